"""Routes and environment variables of Python sources, from one parse per file."""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.predicates import not_in_ignored_dir

# Decorator names of routes, and the kind label.
ROUTE_VERBS = frozenset(("route", "get", "post", "put", "patch", "delete", "options", "head"))
ROUTE_KIND = "page or application route"

FACTS = (
    "repo_id string, file_path string, fact string, name string, line_number int, handler string, "
    "methods array<string>, default_value string, ordinal int"
)


def _text_arg(call: ast.Call, at: int = 0) -> str | None:
    if len(call.args) > at and isinstance(call.args[at], ast.Constant) and isinstance(call.args[at].value, str):
        return call.args[at].value
    return None


def _route(call: ast.expr) -> tuple[str, list[str]] | None:
    """(path, methods) of a route decorator, or None."""
    if not (isinstance(call, ast.Call) and isinstance(call.func, ast.Attribute)):
        return None
    verb, path = call.func.attr.lower(), _text_arg(call)
    if verb not in ROUTE_VERBS or path is None:
        return None
    if verb != "route":
        return path, [verb.upper()]
    methods = ["GET"]
    for keyword in call.keywords:
        if keyword.arg == "methods" and isinstance(keyword.value, (ast.List, ast.Tuple, ast.Set)):
            given = [e.value.upper() for e in keyword.value.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)]
            methods = given or methods
    return path, methods


def _env_name(call: ast.Call) -> str | None:
    func = call.func
    if not isinstance(func, ast.Attribute):
        return None
    via_environ = func.attr == "get" and isinstance(func.value, ast.Attribute) and func.value.attr == "environ"
    return _text_arg(call) or None if via_environ or func.attr == "getenv" else None


def source_facts(source: str) -> list[tuple]:
    """(fact, name, line, handler, methods, default) rows of one file; none if it does not parse."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    rows, seen = [], set()
    for node in ast.walk(tree):
        found = []
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            for path, methods in filter(None, map(_route, node.decorator_list)):
                found.append(("route", path, node.lineno, node.name, methods, None))
        elif isinstance(node, ast.Call) and (name := _env_name(node)):
            given = node.args[1] if len(node.args) > 1 else None
            value = given.value if isinstance(given, ast.Constant) else None
            found.append(("env", name, node.lineno, None, None, None if value is None else repr(value)))
        for row in found:
            if row[:4] not in seen:
                seen.add(row[:4])
                rows.append(row)
    return rows


def python_facts(files: DataFrame) -> DataFrame:
    """All facts of Python files outside ignored directories (the file name counts as a part too)."""
    chosen = files.where(
        not_in_ignored_dir("path", "tree", include_name=True) & F.col("path").endswith(".py")
    ).select("repo_id", "path", "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [
                (repo, path, fact, name, line, handler, methods, default, i)
                for repo, path, content in zip(batch["repo_id"], batch["path"], batch["content"])
                for i, (fact, name, line, handler, methods, default) in enumerate(source_facts(content))
            ]
            yield pd.DataFrame(out, columns=["repo_id", "file_path", "fact", "name", "line_number", "handler",
                                             "methods", "default_value", "ordinal"])

    # A cheap test in the JVM spares the parse of files that can hold neither fact.
    may_hold = F.col("content").contains("@") | F.col("content").contains("environ") | F.col("content").contains("getenv")
    return chosen.where(may_hold).mapInPandas(parse, FACTS)


def routes(files: DataFrame) -> DataFrame:
    return python_facts(files).where(F.col("fact") == "route").select(
        "repo_id", F.col("name").alias("path"), "methods", "handler", "file_path", "line_number",
        F.lit(ROUTE_KIND).alias("route_kind"),
    )


def env_vars(files: DataFrame) -> DataFrame:
    return python_facts(files).where(F.col("fact") == "env").select(
        "repo_id", "name", "default_value", "file_path", "line_number"
    )


def route_methods(files: DataFrame) -> DataFrame:
    """One row per path and method of a repository: handlers, and whether several of them claim it.

    Handlers are counted, and the first is named by file and line: both combine on the map side.
    """
    served = routes(files).select("repo_id", "path", F.explode("methods").alias("method"), "handler", "file_path", "line_number")
    one = served.groupBy("repo_id", "path", "method", "handler", "file_path").agg(F.min("line_number").alias("line_number"))
    return one.groupBy("repo_id", "path", "method").agg(
        F.count(F.lit(1)).alias("handlers"), F.min(F.struct("file_path", "line_number", "handler")).alias("_f")
    ).select(
        "repo_id", "path", "method", "handlers", (F.col("handlers") > 1).alias("duplicate"),
        F.col("_f.handler").alias("first_handler"), F.col("_f.file_path").alias("file_path"), F.col("_f.line_number").alias("line_number"),
    )


def variable_table(files: DataFrame) -> DataFrame:
    """One row per environment variable of a repository: references, files, and its smallest and largest default."""
    per_file = env_vars(files).groupBy("repo_id", "name", "file_path").agg(
        F.count(F.lit(1)).alias("references"), F.min("default_value").alias("low"), F.max("default_value").alias("high"),
        F.count("default_value").alias("given"),
    )
    return per_file.groupBy("repo_id", "name").agg(
        F.sum("references").alias("references"), F.count(F.lit(1)).alias("files"), F.min("low").alias("default_value"),
        ((F.sum("given") > 0) & (F.sum("given") < F.sum("references"))).alias("sometimes_required"),
        (F.min("low") != F.max("high")).alias("defaults_differ"),
    )
