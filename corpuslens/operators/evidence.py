"""Evidence bundles about a repository, as text for whoever writes its description."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.naming import location
from corpuslens.functions.predicates import is_entry_point
from corpuslens.operators.files import dependency_manifests, detect_frameworks, first_paths, language_stats, with_language
from corpuslens.operators.dependencies import dependencies, manifest_slice
from corpuslens.session import pin
from corpuslens.sources.python_source import python_facts


def architecture_evidence(files: DataFrame, entries: int) -> DataFrame:
    """Languages, frameworks, entry points and the first ``entries`` paths per repository, gathered into cells."""
    repos = files.select("repo_id").distinct()
    tree = (
        first_paths(files, entries, walk="language")
        .groupBy("repo_id")
        .agg(
            F.array_sort(F.collect_list("path")).alias("_tree"),
            F.array_sort(F.collect_list(F.when(is_entry_point("path"), F.col("path")))).alias("_entry"),
        )
    )
    langs = language_stats(files).groupBy("repo_id").agg(
        F.array_sort(
            F.collect_list(F.concat("language", F.lit(" ("), F.col("files").cast("string"), F.lit(" files)")))
        ).alias("_langs")
    )
    works = detect_frameworks(files).groupBy("repo_id").agg(F.array_sort(F.collect_set("framework")).alias("_works"))

    def text(name: str, sep: str, empty: str) -> Column:
        return F.coalesce(F.nullif(F.array_join(name, sep), F.lit("")), F.lit(empty))

    return (
        repos.join(tree, "repo_id", "left")
        .join(langs, "repo_id", "left")
        .join(works, "repo_id", "left")
        .select(
            "repo_id",
            text("_langs", ", ", "").alias("languages"),
            text("_works", ", ", "none detected").alias("frameworks"),
            text("_entry", ", ", "none obviously named").alias("entry_points"),
            text("_tree", "\n", "").alias("file_tree"),
        )
    )


# Fixed values, here and in the lines below: section number, name and the line that stands for an empty section.
SECTIONS = (
    (1, "languages", "- None detected"),
    (2, "manifests", "- None detected"),
    (3, "dependencies", "- None detected"),
    (4, "routes", "- No verified application routes detected"),
    (5, "environment", "- No verified environment-variable references detected"),
    (6, "tree", "- No repository files detected"),
)


def documentation_evidence(files: DataFrame, entries: int | None = None) -> DataFrame:
    """Evidence lines (repo_id, section_no, section, sort_key, line); sort by them to get the text.

    With ``entries`` the file tree stops after so many paths per repository.

    Lists such as dependencies have no bound, so every line stays a row and nothing is gathered.
    """

    def lines(df: DataFrame, no: int, key: Column, line: Column) -> DataFrame:
        return df.select("repo_id", F.lit(no).alias("section_no"), key.cast("string").alias("sort_key"), line.alias("line"))

    bullet = lambda c: F.concat(F.lit("- "), c)
    langs = with_language(files).select("repo_id", "language").distinct()
    deps = dependencies(manifest_slice(files))
    version = F.when(F.coalesce("version", F.lit("")) != "", F.concat(F.lit("=="), "version")).otherwise(" (version not pinned)")
    dep_line = F.concat(F.lit("- "), "name", version, F.lit(" ["), "ecosystem", F.lit("; "), "manifest", F.lit("]"))
    where = location("file_path", "line_number")
    route_line = F.concat(
        F.lit("- "), F.array_join("methods", ", "), F.lit(" "), "name", F.lit(" → "), "handler",
        F.lit(" (page or application route; "), where, F.lit(")"),
    )
    env_line = F.concat(
        F.lit("- "), "name", F.lit(": "),
        F.coalesce(F.concat(F.lit("default="), "default_value"), F.lit("no default detected")),
        F.lit("; referenced at "), where,
    )
    order = F.concat_ws("\u0001", "file_path", F.format_string("%09d", F.col("ordinal")))
    is_route = F.col("fact") == "route"
    in_source = python_facts(files).select(
        "repo_id", F.when(is_route, 4).otherwise(5).alias("section_no"), order.alias("sort_key"),
        F.when(is_route, route_line).otherwise(env_line).alias("line"),
    )
    tree = repo_tree(files).select("repo_id", "path") if entries is None else first_paths(files, entries, walk="tree")
    # Read twice below, so it is kept rather than computed twice.
    found = pin(
        lines(langs, 1, F.col("language"), bullet(F.col("language")))
        .unionByName(lines(dependency_manifests(files), 2, F.col("path"), bullet(F.col("path"))))
        .unionByName(lines(deps, 3, F.concat_ws("\u0001", "manifest", "name", "version"), dep_line))
        .unionByName(in_source)
        .unionByName(lines(tree, 6, F.col("path"), bullet(F.col("path"))))
    )
    every = files.select("repo_id").distinct().select(
        "repo_id", F.explode(F.array(*[F.lit(no) for no, _, _ in SECTIONS])).alias("section_no")
    )
    fallback = F.element_at(F.array(*[F.lit(text) for _, _, text in SECTIONS]), F.col("section_no"))
    # A repository has an empty section if no line of that section exists: present sections are few per repository.
    present = found.select("repo_id", "section_no").distinct()
    empty = every.join(present, ["repo_id", "section_no"], "left_anti").select(
        "repo_id", "section_no", F.lit("").alias("sort_key"), fallback.alias("line")
    )
    name = F.element_at(F.array(*[F.lit(n) for _, n, _ in SECTIONS]), F.col("section_no"))
    return found.unionByName(empty).select("repo_id", "section_no", name.alias("section"), "sort_key", "line")
