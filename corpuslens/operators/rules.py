"""Line and file rules.

Every rule of the catalogue becomes a literal predicate, so each pattern is compiled once per task and
the whole scan is one narrow pass over the files: read, explode lines, test, emit. Nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens import catalogue as cat
from corpuslens.catalogue import RULES, SEQ, Rule
from corpuslens.functions.lookup import contains_any, sql_literal
from corpuslens.functions.predicates import language_of, not_in_ignored_dir, security_scannable
from corpuslens.functions.text import char_indent, line_count, lines_array, strip
from corpuslens.schemas import FINDING_COLUMNS

LINE_FAMILIES = ("common", "language", "php", "html", "security")


# The HTML checks on a lower-case line.
_HTML_TESTS = {
    "img_alt": "contains({low}, '<img') AND NOT contains({low}, 'alt=')",
    "inline_handler": "contains({low}, 'on') AND contains({low}, '=') AND {low} RLIKE '(?U)\\\\son\\\\w+\\\\s*='",
    "noopener": "contains({low}, 'target=\"_blank\"') AND NOT contains({low}, 'noopener')",
    "input_type": "contains({low}, '<input') AND NOT contains({low}, 'type=')",
    "blocking_script": "contains({low}, '<script') AND contains({low}, 'src=')"
    " AND NOT contains({low}, 'defer') AND NOT contains({low}, 'async')",
}


def _holds_one(column: str, tokens: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, {sql_literal(t)})" for t in tokens) + ")"


def _line_test(rule: Rule) -> str:
    """The rule's predicate over (line, language, _secure), cheapest test first."""
    gate = {"security": "_secure", "common": "language IS NOT NULL"}.get(
        rule.family, f"language = {sql_literal(rule.language)}"
    )
    tests = [gate]
    if rule.kind == "text":
        tests.append(f"contains(line, {sql_literal(rule.pattern)})")
    elif rule.kind == "html":
        tests.append(_HTML_TESTS[rule.pattern].format(low="lower(line)"))
    else:
        tests += [_holds_one("line", group) for group in cat.NEEDS.get(rule.rule_id, ())]
        if rule.rule_id in cat.NEEDS_LOWER:
            tests.append(_holds_one("lower(line)", cat.NEEDS_LOWER[rule.rule_id]))
        tests.append(f"line RLIKE {sql_literal(rule.pattern)}")
    return "(" + " AND ".join(tests) + ")"


_SEQ = {"php": SEQ["php"], "html": SEQ["html"], "common": SEQ["language"], "language": SEQ["language"],
        "security": SEQ["security"], "css": SEQ["css"]}
# File rule: analyzer, whose order and language label it takes; description; suggested fix.
_FILE_TEXT = {
    "RF1": ("language", "The file is long.", "Split the file."),
    "RF2": ("language", "A loop inside a loop may take quadratic time.", "Use a lookup instead of the inner loop."),
    "RP9": ("php", "The file is long.", "Split the file."),
    "RH6": ("html", "The root element states no language.", "Add a lang attribute."),
    "RC4": ("css", "The stylesheet is long.", "Split the stylesheet."),
}


_FIELDS = ("rule_id", "source_tool", "severity", "category", "title", "description", "risk", "suggested_fix", "seq_major", "label")


def _rule_text(*values) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {sql_literal(x)}" for k, x in zip(_FIELDS, values)) + ")"


def _line_rule_texts(rules: list[Rule]) -> list[str]:
    return [
        _rule_text(r.rule_id, r.tool, r.severity, r.category, r.title, r.description, r.risk, r.suggested_fix,
                   _SEQ[r.family], "none" if r.family == "security" else "file")
        for r in rules
    ]


def _file_rule_texts() -> list[str]:
    out = []
    for rid, (tool, severity, category, title) in cat.FILE_RULES.items():
        family, description, fix = _FILE_TEXT[rid]
        out.append(_rule_text(rid, tool, severity, category, title, description, None, fix, _SEQ[family],
                              "css" if family == "css" else "file"))
    return out


def _file_rule_hits(content: Column, language: Column, first: int) -> Column:
    """Numbers, from ``first`` on, of the file rules that fire."""
    n = line_count(content)
    lowered = F.lower(content)
    tests = {
        "RF1": n > cat.LARGE_SOURCE_LINES,
        "RF2": language.isin(list(cat.LOOP_TOKENS)) & (nested_loop_count(content, language) > 0),
        "RP9": (language == "PHP") & (n > cat.LARGE_SOURCE_LINES),
        "RH6": (language == "HTML") & lowered.contains("<html") & ~lowered.contains('lang="'),
        "RC4": language.isin(*cat.CSS_LANGUAGES) & (n > cat.LARGE_STYLESHEET_LINES),
    }
    hits = [F.when(tests[rid], F.lit(first + i)) for i, rid in enumerate(cat.FILE_RULES)]
    return F.array_compact(F.array(*hits))


def _scan_frame(files: DataFrame, security_max_bytes: int | None) -> DataFrame:
    """Files any scan reads: language files and security-scannable files, flagged for both."""
    language = F.when(not_in_ignored_dir("path", "language"), language_of("path"))
    return (
        files.select(
            "repo_id", "path", "content",
            language.alias("language"),
            F.coalesce(security_scannable("path", security_max_bytes), F.lit(False)).alias("_secure"),
        )
        .where(F.col("language").isNotNull() | F.col("_secure"))
    )


def _findings(hits: DataFrame, texts: list[str]) -> DataFrame:
    """Findings from (repo_id, path, language, line_number, _rule), the rule texts looked up in a literal."""
    label = F.col("_r.label")
    return hits.withColumn("_r", F.element_at(F.expr(f"array({', '.join(texts)})"), F.col("_rule") + 1)).select(
        "repo_id", "_r.rule_id", "_r.title", "_r.severity", "_r.category",
        F.col("path").alias("file_path"),
        F.when(F.col("_r.rule_id") == "RH6", F.lit(1)).otherwise(F.col("line_number")).cast("int").alias("line_number"),
        F.when(label == "css", F.lit("CSS")).when(label == "file", F.col("language")).alias("language"),
        "_r.description", "_r.risk", "_r.suggested_fix",
        F.lit(None).cast("string").alias("generated_patch"),
        "_r.source_tool", "_r.seq_major",
        F.col("_rule").cast("bigint").alias("seq_minor"),
    )


def match_rules(
    files: DataFrame, families: tuple[str, ...] = LINE_FAMILIES, file_rules: bool = False, security_max_bytes: int | None = None
) -> DataFrame:
    """Findings of the chosen line-rule families; with ``file_rules`` also the file-level ones, in the same pass.

    Files of any size are searched for secrets unless ``security_max_bytes`` is given.
    """
    rules = [r for r in RULES if r.family in families]
    scan = _scan_frame(files, security_max_bytes)
    if families == ("security",):
        scan = scan.where(F.col("_secure"))
    elif "security" not in families:
        scan = scan.where(F.col("language").isNotNull())
        if "common" not in families:
            scan = scan.where(F.col("language").isin(sorted({r.language for r in rules})))
    none = F.array().cast("array<int>")
    per_file = F.when(
        F.col("language").isNotNull(), _file_rule_hits(F.col("content"), F.col("language"), len(rules))
    ).otherwise(none)
    lines = scan.withColumn("_file_hits", per_file if file_rules else none).select(
        "repo_id", "path", "language", "_secure", "_file_hits", F.posexplode(lines_array("content")).alias("_pos", "line")
    )
    tests = [_line_test(r) for r in rules]
    wanted = F.expr(" OR ".join(tests))
    on_line = F.expr(f"array_compact(array({', '.join(f'IF({t}, {i}, NULL)' for i, t in enumerate(tests))}))")
    if file_rules:
        # File-level findings ride on the first line; a file without lines has none.
        first = (F.col("_pos") == 0) & (F.size("_file_hits") > 0)
        wanted = first | wanted
        on_line = F.concat(F.when(first, F.col("_file_hits")).otherwise(none), on_line)
    # The filter runs in generated code and stops at the first hit; only hit lines build the array.
    hits = lines.where(wanted).select(
        "repo_id", "path", "language",
        (F.col("_pos") + 1).alias("_line"),
        F.explode(on_line).alias("_rule"),
    ).withColumn("line_number", F.when(F.col("_rule") < len(rules), F.col("_line")))
    return _findings(hits, _line_rule_texts(rules) + _file_rule_texts())


def scan_findings(files: DataFrame, security_max_bytes: int | None = None) -> DataFrame:
    """Every line and file rule in one pass over the files."""
    return match_rules(files, LINE_FAMILIES, file_rules=True, security_max_bytes=security_max_bytes)


def _holds(tokens):
    return lambda line: contains_any(strip(line), tokens)


def nested_loop_count(content: Column, language: Column) -> Column:
    """Loop lines indented deeper than the loop line before them.

    Computed inside the file's own row: a filter over its lines, then a fold over the indents.
    """
    by_tokens: dict[tuple, list[str]] = {}
    for lang, tokens in cat.LOOP_TOKENS.items():
        by_tokens.setdefault(tokens, []).append(lang)
    lines = lines_array(content)
    loops = F.array().cast("array<string>")
    for tokens, langs in by_tokens.items():
        # The language is tested once per file, outside the lambda.
        loops = F.when(
            language.isin(langs) & contains_any(content, [t.strip() for t in tokens]),
            F.filter(lines, _holds(tokens)),
        ).otherwise(loops)
    indents = F.transform(loops, char_indent)
    start = F.struct(F.lit(None).cast("int").alias("prev"), F.lit(0).alias("n"))
    folded = F.aggregate(
        indents,
        start,
        lambda acc, x: F.struct(
            x.alias("prev"), (acc["n"] + F.when(x > acc["prev"], 1).otherwise(0)).alias("n")
        ),
    )
    return folded["n"]


def nested_loops(files: DataFrame) -> DataFrame:
    """Nested-loop count of every file in a language that has loop tokens, where it is above zero."""
    from corpuslens.operators.files import with_language

    count = nested_loop_count(F.col("content"), F.col("language"))
    return (
        with_language(files)
        .where(F.col("language").isin(list(cat.LOOP_TOKENS)))
        .select("repo_id", "path", "language", count.alias("nested_count"))
        .where(F.col("nested_count") > 0)
    )


def file_findings(files: DataFrame) -> DataFrame:
    """File-level findings alone: size limits, nested loops, and the HTML language check."""
    from corpuslens.operators.files import with_language

    hits = with_language(files).select(
        "repo_id", "path", "language", F.lit(None).cast("int").alias("line_number"),
        F.explode(_file_rule_hits(F.col("content"), F.col("language"), 0)).alias("_rule"),
    )
    return _findings(hits, _file_rule_texts())

