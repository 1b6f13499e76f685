"""Generated fixes: parsing, acceptance checks, selection and change lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.text import normal_path, strip, wide_lines_array
from corpuslens.operators.findings import first_wins

# Response sections, fences, heading marks, the placeholder for "no fix", and words that betray prose.
SECTIONS = ("IMPROVED_CODE", "EXPLANATION", "SIDE_EFFECTS", "IMPROVEMENT")
NO_FIX = "VALIDATION_REQUIRED"
COMMIT_PROSE = (
    r"(?imUd)^\s*(however|here is the corrected version|alternative implementation|explanation"
    r"|side effects|improvement)\s*[:.]?"
)
GENERATION_PROSE = r"(?imUd)^\s*(however|here is the corrected version|alternative|explanation)\s*[:.]?"
PHP_BANNED = ("filter_sanitize_string", "password_verify($pwd, password_hash(", "here is the corrected version")
OPEN_FENCE = r"(?U)^\s*```[a-zA-Z0-9_+#.-]*\s*\n?"
CLOSE_FENCE = r"(?U)\n?\s*```\s*\z"
MAX_GROWTH, MAX_EXTRA = 4, 12_000


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def heading(line: Column) -> Column:
    """A line as a section heading: list, emphasis and colon marks removed, upper case."""
    bare = F.regexp_replace(strip(line), r"(?U)^[#*\-\s]+", "")
    return F.upper(strip(F.regexp_replace(bare, r"(?U)[*:\s]+\z", "")))


def parse_fix_sections(responses: DataFrame, column: str = "raw_response") -> DataFrame:
    """Adds the four sections of a response and ``valid`` (a non-blank code section).

    Headings get a mark, the text is cut at the marks, and the pieces of each section are joined in order.
    """
    marked = F.array_join(
        F.transform(
            wide_lines_array(column),
            lambda x: F.when(heading(x).isin(*SECTIONS), F.concat(F.lit("\r"), heading(x), F.lit("\n"))).otherwise(
                F.concat(x, F.lit("\n"))
            ),
        ),
        "",
    )
    pieces = responses.withColumn("_pieces", F.split(marked, "\r"))
    tail = F.slice("_pieces", F.lit(2), F.greatest(F.size("_pieces") - 1, F.lit(0)))

    def section(name: str) -> Column:
        own = F.filter(tail, lambda p: F.substring_index(p, "\n", 1) == name)
        return F.array_join(F.transform(own, lambda p: F.substring(p, F.lit(len(name) + 2), F.char_length(p))), "")

    out = pieces
    for name in SECTIONS:
        out = out.withColumn(name.lower(), section(name))
    return out.drop("_pieces").withColumn("valid", strip("improved_code") != "")


def clean_fences(content: Column | str) -> Column:
    """Text without one opening and one closing code fence."""
    inner = F.regexp_replace(strip(content), OPEN_FENCE, "")
    return strip(F.regexp_replace(inner, CLOSE_FENCE, ""))


def clean_code_error(cleaned: Column) -> Column:
    return F.when(cleaned.contains("```"), "unexpected code fence").when(
        cleaned.rlike(GENERATION_PROSE), "explanatory text"
    )


def _php_error(lowered: Column) -> Column:
    error = F.when(~lowered.contains("<?php"), "no PHP opening tag")
    for text, reason in zip(PHP_BANNED, ("deprecated filter", "hashes on every check", "explanatory text")):
        error = error.when(lowered.contains(text), reason)
    return error


def commit_reject_reason(path: Column | str, patch: Column | str) -> Column:
    """First failing check of a patch about to be committed, or NULL."""
    text = strip(F.coalesce(_c(patch), F.lit("")))
    lowered, lower_path = F.lower(text), F.lower(_c(path))
    php = lower_path.endswith(".php")
    html = lower_path.endswith(".html") | lower_path.endswith(".htm")
    return (
        F.when(text == "", "empty")
        .when(text == NO_FIX, "needs manual validation")
        .when(text.contains("```"), "contains code fences")
        .when(text.rlike(COMMIT_PROSE), "contains explanatory text")
        .when(php, _php_error(lowered))
        .when(html & lowered.contains("<html") & ~lowered.contains("</html>"), "incomplete HTML")
    )


def generation_reject_reason(path: Column | str, original: Column | str, improved: Column | str, language: Column | str) -> Column:
    """First failing check of a freshly generated file against its original, or NULL."""
    old, new = _c(original), _c(improved)
    n_old, n_new = F.char_length(old), F.char_length(new)
    ext = F.substring_index(F.lower(_c(path)), ".", -1)
    php = (F.lower(strip(F.coalesce(_c(language), F.lit("")))) == "php") | (ext == "php")
    html = ext.isin("html", "htm")
    return F.coalesce(
        F.when(new == "", "empty")
        .when(strip(new) == NO_FIX, "no confident fix")
        .when(n_new > F.greatest(n_old * MAX_GROWTH, n_old + MAX_EXTRA), "unexpectedly large"),
        F.when(php, _php_error(F.lower(new))),
        F.when(html & F.lower(old).contains("<html") & ~F.lower(new).contains("<html"), "document root removed"),
    )


def patch_commit_check(patches: DataFrame) -> DataFrame:
    return patches.withColumn("reject_reason", commit_reject_reason("file_path", "generated_patch"))


def patch_generation_check(responses: DataFrame) -> DataFrame:
    """Parses, cleans and checks responses; ``reject_reason`` is NULL for an acceptable file."""
    parsed = parse_fix_sections(responses).withColumn("improved", clean_fences("improved_code"))
    reason = F.coalesce(
        F.when(~F.col("valid"), "no code section"),
        clean_code_error(F.col("improved")),
        generation_reject_reason("file_path", "original_code", "improved", "language"),
    )
    return parsed.withColumn("reject_reason", reason)


def latest_patches(issues: DataFrame, key: str = "analysis_id") -> DataFrame:
    """Newest non-empty patch per (analysis, normalised path)."""
    patched = (
        issues.where(F.col("generated_patch").isNotNull() & (F.col("generated_patch") != ""))
        .withColumn("file_path", normal_path("file_path"))
        .where(F.col("file_path") != "")
    )
    return first_wins(patched, (key, "file_path"), [F.col("created_at").desc(), F.col("id")])


def pr_change_set(issues: DataFrame, key: str = "analysis_id") -> DataFrame:
    """Body lines of the change list, one row per line, for analyses whose every latest patch passes.

    Sort by (analysis, part, file_path) and join with newlines to get the text; a change list of any
    length is never gathered into one cell.
    """
    checked = patch_commit_check(latest_patches(issues, key))
    per_analysis = checked.groupBy(key).agg(F.bool_and(F.col("reject_reason").isNull()).alias("ok"), F.count("*").alias("files"))
    accepted = per_analysis.where("ok").select(key, "files")
    head = accepted.select(
        key, F.lit(0).alias("part"), F.lit("").alias("file_path"),
        F.concat(F.lit("Automated fixes ("), F.substring(F.col(key).cast("string"), 1, 8), F.lit("): "),
                 F.col("files").cast("string"), F.lit(" files")).alias("line"),
    )
    body = checked.join(accepted, key, "left_semi").select(
        key, F.lit(1).alias("part"), "file_path", F.concat(F.lit("- `"), "file_path", F.lit("`")).alias("line")
    )
    return head.unionByName(body)
