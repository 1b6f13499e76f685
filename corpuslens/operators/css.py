"""Stylesheet checks.

Comments are removed per file by one expression. Only lines that hold a brace or a declaration are
shuffled, as two counters, a property name and two flags, to the window partition of their file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens import catalogue as cat
from corpuslens.catalogue import CSS_RULES, SEQ
from corpuslens.functions.text import count_char, lines_array, strip, unix_newlines
from corpuslens.operators.files import with_language

#: Bytes of stylesheets whose lines one task sorts.
BYTES_PER_TASK = 8 << 20
# Fixed value: a property name before the first colon of a stripped line.
PROPERTY = r"(?U)^(--[a-zA-Z0-9_-]+|[a-zA-Z-]+)[\s\x1c-\x1f]*:"


def strip_block_comments(content: Column) -> Column:
    """Removes /* */ comments, keeping every newline so that line numbers stay."""
    pieces = F.regexp_extract_all(
        unix_newlines(content), F.lit(r"(?s)(/\*.*?(?:\*/|\z)|[^/]+|/)"), F.lit(1)
    )
    kept = F.transform(
        pieces, lambda p: F.when(p.startswith("/*"), F.regexp_replace(p, r"[^\n]+", "")).otherwise(p)
    )
    return F.array_join(kept, "")


def _any_start(c: Column, *heads: str) -> Column:
    test = F.lit(False)
    for head in heads:
        test = test | c.startswith(head)
    return test


def _any_end(c: Column, *tails: str) -> Column:
    test = F.lit(False)
    for tail in tails:
        test = test | c.endswith(tail)
    return test


def css_lines(files: DataFrame) -> DataFrame:
    """Stylesheet lines, without comments, that hold a brace, a colon or !important; no other line matters."""
    raw = F.col("_raw")
    return (
        with_language(files)
        .where(F.col("language").isin(*cat.CSS_LANGUAGES))
        .select("repo_id", "path", strip_block_comments(F.col("content")).alias("_clean"))
        .select("repo_id", "path", F.posexplode(lines_array("_clean")).alias("_pos", "_raw"))
        .where(raw.contains(":") | raw.contains("{") | raw.contains("}") | raw.contains("!important"))
        .select("repo_id", "path", (F.col("_pos") + 1).cast("int").alias("line_no"), strip(raw).alias("text"))
    )


def css_line_facts(lines: DataFrame) -> DataFrame:
    text, name = F.col("text"), F.col("_name")
    value = strip(F.substring(text, F.locate(":", text) + 1, F.char_length(text)))
    declaration = (name != "") & ~_any_start(text, "http://", "https://") & ~text.endswith("{")
    unfinished = (
        ~_any_end(text, ";", "{", "}", ",", ":", "\\", ")")
        & (value != "")
        & (count_char(text, "(") == count_char(text, ")"))
    )
    return lines.withColumn("_name", F.regexp_extract(text, PROPERTY, 1)).select(
        "repo_id", "path", "line_no",
        text.contains("!important").alias("important"),
        count_char(text, "{").alias("n_open"),
        count_char(text, "}").alias("n_close"),
        declaration.alias("declaration"),
        F.when(declaration, F.lower(name)).alias("property"),
        (declaration & unfinished).alias("unfinished"),
    )


def tasks_for(files: DataFrame) -> int:
    """Tasks that the lines are dealt to: their number grows with the bytes of the stylesheets, so that a task's memory does not."""
    sheets = with_language(files).where(F.col("language").isin(*cat.CSS_LANGUAGES))
    total = sheets.agg(F.sum(F.col("size_bytes").cast("bigint"))).first()[0] or 0
    return max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BYTES_PER_TASK))


def css_checks(files: DataFrame) -> DataFrame:
    """RC1-RC3 findings. The window partition is one file, which is one row of the input table."""
    per_file = Window.partitionBy("repo_id", "path").orderBy("line_no")
    running = per_file.rowsBetween(Window.unboundedPreceding, 0)
    before = per_file.rowsBetween(Window.unboundedPreceding, -1)
    per_rule = Window.partitionBy("repo_id", "path", "_group", "property").orderBy("line_no")
    facts = css_line_facts(css_lines(files)).repartition(tasks_for(files), "repo_id", "path")
    state = (
        facts.withColumn("_sum", F.sum(F.col("n_open") - F.col("n_close")).over(running))
        .withColumn("_low", F.min("_sum").over(running))
        # Depth never drops below zero: take the lowest running sum so far back out.
        .withColumn("_depth", F.col("_sum") - F.least(F.lit(0), F.col("_low")))
        .withColumn("_inside", (F.lag("_depth", 1, 0).over(per_file) > 0) | (F.col("n_open") > 0))
        .withColumn(
            "_group",
            F.sum((F.col("n_open") > 0).cast("int")).over(running)
            + F.coalesce(F.sum((F.col("n_close") > 0).cast("int")).over(before), F.lit(0)),
        )
        .withColumn("_counted", F.col("declaration") & F.col("_inside"))
        .withColumn("_nth", F.sum(F.col("_counted").cast("int")).over(per_rule))
    )
    tests = {
        "RC1": F.col("important"),
        "RC2": F.col("_counted") & (F.col("_nth") > 1),
        "RC3": F.col("_counted") & F.col("unfinished"),
    }
    about = {
        "RC1": ("The cascade is overridden by force.", "Raise the selector's specificity."),
        "RC2": ("The property is set twice in this rule.", "Keep one of the declarations."),
        "RC3": ("The declaration has no semicolon.", "End it with a semicolon."),
    }
    hits = F.array_compact(
        F.array(
            *[
                F.when(
                    test,
                    F.struct(
                        F.lit(rid).alias("rule_id"),
                        F.lit(CSS_RULES[rid][0]).alias("severity"),
                        F.lit(CSS_RULES[rid][1]).alias("category"),
                        F.lit(CSS_RULES[rid][2]).alias("title"),
                        F.lit(about[rid][0]).alias("description"),
                        F.lit(about[rid][1]).alias("suggested_fix"),
                        F.lit(i).alias("k"),
                    ),
                )
                for i, (rid, test) in enumerate(tests.items())
            ]
        )
    )
    return state.select("repo_id", "path", "line_no", F.explode(hits).alias("_h")).select(
        "repo_id",
        "_h.rule_id", "_h.title", "_h.severity", "_h.category",
        F.col("path").alias("file_path"),
        F.col("line_no").alias("line_number"),
        F.lit("CSS").alias("language"),
        "_h.description",
        F.lit(None).cast("string").alias("risk"),
        "_h.suggested_fix",
        F.lit(None).cast("string").alias("generated_patch"),
        F.lit("scan-css-checks").alias("source_tool"),
        F.lit(SEQ["css"]).alias("seq_major"),
        F.col("_h.k").cast("bigint").alias("seq_minor"),
    )
