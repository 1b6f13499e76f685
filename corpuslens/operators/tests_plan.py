"""Which files to write tests for, and how."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions.naming import suggested_framework, test_file_name
from corpuslens.functions.predicates import is_test_path
from corpuslens.operators.files import with_language
from corpuslens.session import join_small


def test_candidates(issues: DataFrame, files: DataFrame, n: int = 6) -> DataFrame:
    """Per repository the first n language files: those with issues, then those that are not tests."""
    language_files = with_language(files).select("repo_id", "path", "language")
    with_issues = issues.select("repo_id", F.col("file_path").alias("path")).distinct()
    flagged = with_issues.withColumn("_issue", F.lit(True))
    tiers = (
        language_files.join(flagged, ["repo_id", "path"], "left")
        .withColumn("tier", F.when(F.col("_issue"), 1).otherwise(2))
        .where((F.col("tier") == 1) | ~is_test_path("path", "candidate"))
    )
    w = Window.partitionBy("repo_id").orderBy("tier", "path")
    return (
        tiers.withColumn("position", F.row_number().over(w))
        .where(F.col("position") <= n)
        .select("repo_id", "position", "tier", "language", "path")
    )


def suggested_tests(candidates: DataFrame) -> DataFrame:
    return candidates.select(
        "*",
        suggested_framework("language", "path").alias("framework"),
        test_file_name("language", "path").alias("test_file"),
    )


def source_excerpts(paths: DataFrame, files: DataFrame, limit: int | None = None) -> DataFrame:
    """Adds the text of each listed file, or its first ``limit`` characters; (repo_id, path) is unique in files."""
    content = F.col("content") if limit is None else F.substring("content", 1, limit)
    text = files.select("repo_id", "path", content.alias("excerpt"))
    return join_small(text, paths, ["repo_id", "path"], "inner")
