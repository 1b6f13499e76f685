"""Repository scores and finding counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.catalogue import CATEGORY_SCORE, SCORE_WEIGHTS, SEVERITY_PENALTY
from corpuslens.functions.lookup import lookup

ALWAYS_SUPPORTED = ("documentation_score", "architecture_score")


def penalties(findings: DataFrame, key: str = "repo_id") -> DataFrame:
    """Summed penalties per score column; one hash aggregate with map-side combine."""
    penalty = F.coalesce(lookup(F.col("severity"), SEVERITY_PENALTY), F.lit(0))
    target = lookup(F.col("category"), CATEGORY_SCORE)
    return (
        findings.select(key, target.alias("_target"), penalty.alias("_penalty"))
        .groupBy(key)
        .agg(*[F.sum(F.when(F.col("_target") == s, F.col("_penalty"))).alias(f"_p_{s}") for s in SCORE_WEIGHTS])
    )


def overall(scores: dict[str, Column]) -> Column:
    """Half-even rounded weighted mean over the available scores, in doubles in weight order."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for name, w in SCORE_WEIGHTS.items():
        total = total + F.coalesce(scores[name] * F.lit(w), F.lit(0.0))
        weight = weight + F.when(scores[name].isNull(), F.lit(0.0)).otherwise(F.lit(w))
    return F.when(weight > 0, F.bround(total / weight, 0)).cast("int")


def score_repos(findings: DataFrame, facts: DataFrame, key: str = "repo_id") -> DataFrame:
    """Scores per repository from de-duplicated findings and (file_count, has_tests, has_docs)."""
    joined = facts.join(penalties(findings, key), key, "left")
    columns: dict[str, Column] = {}
    for name in SCORE_WEIGHTS:
        value = F.greatest(F.lit(0), F.lit(100) - F.coalesce(F.col(f"_p_{name}"), F.lit(0))).cast("int")
        # A score of exactly 0 counts as 100 before the cap is applied.
        if name == "testing_score":
            value = F.when(F.col("has_tests"), value).otherwise(F.least(F.when(value == 0, 100).otherwise(value), F.lit(40)))
        if name == "documentation_score":
            value = F.when(F.col("has_docs"), value).otherwise(F.least(F.when(value == 0, 100).otherwise(value), F.lit(45)))
        if name not in ALWAYS_SUPPORTED:
            value = F.when(F.col("file_count") > 0, value)
        columns[name] = value.cast("int")
    return joined.select(key, *[c.alias(n) for n, c in columns.items()], overall(columns).alias("overall_score"))


def severity_counts(issues: DataFrame, key: str = "analysis_id") -> DataFrame:
    return issues.groupBy(key).agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low")]
    )


def findings_total(issues: DataFrame, key: str = "analysis_id") -> DataFrame:
    return issues.groupBy(key).agg(F.count("*").alias("total_findings"))


def repo_summary(repositories: DataFrame) -> DataFrame:
    return repositories.groupBy("owner_id").agg(
        F.count("*").alias("repositories"), F.count_if(F.col("is_private")).alias("private_repositories")
    )


def corpus_rollup(issues: DataFrame) -> DataFrame:
    """Finding counts by language, category and severity with subtotals."""
    return (
        issues.groupBy("language", "category", "severity")
        .count()
        .rollup("language", "category", "severity")
        .agg(F.sum("count").alias("findings"), F.grouping_id().cast("int").alias("level"))
    )
