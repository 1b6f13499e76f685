"""Appending, de-duplicating and comparing findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.schemas import FINDING_COLUMNS

TOOL_KEY = ("repo_id", "title", "file_path", "line_number", "source_tool")
GLOBAL_KEY = ("repo_id", "title", "file_path", "line_number", "category", "source_tool")


def union_findings(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [p.select(*FINDING_COLUMNS) for p in parts])


def first_wins(df: DataFrame, key: tuple[str, ...], order: list[Column | str]) -> DataFrame:
    """Keeps the first row of every key. NULL keys are equal to each other.

    The filter on row_number lets Spark keep one row per key in each map task before the shuffle
    (a group limit), so a key that fills a third of the input still arrives as a few rows.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def dedup_findings(findings: DataFrame, key: tuple[str, ...] = GLOBAL_KEY) -> DataFrame:
    """Severity and description are not part of the key; the first in analyzer order is kept."""
    return first_wins(findings, key, ["seq_major", "seq_minor", "severity", "description"])


def diff_issues(previous: DataFrame, current: DataFrame, key: tuple[str, ...] = GLOBAL_KEY) -> DataFrame:
    """new / persisting / resolved findings between two analyses, one row per key.

    One aggregation over both sides instead of a full outer join: equal keys combine on the map side.
    """
    both = previous.select(*key, F.lit(1).alias("_old"), F.lit(0).alias("_new")).unionByName(
        current.select(*key, F.lit(0).alias("_old"), F.lit(1).alias("_new"))
    )
    state = both.groupBy(*key).agg(F.max("_old").alias("_old"), F.max("_new").alias("_new"))
    return state.select(
        *key,
        F.when((F.col("_old") == 1) & (F.col("_new") == 1), "persisting")
        .when(F.col("_new") == 1, "new")
        .otherwise("resolved")
        .alias("change"),
    )
