"""Tables, file trees and the writers behind them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions.text import decode_utf8
from corpuslens.schemas import SCHEMAS, content_key
from corpuslens.sources.tree import list_tree, read_tree


def read_table(spark: SparkSession, name: str, location: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """A table of the data model from parquet, or from a database with fmt='jdbc'.

    For jdbc pass url, driver, and partitionColumn / lowerBound / upperBound / numPartitions, so that
    the read is split; location is the database table.
    """
    if fmt == "jdbc":
        return spark.read.format("jdbc").options(dbtable=location, **options).load()
    return spark.read.format(fmt).options(**options).schema(SCHEMAS[name]).load(location)


def scan_files(spark: SparkSession, root: str, repo_depth: int = 1, links: DataFrame | None = None, content: bool = True) -> DataFrame:
    """Reads a tree of checked-out repositories as the files table, empty files and hidden names included.

    ``root`` is a folder, not a pattern, and holds one folder per repository (``repo_depth`` levels down). Symbolic links
    are found where they are, listed without content and never followed; ``links`` (repo_id, path) adds those of a store
    that has none. Without ``content`` only names and sizes are read. The tree's state is that of the listing: what is
    added later is not seen, what is gone is left out.
    """
    if content:
        raw = read_tree(spark, root, repo_depth)
    else:
        raw = list_tree(spark, root, repo_depth).drop("place").withColumn("raw", F.lit(None).cast("binary"))
    listed = raw.select(
        "repo_id", "path", "size_bytes", "is_symlink", decode_utf8("raw").alias("content"),
        F.is_valid_utf8(F.col("raw").cast("string")).alias("utf8_valid"),
    )
    if links is None:
        return listed
    marked = links.select("repo_id", "path", F.lit(True).alias("_link")).distinct()
    joined = listed.join(marked, ["repo_id", "path"], "left").withColumn("is_symlink", F.col("is_symlink") | F.coalesce("_link", F.lit(False)))
    return joined.select(*listed.columns)


def write_issues(findings: DataFrame, path: str, analysis_id: str | None = None) -> None:
    """Appends findings as issues. ``analysis_id`` is a column name or, by default, the repository."""
    keyed = findings.withColumn("analysis_id", F.col(analysis_id or "repo_id"))
    rows = keyed.select(
        content_key("analysis_id", "title", "file_path", "line_number", "category", "source_tool").alias("id"),
        "analysis_id", "title", "severity", "category", "file_path", "line_number", "language", "description",
        "risk", "suggested_fix", "generated_patch", "source_tool",
        F.lit("open").alias("status"),
        F.current_timestamp().alias("created_at"),
        # Issues of one analysis are created in this order; they share created_at.
        F.col("seq_major").cast("bigint").alias("seq_major"), F.col("seq_minor").cast("bigint").alias("seq_minor"),
    )
    rows.repartitionByRange("analysis_id", "seq_major", "seq_minor").sortWithinPartitions("analysis_id", "seq_major", "seq_minor").write.mode("append").parquet(path)


def append_chat_turns(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Two rows per answered question: the user's turn, then the assistant's with its references."""
    joined = questions.join(answers, ["session_id", "turn"])
    user = joined.select(
        "session_id", "turn", F.lit(0).alias("part"), F.lit("user").alias("role"),
        F.col("message").alias("content"), F.lit(None).cast("string").alias("referenced_files"),
    )
    assistant = joined.select(
        "session_id", "turn", F.lit(1).alias("part"), F.lit("assistant").alias("role"),
        F.col("answer").alias("content"), F.array_join("refs", ",").alias("referenced_files"),
    )
    return user.unionByName(assistant)
