"""Source chunks.

A file is one row, so its chunks are cut inside that row: boundary lines get a mark, the text is split at
the marks, and the pieces are exploded. No shuffle, no window, and time linear in the file's length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.catalogue import CHUNK_BOUNDARY, CHUNK_NEEDS, CHUNK_WINDOW_LINES
from corpuslens.functions.lookup import contains_any
from corpuslens.functions.text import count_char, lines_array, strip
from corpuslens.operators.files import with_language
from corpuslens.operators.numbering import number_within

# Lines hold no carriage return once newlines are unified, so it is free to serve as the mark.
MARK = "\r"


def file_chunks(files: DataFrame) -> DataFrame:
    """One row per file with its chunks as an array of (start_line, end_line, content).

    A file with boundary lines is cut at each of them and what precedes the first is dropped; any
    other file is cut every 60 lines. Blank chunks are dropped and content is stripped.
    """
    flagged = (
        with_language(files)
        .select("repo_id", F.col("path").alias("file_path"), lines_array("content").alias("_lines"))
        .withColumn("_flags", F.transform("_lines", lambda x: contains_any(x, CHUNK_NEEDS) & x.rlike(CHUNK_BOUNDARY)))
    )

    def mark(line, i, cut):
        head = F.when(cut, F.concat(F.lit(MARK), (i + 1).cast("string"), F.lit("\n"))).otherwise(F.lit(""))
        return F.concat(head, line, F.lit("\n"))

    # Lambdas use their own variables only: a column they named could be inlined and redone per line.
    by_boundary = F.transform(F.arrays_zip("_lines", "_flags"), lambda z, i: mark(z["_lines"], i, z["_flags"]))
    by_window = F.transform("_lines", lambda x, i: mark(x, i, i % CHUNK_WINDOW_LINES == 0))

    def chunk(piece):
        start = F.substring_index(piece, "\n", 1).cast("int")
        text = F.substring(piece, F.position(F.lit("\n"), piece) + 1, F.char_length(piece))
        return F.struct(
            start.alias("start_line"),
            (start + count_char(piece, "\n") - 2).cast("int").alias("end_line"),
            strip(text).alias("content"),
        )

    marked = flagged.select("repo_id", "file_path", F.split(
        F.array_join(F.when(F.array_contains("_flags", True), by_boundary).otherwise(by_window), ""), MARK
    ).alias("_pieces"))
    chunks = F.filter(
        F.transform(F.slice("_pieces", F.lit(2), F.greatest(F.size("_pieces") - 1, F.lit(0))), chunk),
        lambda c: c["content"] != "",
    )
    return marked.select("repo_id", "file_path", chunks.alias("_chunks"))


def chunk_files(files: DataFrame) -> DataFrame:
    """One row per chunk: repo_id, file_path, start_line, end_line, content."""
    return (
        file_chunks(files)
        # An inner explode of a column makes Spark infer size(column) > 0 and compute the column a second time
        # below; the outer form with a filter does not.
        .select("repo_id", "file_path", F.explode_outer("_chunks").alias("_c"))
        .where(F.col("_c").isNotNull())
        .select("repo_id", "file_path", "_c.start_line", "_c.end_line", "_c.content")
    )


def build_chunk_index(files: DataFrame) -> DataFrame:
    """Chunks with the id 'path:start-end:ordinal', the ordinal running over the whole repository.

    Files are cut once; the chunks are range-partitioned by repository and place, written, and numbered where they
    lie, so a repository with a third of all files is split and no text is joined.
    """
    numbered = number_within(chunk_files(files), ["repo_id"], ["file_path", "start_line"], "_n")
    name = F.concat(
        "file_path", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"),
        F.lit(":"), (F.col("_n") - 1).cast("string"),
    )
    return numbered.select("repo_id", name.alias("chunk_id"), "file_path", "start_line", "end_line", "content")


def write_chunk_index(index: DataFrame, path: str) -> None:
    """Replaces the chunks of the repositories present in ``index`` and leaves the others.

    Dropping a repository's old chunks first also removes those of files that no longer exist.
    """
    index.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_id").parquet(path)
