"""A chunk index that is brought up to date instead of being written anew.

Chunks lie in a fixed number of buckets by a hash of repository and file, each with the hash of its content and, once it is
known, its vector. An update compares keys and content hashes with what is stored by one full outer join of narrow rows, and
rewrites the buckets that differ; there, chunks whose content is unchanged keep their vector, also when they have moved
within their repository. Chunks of files that are gone go with the update. Only ``chunk_id`` carries the running number
of a repository, which one new chunk shifts for all that follow; so it is worked out when the index is read.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.operators.numbering import number_within
from corpuslens.session import join_small, scratch_path

BUCKETS = 256
KEY = ["repo_id", "file_path", "start_line", "end_line"]
STORED = "repo_id string, file_path string, start_line int, end_line int, content string, hash string, embedding array<float>, bucket int"


class Update(NamedTuple):
    """Chunks that came, went, changed their content at their place, and stayed; and the buckets that were rewritten."""

    added: int
    removed: int
    changed: int
    same: int
    buckets: list[int]


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def stored_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The rows of an index as they are stored; none where there is no index yet."""
    if not _exists(spark, path):
        return spark.createDataFrame([], STORED)
    return spark.read.schema(STORED).parquet(path).where("repo_id IS NOT NULL")


def read_chunk_index(spark: SparkSession, path: str) -> DataFrame:
    """The index with ``chunk_id`` ('path:start-end:number in the repository'), content, hash and vector."""
    rows = number_within(stored_chunks(spark, path).drop("bucket"), ["repo_id"], ["file_path", "start_line", "end_line"], "_n")
    name = F.concat("file_path", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit(":"), (F.col("_n") - 1).cast("string"))
    return rows.select("repo_id", name.alias("chunk_id"), "file_path", "start_line", "end_line", "content", "hash", "embedding")


def _rewrite(rows: DataFrame, buckets: list[int], path: str) -> None:
    """Replaces whole buckets. One that has no chunk any more gets a row without a repository, which no reader sees."""
    spark = rows.sparkSession
    # The rows come from the buckets that are replaced, so they are written elsewhere first.
    place = scratch_path(spark, "chunk-buckets")
    marks = spark.createDataFrame([(b,) for b in buckets], "bucket int")
    for f in rows.schema.fields:
        if f.name != "bucket":
            marks = marks.withColumn(f.name, F.lit(None).cast(f.dataType))
    rows.unionByName(marks.select(rows.columns)).write.parquet(place)
    fresh = spark.read.schema(rows.schema).parquet(place)
    fresh.repartition("bucket").sortWithinPartitions("bucket", *KEY).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def update_chunk_index(chunks: DataFrame, path: str, repositories: DataFrame | None = None, buckets: int = BUCKETS) -> Update:
    """Makes the index hold exactly ``chunks`` (repo_id, file_path, start_line, end_line, content) for their repositories, and
    for those in ``repositories`` (repo_id) that have none any more; other repositories are left alone. ``buckets`` must be the
    same in every update of an index. A second run with the same chunks rewrites nothing."""
    spark = chunks.sparkSession
    bucket = F.pmod(F.xxhash64("repo_id", "file_path"), F.lit(buckets)).cast("int")
    place = scratch_path(spark, "new-chunks")
    new = chunks.select(*KEY, "content").withColumns({"hash": F.sha2(F.encode("content", "utf-8"), 256), "bucket": bucket})
    new.write.parquet(place)
    new = spark.read.schema(new.schema).parquet(place)
    scope = new.select("repo_id") if repositories is None else new.select("repo_id").unionByName(repositories.select("repo_id"))
    scope = scope.distinct().withColumn("_in", F.lit(True))
    old = join_small(stored_chunks(spark, path), scope, "repo_id", "left")
    inside = old.where("_in").select(*KEY, F.col("hash").alias("_old"), F.col("bucket").alias("_b"))
    both = inside.join(new.select(*KEY, "hash", "bucket"), KEY, "full_outer").select(
        F.coalesce("bucket", "_b").alias("bucket"),
        F.when(F.col("_old").isNull(), "added").when(F.col("hash").isNull(), "removed").when(F.col("_old") != F.col("hash"), "changed").otherwise("same").alias("kind"),
    )
    found = both.groupBy("bucket", "kind").count().collect()  # four numbers for each bucket at most
    totals = {k: sum(r["count"] for r in found if r["kind"] == k) for k in ("added", "removed", "changed", "same")}
    touched = sorted({r["bucket"] for r in found if r["kind"] != "same"})
    if touched:
        vectors = old.where("_in AND embedding IS NOT NULL").select("repo_id", "hash", "embedding").dropDuplicates(["repo_id", "hash"])
        fresh = new.where(F.col("bucket").isin(touched)).join(vectors, ["repo_id", "hash"], "left")
        others = old.where(F.col("_in").isNull() & F.col("bucket").isin(touched))
        columns = [*KEY, "content", "hash", "embedding", "bucket"]
        _rewrite(fresh.select(columns).unionByName(others.select(columns)), touched, path)
    return Update(**totals, buckets=touched)


def without_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Contents that still need a vector, each once per repository: repo_id, hash, content."""
    return stored_chunks(spark, path).where("embedding IS NULL").select("repo_id", "hash", "content").dropDuplicates(["repo_id", "hash"])


def set_vectors(vectors: DataFrame, path: str) -> list[int]:
    """Stores vectors (repo_id, hash, embedding) with the chunks of that content; gives the buckets that were rewritten."""
    spark = vectors.sparkSession
    stored = stored_chunks(spark, path)
    given = vectors.select("repo_id", "hash", F.col("embedding").cast("array<float>").alias("_given")).dropDuplicates(["repo_id", "hash"])
    touched = sorted(r[0] for r in stored.join(given.select("repo_id", "hash"), ["repo_id", "hash"], "left_semi").select("bucket").distinct().collect())
    if touched:
        rows = stored.where(F.col("bucket").isin(touched)).join(given, ["repo_id", "hash"], "left")
        columns = [*KEY, "content", "hash", "embedding", "bucket"]
        _rewrite(rows.withColumn("embedding", F.coalesce("_given", "embedding")).select(columns), touched, path)
    return touched
