"""An inverted-file index over chunk vectors: each chunk lies in the list of its nearest centroid, questions probe few lists.

Centroids are learned by Lloyd's rounds in Spark on a bounded sample; the driver and the tasks only hold the centroids, whose
number has a bound. Every chunk is assigned and stored in the folder of its list, so a search reads the folders it probes.
The probed chunks are ranked by their exact distances: what a search misses is in lists it did not probe. Without a number
of probes all lists are searched, which is the exact answer.

A question only searches its own repository, so it probes the nearest of the lists that hold chunks of that repository;
small repositories therefore need no more probes than they have lists. Vectors of another length than the index's own are
kept in list -1, which is always probed; rows without a vector are not indexed (``retrieval.without_vector`` lists them).
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpuslens.operators.retrieval import retrieve_chunks, searchable
from corpuslens.session import join_small, scratch_path

#: Lists an index may have; with ``VALUES`` it bounds what is broadcast: at most 32 MB of centroids.
MOST_LISTS = 4096
VALUES = 4 << 20
#: Rows of the sample for each list, and rounds of learning.
SAMPLE_PER_LIST, ROUNDS = 64, 8
PROBES = 32
#: Chunks of a file of the index.
FILE_ROWS = 200_000
#: Chunks of the lists that a question that searches all of them meets at a time; with a last list, mostly within a block of ``retrieve_chunks``.
CELL_ROWS = 16_000
OTHER = -1


def assign(vectors: np.ndarray, centroids: np.ndarray, step: int = 4096) -> np.ndarray:
    """The nearest centroid of each vector, the first of equal ones."""
    own = np.einsum("ij,ij->i", centroids, centroids)
    return np.concatenate([(own - 2 * (vectors[i : i + step] @ centroids.T)).argmin(axis=1) for i in range(0, len(vectors), step)] or [np.zeros(0, np.int64)])


def _matrix(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of an array column that have ``size`` values, as numbers of rows and a matrix."""
    lengths = np.array([len(v) if v is not None else -1 for v in column.to_pylist()]) if column.null_count else column.value_lengths().to_numpy()
    rows = np.flatnonzero(lengths == size)
    values = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return rows, values.reshape(len(rows), size)


def learn_centroids(chunks: DataFrame, lists: int | None = None, sample_per_list: int = SAMPLE_PER_LIST, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of the most frequent vector length. By default as many lists as the square root of the rows, up to
    ``MOST_LISTS``. The sample, about ``sample_per_list`` rows for each list, is taken by a hash of the chunk."""
    rows = chunks.where(searchable()).select(F.xxhash64("repo_id", "chunk_id").alias("h"), "embedding")
    sizes = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    if not sizes:
        return np.zeros((0, 0))
    size, total = sizes[0]
    wanted = max(1, min(lists or round(math.sqrt(total)), MOST_LISTS, VALUES // size, total))
    share = min(1.0, 1.2 * wanted * sample_per_list / total)
    place = scratch_path(chunks.sparkSession, "vector-sample")
    low = -(1 << 63) + int(share * ((1 << 64) - 1))
    rows.where((F.size("embedding") == size) & (F.col("h") <= F.lit(min(low, (1 << 63) - 1)))).write.parquet(place)
    sample = chunks.sparkSession.read.schema(rows.schema).parquet(place)
    first = sample.orderBy("h").limit(wanted).collect()
    centroids = np.array([r["embedding"] for r in first], np.float64).reshape(len(first), size)
    parts = "list int, n bigint, total array<double>"
    for _ in range(rounds if len(centroids) > 1 else 0):
        shared = chunks.sparkSession.sparkContext.broadcast(centroids)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros_like(shared.value), np.zeros(len(shared.value), np.int64)
            for batch in batches:
                _, vectors = _matrix(batch.column(0), size)
                at = assign(vectors, shared.value)
                np.add.at(total, at, vectors)
                n += np.bincount(at, minlength=len(n))
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), pa.array(list(total[some]), pa.list_(pa.float64()))], names=["list", "n", "total"])

        def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"list": [key[0]], "n": [rows["n"].sum()], "total": [np.sum(np.stack(rows["total"].to_list()), axis=0)]})

        # One row of each list and task, summed by list; the driver gets one row of each list.
        found = sample.select("embedding").mapInArrow(sums, parts).groupBy("list").applyInPandas(merge, parts).collect()
        moved = centroids.copy()
        for row in found:
            moved[row["list"]] = np.array(row["total"]) / row["n"]
        shared.unpersist()
        if np.allclose(moved, centroids, rtol=0, atol=1e-9):
            break
        centroids = moved
    return centroids


@dataclass(frozen=True)
class VectorIndex:
    """Where an index lies: chunks in a folder for each list, the lists of each repository, and the centroids."""

    path: str
    centroids: np.ndarray
    stored: StructType

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorIndex:
        rows = [json.loads(r[0]) for r in spark.read.text(f"{path}/facts").collect()]
        found = sorted((r for r in rows if "list" in r), key=lambda r: r["list"])
        stored = StructType.fromJson(next(r["stored"] for r in rows if "stored" in r))
        return cls(path, np.array([r["at"] for r in found], np.float64).reshape(len(found), -1 if found else 0), stored)

    def chunks(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.stored).parquet(f"{self.path}/lists")

    def sizes(self, spark: SparkSession) -> DataFrame:
        """One row per repository: its lists and how many chunks each holds."""
        kind = self.stored["repo_id"].dataType.simpleString()
        return spark.read.schema(f"repo_id {kind}, lists array<struct<list: int, n: bigint>>").parquet(f"{self.path}/sizes")


def build_vector_index(chunks: DataFrame, path: str, lists: int | None = None, sample_per_list: int = SAMPLE_PER_LIST) -> VectorIndex:
    """Learns centroids, assigns every chunk that has a vector, and writes the index below ``path``, a fresh folder.

    All columns of ``chunks`` are stored; one that is called ``list`` is replaced."""
    spark = chunks.sparkSession
    centroids = learn_centroids(chunks, lists, sample_per_list)
    shared, size = spark.sparkContext.broadcast(centroids), centroids.shape[1]

    def nearest_list(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = np.full(len(batch), OTHER, np.int32)
            rows, vectors = _matrix(batch, size)
            if len(rows):
                out[rows] = assign(vectors, shared.value)
            yield pa.array(out)

    listed = chunks.where(searchable()).drop("list").withColumn("list", F.arrow_udf(nearest_list, "int")(F.col("embedding")))
    assigned = f"{path}/assigned"
    listed.select("repo_id", "list").groupBy("repo_id", "list").count().write.parquet(assigned)
    counts = spark.read.schema(f"repo_id {chunks.schema['repo_id'].dataType.simpleString()}, list int, count bigint").parquet(assigned)
    # At most ``MOST_LISTS`` entries for a repository.
    lists_of = F.sort_array(F.collect_list(F.struct("list", F.col("count").alias("n"))))
    counts.groupBy("repo_id").agg(lists_of.alias("lists")).write.parquet(f"{path}/sizes")
    # A large list goes to several files, by a hash of the chunk.
    files = counts.groupBy("list").agg(F.ceil(F.sum("count") / F.lit(FILE_ROWS)).cast("int").alias("_files"))
    placed = join_small(listed, files, "list", "inner").withColumn("_file", F.pmod(F.xxhash64("repo_id", "chunk_id"), F.col("_files")))
    placed.repartition("list", "_file").drop("_file", "_files").sortWithinPartitions("list", "repo_id").write.partitionBy("list").option("maxRecordsPerFile", FILE_ROWS).parquet(f"{path}/lists")
    facts = [{"list": i, "at": c.tolist()} for i, c in enumerate(centroids)] + [{"stored": listed.schema.jsonValue()}]
    spark.createDataFrame([(json.dumps(f),) for f in facts], "value string").write.text(f"{path}/facts")
    return VectorIndex(path, centroids, listed.schema)


def choose_lists(questions: DataFrame, index: VectorIndex, probes: int | None = PROBES) -> DataFrame:
    """(question_id, repo_id, embedding, list) for each list that a question probes: the ``probes`` nearest of its
    repository's, or all of them; list -1 besides."""
    spark = questions.sparkSession
    size = index.centroids.shape[1] if len(index.centroids) else 0
    asked = questions.where(searchable()).select("question_id", "repo_id", "embedding")
    asked = join_small(asked, index.sizes(spark), "repo_id", "inner").withColumn("_all", F.transform("lists", lambda x: x["list"]))
    if probes is None:
        return asked.select("question_id", "repo_id", "embedding", F.explode("_all").alias("list"))
    shared = spark.sparkContext.broadcast(index.centroids)

    def choose(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for vectors, lists in batches:
            out = []
            rows, matrix = _matrix(vectors, size)
            place = dict(zip(rows.tolist(), range(len(rows))))
            for row, have in enumerate(lists.to_pylist()):
                known = np.array([i for i in have if i != OTHER], np.int64)
                if row in place and len(known) > probes:
                    gap = shared.value[known] - matrix[place[row]]
                    near = np.argsort(np.einsum("ij,ij->i", gap, gap), kind="stable")[:probes]
                    out.append([i for i in have if i == OTHER] + known[near].tolist())
                else:
                    out.append(have)
            yield pa.array(out, pa.list_(pa.int32()))

    chosen = asked.withColumn("_near", F.arrow_udf(choose, "array<int>")("embedding", "_all"))
    return chosen.select("question_id", "repo_id", "embedding", F.explode_outer("_near").alias("list")).where("list IS NOT NULL")


def gathered_lists(index: VectorIndex, spark: SparkSession, rows: int = CELL_ROWS) -> DataFrame:
    """(repo_id, list, cell): the lists of a repository gathered in their order, a cell with about ``rows`` chunks."""
    listed = index.sizes(spark).select("repo_id", F.explode("lists").alias("_l")).select("repo_id", "_l.list", "_l.n")
    # At most ``MOST_LISTS`` rows for a repository.
    ahead = Window.partitionBy("repo_id").orderBy("list").rowsBetween(Window.unboundedPreceding, -1)
    return listed.select("repo_id", "list", F.floor(F.coalesce(F.sum("n").over(ahead), F.lit(0)) / F.lit(rows)).cast("int").alias("cell"))


def search_vectors(questions: DataFrame, index: VectorIndex, k: int = 6, probes: int | None = PROBES) -> DataFrame:
    """The k nearest chunks (L2) of every question among the probed lists of its repository: question_id, repo_id, chunk_id,
    distance, rank. ``probes=None`` searches all lists and is exact."""
    spark = questions.sparkSession
    chunks = index.chunks(spark).select("repo_id", "chunk_id", "embedding", "list")
    if probes is None:
        # A question that searches all lists meets them gathered, once for each cell and not once for each list.
        cells = gathered_lists(index, spark)
        asked = questions.where(searchable()).select("question_id", "repo_id", "embedding")
        asked = join_small(asked, cells.groupBy("repo_id").agg(F.collect_set("cell").alias("_cells")), "repo_id", "inner")
        chosen = asked.select("question_id", "repo_id", "embedding", F.explode("_cells").alias("list"))
        chunks = join_small(chunks, cells, ["repo_id", "list"], "inner").select("repo_id", "chunk_id", "embedding", F.col("cell").alias("list"))
    else:
        chosen = choose_lists(questions, index, probes)
        few = [r[0] for r in chosen.select("list").distinct().collect()]  # at most MOST_LISTS + 1 numbers
        if few:
            chunks = chunks.where(F.col("list").isin(few))
    # Each list of a repository is searched as a repository of its own, in blocks if it is large.
    cell = F.struct("repo_id", "list").alias("repo_id")
    found = retrieve_chunks(chosen.select("question_id", cell, "embedding"), chunks.select(cell, "chunk_id", "embedding"), k)
    best = found.select("question_id", F.col("repo_id.repo_id").alias("repo_id"), "chunk_id", "distance")
    order = Window.partitionBy("question_id", "repo_id").orderBy("distance", "chunk_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact answers that were found."""
    keys = ["question_id", "repo_id", "chunk_id"]
    total = exact.count()
    return found.select(*keys).join(exact.select(*keys), keys).count() / total if total else 1.0
