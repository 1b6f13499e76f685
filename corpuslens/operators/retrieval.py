"""Nearest chunks of a question within its repository, and the context text built from them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.session import join_small, pin

NO_INDEX = "No index exists for this repository yet. Run an analysis first."


#: Questions whose distances to a block's chunks are worked out at a time.
QUESTION_STEP = 256


def nearest(chunks: np.ndarray, questions: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and distances of the k nearest chunks of each question, ties to the earlier chunk.

    Matrix products find the candidates; whatever may still be among the best k is measured again by differences.
    """
    k = min(k, len(chunks))
    lengths = np.einsum("ij,ij->i", chunks, chunks)
    picked, distances = np.empty((len(questions), k), np.int64), np.empty((len(questions), k))
    for start in range(0, len(questions), QUESTION_STEP):
        part = questions[start : start + QUESTION_STEP]
        own = np.einsum("ij,ij->i", part, part)
        rough = lengths[None, :] - 2 * (part @ chunks.T) + own[:, None]
        limit = np.partition(rough, k - 1, axis=1)[:, k - 1]
        # The products may be off by rounding in proportion to the squared lengths.
        limit = limit + 1e-9 * (own + lengths.max() + 1)
        for row, question in enumerate(part):
            near = np.flatnonzero(rough[row] <= limit[row])
            diff = chunks[near] - question
            exact = np.sqrt(np.einsum("ij,ij->i", diff, diff))
            best = np.argsort(exact, kind="stable")[:k]
            picked[start + row], distances[start + row] = near[best], exact[best]
    return picked, distances


def _nearest_in_block(k: int):
    """Best k chunks per question inside one block; distances in double, ties by chunk id."""

    def run(questions: pd.DataFrame, chunks: pd.DataFrame) -> pd.DataFrame:
        chunks = chunks.sort_values("chunk_id", kind="stable")
        sizes, wanted = chunks["embedding"].map(len).to_numpy(), questions["embedding"].map(len).to_numpy()
        places, asked, distances = [], [], []
        for size in np.intersect1d(sizes, wanted):
            side, questioned = np.flatnonzero(sizes == size), np.flatnonzero(wanted == size)
            at, distance = nearest(
                np.stack(chunks["embedding"].iloc[side].to_list()).astype(np.float64),
                np.stack(questions["embedding"].iloc[questioned].to_list()).astype(np.float64), k,
            )
            places.append(side[at.ravel()])
            asked.append(np.repeat(questioned, at.shape[1]))
            distances.append(distance.ravel())
        place, of = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (places, asked))
        return pd.DataFrame({
            "question_id": questions["question_id"].to_numpy()[of], "repo_id": questions["repo_id"].to_numpy()[of],
            "chunk_id": chunks["chunk_id"].to_numpy()[place], "distance": np.concatenate(distances) if distances else np.empty(0),
        })

    return run


def without_vector(rows: DataFrame) -> DataFrame:
    """Questions or chunks that no search can find: their vector is NULL, empty or holds a NULL."""
    return rows.where(~searchable())


def searchable():
    return F.coalesce((F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull()), F.lit(False))


def _blocks(df: DataFrame, rows: int, out: str) -> DataFrame:
    """Block count of every repository that needs more than one block: at most total / rows repositories."""
    sizes = df.groupBy("repo_id").agg(F.ceil(F.count("*") / F.lit(rows)).cast("int").alias(out))
    return sizes.where(F.col(out) > 1)


def _blocked(df: DataFrame, key: str, own: str, other: str, own_blocks: DataFrame, other_blocks: DataFrame) -> DataFrame:
    """Places each row in one block of its own side and in every block of the other side."""
    mine = F.coalesce(F.col("_own"), F.lit(1))
    theirs = F.coalesce(F.col("_other"), F.lit(1))
    placed = join_small(df, own_blocks.toDF("repo_id", "_own"), "repo_id", "left")
    return (
        join_small(placed, other_blocks.toDF("repo_id", "_other"), "repo_id", "left")
        .withColumn(own, F.pmod(F.xxhash64(key), mine).cast("int"))
        .withColumn(other, F.explode(F.sequence(F.lit(0), theirs - 1)))
        .drop("_own", "_other")
    )


def retrieve_chunks(
    questions: DataFrame, chunks: DataFrame, k: int = 6, block_rows: int = 20_000, question_rows: int = 5_000
) -> DataFrame:
    """The exact k nearest chunks (L2) of every question among its repository's chunks.

    Chunks and questions of a repository are cut into blocks of bounded size by a hash of their ids, and
    every pair of blocks is one group, so one huge repository fills many equal tasks. A group returns k rows
    per question, never the pairs; the final window sees k rows per question and block. Rows without a vector take
    no part (``without_vector`` lists them); vectors are compared with those of their own length.
    """
    questions, chunks = questions.where(searchable()), chunks.where(searchable())
    chunk_blocks = pin(_blocks(chunks, block_rows, "_cb"))
    question_blocks = pin(_blocks(questions, question_rows, "_qb"))
    left = _blocked(questions.select("question_id", "repo_id", "embedding"), "question_id",
                    "_qblock", "_cblock", question_blocks, chunk_blocks)
    right = _blocked(chunks.select("repo_id", "chunk_id", "embedding"), "chunk_id",
                     "_cblock", "_qblock", chunk_blocks, question_blocks)
    id_type = chunks.schema["chunk_id"].dataType.simpleString()
    schema = (
        f"question_id {questions.schema['question_id'].dataType.simpleString()}, "
        f"repo_id {questions.schema['repo_id'].dataType.simpleString()}, chunk_id {id_type}, distance double"
    )
    best = (
        left.groupBy("repo_id", "_qblock", "_cblock")
        .cogroup(right.groupBy("repo_id", "_qblock", "_cblock"))
        .applyInPandas(_nearest_in_block(k), schema)
    )
    order = Window.partitionBy("question_id", "repo_id").orderBy("distance", "chunk_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rag_context(questions: DataFrame, chunks: DataFrame, k: int = 6, content_chars: int | None = None) -> DataFrame:
    """Context blocks and references per question of a repository, best first; at most k blocks each.

    With ``content_chars`` a block holds so many first characters of its chunk.
    """
    found = retrieve_chunks(questions, chunks, k)
    content = F.col("content") if content_chars is None else F.substring("content", 1, content_chars)
    body = chunks.select("repo_id", "chunk_id", "file_path", "start_line", "end_line", content.alias("content"))
    ref = F.concat("file_path", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    blocks = (
        # At most k rows per question; when few enough they go to the chunks, whose texts then stay in place.
        join_small(body, found, ["repo_id", "chunk_id"], "inner")
        .select("question_id", "repo_id", F.struct("rank", ref.alias("ref"), "content").alias("_b"))
        .groupBy("question_id", "repo_id")
        .agg(F.array_sort(F.collect_list("_b")).alias("_b"))
        .select(
            "question_id", "repo_id",
            F.array_join(
                F.transform(
                    "_b",
                    lambda b: F.concat(F.lit("### "), b["ref"], F.lit("\n```\n"), b["content"], F.lit("\n```")),
                ),
                "\n\n",
            ).alias("context"),
            F.array_join(F.transform("_b", lambda b: b["ref"]), ",").alias("referenced_files"),
        )
    )
    return questions.select("question_id", "repo_id").join(blocks, ["question_id", "repo_id"], "left").select(
        "question_id", "repo_id",
        F.coalesce("context", F.lit(NO_INDEX)).alias("context"),
        F.coalesce("referenced_files", F.lit("")).alias("referenced_files"),
    )
