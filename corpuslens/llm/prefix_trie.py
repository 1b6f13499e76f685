"""Conversations as a prefix trie: one node for each distinct beginning, with totals over subtrees.

Turns enter as digests, so no text is moved. A node's identity is a digest of the digests up to it, built by blocks of
``BAND`` turns: inside a block from its turns, across blocks from the digests of whole blocks by the same rule once more.
No task needs a whole conversation, and rounds grow with the logarithm of the longest one to base ``BAND``.

Totals over subtrees are rolled up by bands of ``BAND`` depths: every node explodes to its ancestors inside its band
only. The topmost nodes of the bands then form a trie of their own, of a depth smaller by that factor, which is rolled up
in the same way; the completed totals of band tops are added to the nodes above them in the band before theirs.

Turns are ordered by ``turn`` (NULL first), equal ones by the digest of role and text. NULL role and text are empty.
Rows without ``conv_id`` belong to no conversation and are left out. Repeated rows are turns of their own. Without
conversations there is no node, not even the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import save, words
from corpuslens.operators.numbering import number_within

#: Depths of a band: the most ancestors that a node explodes to, and the turns that one array holds.
BAND = 32
#: Ids of one string that the end digests are read from; the strings of a node are digested in order, one at a time.
CHUNK_IDS = 512


def _digest(value: Column) -> Column:
    """128 bits of SHA-256: no two of 10^15 values are to be expected alike."""
    return F.substring(F.unhex(F.sha2(value, 256)), 1, 16)


def turns_of(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, n (place from 1), digest, tokens (words of the text)."""
    said = [F.encode(F.coalesce(F.col(c).cast("string"), F.lit("")), "utf-8") for c in (role, text)]
    length = F.encode(F.concat(F.octet_length(said[0]).cast("string"), F.lit(":")), "utf-8")
    rows = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("bigint").alias("conv"), F.col(turn).alias("turn"),
        _digest(F.concat(length, *said)).alias("digest"), F.size(words(F.col(text))).cast("bigint").alias("tokens"),
        F.monotonically_increasing_id().alias("place"),
    )
    # Repeated turns are alike, so it does not matter that their places are not the same in every run.
    order = [F.col("turn").asc_nulls_first(), F.col("digest"), F.col("place")]
    return number_within(rows, ["conv"], order, "n").select("conv", "n", "digest", "tokens")


def rebuild(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Each conversation behind the head of conversation c - c % ``every``: its first h turns (h = crc32(c) % ``most``),
    then the own turns after the first h. Gives (conv, depth, digest, tokens) and (conv, length) of all conversations."""
    convs = turns.groupBy("conv").agg(F.max("n").alias("own"))
    convs = convs.withColumn("h", F.crc32(F.encode(F.col("conv").cast("string"), "utf-8")) % most)
    # Heads hold fewer than ``most`` turns each, and ``every`` conversations share one: no key of these joins is frequent.
    heads = (
        turns.where((F.col("conv") % every == 0) & (F.col("n") < most)).groupBy("conv")
        .agg(F.sort_array(F.collect_list(F.struct("n", "digest", "tokens"))).alias("head"))
    )
    shared = convs.withColumn("base", F.col("conv") - F.col("conv") % every).join(heads.withColumnRenamed("conv", "base"), "base", "left")
    head = F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("h").cast("int"))
    planned = save(shared.select("conv", "h", "own", head.alias("head")), "trie-plan")
    front = planned.select("conv", F.explode("head").alias("t")).select("conv", F.col("t.n").alias("depth"), "t.digest", "t.tokens")
    # One row for each conversation on the right; a long one on the left is split by adaptive execution.
    shifts = planned.select("conv", "h", F.size("head").alias("ahead"))
    back = turns.join(shifts, "conv").where("n > h").select("conv", (F.col("n") - F.col("h") + F.col("ahead")).alias("depth"), "digest", "tokens")
    length = F.size("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    return front.unionByName(back), planned.select("conv", length.cast("bigint").alias("length"))


def _blocks(rows: DataFrame, *more: str) -> DataFrame:
    """Runs of at most ``BAND`` steps of a conversation as arrays: conv, block, items (step, id and what else is named)."""
    block = F.floor((F.col("step") - 1) / BAND).cast("bigint").alias("block")
    return rows.groupBy("conv", block).agg(F.sort_array(F.collect_list(F.struct("step", "id", *more))).alias("items"))


def prefix_ids(rows: DataFrame) -> DataFrame:
    """From (conv, step, id, tokens): blocks whose ids stand for all that the conversation holds up to their step."""
    blocks = save(_blocks(rows, "tokens"), "trie-blocks")
    so_far = F.expr("transform(sequence(1, size(items)), j -> substring(unhex(sha2(array_join(transform(slice(items, 1, j), x -> hex(x.id)), ''), 256)), 1, 16))")
    blocks = blocks.withColumn("so_far", so_far)
    full = blocks.where(F.size("items") == BAND).select(
        "conv", (F.col("block") + 1).alias("step"), F.element_at("so_far", -1).alias("id"), F.lit(0).cast("bigint").alias("tokens")
    )
    longer = blocks.where("block > 0").select("conv").distinct()
    if longer.isEmpty():
        before = blocks.withColumn("before", F.lit(b""))
    else:
        # Whole blocks take the place of turns; what lies before block k is the beginning of k of them.
        above = prefix_ids(full.join(longer, "conv", "left_semi")).select("conv", F.explode("items").alias("i"))
        before = blocks.join(above.select("conv", F.col("i.step").alias("block"), F.col("i.id").alias("before")), ["conv", "block"], "left")
        before = before.withColumn("before", F.coalesce("before", F.lit(b"")))
    # Zipped, as a lambda that reached for the other array could have it computed again for every element.
    ids = F.expr("transform(arrays_zip(items, so_far), z -> named_struct('step', z.items.step, 'id', substring(unhex(sha2(concat(before, z.so_far), 256)), 1, 16), 'tokens', z.items.tokens))")
    return save(before.select("conv", "block", ids.alias("items")), "trie-ids")


def roll_up(blocks: DataFrame, values: DataFrame, names: list[str]) -> DataFrame:
    """Sums of ``names`` over subtrees, per id. ``blocks`` has (conv, block, items of step and id), all of an id's
    conversations the same ids before it; ``values`` has one row for each id."""
    sums = [F.sum(n).alias(n) for n in names]
    at = blocks.select("conv", "block", F.explode("items").alias("i")).select("conv", "block", F.col("i.id").alias("id"))
    # Any conversation of a node tells its ancestors; the smallest does, so that repeated work gives the same.
    first = at.groupBy("id").agg(F.min("conv").alias("conv"), F.min("block").alias("block"))
    path = F.transform("items", lambda x: x["id"])
    placed = first.join(blocks.select("conv", "block", path.alias("ids")), ["conv", "block"])
    placed = placed.withColumn("path", F.slice("ids", F.lit(1), F.array_position("ids", F.col("id")).cast("int")))
    inside = placed.select("id", "path").join(values, "id").select(F.explode("path").alias("id"), *names).groupBy("id").agg(*sums)
    if blocks.where("block > 0").isEmpty():
        return inside
    inside = save(inside, "trie-inside")
    tops = blocks.where("block > 0").select("conv", F.col("block").alias("step"), F.element_at("items", 1)["id"].alias("id"))
    tops = save(tops, "trie-tops")
    whole = roll_up(save(_blocks(tops), "trie-bands"), inside.join(tops.select("id").distinct(), "id", "left_semi"), names)
    # The band before a top, as its smallest conversation has it.
    owner = tops.groupBy("id").agg(F.min("conv").alias("conv"), F.min("step").alias("step"))
    above = blocks.select("conv", (F.col("block") + 1).alias("step"), path.alias("path"))
    carried = whole.join(owner, "id").join(above, ["conv", "step"]).select(F.explode("path").alias("id"), *names)
    return inside.unionByName(carried).groupBy("id").agg(*sums)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (id, conv) to strings of at most ``CHUNK_IDS`` decimal ids of one node, with the first of them."""
    for batch in batches:
        ids, convs = (c.to_pylist() for c in batch.columns)
        out: list[list] = []
        for node, conv in zip(ids, convs):
            if not out or out[-1][0] != node or len(out[-1][2]) == CHUNK_IDS:
                out.append([node, conv, []])
            out[-1][2].append(str(conv))
        yield pa.RecordBatch.from_arrays(
            [pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.int64()), pa.array([",".join(o[2]) for o in out], pa.string())],
            names=["id", "first", "part"],
        )


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (id, first, part) to one digest for each node; only the digest under way is kept."""
    node, digest = None, None

    def row(nodes: list, hashes: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(hashes, pa.string())], names=["id", "ends_sha256"])

    for batch in batches:
        nodes, hashes = [], []
        for key, part in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if key != node:
                if digest is not None:
                    nodes.append(node)
                    hashes.append(digest.hexdigest())
                node, digest = key, hashlib.sha256(part.encode())
            else:
                digest.update(b"," + part.encode())
        yield row(nodes, hashes)
    if digest is not None:
        yield row([node], [digest.hexdigest()])


def end_hashes(ends: DataFrame) -> DataFrame:
    """(id, conv) to (id, ends_sha256). A digest has an order, so the ids of one node pass through one task: as long
    strings that other tasks joined, and never all in memory."""
    parts = ends.select("id", "conv").repartitionByRange("id", "conv").sortWithinPartitions("id", "conv").mapInArrow(_chunks, "id binary, first bigint, part string")
    return parts.repartition("id").sortWithinPartitions("id", "first").mapInArrow(_hashes, "id binary, ends_sha256 string")


def prefix_trie(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", every: int = 20, most: int = 4
) -> DataFrame:
    """Per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns = save(turns_of(conversations, conv, turn, role, text), "trie-turns")
    rows, lengths = rebuild(turns, every, most)
    rows, lengths = save(rows, "trie-rows"), save(lengths, "trie-lengths")
    blocks = prefix_ids(rows.select("conv", F.col("depth").alias("step"), F.col("digest").alias("id"), "tokens"))
    root = F.lit(b"")

    items = blocks.select("conv", "block", F.explode("items").alias("i")).select("conv", F.col("i.step").alias("depth"), F.col("i.id").alias("id"), F.col("i.tokens").alias("tokens"))
    counted = items.groupBy("id").agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv"), F.min("depth").alias("depth"), F.min("tokens").alias("tokens")
    )
    # A node's parent is what its smallest member holds one step before.
    parents = items.select("conv", (F.col("depth") + 1).alias("depth"), F.col("id").alias("parent"))
    nodes = counted.join(parents, ["conv", "depth"], "left").withColumn("parent", F.coalesce("parent", root))
    nodes = save(nodes, "trie-nodes")

    children = save(nodes.groupBy("parent").agg(F.count(F.lit(1)).alias("n_children")).withColumnRenamed("parent", "id"), "trie-children")
    own = nodes.join(children, "id", "left").select(
        "id", F.col("n_children").isNull().cast("bigint").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("tokens")).alias("saved_tokens")
    )
    own = save(own, "trie-own")
    totals = roll_up(blocks, own, ["n_leaves", "saved_tokens"])

    everyone = lengths.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv")).where("n_convs > 0")
    no = F.lit(None).cast("bigint")
    sums = own.agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    both = everyone.select("conv", "n_convs", no.alias("n_leaves"), no.alias("saved_tokens")).unionByName(sums.select(no.alias("conv"), no.alias("n_convs"), "n_leaves", "saved_tokens"))
    top = both.agg(*[F.max(c).alias(c) for c in both.columns]).where("n_convs > 0").select(
        root.alias("id"), "conv", F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("binary").alias("parent"), "n_convs",
        F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"),
    )
    full = nodes.join(totals, "id").select("id", "conv", "depth", "parent", "n_convs", "n_leaves", "saved_tokens").unionByName(top)

    last = items.join(lengths, "conv").where("depth = length").select("id", "conv")
    ends = last.unionByName(lengths.where("length = 0").select(root.alias("id"), "conv"))
    owners = nodes.select(F.col("id").alias("parent"), F.col("conv").alias("parent_conv")).unionByName(everyone.select(root.alias("parent"), F.col("conv").alias("parent_conv")))
    return (
        full.join(children, "id", "left").join(end_hashes(ends), "id", "left").join(owners, "parent", "left")
        .select(
            F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs",
            F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"), "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
        )
    )
