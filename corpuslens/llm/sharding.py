"""Balanced label propagation: rows into shards, linked rows together, counts at most one apart.

Links come as groups (rows of one group are linked with each other, such as equal texts); a row without a group has
none. Groups of more than a tenth of a quota, of which there are ten for each shard at most, are placed first, by
their sizes: the largest fills whole shards, and what is left of it goes where it fits best, so a group stands in as few
shards as its size allows unless the rooms left are all too small. Every other row starts in a shard by hash, in
proportion to the rooms left. In each round, every group counts its rows per shard; rows move towards the shard that holds most of their group, as long as
that shard has room, which is its quota less the rows placed and the linked rows it holds. Rows of one group move in
blocks of at most a hundredth of a quota, and when more want in than there is room for, blocks are accepted by hash in
proportion. Every move makes a group less spread, and rounds go on until no group wishes to move or no wish was
accepted in two rounds running. Rows without links are dealt last, into exactly the places left, which makes the counts
even.

Only counts per (group, shard) are shuffled with the links; the driver sees numbers per shard. Ranks are made from
counts per (input part, shard), so no shard or group is ever gathered in one task.

NULL texts have size 8, crc 0 and no links. Repeated rows are rows of their own. Fewer rows than shards leave some
shards empty; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm.common import save

SHARDS = 24
#: Groups of more than this share of a quota are placed by their sizes.
LARGE_SHARE = 0.1
#: Blocks of a group are at most this share of a shard's quota.
BLOCK_SHARE = 0.01


def _place(row: Column, room: list[int]) -> Column:
    """A shard by hash, in proportion to the room of each."""
    ends = [sum(room[: s + 1]) for s in range(len(room))]
    at = F.pmod(F.xxhash64(row, F.lit("shard")), F.lit(max(1, ends[-1])))
    return F.least(F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= at)), F.lit(len(room) - 1))


def _lookup(values: list, at: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), at)


def _ranked(rows: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``rank`` (from 0, gapless) within ``by``. ``part`` says which task wrote a row, so counts per (by, part) give each
    part's first rank, and a sort within (by, part) the rest."""
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(*by, "part").agg(F.count(F.lit(1)).alias("_n"))
    ahead = parts.select(*by, "part", F.coalesce(F.sum("_n").over(before.partitionBy(*by).orderBy("part")), F.lit(0)).alias("_ahead"))
    local = F.row_number().over(Window.partitionBy(*by, "part").orderBy("row")) - 1
    return rows.withColumn("_local", local).join(ahead, [*by, "part"]).withColumn("rank", F.col("_ahead") + F.col("_local")).drop("_ahead", "_local")


def plan_large(sizes: list[int], quotas: list[int]) -> tuple[list[list[tuple[int, int, int]]], list[int]]:
    """For each group, pieces (first rank, shard, first slot) in order of rank; and the rows placed per shard.

    In order of size, a group takes the smallest room that holds all of it or, without one, fills the largest."""
    room, pieces = list(quotas), [[] for _ in sizes]
    for g in sorted(range(len(sizes)), key=lambda g: (-sizes[g], g)):
        rank = 0
        while rank < sizes[g]:
            left = sizes[g] - rank
            fitting = [s for s in range(len(room)) if room[s] >= left]
            s = min(fitting, key=lambda s: (room[s], s)) if fitting else max(range(len(room)), key=lambda s: (room[s], -s))
            pieces[g].append((rank, s, quotas[s] - room[s]))
            taken = min(left, room[s])
            rank, room[s] = rank + taken, room[s] - taken
    return pieces, [q - r for q, r in zip(quotas, room)]


def place_large(rows: DataFrame, large: list, pieces: list[list[tuple[int, int, int]]]) -> DataFrame:
    """(row, shard, slot) of the rows (row, part, g) of large groups."""
    names = rows.sparkSession.createDataFrame([(r["g"], k) for k, r in enumerate(large)], rows.select("g").withColumn("k", F.lit(0)).schema)
    spans = [(k, i, rank, p[i + 1][0] if i + 1 < len(p) else large[k]["m"], s, slot) for k, p in enumerate(pieces) for i, (rank, s, slot) in enumerate(p)]
    table = rows.sparkSession.createDataFrame(spans, "k int, i int, a bigint, z bigint, shard int, b bigint")
    ranked = _ranked(rows.join(F.broadcast(names), "g").select("row", "part", "k"), ["k"])
    inside = (F.col("rank") >= F.col("a")) & (F.col("rank") < F.col("z"))
    return ranked.join(F.broadcast(table), "k").where(inside).select("row", "shard", (F.col("b") + F.col("rank") - F.col("a")).alias("slot"))


def propagate(linked: DataFrame, quotas: list[int]) -> DataFrame:
    """Moves rows (row, part, g, block, shard) of groups towards their neighbours' shards within the quotas."""
    shards = len(quotas)
    turn = idle = 0
    while idle < 2:
        counts = save(linked.groupBy("g", "shard").agg(F.count(F.lit(1)).alias("c")), "group-counts")
        held = {r["shard"]: r["n"] for r in counts.groupBy("shard").agg(F.sum("c").alias("n")).collect()}
        room = [quotas[s] - held.get(s, 0) for s in range(shards)]
        # The best shard of a group among those with room; a row's own shard wins ties, then the smaller one.
        fits = counts.where(_lookup([r > 0 for r in room], F.col("shard")))
        best = fits.groupBy("g").agg(F.max(F.struct(F.col("c"), (-F.col("shard")).alias("s"))).alias("b"))
        best = best.select("g", F.col("b.c").alias("bc"), (-F.col("b.s")).alias("to"))
        wishes = counts.join(best, "g").where((F.col("bc") > F.col("c")) | ((F.col("bc") == F.col("c")) & (F.col("to") < F.col("shard"))))
        wishes = save(wishes.select("g", "shard", "to", "c"), "wishes")
        flows = wishes.groupBy("shard", "to").agg(F.sum("c").alias("n")).collect()  # shards x shards numbers at most
        if not flows:
            break
        wanted, leaving = [0] * shards, [0] * shards
        for r in flows:
            wanted[r["to"]] += r["n"]
            leaving[r["shard"]] += r["n"]
        share = [min(1.0, max(0.0, (room[s] + leaving[s] / 2) / wanted[s])) if wanted[s] else 0.0 for s in range(shards)]
        chance = F.pmod(F.xxhash64("g", "block", F.lit(turn)), F.lit(1 << 20)) / (1 << 20)
        moved = linked.join(wishes.select("g", "shard", "to"), ["g", "shard"], "left")
        go = F.col("to").isNotNull() & (chance < _lookup(share, F.col("to")))
        moved = save(moved.withColumns({"shard": F.when(go, F.col("to")).otherwise(F.col("shard")), "went": F.coalesce(go, F.lit(False))}).drop("to"), "shards")
        idle = idle + 1 if moved.where("went").isEmpty() else 0
        linked, turn = moved.drop("went"), turn + 1
    return linked


def balanced_shards(rows: DataFrame, group: Column, shards: int = SHARDS) -> DataFrame:
    """All columns of ``rows`` (written once) and ``shard``, ``slot``; shard counts differ by one at most."""
    columns = rows.columns
    mark = F.monotonically_increasing_id()
    base = save(rows.withColumns({"row": mark, "part": F.shiftright(mark, 33), "g": group}), "rows")
    total = base.count()
    quotas = [total // shards + (s < total % shards) for s in range(shards)]
    sizes = save(base.where("g IS NOT NULL").groupBy("g").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "groups")
    block = max(1, int(BLOCK_SHARE * total / shards))
    # At most shards / LARGE_SHARE groups, whatever the number of rows.
    bound = max(1.0, LARGE_SHARE * total / shards)
    large = sizes.where(F.col("m") > bound).orderBy(F.desc("m"), "g").collect()
    pieces, placed = plan_large([r["m"] for r in large], quotas)
    fixed = base.select("row", "part", "g").join(F.broadcast(sizes.where(F.col("m") > bound).select("g")), "g", "left_semi")
    fixed = save(place_large(fixed, large, pieces), "large")
    quotas_left = [q - p for q, p in zip(quotas, placed)]
    linked = base.select("row", "part", "g").join(sizes.where(F.col("m") <= bound), "g").select(
        "row", "part", "g", F.pmod(F.xxhash64("row"), F.ceil(F.col("m") / block)).alias("block"), _place(F.col("row"), quotas_left).alias("shard")
    )
    linked = propagate(save(linked, "linked"), quotas_left)

    # Linked rows beyond a quota, then all rows without links, take the places that are left.
    ranked = save(_ranked(linked.select("row", "part", "shard"), ["shard"]), "ranked")
    slot = F.col("rank") + _lookup(placed, F.col("shard"))
    settled = ranked.where(F.col("rank") < _lookup(quotas_left, F.col("shard"))).select("row", "shard", slot.alias("slot"))
    settled = save(settled.unionByName(fixed), "settled")
    held = {r["shard"]: r["n"] for r in settled.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    taken = [held.get(s, 0) for s in range(shards)]
    ends, end = [], 0
    for s in range(shards):
        end += quotas[s] - taken[s]
        ends.append(end)
    rest = base.select("row", "part").join(settled.select("row"), "row", "left_anti")
    rest = _ranked(rest.withColumn("all", F.lit(0)), ["all"])
    shard = F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= F.col("rank")))
    rest = rest.withColumn("shard", shard)
    starts = [e - (quotas[s] - taken[s]) for s, e in enumerate(ends)]
    slot = F.col("rank") - _lookup(starts, F.col("shard")) + _lookup(taken, F.col("shard"))
    places = settled.unionByName(rest.select("row", "shard", slot.alias("slot")))
    return base.join(places, "row").select(*columns, F.col("shard").cast("int").alias("shard"), F.col("slot").cast("bigint").alias("slot"))


def shard_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """Per row: ``key``, size, text_crc32, law (``rows``), shard, slot, grown_shard (NULL). Equal texts are linked."""
    value = F.encode(F.coalesce(F.col(text), F.lit("")), "utf-8")
    facts = docs.select(
        key, (F.octet_length(value) + 8).cast("bigint").alias("size"), F.crc32(value).alias("text_crc32"),
        F.when(F.col(text).isNotNull(), F.unhex(F.sha2(value, 256))).alias("_group"),
    )
    placed = balanced_shards(facts, F.col("_group"), shards)
    return placed.select(key, "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
