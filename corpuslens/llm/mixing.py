"""Temperature mixing of sources.

A source with share p of all tokens gets the weight p ** a, normalised. The exponent a in 0..1 is found by bisection:
the smallest one that keeps every source within ``max_repeats`` passes, or the one whose weights have the entropy
asked for. By default the budget is the least at which every source is used whole at least once, so no document is
dropped; a given budget may be smaller or larger.

A source's budget is spent in whole passes and a last, partial one. For each pass its rows are dealt into hash blocks;
blocks, and rows within a block, are permuted by hashes of pass and seed. The partial pass takes blocks in the order
of the permutation while they fit, then rows of the next block. Orders are given as keys to sort by, so nothing is
sorted as a whole here.

A row's tokens are its words plus one. A NULL source is a source of its own. Rows with the same key go together.
An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm.common import fresh_name, save, words

MAX_REPEATS = 2.0
BLOCK_TOKENS = 1 << 18
SEED = 1
#: Sources up to this number are broadcast to their rows (about 100 bytes each); more are joined by shuffle.
BROADCAST_SOURCES = 20_000
#: Leading bits of a block's place in the permutation that partial sums are kept for, as shifts: 4096 ranges, then 4096 in one.
RANGE_SHIFTS = (52, 40)
#: Levels of the bisection that one job evaluates, and jobs.
LEVELS, JOBS = 4, 8


def source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source.cast("string")))


def bisect_exponent(shares: DataFrame, too_low) -> float:
    """The smallest exponent in 0..1 (to about 1e-9) where ``too_low(exponent, sum p^a, sum p^a ln p)`` is false.

    ``shares`` has one row per source with ``p``. A job evaluates all midpoints of the next few halvings at once.
    """
    low, high = 0.0, 1.0
    for _ in range(JOBS):
        steps = 1 << LEVELS
        points = [low + (high - low) * i / steps for i in range(1, steps)]
        sums = shares.agg(*[F.sum(f(a)) for a in points for f in (lambda a: F.pow("p", F.lit(a)), lambda a: F.pow("p", F.lit(a)) * F.log("p"))]).first()
        lo, hi = 0, steps
        while hi - lo > 1:
            mid = (lo + hi) // 2
            if too_low(points[mid - 1], sums[2 * mid - 2], sums[2 * mid - 1]):
                lo = mid
            else:
                hi = mid
        low, high = low + (high - low) * lo / steps, low + (high - low) * hi / steps
    return high


def plan_mixture(
    rows: DataFrame, max_repeats: float | None = MAX_REPEATS, entropy_share: float | None = None, budget_tokens: float | None = None,
    block_tokens: int = BLOCK_TOKENS, seed: int = SEED,
) -> DataFrame:
    """Per source ``_s`` of ``rows`` (_s, _k, _n): tokens, weight, passes, blocks, and the thresholds ``block_end`` and ``row_end`` of
    the partial pass. ``entropy_share`` is the entropy asked for as a share of the largest, log of the number of sources."""
    sources = save(rows.groupBy("_s").agg(F.sum("_n").alias("tokens")), "sources")
    total, k, least, most = sources.agg(F.sum("tokens"), F.count(F.lit(1)), F.min("tokens"), F.max("tokens")).first()
    total = total or 1
    shares = sources.withColumn("p", F.col("tokens") / F.lit(total))
    exponent = 1.0
    if k and k > 1 and entropy_share is not None:
        # Entropy falls as the exponent rises: the largest one that still has it.
        goal = entropy_share * math.log(k)
        exponent = bisect_exponent(shares, lambda a, z, s: math.log(z) - a * s / z > goal)
    elif k and k > 1 and max_repeats is not None:
        exponent = bisect_exponent(shares, lambda a, z, s: (most / least) ** (1 - a) > max_repeats)
    norm = shares.agg(F.sum(F.pow("p", F.lit(exponent)))).first()[0] or 1.0
    top = (most or 1) / total
    budget = float(budget_tokens) if budget_tokens is not None else total * norm * top ** (1 - exponent)
    weighted = shares.withColumn("weight", F.pow("p", F.lit(exponent)) / F.lit(norm))
    # A hair is added so that a source meant to be used exactly whole is not rounded below it.
    granted = F.floor(F.col("weight") * F.lit(budget) * (1 + 1e-9)).cast("bigint")
    weighted = weighted.withColumn("granted", granted).withColumn("passes", F.floor(F.col("granted") / F.col("tokens")).cast("int"))
    weighted = weighted.withColumn("rest", F.col("granted") - F.col("passes") * F.col("tokens"))
    weighted = weighted.withColumn("blocks", F.ceil(F.col("tokens") / block_tokens).cast("bigint"))
    plan = save(weighted.select("_s", "tokens", "weight", "passes", "rest", "blocks"), "mixture")

    partial = rows.join(_small(plan.select("_s", "passes", "rest", "blocks"), plan), "_s").where("rest > 0")
    partial = partial.withColumn("h", block_key(F.col("passes"), F.col("_s"), block_of(F.col("_k"), F.col("blocks"), seed), seed))
    blocks = save(partial.groupBy("_s", "h").agg(F.sum("_n").alias("t"), F.first("rest").alias("rest")), "mixture-blocks")
    near = blocks.withColumn("base", F.lit(0).cast("bigint"))
    for shift in RANGE_SHIFTS:
        near = border_range(near, shift)
    order = Window.partitionBy("_s").orderBy("h")
    blocks = near.withColumn("end", F.col("base") + F.sum("t").over(order)).where("end > rest")
    # The first block that does not fit whole; what is left of the rest goes to its rows.
    border = blocks.groupBy("_s").agg(F.min_by(F.struct("h", (F.col("rest") - F.col("end") + F.col("t")).alias("left")), "end").alias("b"))
    border = save(border.select("_s", F.col("b.h").alias("block_end"), F.col("b.left").alias("left")), "border")
    inside = partial.join(_small(border, plan), "_s").where("h = block_end")
    inside = inside.select("_s", row_key(F.col("passes"), F.col("_k"), seed).alias("r"), "_n", "left")
    fits = inside.withColumn("end", F.sum("_n").over(Window.partitionBy("_s").orderBy("r"))).where("end <= left")
    last = fits.groupBy("_s").agg(F.max("r").alias("row_end"))
    return save(plan.join(border.drop("left"), "_s", "left").join(last, "_s", "left"), "mixture-plan")


def border_range(blocks: DataFrame, shift: int) -> DataFrame:
    """Of (_s, h, t, rest, base) the blocks of the range of h in which the sum over a source passes ``rest``, with the sum
    before that range as ``base``. Ranges are the leading bits of h, so few sums per source are put in order, however many
    blocks it has. A source whose blocks all fit has no such range."""
    ranged = blocks.withColumn("g", F.shiftright("h", shift))
    sums = ranged.groupBy("_s", "g").agg(F.sum("t").alias("t"), F.first("rest").alias("rest"), F.first("base").alias("base"))
    end = F.col("base") + F.sum("t").over(Window.partitionBy("_s").orderBy("g"))
    border = sums.withColumn("end", end).where("end > rest AND end - t <= rest").select("_s", "g", (F.col("end") - F.col("t")).alias("base"))
    return ranged.drop("base").join(border, ["_s", "g"]).select("_s", "h", "t", "rest", "base")


def _small(side: DataFrame, sized: DataFrame) -> DataFrame:
    """Broadcasts a table of one row per source if the sources were counted and are few."""
    return F.broadcast(side) if sized.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else side


def block_of(key: Column, blocks: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed), F.lit("block")), blocks)


def block_key(number: Column, source: Column, block: Column, seed: int) -> Column:
    return F.xxhash64(number, source, block, F.lit(seed), F.lit("order"))


def row_key(number: Column, key: Column, seed: int) -> Column:
    return F.xxhash64(number, key, F.lit(seed), F.lit("row"))


def mix_sources(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", max_repeats: float | None = MAX_REPEATS,
    entropy_share: float | None = None, budget_tokens: float | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = SEED,
    facts: str | None = "__mix",
) -> DataFrame:
    """All columns of ``docs``, each row as often as the mixture uses it, and one struct column ``facts`` (None: without it;
    an input column of that name is replaced): tokens, weight, number (of the pass, from 0), block, block_key, row_key. Sort by number, block_key, row_key for the
    order of a source's passes."""
    tokens = (F.size(words(F.col(text))) + 1).cast("bigint")
    name, given = source_key(F.col(source)), F.coalesce(F.col(key).cast("string"), F.lit(""))
    rows = save(docs.select(name.alias("_s"), given.alias("_k"), tokens.alias("_n")), "token-counts")
    plan = plan_mixture(rows, max_repeats, entropy_share, budget_tokens, block_tokens, seed)
    plan_name, number_name = fresh_name(docs, "plan"), fresh_name(docs, "number")
    source_name, tokens_name = fresh_name(docs, "of_source"), fresh_name(docs, "tokens")
    side = _small(plan.select(F.struct("*").alias(plan_name), F.col("_s").alias(source_name)), plan)
    p = F.col(plan_name)
    block = block_of(given, p["blocks"], seed)
    place = block_key(p["passes"], p["_s"], block, seed)
    again = F.when(p["rest"] <= 0, False).when(p["block_end"].isNull() | (place < p["block_end"]), True).otherwise(
        (place == p["block_end"]) & F.coalesce(row_key(p["passes"], given, seed) <= p["row_end"], F.lit(False))
    )
    last = p["passes"] - F.when(again, 0).otherwise(1)
    joined = docs.withColumn(tokens_name, tokens).join(side, name == F.col(source_name)).where(last >= 0)
    dealt = joined.withColumn(number_name, F.explode(F.sequence(F.lit(0), last)))
    kept = [F.col(f"`{c}`") for c in docs.columns if c != facts]
    if facts is None:
        return dealt.select(*kept)
    number = F.col(number_name)
    told = F.struct(
        F.col(tokens_name).alias("tokens"), p["weight"].alias("weight"), number.alias("number"), block.alias("block"),
        block_key(number, p["_s"], block, seed).alias("block_key"), row_key(number, given, seed).alias("row_key"),
    )
    return dealt.select(*kept, told.alias(facts))
