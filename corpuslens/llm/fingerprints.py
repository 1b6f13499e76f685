"""Winnowing fingerprints of documents, and of a document beside its neighbour in key order.

A text's tokens are its words, lower-cased, words of over ``TOKEN_CHARS`` code points in pieces of that length (so that text without
white space has tokens too). Every run of ``K`` tokens is hashed; of every ``W`` neighbouring hashes the smallest is
chosen, the rightmost of equal ones, and its position is kept. So any run of ``K + W - 1`` tokens that two texts
share gives them a common fingerprint. A text of fewer tokens is hashed as one run; a text of no token has none.

Likeness is the share of common hashes among all hashes of two fingerprints (1 if both have none).

NULL texts are empty. Neighbours are by descending key, NULL keys last; rows of one key by their text's hash; the
neighbour of the last row is the first. Rows are dealt into ranges of keys by exact quantiles of the keys, and the
row that follows a range is dealt into it as well, so no range needs another and no row meets all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm.common import SPACES

K, W = 3, 4
TOKEN_CHARS = 8
#: Rows of a range of keys, and the largest number of ranges (their ends are literals in the plan).
RANGE_ROWS = 2000
MOST_RANGES = 1 << 18


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"[^{SPACES[1:-1]}]{{1,{TOKEN_CHARS}}}"), F.lit(0))


def with_fingerprint(rows: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: array of (hash, pos), pos counted in tokens from 0, in order of position.

    Each array is made in a generator of its own, so that the optimizer cannot compute it again for every use.
    """
    rows = rows.withColumn("_t", F.explode(F.array(tokens(F.coalesce(F.col(text), F.lit(""))))))
    n = F.size("_t")
    none = F.array().cast("array<bigint>")
    grams = F.transform(F.sequence(F.lit(1), n - (K - 1)), lambda i: F.xxhash64(F.slice(F.col("_t"), i, K)))
    grams = F.when(n >= K, grams).when(n > 0, F.array(F.xxhash64("_t"))).otherwise(none)
    # The smallest (hash, -position) of a window is the smallest hash, the rightmost of equal ones.
    placed = F.transform(grams, lambda h, i: F.struct(h.alias("hash"), (-i).alias("back")))
    rows = rows.withColumn("_h", F.explode(F.array(placed)))
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.size("_h") - (W - 1), F.lit(1))), lambda i: F.array_min(F.slice(F.col("_h"), i, W)))
    rows = rows.withColumn("_m", F.explode(F.array(F.when(F.size("_h") > 0, windows))))
    # Neighbouring windows mostly choose the same position.
    chosen = F.filter("_m", lambda x, i: (i == 0) | (F.get(F.col("_m"), i - 1)["back"] != x["back"]))
    fingerprint = F.transform(chosen, lambda x: F.struct(x["hash"].alias("hash"), (-x["back"]).alias("pos")))
    empty = F.array().cast("array<struct<hash:bigint,pos:int>>")
    return rows.withColumn(out, F.explode(F.array(F.coalesce(fingerprint, empty)))).drop("_t", "_h", "_m")


def hashes(fingerprint: Column) -> Column:
    return F.array_distinct(F.transform(fingerprint, lambda x: x["hash"]))


def likeness(a: Column, b: Column) -> Column:
    """Of two arrays of distinct hashes."""
    common = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - common
    return F.when(every > 0, common / every).otherwise(F.lit(1.0))


def digest(fingerprint: Column) -> Column:
    """Number of chosen hashes and 128 bits over all hashes and positions."""
    return F.concat(F.size(fingerprint).cast("string"), F.lit("-"), F.hex(F.xxhash64(fingerprint)), F.hex(F.xxhash64(fingerprint, F.lit("second"))))


def _rank(ends: list[int], value: Column, inclusive: bool) -> Column:
    """How many of the sorted ``ends`` are smaller than (or equal to) a value, 64 at a time from the coarsest level."""
    if len(ends) <= 64:
        return F.size(F.filter(F.array(*[F.lit(e).cast("bigint") for e in ends]), lambda e: (e <= value) if inclusive else (e < value)))
    chunks = [ends[i : i + 64] for i in range(0, len(ends), 64)]
    coarse = _rank([c[-1] for c in chunks], value, inclusive)
    fine = F.get(F.array(*[F.array(*[F.lit(e).cast("bigint") for e in c]) for c in chunks]), coarse)
    within = F.size(F.filter(fine, lambda e: (e <= value) if inclusive else (e < value)))
    return F.when(coarse < len(chunks), coarse * 64 + within).otherwise(F.lit(len(ends)))


def with_next(docs: DataFrame, key: str, prepare, carry: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """``prepare(docs)`` with a struct column ``_next`` of the ``carry`` columns of the next row.

    Rows are dealt out once, by ranges of the key; ``prepare`` runs behind that exchange, on the rows of a task.
    """
    total, smallest, largest = docs.agg(F.count(F.lit(1)), F.min(key), F.max(key)).first()
    ranges = min(MOST_RANGES, max(1, -(-total // range_rows)))
    ends: list[int] = []
    if ranges > 1 and smallest is not None:
        # A larger accuracy only makes ranges more even; any ends that are keys are right.
        shares = [i / ranges for i in range(1, ranges)]
        ends = sorted(set(docs.agg(F.percentile_approx(key, shares, F.lit(max(10_000, 4 * ranges)))).first()[0]))
        ends = [e for e in ends if e < largest]
    k = F.col(key)
    # Range i holds keys up to its end; the end itself also follows the first row of the next range. The rows of
    # the largest key also stand behind the last row.
    low = F.coalesce(_rank(ends, k, False), F.lit(0)) if ends else F.lit(0)
    high = F.coalesce(_rank(ends, k, True), F.lit(0)) if ends else F.lit(0)
    own = F.struct(low.alias("range"), F.lit(0).alias("guest"))
    more = F.when(high > low, F.struct(high.alias("range"), F.lit(1).alias("guest")))
    first = F.when(k.eqNullSafe(F.lit(largest)), F.struct(F.lit(0).alias("range"), F.lit(2).alias("guest")))
    copies = F.filter(F.array(own, more, first), lambda x: x.isNotNull())
    dealt = docs.withColumn("_at", F.explode(copies)).withColumns({"_range": F.col("_at.range"), "_guest": F.col("_at.guest")}).drop("_at")
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ready = prepare(dealt.repartition(n, "_range"))
    order = Window.partitionBy("_range").orderBy(F.col("_guest") == 2, F.col(key).desc_nulls_last(), "_tie", "_guest")
    following = ready.withColumn("_next", F.lead(F.struct(*carry)).over(order))
    return following.where(F.col("_guest") == 0).drop("_range", "_guest", "_tie")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key`` and its fingerprint, an array of (hash, pos) in order of position. This is what two readers compare:
    a hash that both hold marks a run of ``K`` tokens that both texts have, at the two positions."""
    rows = docs.select(F.col(key).alias("_k"), F.col(text).alias("_text"))
    return with_fingerprint(rows, "_text", "_fp").select(F.col("_k").alias(key), F.col("_fp").alias("fingerprint"))


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Per row: ``key``, n_chars, edited_sha256, fingerprint and edited_fingerprint (digests of what ``fingerprints`` gives, equal
    for equal texts), near_edited, near_next.

    The edited text is the text with its last half replaced by as many first code points of the next row's text.
    """
    base = docs.select(F.col(key).alias("_k"), F.coalesce(F.col(text), F.lit("")).alias("_text"))

    def prepare(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("_tie", F.xxhash64("_text"))
        rows = with_fingerprint(rows, "_text", "_fp")
        return rows.withColumns({"_set": hashes(F.col("_fp")), "_digest": digest(F.col("_fp"))}).drop("_fp")

    rows = with_next(base, "_k", prepare, ["_text", "_set"], range_rows)
    n = F.char_length("_text")
    half = F.floor(n / 2).cast("int")
    # A row alone in its table follows itself.
    following = F.coalesce(F.col("_next._text"), F.col("_text"))
    edited = F.concat(F.substring(F.col("_text"), F.lit(1), n - half), F.substring(following, F.lit(1), half))
    rows = rows.withColumn("_edited", F.explode(F.array(edited)))
    rows = with_fingerprint(rows, "_edited", "_efp")
    return rows.select(
        F.col("_k").alias(key), n.cast("bigint").alias("n_chars"), F.sha2(F.encode("_edited", "utf-8"), 256).alias("edited_sha256"),
        F.col("_digest").alias("fingerprint"), digest(F.col("_efp")).alias("edited_fingerprint"),
        likeness(F.col("_set"), hashes(F.col("_efp"))).alias("near_edited"),
        likeness(F.col("_set"), F.coalesce(F.col("_next._set"), F.col("_set"))).alias("near_next"),
    )
