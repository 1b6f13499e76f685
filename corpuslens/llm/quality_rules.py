"""Quality rules as a short-circuit cascade.

Each rule is a Boolean expression over text measures. On a sample of rows from all parts of the table the cascade times
every rule by itself and counts what it rejects, and orders the rules by rejection per cost. The verdict is one nested
CASE in that order, so a text that an early rule rejects never pays for the later ones. The order, which measured times
decide, changes cost only: no column of the result depends on it.

NULL and empty texts have no words, and fail the base rule. Repeated rows are judged alike. Whole texts are measured, in
memory of some arrays of a text's words.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import save, words

WINDOW = 5
#: About so many rows are sampled, of the whole table, to estimate cost and selectivity.
SAMPLE_ROWS = 1000
SAMPLE_SEED = 11


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds one struct column ``_q``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines, words.

    The word array is made in a generator, which keeps the optimizer from repeating the split inside each use.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    split = F.struct(
        words(value).alias("words"),
        F.filter(F.split(value, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    first = docs.withColumn("_w", F.explode(F.array(split)))
    n = F.size("_w.words")
    grams = F.when(
        n >= WINDOW,
        F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(F.col("_w.words"), i, WINDOW))),
    ).otherwise(F.array().cast("array<bigint>"))
    second = first.withColumn("_g", F.explode(F.array(grams)))
    third = second.withColumn("_s", F.explode(F.array(F.when(F.size(F.array_distinct("_g")) < F.size("_g"), F.array_sort(
        F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i")))
    )))))
    # Neighbours in hash order with the same hash are windows found twice or more.
    last = F.size("_s")
    same = F.zip_with(F.slice("_s", 1, last - 1), F.slice("_s", 2, last - 1), lambda a, b: F.when(a["g"] == b["g"], F.array(a["i"], b["i"])))
    fourth = third.withColumn("_p", F.explode(F.array(F.when(F.col("_s").isNotNull(), F.array_sort(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull()))))))))
    starts = F.size("_p")
    steps = F.zip_with(F.slice("_p", 1, starts - 1), F.slice("_p", 2, starts - 1), lambda a, b: F.least(b - a, F.lit(WINDOW)))
    repeated = F.when(F.col("_p").isNull(), F.lit(0)).otherwise(F.aggregate(steps, F.lit(WINDOW), lambda acc, x: acc + x))
    measures = F.struct(
        n.cast("bigint").alias("n_words"),
        (F.char_length(value) - F.size(F.split(value, r"[\x20\x09-\x0D]", -1)) + 1).cast("bigint").alias("word_chars"),
        (F.size(F.split(value, r"[#*$%&|<>]", -1)) - 1).cast("bigint").alias("n_symbols"),
        (F.size("_w.lines") - F.size(F.array_distinct("_w.lines"))).cast("bigint").alias("n_dup_lines"),
        repeated.cast("bigint").alias("n_repeat_words"),
        F.col("_w.lines").alias("lines"),
        F.col("_w.words").alias("words"),
    )
    return fourth.withColumn("_q", F.explode(F.array(measures))).drop("_w", "_g", "_s", "_p")


def base_failed() -> Column:
    q = F.col("_q")
    return (q["n_words"] < 10) | (100 * q["n_repeat_words"] > 20 * q["n_words"])


def standard_rules(text: str = "text") -> list[Rule]:
    """Rules beyond the base. Each compares integers, so a verdict is exact."""
    q = F.col("_q")
    value = F.coalesce(F.col(text), F.lit(""))
    capitals = F.size(F.split(value, r"\p{Lu}", -1)) - 1
    letters = F.size(F.split(value, r"\p{L}", -1)) - 1
    return [
        Rule("symbols", 10 * q["n_symbols"] > q["n_words"]),
        Rule("duplicate_lines", 2 * q["n_dup_lines"] > F.size(q["lines"])),
        Rule("word_length", (q["word_chars"] < 2 * q["n_words"]) | (q["word_chars"] > 20 * q["n_words"])),
        Rule("bang_words", 10 * F.size(F.filter(q["words"], lambda w: w.endswith("!!"))) > 3 * q["n_words"]),
        Rule("capitals", 10 * capitals > 4 * letters),
        Rule("few_letters", 2 * letters < q["word_chars"]),
    ]


def cascade_order(docs: DataFrame, rules: list[Rule], text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by rejection per cost, best first, as measured on ``sample_rows`` rows; ties in the given order.

    Each rule is timed over the written sample, less the time of a pass without any rule. The sample takes each row with
    the same chance, whole; the number of rows comes from the files' footers.
    """
    share = min(1.0, sample_rows / max(docs.count(), 1))
    sample = docs.select(text).sample(share, SAMPLE_SEED)
    sample = save(with_measures(sample, text).where(~base_failed()), "rule-sample")

    def seconds(*columns: Column) -> tuple[float, tuple]:
        began = time.perf_counter()
        row = sample.agg(F.count(F.lit(1)), F.sum(F.xxhash64(text, "_q").bitwiseAND(F.lit(1))), *columns).first()
        return time.perf_counter() - began, tuple(row)[2:]

    seconds()
    floor, _ = seconds()
    ranked = []
    for place, rule in enumerate(rules):
        took, (hits,) = seconds(F.count_if(rule.rejects))
        ranked.append((-(hits or 0) / max(took - floor, 1e-3), place))
    return [rules[place] for _, place in sorted(ranked)]


def passes(rules: list[Rule]) -> Column:
    """Whether neither the base nor any rule rejects; after the first that does, no other is evaluated."""
    verdict = F.lit(True)
    for rule in reversed(rules):
        verdict = F.when(rule.rejects, False).otherwise(verdict)
    return F.when(base_failed(), False).otherwise(verdict)


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: list[Rule] | None = None, order: bool = True) -> DataFrame:
    """Per row: ``key``, the base measures, base_failed, kept (neither the base nor a rule rejects it).

    ``order=False`` keeps the given order and skips the sample. An empty table gives an empty result.
    """
    docs = docs.select(key, text)
    rules = standard_rules(text) if rules is None else rules
    if order and rules:
        rules = cascade_order(docs, rules, text)
    q = F.col("_q")
    return with_measures(docs, text).select(
        key,
        *[q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base_failed().alias("base_failed"),
        passes(rules).alias("kept"),
    )
