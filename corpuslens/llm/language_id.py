"""Language identification by compression.

For each language a zstandard raw-content dictionary is built from whole labelled texts: a bounded number of rows, and
of their blocks as many as fit into the dictionary, both chosen by a hash, so that no part of a text is preferred. A text
is coded in blocks with every dictionary; the language whose dictionary gives the fewest bytes wins. The margin to the
runner-up, as a share of the runner-up's bytes, tells how sure that is: below ``min_margin`` the text is rejected.

A NULL text, or one without a letter, has language ``und``, score 0 and is rejected. If nothing could be learned,
every text is ``und``. Equal sizes go to the language with more labelled rows, then to the first in name order. Long texts
are coded block by block, in memory of a few times their size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslens.llm.common import fold, slabs, with_verdict

#: The sample a dictionary is made from: rows of each language, bytes of their blocks, and characters of a block.
TEXTS_PER_LANGUAGE = 64
DICTIONARY_BYTES = 256 << 10
SAMPLE_BLOCK = 1000
#: Texts are coded in blocks of so many characters, so that a dictionary counts as much at the end of a long text.
BLOCK_CHARS = 4000
MIN_MARGIN = 0.005
SHARPNESS = 40.0
OTHER = re.compile(r"[^\w\s]+|[\d_]+")


def normalise(text: str) -> str:
    """Lower-case letters and white space; digits and signs go."""
    return OTHER.sub(" ", text.lower()).strip()


def _parameters():
    """Greedy search for matches from four bytes on: of zstandard's strategies it told short invented words apart
    best for its time. Level 3 looks for longer matches only and the optimal parsers blur the difference."""
    import zstandard

    return zstandard.ZstdCompressionParameters(
        write_content_size=0, write_checksum=0, write_dict_id=0, window_log=19, chain_log=17, hash_log=17,
        search_log=3, min_match=4, target_length=8, strategy=zstandard.STRATEGY_GREEDY,
    )


def sample_blocks(text: str) -> Iterator[str]:
    """The whole text, normalised, in blocks of about ``SAMPLE_BLOCK`` characters that end between words if they can."""
    clean = normalise(text)
    at = 0
    while at < len(clean):
        stop = clean.find(" ", at + SAMPLE_BLOCK - 1, at + 2 * SAMPLE_BLOCK) + 1 or at + SAMPLE_BLOCK
        yield clean[at:stop].strip()
        at = stop


def learn(
    docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", lang: str = "lang",
    texts_per_language: int = TEXTS_PER_LANGUAGE, dictionary_bytes: int = DICTIONARY_BYTES,
) -> dict[str, bytes]:
    """Dictionaries from the rows where ``train`` holds and ``lang`` is given: a bounded sample of each language, chosen
    by a hash of the key. Only keys are ranked; texts are read for the chosen rows, whole. If their blocks are more than
    ``dictionary_bytes``, those with the smallest hashes are taken, wherever they stand."""
    labelled = docs.where(train & F.col(lang).isNotNull())
    frequent = {r[0]: r[1] for r in labelled.groupBy(lang).agg(F.count(F.lit(1))).collect()}
    rows = labelled.select(key, lang, F.xxhash64(key).alias("_h"))
    rank = F.row_number().over(Window.partitionBy(lang).orderBy("_h", key))
    chosen = rows.withColumn("_r", rank).where(F.col("_r") <= texts_per_language).select(key).distinct().collect()
    keys = [r[0] for r in chosen if r[0] is not None]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, value in zip(*(c.to_pylist() for c in batch.columns)):
                blocks = list(dict.fromkeys(sample_blocks(value)))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(blocks), pa.string()), pa.array(blocks, pa.string())], names=["lang", "block"])

    sampled = labelled.where(F.col(key).isin(keys) & F.col(text).isNotNull())
    blocks = sampled.select(F.col(lang).cast("string"), text).mapInArrow(cut, "lang string, block string").where("block <> ''").distinct()
    # A block has at most twice ``SAMPLE_BLOCK`` characters and most fill it, so this many are enough for the bytes.
    most = dictionary_bytes // 64
    place = F.row_number().over(Window.partitionBy("lang").orderBy("_h", "block"))
    ordered = blocks.withColumn("_h", F.xxhash64("block")).withColumn("_p", place).where(F.col("_p") <= most)
    before = F.sum(F.octet_length("block") + 1).over(Window.partitionBy("lang").orderBy("_p"))
    found = ordered.withColumn("_end", before).where(F.col("_end") <= dictionary_bytes + 1).collect()
    parts: dict[str, list[str]] = {}
    for row in sorted(found, key=lambda r: r["_p"]):
        parts.setdefault(row["lang"], []).append(row["block"])
    return {name: " ".join(parts[name]).encode() for name in sorted(frequent, key=lambda name: (-frequent[name], name)) if name in parts}


class Languages:
    """Compressors of all languages, for one Python worker."""

    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard

        self.names = list(dictionaries)
        self.coders = []
        for content in dictionaries.values():
            prepared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            prepared.precompute_compress(compression_params=_parameters())
            self.coders.append(zstandard.ZstdCompressor(compression_params=_parameters(), dict_data=prepared))

    def sizes(self, text: str) -> list[int]:
        blocks = [text[i : i + BLOCK_CHARS].encode() for i in range(0, len(text), BLOCK_CHARS)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.coders]

    def decide(self, text: str | None, min_margin: float = MIN_MARGIN) -> tuple[str, float, float, bool]:
        """lang, score, margin, rejected. The score is the winner's share of weights that fall with relative size."""
        clean = normalise(text or "")
        # Word signs that are no letters, such as fractions and Roman numerals of their own sign, tell no language.
        if not self.names or not any(c.isalpha() for c in clean):
            return "und", 0.0, 0.0, True
        sizes = np.array(self.sizes(clean), float)
        best = int(sizes.argmin())
        weight = np.exp(-SHARPNESS * (sizes / sizes[best] - 1))
        others = np.delete(sizes, best)
        margin = float(1 - sizes[best] / others.min()) if len(others) else 1.0
        return self.names[best], float(weight[best] / weight.sum()), margin, margin < min_margin


def classifier(spark: SparkSession, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN):
    """A column function: text to struct(lang_pred, score, margin, rejected)."""
    shared = spark.sparkContext.broadcast(dictionaries)

    @F.arrow_udf("lang_pred string, score double, margin double, rejected boolean")
    def identify(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        languages = Languages(shared.value)
        kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
        for batch in batches:
            rows = [languages.decide(t, min_margin) for slab in slabs(batch) for t in slab.to_pylist()]
            columns = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.StructArray.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang_pred", "score", "margin", "rejected"]
            )

    return identify


def identify_languages(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", min_margin: float = MIN_MARGIN) -> DataFrame:
    """Per row: ``key``, held_out, lang_pred, score, margin, rejected. Rows whose fold is 0 are never learned from."""
    identify = classifier(docs.sparkSession, learn(docs, fold(F.col(key)) != 0, key, text, lang), min_margin)
    held_out = F.coalesce(fold(F.col(key)) == 0, F.lit(False)).alias("held_out")
    return docs.select(key, held_out, identify(F.col(text)).alias("_r")).select(key, "held_out", "_r.*")


def keep_identified(docs: DataFrame, labelled: DataFrame, min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows of ``docs`` whose language is clear, all columns as they are. ``labelled`` has doc_id, text, lang."""
    identify = classifier(docs.sparkSession, learn(labelled, fold(F.col("doc_id")) != 0), min_margin)
    return with_verdict(docs, identify(F.col("text")), lambda r: ~r["rejected"])
