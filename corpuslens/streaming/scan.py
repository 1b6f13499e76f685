"""Continuous rule scan over newly arriving files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.operators.findings import GLOBAL_KEY
from corpuslens.operators.rules import LINE_FAMILIES, match_rules
from corpuslens.session import scratch_path


def stream_rules(files: DataFrame, families: tuple[str, ...] = LINE_FAMILIES) -> DataFrame:
    """The batch rule scan on a stream of files. It is stateless, so it takes a stream as it is."""
    return match_rules(files, families)


def dedup_stream(findings: DataFrame, arrival: str, delay: str = "1 hour") -> DataFrame:
    """Drops a finding seen again within the delay; the state is bounded by the watermark."""
    return findings.withWatermark(arrival, delay).dropDuplicatesWithinWatermark(list(GLOBAL_KEY))


def run_available(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now and returns what it wrote, read back from the shared folder."""
    spark = stream.sparkSession
    base = scratch_path(spark, label)
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{base}/out")
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def run_updates(stream: DataFrame, keys: list[str], label: str, newest: tuple[str, ...] = ()) -> DataFrame:
    """Runs an update-mode stream over what is there now; the row per key with the largest ``newest`` columns, then of
    the last batch, wins."""
    spark = stream.sparkSession
    base = scratch_path(spark, label)

    def write(batch: DataFrame, batch_id: int) -> None:
        # Overwriting the batch's own folder makes a retried batch harmless.
        batch.withColumn("_batch", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(f"{base}/out/b={batch_id}")

    query = (
        stream.writeStream.foreachBatch(write)
        .outputMode("update")
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    rows = spark.read.parquet(f"{base}/out").drop("b")
    values = [c for c in stream.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*newest, "_batch")).alias("_v"))
    return last.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in values])
