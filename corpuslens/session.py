"""Session defaults and the shared folder that long jobs cut their lineage with."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app_name: str = "corpuslens", cores: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benches. On a cluster the submitted session is used as it is."""
    cores = cores or os.cpu_count() or 4
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.variant.allowDuplicateKeys", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Only a local master may fall back to a temp folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    folder = tempfile.mkdtemp(prefix="corpuslens-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; every run takes a new one."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def pin(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: values that depend on task placement stay fixed if executors are lost."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


# A side of a join is broadcast only after it was measured and has at most this many rows and bytes.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20


def is_small(side: DataFrame) -> tuple[int, bool]:
    """Rows of a side that was computed once (counted up to the bound), and whether it may be broadcast.

    Bytes are those of the rows as JSON text, an upper estimate for rows of numbers and short texts.
    """
    bounded = side.limit(BROADCAST_ROWS + 1)
    size = F.octet_length(F.to_json(F.struct("*"))) if side.columns else F.lit(0)
    rows, total = bounded.agg(F.count(F.lit(1)), F.coalesce(F.sum(size.cast("bigint")), F.lit(0))).first()
    return rows, rows <= BROADCAST_ROWS and total <= BROADCAST_BYTES


def join_small(big: DataFrame, side: DataFrame, on: str | list[str], how: str) -> DataFrame:
    """Left, left-anti or inner join with a side that is nearly always empty or small, such as repositories over a
    cap or the chunks picked for some questions.

    The side is computed once and measured. Empty: no left or anti join at all. Small: broadcast, so that the big
    side is not shuffled. Larger: an ordinary join, which adaptive execution splits where the big side is skewed.
    """
    side = pin(side)
    rows, small = is_small(side)
    if rows == 0 and how == "left_anti":
        return big
    if rows == 0 and how == "left":
        extra = [f for f in side.schema.fields if f.name not in ([on] if isinstance(on, str) else on)]
        return big.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in extra])
    return big.join(F.broadcast(side) if small else side, on, how)
