"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Settings the operators are written for. A cluster sets its own memory, cores and shuffle partitions.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

#: A table below this many rows may be broadcast; the count is always known before the hint is given.
BROADCAST_ROWS = 100_000
#: A table of binary values below this many bytes may be broadcast.
BROADCAST_BYTES = 64 * 1024 * 1024


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName("framewright")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for name, value in {**SETTINGS, **extra}.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The folder shared by all executors, as the session names it.

    Only a local session without that setting gets a folder of its own: there every task runs on this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="framewright-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the scratch folder."""
    app = spark.sparkContext.applicationId
    return f"{scratch_root(spark).rstrip('/')}/{app}/{label}-{uuid.uuid4().hex}"


def scratch_table(df: DataFrame, label: str = "table") -> DataFrame:
    """Write *df* once and read it back: later branches see the same rows, and lost executors cost no recompute."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, bytes_of: str | None = None) -> DataFrame:
    """Hint a broadcast only when the measured size allows it; otherwise the join shuffles both sides.

    *bytes_of* names a binary column whose total size is measured as well.
    """
    size = F.sum(F.octet_length(bytes_of)) if bytes_of else F.lit(0)
    rows, total = df.agg(F.count(F.lit(1)), F.coalesce(size, F.lit(0))).first()
    small = rows <= BROADCAST_ROWS and total <= BROADCAST_BYTES
    return F.broadcast(df) if small else df


def join_null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on columns that may be null, keeping one copy of them (the left one)."""
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    condition = F.lit(True)
    for c in on:
        condition = condition & left[c].eqNullSafe(renamed[f"_r_{c}"])
    return left.join(renamed, condition, how).drop(*[f"_r_{c}" for c in on])
