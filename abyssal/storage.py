"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark drops a query's shuffle files as it ends; the written table replaces them.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: ``monotonically_increasing_id`` keeps the row's place in its partition in the low bits.
_ROW_BITS = 33


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where that is unset on one machine (tests) a temporary
    folder is set once for the session; on a cluster executors would not see it, so there it is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or getattr(spark, "_abyssal_dir", None)
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="abyssal-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        where = spark._abyssal_dir = f"file://{folder}"
    return where.rstrip("/")


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the written table.

    Later reads see the same rows in the same files whatever executor is lost.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/abyssal-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, keys: list[str], name: str, rank: str = "n") -> DataFrame:
    """Number all rows from 0 in the order of ``keys`` without a single-task sort.

    Range partitions are sorted and written, so that later reads can't deal them anew; the count
    of each partition (one row a partition) goes to the driver and comes back as offsets. Ties get
    different numbers.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    local = stored(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_row", F.monotonically_increasing_id()), name)
    part = F.shiftright("_row", _ROW_BITS).cast("int")
    counts = {r["p"]: r["n"] for r in local.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    offsets, total = [0] * (max(counts, default=0) + 1), 0
    for p in sorted(counts):
        offsets[p], total = total, total + counts[p]
    row = F.col("_row").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return local.withColumn(rank, F.element_at(F.lit(offsets).cast("array<bigint>"), part + 1) + row).drop("_row")
