"""Table helpers: positions in a total order without a global window, and
intermediate tables written to the cluster's shared folder."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def scratch_path(spark, name: str) -> str:
    """A fresh folder under the cluster's shared ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/concord/{name}-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark):
    """Writes inside remove their shuffles' files when they end, not when the driver's JVM happens to collect them."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back."""
    path = scratch_path(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, order: list, rank: str, name: str) -> DataFrame:
    """Add the 0-based position in a total order: range partitions are sorted and
    numbered inside, then shifted by the counts of the partitions before them (one row
    per partition).  Written once: numbering needs two passes over the same partitions.

    The number of a row in its partition is the lower part of Spark's row id: a window
    over the partition would shuffle the sorted rows a second time.  ``df`` is run twice
    (once for the ranges' bounds): callers store what is dear to compute."""
    part, place = f"__{rank}_part", f"__{rank}_place"
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    held = stored(cut.withColumn(place, F.monotonically_increasing_id()), name)
    held = held.withColumn(part, F.shiftright(place, 33)).withColumn(place, F.col(place).bitwiseAND(F.lit((1 << 33) - 1)))
    shift = held.groupBy(part).count().select(F.col(part), F.coalesce(F.sum("count").over(
        Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(rank))
    return held.join(F.broadcast(shift), part).withColumn(rank, F.col(rank) + F.col(place)).drop(part, place)


def running_total(df: DataFrame, order: list, value: str, total: str, name: str) -> DataFrame:
    """Add the sum of ``value`` over the rows before, in a total order: range
    partitions are summed inside, then shifted by the sums of the partitions before them."""
    part, inside = f"__{total}_part", f"__{total}_inside"
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(n, *order).withColumn(part, F.spark_partition_id())
    before = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    held = stored(cut.withColumn(inside, F.coalesce(F.sum(value).over(before), F.lit(0))), name)
    shift = held.groupBy(part).agg(F.sum(value).alias("__sum")).select(F.col(part), F.coalesce(F.sum("__sum").over(
        Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(total))
    return held.join(F.broadcast(shift), part).withColumn(total, F.col(total) + F.col(inside)).drop(part, inside)
