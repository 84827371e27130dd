"""Helpers that the operators share: tables, shared intermediate files, Arrow maps."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_dir

BATCH_ROWS = 1000              # rows in an Arrow batch: bounds a Python worker's memory on long texts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table once into the shared folder of
    ``spark.checkpoint.dir`` and read it back: lineage ends at files that
    survive the loss of any executor, and later jobs do not repeat the work."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow with small batches."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(fn, schema)


def record_batch(schema: dict, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) for k, t in schema.items()], names=list(schema))


def blob(array) -> bytes:
    """A numpy array as compressed bytes."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(array.tobytes())


def unblob(data: bytes, dtype):
    import numpy as np
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype)


def ranked(df: DataFrame, order: list, rank: str, name: str) -> DataFrame:
    """Add the 0-based position in a total order, without a global window:
    range partitions are numbered inside, then shifted by the counts of the
    partitions before them (one row per partition)."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    part, place = f"__{rank}_part", f"__{rank}_place"
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(n, *order).withColumn(part, F.spark_partition_id())
    held = stored(cut.withColumn(place, F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1), name)
    sizes = held.groupBy(part).count()
    shift = sizes.select(F.col(part), F.coalesce(F.sum("count").over(
        Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(rank))
    return held.join(F.broadcast(shift), part).withColumn(rank, F.col(rank) + F.col(place)).drop(part, place)
