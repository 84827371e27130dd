"""The configured datasets as files (A7, A11, B9): one job writes every
(dataset, split) folder that is missing, with bounded files and companion metadata.

Layout under a base folder: ``pairs/name=.../split=...`` and
``metadata/name=.../split=...`` (gz JSON lines, line numbers per split in file
order) and ``log``, an append-only table of what happened to each split: *begun*
before its files are written, *done* after both kinds are.  A split whose last
entry is *done* is complete and skipped by later runs; one that was begun and
not finished is broken and written anew, its folders replaced as a whole
(dynamic partition overwrite).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .io import LINES_PER_FILE, METADATA_SCHEMA, PAIR_SCHEMA, with_ordinal
from .tables import stored

SPLIT = ("name", "split")
LOG = "name string, split string, n bigint, turn int, state string"


def log(spark: SparkSession, base: str) -> DataFrame:
    """What happened to the splits so far; empty where nothing was written yet."""
    try:
        return spark.read.schema(LOG).parquet(f"{base}/log")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], LOG)


def complete(spark: SparkSession, base: str) -> DataFrame:
    """(name, split, n) of the splits whose last entry is *done*."""
    last = log(spark, base).groupBy(*SPLIT).agg(F.max(F.struct("turn", F.col("state") == "done", "n")).alias("last"))
    return last.where("last.col2").select(*SPLIT, "last.n")


def note(spark: SparkSession, base: str, splits: list, turn: int, state: str) -> None:
    """Append entries for splits (name, split, n)."""
    spark.createDataFrame([(*s, turn, state) for s in splits], LOG).coalesce(1).write.mode("append").parquet(f"{base}/log")


def write_splits(rows: DataFrame, sizes: DataFrame, base: str, overwrite: bool = False, lines_per_file: int = LINES_PER_FILE) -> list:
    """Write the splits of ``sizes`` (name, split, n) that are not complete (all of them with ``overwrite``).

    ``rows``: name, split, id (the 0-based line), the pair and its metadata; rows
    of other splits are dropped before their sentences are built.  Returns the
    (name, split, n) written.  ``sizes`` is the configuration: one row per split,
    which bounds what reaches the driver."""
    spark = rows.sparkSession
    todo = sizes if overwrite else sizes.join(complete(spark, base), list(SPLIT), "left_anti")
    todo = [tuple(r) for r in todo.select(*SPLIT, "n").orderBy(*SPLIT).collect()]
    if not todo:
        return []
    turn = 1 + (log(spark, base).agg(F.max("turn")).first()[0] or 0)
    note(spark, base, todo, turn, "begun")
    first, files = [], 0
    for name, split, n in todo:                            # files are numbered through, a split's own ones side by side
        first.append((name, split, files))
        files += max(1, -(-n // lines_per_file))
    places = spark.createDataFrame(first, "name string, split string, _first int")
    held = stored(rows.join(F.broadcast(places), list(SPLIT)), "splits")
    file = F.col("_first") + F.call_function("div", F.col("id"), F.lit(lines_per_file)).cast("int")
    cut = held.repartitionById(files, file).sortWithinPartitions(*SPLIT, "id")      # the order that a writer of folders keeps
    meta = [f.name for f in METADATA_SCHEMA.fields if f.name in rows.columns]
    for kind, columns in (("pairs", [F.struct("src", "prefix", "tgt").alias("translation")]), ("metadata", meta)):
        cut.select(*SPLIT, *columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*SPLIT).option(
            "compression", "gzip").option("ignoreNullFields", "false").json(f"{base}/{kind}")
    note(spark, base, todo, turn, "done")
    return todo


def _read(spark: SparkSession, base: str, kind: str, schema) -> DataFrame:
    for c in SPLIT:
        schema = schema if c in schema.names else type(schema)(list(schema.fields)).add(c, "string")
    return with_ordinal(spark.read.schema(schema).json(f"{base}/{kind}"), "line", SPLIT)


def read_splits(spark: SparkSession, base: str) -> DataFrame:
    """(name, split, line, src, prefix, tgt, metadata...) of the complete splits."""
    pairs = _read(spark, base, "pairs", PAIR_SCHEMA).select(*SPLIT, "line", "translation.src", "translation.prefix", "translation.tgt")
    meta = _read(spark, base, "metadata", METADATA_SCHEMA)
    both = pairs.join(meta, [*SPLIT, "line"])
    return both.join(F.broadcast(complete(spark, base).select(*SPLIT)), list(SPLIT), "left_semi")
