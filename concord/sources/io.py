"""Sources and sinks (A1-A12): sentence-pair JSON lines with a companion
metadata file, prediction text, TSV gold, result CSV, pairing by line,
ordered unions, dataset config, run parameters.

Line numbers of multi-file tables come from the files themselves: a row's place
is its file's place in path order and its place in the file, both taken in the
JVM from the scan's metadata, so tables written side by side line up whatever
sizes their files have and however Spark packs them into partitions.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .tables import ranked, shuffles_dropped, stored

PAIR_SCHEMA = T.StructType([T.StructField("translation", T.StructType([
    T.StructField("src", T.StringType()), T.StructField("prefix", T.StringType()),
    T.StructField("tgt", T.StringType()),
    T.StructField("predict_identical_until_given_word_number", T.IntegerType()),
    T.StructField("predict_from_given_words_after_identical", T.ArrayType(T.StringType()))]))])

METADATA_SCHEMA = T.StructType([
    T.StructField("subject_number", T.StringType()),
    T.StructField("predict_identical_until_given_word_number", T.IntegerType()),
    T.StructField("object_number", T.StringType()),
    T.StructField("main_verb", T.StringType()),
    T.StructField("predict_from_given_words_after_identical", T.ArrayType(T.StringType())),
    T.StructField("final_intervener_number", T.StringType()),
    T.StructField("n_distractors", T.IntegerType()),
    T.StructField("each_distractor_structure", T.StringType()),
    T.StructField("distractor_structures", T.StringType()),
    T.StructField("final_distractor_structure", T.StringType()),
    T.StructField("pos_sequence", T.StringType()),
    T.StructField("tense", T.StringType()),
    T.StructField("condition", T.StringType()),
])


def with_ordinal(df: DataFrame, name: str = "example_id", within: tuple = ()) -> DataFrame:
    """A3: 0-based line number of a file-based table, over its files in path order;
    with ``within`` (partition columns of the folders), numbered anew for each of their values.

    A file block is read by one task in order, so ``monotonically_increasing_id``
    counts its rows; a table of the blocks' first ids and sizes (one row per
    block) turns that into a number over all files."""
    block = ["_line_path", "_line_block"]
    x = df.select("*", F.col("_metadata.file_path").alias(block[0]), F.col("_metadata.file_block_start").alias(block[1]))
    x = x.withColumn("_line_id", F.monotonically_increasing_id())
    blocks = x.groupBy(*within, *block).agg(F.min("_line_id").alias("_line_first"), F.count(F.lit(1)).alias("_line_n"))
    before = F.sum("_line_n").over(Window.partitionBy(*within).orderBy(*block).rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.withColumn("_line_shift", F.coalesce(before, F.lit(0)) - F.col("_line_first")).drop("_line_first", "_line_n", *within)
    # every row has its block; a left join is left out of plans that ask for no number, as a count
    out = x.join(F.broadcast(blocks), block, "left").withColumn(name, F.col("_line_id") + F.col("_line_shift"))
    return out.select(*df.columns, name)


PAIR = ("src", "prefix", "tgt")


def write_pairs(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Sentence pairs as gz JSON lines {"translation": {src, prefix, tgt}}."""
    out = df.select(F.struct(*PAIR).alias("translation"))
    out.write.mode(mode).option("compression", "gzip").json(path)


def write_metadata(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Companion metadata, NULLs written explicitly."""
    cols = [f.name for f in METADATA_SCHEMA.fields if f.name in df.columns]
    df.select(*cols).write.mode(mode).option("compression", "gzip").option("ignoreNullFields", "false").json(path)


LINES_PER_FILE = 250_000


def in_files(df: DataFrame, line: str, n_lines: int, lines_per_file: int = LINES_PER_FILE) -> DataFrame:
    """Rows with 0-based line numbers as the partitions of a written table: partition
    k, which becomes the k-th file by name, holds the k-th ``lines_per_file`` lines in order."""
    files = max(1, -(-n_lines // lines_per_file))
    return df.repartitionById(files, F.call_function("div", F.col(line), F.lit(lines_per_file)).cast("int")).sortWithinPartitions(line)


def write_dataset(df: DataFrame, path: str, order: list, lines_per_file: int = LINES_PER_FILE) -> None:
    """Pairs and metadata written side by side in the given order.

    The columns that are written (and the order's, where it is given by names) are
    stored, since numbering reads them twice, and shuffled without the others.  The
    rows are numbered first (``ranked``: stored, no global window); a row's
    number alone says which file it goes to and where it stands there, so the
    files by name hold the order asked for, whatever a scan makes of the stored
    rows, and file k of the pairs lines up with file k of the metadata."""
    if all(isinstance(x, str) for x in order):
        wanted = {*PAIR, *order, *(f.name for f in METADATA_SCHEMA.fields)}
        df = df.select(*[c for c in df.columns if c in wanted])
    placed = ranked(stored(df, "dataset-rows"), order, "_line", "dataset")
    n = placed.count()
    with shuffles_dropped(df.sparkSession):
        write_pairs(in_files(placed, "_line", n, lines_per_file), path)
        write_metadata(in_files(placed, "_line", n, lines_per_file), metadata_path(path))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """A1: pairs flattened to (example_id, src, prefix, tgt[, constraint fields])."""
    df = with_ordinal(spark.read.schema(PAIR_SCHEMA).json(path))
    return df.select("example_id", "translation.*")


def metadata_path(pairs_path: str) -> str:
    """A2: companion file name: '.json' -> '_metadata.json'."""
    return pairs_path.replace(".json", "_metadata.json")


CONSTRAINTS = ["predict_identical_until_given_word_number", "predict_from_given_words_after_identical"]


def read_metadata(spark: SparkSession, path: str, keep: list | None = None) -> DataFrame:
    """A2: metadata rows with line numbers; optionally only the chosen keys."""
    df = with_ordinal(spark.read.schema(METADATA_SCHEMA).json(path))
    return df.select("example_id", *keep) if keep else df


def read_validation(spark: SparkSession, path: str) -> DataFrame:
    """A2/A3: pairs with the constraint fields of their metadata; the plain pairs
    if no metadata row has any of them."""
    pairs = read_pairs(spark, path).drop(*CONSTRAINTS)
    meta = read_metadata(spark, metadata_path(path), CONSTRAINTS)
    some = F.col(CONSTRAINTS[0]).isNotNull() | F.col(CONSTRAINTS[1]).isNotNull()
    if not meta.where(some).head(1):
        return pairs
    return pairs_with_metadata(pairs, meta)


def pairs_with_metadata(pairs: DataFrame, metadata: DataFrame) -> DataFrame:
    """A3: line-aligned join; unequal row counts are an error (as the original assert)."""
    n1, n2 = pairs.count(), metadata.count()
    if n1 != n2:
        raise ValueError(f"pairs ({n1}) and metadata ({n2}) are not line-aligned")
    return pairs.join(metadata, "example_id")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """A4: one prediction per line -> (example_id, pred)."""
    return with_ordinal(spark.read.text(path)).withColumnRenamed("value", "pred")


def gold_from_tsv(line: str = "value"):
    """A5: the gold sentence is the second tab-separated field."""
    return F.get(F.split(F.col(line), "\t"), 1)


def read_gold_tsv(spark: SparkSession, path: str) -> DataFrame:
    return with_ordinal(spark.read.text(path)).select("example_id", gold_from_tsv().alias("gold"))


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """A1/A5: (example_id, gold) from a .json[.gz] pair file or a tab-separated one."""
    if path.removesuffix(".gz").endswith(".json"):
        return read_pairs(spark, path).select("example_id", F.col("tgt").alias("gold"))
    return read_gold_tsv(spark, path)


def input_format(path: str) -> str:
    """H14: 'csv' or 'json' from a path's extension (.gz aside); anything else is an error."""
    kind = path.removesuffix(".gz").rsplit(".", 1)[-1]
    if kind not in ("csv", "json"):
        raise ValueError(f"{path} should be a csv or a json file")
    return kind


def input_format_col(path_col) -> "F.Column":
    """H14 as a column: NULL for paths that ``input_format`` refuses."""
    c = F.col(path_col) if isinstance(path_col, str) else path_col
    ext = F.regexp_extract(c, r"\.(csv|json)(\.gz)?$", 1)
    return F.when(ext != "", ext)


def read_input(spark: SparkSession, path: str) -> DataFrame:
    """The training or validation file by its extension."""
    if input_format(path) == "csv":
        return with_ordinal(spark.read.option("header", True).csv(path))
    return read_pairs(spark, path)


def read_config(spark: SparkSession, path: str) -> tuple[dict, list]:
    """Dataset configuration JSON -> ({lang: {dataset: (p, {split: n}, generator)}}, [(train, test)]).

    The file is read by Spark (one bounded document); the generator's name is
    the last part of its dotted path."""
    text = spark.read.option("wholetext", True).text(path).first()[0]
    raw = json.loads(text)
    langs = {lang: {name: (float(p), {k: int(n) for k, n in splits.items()}, gen.rsplit(".", 1)[-1])
                    for name, (p, splits, _, gen) in sets.items()} for lang, sets in raw["langs"].items()}
    return langs, [tuple(x) for x in raw.get("pairs", [])]


def write_config(spark: SparkSession, path: str, config: dict, pairs: list, grammars: dict) -> None:
    """The inverse of ``read_config``."""
    raw = {"langs": {lang: {name: [p, splits, grammars.get(lang, lang), gen] for name, (p, splits, gen) in sets.items()}
                     for lang, sets in config.items()}, "pairs": [list(x) for x in pairs]}
    spark.createDataFrame([(json.dumps(raw),)], "value string").coalesce(1).write.text(path)


RUN_SCHEMA = "train_dataset string, num_train_epochs double, num_train_examples bigint, learning_rate double, n_params string"


def read_run_params(spark: SparkSession, path: str) -> DataFrame:
    """The run-parameter record(s), one JSON object per line."""
    return spark.read.schema(RUN_SCHEMA).json(path)


def write_results_csv(df: DataFrame, path: str, mode: str = "overwrite", partition_by: str | None = None) -> None:
    """Result rows as CSV.gz with 'NaN' for NULL; arrays as JSON text."""
    cols = [F.to_json(F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
            else F.col(f.name) for f in df.schema.fields]
    w = df.select(*cols).write.mode(mode).option("header", True).option("nullValue", "NaN").option("compression", "gzip")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.csv(path)


def read_checkpoint_results(spark: SparkSession, glob_path: str, schema) -> DataFrame:
    """Every checkpoint's results as one table with the given types, the
    iteration taken from the path, and ``place``: the order by iteration, within
    it that of the files' lines."""
    schema = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    plain = T.StructType([f if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else T.StructField(f.name, T.StringType())
                          for f in schema.fields if f.name != "iteration"])
    df = spark.read.schema(plain).option("header", True).option("nullValue", "NaN").csv(glob_path)
    it = F.regexp_extract(F.col("_metadata.file_path"), r"checkpoint-([0-9]+)", 1).cast("int")
    df = with_ordinal(df.select("*", "_metadata", it.alias("iteration")), "line")
    back = [F.from_json(f.name, f.dataType).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f.name)
            for f in schema.fields if f.name != "iteration"]
    return df.select("iteration", "line", *back)


def ordered_union(frames: list) -> DataFrame:
    """A10: concatenation in the given order: (file_ordinal, rows...)."""
    out = None
    for i, f in enumerate(frames):
        f = f.withColumn("file_ordinal", F.lit(i))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out
