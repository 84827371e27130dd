"""Model-input preparation (H1-H14): input strings, a corpus vocabulary,
token ids, truncation, static and dynamic padding, forced prefixes and
allowed-next-token constraints.

Tokenisation is word level over the formatted text (the vocabulary is built
by Spark from the data); everything is DataFrame functions, no Python per row.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import format_sentence, truncate_words, words
from ..sources.io import CONSTRAINTS
from ..sources.tables import ranked, stored

PAD_ID, EOS_ID, UNK_ID = 0, 1, 2
FIRST_WORD_ID = 3
LABEL_PAD = -100
MAX_SOURCE_LENGTH = 1024
MAX_TARGET_LENGTH = 128


def build_inputs(df: DataFrame, src="src", prefix="prefix", source_prefix: str | None = None,
                 model_prefix: str | None = None) -> Column:
    """H1/H2: task prefix (argument, else the model's, else '') + row prefix + source."""
    task = source_prefix if source_prefix is not None else (model_prefix if model_prefix is not None else "")
    return F.concat(F.lit(task), F.col(prefix), F.col(src))


def tokens(text: Column) -> Column:
    """Word tokens of the formatted text."""
    return words(format_sentence(text))


def vocabulary(df: DataFrame, tokens_col: str) -> DataFrame:
    """H3: (word, n, token_id) with ids by (count desc, word), after the
    special ids.  Counting is a partially aggregated shuffle; the ranking numbers
    range partitions and shifts them (``ranked``), and is stored once, since
    every encode reads it."""
    # explode_outer: a plain explode adds a filter on the tokens, which is pushed
    # below and repeats whatever they are computed from
    each = df.select(F.explode_outer(tokens_col).alias("word")).where(F.col("word").isNotNull())
    counts = each.groupBy("word").agg(F.count("*").alias("n"))
    # ranking samples its input for range bounds first: the counts are written, not counted twice
    placed = ranked(stored(counts, "word-counts"), [F.desc("n"), F.asc("word")], "place", "vocabulary")
    return placed.select("word", "n", (F.col("place") + FIRST_WORD_ID).cast("int").alias("token_id"))


SMALL_VOCABULARY = 512             # words that are looked up inside a row


def small_vocabulary(vocab: DataFrame) -> dict | None:
    """{word: token_id} of a vocabulary of at most ``SMALL_VOCABULARY`` words (a grammar's), most frequent first; else None."""
    rows = vocab.select("word", "token_id").orderBy("token_id").limit(SMALL_VOCABULARY + 1).collect()
    return {r.word: r.token_id for r in rows} if len(rows) <= SMALL_VOCABULARY else None


def small_ids(words_col: Column, ids: dict) -> Column:
    """Token ids of an array of words by a literal map (unknown -> UNK)."""
    if not ids:
        return F.transform(words_col, lambda w: F.lit(UNK_ID))
    known = F.create_map(*[F.lit(x) for kv in ids.items() for x in kv])
    return F.transform(words_col, lambda w: F.coalesce(F.try_element_at(known, w), F.lit(UNK_ID)))


def encode(df: DataFrame, key: str, tokens_col: str, vocab: DataFrame, add_eos: bool = True, unique: bool = False) -> DataFrame:
    """H3: token ids per row (unknown -> UNK, EOS appended).

    Where a key has one row (``unique``) and the vocabulary is a grammar's, words
    are looked up inside the row.  Otherwise tokens are exploded with their position
    (rows without tokens stay), joined to the vocabulary and put together again per
    key.  How the vocabulary is joined is left to the adaptive planner, which
    knows its size in bytes and splits the partitions of frequent words."""
    small = small_vocabulary(vocab) if unique else None
    if small is not None:
        ids = F.coalesce(small_ids(F.col(tokens_col), small), F.array().cast("array<int>"))
        return df.select(key, (F.concat(ids, F.array(F.lit(EOS_ID))) if add_eos else ids).alias("ids"))
    ex = df.select(key, F.posexplode_outer(tokens_col).alias("pos", "word"))
    j = ex.join(vocab.select("word", "token_id"), "word", "left")
    tok = F.when(F.col("pos").isNotNull(), F.struct("pos", F.coalesce("token_id", F.lit(UNK_ID)).alias("token_id")))
    g = j.groupBy(key).agg(F.sort_array(F.collect_list(tok)).alias("_t"))
    ids = F.transform("_t", lambda s: s["token_id"])
    return g.select(key, (F.concat(ids, F.array(F.lit(EOS_ID))) if add_eos else ids).alias("ids"))


TOKENIZER_BYTES = 256 << 20        # of a tokenizer's file, which every task gets


def encode_external(df: DataFrame, text: str, tokenizer: str, out: str = "ids", add_eos: bool = False) -> DataFrame:
    """H3 with an external tokenizer: ``df`` plus the token ids of ``text`` as array<int>.

    ``tokenizer`` is the path of a file in the ``tokenizers`` library's JSON format;
    Spark reads it, its size is checked, and it is broadcast once; a task loads it
    once and encodes whole Arrow batches.  NULL text has NULL ids; ``add_eos``
    appends ``EOS_ID``."""
    spark = df.sparkSession
    file = spark.read.format("binaryFile").load(tokenizer).select("length", "content")
    if file.agg(F.sum("length")).first()[0] > TOKENIZER_BYTES:
        raise ValueError(f"{tokenizer} is larger than {TOKENIZER_BYTES} bytes")
    sent = spark.sparkContext.broadcast(bytes(file.where("length > 0").first().content))
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])
    end = [EOS_ID] if add_eos else []

    def run(batches):
        from tokenizers import Tokenizer

        load = Tokenizer.from_buffer(sent.value)
        for batch in batches:
            texts = batch.column(text).to_pylist()
            ids = iter(load.encode_batch([t for t in texts if t is not None], add_special_tokens=False))
            made = [None if t is None else next(ids).ids + end for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.list_(pa.int32()))], names=schema.names)

    return df.mapInArrow(run, schema)


def word_tokenizer(vocab: DataFrame) -> str:
    """A vocabulary (word, token_id) as a word-level tokenizer in the ``tokenizers`` library's JSON format.

    For vocabularies of a grammar's size; the file's bound is checked when it is read."""
    ids = {r.word: r.token_id for r in vocab.select("word", "token_id").toLocalIterator()}
    return json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None,
                       "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "decoder": None,
                       "model": {"type": "WordLevel", "vocab": {"<unk>": UNK_ID, **ids}, "unk_token": "<unk>"}})


def truncate_ids(ids: Column, max_len: int, keep_eos: bool = True) -> Column:
    """H4: at most ``max_len`` ids; the end-of-sequence id stays last."""
    if not keep_eos:
        return F.slice(ids, 1, max_len)
    return F.when(F.size(ids) <= max_len, ids).otherwise(
        F.concat(F.slice(ids, 1, max_len - 1), F.array(F.lit(EOS_ID))))


def pad(ids: Column, length, value: int = PAD_ID) -> Column:
    """H5: right-pad to ``length`` (a literal or a column)."""
    n = length if isinstance(length, Column) else F.lit(length)
    return F.concat(ids, F.array_repeat(F.lit(value), F.greatest(n - F.size(ids), F.lit(0))))


def attention_mask(ids: Column, length) -> Column:
    n = length if isinstance(length, Column) else F.lit(length)
    return F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), F.greatest(n - F.size(ids), F.lit(0))))


def labels(ids: Column, length) -> Column:
    """H5: label ids padded with -100 (ignored by the loss)."""
    return pad(ids, length, LABEL_PAD)


def with_batches(df: DataFrame, order_col: str, batch_size: int) -> DataFrame:
    """H6: consecutive batches in ``order_col`` order (distributed ranks)."""
    placed = ranked(df, [F.col(order_col)], "_place", "batches")
    return placed.withColumn("batch_id", F.call_function("div", F.col("_place"), F.lit(batch_size))).drop("_place")


def dynamic_pad(df: DataFrame, ids_col: str, batch_col: str = "batch_id", value: int = PAD_ID) -> DataFrame:
    """H6: pad each row to the longest sequence of its batch (partitioned window)."""
    w = Window.partitionBy(batch_col)
    m = F.max(F.size(ids_col)).over(w)
    return df.withColumn("batch_max_len", m).withColumn(ids_col, pad(F.col(ids_col), F.col("batch_max_len"), value))


def forced_prefix(gold: Column, k: Column) -> Column:
    """The first k words of the gold target (kept identical when decoding)."""
    return truncate_words(gold, k)


def allowed_by_position(df: DataFrame, key: str, prefix_col: str, alts_col: str, vocab: DataFrame, unique: bool = False) -> DataFrame:
    """The token ids that a decoder may emit at each position of a row.

    ``prefix_col``: the words of the forced prefix, which alone are allowed at
    the first positions; ``alts_col``: the words of each alternative after it.
    Alternatives end with EOS and are padded to the longest; the last position
    is stripped.  At a position, an alternative that has just ended opens a new
    word (``opens_word``), one that ended before opens everything (``open_all``),
    the others allow their token.  Where a key has one row (``unique``) and the
    vocabulary is a grammar's, positions are made inside the row."""
    n = F.size(prefix_col)
    longest = F.aggregate(F.transform(alts_col, lambda a: F.size(a)), F.lit(0), lambda m, k: F.greatest(m, k))
    small = small_vocabulary(vocab) if unique else None
    if small is not None:
        rows = df.select(key, small_ids(F.col(prefix_col), small).alias("_p"), F.transform(alts_col, lambda a: small_ids(a, small)).alias("_a"))
        n, sizes = F.size("_p"), F.transform("_a", lambda a: F.size(a))
        longest = F.coalesce(F.array_max(sizes), F.lit(0))

        def after(j):
            here = F.array_compact(F.transform("_a", lambda a: F.get(a, j)))
            return F.struct((n + j).cast("int").alias("pos"), F.array_sort(F.array_distinct(here)).alias("allowed"),
                            F.exists("_a", lambda a: F.size(a) == j).alias("opens_word"), F.exists("_a", lambda a: F.size(a) < j).alias("open_all"))

        forced = F.transform("_p", lambda t, i: F.struct(i.alias("pos"), F.array(t).alias("allowed"), F.lit(False).alias("opens_word"), F.lit(False).alias("open_all")))
        places = F.when(longest > 0, F.sequence(F.lit(0), longest - 1)).otherwise(F.array().cast("array<int>"))
        return rows.select(key, F.explode(F.concat(forced, F.transform(places, after))).alias("_i")).select(key, "_i.*")

    def item(pos, word, mark):
        return F.struct(pos.cast("int").alias("pos"), word.alias("word"), F.lit(mark).alias("mark"))

    none = F.lit(None).cast("string")
    forced = F.transform(prefix_col, lambda w, i: item(i, w, "token"))

    def one(a):
        said = F.transform(a, lambda w, i: item(n + i, w, "token"))
        after = F.filter(F.transform(F.sequence(F.lit(0), longest), lambda j: F.struct(j.alias("j"), F.size(a).alias("m"))),
                         lambda s: (s["j"] >= s["m"]) & (s["j"] < longest))
        ends = F.transform(after, lambda s: F.when(s["j"] == s["m"], item(n + s["j"], none, "end")).otherwise(item(n + s["j"], none, "open")))
        return F.concat(said, ends)

    items = F.concat(forced, F.flatten(F.transform(alts_col, one)))
    each = df.select(key, F.explode_outer(items).alias("_i")).select(key, "_i.*").where(F.col("pos").isNotNull())
    each = each.join(vocab.select("word", "token_id"), "word", "left")
    token = F.when(F.col("mark") == "token", F.coalesce("token_id", F.lit(UNK_ID)))
    return each.groupBy(key, "pos").agg(F.array_sort(F.collect_set(token)).alias("allowed"),
                                        F.max(F.col("mark") == "end").alias("opens_word"), F.max(F.col("mark") == "open").alias("open_all"))


def constraint_check(pred: Column, gold: Column, k: Column, allowed_words: Column) -> Column:
    """Does the prediction keep the first k gold words and continue with
    one of the allowed words?  NULL when k is NULL."""
    pw, gw = words(pred), words(gold)
    same = F.slice(pw, 1, k) == F.slice(gw, 1, k)
    nxt = F.get(pw, k)
    return F.when(k.isNotNull(), same & F.coalesce(F.array_contains(allowed_words, nxt), F.lit(False)))


def prepared_columns(columns: list, training: bool) -> list:
    """H9: the source columns that preparation drops: all of them, but for the
    constraint fields of an evaluation table."""
    return [c for c in columns if training or c not in CONSTRAINTS]


def split_fields(schema: T.StructType) -> tuple:
    """H7: (numeric-list columns, other columns) — the former are padded into
    tensors by a collator, the latter passed through untouched."""
    numeric = (T.IntegerType, T.LongType, T.ShortType, T.ByteType, T.FloatType, T.DoubleType)
    num = [f.name for f in schema.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, numeric)]
    return num, [f.name for f in schema.fields if f.name not in num]


def with_constraint_defaults(df: DataFrame) -> DataFrame:
    """A constraint column stays only if some row has a value in it; then
    the identical-prefix length defaults to 0, the allowed next words to NULL."""
    found = [c for c in CONSTRAINTS if c in df.columns]
    if not found:
        return df
    some = df.agg(*[F.count(c).alias(c) for c in found]).first()
    out = df.drop(*[c for c in found if not some[c]])
    if CONSTRAINTS[0] in out.columns:
        out = out.withColumn(CONSTRAINTS[0], F.coalesce(F.col(CONSTRAINTS[0]), F.lit(0)))
    return out


def prepare(df: DataFrame, key: str, input_ids: DataFrame, label_ids: DataFrame, training: bool, max_source: int = MAX_SOURCE_LENGTH,
            max_target: int = MAX_TARGET_LENGTH) -> DataFrame:
    """Truncated input ids and labels with the constraint columns of ``df``."""
    kept = [c for c in df.columns if c not in prepared_columns(df.columns, training)]
    rows = with_constraint_defaults(df.select(key, *kept))
    x = input_ids.select(key, truncate_ids(F.col("ids"), max_source).alias("input_ids"))
    y = label_ids.select(key, truncate_ids(F.col("ids"), max_target).alias("labels"))
    return rows.join(x, key).join(y, key)
