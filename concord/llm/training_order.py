"""Training-order materialisation of token sequences.

Texts become token ids (a public tokenizer's file, its path a parameter), each
closed by the end id, and are packed into sequences of ``LENGTH`` ids; the
packed sequences are written once, so that their numbering is fixed.  A keyed
Feistel network over the next power of four, walked until it lands below the
number of sequences, is a permutation of the sequence numbers: it gives every
sequence its global slot without a shuffle table.  Range partitions of the
slots write shards of ``SHARD`` sequences: each sequence takes ``stride`` bytes,
so slot s lies at byte (s - first_slot) * stride of its shard, and a reader that
stopped at any slot goes on from there.

Only sequence counts per partition reach the driver's plan; the vocabulary sent
to the tasks has the size of the tokenizer's file.

Defined cases: null and empty texts give their end id only; documents may span
sequences; the last sequence of a partition is padded with the end id
(``n_tokens`` tells its length); repeated documents are repeated; a null doc_id
is carried as null; an empty table has no shards.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blob, map_batches, stored, unblob
from .words import M1, mix

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LENGTH = 1024
SHARD = 1024
ROUNDS = 6
SEED = 11

SEQUENCE = "part int, place long, n_tokens int, doc_ids array<long>, ids binary"
SHARDS = "shard long, first_slot long, n_sequences int, stride int, n_tokens array<int>, doc_ids array<long>, docs_per_sequence array<int>, payload binary"


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def permute(index: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """The slots of sequence numbers below n."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(int.from_bytes(hashlib.sha256(f"{seed}:{r}".encode()).digest()[:8], "little")) for r in range(ROUNDS)]
    x = index.astype(np.uint64)
    left = np.arange(len(x))
    while len(left):
        a, b = x[left] >> np.uint64(half), x[left] & mask
        for k in keys:
            a, b = b, a ^ (mix(b * M1 + k) & mask)
        x[left] = (a << np.uint64(half)) | b
        left = left[x[left] >= n]
    return x.astype(np.int64)


def slot(index: Column, n: int, seed: int = SEED) -> Column:
    @F.pandas_udf("long")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series(permute(v.to_numpy(np.int64), n, seed))

    return run(index)


def id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def sequences(docs: DataFrame, path: str = TOKENIZER, length: int = LENGTH) -> tuple[DataFrame, str]:
    """Packed sequences (``SEQUENCE``, ids compressed) and the type of an id."""
    vocabulary = ranks(path)
    end = max(vocabulary.values()) + 1
    kind = id_type(end + 1)
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        import tiktoken
        from pyspark import TaskContext

        encode = tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=sent.value, special_tokens={}).encode_ordinary
        part, place = TaskContext.get().partitionId(), 0
        ids: list[int] = []
        owners: list = []                          # documents of the open sequence
        rows: list[tuple] = []

        def close(found: list[int]) -> None:
            nonlocal place
            full = np.full(length, end, kind)
            full[:len(found)] = found
            rows.append((part, place, len(found), owners, blob(full)))
            place += 1

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                zip(*rows), (pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary()))], names=["part", "place", "n_tokens", "doc_ids", "ids"])
            rows.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids += encode(text or "")
                ids.append(end)
                owners = [*owners, doc_id]
                whole = len(ids) // length * length
                for at in range(0, whole, length):
                    close(ids[at:at + length])
                    owners = [doc_id]
                    if len(rows) >= 256:
                        yield out()
                if whole:
                    ids = ids[whole:]
                    owners = [doc_id] if ids else []
        if ids:
            close(ids)
        if rows:
            yield out()

    return stored(map_batches(docs.select("doc_id", "text"), run, SEQUENCE), "token-sequences"), kind


def shards(docs: DataFrame, path: str = TOKENIZER, length: int = LENGTH, size: int = SHARD, seed: int = SEED) -> DataFrame:
    """The shards (``SHARDS``) of a table's training order."""
    packed, kind = sequences(docs, path, length)
    counts = packed.groupBy("part").count()
    n = counts.agg(F.sum("count")).first()[0] or 0
    shift = counts.select("part", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shift"))
    # one row per partition of the packed table: always small, so the packed ids stay where they lie
    placed = packed.join(F.broadcast(shift), "part").withColumn("slot", slot(F.col("shift") + F.col("place"), n, seed))
    placed = placed.select((F.col("slot") / size).cast("long").alias("shard"), "slot", "n_tokens", "doc_ids", "ids")
    parts = max(1, min(-(-n // size), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    ordered = placed.repartitionByRange(parts, "shard").sortWithinPartitions("slot")
    stride = length * np.dtype(kind).itemsize

    def run(batches):
        held: list[dict] = []

        def out():
            row = (held[0]["shard"], held[0]["slot"], len(held), stride, [r["n_tokens"] for r in held], [d for r in held for d in r["doc_ids"]],
                   [len(r["doc_ids"]) for r in held], b"".join(unblob(r["ids"], kind).tobytes() for r in held))
            held.clear()
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=[c.split()[0] for c in SHARDS.split(", ")])

        for batch in batches:
            for r in batch.to_pylist():
                if held and r["shard"] != held[0]["shard"]:
                    yield out()
                held.append(r)
        if held:
            yield out()

    return map_batches(ordered, run, SHARDS)


def write(df: DataFrame, path: str) -> None:
    """Shards as Parquet, sorted by slot inside and across files."""
    df.write.option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str, first: int, n: int, dtype: str = "<u2") -> DataFrame:
    """(slot, ids) of the n slots from ``first`` on; only the shards that hold them are read."""
    held = spark.read.parquet(path).where((F.col("first_slot") < first + n) & (F.col("first_slot") + F.col("n_sequences") > first))

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                lo, hi = max(first, r["first_slot"]), min(first + n, r["first_slot"] + r["n_sequences"])
                at = [(s, (s - r["first_slot"]) * r["stride"], r["n_tokens"][s - r["first_slot"]]) for s in range(lo, hi)]
                ids = [np.frombuffer(r["payload"], dtype, k, a).astype(np.int32).tolist() for _, a, k in at]
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _, _ in at], pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["slot", "ids"])

    return map_batches(held, run, "slot long, ids array<int>")
