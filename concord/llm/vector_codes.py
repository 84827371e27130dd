"""Vector codes by product quantisation with equal-average nearest-entry search.

Vectors are cut into equal consecutive parts; each part position has a codebook
of whole numbers.  The codebooks start as the parts of the vectors with the
smallest ids and are refined in rounds: every part goes to its nearest entry,
each entry becomes the componentwise floor of its parts' mean.

Nearest entries are found by the equal-average rule.  By Cauchy-Schwarz the
squared gap between the component sums of two points, divided by their
dimension, is at most their squared distance.  Entries are sorted by their sum;
the search goes outward from a part's own sum, on both sides, and a side ends
where the squared gap over the dimension is strictly more than the best
distance so far.  Equally near entries are thus all seen, and the one with the
lowest index wins.

Each round is one pass over the vectors without a shuffle of them: a task adds
up its parts by entry and hands on one row per (part, entry, component); only
the codebooks (entries x dimension numbers) reach the driver and the tasks.

Defined cases: rows whose vector is null, empty, holds a null or non-finite
component or has another length than the kept vector with the smallest id are
dropped; components are multiplied by ``scale`` and rounded down, and must then
be below 2^26 (all sums of squares are exact in 64 bits), else an error is
raised; null ids come after all others; rows with equal ids are ordered by
their vectors; fewer vectors than entries make smaller codebooks; repeated rows
count each; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
CHUNK = 8192                       # vectors worked on at once
LIMIT = 1 << 26                    # of a scaled component
ID, VECTOR, LABEL = "__code_id", "__code_vector", "__code_label"


def nearest(values: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of ``values`` (n x d): index of its nearest row of ``book``
    (k x d), their squared distance, and how many entries were compared."""
    n, d = values.shape
    sums = book.sum(axis=1)
    order = np.argsort(sums, kind="stable")
    sums, entries = sums[order], book[order]
    own = values.sum(axis=1)
    best, index = np.full(n, (1 << 62) // d), np.full(n, len(book))
    compared = np.zeros(n, np.int64)
    at = np.searchsorted(sums, own)
    sides = [(np.arange(n), at - 1, -1), (np.arange(n), at, 1)]
    while sides:
        left = []
        for rows, place, step in sides:
            there = (place >= 0) & (place < len(book))
            rows, place = rows[there], place[there]
            gap = own[rows] - sums[place]
            near = gap * gap <= d * best[rows]
            rows, place = rows[near], place[near]
            if not len(rows):
                continue
            far = ((values[rows] - entries[place]) ** 2).sum(axis=1)
            better = (far < best[rows]) | ((far == best[rows]) & (order[place] < index[rows]))
            best[rows[better]], index[rows[better]] = far[better], order[place][better]
            compared[rows] += 1
            left.append((rows, place + step, step))
        sides = left
    return index, best, compared


def scaled(column: pa.Array, size: int, scale: int) -> np.ndarray:
    """The vectors of a list column without nulls as whole numbers, n x size."""
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, size)
    out = np.floor(flat * scale)
    if len(out) and np.abs(out).max() >= LIMIT:
        raise ValueError(f"a component times {scale} is {LIMIT} or more")
    return out.astype(np.int64)


@dataclass
class Codebooks:
    entries: np.ndarray            # parts x entries x components
    scale: int = SCALE

    @property
    def size(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Indexes (n x parts), squared error and compared entries of whole-number vectors (n x size)."""
        parts = vectors.reshape(len(vectors), *self.entries.shape[::2])
        found = [nearest(parts[:, p], book) for p, book in enumerate(self.entries)]
        return np.stack([f[0] for f in found], axis=1), sum(f[1] for f in found), sum(f[2] for f in found)

    def decode(self, indexes: np.ndarray) -> np.ndarray:
        """The vectors that indexes (n x parts) stand for, unscaled."""
        return self.entries[np.arange(indexes.shape[1]), indexes].reshape(len(indexes), -1) / self.scale

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _chunks(batches, size: int, scale: int):
    """(rows as one table, their vectors) for about ``CHUNK`` rows at a time."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= CHUNK:
            whole = pa.Table.from_batches(held).combine_chunks()
            yield whole, scaled(whole.column(VECTOR).combine_chunks(), size, scale)
            held, rows = [], 0
    if rows:
        whole = pa.Table.from_batches(held).combine_chunks()
        yield whole, scaled(whole.column(VECTOR).combine_chunks(), size, scale)


def usable(vector: Column, parts: int) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(fine & (F.size(vector) > 0) & (F.size(vector) % parts == 0), F.lit(False))


def fit(vectors: DataFrame, size: int, parts: int, entries: int, rounds: int, scale: int) -> Codebooks:
    """Codebooks of vectors (id, vector, ...), all of them usable and of ``size``."""
    first = vectors.orderBy(F.col(ID).asc_nulls_last(), VECTOR).limit(entries).select(VECTOR).toArrow()
    start = scaled(first.column(VECTOR).combine_chunks(), size, scale)
    books = Codebooks(np.ascontiguousarray(start.reshape(len(start), parts, size // parts).transpose(1, 0, 2)), scale)
    for _ in range(rounds):
        books = Codebooks(_refined(vectors, books), scale)
    return books


def _refined(vectors: DataFrame, books: Codebooks) -> np.ndarray:
    parts, entries, d = books.entries.shape

    def run(batches):
        total, count = np.zeros((parts, entries, d), np.int64), np.zeros((parts, entries), np.int64)
        for _, values in _chunks(batches, books.size, books.scale):
            index, _, _ = books.encode(values)
            for p in range(parts):
                np.add.at(total[p], index[:, p], values[:, p * d:(p + 1) * d])
                count[p] += np.bincount(index[:, p], minlength=entries)
        if count.any():
            place = np.arange(parts * entries * d)
            yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), pa.array(total.ravel()), pa.array(np.repeat(count.ravel(), d))], names=["place", "total", "count"])

    sums = map_batches(vectors.select(VECTOR), run, "place int, total long, count long").groupBy("place").agg(
        F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum(F.col("count").cast("decimal(38,0)")).alias("count"))
    new = books.entries.copy().ravel()
    for place, total, count in sums.where(F.col("count") > 0).collect():       # entries x dimension rows at most
        new[place] = int(total) // int(count)
    return new.reshape(books.entries.shape)


def compress(table: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks | None]:
    """(id, label, code, error, compared) of the usable rows, and the codebooks (None without rows).

    ``code`` has two hex digits per part (``entries`` is at most 256), ``error`` is the squared distance
    to the decoded vector in scaled units, ``compared`` the entries that the search looked at."""
    if not 1 <= entries <= 256:
        raise ValueError("entries must be between 1 and 256")
    kept = table.select(F.col(id).alias(ID), F.col(vector).alias(VECTOR), F.col(label).alias(LABEL)).where(usable(F.col(vector), parts))
    types = {f.name: f.dataType for f in kept.schema}
    schema = T.StructType([T.StructField(id, types[ID]), T.StructField(label, types[LABEL]), T.StructField("code", T.StringType()),
                           T.StructField("error", T.LongType()), T.StructField("compared", T.LongType())])
    first = kept.orderBy(F.col(ID).asc_nulls_last(), VECTOR).select(F.size(VECTOR)).first()
    if first is None:
        return table.sparkSession.createDataFrame([], schema), None
    size = first[0]
    kept = kept.where(F.size(VECTOR) == size)
    books = fit(kept, size, parts, entries, rounds, scale)

    def run(batches):
        for whole, values in _chunks(batches, size, scale):
            index, error, compared = books.encode(values)
            codes = [bytes(row).hex() for row in index.astype(np.uint8)]
            yield from pa.table([whole.column(ID), whole.column(LABEL), pa.array(codes, pa.string()), pa.array(error), pa.array(compared)],
                                names=schema.names).to_batches()

    return map_batches(kept, run, schema), books


def with_label_error(codes: DataFrame, label: str = "label") -> DataFrame:
    """``codes`` plus label_error: the error summed over rows of equal label, nulls together."""
    sums = codes.groupBy(F.col(label).alias(LABEL)).agg(F.sum("error").alias("label_error"))
    return codes.join(sums, F.col(label).eqNullSafe(F.col(LABEL))).drop(LABEL)
