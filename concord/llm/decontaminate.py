"""Benchmark decontamination with an FM-index per shard of training text.

Benchmark texts are cut into phrases of ``WINDOW`` consecutive words (a shorter
item is one phrase).  Each task takes its documents in shards of about 4 MB of
text and builds an FM-index over a shard's words; all phrases are found by
backward search and their occurrences located by sampled suffix positions; the
occurrences of a document are merged into removal spans.

Words that occur in no phrase can be in no occurrence: they are one separator
symbol, and runs of phrase words shorter than the shortest phrase are left out
of the index, which keeps it small without losing an occurrence.

The phrases are a stated query set, in blocks of about ``BLOCK_BYTES`` of benchmark
text at most (an item is never cut).  One block at a time is collected, sent to the
tasks, searched for in all documents and released; each pass adds its spans and items
to those of the passes before, and is stored, so neither the driver nor a task ever
holds more than a block.  A benchmark of one block takes a single pass and stores
nothing.  Documents stay where they lie and are never shuffled.  A word is known by a
64-bit hash.

Defined cases: null or empty text has no words, no hits; an item without words
has no phrase; repeated items count once by item_id, a null item_id as "null";
repeated documents are treated alike; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .common import map_batches, stored
from .fm_index import FMIndex

WINDOW = 10
BLOCK_BYTES = 8 << 20
PREFIX = "__decon_"
SEPARATOR = 1                  # 0 ends the text


class Phrases:
    """Distinct phrases of a block of items, as symbols of the block's own vocabulary."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        w = W.find(pa.array([t for _, t in items], pa.string()), W.ALNUM, lower=True)
        h = w.hashes()
        self.vocabulary = np.unique(h)
        symbol = np.searchsorted(self.vocabulary, h) + SEPARATOR + 1
        by_size: dict[int, dict[bytes, set[str]]] = {}
        for k, (name, _) in enumerate(items):
            s = symbol[w.first[k]:w.first[k + 1]]
            size = min(window, len(s))
            for i in range(len(s) - size + 1 if size else 0):
                by_size.setdefault(size, {}).setdefault(s[i:i + size].tobytes(), set()).add(name)
        self.sizes = [(size, np.array([np.frombuffer(p, np.int64) for p in found]), list(found.values())) for size, found in sorted(by_size.items())]
        self.shortest = min(by_size, default=0)

    def symbols(self, h: np.ndarray) -> np.ndarray:
        """Symbols of word hashes, SEPARATOR for words of no phrase."""
        if not len(self.vocabulary):
            return np.full(len(h), SEPARATOR, np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == h, at + SEPARATOR + 1, SEPARATOR)


def occurrences(phrases: Phrases, w: W.Words) -> list[tuple[int, int, set[str]]]:
    """(first word, size, items) of every phrase occurrence in the shard's words."""
    if not phrases.sizes or not len(w.start):
        return []
    symbol, row = phrases.symbols(w.hashes()), w.row
    known = symbol != SEPARATOR
    edge = np.ones(len(row), bool)                     # where a run of known words of one row begins
    edge[1:] = (row[1:] != row[:-1]) | (known[1:] != known[:-1])
    run = np.cumsum(edge) - 1
    long_ = known & (np.bincount(run)[run] >= phrases.shortest)
    place = np.flatnonzero(long_)
    if not len(place):
        return []
    gaps = np.flatnonzero(run[place][1:] != run[place][:-1]) + 1
    text = np.concatenate([np.insert(symbol[place], gaps, SEPARATOR), [SEPARATOR, 0]])
    origin = np.concatenate([np.insert(place, gaps, -1), [-1, -1]])
    index, found = FMIndex(text), []
    for size, matrix, names in phrases.sizes:
        lo, hi = index.search(matrix)
        got = np.flatnonzero(hi > lo)
        which = np.repeat(got, (hi - lo)[got])
        ranks = np.arange(len(which)) - np.repeat(np.cumsum((hi - lo)[got]) - (hi - lo)[got], (hi - lo)[got]) + lo[which]
        found += [(int(origin[at]), size, names[k]) for k, at in zip(which, index.locate(ranks))]
    return found


def find(phrases: Phrases, column: pa.Array) -> tuple[W.Words, dict[int, list], dict[int, set[str]]]:
    """Words, and for rows with hits their merged word spans and items."""
    w = W.find(column, W.ALNUM, lower=True)
    spans: dict[int, list] = {}
    items: dict[int, set[str]] = {}
    for first, size, names in sorted(occurrences(phrases, w), key=lambda x: x[:2]):
        r = int(np.searchsorted(w.first, first, "right")) - 1
        items.setdefault(r, set()).update(names)
        merged = spans.setdefault(r, [])
        at = first - int(w.first[r])
        if merged and at <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], at + size)
        else:
            merged.append([at, at + size])
    return w, spans, items


def blocks(benchmark: DataFrame) -> Iterator[tuple[Phrases, bool]]:
    """The benchmark's phrases in blocks of bounded size, one at a time, and whether it is the last."""
    items = benchmark.where("text IS NOT NULL").select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("name"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(2 * total / BLOCK_BYTES))     # hashed to blocks of half the bound on average
    if n > 1:                                          # in files by block, so that a block reads its own
        items = stored(items.withColumn("block", F.pmod(F.xxhash64("name", "text"), F.lit(n))).repartitionByRange("block").sortWithinPartitions("block"), "decon-items")
    for k in range(n):
        yield Phrases([(r.name, r.text) for r in (items.where(F.col("block") == k) if n > 1 else items).select("name", "text").collect()]), k == n - 1


FOUND = T.StructType().add("n_words", T.LongType()).add(
    "spans", T.ArrayType(T.StructType().add("first", T.IntegerType()).add("last", T.IntegerType()))).add("items", T.ArrayType(T.StringType()))
SPANS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def search(docs: DataFrame, phrases, columns: list[str]) -> DataFrame:
    """``columns`` of docs and its text, n_words, spans and items under prefixed names; spans and items that docs has are kept."""
    schema = docs.select(*columns, PREFIX + "text").schema
    for f in FOUND:
        schema = schema.add(PREFIX + f.name, f.dataType)
    names, more = [f.name for f in schema], PREFIX + "spans" in docs.columns

    def run(batches):
        for batch in batches:
            for part in W.slices(batch, PREFIX + "text"):
                w, spans, items = find(phrases.value, part.column(PREFIX + "text"))
                if more:
                    for r, (s, named) in enumerate(zip(part.column(PREFIX + "spans").to_pylist(), part.column(PREFIX + "items").to_pylist())):
                        if s:
                            spans[r] = merge(spans.get(r, []) + [[x["first"], x["last"]] for x in s])
                            items[r] = items.get(r, set()) | set(named)
                rows = range(part.num_rows)
                arrays = [part.column(c) for c in columns] + [
                    part.column(PREFIX + "text"), pa.array(w.counts, pa.int64()),
                    pa.array([[{"first": a, "last": b} for a, b in spans.get(r, ())] for r in rows], SPANS),
                    pa.array([sorted(items.get(r, ())) for r in rows], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return map_batches(docs, run, schema)


def mark(docs: DataFrame, benchmark: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of docs with n_words, spans (hit words, first to before last) and items under prefixed names."""
    return search_all(docs.select(*columns, F.col("text").alias(PREFIX + "text")), blocks(benchmark), columns).drop(PREFIX + "text")


def search_all(held: DataFrame, parts: Iterator[tuple[Phrases, bool]], columns: list[str]) -> DataFrame:
    """``search`` for block after block; all passes but the last are stored."""
    for phrases, last in parts:
        sent = held.sparkSession.sparkContext.broadcast(phrases)
        held = search(held, sent, columns)
        if not last:
            held = stored(held, "decon-found")
            sent.unpersist()
    return held


def merge(spans: list) -> list:
    out: list = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def without(text: str, w: W.Words, at_row: int, spans: list) -> str:
    """A text without the words of its spans."""
    base, end = int(w.first[at_row]), int(w.first[at_row + 1])
    start = int(w.off[at_row])
    data, at, kept = text.encode(), 0, []
    for a, b in spans:
        kept.append(data[at:w.start[base + a] - start])
        at = int(w.start[base + b] if base + b < end else w.end[end - 1]) - start
    return b"".join([*kept, data[at:]]).decode()


def cut(text: str, sent: list[Phrases]) -> str:
    """The text without its removal spans, until none is left."""
    while True:
        column, gone = pa.array([text], pa.string()), []
        for block in sent:
            w, spans, _ = find(block, column)
            gone += spans.get(0, [])
        if not gone:
            return text
        text = without(text, w, 0, merge(gone))


def changed(part: pa.RecordBatch, new: dict[int, str]) -> pa.RecordBatch:
    """Rows with new texts (and their n_chars); those that have lost all words go."""
    names, arrays = part.schema.names, part.columns
    for name, value in (("text", lambda t: t), ("n_chars", len)):
        if name in names:
            k = names.index(name)
            values = arrays[k].to_pylist()
            for r, t in new.items():
                values[r] = value(t)
            arrays[k] = pa.array(values, part.schema.field(k).type)
    hit, left = list(new), np.ones(part.num_rows, bool)
    left[hit] = W.find(pa.array(list(new.values()), pa.string()), W.ALNUM, lower=True).counts > 0
    return pa.RecordBatch.from_arrays(arrays, schema=part.schema).filter(pa.array(left))


def remove_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the benchmark's windows; a document that loses all its words goes.

    A benchmark of one block is searched for and cut in one pass.  With more blocks,
    all are searched for in turn before anything is cut, and the documents that were
    cut go through another round, until none has a window left."""
    parts = blocks(benchmark)
    phrases, last = next(parts)
    if last:
        return remove_block(docs, phrases)
    parts, clean = chain([(phrases, last)], parts), []
    while True:
        named = docs.columns
        found = stored(search_all(docs.withColumn(PREFIX + "text", F.col("text")), parts, named).drop(PREFIX + "text"), "decon-round")
        clean.append(found.where(F.size(PREFIX + "spans") == 0).select(*named))
        hit = found.where(F.size(PREFIX + "spans") > 0)
        if hit.isEmpty():
            break
        docs, parts = stored(cut_found(hit, docs.schema), "decon-cut"), blocks(benchmark)
    out = clean[0]
    for more in clean[1:]:
        out = out.union(more)
    return out


def cut_found(hit: DataFrame, schema: T.StructType) -> DataFrame:
    """Documents without the spans that were found in them."""

    def run(batches):
        for batch in batches:
            for part in W.slices(batch, "text"):
                w = W.find(part.column("text"), W.ALNUM, lower=True)
                texts, spans = part.column("text").to_pylist(), part.column(PREFIX + "spans").to_pylist()
                new = {r: without(texts[r], w, r, [(x["first"], x["last"]) for x in s]) for r, s in enumerate(spans)}
                yield changed(part.select(schema.names), new)

    return map_batches(hit, run, schema)


def remove_block(docs: DataFrame, phrases: Phrases) -> DataFrame:
    """``remove_spans`` for the phrases of one block."""
    sent = docs.sparkSession.sparkContext.broadcast(phrases)

    def run(batches):
        for batch in batches:
            for part in W.slices(batch, "text"):
                hit = find(sent.value, part.column("text"))[1]
                if not hit:
                    yield part
                    continue
                texts = part.column("text").to_pylist()
                yield changed(part, {r: cut(texts[r], [sent.value]) for r in sorted(hit)})

    return map_batches(docs, run, docs.schema)
