"""Repeated passages, removed by prefix-partitioned suffix trees.

A window is ``WINDOW`` consecutive words of a document.  A word goes if it lies in
a window whose word sequence also starts in a document with a smaller doc_id.

Suffixes are split into groups by prefixes of variable length: a suffix's prefix
reaches up to the end of its first anchor, the word ``ANCHOR``-gram with the
smallest hash of its window.  Equal windows have equal prefixes, and neighbouring
suffixes mostly share their anchor, so a run of suffixes travels as one piece of
words rather than one by one.

1. Anchors: each document's runs give (anchor, content hash, doc_id).  Anchors
   of a single document cannot begin a repeat and are dropped here.
2. Equal runs are one path of the tree, whatever the number of their documents:
   an aggregate leaves the smallest and the largest doc_id of each.  An anchor
   with one content only is a single path, whose windows all repeat the smallest
   document's.
3. Of the other contents, one document sends the words; they go, grouped by
   anchor into buckets of a bounded number of words, to tasks that build the
   bucket's suffix tree (as a suffix array cut at depth ``WINDOW``, whose
   stretches of common prefixes are the internal nodes).  The nodes of depth
   ``WINDOW`` with leaves of several documents are the repeats.
4. Groups of more than ``GROUP_RUNS`` contents get the longest prefix, the window
   itself: its group is a single node, and an aggregate with map-side combine
   finds the node's smallest document whatever its size.

What is found for a content (stretches of windows and the smallest document that
has them) goes back to all documents with that run, by id and print (a hash of the
text), so rows that share an id, or have none, do not meet under one key.
Words are known by 64-bit hashes.

Defined cases: null or empty text has no words; documents shorter than a window
keep everything; a null doc_id counts as larger than any other; rows with equal
doc_id never remove each other's words; empty tables give empty results.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import map_batches, stored

WINDOW = 50
ANCHOR = 8
GROUP_RUNS = 25_000            # about BUCKET_WORDS words
BUCKET_WORDS = 2_000_000
LAST = (1 << 63) - 1               # the place of a null doc_id in the order
PREFIX = "__substring_"
PRINTS = 1 << 24               # prints of texts: few bytes, many parts of one id

BASE = np.uint64(0xD1342543DE82EF95)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

RUN = "kind int, anchor long, content long, low long, high long, n int, place int, window long, words binary"
FOUND = "anchor long, content long, first int, last int, low long"


def sliding(x: np.ndarray, n: int, f) -> np.ndarray:
    """f over all windows of n values, by doubling."""
    size = 1
    while size * 2 <= n:
        x = f(x[:len(x) - size], x[size:])
        size *= 2
    return f(x[:len(x) - (n - size)], x[n - size:]) if n > size else x


class Spans:
    """Hashes of any word spans of a sequence."""

    def __init__(self, h: np.ndarray):
        one = np.ones(1, np.uint64)
        self.power = np.cumprod(np.concatenate([one, np.full(len(h), BASE)]))
        self.inverse = np.cumprod(np.concatenate([one, np.full(len(h), BASE_INVERSE)]))
        self.sum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * self.power[:-1])])

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return W.mix((self.sum[last] - self.sum[first]) * self.inverse[first])


def runs(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor places, and the first and last windows that each is the anchor of.

    Ties in a window make all smallest grams its anchors; equal windows still
    have equal anchors, and a window is in a run of each."""
    m = len(h) - WINDOW + 1
    if m <= 0:
        return (np.zeros(0, np.int64),) * 3
    gram = h[:len(h) - ANCHOR + 1].copy()
    for k in range(1, ANCHOR):
        gram = gram * W.M1 + h[k:len(h) - ANCHOR + 1 + k]
    gram = W.mix(gram) | np.uint64(1)
    span = WINDOW - ANCHOR + 1
    least = sliding(gram, span, np.minimum)                    # per window
    whole = row[:m] == row[WINDOW - 1:]
    least = np.where(whole, least, 0)
    most = sliding(np.concatenate([np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)]), span, np.maximum)
    place = np.flatnonzero(most == gram)                       # the smallest gram of some window
    # windows of an anchor are consecutive: up to the next smaller gram on either side, in its row
    first, last = _reach(gram, place, span, row)
    return place, first, last


def _reach(gram: np.ndarray, place: np.ndarray, span: int, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last windows with ``place`` as a smallest gram."""
    lo, hi = place.copy(), place.copy()                        # grams not smaller than the anchor's
    start = np.searchsorted(row, row[place], "left")
    end = np.searchsorted(row, row[place], "right") - ANCHOR   # the row's last gram
    for side, edge, step in ((lo, start, -1), (hi, end, 1)):
        left = np.arange(len(place))
        for _ in range(span - 1):
            nxt = side[left] + step
            ok = (nxt >= edge[left]) if step < 0 else (nxt <= edge[left])
            ok[ok] = gram[nxt[ok]] >= gram[place[left[ok]]]
            left = left[ok]
            if not len(left):
                break
            side[left] += step
    return lo, hi - span + 1


def words_of(part: pa.RecordBatch):
    w = W.find(part.column("text"))
    h = w.hashes()
    return w, h, w.row


def anchors(docs: DataFrame) -> DataFrame:
    """Distinct (anchor, content, id, print) of docs (id, print, text)."""

    def run(batches):
        for batch in batches:
            for part in W.slices(batch):
                w, h, row = words_of(part)
                place, first, last = runs(h, row)
                if not len(place):
                    continue
                key, content = describe(h, place, first, last)
                owner, text = (np.array(part.column(c).to_pylist(), np.int64)[row[place]] for c in ("id", "print"))
                by = np.lexsort((content, key, text, owner))
                new = np.ones(len(by), bool)
                new[1:] = np.any([x[by][1:] != x[by][:-1] for x in (owner, text, key, content)], axis=0)
                by = by[new]
                yield pa.RecordBatch.from_arrays([pa.array(x[by]) for x in (key, content, owner, text)], names=["anchor", "content", "id", "print"])

    return map_batches(docs, run, "anchor long, content long, id long, print long")


def describe(h: np.ndarray, place: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchor hashes and hashes of the runs' words."""
    s = Spans(h)
    key = s.of(place, place + ANCHOR)
    content = W.mix(s.of(first, last + WINDOW) + W.mix(((last - first) * 1000 + place - first).astype(np.uint64)))
    return key.view(np.int64), content.view(np.int64)


def contents(pairs: DataFrame) -> DataFrame:
    """(anchor, content, low, high, kind) of the runs whose anchor several documents have.

    kind 0: the anchor's only content; 1: for a tree; 2: of a group too large for a task."""
    each = pairs.groupBy("anchor", "content").agg(F.min(F.struct("id", "print")).alias("least"), F.max("id").alias("high"))
    each = each.select("anchor", "content", F.col("least.id").alias("low"), F.col("least.print").alias("low_print"), "high")
    groups = each.groupBy("anchor").agg(F.min("low").alias("lo"), F.max("high").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi")
    kind = F.when(F.col("n") == 1, 0).when(F.col("n") <= GROUP_RUNS, 1).otherwise(2)
    return each.join(groups.select("anchor", kind.alias("kind")), "anchor")


def pieces(docs: DataFrame, each: DataFrame) -> DataFrame:
    """``RUN`` rows of the contents of kind 1 (a run with its words) and 2 (each of
    its windows), sent by the smallest document that has them."""
    names = [c.split()[0] for c in RUN.split(", ")]
    types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
    asked = each.where("kind > 0").groupBy(F.col("low").alias("id"), F.col("low_print").alias("print")).agg(F.collect_list(F.struct("anchor", "content", "kind", "high")).alias("asked"))

    def run(batches):
        for batch in batches:
            for part in W.slices(batch):
                w, h, row = words_of(part)
                place, first, last = runs(h, row)
                if not len(place):
                    continue
                key, content = describe(h, place, first, last)
                s = Spans(h)
                ids, lists = part.column("id").to_pylist(), part.column("asked").to_pylist()
                edge = np.searchsorted(row[place], np.arange(part.num_rows + 1))
                rows: list[tuple] = []
                for r in range(part.num_rows):
                    left = {(m["anchor"], m["content"]): (m["kind"], m["high"]) for m in lists[r]}
                    for k in range(edge[r], edge[r + 1]):
                        name = (int(key[k]), int(content[k]))
                        if name not in left:
                            continue
                        kind, high = left.pop(name)            # a run that comes twice is sent once
                        f, n = int(first[k]), int(last[k] - first[k]) + 1
                        if kind == 1:
                            rows.append((1, *name, ids[r], high, n, 0, 0, h[f:f + n + WINDOW - 1].tobytes()))
                        else:
                            i = np.arange(f, f + n)
                            rows += [(2, *name, ids[r], high, n, d, x, None) for d, x in enumerate(s.of(i, i + WINDOW).view(np.int64).tolist())]
                for at in range(0, len(rows), 20_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at:at + 20_000]), types)], names=names)

    return map_batches(docs.join(asked.hint("shuffle_hash"), ["id", "print"]), run, RUN)


def tree(group: pa.Table) -> pa.Table:
    """``FOUND`` rows of a bucket's runs: stretches of windows that smaller documents have."""
    low_id, high_id = group.column("low").to_numpy(), group.column("high").to_numpy()
    paths = [np.frombuffer(c, np.uint64) for c in group.column("words").to_pylist()]
    size = np.array([len(p) for p in paths])
    start = np.concatenate([[0], np.cumsum(size)])
    text = np.concatenate(paths)
    left = np.repeat(start[1:], size) - np.arange(len(text))   # words up to the path's end
    suffix = np.flatnonzero(left >= WINDOW)                    # the windows
    _, rank = np.unique(text, return_inverse=True)
    depth = 1
    while depth < WINDOW:                                      # ranks of prefixes of twice the depth
        step = min(depth, WINDOW - depth)
        second = np.zeros(len(text), np.int64)
        second[:-step] = rank[step:] + 1
        key = rank * (len(text) + 1) + second
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank = np.empty(len(text), np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]).astype(np.int64)]))
        depth += step
    node, of = np.unique(rank[suffix], return_inverse=True)    # nodes of depth WINDOW
    low = np.full(len(node), LAST)
    np.minimum.at(low, of, np.repeat(low_id, size)[suffix])
    low = low[of]                                              # the smallest document with each window
    edge = np.concatenate([[0], np.cumsum(size - WINDOW + 1)])
    # stretches of windows with the same smallest document, if a document of the run is larger
    new = np.ones(len(low), bool)
    new[1:] = low[1:] != low[:-1]
    new[edge[:-1]] = True
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(low))
    r = np.searchsorted(edge, first, "right") - 1
    use = low[first] < high_id[r]
    first, last, r = first[use], last[use], r[use]
    take = pa.array(r)
    return pa.table({"anchor": group.column("anchor").take(take), "content": group.column("content").take(take), "first": pa.array(first - edge[r], pa.int32()),
                     "last": pa.array(last - edge[r], pa.int32()), "low": pa.array(low[first], pa.int64())})


def repeats(docs: DataFrame) -> DataFrame:
    """(id, print, marks array<struct<anchor, content, first, last>>): for documents of docs
    (id, print, text), the stretches of their runs' windows that smaller documents have."""
    pairs = stored(anchors(docs), "substring-anchors")
    each = stored(contents(pairs), "substring-contents")
    sent = stored(pieces(docs, each), "substring-pieces")
    total = sent.where("kind = 1").agg(F.sum(F.col("n") + WINDOW - 1)).first()[0] or 0
    buckets = max(1, math.ceil(total / BUCKET_WORDS))
    trees = sent.where("kind = 1").withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets))).groupBy("bucket").applyInArrow(tree, FOUND)
    # one path: all windows; its runs are cut to their length where they are marked
    single = each.where("kind = 0").select("anchor", "content", F.lit(0).alias("first"), F.lit(WINDOW).alias("last"), "low")
    wide = sent.where("kind = 2")
    least = wide.groupBy("window").agg(F.min("low").alias("least"))
    wide = wide.join(least, "window").where("least < high").select("anchor", "content", F.col("place").alias("first"), (F.col("place") + 1).alias("last"), F.col("least").alias("low"))
    found = trees.union(single).union(wide)
    marked = pairs.join(found, ["anchor", "content"]).where("low < id")
    return marked.groupBy("id", "print").agg(F.collect_list(F.struct("anchor", "content", "first", "last")).alias("marks"))


def removed(h: np.ndarray, row: np.ndarray, marks: list, rows: int) -> np.ndarray:
    """Which words of a slice's rows the rows' marks remove."""
    step = np.zeros(len(h) + 1, np.int64)
    place, first, last = runs(h, row)
    if len(place) and any(marks):
        key, content = describe(h, place, first, last)
        edge = np.searchsorted(row[place], np.arange(rows + 1))
        for r in range(rows):
            by_run: dict[tuple, list] = {}
            for m in marks[r] or ():
                by_run.setdefault((m["anchor"], m["content"]), []).append((m["first"], m["last"]))
            if by_run:
                for k in range(edge[r], edge[r + 1]):
                    for a, b in by_run.get((int(key[k]), int(content[k])), ()):
                        step[first[k] + a] += 1
                        step[min(first[k] + b, last[k] + 1) + WINDOW - 1] -= 1
    return np.cumsum(step)[:-1] > 0


def deduplicate(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of docs with n_words, n_removed and the kept words (joined by spaces) under prefixed names."""
    keyed = docs.withColumns({PREFIX + "id": F.coalesce(F.col("doc_id"), F.lit(LAST)), PREFIX + "print": F.pmod(F.xxhash64("text"), F.lit(PRINTS))})
    marks = repeats(keyed.select(F.col(PREFIX + "id").alias("id"), F.col(PREFIX + "print").alias("print"), "text"))
    marks = marks.select(*[F.col(c).alias(PREFIX + c) for c in ("id", "print", "marks")])
    joined = keyed.join(marks.hint("shuffle_hash"), [PREFIX + "id", PREFIX + "print"], "left").select(*columns, F.col("text").alias(PREFIX + "text"), PREFIX + "marks")
    schema = docs.select(*columns).schema.add(PREFIX + "n_words", "long").add(PREFIX + "n_removed", "long").add(PREFIX + "kept", "string")
    names = [f.name for f in schema]

    def run(batches):
        for batch in batches:
            for part in W.slices(batch, PREFIX + "text"):
                w = W.find(part.column(PREFIX + "text"))
                keep = ~removed(w.hashes(), w.row, part.column(PREFIX + "marks").to_pylist(), part.num_rows)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(w.counts, pa.int64()), pa.array(w.counts - W.per_row(keep, w.first), pa.int64()),
                                                  joined_words(w, keep)], names=names)

    return map_batches(joined, run, schema)


def joined_words(w: W.Words, keep: np.ndarray) -> pa.Array:
    """Rows' kept words, joined by one space."""
    data = w.data.tobytes()
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        k = a + np.flatnonzero(keep[a:b])
        out.append(b" ".join([data[s:e] for s, e in zip(w.start[k].tolist(), w.end[k].tolist())]).decode())
    return pa.array(out, pa.string())
