"""Quality rules with risk-controlled thresholds.

Every document gets counts and, from them, one badness score per rule.  All
rules together get cutoffs per stratum (language) from labelled documents, so
that they provably reject few good ones:

* The scores are cut into ``BINS`` fixed steps.  A stratum's *path* is a sequence of
  ``LEVELS`` joint cutoffs, mild to harsh and nested: at each level every rule cuts
  the same tail off the stratum's unlabelled documents, if the bad labelled ones are
  ``ENRICHED`` times as frequent there (else it stays where it was).  The path is
  made without the good labelled documents, so it is fixed before they are looked at.
* Levels are tested from the mildest to the harshest (fixed-sequence testing): a
  level passes if the exact binomial tail P(X <= k) for X ~ Bin(n, alpha) is
  at most delta / strata, where any rule would reject k of the n good labelled
  documents: the upper Clopper-Pearson bound of the joint false-rejection rate is
  then below alpha.  The first failure ends the sequence, so only the strata
  need the Bonferroni correction; with four strata, 86 good labels without a loss suffice.
* Among the certified levels, the one with the largest
  bad share - ``GOOD_COST`` * good share is used, if it is positive.

With probability 1 - delta, every stratum's good documents are rejected at a
rate of at most alpha by all rules together.  Strata without enough labels get
no cutoff and lose no document to the rules.  What tasks take are histograms of
fixed size: (stratum, rule, bin) for the paths, (stratum, level) for the tests.

Defined cases: null text has no words (all counts 0, base_failed); a null
language is a stratum of its own; a document with several labels is good only
if all of them are 1; null labels and labels of unknown documents do not count;
repeated documents are judged alike; tables may be empty.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .common import map_batches, stored

ALPHA = 0.05                   # good documents that a stratum may lose
DELTA = 0.05                   # probability that any stratum loses more
BINS = 200                     # steps of a score
GOOD_COST = 5.0                # what a rejected good share costs against a rejected bad one
LEVELS = 32                    # joint cutoffs of a path
MILDEST, HARSHER = 0.0005, 1.25        # the first tail, and the factor from one to the next
ENRICHED = 2.0                 # bad documents in a tail against unlabelled ones
MIN_WORDS = 50
RULES = ("symbols", "dup_lines", "repeats", "capitals", "shouting", "long_words")

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
PREFIX = "__quality_"          # names of columns added on the way
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """Counts and rule bins of a text column's rows."""
    w = W.find(column)
    n, row = len(w.first) - 1, w.row
    lead = (w.data & 0xC0) != 0x80                     # first bytes of code points
    at = np.concatenate([[0], np.cumsum(lead & W.SPACE[w.data])])

    def by_row(flags):
        return W.per_row(flags, w.off)

    chars = at[w.off[1:]] - at[w.off[:-1]]
    # lines: bounds are the rows' and the line feeds'
    feeds = np.flatnonzero(w.data == 0x0A)
    line_start = np.sort(np.concatenate([w.off[:-1], feeds + 1]))
    line_end = np.sort(np.concatenate([w.off[1:], feeds]))
    keep = at[line_end] > at[line_start]
    line_row = _rows_of_lines(w.off, feeds)[keep]
    line_hash = W.hash_spans(w.data, line_start[keep], line_end[keep])
    n_lines = np.bincount(line_row, minlength=n)
    dup_lines = n_lines - _distinct(line_row, line_hash, n)
    # words in 3-word windows that come twice in their text
    h3, first = W.windows(w.hashes(), row, 3)
    r3 = row[first]
    by = np.lexsort((h3, r3))
    same = (h3[by][1:] == h3[by][:-1]) & (r3[by][1:] == r3[by][:-1])
    twice = np.zeros(len(h3), bool)
    twice[by[1:][same]] = True
    twice[by[:-1][same]] = True
    repeat = W.per_row(W.covered(len(row), first[twice], 3), w.first)
    n_words = w.counts
    symbols = by_row(SYMBOL[w.data])
    capitals = by_row((w.data >= 0x41) & (w.data <= 0x5A))
    bangs = by_row(w.data == 0x21)
    some, some_chars = np.maximum(n_words, 1), np.maximum(chars, 1)
    scores = (symbols / some / 2, dup_lines / np.maximum(n_lines, 1), repeat / some, capitals / some_chars,
              bangs / some / 2, chars / some / 40)
    bins = np.stack([np.minimum(np.floor(np.clip(s, 0, 1) * BINS), BINS).astype(np.int32) for s in scores], axis=1)
    return {"n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines,
            "n_repeat_words": repeat, "bins": bins}


def _rows_of_lines(off: np.ndarray, feeds: np.ndarray) -> np.ndarray:
    """The row of each line, lines in order of (row, place)."""
    per_row = np.searchsorted(feeds, off[1:]) - np.searchsorted(feeds, off[:-1]) + 1
    return np.repeat(np.arange(len(per_row)), per_row)


def _distinct(row: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    by = np.lexsort((h, row))
    new = np.ones(len(by), bool)
    new[1:] = (h[by][1:] != h[by][:-1]) | (row[by][1:] != row[by][:-1])
    return np.bincount(row[by][new], minlength=n)


def with_counts(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of docs, the counts and the rules' bins under prefixed names."""
    schema = docs.select(*columns).schema
    for c in COUNTS:
        schema = schema.add(PREFIX + c, T.LongType())
    schema = schema.add(PREFIX + "bins", T.ArrayType(T.IntegerType()))
    names = [f.name for f in schema]

    def run(batches):
        for batch in batches:
            for part in W.slices(batch, PREFIX + "text"):
                m = measure(part.column(PREFIX + "text"))
                bins = m["bins"]
                arrays = [part.column(c) for c in columns] + [pa.array(m[c], pa.int64()) for c in COUNTS]
                arrays.append(pa.ListArray.from_arrays(np.arange(len(bins) + 1, dtype=np.int32) * len(RULES), bins.ravel()))
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return map_batches(docs.select(*columns, F.col("text").alias(PREFIX + "text")), run, schema)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Bin(n, p), summed from the largest term down."""
    if k >= n:
        return 1.0
    if k > n * p:                                      # above the mean: nothing to certify
        return 1.0
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    total, j = term, k
    while j > 0 and term > total * 1e-17:
        term *= j * (1 - p) / ((n - j + 1) * p)
        total += term
        j -= 1
    return min(total, 1.0)


def choose(good: np.ndarray, bad: np.ndarray, alpha: float, delta: float) -> int:
    """The best certified cutoff for counts by place, 0 kept by all: the places from the
    last one down are cut off in turn (one past the last: no cutoff)."""
    n_good, n_bad, none = int(good.sum()), int(bad.sum()), len(good)
    if not n_good or not n_bad:
        return none
    best, value = none, 0.0
    lost, caught = 0, 0
    for b in range(none - 1, 0, -1):
        lost, caught = lost + int(good[b]), caught + int(bad[b])
        if binomial_tail(lost, n_good, alpha) > delta:
            break
        gain = caught / n_bad - GOOD_COST * lost / n_good
        if gain > value:
            best, value = b, gain
    return best


def path(reference: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Joint cutoffs (levels x rules) from histograms (rules x bins) of reference and bad documents."""
    every = not reference.sum()                                # all documents are labelled: the tails are those of the bad ones
    reference = bad if every else reference
    out = np.full((LEVELS, len(reference)), BINS + 1, np.int64)
    for r, (own, wrong) in enumerate(zip(reference, bad)):
        tail, caught = (np.append(h[::-1].cumsum()[::-1] / max(1, h.sum()), 0.0) for h in (own, wrong))
        now = BINS + 1
        for t in range(LEVELS):
            cut = max(1, int(np.argmax(tail <= MILDEST * HARSHER ** t)))
            if caught[cut] > 0 and (every or caught[cut] >= ENRICHED * tail[cut]):
                now = min(now, cut)
            out[t, r] = now
    return out


def paths(scored: DataFrame) -> DataFrame:
    """(lang, path array<array<int>>) of scored (lang, bins, good: null where there is no label)."""
    import pandas as pd

    hist = scored.select("lang", "good", F.posexplode("bins").alias("rule", "bin")).groupBy("lang", "rule", "bin").agg(
        F.count_if(F.col("good").isNull()).alias("reference"), F.count_if(~F.col("good")).alias("bad"), F.count_if("good").alias("good"))

    def per_stratum(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros((2, len(RULES), BINS + 1), np.int64)
        for k, c in enumerate(("reference", "bad")):
            np.add.at(counts[k], (pdf["rule"].to_numpy(), pdf["bin"].to_numpy()), pdf[c].to_numpy())
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "path": [path(*counts).tolist()]})

    # strata without labels on both sides certify nothing
    known = hist.groupBy("lang").agg(F.sum("good").alias("g"), F.sum("bad").alias("b")).where("g > 0 and b > 0").select(F.col("lang").alias("__lang"))
    hist = hist.join(known, F.col("lang").eqNullSafe(F.col("__lang"))).drop("__lang", "good")
    return hist.groupBy("lang").applyInPandas(per_stratum, "lang string, path array<array<int>>")


def cutoffs(scored: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per stratum: (lang, cuts array<int> in the order of ``RULES``).

    ``scored``: lang, bins, good boolean (null: no label), one row per document."""
    import pandas as pd

    ways = stored(paths(scored), "quality-paths")
    strata = max(1, ways.count())
    known = scored.where(F.col("good").isNotNull())
    both = known.join(ways.select(F.col("lang").alias("__lang"), "path"), F.col("lang").eqNullSafe(F.col("__lang")))
    rejects = lambda cut: F.exists(F.zip_with(cut, "bins", lambda c, b: b >= c), lambda x: x)              # noqa: E731
    # nested levels: those that reject a document are the last ones
    place = F.size(F.filter("path", rejects))
    counts = both.select("lang", "good", place.alias("place")).groupBy("lang", "place").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    counts = counts.join(ways.select(F.col("lang").alias("__lang"), "path"), F.col("lang").eqNullSafe(F.col("__lang"))).drop("__lang")

    def per_stratum(pdf: pd.DataFrame) -> pd.DataFrame:
        good, bad = np.zeros(LEVELS + 1, np.int64), np.zeros(LEVELS + 1, np.int64)
        good[pdf["place"]], bad[pdf["place"]] = pdf["good"], pdf["bad"]
        b = choose(good, bad, alpha, delta / strata)
        cuts = [BINS + 1] * len(RULES) if b > LEVELS else [int(c) for c in pdf["path"].iloc[0][LEVELS - b]]
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "cuts": [cuts]})

    return counts.groupBy("lang").applyInPandas(per_stratum, "lang string, cuts array<int>")


def label_cutoffs(counted: DataFrame, labels: DataFrame) -> DataFrame:
    """The cutoffs that the labelled documents of ``counted`` (doc_id, lang, counts, bins) certify."""
    marks = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    # one row of a repeated document stands for all: the histograms count documents
    one = counted.where(F.col(PREFIX + "n_words") > 0).groupBy("doc_id", "lang").agg(F.min(PREFIX + "bins").alias("bins"))
    return cutoffs(stored(one.join(marks, "doc_id", "left").select("lang", "bins", "good"), "quality-scored"))


def judged(counted: DataFrame, cuts: DataFrame) -> DataFrame:
    """``counted`` plus base_failed, the failed rules and kept, under prefixed names."""
    cuts = cuts.select(F.col("lang").alias(PREFIX + "lang"), F.col("cuts").alias(PREFIX + "cuts"))
    out = counted.join(cuts, counted["lang"].eqNullSafe(cuts[PREFIX + "lang"]), "left")
    n, bins, cut = F.col(PREFIX + "n_words"), F.col(PREFIX + "bins"), F.col(PREFIX + "cuts")
    failed = F.array_compact(F.array(*[F.when(bins[i] >= cut[i], F.lit(r)) for i, r in enumerate(RULES)]))
    return out.withColumns({
        PREFIX + "base_failed": (n < MIN_WORDS) | (100 * F.col(PREFIX + "n_repeat_words") > 50 * n),
        PREFIX + "failed": failed,
    }).withColumn(PREFIX + "kept", ~F.col(PREFIX + "base_failed") & (F.size(PREFIX + "failed") == 0)).drop(PREFIX + "lang", PREFIX + "cuts")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts and verdict of every document (no texts)."""
    counted = stored(with_counts(docs, ["doc_id", "lang"]), "quality-counts")
    return judged(counted, label_cutoffs(counted, labels))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their columns.

    Texts are not shuffled: the labelled documents' counts give the cutoffs,
    then each row is measured, judged and kept or dropped where it lies."""
    cuts = stored(label_cutoffs(with_counts(docs, ["doc_id", "lang"]), labels), "quality-cutoffs")
    return judged(with_counts(docs, docs.columns), cuts).where(PREFIX + "kept").select(*docs.columns)
