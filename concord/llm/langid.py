"""Language identification by interpolated Kneser-Ney character models.

One model per language over the characters of words: a word is read with a
boundary symbol on either side, contexts do not reach over it.  Counts of the
longest n-grams come from a distributed aggregate over a sample of the distinct
learning texts of about ``FIT_BYTES`` bytes in all, shared evenly among the languages,
with one text of every language at least;
shorter n-grams get continuation counts (distinct left neighbours).  For every
order, the n-grams' hashes are one sorted array over all languages, with a
column of interpolated probabilities per language; a second sorted array has the
back-off weights of the contexts.  The arrays' size is bounded by the sample,
so they may be sent to every task.

A text's cross-entropy is the mean of -log2 p over its words' characters and
ends; the language with the lowest one is predicted.  A tenth of the sample
(but of each language's first text) is kept back to calibrate: the sharpness of the score (a softmax of negative
cross-entropies, by likelihood), and per language the cross-entropy that 99.5 %
of its texts stay below; predictions beyond it are flagged as rejected.

Only text and language are ever looked at.  Whole texts are scored; each
distinct word of a batch once.

Defined cases: null text or text without a letter is ``und`` with score 0;
equal cross-entropies go to the first language by code point; without learning
rows everything is ``und``; repeated rows are judged alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import map_batches

ORDER = 5
FIT_BYTES = 8_000_000          # of learning text, all languages together
KEPT_BACK = 10                 # one in so many sampled rows calibrates
QUANTILE = 0.995
SHARPNESS = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0)
ALPHABET = 0x110000            # the last resort spreads its mass evenly over the code points
PREFIX = "__lang_"


def grams(words: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the n-gram that ends at each predicted symbol (n x order,
    padded with 0 to the left), and the number of symbols of each word."""
    joined = "\0" + "\0".join(w.decode("utf-8", "replace") for w in words) + "\0"
    text = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    bound = np.flatnonzero(text == 0)
    place = np.arange(len(text))
    since = np.zeros(len(text), np.int64)              # symbols since the boundary before
    since[1:] = place[1:] - bound[np.searchsorted(bound, place[1:], "left") - 1]
    columns = [np.where(since >= back, text[np.maximum(place - back, 0)], 0)[1:] for back in range(order - 1, -1, -1)]
    return np.stack(columns, axis=1), np.diff(bound)


def keys(codes: np.ndarray) -> np.ndarray:
    """64-bit hashes of rows of code points."""
    h = np.full(len(codes), codes.shape[1] + 1, np.uint64)
    for c in codes.T:
        h = W.mix(h * W.M1 + c.astype(np.uint64) + np.uint64(1))
    return h


@dataclass
class Model:
    languages: list[str]
    gram_keys: list[np.ndarray]        # by order, sorted
    gram_p: list[np.ndarray]           # n x languages, NaN where the language lacks it
    context_keys: list[np.ndarray]
    context_w: list[np.ndarray]        # back-off weights, 1 where the language lacks it
    sharpness: float = 8.0
    limits: tuple = ()

    def log2p(self, codes: np.ndarray) -> np.ndarray:
        """n x languages: log2 probabilities of the last symbols of n-grams."""
        p = np.full((len(codes), len(self.languages)), 1.0 / ALPHABET)
        for k in range(1, len(self.gram_keys) + 1):
            part = codes[:, codes.shape[1] - k:]
            at, hit = _find(self.context_keys[k - 1], keys(part[:, :-1]))
            weight = np.where(hit[:, None], self.context_w[k - 1][at], 1.0)
            at, hit = _find(self.gram_keys[k - 1], keys(part))
            seen = np.where(hit[:, None], self.gram_p[k - 1][at], np.nan)
            p = np.where(np.isnan(seen), weight * p, seen)
        return np.log2(p)


def _find(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
    return at, sorted_keys[at] == wanted


def train(counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER) -> Model:
    """``counts``: by language, the longest n-grams' code points and counts."""
    languages = sorted(counts, key=lambda s: s.encode())
    per = {name: _kneser_ney(*counts[name], order) for name in languages}
    model = Model(languages, [], [], [], [])
    for k in range(order):
        for which, (out_keys, out_values, empty) in enumerate(((model.gram_keys, model.gram_p, np.nan), (model.context_keys, model.context_w, 1.0))):
            union = np.unique(np.concatenate([per[n][k][which][0] for n in languages]))
            values = np.full((len(union), len(languages)), empty)
            for j, n in enumerate(languages):
                key, value = per[n][k][which]
                values[np.searchsorted(union, key), j] = value
            out_keys.append(union)
            out_values.append(values)
    return model


def _kneser_ney(codes: np.ndarray, count: np.ndarray, order: int) -> list:
    """By order: (n-gram keys, interpolated probabilities), (context keys, back-off weights)."""
    levels: list = [None] * order
    for k in range(order, 0, -1):                      # adjusted counts, from the longest n-grams down
        levels[k - 1] = codes, count
        if k > 1:
            short = codes[:, 1:]
            _, first, back = np.unique(keys(short), return_index=True, return_inverse=True)
            codes, count = short[first], np.bincount(back)
    out: list = []
    lower_keys, lower_p = None, None
    for k, (codes, count) in enumerate(levels, 1):
        once, twice = (count == 1).sum(), (count == 2).sum()
        discount = once / (once + 2 * twice) if once else 0.5
        context, where = np.unique(keys(codes[:, :-1]), return_inverse=True)
        total, kinds = np.bincount(where, count), np.bincount(where)
        weight = discount * kinds / total
        below = 1.0 / ALPHABET if k == 1 else lower_p[np.searchsorted(lower_keys, keys(codes[:, 1:]))]
        p = (count - discount) / total[where] + weight[where] * below
        key = keys(codes)
        by = np.argsort(key)
        lower_keys, lower_p = key[by], p[by]
        out.append(((lower_keys, lower_p), (context, weight)))
    return out


def distinct_words(w: W.Words) -> tuple[list[bytes], np.ndarray]:
    """The distinct words of a slice and the one that each word is."""
    _, first, which = np.unique(w.hashes(), return_index=True, return_inverse=True)
    data = w.data.tobytes()
    return [data[a:b] for a, b in zip(w.start[first].tolist(), w.end[first].tolist())], which


def entropies(model: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows x languages: cross-entropies (NaN: nothing to read); and which rows have a letter."""
    w = W.find(column, W.SPACE, lower=True)
    n = len(w.first) - 1
    if not len(w.start):
        return np.full((n, len(model.languages)), np.nan), np.zeros(n, bool)
    words, which = distinct_words(w)
    codes, sizes = grams(words)
    _, first, back = np.unique(keys(codes), return_index=True, return_inverse=True)
    p = model.log2p(codes[first])
    edge = np.concatenate([[0], np.cumsum(sizes)])
    points, at = np.unique(codes[:, -1], return_inverse=True)
    letter = np.array([chr(c).isalpha() for c in points])[at]
    has_letter = np.add.reduceat(letter, edge[:-1]) > 0
    size = W.per_row(sizes[which], w.first)
    out = np.empty((n, len(model.languages)))
    for j in range(len(model.languages)):              # a language at a time: memory for one column of symbols
        by_word = np.add.reduceat(p[back, j], edge[:-1])
        with np.errstate(invalid="ignore"):
            out[:, j] = -W.per_row(by_word[which], w.first) / size
    return out, W.per_row(has_letter[which], w.first) > 0


def predict(model: Model, column: pa.Array) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Language, score, cross-entropy and whether it is accepted, by row."""
    n = len(column)
    if not model.languages:
        return ["und"] * n, np.zeros(n), np.full(n, np.nan), np.zeros(n, bool)
    x, ok = entropies(model, column)
    x = np.where(ok[:, None], x, np.inf)
    best = x.argmin(axis=1)
    low = x[np.arange(n), best]
    with np.errstate(invalid="ignore"):
        score = np.where(ok, 1 / np.exp(-model.sharpness * (x - low[:, None])).sum(axis=1), 0.0)
    limit = np.array(model.limits or [np.inf] * len(model.languages))[best]
    names = np.array(model.languages, object)[best]
    return np.where(ok, names, "und").tolist(), score, np.where(ok, low, np.nan), ok & (low <= limit)


def fit(learn: DataFrame, budget: int = FIT_BYTES) -> Model:
    """A model from the rows (text, lang) of ``learn``; rows without either are left out."""
    learn = learn.where("text IS NOT NULL AND lang IS NOT NULL").where(F.col("text").rlike(r"\p{L}")).select("text", "lang")
    drawn = F.pmod(F.xxhash64(F.lit(7), "text"), F.lit(1_000_000))
    sizes = {r.lang: r for r in learn.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n"), F.min(drawn).alias("least")).collect()}
    if not sizes:
        return Model([], [], [], [], [])
    # below its bound a text is drawn; the first one of a language always is, and is never kept back
    bound = F.create_map(*[F.lit(v) for name, r in sizes.items() for v in (name, max(r.least + 1.0, 1_000_000 * budget / len(sizes) / r.n))])
    least = F.create_map(*[F.lit(v) for name, r in sizes.items() for v in (name, r.least)])
    held = (F.pmod(F.xxhash64(F.lit(8), "text"), F.lit(KEPT_BACK)) == 0) & (drawn != least[F.col("lang")])
    # copies of a text count once, so they cannot fill the sample
    sample = learn.where(drawn < bound[F.col("lang")]).distinct().withColumn("held", held)
    found: dict = {}
    for r in map_batches(sample.where("NOT held").select("text", "lang"), _count, "lang string, gram binary, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow().to_batches():
        names, gram, n = r.column(0).to_pylist(), r.column(1).to_pylist(), r.column(2).to_numpy()
        for name in set(names):
            at = [i for i, x in enumerate(names) if x == name]
            found.setdefault(name, []).append((np.frombuffer(b"".join(gram[i] for i in at), "<u4").reshape(-1, ORDER), n[at]))
    if not found:
        return Model([], [], [], [], [])
    model = train({k: tuple(np.concatenate(x) for x in zip(*v)) for k, v in found.items()})
    return calibrate(model, sample.where("held").select("text", "lang"))


def _count(batches):
    for batch in (part for whole in batches for part in W.slices(whole)):
        texts, langs = batch.column(0), np.array(batch.column(1).to_pylist(), object)
        for name in sorted(set(langs)):
            w = W.find(texts.filter(pa.array(langs == name)), W.SPACE, lower=True)
            if not len(w.start):
                continue
            words, which = distinct_words(w)
            codes, sizes = grams(words)
            times = np.repeat(np.bincount(which, minlength=len(words)), sizes)
            _, first, back = np.unique(keys(codes), return_index=True, return_inverse=True)
            n = np.bincount(back, times).astype(np.int64)
            raw = np.ascontiguousarray(codes[first].astype("<u4"))
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(n), pa.string()), pa.array([r.tobytes() for r in raw], pa.binary()), pa.array(n)], names=["lang", "gram", "n"])


def calibrate(model: Model, held: DataFrame) -> Model:
    """Set the sharpness and the languages' limits by the rows kept back."""
    sent = held.sparkSession.sparkContext.broadcast(model)
    index = {name: k for k, name in enumerate(model.languages)}

    def run(batches):
        m = sent.value
        for batch in (part for whole in batches for part in W.slices(whole)):
            x, ok = entropies(m, batch.column(0))
            true = np.array([index.get(name, -1) for name in batch.column(1).to_pylist()])
            ok &= true >= 0
            x, true = x[ok], true[ok]
            own = x[np.arange(len(x)), true]
            gain = [-np.log(np.exp(-s * (x - own[:, None])).clip(0, 1e300).sum(axis=1)) for s in SHARPNESS]
            yield pa.RecordBatch.from_arrays([pa.array(true, pa.int32()), pa.array(own), *map(pa.array, gain)], names=["k", "own", *(f"s{i}" for i in range(len(gain)))])

    cols = [f"s{i}" for i in range(len(SHARPNESS))]
    rows = map_batches(held, run, "k int, own double, " + ", ".join(f"{c} double" for c in cols))
    got = rows.groupBy("k").agg(F.expr(f"percentile_approx(own, {QUANTILE}, 10000)").alias("limit"), *[F.sum(c).alias(c) for c in cols]).collect()
    if got:
        model.sharpness = max(zip(SHARPNESS, cols), key=lambda sc: sum(r[sc[1]] for r in got))[0]
        limits = {r.k: r.limit for r in got}
        model.limits = tuple(limits.get(k, np.inf) for k in range(len(model.languages)))
    return model


def identify(docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """``columns`` of docs and, under prefixed names, the prediction for text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*columns).schema.add(PREFIX + "pred", "string").add(PREFIX + "score", "double").add(PREFIX + "entropy", "double").add(PREFIX + "accepted", "boolean")
    names = [f.name for f in schema]

    def run(batches):
        for batch in batches:
            for part in W.slices(batch, PREFIX + "text"):
                pred, score, entropy, accepted = predict(sent.value, part.column(PREFIX + "text"))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(pred, pa.string()), pa.array(score), pa.array(entropy, from_pandas=True), pa.array(accepted)], names=names)

    return map_batches(docs.select(*columns, F.col("text").alias(PREFIX + "text")), run, schema)


def fold(doc_id: Column, n: int = 5) -> Column:
    """The remainder of crc32 of the id as text; 0 only for ids that are given."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(-1))
