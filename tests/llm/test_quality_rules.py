import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from concord.llm import quality_rules as Q

TEXTS = [None, "", " \n\t", "one", "a b c a b c x a b c", "l1 x\nl1 x\n\n\n l1 x\nl1 x", "ü#ß <|> %% ! ABC é", "x " * 3000,
         "a b c d\x0be f", "A\r\nA\r\nB", "w" * 70_000 + " tail"]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    tri = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    n = Counter(tri)
    hit = {i + k for i, t in enumerate(tri) if n[t] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_counts_equal_brute_force():
    rng = np.random.default_rng(1)
    texts = TEXTS + [" ".join(rng.choice(["a", "b", "c\n", "d#", "é"], rng.integers(0, 60))) for _ in range(200)]
    m = Q.measure(pa.array(texts, pa.string()))
    got = list(zip(*[m[c].tolist() for c in Q.COUNTS]))
    assert got == [brute(t) for t in texts]


def test_binomial_tail_is_exact():
    import math
    for n, k, p in ((10, 2, 0.3), (200, 0, 0.01), (50, 3, 0.2)):
        want = sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))
        assert Q.binomial_tail(k, n, p) == pytest.approx(want, rel=1e-12)


def test_cutoff_respects_the_risk():
    good, bad = np.zeros(Q.BINS + 1, int), np.zeros(Q.BINS + 1, int)
    good[0], good[40], bad[120], bad[30] = 5000, 400, 300, 300
    b = Q.choose(good, bad, 0.02, 0.01)
    assert 40 < b <= 120                       # 400 of 5400 good documents would be too many
    assert Q.choose(good[:] * 0 + (np.arange(Q.BINS + 1) == 0) * 20, bad, 0.02, 0.01) == Q.BINS + 1   # too few labels
    assert Q.choose(good * 0, bad * 0, 0.02, 0.01) == Q.BINS + 1


def histograms(bins):
    out = np.zeros((len(Q.RULES), Q.BINS + 1), int)
    for r in range(len(Q.RULES)):
        np.add.at(out[r], bins[:, r], 1)
    return out


def drawn(rng, n, junk):
    """Scores of good documents (rarely high in a rule) and of bad ones (half of them high in some)."""
    bins = rng.geometric(0.25, (n, len(Q.RULES))) - 1
    high = rng.random((n, len(Q.RULES))) < (0.12 if junk else 0.004)
    return np.minimum(np.where(high, rng.integers(20, 120, bins.shape), bins), Q.BINS)


def rejected(bins, cuts):
    return (bins >= cuts).any(axis=1)


def decide(way, good, bad, alpha, delta):
    places = [np.bincount([sum(rejected(b[None], cuts)[0] for cuts in way) for b in x], minlength=Q.LEVELS + 1) for x in (good, bad)]
    b = Q.choose(*places, alpha, delta)
    return np.full(len(Q.RULES), Q.BINS + 1) if b > Q.LEVELS else way[Q.LEVELS - b]


def test_paths_are_nested_and_only_enriched_rules_cut():
    rng = np.random.default_rng(2)
    reference, bad = drawn(rng, 3000, False), drawn(rng, 300, True)
    bad[:, 5] = drawn(rng, 300, False)[:, 5] * 0           # rule 5 says nothing about bad documents
    way = Q.path(histograms(reference), histograms(bad))
    assert way.shape == (Q.LEVELS, len(Q.RULES)) and (np.diff(way, axis=0) <= 0).all()
    assert (way[:, 5] == Q.BINS + 1).all() and (way[-1, :5] <= Q.BINS).all() and way.min() >= 1
    assert (Q.path(histograms(reference[:0]), histograms(bad)) <= Q.BINS).any()


def test_false_rejections_stay_under_alpha():
    """Over many samples of labels, the true rate is over alpha in no more than delta of them; and something is certified."""
    rng = np.random.default_rng(3)
    world = drawn(rng, 20_000, False)
    alpha, delta = 0.05, 0.1
    over = certified = 0
    for _ in range(150):
        way = Q.path(histograms(drawn(rng, 400, False)), histograms(drawn(rng, 60, True)))
        cuts = decide(way, drawn(rng, 120, False), drawn(rng, 60, True), alpha, delta)
        certified += (cuts <= Q.BINS).any()
        over += rejected(world, cuts).mean() > alpha
    assert over <= 0.1 * 150 + 8 and certified > 75


def test_certified_rules_reject_end_to_end(spark):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))                                      # noqa: E731
    fine = [" ".join(word() for _ in range(90)) for _ in range(500)]
    junk = [" ".join(word() + (" ###" if k % 2 else " ") for k in range(90)) for _ in range(120)]
    rows = [(k, t, "en") for k, t in enumerate(fine + junk)] + [(5000 + k, t, "de") for k, t in enumerate(fine[:30])]
    labels = [(k, int(k < 500)) for k in range(620) if k % 3 == 0] + [(5000, 1), (5001, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    out = {r.doc_id: r for r in Q.report(docs, marks).collect()}
    p = Q.PREFIX
    bad = [out[k] for k in range(500, 620)]
    assert all(not r[p + "kept"] and "symbols" in r[p + "failed"] and not r[p + "base_failed"] for r in bad)
    assert sum(not out[k][p + "kept"] for k in range(500)) <= 0.05 * 500
    assert all(out[5000 + k][p + "kept"] for k in range(30))   # two labels certify nothing
    kept = {r.doc_id for r in Q.keep_good(docs, marks).collect()}
    assert kept == {k for k, r in out.items() if r[p + "kept"]}


def test_tables_with_odd_rows(spark):
    rows = [(1, "good words " * 40, "en", "x"), (1, "good words " * 40, "en", "x"), (None, None, None, "y"), (2, "", "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id long, quality int")
    out = Q.report(docs, labels)
    assert out.count() == 4 and out.where(Q.PREFIX + "kept").count() == 0
    fine = " ".join(f"word{i}" for i in range(80))
    more = docs.union(spark.createDataFrame([(9, fine, None, "z")], docs.schema))
    kept = Q.keep_good(more, labels)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [9]
    assert Q.keep_good(more.limit(0), labels.limit(0)).count() == 0
