import re

import numpy as np
import pyarrow as pa

from concord.llm import decontaminate as D
from concord.llm.fm_index import FMIndex

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(texts, items):
    phrases = {}
    for name, t in items:
        w = words(t)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            phrases.setdefault(tuple(w[i:i + n]), set()).add(name)
    out = []
    for t in texts:
        w, hit, named = words(t), set(), set()
        for p, names in phrases.items():
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i:i + len(p)]) == p:
                    hit |= set(range(i, i + len(p)))
                    named |= names
        out.append((len(w), len(hit), sorted(named)))
    return out


def test_fm_index_finds_all_occurrences():
    rng = np.random.default_rng(2)
    t = np.append(rng.integers(1, 5, 400), 0)
    index = FMIndex(t)
    for size in (1, 2, 5):
        p = rng.integers(1, 5, (30, size))
        for q, a, b in zip(p, *index.search(p)):
            want = [i for i in range(len(t) - size) if (t[i:i + size] == q).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_spans_equal_brute_force():
    rng = np.random.default_rng(3)
    v = ["a", "B", "c-d", "é", "X1"]
    say = lambda n: " ".join(rng.choice(v, n))                 # noqa: E731
    items = [("1", say(14)), ("10", say(11)), ("2", say(3)), ("null", "solo"), ("3", ""), ("4", say(14)), ("1", say(12))]
    texts = [None, "", "...", "solo", "x solo. SOLO"] + [say(int(n)) for n in rng.integers(0, 40, 80)]
    texts += [f"{say(4)} {items[0][1].upper()}! {say(5)}", items[1][1] * 1, "q " * 3000 + items[5][1]]
    phrases = D.Phrases(items)
    w, spans, named = D.find(phrases, pa.array(texts, pa.string()))
    got = [(int(n), sum(b - a for a, b in spans.get(r, [])), sorted(named.get(r, ()))) for r, n in enumerate(w.counts)]
    assert got == brute(texts, items)
    for t in texts:
        if t is not None:
            assert brute([D.cut(t, [phrases])], items)[0][1] == 0
    assert D.find(D.Phrases([]), pa.array(["a b"]))[1] == {}


def test_frames(spark):
    text = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, f"Before it. {text.upper()} and after", "s", 5), (1, text, None, 7), (None, None, "s", 0), (3, "clean words", "s", None)],
                                 "doc_id long, text string, spans string, n_chars long")
    bench = spark.createDataFrame([(7, text), (7, text), (None, "zz"), (8, None)], "item_id long, text string")
    m = {(r.doc_id, r[D.PREFIX + "n_words"], tuple(r[D.PREFIX + "items"])) for r in D.mark(docs, bench, ["doc_id"]).collect()}
    assert m == {(1, 15, ("7",)), (1, 11, ("7",)), (None, 0, ()), (3, 2, ())}
    kept = {(r.doc_id, r.text, r.spans, r.n_chars) for r in D.remove_spans(docs, bench).collect()}
    assert kept == {(1, "Before it. and after", "s", 20), (None, None, "s", 0), (3, "clean words", "s", None)}
    assert D.remove_spans(docs.limit(0), bench).count() == 0 and D.remove_spans(docs, bench.limit(0)).count() == 4


def test_blocks_one_at_a_time(spark, monkeypatch):
    """A benchmark of several blocks gives the spans, items and texts of a single one."""
    rng = np.random.default_rng(4)
    v = ["a", "B", "c-d", "é", "X1", "two"]
    say = lambda n: " ".join(rng.choice(v, n))                 # noqa: E731
    items = [(k, say(int(n))) for k, n in enumerate(rng.integers(1, 16, 40))] + [(None, "solo"), (50, None), (3, say(12))]
    long_ = [t for _, t in items if t and len(words(t)) > 9]
    rows = [(k, f"{say(int(n))} {rng.choice(long_)} {say(2)}", 1) for k, n in enumerate(rng.integers(0, 30, 40))] + [(None, None, None), (7, "", 0), (8, "SOLO", 4), (9, "quite clean", 11)]
    # what is left of this after a cut is a window again
    w = words(long_[0])
    rows.append((99, " ".join(["x1x", *w[:5], *words(long_[1]), *w[5:], "y1y"]), 5))
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    key = lambda r: (r[0] is None, r[0] or 0, str(r[1:]))      # noqa: E731
    marked = lambda: sorted(map(tuple, D.mark(docs, bench, ["doc_id"]).collect()), key=key)       # noqa: E731
    kept = lambda: sorted(map(tuple, D.remove_spans(docs, bench).collect()), key=key)             # noqa: E731
    one = marked(), kept()
    monkeypatch.setattr(D, "BLOCK_BYTES", 800)
    parts = list(D.blocks(bench))
    assert len(parts) >= 3 and [last for _, last in parts] == [False] * (len(parts) - 1) + [True]
    assert (marked(), kept()) == one
    named = [(str(i) if i is not None else "null", t) for i, t in items if t is not None]
    assert sorted((n, sum(x["last"] - x["first"] for x in s), sorted(i)) for _, n, s, i in one[0]) == sorted(brute([t for _, t, _ in rows], named))
