import random
import re

import numpy as np
import pytest

from concord.llm import substring_dedup as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    order = lambda i: (i is None, i or 0)                      # noqa: E731
    low = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - S.WINDOW + 1):
            x = tuple(w[k:k + S.WINDOW])
            low[x] = min(low.get(x, (True, 1)), order(i))
    out = []
    for i, t in rows:
        w, gone = WORD.findall(t or ""), set()
        for k in range(len(w) - S.WINDOW + 1):
            if low[tuple(w[k:k + S.WINDOW])] < order(i):
                gone |= set(range(k, k + S.WINDOW))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=lambda r: (order(r[0]), r[1:]))


def corpus():
    rng = random.Random(10)
    say = lambda n: [f"{rng.choice('abcdefgh')}{rng.randint(0, 400)}" for _ in range(n)]       # noqa: E731
    shared = [say(n) for n in (49, 50, 51, 70, 200)]
    rows = []
    for i in range(140):
        t = say(rng.randint(0, 90))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            a = rng.randint(0, 6)
            t += p[a:len(p) - rng.randint(0, 6)] + say(rng.randint(0, 30))
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(t)))
    rows += [(i + 200, rows[i][1]) for i in range(0, 40, 3)]                       # copies
    rows += [(3, rows[3][1]), (3, rows[7][1]), (None, rows[5][1]), (None, rows[5][1]), (500, None), (501, ""), (502, "x " * 300), (503, "x " * 120), (1, "x " * 60)]
    edited = rows[20][1].split()
    for i in range(30):
        e = edited[:]
        if e:
            e[rng.randrange(len(e))] = f"new{i}"
        rows.append((600 + i, " ".join(e)))
    return rows


def test_runs_cover_every_window():
    rng = np.random.default_rng(11)
    row = np.repeat(np.arange(9), [0, 10, 49, 50, 51, 90, 300, 1, 400])
    h = rng.integers(0, 3, len(row)).astype(np.uint64) + np.uint64(5)
    place, first, last = S.runs(h, row)
    seen = set()
    for p, a, b in zip(place, first, last):
        assert (row[a] == row[b + S.WINDOW - 1]) and a <= p <= b + S.WINDOW - S.ANCHOR and p - a < S.WINDOW
        seen |= set(range(a, b + 1))
    assert seen == {i for i in range(len(row) - S.WINDOW + 1) if row[i] == row[i + S.WINDOW - 1]}


@pytest.mark.parametrize("group_runs", [4096, 3])
def test_removal_equals_brute_force(spark, monkeypatch, group_runs):
    monkeypatch.setattr(S, "GROUP_RUNS", group_runs)
    monkeypatch.setattr(S, "BUCKET_WORDS", 3000)
    rows = corpus()
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, id string").repartition(4)
    p = S.PREFIX
    got = [(r.doc_id, r[p + "n_words"], r[p + "n_removed"], r[p + "kept"]) for r in S.deduplicate(df, ["doc_id", "id"]).collect()]
    assert sorted(got, key=lambda r: (r[0] is None, r[0] or 0, r[1:])) == brute(rows)
    assert sum(r[2] for r in got) > 1000


def test_many_null_ids(spark):
    """Rows without an id, or with one id, do not share their marks: five times the rows, not 25 times the work."""
    rng = random.Random(12)
    passage = " ".join(f"p{rng.randint(0, 900)}" for _ in range(60))
    rows = [(1, passage)] + [(None if k % 2 else 7, f"{passage if k % 3 else ''} {' '.join(f'w{rng.randint(0, 9000)}' for _ in range(20))}") for k in range(5000)]
    df, p = spark.createDataFrame(rows, "doc_id long, text string").repartition(4), S.PREFIX
    marks = S.repeats(df.selectExpr(f"coalesce(doc_id, {S.LAST}) AS id", f"pmod(xxhash64(text), {S.PRINTS}) AS print", "text"))
    assert marks.selectExpr("max(size(marks))").first()[0] <= 8
    got = [(r.doc_id, r[p + "n_words"], r[p + "n_removed"], r[p + "kept"]) for r in S.deduplicate(df, ["doc_id"]).collect()]
    assert sorted(got, key=lambda r: (r[0] is None, r[0] or 0, r[1:])) == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.deduplicate(df, ["doc_id"]).count() == 0
