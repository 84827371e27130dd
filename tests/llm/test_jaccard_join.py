import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from concord.llm import jaccard_join as J
from concord.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows):
    s = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(s[i] & s[j])
            if both and 100 * both >= 80 * len(s[i] | s[j]):
                root[find(i)] = find(j)
    group = {}
    for i, (d, _) in enumerate(rows):
        group.setdefault(find(i), []).append(d)
    low = {r: min((d for d in g if d is not None), default=None) for r, g in group.items()}
    return [(d, len(s[i]), low[find(i)]) for i, (d, _) in enumerate(rows)], find


def corpus(seed=12):
    rng = random.Random(seed)
    say = lambda n: [f"{rng.choice('abcdefgh')}{rng.randint(0, 900)}" for _ in range(n)]       # noqa: E731
    rows, passage = [], say(40)
    for _ in range(60):
        rows.append(say(rng.choice((0, 1, 2, 4, 5, 6, 9, 30, 120, 300))))
    base = say(150)
    for _ in range(90):                                        # near copies, from alike to far
        e = base[:]
        for _ in range(rng.choice((0, 1, 2, 3, 4, 6, 9, 14))):
            e[rng.randrange(len(e))] = f"n{rng.random()}"
        rows.append(e[rng.choice((0, 0, 3)):len(e) - rng.choice((0, 0, 10))])
    for _ in range(40):                                        # a passage that many share
        rows.append(say(rng.choice((3, 20, 80))) + passage + say(rng.choice((0, 20, 80))))
    for _ in range(25):                                        # chains
        e = rows[rng.randrange(len(rows))][:]
        if len(e) > 20:
            e[rng.randrange(len(e))] = f"c{rng.random()}"
        rows.append(e)
    texts = [rng.choice((" ", "\n")).join(x) for x in rows]
    out = list(enumerate(texts))
    rng.shuffle(out)
    return [*out, (3, out[3][1]), (700, out[5][1].upper()), (None, out[6][1]), (None, "lonely null one two"), (800, None), (801, " "), (5, "other text of five"), (802, "w " * 5000)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, node string").repartition(4)


order = lambda r: tuple((x is None, x or 0) for x in r)        # noqa: E731


@pytest.mark.parametrize("region,crowded", [(8_000_000, 16), (4000, 3)])
def test_classes_equal_brute_force(spark, monkeypatch, region, crowded):
    monkeypatch.setattr(J, "SPREAD", crowded + 4)
    monkeypatch.setattr(J, "REGION_SHINGLES", region)
    monkeypatch.setattr(J, "CROWDED", crowded)
    rows = corpus()
    got = [tuple(r) for r in J.classes(frame(spark, rows)).collect()]
    assert sorted(got, key=order) == sorted(brute(rows)[0], key=order)


def test_one_of_each_class_stays(spark):
    rows = corpus(13)
    want, find = brute(rows)
    df = frame(spark, rows)
    kept = J.keep_first(df)
    assert kept.columns == df.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    index = {}
    for i, r in enumerate(rows):
        index.setdefault(r, find(i))
    full = [r for r in got if shingles(r[1])]
    assert len(full) == len({find(i) for i, r in enumerate(rows) if shingles(r[1])}) == len({index[r] for r in full})
    lows = {find(i): low for i, (_, n, low) in enumerate(want) if n}
    assert all(d == lows[index[d, t]] for d, t in full)
    assert sum(not shingles(t) for _, t in got) == sum(not shingles(t) for _, t in rows)


def test_region_join_is_exact():
    rng = np.random.default_rng(14)
    for _ in range(30):
        base = rng.choice(2000, 40, replace=False)
        sets = []
        for _ in range(25):
            x = base.copy()
            k = rng.integers(0, 9)
            x[rng.choice(40, k, replace=False)] = rng.integers(2000, 2400, k)
            sets.append(np.unique(x).astype(np.uint64))
        got = J.join_region(sets)
        root = list(range(25))
        for i in range(25):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = root[i], root[j]
                    root = [min(a, b) if r in (a, b) else r for r in root]
        assert got.tolist() == root


@pytest.mark.parametrize("n,seconds", [(1000, 2), (4000, 10)])
def test_dense_regions_take_seconds(n, seconds):
    rng = np.random.default_rng(17)
    base = rng.choice(10 ** 6, 150, replace=False)
    sets = []
    for _ in range(n):
        x = base.copy()
        k = int(rng.integers(0, 38))                           # up to a quarter changed
        x[rng.choice(150, k, replace=False)] = rng.integers(10 ** 6, 10 ** 9, k)
        sets.append(np.unique(x).astype(np.uint64))
    began = time.process_time()
    got = J.join_region(sets)
    assert time.process_time() - began < seconds * 4           # BLAS may use several cores
    m = J.Members(sets)
    root = np.arange(n)
    for lo in range(0, n, 500):
        rows = np.arange(lo, min(n, lo + 500))
        for r, shared in zip(rows, m.shared(rows)):
            near = np.unique(root[J.linked(shared, m.size[r], m.size)])
            root[np.isin(root, near)] = near[0]
    assert (got == root).all()


def test_many_null_ids_take_linear_time(spark):
    rng = random.Random(18)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(5000):
        e = base[:]
        e[k % 60] = f"x{rng.randrange(400)}"
        rows.append((None, " ".join(e)))
    began = time.time()
    got = J.classes(frame(spark, rows)).collect()
    assert time.time() - began < 60
    assert len(got) == 5000 and {(r.doc_id, r.component_id) for r in got} == {(None, None)}
    assert J.keep_first(frame(spark, rows)).count() == 1


def test_split_regions_are_bounded_and_linked_pairs_meet(spark, monkeypatch):
    monkeypatch.setattr(J, "REGION_SHINGLES", 4000)
    rng = np.random.default_rng(16)
    rows, sets = [], {}
    for region in (1, 2):                                      # two oversized regions: near-copy groups that share a passage
        passage = rng.integers(0, 1 << 62, 24).tolist()
        for g in range(30):
            base = passage + rng.integers(0, 1 << 62, int(40 * 15 ** rng.random())).tolist()
            for _ in range(6):
                x = base[:]
                for at in rng.choice(len(x), int(rng.integers(0, len(x) // 30)), replace=False):
                    x[at] = int(rng.integers(0, 1 << 62))
                text = " ".join(map(str, x))
                shingle, _, node = J.sets(pa.array([text]))
                if int(node[0]) not in sets:
                    sets[int(node[0])] = shingle
                    rows.append((region, int(node[0]), len(shingle), zstandard.ZstdCompressor().compress(text.encode())))
    schema = "region long, node long, n int, packed binary"
    members = spark.createDataFrame(rows, schema)
    pairs = []
    for k, (_, a, n, _) in enumerate(rows):
        for _, b, _, _ in rows[:k]:
            both = len(np.intersect1d(sets[a], sets[b]))
            if both and 100 * both >= 80 * (n + len(sets[b]) - both):
                pairs.append((a, b))
    assert pairs

    def meet(cells):
        of = {}
        for r in cells:
            of.setdefault(r.node, set()).add(r.region)
        assert all(of[a] & of[b] for a, b in pairs)
        size = {}
        for r in cells:
            size[r.region] = size.get(r.region, 0) + r.n
        return max(size.values())

    bands = J.banded(members, J.oversized(members)).select("region", "node", "n").collect()
    assert meet(bands) < 0.6 * sum(r[2] for r in rows if r[0] == 1)
    cells = J.bounded(J.stored(members, "test-members")).collect()
    assert meet(cells) <= 4000                                 # over several rounds
    assert len({(r.region, r.node) for r in cells}) == len(cells) <= 2 * len(rows)


def test_components(spark):
    rng = random.Random(15)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7)]
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.u: r.root for r in components(spark.createDataFrame(edges, "u long, v long"), "test").collect()}
    assert got == {k: v for k, v in root.items() if k != v}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert J.classes(df).count() == 0 and J.keep_first(df).count() == 0


def test_hot_pivots_take_a_row_per_slice(spark):
    """A passage of 600 texts: its pivots meet in one place once per slice, and no shared pivot is lost."""
    rng = random.Random(21)
    passage = " ".join(f"p{k}" for k in range(30))
    rows = [(k, passage + " " + " ".join(f"u{rng.random()}" for _ in range(6))) for k in range(600)]
    docs = J.keyed(frame(spark, rows).select("doc_id", "text")).repartition(3)
    got = J.pivots(docs).collect()
    of = {}
    for r in got:
        of.setdefault(r.key if r.pivot is None else r.pivot, set()).add(r.node)
    hot = {p for p, nodes in of.items() if len(nodes) == 600}
    assert hot and all(sum(r.key == p and r.pivot is None for r in got) <= 3 for p in hot)
    least = {r.node: r.l for r in J.pivots(docs).select("node", J.least_shared(J.F.col("n")).alias("l")).distinct().collect()}
    want = {}
    for p, nodes in of.items():
        for x in nodes if len(nodes) > 1 else ():
            want.setdefault(x, set()).add(p)
    kept = {r.node: set(r.pivots) for r in J.survivors(docs).collect()}
    assert kept == {x: ps for x, ps in want.items() if len(ps) >= least[x]} and kept
