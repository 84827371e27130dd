import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from concord.llm import langid as L


def brute_model(words, order):
    """Interpolated Kneser-Ney by dictionaries: p(symbol | history)."""
    top = Counter()
    for w in words:
        s = [0] + [ord(c) for c in w] + [0]
        for i in range(1, len(s)):
            top[tuple(([0] * order + s[:i + 1])[-order:])] += 1
    levels = {order: top}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter()
        for g in levels[k + 1]:
            levels[k][g[1:]] += 1
    d = {}
    for k, c in levels.items():
        one, two = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d[k] = one / (one + 2 * two) if one else 0.5
    kids = {k: defaultdict(dict) for k in levels}
    for k, c in levels.items():
        for g, v in c.items():
            kids[k][g[:-1]][g[-1]] = v

    def p(history, x, k=order):
        if k == 0:
            return 1 / L.ALPHABET
        seen = kids[k].get(history, {})
        low = p(history[1:], x, k - 1)
        if not seen:
            return low
        total = sum(seen.values())
        return max(seen.get(x, 0) - d[k], 0) / total + d[k] * len(seen) / total * low
    return p


def test_model_equals_brute_force():
    rng = random.Random(7)
    train = {k: ["".join(rng.choices(a, k=rng.randint(1, 6))) for _ in range(300)] for k, a in (("x", "abcé"), ("y", "bcdß"))}
    counts = {}
    for name, words in train.items():
        c = Counter(words)
        codes, sizes = L.grams([w.encode() for w in c], 3)
        counts[name] = (codes, np.repeat(list(c.values()), sizes))
        u, back = np.unique(codes, axis=0, return_inverse=True)
        counts[name] = (u, np.bincount(back.ravel(), counts[name][1]).astype(int))
    model = L.train(counts, 3)
    for name, words in train.items():
        p = brute_model(words, 3)
        for w in ("abc", "é", "zzz", "bcbcbd"):
            codes, _ = L.grams([w.encode()], 3)
            want = [math.log2(p(tuple(g[:-1]), g[-1])) for g in codes.tolist()]
            assert model.log2p(codes)[:, model.languages.index(name)] == pytest.approx(want)
    total = sum(2 ** model.log2p(np.array([[97, 98, c] for c in (0, *map(ord, "abcéxyzdß"))]))[:, 0])
    assert 0.99 < total <= 1                           # code points never seen have the rest


def test_held_out_accuracy_and_odd_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, "s", 1), (5000, "", "en", "s", 1), (5001, "123 $$$ !", "en", "s", 1), (5001, "123 $$$ !", "en", "s", 1),
                                 (5002, "the " * 100_000, None, "s", 1)], docs.schema)
    docs = docs.union(odd).withColumn("lang_pred", F.lit("clash"))
    model = L.fit(docs.where(L.fold(F.col("doc_id")) != 0))
    out = L.identify(docs, model, ["doc_id", "lang", "lang_pred"]).collect()
    p = L.PREFIX
    held = [r for r in out if r.doc_id is not None and r.doc_id < 1000 and r.lang and len(model.languages) > 1]
    assert sum(r[p + "pred"] == r.lang for r in held) / len(held) > 0.95 and all(0 <= r[p + "score"] <= 1 for r in out)
    und = {r.doc_id for r in out if r[p + "pred"] == "und"}
    assert und == {None, 5000, 5001} and len(out) == docs.count()
    assert L.identify(docs, L.fit(docs.limit(0)), ["doc_id"]).where(F.col(p + "pred") != "und").count() == 0
    assert L.identify(docs.limit(0), model, ["doc_id"]).count() == 0


def test_ties_go_to_the_first_language():
    counts = {k: L.grams([b"ab", b"cd"])[0] for k in ("b", "a")}
    model = L.train({k: (np.unique(c, axis=0), np.ones(len(np.unique(c, axis=0)), int)) for k, c in counts.items()})
    assert L.predict(model, pa.array(["ab"]))[0] == ["a"]


def test_every_language_is_learned_however_few_its_texts(spark):
    rng = random.Random(30)
    rows = []
    for k in range(30):
        letters = [chr(0x4E00 + 40 * k + i) for i in range(12)]
        for _ in range(1 + k % 3):
            rows.append((" ".join("".join(rng.choices(letters, k=5)) for _ in range(40)), f"l{k:02}"))
    rows += [rows[0]] * 60 + [("123 456", "digits"), (None, "l00"), ("abc def", None)]
    learn = spark.createDataFrame(rows, "text string, lang string")
    model = L.fit(learn, budget=20_000)
    assert model.languages == [f"l{k:02}" for k in range(30)]
    own = learn.where("lang like 'l%' and text is not null")
    got = L.identify(own, model, ["lang"]).collect()
    assert all(r.lang == r[L.PREFIX + "pred"] for r in got)
