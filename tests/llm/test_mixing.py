import random

from pyspark.sql import functions as F

from concord.llm import mixing as M


def test_pivot_keeps_the_mass_and_leaves_one_fraction():
    rng = random.Random(4)
    ups = 0.0
    for _ in range(300):
        n = rng.randint(1, 40)
        p, mass = [rng.random() for _ in range(n)], [float(rng.randint(1, 500)) for _ in range(n)]
        want = sum(a * b for a, b in zip(p, mass))
        out = M.pivot(list(p), mass, [rng.random() for _ in range(n)])
        assert sum(0 < v < 1 for v in out) <= 1 and all(0 <= v <= 1 for v in out)
        assert abs(sum(a * b for a, b in zip(out, mass)) - want) < 1e-6
        ups += out[0] - p[0]
    assert abs(ups / 300) < 0.1                # inclusion probabilities stay


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: 1 + i % 3 for i, s in enumerate(order)}
    target, full = {}, set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        free = sum(w[s] for s in sizes if s not in full)
        target = {s: 3 * sizes[s] if s in full else left * w[s] / free for s in sizes}
        more = {s for s in sizes if s not in full and target[s] > 3 * sizes[s]}
        if not more:
            return target
        full |= more


def rows(spark, n=1500):
    rng = random.Random(5)
    data = [(i, "w " * rng.choice((0, 1, 3, 20, 200)) + "x", f"s{rng.choice((0, 0, 0, 1, 2, 3))}", "extra") for i in range(n)]
    data += [(n, "tiny", "z", "e"), (n + 1, None, None, "e"), (None, "a b", None, "e"), (3, data[3][1], data[3][2], "e")]
    return spark.createDataFrame(data, "doc_id long, text string, source string, size string")


def test_mix_meets_targets_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(M, "UNITS_PER_BUCKET", 8)
    monkeypatch.setattr(M, "FAN", 4)
    docs = rows(spark)
    got = [r.asDict() for r in M.plan(docs).collect()]
    sizes, taken = {}, {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"] * r["rows"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["size"] * r["rows"] * r["copies"]
        assert 0 <= r["copies"] <= 3
    want = brute_targets(sizes)
    for r in got:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]]
    assert sum(r["rows"] for r in got) == docs.count()
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 402, s       # one unit at most: 201 words, one of them twice
    again = M.plan(docs.repartition(7)).select("doc_id", "source", "size", "copies").collect()
    assert sorted(map(str, again)) == sorted(map(str, M.plan(docs).select("doc_id", "source", "size", "copies").collect()))
    mixed = M.mix_documents(docs)
    assert mixed.columns == docs.columns
    words = mixed.withColumn("n", F.coalesce(F.regexp_count("text", F.lit(M.WORD)), F.lit(0))).groupBy("source").agg(F.sum("n").alias("n"))
    assert {r.source: r.n for r in words.collect() if r.n} == {s: n for s, n in taken.items() if n}


def test_mix_of_nothing(spark):
    empty = rows(spark, 5).limit(0)
    assert M.plan(empty).count() == 0 and M.mix_documents(empty).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert {(r.doc_id, r.target, r.copies) for r in M.plan(blank).collect()} == {(1, 0.0, 0), (2, 0.0, 0)}
