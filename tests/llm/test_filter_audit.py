import random
import re
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from concord.llm import filter_audit as A
from concord.llm import queries

DOCS = "doc_id long, text string, lang string, mask int, good string, print int"


def failing(rows):
    """Letters that each row (doc_id, text, lang) fails."""
    out = []
    for i, text, _ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = set()
        if len(w) < 200:
            bad.add("A")
        if 100 * len(set(w)) < 50 * len(w):
            bad.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t):
            bad.add("C")
        if re.search(r"[#$%&*|]", t):
            bad.add("D")
        if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows):
            bad.add("E")
        out.append(bad)
    return out


def brute(rows, labels):
    fails, out = failing(rows), {}
    good, toxic = ({i for i, q, t in labels if (q, t)[k] == 1 and i is not None} for k in (0, 1))
    for part in {lang or "" for *_, lang in rows}:
        mine = [(r[0], f) for r, f in zip(rows, fails) if (r[2] or "") == part]
        for order in permutations("ABCDE"):
            left = mine
            for s, letter in enumerate(order, 1):
                gone = [x for x in left if letter in x[1]]
                left = [x for x in left if letter not in x[1]]
                earlier = [x for x in mine if letter in x[1] and x[1] & set(order[:s - 1])]
                out[part, "".join(order), s] = [len(left), len(gone), len(earlier), sum(x[1] == {letter} for x in mine),
                                                sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for letter in "ABCDE":
            mine_too = [k for k in out if k[0] == part and k[1][k[2] - 1] == letter]
            total = sum(out[k][1] for k in mine_too)
            for k in mine_too:
                out[k].append(total)
    return out


def collected(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


def test_every_order_against_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", " \t\n", "short", "A B", "words " * 300, " ".join(f"w{k}" for k in range(250)), " ".join(f"É{k}" for k in range(200)),
             "x | y", "ABC " * 100 + "$", " ".join(f"v{k}" for k in range(199)), "café " * 260 + "#", "é\x0bé\x0cé\re" * 100, "\U0001f600 " * 210]
    rows = [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice(["en", "de", None, ""])) for _ in range(150)]
    labels = [(rng.choice([None, *range(70)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(90)]
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], DOCS).repartition(7)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("other"))
    assert collected(A.report(docs, marks)) == brute(rows, labels)


def test_long_texts_one_hot_part_and_many_parts(spark):
    long = " ".join(f"word{k}" for k in range(200_000)) + " *"
    rows = [(k, long, "en") for k in range(3)] + [(k, "same text", "en") for k in range(10, 300)] + [(k, f"t {k}", f"l{k}") for k in range(1000, 1700)]
    got = A.report(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    got = {(r.part, r.filter_order, r.step): r for r in got.collect()}
    assert len(got) == 701 * 600
    first = got["en", "EADBC", 1]
    assert (first.removed, first.kept, first.unique_fails, first.redundant) == (2 + 289, 2, 0, 0)
    assert got["l1000", "ABCDE", 1].removed == 1 and got["l1000", "BACDE", 1].kept == 1


def test_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.report(spark.createDataFrame([], DOCS), labels).collect() == []


def test_fields_do_not_overflow():
    wide = A.packed_outcomes()
    big = (1 << 62) // 32
    counters = A.unpacked(A.to_bytes(sum(big * w for w in wide)))
    assert len(counters) == A.FIELDS and counters[A.DOCUMENTS] == 32 * big and counters.min() >= 0
    assert (counters[:A.FAILS].reshape(-1, 5) == np.array([16, 8, 4, 2, 1]) * big).all()
    assert (counters[A.FAILS:A.ALONE] == 16 * big).all() and (counters[A.ALONE:A.DOCUMENTS] == big).all()


def test_query_has_all_parts(spark):
    got = queries.QUERIES["op12_filter_audit"](spark, "/root/testdata/sf0.001")
    assert got.count() == got.select("part").distinct().count() * 600
