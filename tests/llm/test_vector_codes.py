import hashlib
import math
import random

import numpy as np
import pytest

from concord.llm import queries, vector_codes
from concord.llm.vector_codes import Codebooks, compress, nearest, with_label_error

SCHEMA = "vec_id long, embedding array<float>, label int, code string, __code_id int"


def brute(rows, parts=16, entries=64, rounds=2):
    """The contract, row by row: {vec_id: (code, error)} and the codebooks' digest."""
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ints = [[math.floor(256 * float(np.float32(x))) for x in r[1]] for r in kept]
    d = len(ints[0]) // parts
    cut = [[v[p * d:(p + 1) * d] for p in range(parts)] for v in ints]
    books = [[list(v[p]) for v in cut[:entries]] for p in range(parts)]

    def assign(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for v in cut:
                groups.setdefault(assign(v[p], books[p])[1], []).append(v[p])
            for i, g in groups.items():
                books[p][i] = [sum(c) // len(g) for c in zip(*g)]
    out = {}
    for r, v in zip(kept, cut):
        got = [assign(v[p], books[p]) for p in range(parts)]
        out[r[0]] = ("".join(f"{i:02x}" for _, i in got), sum(e for e, _ in got))
    return out, hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


def test_search_is_exact_and_prunes():
    rng = np.random.default_rng(3)
    for d, spread in ((1, 5), (4, 3), (4, 400), (8, 60)):      # small spreads make many ties
        book, values = rng.integers(-spread, spread, (64, d)), rng.integers(-spread, spread, (500, d))
        index, far, compared = nearest(values, book)
        all_far = ((values[:, None] - book[None]) ** 2).sum(2)
        assert (index == all_far.argmin(1)).all() and (far == all_far.min(1)).all()
        assert compared.max() <= 64
    assert compared.mean() < 64
    index, far, compared = nearest(np.array([[5, 5]]), np.tile([[5, 5]], (10, 1)))     # equal entries: the first
    assert index[0] == 0 and far[0] == 0 and compared[0] == 10


def test_equals_the_contract(spark):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-0.5, 0.5) for _ in range(32)], rng.choice([1, 2, None]), "x", 7) for i in rng.sample(range(10_000), 300)]
    rows += [(20_000, None, 1, "x", 7), (20_001, [0.1] * 31 + [None], 1, "x", 7), (20_002, [0.1] * 31 + [float("nan")], 1, "x", 7),
             (20_003, [float("-inf")] + [0.1] * 31, 1, "x", 7), (20_004, [], 1, "x", 7), (-5, [0.5, 0.25] * 8, None, "x", 7)]
    same = [(30_000, rows[0][1], 2, "x", 7), (None, rows[1][1], None, "x", 7)]
    # the smallest id sets the length: -5 has 16 components, so leave it out of the large table
    table = spark.createDataFrame(rows[:-1] + same, SCHEMA).repartition(5)
    want, digest = brute([r for r in rows[:-1] + same])
    codes, books = compress(table)
    got = with_label_error(codes).collect()
    assert {r.vec_id: (r.code, r.error) for r in got} == want and len(got) == len(want)
    assert books.sha256() == digest
    labels = {i: lab for i, _, lab, *_ in rows[:-1] + same}
    total = {lab: sum(want[i][1] for i in want if labels[i] == lab) for lab in (1, 2, None)}
    assert all(r.label_error == total[r.label] for r in got)
    short, _ = compress(spark.createDataFrame(rows, SCHEMA))       # with -5: only vectors of its length stay
    assert [r.vec_id for r in short.collect()] == [-5]


def test_few_equal_and_no_rows(spark):
    one = [float(k) / 7 for k in range(16)]
    few = spark.createDataFrame([(3, one, 1), (2, one, 1), (1, [-x for x in one], None)], "vec_id long, embedding array<double>, label int")
    codes, books = compress(few)
    want, digest = brute([(r.vec_id, list(map(float, r.embedding)), r.label) for r in few.collect()])
    assert books.entries.shape == (16, 3, 1) and books.sha256() == digest
    assert {r.vec_id: (r.code, r.error) for r in codes.collect()} == want
    empty, none = compress(few.where("vec_id > 9"))
    assert none is None and empty.columns == ["vec_id", "label", "code", "error", "compared"] and not empty.collect()
    with pytest.raises(Exception, match="or more"):
        compress(spark.createDataFrame([(1, [1e30] * 16, 1)], "vec_id long, embedding array<double>, label int"))


def test_decoding_is_near():
    rng = np.random.default_rng(0)
    vectors = rng.integers(-99, 99, (200, 32))
    books = Codebooks(np.ascontiguousarray(vectors[:64].reshape(64, 16, 2).transpose(1, 0, 2)))
    index, error, _ = books.encode(vectors)
    assert (((books.decode(index) * 256 - vectors) ** 2).sum(1) == error).all()
    assert (error[:64] == 0).all()


def test_query_over_its_table(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.QUERIES["op11_vector_codes"](spark, sf).collect()
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, digest = brute(rows)
    assert {r.vec_id: (r.code, r.error) for r in got} == want and {r.codebooks_sha256 for r in got} == {digest}
    assert vector_codes.ENTRIES == 64
