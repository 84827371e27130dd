import hashlib

from pyspark.sql import functions as F

from concord.functions import draws as D


def py_draw(key, slot, salt=""):
    h = hashlib.md5(f"{salt}/{key}/{slot // 2}".encode()).hexdigest()
    return int(h[8 * (slot % 2):8 * (slot % 2) + 8], 16)


def test_column_and_staged_draws_match_arithmetic(spark):
    df = spark.range(0, 500).withColumnRenamed("id", "k")
    a = df.select("k", D.draw(F.col("k"), 7, "s").alias("x"), D.pick(D.draw(F.col("k"), 6), 10).alias("p"))
    staged = {r.k: r.x for r in D.with_draws(df, "k", {"x": 7}, "s").collect()}
    for r in a.collect():
        assert r.x == py_draw(r.k, 7, "s") == staged[r.k]
        assert r.p == py_draw(r.k, 6) * 10 // D.RANGE


def test_duckdb_has_the_same_draws():
    import duckdb
    got = duckdb.sql(f"SELECT k, {D.draw_sql('k', '2 + 2 * p', repr('a/b'))} AS x, p FROM range(0, 40) t(k), range(0, 5) u(p)").fetchall()
    assert all(x == py_draw(k, 2 + 2 * p, "a/b") for k, x, p in got)


def test_streams_of_far_keys_are_independent(spark):
    base = spark.range(0, 3000)
    shifts = (1, 1 << 25, 1 << 31, (1 << 31) - 1, 1_073_741_823, 1 << 40)
    for shift in shifts:
        for step in (0, 1, 2):
            same = base.agg(F.count_if(D.draw(F.col("id") + shift, 2) == D.draw(F.col("id"), 2 + step))).first()[0]
            assert same == 0, (shift, step)
    near = base.agg(F.count_if(D.draw(F.col("id"), 4) == D.draw(F.col("id"), 5)), F.count_if(D.draw(F.col("id"), 4) == D.draw(F.col("id"), 4, "other"))).first()
    assert tuple(near) == (0, 0)


def test_pick_is_roughly_uniform(spark):
    counts = spark.range(0, 20000).groupBy(D.pick(D.draw(F.col("id"), 3), 10).alias("b")).count().collect()
    assert len(counts) == 10
    for r in counts:
        assert abs(r["count"] - 2000) < 4 * (2000 ** 0.5)
