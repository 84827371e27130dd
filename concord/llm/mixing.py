"""Mixing sources to target weights by pivotal dependent rounding.

Sources get weights, a target number of words each, and so a copy rate
r = target / words of the source.  A document is taken floor(r) times, and once
more with probability r - floor(r); these last copies are drawn together so
that a source's words come out near the target:

* Pivotal step: two fractional probabilities p, q of documents with a and b
  words exchange mass, a*p + b*q unchanged, in a random direction chosen so
  that the expectations stay, until one is 0 or 1.
* Each bucket of documents runs the steps by source, from the longest document
  to the shortest, which leaves at most one fractional document per (bucket,
  source), and mostly a short one.  These residuals go up a reduction
  tree of fan-in ``FAN``; the root's last one is rounded by one draw.  Every
  level is a grouped Spark job over the residuals of the level below.

A source's taken words differ from its target by less than one document.
Buckets and draws are hashes of the rows, so reruns agree however the input is
partitioned.

Targets: words are shared out by weight and capped at ``MAX_RATE`` times the
source's words, the excess being reshared: target = min(cap, level * weight),
where the level solves sum(target) = total.  It is found by a few aggregates
over the table of sources.

Defined cases: null text has size 0; a null source is a source, last in order;
null doc_ids are documents; rows alike in doc_id, source and size are one unit
and are taken equally often; documents without words are drawn independently;
with no words at all every target is 0; an empty table stays empty.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ranked, stored
from .words import M1, mix

MAX_RATE = 3
WEIGHTS = (1, 2, 3)            # by place in the order of sources, repeating
UNITS_PER_BUCKET = 20_000
SOURCES_PER_GROUP = 1_000
FAN = 64
SEED = 20_240_607
PREFIX = "__mix_"
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, name: str = "size") -> DataFrame:
    return docs.withColumn(name, F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long"))


def targets(units: DataFrame, weights: tuple = WEIGHTS, max_rate: float = MAX_RATE) -> DataFrame:
    """(source, source_size, target) from units (source, size, rows)."""
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    order = [F.col("source").asc_nulls_last()]
    table = ranked(sizes, order, "place", "mix-sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    table = table.withColumn("weight", weight)
    cap = F.col("source_size") * float(max_rate)
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while total:
        full = cap < level * F.col("weight")
        held, free = table.agg(F.sum(F.when(full, cap).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        raised = (total - held) / free if free else level
        if raised <= level:
            break
        level = raised
    return table.select("source", "source_size", F.least(cap, level * F.col("weight")).alias("target"))


def pivot(p: list, mass: list, draw: list) -> list:
    """Sequential pivotal rounding that keeps sum(mass * p); at most one entry stays fractional."""
    at = -1                                        # the entry that is still fractional
    for j in range(len(p)):
        if not 0.0 < p[j] < 1.0:
            continue
        if at < 0:
            at = j
            continue
        a, b, x, y = mass[at], mass[j], p[at], p[j]
        up, down = min((1 - x) * a, y * b), min(x * a, (1 - y) * b)     # mass moved to `at`, or from it
        if draw[j] * (up + down) < down:
            x, y = (1.0 if up == (1 - x) * a else x + up / a), (0.0 if up == y * b else y - up / b)
        else:
            x, y = (0.0 if down == x * a else x - down / a), (1.0 if down == (1 - y) * b else y + down / b)
        p[at], p[j] = x, y
        if 0.0 < y < 1.0:
            at = j
        elif not 0.0 < x < 1.0:
            at = -1
    return p


def draws(key: np.ndarray, level: int) -> np.ndarray:
    """Uniform numbers in [0, 1) from unit keys."""
    return (mix(key.view(np.uint64) * M1 + np.uint64(SEED + level)) >> np.uint64(11)).astype(float) / 2.0**53


def _round(level: int, last: bool):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("source", "ascending"), ("size", "descending"), ("key", "ascending"), ("doc_id", "ascending")])
        source, key = group.column("source").to_pylist(), group.column("key").to_numpy()
        p, mass = group.column("p").to_pylist(), (group.column("size").to_numpy() * group.column("rows").to_numpy()).astype(float)
        u = draws(key, level)
        edges = [0, *(i for i in range(1, len(source)) if source[i] != source[i - 1]), len(source)]
        done = []
        for i, j in zip(edges[:-1], edges[1:]):
            part = pivot(p[i:j], mass[i:j].tolist(), u[i:j].tolist())
            if last:
                part = [float(v >= 1.0 or (v > 0.0 and d < v)) for v, d in zip(part, draws(key[i:j], level + 1))]
            done += part
        return group.set_column(group.column_names.index("p"), "p", pa.array(done, pa.float64()))
    return run


def copies(units: DataFrame, shares: DataFrame) -> DataFrame:
    """``units`` (doc_id, source, size, rows) with source_size, target and copies, one row each."""
    s = shares.withColumnRenamed("source", PREFIX + "source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    near = F.round(rate, 9)                        # 2.9999999999 is 3
    base = F.when(F.abs(rate - F.round(rate)) < 1e-9, F.round(rate)).otherwise(F.floor(near))
    x = units.join(s, units["source"].eqNullSafe(s[PREFIX + "source"])).drop(PREFIX + "source")
    x = x.withColumns({"base": base.cast("int"), "key": F.xxhash64(F.lit(SEED), "doc_id", "size", "source")})
    x = x.withColumn("p", F.greatest(F.lit(0.0), rate - F.col("base")))
    x = x.withColumn("p", F.when(F.col("p") < 1e-9, 0.0).when(
        F.col("size") == 0, (F.pmod(F.xxhash64(F.lit(SEED + 1), "key"), F.lit(1 << 30)) < F.col("p") * (1 << 30)).cast("double")).otherwise(F.col("p")))
    x = stored(x, "mix-units")
    n, n_sources = x.count(), shares.count()
    buckets, groups = max(1, math.ceil(n / UNITS_PER_BUCKET)), max(1, math.ceil(n_sources / SOURCES_PER_GROUP))
    open_ = (F.col("p") > 0) & (F.col("p") < 1)
    done, level = [x.where(~open_)], 0
    rest = x.where(open_).withColumns({"bucket": F.pmod(F.xxhash64("key"), F.lit(buckets)), "sources": F.pmod(F.xxhash64("source"), F.lit(groups))})
    while True:
        last = buckets == 1
        out = stored(rest.groupBy("sources", "bucket").applyInArrow(_round(level, last), rest.schema), f"mix-level{level}")
        done.append(out.where(~open_).select(*x.columns))
        if last:
            break
        buckets, level = math.ceil(buckets / FAN), level + 2
        rest = out.where(open_).withColumn("bucket", F.col("bucket") % buckets)
    result = done[0]
    for d in done[1:]:
        result = result.union(d)
    return result.withColumn("copies", F.col("base") + F.round("p").cast("int")).drop("base", "key", "p")


def plan(docs: DataFrame, weights: tuple = WEIGHTS) -> DataFrame:
    """(doc_id, source, size, rows, source_size, target, copies) of the units of docs."""
    units = stored(sized(docs.select("doc_id", "source", "text")).groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows")), "mix-sizes")
    return copies(units, stored(targets(units, weights), "mix-targets"))


def mix_documents(docs: DataFrame, weights: tuple = WEIGHTS) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it."""
    p = plan(docs, weights).where(F.col("copies") > 0).select(
        F.col("doc_id").alias(PREFIX + "id"), F.col("source").alias(PREFIX + "source"), F.col("size").alias(PREFIX + "size"), F.col("copies").alias(PREFIX + "copies"))
    d = sized(docs, PREFIX + "words")
    same = d["doc_id"].eqNullSafe(p[PREFIX + "id"]) & d["source"].eqNullSafe(p[PREFIX + "source"]) & (d[PREFIX + "words"] == p[PREFIX + "size"])
    return d.join(p, same).withColumn(PREFIX + "n", F.explode(F.sequence(F.lit(1), F.col(PREFIX + "copies")))).select(*docs.columns)
