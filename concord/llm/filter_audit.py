"""Interaction audit of five filters by wide packed counters.

Every document has a mask: bit k is set if it fails filter k.  What happens to a
document in all 120 orders of the five filters depends on its mask alone, so each of
the 32 masks is mapped to one big integer.  Its fields, ``FIELD`` bits wide, hold
the 600 step outcomes (1 where the step of the order removes the document), the
filters it fails, the filter it alone fails, and a 1 for the document itself.
Adding these integers adds all counters at once; a field cannot overflow into the
next one below 2^FIELD documents.

Tasks add up one integer per part and group (all, good, toxic documents) and hand
on the sums; these are added in two levels, so no task takes more than a share of
them, and unpacked into rows.  The counts that are no fields follow: after a step
remain the part's documents less those removed up to it; redundant are those that
fail the step's filter less those it removes.

The filters are A: under 200 words; B: distinct words below half of the words;
C: more than 3 % of the code points are capitals A-Z; D: one of ``#$%&*|``;
E: the same text in a row of a smaller doc_id, anywhere in the table.  For E,
texts are known by SHA-256; only digests are shuffled, the smallest id of a text
is found with map-side combining, and the join back to its copies can be split.

Defined cases: null text is empty (and equal to other empty texts); a null
doc_id is neither smaller nor larger than another; a null language is the part
of the empty string; a document is good (toxic) if any of its labels is 1, null
labels count as none; repeated rows count each; an empty table has no parts.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, stored

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
FIELD = 64                         # bits of a counter
FAILS = len(ORDERS) * STEPS        # fields: step outcomes, then failing, failing alone, documents
ALONE, DOCUMENTS = FAILS + STEPS, FAILS + 2 * STEPS
FIELDS = DOCUMENTS + 1
BRANCHES = 256                     # sums that one task adds up in the first level, about
HELD_PARTS = 512                   # parts that a task holds sums of at once
GROUPS = ("all", "good", "toxic")


def packed_outcomes() -> list[int]:
    """For each mask, its integer of fields."""
    out = []
    for mask in range(1 << STEPS):
        fails = [k for k in range(STEPS) if mask >> k & 1]
        fields = [DOCUMENTS] + [FAILS + k for k in fails]
        if len(fails) == 1:
            fields.append(ALONE + fails[0])
        if fails:
            for o, order in enumerate(ORDERS):
                fields.append(o * STEPS + min(order.index(FILTERS[k]) for k in fails))
        out.append(sum(1 << FIELD * f for f in fields))
    return out


def to_bytes(wide: int) -> bytes:
    return wide.to_bytes(FIELDS * FIELD // 8, "little")


def unpacked(wide: bytes) -> np.ndarray:
    return np.frombuffer(wide, "<i8")


def text_bits(text: Column) -> Column:
    """Filters A to D of a text as the lower four bits of its mask."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    # one array for both counts: names the parsed words, not the text, twice
    counts = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d")))[0]
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    bits = lambda c: F.transform(F.array(c), lambda s: F.when(s["n"] < 200, 1).otherwise(0)                        # noqa: E731
                                 + F.when(100 * s["d"] < 50 * s["n"], 2).otherwise(0))[0]
    return bits(counts) + F.when(100 * capitals > 3 * F.length(text), 4).otherwise(0) + F.when(text.rlike(r"[#$%&*|]"), 8).otherwise(0)


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic) of every document."""
    text = F.coalesce("text", F.lit(""))
    light = stored(docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.sha2(text, 256).alias("print"), text_bits(text).alias("bits")), "audit-bits")
    # stored, so that both sides of the join are plain exchanges, which can be split at a text that fills many rows
    firsts = stored(light.groupBy("print").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("print", "first"), "audit-firsts")
    later = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    full = light.join(firsts, "print", "left").select("doc_id", "part", (F.col("bits") + F.when(later, 16).otherwise(0)).alias("mask"))
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marks = marks.where("good = 1 or toxic = 1")
    return full.join(marks, "doc_id", "left").select("part", "mask", F.coalesce(F.col("good") == 1, F.lit(False)).alias("good"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("toxic"))


SUMS = "part string, branch int, all binary, good binary, toxic binary"


def _summed(batches):
    """One row of packed sums per part (and again where a task has very many parts)."""
    wide = packed_outcomes()
    branch = TaskContext.get().partitionId() // BRANCHES
    held: dict[str, list[int]] = {}

    def rows():
        columns = [pa.array(list(held), pa.string()), pa.array([branch] * len(held), pa.int32())]
        columns += [pa.array([to_bytes(s[g]) for s in held.values()], pa.binary()) for g in range(len(GROUPS))]
        return pa.RecordBatch.from_arrays(columns, names=["part", "branch", *GROUPS])

    for batch in batches:
        names = batch.column("part").dictionary_encode()
        code = names.indices.to_numpy() << STEPS | batch.column("mask").to_numpy()
        chosen = [np.ones(len(code), bool), *(batch.column(g).to_numpy(zero_copy_only=False) for g in GROUPS[1:])]
        for g, rows_of in enumerate(chosen):
            found, count = np.unique(code[rows_of], return_counts=True)
            for c, n in zip(found.tolist(), count.tolist()):
                held.setdefault(names.dictionary[c >> STEPS].as_py(), [0] * len(GROUPS))[g] += n * wide[c & (1 << STEPS) - 1]
        if len(held) > HELD_PARTS:
            yield rows()
            held.clear()
    if held:
        yield rows()


def _added(group: pa.Table) -> pa.Table:
    """Packed sums of a part and branch as one row."""
    totals = [pa.array([to_bytes(sum(int.from_bytes(x, "little") for x in group.column(g).to_pylist()))], pa.binary()) for g in GROUPS]
    return pa.table([group.column("part").slice(0, 1), group.column("branch").slice(0, 1), *totals], names=["part", "branch", *GROUPS])


def _rows(part: str, everything: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> dict[str, list]:
    removed = everything[:FAILS].reshape(len(ORDERS), STEPS)
    filters = np.array([[FILTERS.index(f) for f in order] for order in ORDERS])
    shapley = np.zeros(STEPS, np.int64)
    np.add.at(shapley, filters.ravel(), removed.ravel())
    return {
        "part": [part] * FAILS,
        "filter_order": np.repeat(ORDERS, STEPS).tolist(),
        "step": np.tile(np.arange(1, STEPS + 1, dtype=np.int32), len(ORDERS)),
        "kept": (everything[DOCUMENTS] - removed.cumsum(axis=1)).ravel(),
        "removed": removed.ravel(),
        "redundant": (everything[FAILS:ALONE][filters] - removed).ravel(),
        "unique_fails": everything[ALONE:DOCUMENTS][filters].ravel(),
        "good_lost": good[:FAILS], "toxic_lost": toxic[:FAILS],
        "shapley": shapley[filters].ravel(),
    }


REPORT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def _report(group: pa.Table) -> pa.Table:
    total = _added(group)
    return pa.table(_rows(total.column("part")[0].as_py(), *(unpacked(total.column(g)[0].as_py()) for g in GROUPS)))


def audit(masked: DataFrame) -> DataFrame:
    """600 rows for each part of masked (part, mask, good, toxic)."""
    partial = map_batches(masked, _summed, SUMS).groupBy("part", "branch").applyInArrow(_added, SUMS)
    return partial.groupBy("part").applyInArrow(_report, REPORT)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of documents, with what good and toxic ones each step costs."""
    return audit(masks(docs, labels))
