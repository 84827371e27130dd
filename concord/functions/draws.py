"""Deterministic random draws as pure Spark columns.

A draw is a function of (salt, key, slot) only, so every random choice is
independent of partitioning, task retries and executor loss, and needs no
state, no shuffle and no Python.  It is eight hexadecimal digits (32 bits) of
the MD5 digest of ``salt/key/group``, with two slots to a group: digests of
different salts, keys and groups share nothing, keys may be any BIGINT, and any
SQL engine has the same function.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RANGE = 1 << 32

# slot layout of one sentence
SLOT_SHAPE = 0
SLOT_TENSE = 1


def word_slot(pos):
    return 2 + 2 * pos


def number_slot(pos):
    return 3 + 2 * pos


def _lit(v):
    return v if isinstance(v, Column) else F.lit(v)


def digest(key, group, salt="") -> Column:
    return F.md5(F.concat_ws("/", _lit(salt), _lit(key).cast("string"), _lit(group).cast("string")))


def part(d: Column, slot: int) -> Column:
    return F.conv(F.substring(d, 1 + 8 * (slot % 2), 8), 16, 10).cast("bigint")


def draw(key, slot: int, salt="") -> Column:
    """Uniform BIGINT in [0, RANGE) for (salt, key, slot)."""
    return part(digest(key, slot // 2, salt), slot)


def lower_half(d: Column, slot: int) -> Column:
    """Whether the draw of ``slot`` is below RANGE / 2, read off its first hexadecimal digit."""
    return F.substring(d, 1 + 8 * (slot % 2), 1) < "8"


def pick(x: Column, n) -> Column:
    """Map a draw to 0..n-1 by scaling (not modulus, which would bias large n)."""
    return F.call_function("div", x * _lit(n).cast("bigint"), F.lit(RANGE).cast("bigint"))


def draw_sql(key: str, slot: str, salt: str = "''") -> str:
    """The same draw as a DuckDB expression; ``salt``, ``key`` and ``slot`` are SQL."""
    return (f"CAST('0x' || substr(md5({salt} || '/' || ({key}) || '/' || CAST(({slot}) // 2 AS INTEGER)), "
            f"CAST(1 + 8 * (({slot}) % 2) AS INTEGER), 8) AS BIGINT)")


def pick_sql(x: str, n) -> str:
    return f"(({x}) * CAST({n} AS BIGINT) // {RANGE})"


def stage(df, cols: dict):
    """Add/replace columns in one projection.  Successive stages keep every
    intermediate an attribute: expressions referenced several times are not
    inlined into each other, which keeps generated code small and each value
    computed once per row."""
    names = set(cols)
    return df.select(*[c for c in df.columns if c not in names], *[v.alias(k) for k, v in cols.items()])


def with_draws(df, key_col: str, slots: dict, salt="") -> object:
    """Add one draw column per ``{name: slot}``: each group's digest is taken once."""
    groups = sorted({s // 2 for s in slots.values()})
    df = stage(df, {f"_g{g}": digest(F.col(key_col), g, salt) for g in groups})
    df = stage(df, {n: part(F.col(f"_g{s // 2}"), s) for n, s in slots.items()})
    return df.drop(*[f"_g{g}" for g in groups])
