"""Equi-joins: eight types, a null comparison for each key, output selection, suffixes and residual conditions.

Everything becomes one Join node, so Catalyst prunes columns, adds null filters and picks broadcast, hash or merge
joins, and adaptive execution splits skewed keys. Nulls: under "EQ" a null key matches nothing (and an anti join keeps
its row), under "IS" nulls match each other; both stay equi-joins. -0.0 equals 0.0 and NaN equals NaN, as in Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Join type -> Spark's type, and whether the sides change places (Spark has no right semi or anti join).
JOIN_TYPES = {
    "inner": ("inner", False),
    "left_outer": ("left", False),
    "right_outer": ("right", False),
    "full_outer": ("full", False),
    "left_semi": ("left_semi", False),
    "left_anti": ("left_anti", False),
    "right_semi": ("left_semi", True),
    "right_anti": ("left_anti", True),
}
#: Up to so many rows, and bytes of what they hold (by a bound for each row), a side is broadcast on request.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 256 << 20
STRATEGIES = {"broadcast": "broadcast", "hash": "shuffle_hash", "merge": "merge"}


def small(df: DataFrame) -> bool:
    """Whether df is small enough to broadcast; reads no more than the rows that would be."""
    some = df.limit(BROADCAST_ROWS + 1).select(F.length(F.to_json(F.struct("*"))).alias("n")) if df.columns else df.limit(BROADCAST_ROWS + 1).select(F.lit(0).alias("n"))
    found = some.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("bytes")).first()
    return found.rows <= BROADCAST_ROWS and found.bytes <= BROADCAST_BYTES


def hash_join(
    left: DataFrame,
    right: DataFrame,
    left_keys: Sequence[str],
    right_keys: Sequence[str],
    how: str = "inner",
    key_cmp: Sequence[str] | None = None,
    left_output: Sequence[str] | None = None,
    right_output: Sequence[str] | None = None,
    suffixes: tuple[str, str] = ("", ""),
    residual: Callable[[Callable[[str], Column], Callable[[str], Column]], Column] | None = None,
    strategy: str | None = None,
) -> DataFrame:
    """left joined with right on left_keys[i] = right_keys[i].

    key_cmp: "EQ" or "IS" for each key. left_output, right_output: columns to return, in that order, left first; all by
    default. Semi and anti joins return the side they keep. suffixes go to names that both outputs have.
    residual(l, r): a further condition, where l("x") and r("x") are columns of the sides. It is part of the join
    condition, so that outer rows without a full match stay and semi and anti joins test it.
    strategy: a hint, "broadcast", "hash" or "merge". A side is broadcast only after its rows have been counted and
    measured: beyond BROADCAST_ROWS or BROADCAST_BYTES the join is planned without the hint.
    """
    if how not in JOIN_TYPES:
        raise ValueError(f"unknown join type {how!r}; there are {', '.join(JOIN_TYPES)}")
    if not left_keys or len(left_keys) != len(right_keys):
        raise ValueError("left_keys and right_keys must be of equal length and not empty")
    key_cmp = key_cmp or ["EQ"] * len(left_keys)
    if len(key_cmp) != len(left_keys) or not set(key_cmp) <= {"EQ", "IS"}:
        raise ValueError("key_cmp must give EQ or IS for each key")
    if strategy is not None and strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    sides = {"l": left, "r": right}
    wanted = {"l": list(left.columns if left_output is None else left_output), "r": list(right.columns if right_output is None else right_output)}
    for side, names in (("l", [*left_keys, *wanted["l"]]), ("r", [*right_keys, *wanted["r"]])):
        for name in names:
            if sides[side].columns.count(name) != 1:
                raise ValueError(f"column {name!r} is missing or ambiguous in {sides[side].columns}")
    # Positional names keep the sides apart, also in a join of a table with itself.
    place = {side: {c: f"{side}{i}" for i, c in enumerate(df.columns)} for side, df in sides.items()}
    l, r = (df.toDF(*[f"{side}{i}" for i in range(len(df.columns))]) for side, df in sides.items())  # noqa: E741
    of_left, of_right = (lambda name: F.col(place["l"][name])), (lambda name: F.col(place["r"][name]))
    tests = [of_left(a).eqNullSafe(of_right(b)) if cmp == "IS" else of_left(a) == of_right(b) for a, b, cmp in zip(left_keys, right_keys, key_cmp, strict=True)]
    if residual is not None:
        tests.append(residual(of_left, of_right))
    condition = reduce(lambda a, b: a & b, tests)
    kind, swapped = JOIN_TYPES[how]
    if strategy == "broadcast" and not small(l if swapped else r):
        strategy = None
    if strategy:
        r = r.hint(STRATEGIES[strategy]) if not swapped else r
        l = l.hint(STRATEGIES[strategy]) if swapped else l  # noqa: E741
    joined = r.join(l, condition, kind) if swapped else l.join(r, condition, kind)
    if kind in ("left_semi", "left_anti"):
        side = "r" if swapped else "l"
        return joined.select(*[F.col(place[side][c]).alias(c) for c in wanted[side]])
    both = set(wanted["l"]) & set(wanted["r"])
    out = [F.col(place[side][c]).alias(c + suffix if c in both else c) for side, suffix in zip("lr", suffixes, strict=True) for c in wanted[side]]
    return joined.select(*out)
