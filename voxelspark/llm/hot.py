"""Joins on keys of which a few may hold a large share of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than this part of the rows, so there are fewer hot keys than that.
SHARE = 256


def join_hot(left: DataFrame, right: DataFrame, on: list[str], weight: str, total: int, how: str = "inner", null_safe: bool = False) -> DataFrame:
    """``left`` joined with ``right``, which has a row a key and in ``weight`` (not in the result) the rows ``left`` has of it.

    The rows of ``right`` with more than ``total / SHARE`` are fewer than ``SHARE``, so they are broadcast and their
    partners stay where they are; all others are joined the plain way, where no key is hot. ``how`` is inner or left.
    """
    keys = {k: f"_{k}" for k in on}
    side, bound = right.withColumnsRenamed(keys), total / SHARE
    same = reduce(lambda a, b: a & b, [F.col(a).eqNullSafe(F.col(b)) if null_safe else F.col(a) == F.col(b) for a, b in keys.items()])
    many, few = side.where(F.col(weight) > bound), side.where(F.col(weight) <= bound)
    out = [*left.columns, *[c for c in side.columns if c != weight and c not in keys.values()]]
    hot = left.join(F.broadcast(many), same).select(*out)
    rest = left.join(F.broadcast(many.select(*keys.values())), same, "left_anti").join(few, same, how).select(*out)
    return hot.unionByName(rest)
