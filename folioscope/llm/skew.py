"""Joins of a table with hot keys, by a broadcast of bounded size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.plans.scale import materialise

MOST_HOT = 10_000
"""A key is hot if it has more than this part of all rows, so at most as many keys are."""
LEAST_HOT = 256
"""Rows below which no key counts as hot."""


def join_hot(big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``big`` joined with ``small``, which has each key once; ``big`` is read several times, so it should be stored.

    Keys with more than a ``MOST_HOT``-th of the rows of ``big`` meet their rows of ``small`` by a broadcast of at most
    ``MOST_HOT`` rows; all other keys are shuffled, and none of those can fill a task. Null keys match nothing. ``how`` is
    inner, left, left_semi or left_anti.
    """
    keys = list(keys)
    counts = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    total = F.greatest(F.lit(LEAST_HOT), F.lit(big.count()) / MOST_HOT)
    hot = materialise(counts.where(F.col("_rows") > total).select(*keys).dropna(), "hot-keys")
    if hot.isEmpty():
        return big.join(small, keys, how)
    hot = F.broadcast(hot)
    cold = big.join(hot, keys, "left_anti").join(small, keys, how)
    few = small.join(hot, keys, "left_semi")
    return cold.unionByName(big.join(hot, keys, "left_semi").join(F.broadcast(few), keys, how))
