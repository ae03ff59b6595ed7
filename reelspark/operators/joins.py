"""Joins against tables with one row a key, where some keys may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.plans.cut import cut

#: A key is frequent if more than one in so many rows has it; so there are no more frequent keys than that.
FREQUENT = 256


def frequent_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", most: int = FREQUENT, once: bool = False) -> DataFrame:
    """``left`` joined to ``right`` (a row a key, keys never null) by ``keys``; how: ``inner`` or ``left``. once: ``left``
    is cut already.

    Rows of frequent keys stay where they are and meet the ``most`` rows of ``right`` at most that they need by a
    broadcast; all others are shuffled, no key with more than a ``most``-th of the rows. Rows with null keys meet nothing.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"no such join: {how}")
    d = left if once else cut(left)
    counts = d.groupBy(*keys).agg(F.count("*").alias("__n"))
    limit = d.count() / most
    frequent = F.broadcast(cut(counts.filter(F.col("__n") > limit).select(*keys, F.lit(True).alias("__frequent"))))  # ``most`` rows at most
    same = lambda f: [d[k].eqNullSafe(f[k]) for k in keys]
    marked = d.join(frequent, same(frequent), "left").select(*[d[c] for c in d.columns], F.col("__frequent"))
    few = F.broadcast(right.join(frequent.drop("__frequent"), keys, "left_semi"))  # a row a frequent key
    hot = marked.filter("__frequent").drop("__frequent").join(few, keys, how)
    cold = marked.filter("__frequent is null").drop("__frequent").join(right, keys, how)
    return hot.unionByName(cold)
