"""Read-through caches of catalogs: versioned tables of entries with their time.

A key that was looked up in vain has an entry too, with nulls, which lasts for a time of its own. Of several entries of
a key the youngest counts; older ones go when the table is compacted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.functions import fixed as X
from reelspark.operators.catalogs import misses
from reelspark.sources.store import COMPACT, Store

#: Days for which nothing found stays nothing found.
NEGATIVE_DAYS = 1


class Cache:
    """Entries of ``schema`` (DDL) by ``keys`` at ``path``."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], days: int = X.CACHE_DAYS, negative_days: int = NEGATIVE_DAYS, compact: int = COMPACT):
        self.store = Store(spark, path, f"{schema}, cached_at timestamp", self.latest, compact)
        self.keys, self.days, self.negative = keys, days, negative_days
        self.names = [c for c in self.store.read().columns if c != "cached_at"]
        self.values = [c for c in self.names if c not in keys]

    def latest(self, rows: DataFrame) -> DataFrame:
        """The entry of each key that was made last; of those of one time, all its columns decide."""
        rest = [c for c in self.names if c not in self.keys]
        best = F.max(F.struct("cached_at", *rest)).alias("e")
        return rows.groupBy(*self.keys).agg(best).select(*self.keys, *[F.col(f"e.{c}") for c in rest], F.col("e.cached_at"))

    def read(self, now: Column | None = None) -> DataFrame:
        """A row a key whose entry is young enough."""
        now = F.current_timestamp() if now is None else now
        nothing = reduce(lambda a, b: a & b, [F.col(c).isNull() for c in self.values], F.lit(True)) if self.values else F.lit(False)
        since = lambda days: now - F.expr(f"interval {days} days")
        return self.latest(self.store.read()).filter(F.col("cached_at") >= F.when(nothing, since(self.negative)).otherwise(since(self.days)))

    def add(self, new: DataFrame, now: Column | None = None) -> None:
        """Add entries; those that are there keep their time."""
        self.store.append(new.select(*self.names).withColumn("cached_at", F.current_timestamp() if now is None else now))

    def looked_up(self, wanted: DataFrame, fetch, now: Column | None = None) -> DataFrame:
        """Entries of the keys of ``wanted``, after ``fetch`` (missing keys -> rows) filled the cache; keys for which it has no row
        get an entry of nulls."""
        asked = wanted.select(*self.keys).distinct()
        missing = misses(asked, self.read(now), self.keys)
        if not missing.isEmpty():
            found = fetch(missing).select(*self.names)
            self.add(missing.join(found, self.keys, "left"), now)
        return self.read(now).join(asked, self.keys, "left_semi")
