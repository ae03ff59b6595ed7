"""An extension: files that arrive, planned batch by batch, without collisions between batches.

What earlier batches have taken is a versioned table of names: those that were given are taken in all directories, as
within a batch; those of files that stayed as they are, in their own. Rows carry a bucket of their family of names, and
compaction sorts them by it, so a batch reads the files of its own families' buckets only. A batch that is repeated
finds what the batches before it have taken, gives the same names and adds nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reelspark.operators.allocate import family
from reelspark.plans.cut import cut
from reelspark.plans.pipeline import Options, plan
from reelspark.sources.store import Store

#: Buckets of families; a batch names those that it reads.
BUCKETS = 1024
SCHEMA = "bucket int, family string, dir string, name string, stream string, batch long"


def _bucketed(names: DataFrame) -> DataFrame:
    f = names.withColumn("family", family(F.col("name")))
    return f.withColumn("bucket", F.pmod(F.xxhash64("family"), F.lit(BUCKETS)).cast("int"))


class Reservations:
    """The names that the batches of a stream have taken, at ``path``."""

    def __init__(self, spark: SparkSession, path: str, stream: str = "arrivals"):
        self.stream = stream
        self.store = Store(spark, path, SCHEMA, lambda rows: rows.distinct().repartitionByRange("bucket").sortWithinPartitions("bucket", "family"))

    def before(self, batch: int, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(``dir, name`` that lie there, ``name`` that are given) of the families of the ``new_name`` in wanted, by earlier batches."""
        asked = _bucketed(wanted.select(F.col("new_name").alias("name"))).select("bucket", "family").distinct()
        asked = cut(asked)
        buckets = [r.bucket for r in asked.select("bucket").distinct().collect()]  # BUCKETS at most
        rows = self.store.read().filter(F.col("bucket").isin(buckets) & ~((F.col("stream") == self.stream) & (F.col("batch") >= batch)))
        rows = cut(rows.join(asked, ["bucket", "family"], "left_semi"))
        return rows.filter("dir is not null").select("dir", "name"), rows.filter("dir is null").select("name")

    def take(self, batch: int, planned: DataFrame) -> None:
        """Add the names of a batch's plan."""
        moved = F.col("status") == "renamed"
        folder = F.when(~moved, F.regexp_extract("path", r"^(.*)/[^/]*$", 1))
        names = planned.select(folder.alias("dir"), F.col("dest_name").alias("name"))
        rows = _bucketed(names).withColumns({"stream": F.lit(self.stream), "batch": F.lit(batch).cast("long")})
        self.store.append(rows, self.stream, batch)


def plan_batch(batch: DataFrame, number: int, names: Reservations, options: Options | None = None) -> DataFrame:
    """The plan of one batch of files (``file_id, path``), its names taken."""
    planned = cut(plan(batch, replace(options or Options(), names=lambda wanted: names.before(number, wanted))))
    names.take(number, planned)
    return planned


def plan_arrivals(files: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, names: Reservations, options: Options | None = None) -> StreamingQuery:
    """Start planning a stream of files (``file_id, path``); each batch's plan goes to ``sink`` with its number."""

    def each(batch: DataFrame, number: int) -> None:
        sink(plan_batch(batch, number, names, options), number)

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
