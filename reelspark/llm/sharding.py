"""Sharding by proportional stratified interleaving, in DataFrame operations only.

Rows are shuffled within each source by a seeded hash and ranked; a row's fractional rank, ``(2 r - 1) / (2 n)``
for rank r among n rows, spreads every source evenly over (0, 1). All rows are sorted by it and cut into runs of
equal length, so each shard has each source in the proportion of the whole, to within about a row.

No task sorts a source as a whole: ranks are counted within hash buckets of bounded size and moved by the prefix
sums of the buckets' counts, and so is the place in the overall order. A source with a third of all rows costs as
much as many small ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import bucket_of, buckets_for, exclusive_prefix, group_key, written


def ranked(df: DataFrame, rows: int) -> DataFrame:
    """``__rank`` (from 1, within ``__g``, in the order of ``__h``) and ``__n`` (rows of ``__g``) for each row.

    df has ``__g`` (a string, never null) and ``__h`` (a 64-bit hash; rows with equal hashes are alike).
    """
    n = buckets_for(rows)
    df = df.withColumn("__b", bucket_of(F.col("__h"), n))
    sums = df.groupBy("__g", "__b").agg(F.count("*").alias("__c"))
    before = exclusive_prefix(sums, ["__g"], "__b", ["__c"]).select("__g", "__b", "__c_before")
    totals = sums.groupBy("__g").agg(F.sum("__c").alias("__n"))
    local = F.row_number().over(Window.partitionBy("__g", "__b").orderBy("__h"))
    df = df.withColumn("__local", local).join(before, ["__g", "__b"]).join(totals, "__g")
    return df.withColumn("__rank", F.col("__local") + F.col("__c_before")).drop("__b", "__local", "__c_before")


def interleaved_shards(df: DataFrame, strata: Column, identity: list[Column], shards: int, seed: int = 17) -> DataFrame:
    """df with ``__shard`` (0 to shards - 1) and ``__slot`` (from 0 in each shard), a row each.

    strata: the source; null is a source of its own. identity: what tells rows apart; rows that agree in all of it
    change places without a trace. The shards' row counts differ by one at most. An empty table gives an empty table.
    Reruns over the same rows agree, however they are partitioned. Columns that start with two underscores are
    reserved; all others pass through.
    """
    df = df.withColumns({"__g": group_key(strata), "__h": F.xxhash64(F.lit(seed), *identity)})
    rows = df.count()
    r = ranked(df, rows).withColumn("__f", (2 * F.col("__rank") - 1) / (2 * F.col("__n")))
    n = buckets_for(rows)
    r = written(r.withColumn("__b", F.floor(F.col("__f") * n)).drop("__n", "__rank"), "interleave")
    before = exclusive_prefix(r.groupBy("__b").agg(F.count("*").alias("__c")), [], "__b", ["__c"]).select("__b", "__c_before")
    local = F.row_number().over(Window.partitionBy("__b").orderBy("__f", "__g", "__h"))
    r = r.withColumn("__at", local).join(before, "__b").withColumn("__at", F.col("__at") - 1 + F.col("__c_before"))
    r = r.withColumn("__shard", F.expr(f"int(__at * {shards} div {max(rows, 1)})"))
    first = F.expr(f"(__shard * {rows}L + {shards - 1}) div {shards}")
    return r.withColumn("__slot", F.col("__at") - first).drop("__b", "__c_before", "__at", "__f", "__g", "__h")


def op10_interleaved_shards(spark, sf_dir: str) -> DataFrame:
    """All documents in 24 shards by law ``rows``. Null text counts as empty; null source is a source of its own."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", "source", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32")
    )
    d = written(d, "op10")
    out = interleaved_shards(d, F.col("source"), [F.col("doc_id"), F.col("text_crc32"), F.col("size")], 24)
    return out.select(
        "doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), F.col("__shard").alias("shard"), F.col("__slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
