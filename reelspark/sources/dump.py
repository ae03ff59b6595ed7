"""Pages of a wiki from its XML export: names, texts and redirects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "title string, ns int, redirect struct<_title: string>, revision array<struct<text: struct<_VALUE: string>>>"


def read_pages(spark: SparkSession, path: str, namespace: int = 0) -> DataFrame:
    """``page, text, redirect`` of the articles of an export: the text of the last revision, empty where there is none, and the page that
    it refers to, else null. Spark splits large files between pages."""
    p = spark.read.format("xml").option("rowTag", "page").schema(SCHEMA).load(path)
    p = p.filter(F.coalesce("ns", F.lit(0)) == namespace).filter("title is not null")
    text = F.try_element_at("revision", F.lit(-1))["text"]["_VALUE"]
    return p.select(F.col("title").alias("page"), F.coalesce(text, F.lit("")).alias("text"), F.col("redirect._title").alias("redirect"))
