"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and returns a DataFrame.

All but the last return the columns of ``documents``. Each stage's result is written and read again before the next,
so that a lost executor costs a stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.llm._common import written
from reelspark.llm.langid import fold, identify, train_languages
from reelspark.llm.line_dedup import drop_repeated_lines
from reelspark.llm.mixing import curriculum, in_order, word_count
from reelspark.llm.ngram_join import one_of_each
from reelspark.llm.packing import pack_sequences


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known stay: those without a letter (null and empty texts too), and those that no model
    explains, go. Rows are judged one by one, so repeated rows share their fate and ids may be null; a null lang isn't learnt
    from. Texts count whole. Without a labelled row nothing is known and no row stays; an empty table stays empty."""
    models = train_languages(docs.select("doc_id", "text", "lang").filter(F.coalesce(fold() != 1, F.lit(True))))
    return identify(docs, models).filter("not __rejected").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 or more code points that three or more documents share stay in the last of them only. No document
    goes here, not even one that is left empty; ``n_chars`` follows the text. Rows with a null text or doc_id stay as they are, rows
    of one doc_id are one document, and an empty table stays empty; texts of any length are split whole."""
    out = drop_repeated_lines(docs)
    return out.withColumn("n_chars", F.when(F.col("__dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest doc_id: five words, 0.8 or more. Rows without a doc_id
    or without words are no copies and stay; rows that repeat a doc_id stay or go together; an empty table stays empty."""
    return one_of_each(docs, k=5, num=4, den=5)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their weights, in training order. Documents are taken whole, some not at all and some twice; those without
    words (null texts too) never. A null source is one of its own, after all others; a null doc_id is like any other;
    repeated rows are interchangeable; an empty table stays empty."""
    size = word_count(F.col("text"))
    mixed = curriculum(docs, size, F.col("source"), [F.col("doc_id"), F.xxhash64("text")], whole=True)
    return in_order(mixed).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens. A null text is its end id; repeated rows, and those
    without a doc_id, are packed as often as they come; long texts are cut; an empty table gives no pieces."""
    import public_tokenizers

    return pack_sequences(docs, public_tokenizers.path("word_bpe_49k.json"), 2)


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("mixture", mixture), ("packing", packing)]

#: Language models, hashes of near copies and token ids are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
