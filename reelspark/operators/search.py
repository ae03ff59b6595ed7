r"""Ranked search for titles: an inverted index, and the best k titles of each query by upper bounds of scores.

A title's score for a query is the sum of its impacts for the query's words, as whole numbers, so that sums are exact
and ties are ties: ``weight * 22 tf total div (10 tf total + 3 total + 9 length n)``, which is BM25 with k1 = 1.2 and
b = 0.75, for a word found tf times in a title of ``length`` words, among n titles of ``total`` words; ``weight`` is
``floor(1000 ln(1 + (n - df + 0.5) / (df + 0.5)))``. Equal scores go to the smaller id.

Titles of the same words, in any order, are one entry with the number of them; its first ids are looked up at the end, so
copies cost nothing. Queries that hold the same known words are asked once.

The index holds each word's postings in blocks of bounded size by falling impact, with the largest impact of each. A
posting carries its entry's impacts, so a block scores its entries by itself. The leading blocks of a query's rarest word,
and of its two rarest words together, give a score that the k-th best hit reaches at least. A word whose largest
impact reaches that score alone is looked up by itself; every other hit has two of the query's words at least, and the two
that weigh most of all that it has are looked up as a pair, if with all lighter words they can reach it. Pairs are put into
blocks for the search that asks for them; that takes a row for each two words of a title. Blocks that can't reach the score are
not read. Nothing is approximate: a title that is left out scores less than k others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspark.operators.joins import frequent_join
from reelspark.plans.cut import cut

#: Postings of a block; blocks of a word that one task reads, and queries of a word that one task asks, about.
BLOCK, BLOCKS, QUERIES = 256, 64, 100_000


def words(text: Column) -> Column:
    """The words of a text in lower case, in order: letters and digits of any script."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


@dataclass
class Index:
    """``titles``: id, name, ``bag`` (their words in alphabetical order) and the ``place`` among some titles of the bag. ``docs``: a row a bag,
    with its least ``id``, number of titles ``n`` and ``impacts``. ``terms``: a row a word with its ``weight``, largest impact ``best`` and
    the ``lead`` block. ``blocks``: term, block, top, entries. ``unknown``: the weight of a word that no title has."""

    titles: DataFrame
    docs: DataFrame
    terms: DataFrame
    blocks: DataFrame
    unknown: int


def _weight(n: int, df: Column) -> Column:
    return F.floor(F.lit(1000.0) * F.log(F.lit(1.0) + (F.lit(float(n)) - df + 0.5) / (df + 0.5)))


def _blocks(posted: DataFrame, block: int) -> DataFrame:
    """``term, block, top, entries`` of postings (``term, impact, id, n, impacts``)."""
    posted = cut(posted.repartitionByRange("term", F.desc("impact"), "id").withColumn("part", F.spark_partition_id()))
    place = F.row_number().over(Window.partitionBy("term", "part").orderBy(F.desc("impact"), "id")) - 1
    posted = posted.withColumn("block", F.struct("part", F.floor(place / block).alias("number")))
    return cut(posted.groupBy("term", "block").agg(F.max("impact").alias("top"), F.collect_list(F.struct("id", "n", "impacts")).alias("entries")))


def build_index(titles: DataFrame, block: int = BLOCK) -> Index:
    """An index of ``titles`` (``id`` long, each once, and ``name``). Titles without words are never found."""
    t = titles.select(F.col("id").cast("long").alias("id"), "name", F.array_join(F.array_sort(words(F.col("name"))), " ").alias("bag")).filter("bag <> ''")
    t = cut(t.repartitionByRange("bag", "id").withColumn("part", F.spark_partition_id()))  # a bag may hold a large part of all titles
    place = F.row_number().over(Window.partitionBy("bag", "part").orderBy("id")) - 1
    each = cut(t.groupBy("bag").agg(F.min("id").alias("id"), F.count("*").alias("n"))).select("id", "n", F.split("bag", " ").alias("w"))
    n, total = each.agg(F.sum("n"), F.sum(F.col("n") * F.size("w"))).first()
    n, total = n or 0, total or 0
    tf = F.aggregate("w", F.lit(0).cast("long"), lambda s, x: s + (x == F.col("term")).cast("long"))
    p = each.select("id", "n", "w", F.explode(F.array_distinct("w")).alias("term")).select("id", "n", "term", F.size("w").cast("long").alias("length"), tf.alias("tf"))
    p = cut(p)
    weights = p.groupBy("term").agg(_weight(n, F.sum("n")).alias("weight"))
    impact = F.expr(f"weight * tf * 22 * {total}L div (10 * tf * {total}L + 3 * {total}L + 9 * length * {n}L)")
    docs = cut(frequent_join(p, weights, ["term"]).groupBy("id", "n").agg(F.map_from_entries(F.collect_list(F.struct("term", impact.alias("impact")))).alias("impacts")))
    blocks = _blocks(docs.select("id", "n", "impacts", F.explode("impacts").alias("term", "impact")), block)
    terms = blocks.groupBy("term").agg(F.max("top").alias("best"), F.min("block").alias("lead"))
    terms = cut(terms.join(weights, "term"))
    unknown = t.sparkSession.range(1).select(_weight(n, F.lit(0.0))).first()[0]
    return Index(t.withColumn("place", place).drop("part"), docs, terms, blocks, unknown)


def _pair(a: Column, b: Column) -> Column:
    """A key of two words, which no word is."""
    return F.concat(F.least(a, b), F.lit(" "), F.greatest(a, b))


def _pairs(index: Index, asked: DataFrame) -> DataFrame:
    """Blocks of the pairs of words that are ``asked`` for (``term``)."""
    held = F.array_sort(F.map_keys("impacts"))
    two = F.flatten(F.transform(held, lambda a, i: F.transform(F.slice(held, i + 2, F.size(held)), lambda b: F.struct(_pair(a, b).alias("term"), (F.element_at("impacts", a) + F.element_at("impacts", b)).alias("impact")))))
    d = index.docs.select("id", "n", "impacts", F.explode(two).alias("p")).select("id", "n", "impacts", "p.*")
    return _blocks(d.join(asked.select("term").distinct(), "term", "left_semi"), BLOCK)


def _scored(entries: Column, terms: Column) -> Column:
    """(score, id, number of titles, position) of each entry for the query's known words."""

    def score(e: Column, i: Column) -> Column:
        total = F.aggregate(terms, F.lit(0).cast("long"), lambda s, t: s + F.coalesce(F.try_element_at(e["impacts"], t["term"]), F.lit(0).cast("long")))
        return F.struct((-total).alias("minus"), e["id"].alias("id"), e["n"].alias("n"), (i + 1).alias("at"))

    return F.transform(entries, score)


def _reached(entries: Column, terms: Column, k: int) -> Column:
    """The score that k titles of the entries reach; null if there are fewer."""
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("minus"))
    upto = F.aggregate(F.array_sort(_scored(entries, terms)), none, lambda s, e: F.when(s["n"] >= k, s).otherwise(F.struct((s["n"] + e["n"]).alias("n"), e["minus"].alias("minus"))))
    return F.when(upto["n"] >= k, -upto["minus"])


def search(queries: DataFrame, index: Index, k: int = 3) -> DataFrame:
    """``query, rank, id, name, score`` of the best k titles for each different ``query``; queries without a known word have
    no row. ``score`` is the part of the query's weight that the title's words make up, from 0 to 1."""
    zero = F.lit(0).cast("long")
    q = queries.select("query").distinct().select("query", F.explode(F.array_distinct(words(F.col("query")))).alias("term"))
    q = frequent_join(q, index.terms, ["term"], "left").withColumn("weight", F.coalesce("weight", F.lit(index.unknown)))
    mine = F.collect_list(F.when(F.col("best").isNotNull(), F.struct("best", "term", "weight", "lead")))
    q = q.groupBy("query").agg(F.sort_array(mine).alias("terms"), F.sum("weight").alias("weight")).filter(F.size("terms") > 0)
    q = cut(q.withColumn("asks", F.array_join(F.transform("terms", lambda t: t["term"]), " ")))
    upto = F.transform("terms", lambda t, i: F.aggregate(F.slice("terms", F.lit(1), i + 1), zero, lambda s, t: s + t["best"]))  # words are sorted by ``best``
    a = q.groupBy("asks").agg(F.first("terms").alias("terms")).withColumn("upto", upto)
    last, other = F.element_at("terms", -1), F.try_element_at("terms", F.lit(-2))
    a = cut(a.withColumns({"term": last["term"], "block": last["lead"], "pair": _pair(last["term"], other["term"])}))

    one = frequent_join(a.select("asks", "terms", "term", "block"), index.blocks.select("term", "block", "entries"), ["term", "block"])
    two = _pairs(index, a.select(F.col("pair").alias("term")))
    lead = two.groupBy("term").agg(F.min("block").alias("block"))
    two = lead.join(two, ["term", "block"]).select(F.col("term").alias("pair"), "entries")
    two = frequent_join(a.select("asks", "terms", "pair"), two, ["pair"])
    seen = one.select("asks", "terms", "entries").unionByName(two.select("asks", "terms", "entries"))
    floor = seen.select("asks", _reached(F.col("entries"), F.col("terms"), k).alias("floor")).groupBy("asks").agg(F.greatest(F.lit(1).cast("long"), F.coalesce(F.max("floor"), zero)).alias("floor"))
    a = a.select("asks", "terms", "upto").join(floor, "asks")

    def needs(t: Column, j: Column) -> Column:
        """(word or pair, the least impact that helps) for hits whose heaviest word is t."""
        below = lambda x, i: F.col("floor") - F.element_at("upto", i + 1) + x["best"]
        whole = F.array(F.struct(t["term"].alias("term"), below(t, j).alias("least")))
        able = lambda x, i: F.when(t["best"] + F.element_at("upto", i + 1) >= F.col("floor"), F.struct(_pair(x["term"], t["term"]).alias("term"), below(x, i).alias("least")))
        return F.when(t["best"] >= F.col("floor"), whole).otherwise(F.array_compact(F.transform(F.slice("terms", F.lit(1), j), able)))

    a = cut(a.select("asks", "terms", "floor", F.explode(F.flatten(F.transform("terms", needs))).alias("need")).select("asks", "terms", "floor", "need.*"))
    blocks = index.blocks.unionByName(_pairs(index, a.select("term")))
    sizes = blocks.groupBy("term").agg(F.count("*").alias("blocks"))
    known = cut(sizes.join(a.groupBy("term").agg(F.count("*").alias("queries")), "term"))
    rows, cols = F.ceil(F.col("blocks") / BLOCKS), F.ceil(F.col("queries") / QUERIES)  # a word's blocks and queries meet in a grid of tasks
    a = frequent_join(a, known, ["term"]).select("asks", "terms", "floor", "term", "least", F.explode(F.sequence(F.lit(0), rows - 1)).alias("r"), F.pmod(F.xxhash64("asks"), cols).alias("c"))
    b = frequent_join(blocks, known, ["term"])
    b = b.select("term", "top", "entries", F.pmod(F.xxhash64("block"), rows).alias("r"), F.explode(F.sequence(F.lit(0), cols - 1)).alias("c"))
    j = a.join(b, ["term", "r", "c"]).filter(F.col("top") >= F.col("least"))
    best = F.slice(F.array_sort(F.filter(_scored(F.col("entries"), F.col("terms")), lambda e: -e["minus"] >= F.col("floor"))), 1, k)
    matched = lambda e: F.aggregate("terms", zero, lambda s, t: s + F.when(F.coalesce(F.try_element_at(F.element_at("entries", e["at"])["impacts"], t["term"]), zero) > 0, t["weight"]).otherwise(0))
    found = j.select("asks", F.explode(F.transform(best, lambda e: F.struct(e["minus"].alias("minus"), e["id"].alias("doc"), matched(e).alias("matched")))).alias("e")).select("asks", "e.*").distinct()
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("asks").orderBy("minus", "doc"))).filter(F.col("rank") <= k).drop("rank")

    few = F.slice(F.array_sort(F.collect_list(F.struct("id", "name"))), 1, k)  # the k first titles of each range of a bag
    few = index.titles.filter(F.col("place") < k).groupBy("bag").agg(few.alias("few")).select(F.col("few")[0]["id"].alias("doc"), "few")
    hits = frequent_join(found, few, ["doc"]).select("asks", "minus", "matched", F.inline("few"))
    hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("asks").orderBy("minus", "id"))).filter(F.col("rank") <= k)
    return q.select("query", "asks", "weight").join(hits, "asks").select("query", "rank", "id", "name", (F.col("matched") / F.col("weight")).alias("score"))
