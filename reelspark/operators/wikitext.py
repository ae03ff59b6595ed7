"""Episodes, years and titles from wikitext."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelspark.functions import fixed as X
from reelspark.functions.base import cut, group, hit, number
from reelspark.plans.cut import cut as cut_lineage


@F.pandas_udf(T.StringType())
def unescape(c: pd.Series) -> pd.Series:
    """HTML entities as characters; Spark has no full table of them."""
    return c.map(html.unescape, na_action="ignore")


def clean_wiki_title(raw: Column) -> Column:
    """Entities, references, links, the templates that hold a title, all other templates and quotes, in this order."""
    t = unescape(raw)
    for pattern in X.WIKI_REFERENCES:
        t = cut(t, pattern)
    for pattern in (X.WIKI_LINK, *X.WIKI_TITLE_TEMPLATES):
        t = F.regexp_replace(t, pattern, "$1")
    t = cut(cut(t, X.WIKI_TEMPLATE), "''+")
    t = F.replace(cut(t, "&nbsp;", " "), F.lit("\u200b"), F.lit(""))
    return cut(F.trim(cut(t, X.U + r"\s+", " ")), r'^"+|"+$')


def season_of_page(page: Column) -> Column:
    n = number(group(page, X.I + r"(?:season|series|saison|temporada|part|volume)\s*(\d{1,2})"))
    return F.when(n.between(1, 99), n)


def asof_heading(lines: DataFrame) -> DataFrame:
    """lines (``page, pos, heading``) with ``last_heading``: the nearest heading at or before a line."""
    w = Window.partitionBy("page").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("last_heading", F.last("heading", ignorenulls=True).over(w))


def episodes(pages: DataFrame) -> DataFrame:
    """``page, ord, season, number, title`` of the episode templates in pages (``page, text``; optional ``season``, the
    season that a page is known to hold).

    An episode's season is 0 under a heading of specials, else the heading's number, else the page's, else 1. Blocks
    without a number, and titles of less than two characters, give nothing.
    """
    found = F.regexp_extract_all("text", F.lit(X.WIKI_HEADING_OR_EPISODE), F.lit(0))
    season = F.coalesce(F.col("season").cast("int") if "season" in pages.columns else season_of_page(F.col("page")), F.lit(1))
    parts = pages.select("page", season.alias("default"), F.posexplode(found).alias("pos", "part"))
    block = F.col("part").startswith("{{")
    b = asof_heading(parts.withColumn("heading", F.when(~block, F.regexp_extract("part", X.WIKI_HEADING, 1)))).filter(block)
    number_of = lambda name: number(group(F.col("part"), X.U + rf"\|\s*{name}\s*=\s*(\d{{1,3}})"))
    title_of = lambda name: group(F.col("part"), X.U + rf"(?s)\|\s*{name}\s*=\s*(.+?)(?=\n\s*\||\n\}}\}}\z)")
    heading = F.coalesce("last_heading", F.lit(""))
    season = F.when(hit(heading, X.WIKI_SPECIALS), 0).otherwise(F.coalesce(season_of_page(heading), "default"))
    title = clean_wiki_title(F.coalesce(title_of("Title"), title_of("TranslitTitle")))
    n = F.coalesce(number_of("EpisodeNumber2"), number_of("EpisodeNumber"))
    return b.select("page", F.col("pos").alias("ord"), season.alias("season"), n.alias("number"), title.alias("title")).filter("number is not null and length(title) >= 2")


def season_pages(lists: DataFrame) -> DataFrame:
    """``title, page, season, ord`` of the season pages that list pages (``title, page, text``) include or refer to, each
    where it is first mentioned; a list without any stands for itself, its season unknown."""
    names = F.concat(*[F.transform(F.regexp_extract_all("text", F.lit(p), F.lit(1)), F.trim) for p in X.WIKI_SEASON_PAGES])
    each = lists.select("title", "page", F.posexplode_outer(names).alias("ord", "name"))
    each = each.withColumn("season", season_of_page(F.col("name")))
    first = each.filter("season is not null").groupBy("title", "name", "season").agg(F.min("ord").alias("ord"))
    first = first.select("title", F.col("name").alias("page"), "season", "ord")
    own = lists.join(first.select("title").distinct(), "title", "left_anti")
    return first.unionByName(own.select("title", "page", F.lit(None).cast("int").alias("season"), F.lit(0).alias("ord")))


def show_episodes(shows: DataFrame, search: DataFrame, texts: DataFrame) -> DataFrame:
    """``title, season, number, ep_title`` for shows (``title``): from the list page of a show and the season pages that it
    names, else from the page found for its first season; the first page that has an episode wins.

    search: ``query, rank, page``; texts: ``page, text``.
    """
    first = search.filter("rank = 1").select("query", "page")
    t = shows.select("title").filter("title <> ''").distinct()
    asked = t.select("title", F.concat(F.lit("List of "), "title", F.lit(" episodes")).alias("query")).join(first, "query").select("title", "page")
    lists = asked.join(texts, "page", "left").withColumn("text", F.coalesce("text", F.lit("")))
    pages = season_pages(lists)
    rest = t.join(asked.select("title"), "title", "left_anti").select("title", F.concat("title", F.lit(" season 1")).alias("query")).join(first, "query")
    rest = rest.withColumn("season", season_of_page(F.col("page"))).filter("season is not null").select("title", "page", "season", F.lit(0).alias("ord"))
    pages = pages.unionByName(rest).select("title", F.col("page").alias("name"), "season", F.col("ord").alias("page_ord"))
    held = pages.join(texts.withColumnRenamed("page", "name"), "name")
    # a page may serve several shows: parsed once for each, under a name of both
    e = episodes(held.select(F.struct("title", "page_ord").alias("page"), "text", "season"))
    e = e.select("page.title", "season", "number", F.struct("page.page_ord", "ord").alias("at"), F.col("title").alias("ep_title"))
    return e.groupBy("title", "season", "number").agg(F.min_by("ep_title", "at").alias("ep_title"))


def first_year(pages: DataFrame) -> DataFrame:
    """``title, year``: the least year of all date fields of a title's pages (``title, page, text``)."""
    dates = F.regexp_extract_all("text", F.lit(X.WIKI_DATE_FIELD), F.lit(0))
    years = pages.select("title", F.explode(dates).alias("d")).select("title", F.regexp_extract("d", r"(?:19|20)\d{2}", 0).alias("y"))
    return years.groupBy("title").agg(F.min(F.col("y").cast("int")).alias("year"))


def redirected(redirects: DataFrame) -> DataFrame:
    """``page, target``: where redirects (``page, target``, a page once) lead in the end. Pages that lead into a circle lead nowhere.

    Pointers double: each round halves every page's way, and what isn't done after as many rounds as the longest way could
    need is a circle.
    """
    r = redirects.filter("page is not null and target is not null")
    more = r.select(F.col("page").alias("target"), F.lit(True).alias("more")).distinct()
    p = cut_lineage(r.join(more, "target", "left").select("page", "target", F.col("more").isNull().alias("done")))
    going, rounds = p.filter("not done").count(), 0
    while going and rounds <= going.bit_length():
        far = p.select(F.col("page").alias("target"), F.col("target").alias("far"), F.col("done").alias("far_done"))
        p = cut_lineage(p.join(far, "target", "left").select("page", F.when(F.col("done"), F.col("target")).otherwise(F.col("far")).alias("target"), (F.col("done") | F.col("far_done")).alias("done")))
        rounds += 1
    return p.filter("done").select("page", "target")


def followed(pages: DataFrame) -> DataFrame:
    """``page, text`` of pages (``page, text, redirect``; see ``sources.dump``): a redirect has the text of the page that it leads to
    in the end; one that leads nowhere is left out."""
    own = pages.filter("redirect is null").select("page", "text")
    to = redirected(pages.filter("redirect is not null").select("page", F.col("redirect").alias("target")))
    return own.unionByName(to.join(own.withColumnRenamed("page", "target"), "target").select("page", "text"))


def show_years(shows: DataFrame, search: DataFrame, texts: DataFrame) -> DataFrame:
    """``title, year`` of shows (``title``): the first year on the pages of its first season, its own name, and that name as a
    series or anime; where none of them has one, on the page that a search for the title finds (``query, rank, page``)."""
    t = shows.select("title").filter("title <> ''").distinct()
    names = F.array(F.concat("title", F.lit(" season 1")), "title", F.concat("title", F.lit(" (TV series)")), F.concat("title", F.lit(" (anime)")))
    own = first_year(t.select("title", F.explode(names).alias("page")).join(texts, "page"))
    rest = t.join(own, "title", "left_anti").join(search.filter("rank = 1").select(F.col("query").alias("title"), "page"), "title")
    return own.unionByName(first_year(rest.join(texts, "page")))
