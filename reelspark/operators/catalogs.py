"""Look-ups in catalogs, all of them joins against tables; nothing is fetched inside a transformation.

Catalogs are tables of any size: Spark broadcasts those that are small and shuffles the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspark.functions import fixed as X
from reelspark.functions.base import cut, hit
from reelspark.operators.search import Index, search


def key_title(c: Column) -> Column:
    """Letters a-z and digits only, in lower case."""
    return cut(F.lower(c), r"[^a-z0-9]")


def without_disambiguation(title: Column) -> Column:
    clean = F.trim(cut(title, X.DISAMBIGUATION))
    return F.when(clean == "", title).otherwise(clean)


def search_variants(title: Column) -> Column:
    """Queries for a title, from the least to the most normalised, without repeats."""
    s = F.trim(title)
    plain = F.trim(cut(cut(s, r"[\p{Punct}]"), X.U + r"\s+", " "))
    no_article, no_tail = F.trim(cut(s, X.LEADING_ARTICLE)), F.trim(cut(s, X.TRAILING_GENERIC))
    return F.array_distinct(F.filter(F.array(title, s, plain, no_article, no_tail), lambda v: F.coalesce(v != "", F.lit(False))))


def search_shows(titles: DataFrame, hits: DataFrame) -> DataFrame:
    """``title, show_id``: by the first variant that hits. hits: ``query, rank, show_id, name, score``.

    For a variant, a hit of just that name wins, else its first hit if the score is high enough.
    """
    v = titles.select("title").distinct().select("title", F.posexplode(search_variants(F.col("title"))).alias("variant", "query"))
    exact = F.lower("name") == F.lower("query")
    j = v.join(hits, "query").filter(exact | ((F.col("rank") == 1) & (F.col("score") >= X.MIN_SHOW_SCORE)))
    return j.groupBy("title").agg(F.min_by("show_id", F.struct("variant", (~exact).alias("inexact"), "rank")).alias("show_id"))


def show_hits(titles: DataFrame, index: Index, k: int = 10) -> DataFrame:
    """``query, rank, show_id, name, score`` for ``search_shows``: the best k shows of an index of their names for every
    variant of the titles."""
    asked = titles.select("title").distinct().select(F.explode(search_variants(F.col("title"))).alias("query"))
    return search(asked, index, k).withColumnRenamed("id", "show_id")


def page_hits(titles: DataFrame, index: Index) -> DataFrame:
    """``query, rank, page`` for ``translations`` and ``synonyms``: the first pages of an index of pages' names."""
    return search(titles.select(F.col("title").alias("query")), index, X.SEARCH_HITS).select("query", "rank", F.col("name").alias("page"))


def episode_titles(files: DataFrame, episodes: DataFrame) -> DataFrame:
    """files (``show_id, season, episode``) with ``ep_title``: the first entry of that number, even if unnamed."""
    first = episodes.groupBy("show_id", "season", "number").agg(F.min_by("name", "ord").alias("ep_title"))
    return files.join(first.withColumnRenamed("number", "episode"), ["show_id", "season", "episode"], "left")


def special_titles(files: DataFrame, episodes: DataFrame) -> DataFrame:
    """files (``show_id, episode``) with ``ep_title`` of the show's episode-th entry that isn't a regular one."""
    w = Window.partitionBy("show_id").orderBy("ord")
    s = episodes.filter("type <> 'regular'").select("show_id", F.row_number().over(w).alias("episode"), F.col("name").alias("ep_title"))
    return files.join(s, ["show_id", "episode"], "left")


def first_wins(episodes: DataFrame, keys: tuple[str, ...] = ("season", "number"), order: str = "ord") -> DataFrame:
    """The first row of each key by ``order``."""
    rest = [c for c in episodes.columns if c not in keys]
    return episodes.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def fresh(cached: DataFrame, now: Column, days: int = X.CACHE_DAYS) -> DataFrame:
    """Entries that are younger than ``days``."""
    return cached.filter(F.col("cached_at") >= now - F.expr(f"interval {days} days"))


def misses(wanted: DataFrame, cached: DataFrame, keys: list[str]) -> DataFrame:
    """Keys to look up elsewhere: those that the cache doesn't hold."""
    return wanted.select(*keys).distinct().join(cached.select(*keys).distinct(), keys, "left_anti")


def synonyms(titles: DataFrame, pages: DataFrame, page_ids: DataFrame) -> DataFrame:
    """``title, qid``: title to page (``query, page``, rank 1) to entity (``page, qid``); nulls where unknown."""
    t = titles.select("title").distinct().join(pages.filter("rank = 1").select(F.col("query").alias("title"), "page"), "title", "left")
    return t.join(page_ids, "page", "left").select("title", "qid")


def translations(files: DataFrame, hits: DataFrame, page_ids: DataFrame, entities: DataFrame, links: DataFrame) -> DataFrame:
    """files (``file_id, title, is_series, year, source_lang, target_lang``) with ``translated``: the target-language
    title of the best search hit that is a work of the right kind and year; the title itself if there is none.

    hits: ``query, rank, page``; page_ids: ``page, qid``; entities: ``qid, types, year, labels``; links: ``page, to_lang, name``.
    """
    f = files.select("file_id", "title", "is_series", "year", "source_lang", "target_lang")
    c = f.filter(~F.col("source_lang").eqNullSafe(F.col("target_lang"))).join(hits.filter(F.col("rank") <= X.SEARCH_HITS).withColumnRenamed("query", "title"), "title")
    c = c.join(page_ids, "page").join(entities.withColumnRenamed("year", "entity_year"), "qid")
    c = c.join(links.withColumnRenamed("to_lang", "target_lang"), ["page", "target_lang"], "left")
    types = lambda *groups: F.arrays_overlap("types", F.array(*[F.lit(t) for g in groups for t in g]))
    right = types(X.FILM_TYPES, X.SERIES_TYPES, X.WORK_TYPES) & F.when(F.col("is_series").isNull(), True).when(F.col("is_series"), types(X.SERIES_TYPES)).otherwise(types(X.FILM_TYPES))
    exact = key_title(F.col("page")) == key_title(F.col("title"))
    in_year = F.abs(F.col("entity_year") - F.col("year")) <= 1
    trusted = F.when(F.col("year").isNotNull(), F.coalesce(in_year, F.lit(False))).when(F.col("rank") == 1, True).otherwise(F.when(F.col("source_lang").isNull(), exact).otherwise(F.coalesce("is_series", F.lit(False))))
    name = F.coalesce("name", F.element_at("labels", F.col("target_lang")))
    best = c.filter(right & trusted & name.isNotNull()).groupBy("file_id").agg(F.min_by(name, "rank").alias("found"))
    return files.join(best, "file_id", "left").withColumn("translated", F.coalesce(without_disambiguation(F.col("found")), F.col("title"))).drop("found")


def is_known_language(codes: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of ``codes`` whose ``lang`` is in ``known`` (``lang``), case-sensitive."""
    return codes.join(known.select("lang").distinct(), "lang", "left_semi")


def numbered_placeholder(title: Column) -> Column:
    return hit(title, X.NUMBERED_EPISODE)


def _year(date: Column) -> Column:
    return F.when(F.length(date) >= 4, F.substring(date, 1, 4).try_cast("int"))


def _or_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def tv_query(title: Column) -> Column:
    """A show's name as it is searched for: without years, unless nothing else is left."""
    bare = F.trim(cut(cut(title, r"\b(?:19|20)\d{2}\b"), X.U + r"\s+", " "))
    return F.when(bare == "", title).otherwise(bare)


def season_titles(files: DataFrame, tv_search: DataFrame, tv_episodes: DataFrame) -> DataFrame:
    """files (``title, season, episode``) with ``ep_title`` from the first show that the title finds; entries without a
    number or a name don't count, and of several the last does.

    tv_search: ``query, rank, show_id``; tv_episodes: ``show_id, season, number, name, ord``.
    """
    name = F.trim("name")
    e = tv_episodes.filter((F.col("number") != 0) & (name != "")).groupBy("show_id", "season", F.col("number").alias("episode")).agg(F.max_by(name, "ord").alias("ep_title"))
    first = tv_search.filter("rank = 1").select(F.col("query").alias("__query"), "show_id")
    return files.withColumn("__query", tv_query(F.col("title"))).join(first, "__query", "left").join(e, ["show_id", "season", "episode"], "left").drop("__query", "show_id")


def films(titles: DataFrame, movie_search: DataFrame) -> DataFrame:
    """``title, found, year`` for titles that a film search (``query, rank, title, original_title, release_date``) finds."""
    first = movie_search.filter("rank = 1").select(F.col("query").alias("q"), F.coalesce(_or_null(F.col("title")), _or_null(F.col("original_title"))).alias("found"), _year(F.col("release_date")).alias("year"))
    return titles.select("title").distinct().join(first, F.col("title") == F.col("q")).select("title", "found", "year")


def years(titles: DataFrame, tv_search: DataFrame, movie_search: DataFrame) -> DataFrame:
    """``title, year``: of the first show that a search finds, else of the first film; null without either.

    tv_search: ``query, rank, first_air_date``.
    """
    t = titles.select("title").distinct()
    show = tv_search.filter("rank = 1").select(F.col("query").alias("title"), _year(F.col("first_air_date")).alias("show_year"))
    film = films(t, movie_search).select("title", F.col("year").alias("film_year"))
    return t.join(show, "title", "left").join(film, "title", "left").select("title", F.coalesce("show_year", "film_year").alias("year"))


def show_facts(titles: DataFrame, hits: DataFrame, shows: DataFrame) -> DataFrame:
    """``title, show_id, name, year`` of the show that each title finds (see ``search_shows``); shows: ``show_id, name,
    premiered``."""
    facts = shows.select("show_id", "name", _year(F.col("premiered")).alias("year"))
    return search_shows(titles, hits).join(facts, "show_id", "left").select("title", "show_id", "name", "year")


def enriched(files: DataFrame, tv_search: DataFrame, tv_episodes: DataFrame, movie_search: DataFrame) -> DataFrame:
    """files (``title, is_series, season, episode, year, ep_title``; a row may have more) with what the searches know: for
    a series' episode its title, for others the film's title, and its year where the file has none."""
    cols = files.columns
    f = season_titles(files.withColumnRenamed("ep_title", "__old"), tv_search, tv_episodes)
    numbered = F.col("is_series") & (F.col("season") != 0) & (F.col("episode") != 0)
    f = f.withColumn("ep_title", F.when(F.coalesce(numbered, F.lit(False)), F.coalesce("ep_title", "__old")).otherwise(F.col("__old")))
    film = ~F.coalesce("is_series", F.lit(False))
    of = films(files, movie_search).select("title", F.col("found").alias("__found"))
    f = f.join(of, "title", "left").join(years(files, tv_search, movie_search).withColumnRenamed("year", "__year"), "title", "left")
    f = f.withColumn("year", F.when(film, F.coalesce(F.nullif(F.col("year"), F.lit(0)), "__year", "year")).otherwise(F.col("year")))
    return f.withColumn("title", F.when(film, F.coalesce("__found", "title")).otherwise(F.col("title"))).select(cols)


def enriched_series(files: DataFrame, hits: DataFrame, shows: DataFrame, episodes: DataFrame, keep_titles: bool = False) -> DataFrame:
    """files (``file_id, title, is_series, is_special, season, episode, year, ep_title``; a row may have more) with the
    name, year and episode title of the show that is found; specials by their rank among the show's specials.

    Files that aren't numbered episodes, and shows without regular episodes, change nothing; with ``keep_titles`` nor
    do files that have an episode title.
    """
    asks = F.col("is_series") & F.col("season").isNotNull() & (F.col("episode") != 0) & (F.col("title") != "")
    asks = F.coalesce(asks & (F.coalesce("ep_title", F.lit("")) == "" if keep_titles else F.lit(True)), F.lit(False))
    regular = episodes.filter("type = 'regular'")
    facts = show_facts(files.filter(asks), hits, shows).join(regular.select("show_id").distinct(), "show_id", "left_semi")
    f = files.withColumn("__asks", asks).join(facts.select("title", "show_id", F.col("name").alias("__name"), F.col("year").alias("__year")), "title", "left")
    f = episode_titles(f.withColumnRenamed("ep_title", "__old"), regular).withColumnRenamed("ep_title", "__regular")
    f = special_titles(f, episodes).withColumnRenamed("ep_title", "__special")
    found = F.col("__asks") & F.col("show_id").isNotNull()
    title = F.when(F.coalesce(F.col("is_special"), F.lit(False)), F.col("__special")).otherwise(F.col("__regular"))
    other = found & (F.coalesce("__name", F.lit("")) != "") & (F.lower("__name") != F.lower("title"))
    f = f.withColumns({
        "ep_title": F.when(found, F.coalesce(_or_null(title), "__old")).otherwise(F.col("__old")), "year": F.when(found, F.coalesce("__year", "year")).otherwise(F.col("year")),
        "title": F.when(other, F.col("__name")).otherwise(F.col("title")),
    })
    return f.select(files.columns)
