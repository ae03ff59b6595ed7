"""What catalogs say about files: tables of a library, asked between the two votes.

Every look-up is a join against tables that were filled beforehand (see ``sources.cache``); searches are tables of hits or
indexes of names (``operators.search``). A catalog that the library doesn't have says nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.functions import paths
from reelspark.operators import catalogs, wikitext
from reelspark.operators.search import Index, search
from reelspark.plans.cut import cut


@dataclass
class Wiki:
    """hits: ``query, rank, page``, or an index of pages' names; page_ids: ``page, qid``; entities: ``qid, types, year, labels``; links:
    ``page, to_lang, name``; texts: ``page, text``. Hits and pages are those of the title's own language for
    translations, and of the target language for years and episodes (``found`` instead of ``hits``, where it is given)."""

    hits: DataFrame | Index
    page_ids: DataFrame
    entities: DataFrame
    links: DataFrame
    texts: DataFrame
    found: DataFrame | Index | None = None


@dataclass
class Shows:
    """hits: ``query, rank, show_id, name, score``, or an index of shows' names; shows: ``show_id, name, premiered``; episodes: ``show_id,
    season, number, name, type, ord``."""

    hits: DataFrame | Index
    shows: DataFrame
    episodes: DataFrame


@dataclass
class Films:
    """tv_search: ``query, rank, show_id, first_air_date``; tv_episodes: ``show_id, season, number, name, ord``; movie_search: ``query,
    rank, title, original_title, release_date``."""

    tv_search: DataFrame
    tv_episodes: DataFrame
    movie_search: DataFrame


@dataclass
class Library:
    """explicit: the language was asked for, so files whose titles aren't known in it are skipped."""

    language: str = "en"
    wiki: Wiki | None = None
    shows: Shows | None = None
    films: Films | None = None
    explicit: bool = False


#: Tables of a library on disk, a Parquet table each, and which of its parts they make up.
TABLES = {"wiki": ("hits", "page_ids", "entities", "links", "texts"), "shows": ("hits", "shows", "episodes"), "films": ("tv_search", "tv_episodes", "movie_search")}


def library_at(spark: SparkSession, path: str, language: str = "en") -> Library:
    """The library at ``path``: tables ``<part>/<table>.parquet`` of those parts that are there; a part is there if its first table is."""
    kinds = {"wiki": Wiki, "shows": Shows, "films": Films}
    found = {}
    for part, tables in TABLES.items():
        try:
            first = spark.read.parquet(f"{path}/{part}/{tables[0]}.parquet")
        except AnalysisException:
            continue
        found[part] = kinds[part](first, *[spark.read.parquet(f"{path}/{part}/{t}.parquet") for t in tables[1:]])
    return Library(language, **found)


def _pages(hits: DataFrame | Index, queries: DataFrame) -> DataFrame:
    """``query, rank, page`` of ``queries`` (``query``)."""
    if not isinstance(hits, Index):
        return hits
    return search(queries, hits).select("query", "rank", F.col("name").alias("page"))


def translated(files: DataFrame, library: Library) -> DataFrame:
    """files (``file_id, title, is_series, year``; a row may have more) with ``title`` in the library's language, where its
    pages know it; the source is the language that the title's letters show."""
    w = library.wiki
    if w is None:
        return files
    f = files.withColumns({"source_lang": paths.detect_language(F.col("title")), "target_lang": F.lit(library.language), "year": F.nullif("year", F.lit(0))})
    hits = _pages(w.hits, f.select(F.col("title").alias("query")))
    t = catalogs.translations(f.filter("title <> ''"), hits, w.page_ids, w.entities, w.links).select("file_id", "translated")
    out = files.join(t, "file_id", "left").withColumn("title", F.coalesce("translated", "title"))
    return out.select(files.columns)


def wiki_says(asked: DataFrame, library: Library) -> DataFrame:
    """``file_id, title, year, ep_title``: the title as it was asked, the first year of its pages, and the title of its
    episode on the show's pages where season and episode are sure."""
    w = library.wiki
    titles = cut(asked.select("title").filter("title <> ''").distinct())
    queries = titles.select(F.explode(F.array("title", F.concat("title", F.lit(" season 1")), F.concat(F.lit("List of "), "title", F.lit(" episodes")))).alias("query"))
    hits = _pages(w.hits if w.found is None else w.found, queries)
    years = wikitext.show_years(titles, hits, w.texts)
    episodes = wikitext.show_episodes(titles, hits, w.texts)
    at = F.when(F.coalesce("is_special", F.lit(False)), 0).otherwise(F.col("season"))
    numbered = asked.filter(F.col("is_series") & (F.col("episode") != 0) & ~F.coalesce("season_assumed", F.lit(False))).select("file_id", "title", at.alias("season"), F.col("episode").alias("number"))
    found = numbered.join(episodes, ["title", "season", "number"]).select("file_id", "ep_title")
    return asked.select("file_id", "title").join(years, "title", "left").join(found, "file_id", "left").select("file_id", "title", "year", "ep_title")


def found(asked: DataFrame, library: Library) -> dict[str, DataFrame]:
    """By provider: ``file_id, title, year, ep_title``. asked: ``file_id, title, is_series, is_special, season, episode, year, ep_title,
    season_assumed``."""
    out, a = {}, asked.withColumn("year", F.coalesce("year", F.lit(0)))
    if library.wiki is not None:
        out["wikipedia"] = wiki_says(a, library)
    if library.shows is not None:
        s = library.shows
        hits = s.hits if not isinstance(s.hits, Index) else catalogs.show_hits(a.select("title"), s.hits)
        out["tvmaze"] = catalogs.enriched_series(a, hits, s.shows, s.episodes)
    if library.films is not None:
        out["tmdb"] = catalogs.enriched(a, library.films.tv_search, library.films.tv_episodes, library.films.movie_search)
    return {k: v.select("file_id", "title", "year", "ep_title") for k, v in out.items()}


def identified(parsed: DataFrame, library: Library) -> DataFrame:
    """A call of its own for identities (rows of ``evidence.parsed``): their titles in the library's language, then what the
    shows of the library know of them."""
    p = translated(parsed, library)
    if library.shows is None:
        return p
    says = found(p.withColumn("season_assumed", F.lit(False)), replace(library, wiki=None, films=None))["tvmaze"]
    says = says.select("file_id", *[F.col(c).alias(f"__{c}") for c in ("title", "year", "ep_title")])
    j = p.join(says, "file_id", "left")
    return j.withColumns({c: F.coalesce(F.nullif(F.col(f"__{c}").cast(dict(p.dtypes)[c]), F.lit(0 if c == "year" else "").cast(dict(p.dtypes)[c])), c) for c in ("title", "year", "ep_title")}).select(p.columns)
