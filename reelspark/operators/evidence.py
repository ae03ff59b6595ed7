"""Evidence as rows: what each provider says about each field of a file, and how sure it is."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.functions import fixed as X
from reelspark.functions import media, names, paths, quality
from reelspark.plans.cut import spread


def parsed(files: DataFrame) -> DataFrame:
    """files (``file_id, path``) with the fields that a name gives, a row a file."""
    name = names.basename(F.col("path"))
    p = spread(files).select("*", name.alias("basename"))
    p = p.select("*", names.season_episode(F.col("basename")).alias("se"), quality.quality(F.col("basename")).alias("q"), names.is_special(F.col("basename")).alias("is_special"), names.title_before_marker(F.col("basename")).alias("title"))
    return p.select(
        *files.columns, "basename", "title", names.dotted(F.col("title")).alias("dot_title"), names.dotted(F.col("q.label")).alias("dot_quality"), "is_special",
        F.col("se.season").alias("season"), F.col("se.episode").alias("episode"), F.col("se.assumed").alias("season_assumed"), names.extension(F.col("basename")).alias("ext"),
        names.year(F.col("basename")).alias("year"), F.col("q.label").alias("quality"), F.concat(F.col("q.resolution").cast("string"), F.lit("p")).alias("resolution"),
        F.col("q.source").alias("source"), F.col("q.codec").alias("codec"), F.col("q.audio").alias("audio"), F.col("q.hdr").alias("hdr"),
        F.array_join("q.modifiers", "/").alias("mod"), F.lit("").alias("group"), names.episode_title(F.col("basename")).alias("ep_title"),
        F.col("se.season").isNotNull().alias("is_series"), names.is_multi_episode(F.col("basename")).alias("is_multi_episode"),
    )


def parsed_once(files: DataFrame) -> DataFrame:
    """``parsed`` with ``dir_title, dir_season, dir_reason`` of the path (reason: of bonus content). A name or a directory that
    many files have is parsed once; null paths are one of each."""
    within = F.substring("path", F.lit(1), F.length("path") - F.length(F.substring_index("path", "/", -1)))
    f = files.withColumns({"basename": names.basename(F.col("path")), "__dir": within})
    by_name = parsed(f.select(F.col("basename").alias("path")).distinct()).drop("path")
    d = F.col("__dir")
    by_dir = spread(f.select("__dir").distinct()).select("__dir", paths.title_from_path(d).alias("dir_title"), paths.season_from_path(d).alias("dir_season"), paths.supplementary_directory(d).alias("dir_reason"))
    n, p = by_name.withColumnRenamed("basename", "__name"), by_dir.withColumnRenamed("__dir", "__within")
    f = f.join(n, F.col("basename").eqNullSafe(F.col("__name")), "left").drop("__name")
    return f.join(p, F.col("__dir").eqNullSafe(F.col("__within")), "left").drop("__within", "__dir")


def identity(p: DataFrame) -> DataFrame:
    """parsed rows with one nested ``identity``: candidates with confidences, media type, status and warnings.

    A season makes a series' episode, as does the mark of a special; a title alone makes a film. Only warnings make a
    name ambiguous. Whether there are several episodes is decided for names with a season.
    """
    cand = lambda v, c: F.when(v.isNotNull() & (v.cast("string") != ""), F.struct(v.cast("string").alias("value"), c.cast("double").alias("confidence"), F.array(F.lit("filename")).alias("sources")))
    sure = F.when(F.col("season_assumed"), 0.7).otherwise(0.95)
    series = F.col("season").isNotNull()
    kind = F.when(series | F.col("is_special"), "series_episode").when(F.col("title") != "", "movie").otherwise("unknown")
    multi = F.struct(F.col("is_multi_episode").alias("value"), F.when(F.col("is_multi_episode"), 0.95).otherwise(0.9).alias("confidence"), F.when(F.col("is_multi_episode"), "several episodes in the name").otherwise("one episode at most").alias("reason"))
    p = p.withColumn("__warnings", F.when(~(series & F.col("is_multi_episode")), names.numeric_tail_warning(F.col("basename"))).otherwise(F.array().cast("array<struct<code:string,field:string,message:string>>")))
    status = F.when(F.coalesce(F.col("basename") == "", F.lit(True)) | (kind == "unknown"), "unresolved").when(F.size("__warnings") > 0, "ambiguous").otherwise("identified")
    return p.withColumn("identity", F.struct(
        kind.alias("media_type"), status.alias("status"), cand(F.col("title"), F.when(series, 0.9).otherwise(0.8)).alias("title"), cand(F.col("year"), F.lit(0.9)).alias("year"),
        cand(F.col("season"), sure).alias("season"), F.when(series, cand(F.col("episode"), sure)).alias("episode"),
        F.when(series, names.episode_numbers(F.col("basename"))).otherwise(F.array().cast("array<int>")).alias("episodes"), F.when(series, multi).alias("is_multi_episode"),
        F.col("__warnings").alias("warnings"),
    )).drop("__warnings")


def _long(df: DataFrame, provider: str, fields: list[tuple[str, Column, float | Column, Column | bool]]) -> DataFrame:
    one = [F.struct(F.lit(f).alias("field"), v.cast("string").alias("value"), (c if isinstance(c, Column) else F.lit(c)).cast("double").alias("confidence"), (w if isinstance(w, Column) else F.lit(w)).alias("weak")) for f, v, c, w in fields]
    o = df.select("file_id", F.inline(F.array(*one))).filter("value is not null and value <> ''")
    return o.select("file_id", F.lit(provider).alias("provider"), F.lit(X.PROVIDERS.index(provider)).alias("feed_ord"), "field", "value", "confidence", "weak")


def filename_opinions(p: DataFrame, known_title: str = "") -> DataFrame:
    """A special's season 1 is season 0, and no guess; season 0 counts only there."""
    special = F.col("is_special") & (F.coalesce("season", F.lit(0)) <= 1)
    season = F.when(special, 0).when(F.col("season") != 0, F.col("season"))
    weak = F.col("season_assumed") & ~(F.col("is_special") & (F.col("season") == 1))
    title = F.lit(known_title) if known_title else F.col("title")
    tech = [(f, F.when(F.col(f) != "Unknown", F.col(f)), 0.8, False) for f in ("quality", "resolution", "source", "codec", "audio", "hdr", "mod")]
    return _long(p, "filename", [("title", title, 0.9, False), ("season", season, F.when(weak, 0.6).otherwise(0.9), weak), ("episode", F.nullif(F.col("episode"), F.lit(0)), 0.9, weak), *tech, ("year", F.nullif(F.col("year"), F.lit(0)), 0.8, False)])


def dirname_opinions(files: DataFrame, title: Column | None = None, season: Column | None = None) -> DataFrame:
    """title, season: columns that hold what the path says, where that was worked out before."""
    title = paths.title_from_path(F.col("path")) if title is None else title
    season = paths.season_from_path(F.col("path")) if season is None else season
    return _long(files, "dirname", [("title", title, 0.7, False), ("season", season, 0.8, False)])


def file_opinions(probes: DataFrame) -> DataFrame:
    """probes: ``file_id, json``."""
    p = probes.select("file_id", media.probe(F.col("json")).alias("p")).filter("p is not null")
    p = p.select("file_id", media.file_info(F.col("p")).alias("i"), media.tag_values(F.col("p.format.tags")).alias("t"))
    i, t = F.col("i"), F.col("t")
    return _long(p, "file", [
        ("codec", i["video"]["codec"], 0.95, False), ("resolution", F.concat(i["video"]["resolution"].cast("string"), F.lit("p")), 0.95, False), ("audio", i["audio"], 0.95, False),
        ("channels", i["channels"], 0.9, False), ("hdr", i["video"]["hdr"], 0.95, False), ("title", t["show_name"], 0.8, False), ("season", t["season"], 0.8, False), ("episode", t["episode"], 0.8, False),
    ])


def catalog_opinions(meta: DataFrame, provider: str, found: DataFrame) -> DataFrame:
    """What a catalog says. meta: ``file_id, title, season_assumed``; found: ``file_id, title, year, ep_title`` (nulls
    where it has nothing). It repeats the title it was asked for; a guessed season gets no episode title."""
    j = meta.select("file_id", F.col("title").alias("asked"), "season_assumed").filter("asked <> ''").join(found, "file_id", "left")
    return _long(j, provider, [("title", F.coalesce("title", "asked"), 0.9, False), ("year", F.nullif(F.col("year"), F.lit(0)), 0.9 if provider == "tmdb" else 0.85, False), ("ep_title", F.when(~F.coalesce("season_assumed", F.lit(False)), F.col("ep_title")), 0.9, False)])


def together(*opinions: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, opinions)
