"""From paths to a plan of new names, in two votes: local evidence settles season and episode, all evidence the rest."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.functions import fixed as X
from reelspark.functions import names, paths
from reelspark.operators import allocate as A
from reelspark.operators import evidence as E
from reelspark.operators import render as R
from reelspark.operators import voting as V
from reelspark.plans import lookups as L
from reelspark.plans.cut import cut


@dataclass
class Options:
    """template: of the user's, else the defaults. season: settles that field for all files. catalogs: found rows
    (``file_id, title, year, ep_title``) by provider; library: tables in which they are looked up. probes: ``file_id, json``. existing: ``dir, name`` of what lies beside
    the files besides themselves. moves: files are moved one after another, in path order, so that later ones may take the
    names of earlier ones; else the plan is that of a dry run, which frees no name. names: what earlier batches have taken, given
    the names that are wanted now (see ``streaming.arrivals``)."""

    known_title: str = ""
    template: str = ""
    season: int = 0
    catalogs: dict[str, DataFrame] = field(default_factory=dict)
    library: L.Library | None = None
    probes: DataFrame | None = None
    existing: DataFrame | None = None
    moves: bool = False
    names: Callable[[DataFrame], tuple[DataFrame, DataFrame]] | None = None


def skipped(p: DataFrame) -> DataFrame:
    """parsed rows with ``skip_reason``; empty for those that go on."""
    by_dir = F.col("dir_reason") if "dir_reason" in p.columns else None
    return p.withColumn("skip_reason", F.when(F.col("is_multi_episode"), "multi-episode file").otherwise(paths.supplementary_reason(F.col("path"), by_dir)))


def _asked_title(known: str):
    if known:
        return F.lit(known)
    t, d = F.coalesce("title", F.lit("")), F.col("dir_title")
    shorter = (F.lower(t) != F.lower(d)) & F.lower(t).contains(F.lower(d)) & (F.length(d) < F.length(t))
    return F.when((d != "") & ((F.length(t) < 3) | shorter), d).otherwise(t)


def identify(files: DataFrame, options: Options | None = None) -> DataFrame:
    """A row a file of ``files`` (``file_id, path``): the parsed fields with the verdicts applied, ``refused`` and
    ``skip_reason``. Files that are skipped cause no look-up and no vote."""
    o = options or Options()
    p = skipped(E.parsed_once(files)).drop("dir_reason")
    p = cut(p.withColumn("title", _asked_title(o.known_title)))
    if o.library is not None and o.library.wiki is not None:
        named = L.translated(p.filter("skip_reason = ''").select("file_id", "title", "is_series", "year"), o.library)
        p = p.join(named.select("file_id", F.col("title").alias("named")), "file_id", "left")
        if o.library.explicit:  # a title in another language that isn't known in the one that was asked for
            source = paths.detect_language(F.col("title"))
            lost = (F.col("named") == F.col("title")) & source.isNotNull() & (source != o.library.language)
            p = p.withColumn("skip_reason", F.when(F.coalesce(lost, F.lit(False)), F.concat(F.lit("no translation from "), source)).otherwise(F.col("skip_reason")))
        p = cut(p.withColumn("title", F.coalesce("named", "title")).drop("named"))
    go = p.filter("skip_reason = ''")
    local = E.together(E.filename_opinions(go, o.known_title), E.dirname_opinions(go, F.col("dir_title"), F.col("dir_season")), *([E.file_opinions(o.probes.join(go.select("file_id"), "file_id"))] if o.probes is not None else []))
    local = cut(local)
    first = V.fuse_same(local.filter(F.col("field").isin(*X.EXPENSIVE)))
    one = first.groupBy("file_id").agg(
        F.max(F.when((F.col("field") == "season") & F.col("usable"), F.col("value"))).alias("v_season"), F.max(F.when((F.col("field") == "episode") & F.col("usable"), F.col("value"))).alias("v_episode"),
        F.array_sort(F.collect_list(F.when(~F.col("usable"), F.col("field")))).alias("refused"),
    )
    p = p.join(one, "file_id", "left").withColumn("refused", F.coalesce("refused", F.array().cast("array<string>")))
    p = p.withColumns({"season": F.coalesce(F.col("v_season").cast("int"), "season"), "episode": F.coalesce(F.col("v_episode").cast("int"), "episode"), "season_assumed": F.array_contains("refused", "season")})
    if o.season > 0:
        p = p.withColumns({"season": F.lit(o.season), "season_assumed": F.lit(False), "is_series": F.lit(True), "refused": F.array_remove("refused", "season")})
    p = cut(p)
    asked = p.filter("skip_reason = ''").select("file_id", "title", "season_assumed", "is_series", "is_special", "season", "episode", "year", F.lit("").alias("ep_title"))
    catalogs = o.catalogs | (L.found(asked.filter("title <> ''"), o.library) if o.library is not None else {})
    online = [E.catalog_opinions(asked, name, found) for name, found in catalogs.items()]
    cheap = V.fuse_same(E.together(local, *online).filter(~F.col("field").isin(*X.EXPENSIVE)))
    wide = V.usable_values(cheap, ("title", "year", "ep_title", "resolution", "source", "codec", "audio", "hdr", "mod", "quality", "channels"))
    wide = wide.select("file_id", *[F.col(c).alias(f"w_{c}") for c in wide.columns if c != "file_id"])
    p = p.join(wide, "file_id", "left").drop("v_season", "v_episode")
    kinds = dict(p.dtypes)
    p = p.withColumns({c: F.coalesce(F.col(f"w_{c}").cast(kinds[c]), c) for c in ("title", "year", "resolution", "source", "codec", "audio", "hdr", "mod", "quality")})
    p = p.withColumns({"ep_title": F.coalesce(F.nullif(F.col("w_ep_title"), F.lit("")), "ep_title"), "channels": F.col("w_channels"), "dot_title": names.dotted(F.col("title"))})
    return cut(p.drop(*[c for c in p.columns if c.startswith("w_")], "dir_title", "dir_season"))


FIELDS = ("title", "dot_title", "dot_quality", "season", "episode", "ext", "year", "quality", "resolution", "source", "codec", "audio", "hdr", "mod", "group", "ep_title", "channels")


def plan(files: DataFrame, options: Options | None = None) -> DataFrame:
    """``file_id, path, old_name, new_name, dest_name, status, reason`` for each row of ``files``, whose file_ids differ."""
    o = options or Options()
    p = identify(files, o).withColumn("year", F.coalesce("year", F.lit(0)))
    cols = {c: F.col(c) for c in FIELDS}
    if o.template:
        serial = {"season", "episode"} & set(R.fields_of(o.template))
        films, series = (X.TEMPLATE_MOVIE_FALLBACK if serial else o.template), o.template
    else:
        films, series = X.TEMPLATE_MOVIE, X.TEMPLATE_SERIES
    new = F.when(F.col("is_series"), R.render(series, cols)).otherwise(R.render(films, cols))
    uses = F.when(F.col("is_series"), F.array(*[F.lit(f) for f in R.fields_of(series)])).otherwise(F.array(*[F.lit(f) for f in R.fields_of(films)]))
    p = p.withColumn("new_name", new)
    p = p.withColumn("s", R.rename_status(F.col("new_name"), F.col("basename"), F.col("skip_reason"), F.col("refused"), F.col("title"), F.col("ep_title"), uses, F.col("season"), F.col("episode")))
    p = p.select("file_id", "path", F.col("basename").alias("old_name"), F.when(F.col("s.status") == "renamed", F.col("new_name")).otherwise(F.col("basename")).alias("new_name"), "s.status", "s.reason")
    p = cut(p.withColumn("dir", F.regexp_extract("path", r"^(.*)/[^/]*$", 1)))  # rendered once, not again for each look at the status
    there = p.select("dir", F.col("old_name").alias("name"))
    there = there if o.existing is None else there.unionByName(o.existing.select("dir", "name"))
    wanted = p.filter("status = 'renamed'").select("file_id", "path", "dir", "new_name")
    reserved = None
    if o.names is not None:
        wanted = cut(wanted)
        held, reserved = o.names(wanted)
        there = there.unionByName(held)
    dest = A.allocate(wanted, there, sequential=o.moves, reserved=reserved)
    return p.join(dest, "file_id", "left").select("file_id", "path", "old_name", "new_name", F.coalesce("dest_name", "old_name").alias("dest_name"), "status", "reason")


def counters(planned: DataFrame) -> DataFrame:
    """``renamed, total, errors`` of a plan."""
    return planned.agg(F.count_if(F.col("status") == "renamed").alias("renamed"), F.count("*").alias("total"), F.count_if(F.col("status") == "error").alias("errors"))
