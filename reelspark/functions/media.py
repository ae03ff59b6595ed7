"""Technical facts of a file from its probe JSON, with a declared schema."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as X
from .base import let

PROBE = (
    "streams array<struct<codec_type:string,codec_name:string,height:int,coded_height:int,pix_fmt:string,color_transfer:string,bit_rate:string,channels:int,"
    "side_data_list:array<struct<type:string>>,tags:struct<language:string>>>, format struct<tags:map<string,string>>"
)


def probe(json: Column) -> Column:
    """Null for what isn't JSON."""
    return F.from_json(json, PROBE)


def streams(p: Column, kind: str) -> Column:
    return F.coalesce(F.filter(p["streams"], lambda s: s["codec_type"] == kind), F.array().cast("array<" + PROBE.split("array<", 1)[1].split(">>>,", 1)[0] + ">>>"))


def tag_values(tags: Column) -> Column:
    """struct(show_name, ep_title, season, episode): for each the first alias, in the tags' order, with a usable value."""
    alias = F.create_map(*[F.lit(x) for pair in X.TAG_ALIASES for x in pair])
    each = F.filter(F.transform(F.map_entries(tags), lambda e: F.struct(F.element_at(alias, e["key"]).alias("k"), F.trim(e["value"]).alias("v"))), lambda e: F.coalesce(e["v"] != "", F.lit(False)))
    text = lambda k: F.try_element_at(F.transform(F.filter(each, lambda e: e["k"] == k), lambda e: e["v"]), F.lit(1)).alias(k)
    num = lambda k: F.try_element_at(F.filter(F.transform(F.filter(each, lambda e: e["k"] == k), lambda e: e["v"].try_cast("int")), lambda n: F.coalesce(n != 0, F.lit(False))), F.lit(1)).alias(k)
    return F.struct(text("show_name"), text("ep_title"), num("season"), num("episode"))


def standard_height(h: Column) -> Column:
    out = None
    for std in X.HEIGHTS:
        near = F.abs(h - std) <= X.HEIGHT_SLACK
        out = F.when(near, std) if out is None else out.when(near, std)
    return out.otherwise(h)


def stream_codec(name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in X.STREAM_CODECS for x in pair])
    return F.coalesce(F.element_at(known, F.lower(name)), F.upper(name))


def is_hlg(transfer: Column) -> Column:
    return F.coalesce(transfer.isin(*X.HLG_TRANSFERS), F.lit(False))


def video_info(p: Column) -> Column:
    """struct(codec, resolution, hdr, bitrate) of the first video stream; nulls without one."""

    def of(s: Column) -> Column:
        fmt, side = F.lower(F.coalesce(s["pix_fmt"], F.lit(""))), F.coalesce(F.transform(s["side_data_list"], lambda d: d["type"]), F.array().cast("array<string>"))
        transfer = F.coalesce(s["color_transfer"], F.lit(""))
        hdr = (
            F.when(F.array_contains(side, "Dolby Vision") | fmt.contains("dovi") | fmt.contains("dolbyvision"), "Dolby Vision").when(F.array_contains(side, "HDR10+"), "HDR10+")
            .when(F.array_contains(side, "HDR10") | transfer.contains("smpte2084"), "HDR10").when(F.array_contains(side, "HLG") | is_hlg(transfer), "HLG")
        )
        height = F.coalesce(F.nullif(s["height"], F.lit(0)), F.nullif(s["coded_height"], F.lit(0)))
        rate = F.when(s["bit_rate"].rlike(r"^\d+$"), F.floor(s["bit_rate"].try_cast("long") / 1000))
        return F.struct(stream_codec(s["codec_name"]).alias("codec"), standard_height(height).alias("resolution"), F.when(s.isNotNull(), hdr).alias("hdr"), rate.cast("long").alias("bitrate"))

    return let(F.try_element_at(streams(p, "video"), F.lit(1)), of)


def _language(s: Column) -> Column:
    return F.coalesce(s["tags"]["language"], F.lit("und"))


def audio_streams(p: Column) -> Column:
    """array(struct(codec, language, channels)), a struct a stream."""
    return F.transform(streams(p, "audio"), lambda s: F.struct(F.lower(F.coalesce(s["codec_name"], F.lit(""))).alias("codec"), _language(s).alias("language"), F.coalesce(s["channels"], F.lit(0)).alias("channels")))


def subtitle_streams(p: Column) -> Column:
    """array(struct(language, codec)), a struct a stream."""
    return F.transform(streams(p, "subtitle"), lambda s: F.struct(_language(s).alias("language"), F.lower(F.coalesce(s["codec_name"], F.lit(""))).alias("codec")))


def languages(ss: Column) -> Column:
    """Sorted distinct languages of streams that name one, joined by commas."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(ss, lambda s: s["language"]), lambda x: x != "und"))), ",")


def audio_label(codec: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in X.AUDIO_LABELS for x in pair])
    return F.coalesce(F.element_at(known, codec), F.upper(codec))


def file_info(p: Column) -> Column:
    """struct(video, audio, channels, audio_lang, sub_lang): the first audio stream's label, the most channels."""

    def of(audio: Column) -> Column:
        return F.struct(
            video_info(p).alias("video"), audio_label(F.try_element_at(audio, F.lit(1))["codec"]).alias("audio"),
            F.array_max(F.transform(audio, lambda s: s["channels"])).alias("channels"), languages(audio).alias("audio_lang"), languages(subtitle_streams(p)).alias("sub_lang"),
        )

    return let(audio_streams(p), of)
