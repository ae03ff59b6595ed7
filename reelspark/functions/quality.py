"""Quality of a release from its name: each dimension is the first rule that matches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as X
from .base import cut, first_label, hit, let


def normalised(name: Column) -> Column:
    return cut(F.translate(name, "_", " "), X.BLACK_BARS)


def resolution(name: Column) -> Column:
    return first_label(name, X.RESOLUTIONS)


def source(name: Column) -> Column:
    return first_label(name, X.SOURCES)


def codec(name: Column) -> Column:
    return first_label(name, X.CODECS)


def audio(name: Column) -> Column:
    return first_label(name, X.AUDIO)


def hdr(name: Column) -> Column:
    return first_label(name, X.HDR)


def modifiers(name: Column) -> Column:
    """All that match, in the table's order."""
    return F.array_compact(F.array(*[F.when(hit(name, X.I + p), F.lit(label)) for label, p in X.MODIFIERS]))


def label(q: Column) -> Column:
    parts = [
        q["source"], F.when(q["is_remux"], "Remux"), F.concat(q["resolution"].cast("string"), F.lit("p")), q["hdr"], q["codec"], q["audio"],
        F.when(q["is_3d"], "3D"), F.nullif(F.array_join(q["modifiers"], "/"), F.lit("")),
    ]
    return F.coalesce(F.nullif(F.concat_ws(" ", *parts), F.lit("")), F.lit("Unknown"))


def quality(name: Column) -> Column:
    """struct(resolution, source, codec, audio, hdr, is_remux, is_3d, modifiers, label); nulls where nothing matches. Most names
    hold nothing that the rules for the last six could match; one look tells that."""

    def rare(n: Column) -> Column:
        return F.struct(n.alias("n"), ((F.length(n) < F.octet_length(n)) | hit(n, X.RARE)).alias("rare"))

    def of(v: Column) -> Column:
        n, r = v["n"], v["rare"]
        q = F.struct(
            resolution(n).alias("resolution"), source(n).alias("source"), codec(n).alias("codec"), F.when(r, audio(n)).alias("audio"), F.when(r, hdr(n)).alias("hdr"),
            F.coalesce(r & hit(n, X.I + X.REMUX), F.lit(False)).alias("is_remux"), F.coalesce(r & hit(n, X.I + X.THREE_D), F.lit(False)).alias("is_3d"),
            F.when(F.coalesce(r, F.lit(True)), modifiers(n)).otherwise(F.array().cast("array<string>")).alias("modifiers"),
        )
        return let(q, lambda v: v.withField("label", label(v)))

    return let(let(normalised(name), rare), of)


def strip_modifiers(title: Column) -> Column:
    return F.trim(cut(title, X.I + r"\b(?:" + "|".join(f"(?:{p})" for _, p in X.MODIFIERS) + r")\b"))
