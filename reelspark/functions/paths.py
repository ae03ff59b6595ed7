"""Titles, seasons and supplementary content from directories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as X
from .base import any_pattern, cut, first_label, group, hit, let, number, quoted
from .names import basename, clean_title


def ancestors(path: Column) -> Column:
    """The directories above a file, nearest first."""
    return F.filter(F.reverse(F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)), lambda d: d != "")


def is_generic(name: Column) -> Column:
    def of(n: Column) -> Column:
        words = F.filter(F.split(n, " "), lambda w: w != "")
        generic = n.isin(*X.GENERIC_WORDS) | F.forall(words, lambda w: w.isin(*X.GENERIC_WORDS))
        numbered = hit(n, X.U + r"^(?:\d{1,2}|(?:season\s*|s)\d{1,2})$")
        temporary = F.exists(words, lambda w: hit(w, r"^(?:tmp|temp)[\da-z]{3,}$")) | hit(F.replace(n, F.lit(" ")), r"^(?:tmp|temp)[\da-z_]{3,}$")
        return generic | numbered | n.startswith("tv ") | temporary

    return let(F.trim(cut(F.lower(name), X.U + r"[\s_]+", " ")), of)


def title_from_path(path: Column) -> Column:
    """Up to three directory titles, from the nearest that isn't generic up to the next that is; outermost first."""
    item = "struct<started:boolean,done:boolean,parts:array<string>>"
    start = F.from_json(F.lit('{"started":false,"done":false,"parts":[]}'), item)

    def step(a: Column, d: Column) -> Column:
        def with_generic(g: Column) -> Column:
            stop = a["done"] | (a["started"] & (g | (F.size(a["parts"]) >= 3)))
            added = let(clean_title(d), lambda t: F.when((F.length(t) >= 2) & ~F.coalesce(F.try_element_at(a["parts"], F.lit(-1)) == t, F.lit(False)), F.array_append(a["parts"], t)).otherwise(a["parts"]))
            keep = F.struct(a["started"].alias("started"), stop.alias("done"), a["parts"].alias("parts"))
            return F.when(stop | g, keep).otherwise(F.struct(F.lit(True).alias("started"), F.lit(False).alias("done"), added.alias("parts")))

        return let(is_generic(d), with_generic)

    def joined(parts: Column) -> Column:
        whole = F.array_join(F.reverse(parts), " ")
        return F.when(F.length(whole) >= 3, whole).otherwise("")

    return let(F.aggregate(ancestors(path), start, step)["parts"], joined)


def _word_number(suffix: Column, table) -> Column:
    out = None
    for word, n in table:
        out = F.when(hit(suffix, rf"(?U)\b{word}\b"), n) if out is None else out.when(hit(suffix, rf"(?U)\b{word}\b"), n)
    return out


def season_from_path(path: Column) -> Column:
    """The season that the nearest directory names, else null; 0 for specials."""

    def norm(c: Column) -> Column:
        return F.lower(F.trim(cut(c, X.U + r"[._\s\-\[\]()]+", " ")))

    def candidate(d: Column, parent: Column) -> Column:
        positive = lambda c: F.nullif(number(c), F.lit(0))
        suffix = lambda pn, dn: F.when((pn != "") & dn.startswith(F.concat(pn, F.lit(" "))), F.substring(dn, F.length(pn) + 2, F.length(dn)))
        rest = let(norm(parent), lambda pn: let(norm(d), lambda dn: suffix(pn, dn)))
        word = let(rest, lambda s: F.when(s.isNotNull(), F.coalesce(_word_number(s, X.SEASON_WORDS), _word_number(s, X.ROMAN))))
        trailing = number(group(d, X.U + r"(?:^|[\s.])(\d{1,2})$"))
        return F.coalesce(
            positive(group(d, X.SERIES)), positive(group(d, X.I + r"season\s*(\d{1,2})")), positive(group(d, X.I + r"(?:part|vol|volume)\s*(\d{1,2})")),
            F.when(F.lower(d).isin("specials", "special"), 0), word,
            F.when(trailing.between(1, 50), trailing),
        )

    def of(up: Column) -> Column:
        both = F.transform(up, lambda d, i: F.struct(d.alias("d"), F.coalesce(F.try_element_at(up, i + 2), F.lit("")).alias("parent")))
        return F.aggregate(both, F.lit(None).cast("int"), lambda a, x: F.when(a.isNotNull(), a).otherwise(candidate(x["d"], x["parent"])))

    return let(ancestors(path), of)


def _stem(path: Column) -> Column:
    return cut(basename(path), r"(?<=.)\.[^.]*$")


def supplementary_directory(path: Column) -> Column:
    """Why a file's directories make it bonus content: the outermost that matches; null if none does."""
    dirs = F.filter(F.reverse(ancestors(path)), lambda d: any_pattern(d, X.SUPPLEMENTARY_DIRS))
    return let(F.try_element_at(dirs, F.lit(1)), lambda d: F.when(d.isNotNull(), F.concat(F.lit("supplementary directory: "), quoted(d))))


def supplementary_reason(path: Column, by_dir: Column | None = None) -> Column:
    """Why a file is bonus content: its outermost directory that matches, else its own name; empty if it isn't. by_dir: a column
    that holds what its directories say, where that was worked out before."""
    by_dir = supplementary_directory(path) if by_dir is None else by_dir

    def by_name(stem: Column) -> Column:
        plain = F.trim(cut(stem, r"[._]", " "))
        hits = any_pattern(stem, X.SUPPLEMENTARY_STEMS) | any_pattern(plain, X.SUPPLEMENTARY_STEMS)
        return F.when(hits, F.concat(F.lit("supplementary filename: "), quoted(stem))).otherwise("")

    return F.coalesce(by_dir, let(_stem(path), by_name), F.lit(""))


def is_supplementary(path: Column) -> Column:
    return supplementary_reason(path) != ""


def detect_language(title: Column) -> Column:
    """A language by the first script that occurs; null for Latin text."""
    return first_label(F.coalesce(title, F.lit("")), X.SCRIPTS, "")
