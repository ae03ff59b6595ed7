"""Season, episode, year, title and extension from file names: expressions from a name to a value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as X
from .base import after_match, before_match, cut, hit, let, number, number_in

MODIFIER_ANYWHERE = X.I + r"(?<!^)(?:" + "|".join(f"(?:{p})" for _, p in X.MODIFIERS) + r")\b"


def basename(path: Column) -> Column:
    return F.substring_index(F.translate(path, "\\", "/"), "/", -1)


def extension(name: Column) -> Column:
    """Last dot and alphanumerics, in lower case; empty without one."""
    return F.lower(F.regexp_extract(name, X.EXTENSION, 1))


def without_extension(name: Column) -> Column:
    return cut(name, X.VIDEO_SUFFIX)


def year(name: Column) -> Column:
    """The last of the years that don't overlap, else null."""
    return number(F.try_element_at(F.regexp_extract_all(name, F.lit(X.YEAR), F.lit(1)), F.lit(-1)))


def season_episode(name: Column) -> Column:
    """struct(season, episode, assumed) by the first marker that applies; nulls without any.

    A season without an episode is carried on to the forms that give only an episode; these assume season 1 (also in
    place of a carried 0) if there is none.
    """
    def made(season, episode, assumed):
        return F.struct(season.cast("int").alias("season"), episode.cast("int").alias("episode"), assumed.alias("assumed"))

    def other(s: Column) -> Column:
        no, carried = F.lit(False), F.coalesce(F.nullif(s, F.lit(0)), F.lit(1))
        out = F.when(hit(name, X.SERIES_X), made(number_in(name, X.SERIES_X, 1), number_in(name, X.SERIES_X, 2), no))
        for pattern in (X.EPISODE_ALONE, X.EPISODE_BRACKETS):
            found = number_in(name, pattern)
            out = out.when(found.isNotNull() & ~found.isin(*X.NOT_EPISODES), made(carried, found, s.isNull()))
        for pattern in (X.SEASON_DOT_EPISODE, X.SEASON_DOT_DIGIT):
            out = out.when(hit(name, pattern), made(number_in(name, pattern, 1), number_in(name, pattern, 2), no))
        return out.otherwise(made(s, F.lit(None), no))

    # the marker alone says what its groups are, and is short
    both = let(F.regexp_extract(name, X.SERIES, 0), lambda m: F.struct(number_in(m, X.SERIES, 1).alias("s"), number_in(m, X.SERIES, 2).alias("e")))
    return let(both, lambda m: F.when(m["e"].isNotNull(), made(m["s"], m["e"], F.lit(False))).otherwise(other(m["s"])))


def is_special(name: Column) -> Column:
    return hit(name, X.SPECIAL_MARKER)


def _second(rest: Column, first: Column) -> Column:
    """The second episode right after a marker, else null. rest: what follows the marker, in lower case."""
    rest = cut(rest, X.I + r"\band\b", "&")
    sep = F.regexp_extract(rest, r"^[.\s\-_+&,]+", 0)

    def of(r: Column) -> Column:
        marker = X.U + r"^(?:s\d{1,2}e|\d{1,2}x|e)(\d{1,3})(?![0-9])"
        num = F.regexp_extract(r, X.U + r"^(\d{1,4})", 1)
        after = F.substring(r, F.length(num) + 1, F.length(r))
        n = number(num)
        bare = F.when(
            (num != "") & ~hit(after, X.U + r"^\.\d") & ~hit(after, X.TECH_UNITS) & ~num.isin(*X.RESOLUTION_WIDTHS) & (F.length(num) < 4)
            & hit(sep, r"[-+&_]") & (n > first) & (n - first <= X.MAX_RANGE_GAP), n,
        )
        return F.when(hit(r, marker), number_in(r, marker)).otherwise(bare)

    return let(F.substring(rest, F.length(sep) + 1, F.length(rest)), of)


def episode_pairs(name: Column) -> Column:
    """array(struct(first, second)) for each marker that a second episode follows."""

    def of(lower: Column) -> Column:
        marks = F.regexp_extract_all(lower, F.lit(X.MULTI_MARKER), F.lit(0))
        between = F.split(lower, X.MULTI_MARKER, -1)

        def pair(mark: Column, i: Column) -> Column:
            # what follows marker i: text, marker, text, ... up to the end
            tail = F.concat_ws("", F.flatten(F.zip_with(F.slice(between, i + 2, F.size(between)), F.concat(F.slice(marks, i + 2, F.size(marks)), F.array(F.lit(""))), lambda t, m: F.array(t, m))))
            first = number_in(mark, X.U + r"(?:s\d{1,2}e|e|x)(\d{1,3})")
            return F.struct(first.alias("first"), _second(tail, first).alias("second"))

        return F.filter(F.transform(marks, pair), lambda p: p["second"].isNotNull())

    none = F.array().cast("array<struct<first:int,second:int>>")
    return let(F.lower(without_extension(name)), lambda n: F.when(hit(n, X.SECOND_EPISODE), of(n)).when(n.isNotNull(), none))


def episode_numbers(name: Column) -> Column:
    """(first, second) of several episodes, (episode) of one, else empty."""
    return let(episode_pairs(name), lambda p: F.when(F.size(p) > 0, F.array(p[0]["first"], p[0]["second"])).otherwise(F.array_compact(F.array(season_episode(name)["episode"]))))


def is_multi_episode(name: Column) -> Column:
    return F.size(episode_pairs(name)) > 0


def title_case(title: Column) -> Column:
    """Capitalised words, if all letters are ASCII and of one case; else as it is."""
    letters = F.regexp_replace(title, r"[^\p{L}]", "")
    return let(letters, lambda w: F.when((w != "") & hit(w, r"^(?:[A-Z]+|[a-z]+)$"), F.initcap(title)).otherwise(title))


def without_last_year(name: Column) -> Column:
    def of(between: Column) -> Column:
        years = F.regexp_extract_all(name, F.lit(X.YEAR), F.lit(0))
        n = F.size(years)
        head = F.array_join(F.zip_with(F.slice(between, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(years, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda t, y: F.concat(t, y)), "")
        return F.concat(head, F.element_at(between, -2), F.element_at(between, -1))

    return F.when(hit(name, X.YEAR), let(F.split(name, X.YEAR, -1), of)).otherwise(name)


def clean_title(name: Column) -> Column:
    """The show's or film's title: markers, tokens, the last year, groups and brackets removed, in this order."""
    c = cut(F.translate(name, "_", " "), X.VIDEO_SUFFIX)
    for p in (X.SERIES, X.EPISODE_ALONE, X.SEASON_DOT_EPISODE, X.SEASON_DOT_DIGIT, X.SERIES_X):
        c = cut(c, p)

    def rest(n: Column) -> Column:
        marked = hit(n, X.QUALITY_TOKENS) | hit(n, X.SOURCE_TOKENS) | hit(n, X.YEAR)
        t = without_last_year(n)
        for p in (X.QUALITY_TOKENS, X.SOURCE_TOKENS, X.BLACK_BARS):
            t = cut(t, p)
        t = let(t, lambda v: F.when(marked, cut(strip(cut(v, MODIFIER_ANYWHERE)), X.RELEASE_GROUP)).otherwise(v))
        t = cut(cut(t, r"\[.*?\]"), r"\(.*?\)")
        return let(squeeze(cut(t, r"[._-]", " ")), title_case)

    return let(c, rest)


def strip(c: Column) -> Column:
    return cut(c, X.U + r"^\s+|\s+$")


def squeeze(c: Column) -> Column:
    """White space collapsed and stripped."""
    return F.trim(cut(c, X.U + r"\s+", " "))


def before_marker(name: Column) -> Column:
    """What stands before the first kind of marker that matches; all of the name without one."""
    out = None
    for p in (X.SERIES, X.SERIES_X, X.SEASON_DOT_EPISODE, X.SEASON_DOT_DIGIT, X.EPISODE_ALONE):
        before = before_match(name, p)
        out = F.when(hit(name, p), before) if out is None else out.when(hit(name, p), before)
    # most names have the first kind, with something before it: one search tells
    return let(before_match(name, X.SERIES), lambda b: F.when(b != "", b).otherwise(out.otherwise(name)))


def title_of(before: Column) -> Column:
    """The title that stands before a marker."""
    return F.when(strip(before) == "", F.lit("")).otherwise(clean_title(before))


def title_before_marker(name: Column) -> Column:
    """The title before the first kind of marker that matches; all of the name without one."""
    return let(before_marker(name), title_of)


def _clean_ep_title(raw: Column) -> Column:
    t = strip(raw)
    for p in (X.QUALITY_TOKENS, X.SOURCE_TOKENS, r"\[.*?\]", r"\(.*?\)", X.U + r"^[\s._-]*(?:19|20)\d{2}\b[\s._-]*"):
        t = cut(t, p)
    spaced = lambda s: squeeze(cut(s, r"[._-]", " "))
    return let(t, lambda s: F.when(s.startswith("..."), F.concat(F.lit("..."), spaced(F.substring(s, F.lit(4), F.length(s))))).otherwise(spaced(s)))


def episode_title(name: Column) -> Column:
    """What a name says after its marker, if it has two characters or more; else empty."""
    bare = without_extension(name)
    long = lambda c: let(c, lambda v: F.when(F.length(v) >= 2, v))

    def of(b: Column) -> Column:
        dotted = F.when(hit(b, X.SEASON_DOT_EPISODE), long(_clean_ep_title(after_match(b, X.SEASON_DOT_EPISODE))))
        marked = F.when(hit(b, X.SERIES), long(_clean_ep_title(cut(after_match(b, X.SERIES), X.I + r"\s*E\d{1,3}\s*"))))
        return F.coalesce(dotted, marked, F.lit(""))

    return let(bare, of)


def dotted(c: Column) -> Column:
    return cut(strip(c), X.U + r"\s+", ".")


def numeric_tail_warning(name: Column) -> Column:
    """Warnings, array(struct(code, field, message)): one where a number of up to three digits follows the first marker
    that is no width of a picture and no technical figure, in a name that isn't of several episodes."""
    stem = cut(name, X.I + r"\.[a-z0-9]+$")
    tail = cut(F.try_element_at(F.split(F.lower(stem), X.TAIL_MARKER, 2), F.lit(2)), X.U + r"^[.\s\-_+&/]+")
    num = F.regexp_extract(tail, X.U + r"^\d{1,4}", 0)
    after = F.substring(tail, F.length(num) + 1, F.length(tail))
    plain = (num != "") & (F.length(num) < 4) & ~num.isin(*X.RESOLUTION_WIDTHS) & ~hit(after, X.U + r"^\.\d") & ~hit(after, X.TECH_UNITS)
    made = F.struct(F.lit("numeric-episode-title-maybe").alias("code"), F.lit("episode").alias("field"), F.concat(F.lit("number after the marker, perhaps a title: "), num).alias("message"))
    return F.array_compact(F.array(F.when(F.coalesce(plain, F.lit(False)) & ~is_multi_episode(name), made)))
