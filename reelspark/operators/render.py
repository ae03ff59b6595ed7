"""New names from templates, and what keeps a file from getting one."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelspark.functions import fixed as X
from reelspark.functions.base import cut, quoted


#: [[fill]align][sign][z][#][0][width][grouping][.precision][type]
SPEC = re.compile(r"(?:(?P<fill>.)?(?P<align>[<>=^]))?(?P<sign>[+\- ])?(?P<z>z)?(?P<alt>\#)?(?P<zero>0)?(?P<width>\d+)?(?P<group>[,_])?(?:\.(?P<precision>\d+))?(?P<kind>[a-zA-Z%])?", re.S)
#: Fields that are whole numbers; all others are texts.
NUMBERS = ("season", "episode", "year")


def parts_of(template: str) -> list[tuple[str, str | None, str, str | None]]:
    """(text, field, spec, conversion) of a template; ValueError for what it can't mean: braces that don't match, fields
    without a name, attributes, indexes, and specs that hold fields."""
    out = []
    for text, field, spec, conversion in string.Formatter().parse(template):
        if field is not None:
            if not re.fullmatch(r"[^\W\d]\w*", field):
                raise ValueError(f"a template's fields are plain names: {{{field}}}")
            if "{" in spec:
                raise ValueError(f"a field's format can't hold fields: {{{field}:{spec}}}")
            if conversion not in (None, "r", "s", "a"):
                raise ValueError(f"no such conversion: !{conversion}")
            compiled(F.lit(None), spec, conversion is None and field in NUMBERS)
        out.append((text, field, spec or "", conversion))
    return out


def fields_of(template: str) -> list[str]:
    """The fields that a template uses; a malformed template raises ValueError here, before any file is touched."""
    return [f for _, f, _, _ in parts_of(template) if f is not None]


def _padded(sign: Column, body: Column, fill: str, align: str, width: int) -> Column:
    """sign and body in ``width`` code points: ``=`` pads between them, ``^`` puts the odd one on the right."""
    room = F.greatest(F.lit(width) - F.length(sign) - F.length(body), F.lit(0))
    pad = lambda n: F.repeat(F.lit(fill), n.cast("int"))
    left = F.floor(room / 2)
    return {
        "<": F.concat(sign, body, pad(room)), ">": F.concat(pad(room), sign, body), "=": F.concat(sign, pad(room), body), "^": F.concat(pad(left), sign, body, pad(room - left)),
    }[align]


def _grouped(digits: Column, by: str, size: int) -> Column:
    return F.regexp_replace(digits, rf"(?<=[0-9a-fA-F])(?=(?:[0-9a-fA-F]{{{size}}})+$)", by)


def compiled(c: Column, spec: str, whole: bool) -> Column:
    """``format(c, spec)`` of a text or (``whole``) a whole number; nulls count as empty and 0. ValueError for a spec that has
    no meaning for it, and for the general float format and zeros between grouped digits, which aren't offered."""
    m = SPEC.fullmatch(spec)
    if m is None:
        raise ValueError(f"no such format: {spec!r}")
    g = m.groupdict()
    width, kind = int(g["width"] or 0), g["kind"] or ""
    if not whole:
        bad = [k for k in ("sign", "z", "alt", "group") if g[k]]
        if bad or kind not in ("", "s") or g["align"] == "=":
            raise ValueError(f"a text can't be formatted by {spec!r}")
        t = F.coalesce(c.cast("string"), F.lit(""))
        t = t if g["precision"] is None else F.substring(t, 1, int(g["precision"]))
        return _padded(F.lit(""), t, g["fill"] or ("0" if g["zero"] and not g["align"] else " "), g["align"] or "<", width) if width else t
    decimal = kind in tuple("eEfF%")
    if kind not in ("", *"bcdnoxXeEfF%") or (g["z"] and not decimal) or (g["precision"] is not None and not decimal):
        raise ValueError(f"a whole number can't be formatted by {spec!r}")
    if (kind == "c" and (g["sign"] or g["group"] or g["alt"])) or (kind == "n" and g["group"]) or (kind in tuple("eE") and g["group"]) or (g["group"] and g["zero"] and not g["align"]):
        raise ValueError(f"a whole number can't be formatted by {spec!r}")
    n = F.coalesce(c.cast("long"), F.lit(0).cast("long"))
    size, digits, prefix = F.abs(n), F.abs(n).cast("string"), ""
    if kind == "b":
        digits, prefix = F.bin(size), "0b"
    elif kind in tuple("oxX"):
        digits, prefix = F.format_string(f"%{kind}", size), f"0{kind}"
    elif kind == "c":
        digits = F.char(size)
    elif decimal:
        p = int(g["precision"] if g["precision"] is not None else 6)
        digits = F.format_string(f"%.{p}{'f' if kind in 'fF%' else kind}", (size * F.lit(100) if kind == "%" else size).cast("double")) if kind in tuple("eE") else F.concat((size * (100 if kind == "%" else 1)).cast("string"), F.lit("." + "0" * p if p else ("." if g["alt"] else "")))
    if g["group"]:
        every = 4 if kind in tuple("boxX") else 3
        head = F.regexp_extract(digits, r"^[0-9a-fA-F]+", 0)
        digits = F.concat(_grouped(head, g["group"], every), F.substring(digits, F.length(head) + 1, F.length(digits)))
    tail = "%" if kind == "%" else ""
    plus = {"+": "+", " ": " "}.get(g["sign"] or "", "")
    sign = F.lit("") if kind == "c" else F.concat(F.when(n < 0, "-").otherwise(plus), F.lit(prefix if g["alt"] else ""))
    align = g["align"] or ("=" if g["zero"] else "<" if kind == "c" else ">")
    fill = g["fill"] or ("0" if g["zero"] else " ")
    body = F.concat(digits, F.lit(tail))
    return _padded(sign, body, fill, align, width) if width else F.concat(sign, body)


def sanitize(name: Column) -> Column:
    """Look-alikes for forbidden characters, paired quotes, ``_`` for the rest, no trailing dots or spaces."""
    n = F.translate(name, "".join(a for a, _ in X.LOOKALIKES), "".join(b for _, b in X.LOOKALIKES))
    n = F.regexp_replace(n, r'"([^"]*)"', f"{X.QUOTES[0]}$1{X.QUOTES[1]}")
    n = F.replace(n, F.lit('"'), F.lit(X.QUOTES[0]))
    return cut(cut(n, r"[|\x00-\x1f]", "_"), r"[. ]+$")


def render(template: str, columns: dict[str, Column]) -> Column:
    """The cleaned and sanitised name; empty if the template has a field that there is no column for."""
    parts = []
    for text, field, spec, conversion in parts_of(template):
        if text:
            parts.append(F.lit(text))
        if field is not None:
            if field not in columns:
                return F.lit("")
            c = columns[field]
            if conversion in ("r", "a"):
                c = F.coalesce(c, F.lit(0)).cast("string") if field in NUMBERS else quoted(F.coalesce(c.cast("string"), F.lit("")), conversion == "a")
            elif conversion == "s" and field in NUMBERS:
                c = F.coalesce(c, F.lit(0))
            parts.append(compiled(c, spec, conversion is None and field in NUMBERS))
    n = F.concat(*parts) if parts else F.lit("")
    for pattern in (r"\s*\[\s*\]\s*", r"\s*\(\s*\)\s*", r"\s*\{\s*\}", r"\s*\(\s*0\s*\)\s*"):
        n = cut(n, X.U + pattern)
    n = cut(n, X.I + r"\s+(?=" + X.VIDEO_SUFFIX.removeprefix(X.I) + ")")
    n = cut(n, X.U + r"(?<![.\s])\.{2,}(?![.\s])", ".")
    n = cut(F.trim(cut(n, X.U + r"\s+", " ")), r"[. ]$")
    return sanitize(n)


def rename_status(new_name: Column, old_name: Column, skip_reason: Column, refused: Column, title: Column, ep_title: Column, uses: Column, season: Column | None = None, episode: Column | None = None) -> Column:
    """struct(status, reason): ``skipped``, ``unchanged`` or ``renamed``; the first reason that applies.

    refused, uses: arrays of field names that voting refused and that the template needs; season, episode: null where a name has
    none (not looked at if they aren't given).
    """
    made = lambda s, r: F.struct(F.lit(s).alias("status"), r.alias("reason"))
    disputed = F.filter(F.array(F.lit("season"), F.lit("episode")), lambda f: F.array_contains(refused, f) & F.array_contains(uses, f))
    out = F.when(F.coalesce(skip_reason, F.lit("")) != "", made("skipped", skip_reason)).when(F.coalesce(F.length(title), F.lit(0)) < 2, made("skipped", F.lit("no title")))
    for field, value in (("season", season), ("episode", episode)):
        if value is not None:
            out = out.when(F.array_contains(uses, field) & value.isNull(), made("skipped", F.lit(f"no {field}")))
    return (
        out.when(F.size(disputed) > 0, made("unchanged", F.concat(F.lit("disputed: "), F.array_join(disputed, ", "))))
        .when(F.array_contains(uses, "ep_title") & (F.coalesce(ep_title, F.lit("")) == ""), made("skipped", F.lit("no episode title")))
        .when(F.coalesce(new_name, F.lit("")).isin("") | (new_name == old_name), made("unchanged", F.lit("same name")))
        .otherwise(made("renamed", F.lit("")))
    )
