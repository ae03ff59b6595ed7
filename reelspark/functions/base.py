"""Helpers for building column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with value computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hit(c: Column, pattern: str) -> Column:
    """Does the pattern match somewhere?"""
    return F.coalesce(c.rlike(pattern), F.lit(False))


def cut(c: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(by.replace("\\", "\\\\").replace("$", "\\$")))


def group(c: Column, pattern: str, n: int = 1) -> Column:
    """A group of the first match; null where there is no match or the group took no part."""
    return F.nullif(F.regexp_extract(c, pattern, n), F.lit(""))


def number_in(c: Column, pattern: str, n: int = 1) -> Column:
    """A group of the first match as a number; null where there is none. The pattern runs once: nothing is no number."""
    return number(F.regexp_extract(c, pattern, n))


def number(c: Column) -> Column:
    return c.try_cast("int")


def first_label(c: Column, rules: Iterable[tuple], flags: str = "(?iuU)") -> Column:
    """The label of the first rule whose pattern matches, else null."""
    out = None
    for label, pattern in rules:
        out = F.when(hit(c, flags + pattern), F.lit(label)) if out is None else out.when(hit(c, flags + pattern), F.lit(label))
    return out


def any_pattern(c: Column, patterns: Iterable[str], flags: str = "(?iuU)") -> Column:
    """Does one of the patterns match? Those that begin with ``^`` share it, so that all fail at once elsewhere."""
    patterns = list(patterns)
    first = [p[1:] for p in patterns if p.startswith("^") and "|" not in re.sub(r"\(\?:[^()]*\)", "", p)]
    other = [f"(?:{p})" for p in patterns if p[1:] not in first or not p.startswith("^")]
    return hit(c, flags + "|".join(([f"^(?:{'|'.join(first)})"] if first else []) + other))


def before_match(c: Column, pattern: str) -> Column:
    """What stands before the first match of a pattern without ``.``; empty without a match. Unlike ``split``, which compiles its
    pattern for each row."""
    return F.regexp_extract(c, r"(?s)^(.*?)(?-s)" + pattern, 1)


def after_match(c: Column, pattern: str) -> Column:
    """What stands after the first match of a pattern that has groups only where ``re`` sees them, and no ``.``; empty without a match."""
    return F.regexp_extract(c, r"(?s)^.*?(?-s)" + pattern + r"(?s)(.*)", len(re.findall(r"(?<!\\)\((?!\?)", pattern)) + 1)


def quoted(c: Column, ascii_only: bool = False) -> Column:
    """The text as a literal: in single quotes, or double ones where it has single ones only; backslashes, quotes, line
    breaks and tabs escaped, and with ``ascii_only`` all that isn't ASCII."""
    double = c.contains("'") & ~c.contains('"')
    t = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for plain, name in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        t = F.replace(t, F.lit(plain), F.lit(name))
    t = F.when(double, F.concat(F.lit('"'), t, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(t, F.lit("'"), F.lit("\\'")), F.lit("'")))
    if not ascii_only:
        return t
    code = lambda ch: F.ascii(ch)
    escaped = lambda ch: F.when(code(ch) < 128, ch).when(code(ch) < 256, F.format_string("\\x%02x", code(ch))).when(code(ch) < 65536, F.format_string("\\u%04x", code(ch))).otherwise(F.format_string("\\U%08x", code(ch)))
    return F.array_join(F.transform(F.regexp_extract_all(t, F.lit(r"(?s)."), F.lit(0)), escaped), "")
