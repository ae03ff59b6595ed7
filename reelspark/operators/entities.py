"""Entities from the raw JSON that a knowledge base answers with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.functions.base import number

#: Values of claims are objects for some properties and texts for others.
SCHEMA = "entities map<string, struct<claims: map<string, array<struct<mainsnak: struct<datavalue: struct<value: variant>>>>>, labels: map<string, struct<value: string>>>>"


def _values(entity: Column, prop: str) -> Column:
    """The values of a property's claims, nulls where a claim has none."""
    claims = F.coalesce(F.try_element_at(entity["claims"], F.lit(prop)), F.array().cast("array<struct<mainsnak:struct<datavalue:struct<value:variant>>>>"))
    return F.transform(claims, lambda c: c["mainsnak"]["datavalue"]["value"])


def _texts(entity: Column, prop: str, path: str) -> Column:
    return F.transform(_values(entity, prop), lambda v: F.try_variant_get(v, path, "string"))


def _first_year(entity: Column, prop: str) -> Column:
    """The year of a property's first date that has one: a sign and four digits."""
    years = F.transform(_texts(entity, prop, "$.time"), lambda t: number(F.regexp_extract(t, r"^[+-](\d{4})", 1)))
    return F.try_element_at(F.filter(years, lambda y: y.isNotNull()), F.lit(1))


def entities(raw: DataFrame) -> DataFrame:
    """``qid, types, year, labels`` of entities from answers (``qid, json``): P31's ids sorted; the first year of P577, or where that has
    none (or 0), of P580; labels by language. Answers that aren't JSON, that lack the entity, or that have neither types
    nor a year give nothing."""
    e = raw.select("qid", F.try_element_at(F.from_json("json", SCHEMA)["entities"], F.col("qid")).alias("e")).filter("e is not null")
    ids = F.array_sort(F.filter(_texts(F.col("e"), "P31", "$.id"), lambda i: F.coalesce(i != "", F.lit(False))))
    released, began = _first_year(F.col("e"), "P577"), _first_year(F.col("e"), "P580")
    labels = F.coalesce(F.map_filter(F.transform_values(F.col("e.labels"), lambda _, v: v["value"]), lambda _, v: v.isNotNull()), F.create_map().cast("map<string,string>"))
    e = e.select("qid", ids.alias("types"), F.coalesce(F.nullif(released, F.lit(0)), began, released).alias("year"), labels.alias("labels"))
    return e.filter((F.size("types") > 0) | F.col("year").isNotNull())
