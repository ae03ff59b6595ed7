r"""Mixing sources to target weights as a time-varying curriculum, in DataFrame operations only.

Each source has a target of words (its weight's share of the mix, stopped at ``max_epochs`` times what it has) and
a weight schedule over the training time from 0 to 1, piecewise linear. The integral of the schedule is the source's
cumulative demand; inverting it gives, for the c-th word of the source, the time at which it is trained. Documents
are laid out in a seeded order within their source, pass after pass, until the target is met; a document's position
is the time of the middle of what is taken, and the mix is range-sorted by position.

Running sums within a source are made in hash buckets of bounded size, moved by prefix sums over the buckets; no
task holds a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import bucket_of, buckets_for, exclusive_prefix, group_key, written

#: Schedules for the sources in turn: (time, relative weight) knots. Only the shape counts; the share is the target.
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 2.0), (0.5, 1.0), (1.0, 0.0)), ((0.0, 0.5), (1.0, 1.5)))
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, max_epochs: int) -> DataFrame:
    """One row a source: ``__g``, ``__total``, ``__turn``, ``__target``. sizes: ``__g``, ``__source``, ``__total``.

    Sources in code-point order (null last) weigh ``weights`` in turn. Sharing the excess of sources that are stopped
    by weight, again and again, ends where one level holds for all others: the first source, by cap over weight, that
    isn't stopped shows that level. The table has a row a source; its windows are over that only.
    """
    order = Window.orderBy(F.col("__source").isNull(), "__source")
    s = sizes.withColumn("__turn", (F.row_number().over(order) - 1) % len(weights))
    s = s.withColumns({"__w": F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("__turn") + 1), "__cap": F.col("__total") * max_epochs})
    by_ratio = Window.orderBy(F.col("__cap") / F.col("__w"), "__g")
    whole = Window.partitionBy()
    s = s.withColumns({
        "__stopped": F.coalesce(F.sum("__cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "__weights": F.sum("__w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)),
        "__all": F.sum("__total").over(whole),
    })
    s = s.withColumn("__level", (F.col("__all") * share - F.col("__stopped")) / F.col("__weights"))
    ok = F.col("__cap") / F.col("__w") >= F.col("__level")
    s = s.withColumn("__level", F.coalesce(F.min_by(F.when(ok, F.col("__level")), F.when(ok, F.struct(F.col("__cap") / F.col("__w"), F.col("__g")))).over(whole), F.lit(float("inf"))))
    return s.select("__g", "__total", "__turn", F.least(F.col("__cap").cast("double"), F.col("__level") * F.col("__w")).alias("__target"))


def _segments(knots: tuple[tuple[float, float], ...]) -> list[tuple[float, ...]]:
    """(share of the demand before, time at start, length, weights at both ends), with the whole integral as 1."""
    area = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False)]
    total, out = sum(area), []
    for k, (a, b) in enumerate(zip(knots, knots[1:], strict=False)):
        out.append((sum(area[:k]) / total, a[0], b[0] - a[0], a[1] / total, b[1] / total))
    return out


def time_of(q: Column, turn: Column, schedules=SCHEDULES) -> Column:
    """When the share q of a source's demand is met: the inverse of the integral of its schedule."""
    names = ("q0", "t0", "dt", "a", "b")
    each = F.array(*[F.array(*[F.struct(*[F.lit(float(x)).alias(n) for n, x in zip(names, seg, strict=True)]) for seg in _segments(k)]) for k in schedules])
    seg = F.element_at(F.filter(F.element_at(each, turn % len(schedules) + 1), lambda s: s["q0"] <= q), -1)
    rest = (q - seg["q0"]) / seg["dt"]
    root = F.sqrt(F.greatest(F.lit(0.0), seg["a"] * seg["a"] + 2 * (seg["b"] - seg["a"]) * rest))
    return seg["t0"] + F.when(rest <= 0, 0.0).otherwise(seg["dt"] * 2 * rest / (seg["a"] + root))


def curriculum(df: DataFrame, size: Column, source: Column, identity: list[Column], *, weights=(3, 1, 2), share=1.5, max_epochs=2, schedules=SCHEDULES, whole=False, seed=29) -> DataFrame:
    """df, a row each, with ``__size``, ``__source_size``, ``__target``, ``__taken`` (words, repeats counted) and
    ``__copies``: an array of (position, words) for each copy that is taken.

    The last copy that a source gives is cut where the target is met, so the taken words are the rounded target; with
    ``whole``, copies are taken whole, those whose middle lies before the target. Documents without words are never
    taken. Null sources are one source, after all others. Rows that agree in all of ``identity`` are interchangeable.
    An empty table gives an empty table. Columns that start with two underscores are reserved; others pass through.
    """
    df = df.withColumns({"__size": size, "__g": group_key(source), "__source": source, "__h": F.xxhash64(F.lit(seed), *identity)})
    n = buckets_for(df.count())
    df = df.withColumn("__b", bucket_of(F.col("__h"), n))
    sums = written(df.groupBy("__g", "__b").agg(F.sum("__size").alias("__s"), F.first("__source").alias("__source")), "mix-sums")
    goal = targets(sums.groupBy("__g").agg(F.sum("__s").alias("__total"), F.first("__source").alias("__source")), weights, share, max_epochs)
    before = exclusive_prefix(sums, ["__g"], "__b", ["__s"]).select("__g", "__b", "__s_before").join(goal, "__g")
    running = Window.partitionBy("__g", "__b").orderBy("__h").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__start", F.coalesce(F.sum("__size").over(running), F.lit(0))).join(before, ["__g", "__b"])
    df = df.withColumns({"__start": F.col("__start") + F.col("__s_before"), "__quota": F.round("__target").cast("long")})
    copies = []
    for k in range(max_epochs):
        at = F.col("__start") + F.col("__total") * k
        words = F.when(2 * at + F.col("__size") <= 2 * F.col("__quota"), F.col("__size")).otherwise(0) if whole else F.least(F.col("__size"), F.greatest(F.col("__quota") - at, F.lit(0)))
        middle = F.least((at + words / 2) / F.greatest(F.col("__quota"), F.lit(1)), F.lit(1.0))
        copies.append(F.when(words > 0, F.struct(time_of(middle, F.col("__turn"), schedules).alias("position"), words.cast("long").alias("words"))))
    df = df.withColumn("__copies", F.array_compact(F.array(*copies)))
    df = df.withColumn("__taken", F.aggregate("__copies", F.lit(0).cast("long"), lambda a, c: a + c["words"]))
    return df.withColumnRenamed("__total", "__source_size").drop("__g", "__source", "__b", "__start", "__s_before", "__turn", "__quota")


def in_order(mixed: DataFrame) -> DataFrame:
    """The taken copies, a row each with ``__position`` and ``__words``, range-sorted by position."""
    out = mixed.select("*", F.inline("__copies").alias("__position", "__words"))
    return out.orderBy("__position", "__h")


def op5_curriculum_mix(spark, sf_dir: str) -> DataFrame:
    """All documents, a row each (taken 0 for those left out), range-sorted by their first position in training.

    Null text has no words; null source comes last.
    """
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    d = d.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"))
    mixed = curriculum(written(d, "op5"), F.col("size"), F.col("source"), [F.col("doc_id"), F.col("text_hash"), F.col("size")])
    first = F.try_element_at("__copies", F.lit(1))["position"]
    return mixed.select(
        "doc_id", "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__taken").alias("taken"),
        first.alias("position"), F.transform("__copies", lambda c: c["position"]).alias("positions"), "__h",
    ).orderBy(F.col("position").asc_nulls_last(), "__h").drop("__h")
