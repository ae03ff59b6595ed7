"""Arbitration of evidence: clusters of agreeing opinions, weighted winners and decisions, in one shuffle by file.

``opinions`` has a row a file, provider and field: ``file_id, provider, feed_ord, field, value`` (text),
``confidence`` (null: a source that gives none), ``weak``. A file has as many opinions of a field as there are
providers, so a field's opinions are gathered in one row and clustered there, in the providers' order.

Titles agree when they are equal, one contains the other, they have one entity id, or difflib's ratio says so. Only
pairs that the first three leave open are sent to Python, in Arrow batches.
"""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelspark.functions import fixed as X
from reelspark.functions.base import cut, hit, let
from reelspark.operators.joins import frequent_join
from reelspark.plans.cut import cut as cut_lineage

TITLES = ("title", "ep_title")


def weight(field: Column, provider: Column, default: float = 1.0) -> Column:
    """A literal look-up: the table of weights has some forty entries."""
    pairs = [F.lit(x) for f, row in X.WEIGHTS.items() for p, w in row.items() for x in (f"{f}/{p}", w)]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.concat(field, F.lit("/"), provider)), F.lit(default))


def voters(opinions: DataFrame) -> DataFrame:
    """Opinions that count: values that aren't empty, and weak ones only where a field has no other."""
    votes = opinions.filter(F.col("value").isNotNull() & (F.col("value") != ""))
    return votes.withColumn("weak", F.coalesce("weak", F.lit(False)) & F.col("field").isin(*X.EXPENSIVE))


def normal_title(c: Column) -> Column:
    return F.lower(F.trim(cut(c, X.U + r"\s+", " ")))


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def _agreement(texts: pd.Series, known: pd.Series) -> pd.Series:
    """``known``, n * n flags of n texts, with the open ones (null) filled in: is text j (second) close to leader i
    (first)? Rows without open flags bring no texts."""

    def flags(t, k) -> list[bool]:
        n = len(t)
        return [bool(v) if v is not None else SequenceMatcher(None, t[x // n], t[x % n]).ratio() >= X.TITLE_RATIO for x, v in enumerate(k)]

    return pd.Series([flags(t, k) for t, k in zip(texts, known, strict=True)], dtype=object)


#: So that no optimiser rule moves the call into a lambda function, where Python can't be called.
_agreement = _agreement.asNondeterministic()


def _title_rule(a: Column, b: Column) -> Column:
    """True, False, or null where only the ratio can tell. a, b: structs with norm and qid."""
    x, y = a["norm"], b["norm"]
    numbered = hit(x, X.NUMBERED_EPISODE) | hit(y, X.NUMBERED_EPISODE)
    within = (F.least(F.length(x), F.length(y)) >= 4) & (x.contains(y) | y.contains(x))
    return F.when((x == "") | (y == ""), False).when(x == y, True).when(numbered, False).when(within | F.coalesce(a["qid"] == b["qid"], F.lit(False)), True)


def _opinion(o: Column) -> Column:
    """An opinion as votes see it; o: a struct, with or without ``qid``."""
    return F.struct(*[o[c].alias(c) for c in ("feed_ord", "provider", "value", "confidence", "weak")], normal_title(o["value"]).alias("norm"), o["qid"].alias("qid"))


def agreed(ballots: DataFrame) -> DataFrame:
    """Ballots (``field, all``: a field's opinions in order; other columns stay) with the opinions that count, ``ops``, and which
    of them ``agree``: n * n flags. Only titles and their like may need a ratio, and so Python."""
    explicit = F.exists("all", lambda o: ~o["weak"])
    g = ballots.withColumn("ops", F.filter("all", lambda o: ~o["weak"] | ~explicit)).drop("all")
    pairs = lambda rule: F.flatten(F.transform("ops", lambda a: F.transform("ops", lambda b: rule(a, b))))
    title = F.coalesce(F.col("field").isin(*TITLES), F.lit(False))
    plain = g.filter(~title).withColumn("agree", pairs(lambda a, b: F.coalesce(a["value"] == b["value"], F.lit(False))))
    t = g.filter(title).withColumn("known", pairs(_title_rule))
    t = t.withColumn("asked", F.when(F.exists("known", lambda k: k.isNull()), F.transform("ops", lambda o: o["norm"])).otherwise(F.array().cast("array<string>")))
    return plain.unionByName(t.withColumn("agree", _agreement("asked", "known")).drop("known", "asked"))


def collected(opinions: DataFrame) -> DataFrame:
    """Ballots: a row a file and field with all its opinions in order."""
    v = voters(opinions)
    v = v if "qid" in v.columns else v.withColumn("qid", F.lit(None).cast("string"))
    o = F.struct("feed_ord", "provider", "value", "confidence", "weak", "qid")
    return v.groupBy("file_id", "field").agg(F.array_sort(F.collect_list(_opinion(o))).alias("all"))


def gathered(opinions: DataFrame) -> DataFrame:
    """A row a file and field with its opinions in order, and ``agree``: n * n flags."""
    return agreed(collected(opinions))


def ballots(files: DataFrame) -> DataFrame:
    """Ballots (``file_id, field, at, all``) of files whose opinions come in one row (``file_id, at, opinions``: array of structs of
    feed_ord, provider, field, value, confidence, weak, qid): what ``gathered`` collects, without a shuffle."""
    fine = F.filter("opinions", lambda o: F.coalesce(o["value"], F.lit("")) != "")
    f = files.withColumn("opinions", fine)
    f = f.select("file_id", "at", "opinions", F.explode(F.array_distinct(F.transform("opinions", lambda o: o["field"]))).alias("field"))
    mine = F.filter("opinions", lambda o: o["field"] == F.col("field"))
    mine = F.transform(mine, lambda o: o.withField("weak", F.coalesce(o["weak"], F.lit(False)) & F.col("field").isin(*X.EXPENSIVE)))
    return f.select("file_id", "field", "at", F.array_sort(F.transform(mine, _opinion)).alias("all"))


CLUSTER = "array<struct<lead:int,members:array<int>,score:double,vw:double>>"


def clusters(g: DataFrame) -> DataFrame:
    """Single-pass clustering in feed order; the leader is the value of the largest base weight, then the shortest."""
    n = F.size("ops")

    def effective(o: Column, field: Column) -> Column:
        return weight(field, o["provider"]) * F.coalesce(o["confidence"], F.lit(1.0)) * F.when(o["weak"], X.WEAK_FACTOR).otherwise(1.0)

    def step(acc: Column, i: Column) -> Column:
        o = F.element_at("ops", i + 1)
        base, eff = weight(F.col("field"), o["provider"]), effective(o, F.col("field"))
        at = F.array_position(F.transform(acc, lambda c: F.element_at("agree", (c["lead"] * n + i + 1).cast("int"))), F.lit(True))
        new = F.struct(i.cast("int").alias("lead"), F.array(i.cast("int")).alias("members"), eff.alias("score"), base.alias("vw"))

        def joined(c: Column) -> Column:
            old = F.element_at("ops", c["lead"] + 1)["value"]
            better = (base > c["vw"]) | ((base == c["vw"]) & (F.length(o["value"]) < F.length(old)))
            return F.struct(
                F.when(better, i.cast("int")).otherwise(c["lead"]).alias("lead"), F.array_append(c["members"], i.cast("int")).alias("members"),
                (c["score"] + eff).alias("score"), F.when(better, base).otherwise(c["vw"]).alias("vw"),
            )

        return let(at, lambda k: F.when(k == 0, F.array_append(acc, new)).otherwise(F.transform(acc, lambda c, j: F.when(j == k - 1, joined(c)).otherwise(c))))

    only = F.element_at("ops", 1)  # most fields have one opinion
    alone = F.array(F.struct(F.lit(0).alias("lead"), F.array(F.lit(0)).alias("members"), effective(only, F.col("field")).alias("score"), weight(F.col("field"), only["provider"]).alias("vw")))
    out = F.when(n == 1, alone).otherwise(F.aggregate(F.sequence(F.lit(0), n - 1), F.from_json(F.lit("[]"), CLUSTER), step))
    return g.select(*[c for c in g.columns if c != "agree"], out.alias("clusters"))


def verdicts(opinions: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """``file_id, field, value, providers, share, posterior, by_priority, decision, usable`` for each voted field.

    scores: ``provider, field, score`` from earlier runs, the third tie-break; it has a row a provider and field.
    """
    return judged(gathered(opinions), scores)


def judged(g: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """Verdicts on gathered opinions; columns besides ``field, ops, agree`` stay."""
    c = clusters(g)
    keep = [c for c in g.columns if c not in ("field", "ops", "agree")]
    if scores is not None:
        s = scores.groupBy("field").agg(F.map_from_entries(F.collect_list(F.struct("provider", "score"))).alias("succ"))
        c = c.join(F.broadcast(s), "field", "left")  # a row for each of the fixed fields
    else:
        c = c.withColumn("succ", F.lit(None).cast("map<string,double>"))

    def ranked(k: Column, j: Column) -> Column:
        ops = F.transform(k["members"], lambda i: F.element_at("ops", i + 1))
        value = F.element_at("ops", k["lead"] + 1)["value"]
        total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, y: a + y)
        conf = F.filter(F.transform(ops, lambda o: o["confidence"]), lambda v: v.isNotNull())
        return F.struct(
            (-k["score"]).alias("by_score"), (-F.array_max(F.transform(ops, lambda o: weight(F.col("field"), o["provider"], 0.0)))).alias("by_weight"),
            (-total(F.transform(ops, lambda o: F.coalesce(F.try_element_at("succ", o["provider"]), F.lit(0.0))))).alias("by_success"),
            hit(value, X.NUMBERED_EPISODE).cast("int").alias("placeholder"), (-F.exists(ops, lambda o: o["provider"] == "filename").cast("int")).alias("named"), j.alias("ord"),
            value.alias("value"), F.transform(ops, lambda o: o["provider"]).alias("providers"), k["score"].alias("score"),
            F.when(F.size(conf) > 0, total(conf) / F.size(conf)).otherwise(1.0).alias("mean"), F.coalesce(F.array_max(conf), F.lit(1.0)).alias("most"),
        )

    c = c.withColumn("r", F.array_sort(F.transform("clusters", ranked)))
    win, run = F.col("r")[0], F.try_element_at("r", F.lit(2))
    settled = F.struct(win.alias("w"), F.coalesce(run["score"], F.lit(0.0)).alias("run"), run.isNotNull().alias("rival"), F.aggregate("r", F.lit(0.0), lambda a, k: a + k["score"]).alias("total"))
    # as a generator's row: else a filter of the verdicts would be moved below, with all of the above in it, once for each mention of a winner
    c = c.select(*keep, "field", F.inline(F.array(settled)))
    c = c.withColumn("share", F.when(F.col("total") > 0, F.col("w.score") / F.col("total")).otherwise(0.0))
    n, score = F.size("w.providers"), F.col("w.score")
    tied = F.col("rival") & (F.abs(score - F.col("run")) < 1e-9)
    agreed = (n >= 2) & (score > F.col("run")) & (F.col("share") * F.col("w.mean") >= X.CONSENSUS_CONFIDENCE)
    alone = (n == 1) & (F.col("total") == score) & (score > X.SINGLE_EFFECTIVE) & (F.col("w.most") >= X.SINGLE_CONFIDENCE)
    dear = F.when(agreed, "accept").when(tied, "skip").when(alone, "accept").otherwise("skip")
    cheap = F.when((n >= 2) | (F.col("share") >= X.CHEAP_SHARE), "accept").otherwise("guess")
    decision = F.when(F.col("field").isin(*X.EXPENSIVE), dear).otherwise(cheap)
    posterior = F.least(score / F.when(F.col("total") == 0, 1.0).otherwise(F.col("total")) * F.col("w.mean"), F.lit(X.POSTERIOR_CAP))
    return c.select(*keep, "field", F.col("w.value").alias("value"), F.col("w.providers").alias("providers"), "share", posterior.alias("posterior"), tied.alias("by_priority"), decision.alias("decision")).withColumn("usable", F.col("decision") != "skip")


def vote(opinions: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """Verdicts whose confidence is the winner's share of all weight."""
    return verdicts(opinions, scores).drop("posterior").withColumnRenamed("share", "confidence")


def fuse(opinions: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """Verdicts whose confidence is the share times the winners' mean confidence."""
    return verdicts(opinions, scores).drop("share").withColumnRenamed("posterior", "confidence")


def fuse_same(opinions: DataFrame) -> DataFrame:
    """``fuse`` of files many of which say the same of a field: each different ballot is judged once. Ballots meet their
    verdicts by all that they hold; nothing else of a file counts in a vote."""
    b = cut_lineage(collected(opinions))
    v = cut_lineage(judged(agreed(b.select("field", "all").distinct().withColumn("__same", F.col("all")))))
    v = v.drop("share").withColumnRenamed("posterior", "confidence")
    return frequent_join(b.withColumnRenamed("all", "__same"), v, ["field", "__same"], once=True).select("file_id", *[c for c in v.columns if c != "__same"])


def readings(opinions: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """What ``vote`` and ``fuse`` say together, from one vote: their verdicts differ in the confidence only, the ``share`` of the
    one and the ``posterior`` of the other."""
    return verdicts(opinions, scores)


def usable_values(v: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """A row a file with the usable value of each field."""
    return v.filter("usable").groupBy("file_id").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields])


def update_scores(opinions: DataFrame, v: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """``provider, field, score``: one more for each win among two voters or more; losers keep theirs."""
    o = opinions.filter(F.col("value").isNotNull() & (F.col("value") != "")).select("file_id", "field", "provider")
    o = o.join(v.select("file_id", "field", "providers"), ["file_id", "field"])
    enough = o.groupBy("file_id", "field").agg(F.collect_list("provider").alias("voters"), F.first("providers").alias("providers")).filter(F.size("voters") >= 2)
    new = enough.select("field", F.explode("voters").alias("provider"), "providers").select("provider", "field", F.array_contains("providers", F.col("provider")).cast("double").alias("score"))
    return reduce(DataFrame.unionByName, [new, *([scores] if scores is not None else [])]).groupBy("provider", "field").agg(F.sum("score").alias("score"))
