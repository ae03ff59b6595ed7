"""Destination names that don't collide, as if files were renamed one after another in path order.

A taken name gets the smallest free ``_N`` before its extension. A name is taken if the batch has given it to an earlier
file, in any directory, or if it lies in the file's own directory. In a real run the name of a file that was moved
before is free again (``sequential``); in a dry run nothing moves, and all names that lie there stay taken.

Each wanted name is a sequence of names, number 0 the name itself and number N with the suffix. Where one name alone is
wanted in a family (names that differ in suffixes only) and none of the family lies beside a file, the n-th file gets
number n. In all other families runs of files, next to each other in path order, that want one name and see the same
names beside them, are settled as one row, however many files they have: a run takes the first free numbers of its sequence
as intervals, gaps left by names that are taken or wanted themselves, and its files find theirs by rank. What settles
a family is a row a run, an interval of neighbouring suffixes or a name that is freed, never a row a file, but for files that
free names of the family they want.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspark.functions.base import cut
from reelspark.operators.joins import frequent_join
from reelspark.plans.cut import cut as cut_lineage


def _split(name: Column) -> tuple[Column, Column]:
    ext = F.regexp_extract(name, r"(?<=.)(\.[^.]*)$", 1)
    return F.substring(name, F.lit(1), F.length(name) - F.length(ext)), ext


def suffixed(name: Column, n: Column) -> Column:
    base, ext = _split(name)
    return F.when(n == 0, name).otherwise(F.concat(base, F.lit("_"), n.cast("string"), ext))


def family(name: Column) -> Column:
    """What a name and all its suffixed forms share."""
    base, ext = _split(name)
    return F.concat(cut(base, r"(?:_\d+)+$"), ext)


def places(name: Column) -> Column:
    """The sequences in which a name stands: array of (name, number); its own, and that of the name without its suffix."""
    base, ext = _split(name)
    n = F.regexp_extract(base, r"^.*_([1-9]\d{0,17})$", 1)
    own = F.struct(name.alias("name"), F.lit(0).cast("long").alias("number"))
    other = F.struct(F.concat(F.substring(base, F.lit(1), F.length(base) - F.length(n) - 1), ext).alias("name"), n.try_cast("long").alias("number"))
    return F.when(n == "", F.array(own)).otherwise(F.array(own, other))


class Spans:
    """Disjoint intervals of numbers that are not next to each other."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []  # the last number of each

    def end(self, x: int) -> int | None:
        """The last number of the interval that holds x."""
        i = bisect_right(self.starts, x) - 1
        return self.ends[i] if i >= 0 and self.ends[i] >= x else None

    def next(self, x: int) -> float:
        i = bisect_right(self.starts, x)
        return self.starts[i] if i < len(self.starts) else float("inf")

    def add(self, a: int, b: int) -> None:
        i, j = bisect_right(self.ends, a - 2), bisect_right(self.starts, b + 1)
        if i < j:
            a, b = min(a, self.starts[i]), max(b, self.ends[j - 1])
        self.starts[i:j], self.ends[i:j] = [a], [b]

    def remove(self, x: int) -> None:
        i = bisect_right(self.starts, x) - 1
        if i >= 0 and self.ends[i] >= x:
            a, b = self.starts[i], self.ends[i]
            left = [(p, q) for p, q in ((a, x - 1), (x + 1, b)) if p <= q]
            self.starts[i : i + 1], self.ends[i : i + 1] = [p for p, _ in left], [q for _, q in left]


class Settled:
    """What is taken of a family, run by run."""

    def __init__(self, wanted: dict[str, list[tuple[str, int]]]):
        """wanted: the places of each wanted name."""
        self.taken: dict[str, Spans] = defaultdict(Spans)
        self.held: dict[tuple[str, str], Spans] = defaultdict(Spans)
        self.low: dict[tuple[str, str], int] = defaultdict(int)  # below it, only what is in ``freed`` may be free
        self.freed: dict[tuple[str, str], list[int]] = defaultdict(list)
        self.parent = {n: p[1] for n, p in wanted.items() if len(p) > 1 and p[1][0] in wanted}
        self.children: dict[str, list[tuple[int, str]]] = defaultdict(list)  # wanted names that are numbers of another
        for n, (p, k) in self.parent.items():
            self.children[p].append((k, n))
        for c in self.children.values():
            c.sort()

    def free(self, folder: str, name: str, number: int) -> None:
        self.held[folder, name].remove(number)
        if number < self.low[folder, name]:
            heapq.heappush(self.freed[folder, name], number)

    def take(self, name: str, folder: str, n: int) -> list[tuple[int, int]]:
        """(first number, how many) of the intervals of the first n numbers that are free in the folder ("" for folders in
        which nothing of the family lies)."""
        taken, held, key, out = self.taken[name], self.held[folder, name], (folder, name), []
        while n and self.freed[key]:
            x = heapq.heappop(self.freed[key])
            if taken.end(x) is None:
                out.append((x, 1))
                n -= 1
        at = self.low[key]
        while n:
            end = taken.end(at)
            end = held.end(at) if end is None else end
            if end is not None:
                at = end + 1
                continue
            m = int(min(n, min(taken.next(at), held.next(at)) - at))
            out.append((at, m))
            at, n = at + m, n - m
        self.low[key] = at
        for a, m in out:
            taken.add(a, a + m - 1)
            if a == 0 and name in self.parent:
                p, k = self.parent[name]
                self.taken[p].add(k, k)
            of = self.children.get(name, ())
            for k, child in of[bisect_right(of, (a, "")) :]:
                if k >= a + m:
                    break
                self.taken[child].add(0, 0)
        return out


#: Runs of a group of families, about.
RUNS = 20_000
SETTLED = "family string, part int, run long, rank long, number long"


def _settle(runs: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
    """The intervals that each run of some families takes: numbers from ``number`` on for the files from ``rank`` on.

    runs: ``family, part, run`` (their order), kind (0 for a run, 1 for a freed name), new_name, places, folder, n; held:
    ``family, folder, name, first, last``."""
    wanted: dict[str, dict] = defaultdict(dict)
    for f, kind, n, x in zip(runs["family"], runs["kind"], runs["new_name"], runs["places"], strict=True):
        if not kind:
            wanted[f][n] = [(p["name"], p["number"]) for p in x]
    settled = {f: Settled(w) for f, w in wanted.items()}
    for r in held.sort_values("first").itertuples():
        s = settled[r.family]
        (s.held[r.folder, r.name] if isinstance(r.folder, str) else s.taken[r.name]).add(r.first, r.last)
    out = []
    for r in runs.sort_values(["part", "run"]).itertuples():
        s = settled[r.family]
        if r.kind:
            for p in r.places:
                s.free(r.folder, p["name"], p["number"])
            continue
        rank = 0
        for a, m in s.take(r.new_name, r.folder, r.n):
            out.append((r.family, r.part, r.run, rank, a))
            rank += m
    return pd.DataFrame(out, columns=["family", "part", "run", "rank", "number"])


def _ranked(df: DataFrame) -> DataFrame:
    """df with ``n``: the number of rows of the same new_name before a row, by path. No task holds more rows of a name
    than a partition has: rows are dealt by ranges, and counts move the ranks within them."""
    d = cut_lineage(df.repartitionByRange("new_name", "path", "file_id").withColumn("range", F.spark_partition_id()))
    order = Window.partitionBy("new_name").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = d.groupBy("new_name", "range").agg(F.count("*").alias("c")).withColumn("before", F.coalesce(F.sum("c").over(order), F.lit(0)))
    local = F.row_number().over(Window.partitionBy("new_name", "range").orderBy("path", "file_id")) - 1
    d = d.withColumn("local", local).join(before.drop("c"), ["new_name", "range"])
    return d.withColumn("n", F.col("local") + F.col("before")).drop("local", "before", "range")


def _settled(w: DataFrame, held: DataFrame) -> DataFrame:
    """``file_id, new_name, n`` for files (``family, file_id, path, dir, new_name``) of families that hold more than one name.

    held: ``family, dir, name, freed_at`` (the path of the file that frees it, or null); without a dir, a name is taken everywhere."""
    held = held.withColumn("folder", F.concat(F.lit("="), F.col("dir")))
    beside = held.filter("dir is not null").select("family", "dir", "folder").distinct()
    w = frequent_join(w, beside, ["family", "dir"], "left").withColumn("folder", F.coalesce("folder", F.lit("")))
    rows = w.select("family", "path", "file_id", F.lit(0).alias("kind"), "new_name", "folder")
    frees = held.filter("freed_at is not null").select("family", F.col("freed_at").alias("path"), F.lit(None).cast(dict(w.dtypes)["file_id"]).alias("file_id"), F.lit(1).alias("kind"), F.col("name").alias("new_name"), "folder")
    d = cut_lineage(rows.unionByName(frees).repartitionByRange("family", "path").withColumn("part", F.spark_partition_id()))
    order = Window.partitionBy("family", "part").orderBy("path", "kind", "file_id")
    what = F.struct("kind", "new_name", "folder")
    starts = (F.col("kind") == 1) | F.coalesce(F.lag(what).over(order) != what, F.lit(True))
    d = cut_lineage(d.withColumn("run", F.sum(starts.cast("long")).over(order)).withColumn("rank", (F.row_number().over(Window.partitionBy("family", "part", "run").orderBy("path", "kind", "file_id")) - 1).cast("long")))
    runs = d.groupBy("family", "part", "run").agg(F.min("kind").alias("kind"), F.min("new_name").alias("new_name"), F.min("folder").alias("folder"), F.count("*").alias("n")).withColumn("places", places(F.col("new_name")))
    p = held.select("family", "folder", F.explode(places(F.col("name"))).alias("p")).select("family", "folder", "p.*").distinct()
    island = F.col("number") - F.row_number().over(Window.partitionBy("family", "folder", "name").orderBy("number"))
    spans = p.withColumn("island", island).groupBy("family", "folder", "name", "island").agg(F.min("number").alias("first"), F.max("number").alias("last")).drop("island")


    def settle(runs: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        return _settle(runs, held)

    runs = cut_lineage(runs)
    some = F.pmod(F.xxhash64("family"), F.lit(1 + runs.count() // RUNS))  # many small families are one group
    took = runs.groupBy(some).cogroup(spans.groupBy(some)).applyInPandas(settle, SETTLED)
    files = d.filter("kind = 0").select("family", "part", "run", "rank", "file_id", "new_name", F.lit(None).cast("long").alias("shift"))
    both = files.unionByName(took.select("family", "part", "run", "rank", (F.col("number") - F.col("rank")).alias("shift")), allowMissingColumns=True)
    upto = Window.partitionBy("family", "part", "run").orderBy("rank", F.col("shift").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("n", F.col("rank") + F.last("shift", ignorenulls=True).over(upto))
    return both.filter("new_name is not null").select("file_id", "new_name", "n")


def allocate(wanted: DataFrame, existing: DataFrame | None = None, *, sequential: bool = False, reserved: DataFrame | None = None) -> DataFrame:
    """``file_id, dest_name`` for each row of ``wanted`` (``file_id, path, dir, new_name``); existing: ``dir, name``; reserved:
    ``name``, given by earlier batches and taken in all directories.

    A file that already has its name keeps it and takes none. Names of ``existing`` are taken in their directory; with
    ``sequential`` those of files of ``wanted`` only until the file is moved, in path order, as in a real run.
    """
    w = cut_lineage(wanted.select("file_id", "path", "dir", "new_name").withColumn("old", F.substring_index("path", "/", -1)))  # worked out once
    same = w.filter("old = new_name").select("file_id", F.col("new_name").alias("dest_name"))
    w = cut_lineage(w.filter("old <> new_name").withColumn("family", family(F.col("new_name"))))
    kinds = w.groupBy("family").agg(F.min("new_name").alias("lo"), F.max("new_name").alias("hi")).filter("lo <> hi").select("family")
    kind = dict(wanted.dtypes)["file_id"]
    if existing is None:
        held = w.sparkSession.createDataFrame([], "family string, dir string, name string, freed_at string")
    else:
        held = existing.select("dir", "name").distinct().withColumn("family", family(F.col("name")))
        held = held.join(w.select("family", "dir").distinct(), ["family", "dir"], "left_semi")
        if sequential:
            moved = w.groupBy("dir", F.col("old").alias("name")).agg(F.max("path").alias("freed_at"))
            held = held.join(moved, ["dir", "name"], "left")
        else:
            held = held.withColumn("freed_at", F.lit(None).cast("string"))
        held = held.select("family", "dir", "name", "freed_at")
    if reserved is not None:
        given = reserved.select("name").distinct().withColumns({"family": family(F.col("name")), "dir": F.lit(None).cast("string"), "freed_at": F.lit(None).cast("string")})
        held = held.unionByName(given.join(w.select("family").distinct(), "family", "left_semi"))
    held = cut_lineage(held)
    mixed = cut_lineage(kinds.union(held.select("family")).distinct().withColumn("mixed", F.lit(True)))
    w = frequent_join(w, mixed, ["family"], "left")
    plain = _ranked(w.filter("mixed is null").select("file_id", "path", "new_name")).select("file_id", "new_name", "n")
    settled = _settled(w.filter("mixed").select("family", "file_id", "path", "dir", "new_name"), held)
    given = plain.unionByName(settled).select(F.col("file_id").cast(kind).alias("file_id"), suffixed(F.col("new_name"), F.col("n")).alias("dest_name"))
    return same.unionByName(given)
