"""Near-duplicate vectors: an exact metric range join within each label.

Cosine at least ``least`` is a Euclidean distance of at most eps = sqrt(2 - 2 least) between unit vectors. Pivots (a
bounded sample of each large label) split a label into cells, each vector being at home with its nearest pivot p. By
the triangle inequality a vector y can only have a partner at home with pivot q if y lies within eps of the boundary
between its nearest pivot's cell and q's: (|yq|^2 - |yp|^2) / (2 |pq|) <= eps. There y is replicated, and cells join
independently: each finds all partners of the vectors at home in it. Large cells are joined in blocks of bounded size,
each block pair by itself.

The pivots form a tree of two levels: a label is split by some of them, and each part by those that lie in it. A vector
goes down to its own cell and, by the same bound on each level, to all cells where it may have partners; so the
distances to a few hundred pivots place it among tens of thousands of cells.

Equal vectors are one point with a count from the start. A block pair returns the number of partners of each vector
and a spanning forest of its links, so a dense group gives rows in proportion to its size; components are contracted
from the forests. In data without structure (independent directions in many dimensions) nearly every vector is within
eps of every boundary, by any metric; the join is then all pairs, in blocks, and as exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import group_key, written
from .components import connected_components

#: Points at home in a cell, about; pivots of all labels together, and their bytes; points of a block.
CELL, MAX_PIVOTS, PIVOT_BYTES, BLOCK = 2000, 1 << 16, 32 << 20, 4096
#: Distances that are held at a time.
DISTANCES = 1 << 21
#: Added to eps, so that rounding never loses a replica. Links themselves are decided by the cosine.
SLACK = 1e-6


def _units(lists: pa.ListArray) -> np.ndarray:
    x = lists.values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _near(unit: np.ndarray, pivots: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, pivot, is it the nearest) for the nearest pivot of each vector and those beyond whose boundary a partner
    may lie. Distances are worked out for some rows at a time, those between pivots for the nearest ones only."""
    rows, cells, own = [], [], []
    step = max(1, DISTANCES // len(pivots))
    for a in range(0, len(unit), step):
        square = np.maximum(0, 2 - 2 * (unit[a : a + step] @ pivots.T))
        home = square.argmin(axis=1)
        apart = np.sqrt(np.maximum(0, 2 - 2 * (pivots[home] @ pivots.T)))
        at = np.arange(len(home))
        near = square - square[at, home][:, None] <= 2 * (eps + SLACK) * apart + SLACK
        near[at, home] = True
        row, cell = np.nonzero(near)
        rows.append(row + a), cells.append(cell), own.append(home[row] == cell)
    return np.concatenate(rows), np.concatenate(cells), np.concatenate(own)


@dataclass
class Tree:
    """The pivots of a label: ``top``, and for each of them those of its part, whose cells are numbered from ``first``."""

    top: np.ndarray
    parts: list[np.ndarray]
    first: np.ndarray

    @staticmethod
    def of(pivots: np.ndarray) -> Tree:
        top = pivots[: math.isqrt(len(pivots))]
        home = np.concatenate([(pivots[i : i + 4096] @ top.T).argmax(axis=1) for i in range(0, len(pivots), 4096)])
        parts = [pivots[home == k] if np.any(home == k) else top[k : k + 1] for k in range(len(top))]
        return Tree(top, parts, np.cumsum([0, *map(len, parts)])[:-1])

    def place(self, unit: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, is it the home) of each vector; a row has one home."""
        row, part, own = _near(unit, self.top, eps)
        out = []
        for k in np.unique(part):
            at = np.flatnonzero(part == k)
            r, c, home = _near(unit[row[at]], self.parts[k], eps)
            out.append((row[at][r], c + self.first[k], home & own[at][r]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _assign(batches: Iterator[pa.RecordBatch], trees: Broadcast, eps: float) -> Iterator[pa.RecordBatch]:
    """(grp, cell, home, id, cnt, unit) for the home cell of each point and those it is replicated to."""
    for batch in batches:
        for start in range(0, len(batch), 2048):
            part = batch.slice(start, 2048)
            groups = np.array(part.column("grp").to_pylist(), object)
            for g in dict.fromkeys(groups):
                rows = part.take(pa.array(np.flatnonzero(groups == g)))
                unit = _units(rows.column("embedding").combine_chunks() if isinstance(rows.column("embedding"), pa.ChunkedArray) else rows.column("embedding"))
                tree = trees.value.get(g)
                at, cell, is_home = tree.place(unit, eps) if tree else (np.arange(len(unit)), np.zeros(len(unit), np.int64), np.ones(len(unit), bool))
                for a in range(0, len(at), 8192):
                    i = at[a : a + 8192]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([g] * len(i), pa.string()), pa.array(cell[a : a + 8192].astype(np.int32)), pa.array(is_home[a : a + 8192]), rows.column("id").take(pa.array(i)),
                        rows.column("cnt").take(pa.array(i)), pa.array([u.tobytes() for u in unit[i]], pa.binary()),
                    ], names=["grp", "cell", "home", "id", "cnt", "unit"])


def forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """(id, root) links that span the components of a bipartite block of links."""
    out = []
    new_left, new_right = linked.any(axis=1), linked.any(axis=0)
    for first in np.flatnonzero(new_left):
        if not new_left[first]:
            continue
        new_left[first] = False
        root, todo = int(left[first]), [(0, first)]
        while todo:
            side, i = todo.pop()
            found = np.flatnonzero(linked[i] & new_right if side == 0 else linked[:, i] & new_left)
            (new_right if side == 0 else new_left)[found] = False
            ids = (right if side == 0 else left)[found]
            out.extend((int(x), root) for x in ids if x != root)
            todo.extend((1 - side, int(j)) for j in found)
    return out


def _join(table: pa.Table, least: float) -> pa.Table:
    """Partners counted (b null) and links (n null) of one block pair."""
    lefts, rights = (table.filter(pa.array(np.array(table.column(c).to_pylist(), bool))) for c in ("is_left", "is_right"))
    a, b = (np.frombuffer(b"".join(t.column("unit").to_pylist()), np.float64).reshape(len(t), -1) if len(t) else np.empty((0, 1)) for t in (lefts, rights))
    ia, ib = (t.column("id").to_numpy() for t in (lefts, rights))
    cnt = rights.column("cnt").to_numpy()
    ids, n, x, y = [], [], [], []
    if len(ia) and len(ib):
        linked = np.empty((len(ia), len(ib)), bool)
        for s in range(0, len(ia), 512):
            linked[s : s + 512] = a[s : s + 512] @ b.T >= least
            linked[s : s + 512] &= ia[s : s + 512, None] != ib[None, :]
            n.extend((linked[s : s + 512] @ cnt.astype(np.float64)).astype(np.int64).tolist())
        ids = ia.tolist()
        some = [(i, k) for i, k in zip(ids, n, strict=True) if k]
        ids, n = [i for i, _ in some], [k for _, k in some]
        links = forest(linked, ia, ib) if some else []
        x, y = [p for p, _ in links], [q for _, q in links]
    long = pa.int64()
    return pa.table({"a": pa.array([*ids, *x], long), "b": pa.array([*[None] * len(ids), *y], long), "n": pa.array([*n, *[None] * len(x)], long)})


def near_vectors(vectors: DataFrame, *, least: float = 0.93, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id``: a row a row of ``vectors`` (``vec_id`` long, ``embedding``, ``label``).

    Rows are compared where labels are equal and not null and vectors have one length. Null, empty and zero vectors,
    those with null or non-finite components, and rows without a vec_id link with nothing (n_links 0, component_id
    their vec_id). n_links counts rows, copies included; component_id is the smallest vec_id reachable by links. An
    empty table gives an empty table; other columns don't reach the result. The last join, on the vectors themselves,
    rests on adaptive execution to split a vector that a large part of all rows share.
    """
    spark = vectors.sparkSession
    e = F.col("embedding").cast("array<double>")
    norm = F.aggregate(e, F.lit(0.0), lambda t, x: t + x * x)
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce((norm > 0) & (norm < float("inf")) & ~F.isnan(norm), F.lit(False))
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(fine, F.concat_ws("/", F.size("embedding"), group_key(F.col("label")))).alias("grp"), F.when(fine, e).alias("embedding"))
    v = written(v, "vectors")
    points = v.filter("grp is not null").groupBy("grp", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("cnt"))
    points = written(points, "points")
    sizes = points.groupBy("grp").agg(F.count("*").alias("n")).filter(F.col("n") > cell)
    big, width = sizes.agg(F.sum("n")).first()[0] or 0, points.agg(F.max(F.size("embedding"))).first()[0] or 1
    most = max(64, min(MAX_PIVOTS, PIVOT_BYTES // (8 * width)))
    per = max(cell, -(-big // most))
    u = F.pmod(F.xxhash64("embedding", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    chosen = points.join(sizes, "grp").filter(u < F.ceil(F.col("n") / per) / F.col("n")).select("grp", "embedding")
    found = chosen.limit(2 * most).toArrow()  # ``most`` on average: any pivots do
    names = np.array(found.column("grp").to_pylist(), object)
    trees = spark.sparkContext.broadcast({g: Tree.of(_units(found.filter(pa.array(names == g)).column("embedding").combine_chunks())) for g in dict.fromkeys(names)})  # PIVOT_BYTES, twice at most
    eps = float(np.sqrt(2 - 2 * least))
    cells = written(points.mapInArrow(partial(_assign, trees=trees, eps=eps), "grp string, cell int, home boolean, id long, cnt long, unit binary"), "cells")
    counts = cells.groupBy("grp", "cell").agg(F.ceil(F.count_if("home") / block).alias("nh"), F.ceil(F.count("*") / block).alias("na")).filter("nh > 0")
    c = cells.join(counts, ["grp", "cell"]).withColumns({"hb": F.pmod(F.xxhash64("id", F.lit(1)), "nh"), "rb": F.pmod(F.xxhash64("id", F.lit(2)), "na")})
    c = c.withColumn("tasks", F.array_union(F.when(F.col("home"), F.transform(F.sequence(F.lit(0), F.col("na") - 1), lambda i: F.struct(F.col("hb").alias("h"), i.cast("long").alias("r")))).otherwise(F.array().cast("array<struct<h:bigint,r:bigint>>")), F.transform(F.sequence(F.lit(0), F.col("nh") - 1), lambda i: F.struct(i.cast("long").alias("h"), F.col("rb").alias("r")))))
    c = c.select("grp", "cell", "home", "id", "cnt", "unit", "hb", "rb", F.explode("tasks").alias("t"))
    c = c.select("grp", "cell", "id", "cnt", "unit", F.col("t.h").alias("h"), F.col("t.r").alias("r"), (F.col("home") & (F.col("hb") == F.col("t.h"))).alias("is_left"), (F.col("rb") == F.col("t.r")).alias("is_right"))

    def run(table: pa.Table) -> pa.Table:
        return _join(table, least)

    found = written(c.groupBy("grp", "cell", "h", "r").applyInArrow(run, "a long, b long, n long"), "vector-links")
    partners = found.filter("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("partners"))
    roots = connected_components(found.filter("b is not null").select("a", "b"))
    each = points.join(partners, "id", "left").join(roots, "id", "left").select("grp", "embedding", F.col("id").alias("point"), "cnt", "partners", "root")
    out = v.join(each, ["grp", "embedding"], "left")
    return out.select("vec_id", (F.coalesce("partners", F.lit(0)) + F.coalesce(F.col("cnt") - 1, F.lit(0))).alias("n_links"), F.coalesce("root", "point", "vec_id").alias("component_id"))


def op2_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """All vectors at cosine 0.93. A row without a vec_id is kept."""
    out = near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), fine AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND list_count(e) = len(e)
    AND isfinite(list_dot_product(e, e)) AND list_dot_product(e, e) > 0
), links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM fine x JOIN fine y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.93
), reach(vec_id, other) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other
), parts AS (
  SELECT vec_id, min(other) AS component_id FROM reach GROUP BY ALL
)
SELECT p.vec_id, (SELECT count(*) FROM links WHERE a = p.vec_id)::BIGINT AS n_links, component_id::BIGINT AS component_id, p.vec_id = component_id AS kept FROM parts p
"""
