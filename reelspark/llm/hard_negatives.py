"""Hard negatives of embeddings: rows of other labels that score just below an anchor's positives.

Each anchor is scored against all rows. Rows stay where they are, in blocks of bounded size; the anchors, a stated query
set, are written once to the shared folder as files of bounded size that every task goes through, so nothing but what
comes out of a block is shuffled. Within a block an anchor's scores are sorted in full (by score, then id):

1. The first rows of its label are candidates for its positives; a window over all blocks' candidates picks them.
2. In the same order, a binary search finds each positive's upper limit, and the first rows of other labels from there
   down to the lower limit are candidates for its negatives; again a window picks them.

Scores are exact: products of whole numbers, summed in single or double precision where no sum can leave the numbers
that are exact there, else as 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import new_path, open_store, written

#: Bytes of vectors in a block of rows, anchors of a file, and scores that are sorted at a time.
BLOCK_BYTES, ANCHORS, SCORES = 32 << 20, 1024, 1 << 20
#: Vectors of whole numbers from this length on take no part: a hundred times a product must fit 64 bits.
LONGEST = float(1 << 28)


def _vectors(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _exact(most: float) -> type:
    """The fastest type in which sums of products up to this size are exact."""
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


def _length(x: np.ndarray) -> float:
    return float(np.sqrt((x.astype(np.float64) ** 2).sum(axis=1).max(initial=0))) + 1


def _scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    kind = _exact(_length(anchors) * _length(rows))
    return (anchors.astype(kind) @ rows.T.astype(kind)).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(dimensions, ids, labels, vectors) of rows of one length, by id; a block has BLOCK_BYTES of vectors at most."""
    held: dict[int, list] = {}

    def block(d: int):
        ids, labels, x = (np.concatenate(c) for c in zip(*held.pop(d), strict=True))
        order = np.lexsort((labels, ids))
        return d, ids[order], labels[order], x[order]

    for batch in batches:
        v = batch.column("v")
        sizes = np.asarray(v.value_lengths())
        for d in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == d)
            most = max(1, BLOCK_BYTES // (8 * max(d, 1)))
            for a in range(0, len(at), most):
                part = batch.take(pa.array(at[a : a + most]))
                if sum(len(h[0]) for h in held.get(d, ())) + len(part) > most:
                    yield block(d)
                held.setdefault(d, []).append((part.column("id").to_numpy(), part.column("label").to_numpy(), _vectors(part.column("v")) if d else np.zeros((len(part), 0), np.int64)))
    for d in list(held):
        yield block(d)


def _save(batches: Iterator[pa.RecordBatch], root: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Anchors of one length to files of at most ANCHORS rows; a row a file."""
    from uuid import uuid4

    for batch in batches:
        sizes = np.asarray(batch.column("v").value_lengths())
        for d in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == d)
            for a in range(0, len(at), ANCHORS):
                path = f"{root}/anchors-{uuid4().hex}.arrow"
                with open_store(path, "w") as sink, pa.ipc.new_stream(sink, schema) as out:
                    out.write_batch(pa.RecordBatch.from_arrays(batch.take(pa.array(at[a : a + ANCHORS])).columns, schema=schema))
                yield pa.RecordBatch.from_pydict({"d": pa.array([d], pa.int32()), "path": [path]})


def _saved(anchors: DataFrame, name: str) -> dict[int, list[str]]:
    """Paths of the anchors' files by length of the vectors: one for about ANCHORS rows, or each of a partition's batches."""
    spark = anchors.sparkSession
    n = anchors.count()
    a = anchors.repartition(max(1, -(-n // ANCHORS)), "anchor")
    schema = pa.schema([("anchor", pa.int64()), ("id", pa.int64()), ("label", pa.int64()), ("v", pa.list_(pa.int64())), *([("positives", pa.list_(pa.int64()))] if "positives" in a.columns else [])])
    out: dict[int, list[str]] = {}
    for r in written(a.mapInArrow(partial(_save, root=new_path(spark, name), schema=schema), "d int, path string"), name).toLocalIterator():
        out.setdefault(r.d, []).append(r.path)
    return out


def _sorted(batches: Iterator[pa.RecordBatch], files: dict[int, list[str]]):
    """For each block and anchor: (anchor's row, anchor's label, its id, scores from the highest on, the rows' ids, their labels)."""
    for d, ids, labels, x in _blocks(batches):
        for path in files.get(d, ()):
            with open_store(path, "r") as source:
                table = pa.ipc.open_stream(source).read_all().combine_chunks()
            rows = table.drop_columns("v").to_pylist()
            v = _vectors(table.column("v").combine_chunks()) if d else np.zeros((len(rows), 0), np.int64)
            step = max(1, SCORES // len(ids))
            for a in range(0, len(rows), step):
                for row, score in zip(rows[a : a + step], _scores(v[a : a + step], x), strict=True):
                    order = np.argsort(-score, kind="stable")  # rows are in the order of their ids
                    yield row, score[order], ids[order], labels[order]


def _positives(batches: Iterator[pa.RecordBatch], files: dict[int, list[str]], most: int) -> Iterator[pa.RecordBatch]:
    for row, score, ids, labels in _sorted(batches, files):
        at = np.flatnonzero((labels == row["label"]) & (ids != row["id"]))[:most]
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), row["anchor"])), pa.array(ids[at]), pa.array(score[at])], names=["anchor", "id", "score"])


def _negatives(batches: Iterator[pa.RecordBatch], files: dict[int, list[str]], most: int, low: int, high: int) -> Iterator[pa.RecordBatch]:
    for row, score, ids, labels in _sorted(batches, files):
        other = np.flatnonzero(labels != row["label"])
        falling = -score[other]
        for k, p in enumerate(row["positives"]):
            first = np.searchsorted(falling, -p, side="left")
            at = other[first : first + most]
            at = at[low * p <= high * score[at]]
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), row["anchor"])), pa.array(np.full(len(at), k, np.int32)), pa.array(ids[at]), pa.array(score[at])], names=["anchor", "k", "id", "score"])


def _together(run, batches: Iterator[pa.RecordBatch], rows: int = 8192, **more) -> Iterator[pa.RecordBatch]:
    """The small batches of ``run`` as larger ones."""
    held, n = [], 0
    for b in run(batches, **more):
        held.append(b)
        n += len(b)
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def hard_negatives(vectors: DataFrame, is_anchor: Column, *, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` from ``vectors`` (``vec_id`` and ``label``
    whole numbers, ``embedding``).

    A component x counts as floor(scale * x); a score is the inner product with the anchor, ties go to the smaller
    vec_id. Positives are an anchor's first rows of its label with another vec_id; the negatives of each are the first
    rows of other labels with low * positive_score <= high * negative_score <= high * positive_score. An anchor without
    positives, and a positive without negatives, has no row.

    Rows with a null vec_id or label, a null vector or any null or non-finite component take no part, nor do those
    whose scaled vector is 2**28 long or longer. Rows are compared where their vectors have one length; of empty
    vectors all scores are 0. Repeated rows each count, as anchors, positives and negatives. An empty table gives an
    empty table; other columns don't reach the result.
    """
    spark = vectors.sparkSession
    x = F.transform(F.col("embedding").cast("array<double>"), lambda c: F.floor(c * F.lit(float(scale))))
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) * float(scale) < LONGEST))
    v = vectors.filter(is_anchor.isNotNull() & F.coalesce(fine & F.col("vec_id").isNotNull() & F.col("label").isNotNull(), F.lit(False)))
    v = v.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), x.alias("v"), is_anchor.alias("asks"))
    v = written(v.filter(F.aggregate("v", F.lit(0.0), lambda t, c: t + c.cast("double") * c) < LONGEST * LONGEST), "vectors")
    rows = v.select("id", "label", "v")
    anchors = written(v.filter("asks").select(F.monotonically_increasing_id().alias("anchor"), "id", "label", "v"), "anchors")
    best = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))
    found = rows.mapInArrow(partial(_together, _positives, files=_saved(anchors, "anchors"), most=positives), "anchor long, id long, score long")
    top = found.withColumn("k", best("anchor")).filter(F.col("k") <= positives)
    top = written(top.select("anchor", (F.col("k") - 1).alias("k"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    each = top.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "positive_score"))), lambda p: p["positive_score"]).alias("positives"))
    files = _saved(anchors.join(each, "anchor").select("anchor", "id", "label", "v", "positives"), "anchors")
    found = rows.mapInArrow(partial(_together, _negatives, files=files, most=negatives, low=low, high=high), "anchor long, k int, id long, score long")
    found = found.withColumn("rank", best("anchor", "k")).filter(F.col("rank") <= negatives)
    out = found.join(top, ["anchor", "k"]).join(anchors.select("anchor", F.col("id").alias("anchor_id")), "anchor")
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """All vectors; every seventh has the label after its own, every hundredth is an anchor."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    v = v.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(v, F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.id AS a, b.id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON len(a.e) = len(b.e) AND a.id <> b.id WHERE a.id % 100 = 0
), positives AS (
  SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id) <= 5
)
SELECT p.a AS anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.id ORDER BY n.score DESC, n.id) AS INT) AS rank,
  n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.a = p.a AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY row_number() OVER (PARTITION BY p.a, p.id ORDER BY n.score DESC, n.id) <= 5
"""
