r"""Removal of lines that repeat across documents.

Two Bloom filters tell keys of lines that were seen once from those that were seen twice. Both are cut into segments by
the key's hash and built where the lines are: a partition sets, for each segment, the bits of the keys it has seen (once)
and of those it has seen in two documents (twice). What travels is the set bits, sorted and compressed, never a line or
its hash. A segment's filters are merged bit by bit: what two partitions have both seen once was seen twice. Few keys
are, so a merged twice-seen filter is folded in half, again and again, until a quarter of its bits would be set: its size
follows the keys that repeat, not all keys. The folded filters are a table in the shared folder. A task collects the
hashes of its keys (HELD_KEYS at a time, more than a partition of usual size has), sorts them by segment and goes through
the table once, with one filter in memory.

A line whose key isn't in the twice-seen filter is unique and never moves. Suspected repeats are shuffled as 128-bit
digests with their document, counted exactly, and the document that keeps a line is chosen; what filters suspect
wrongly ends there. A key found in a third of all documents is one set of bits a partition, and one row a partition
after the partial count.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_rows, new_path, stored_rows, text_chunks, written

SPACE = " \t\n\x0b\x0c\r"
#: Bits for each key, and positions set for each.
BITS, PROBES = 12, 6
#: Bits of a segment at most, and segments at least.
SEGMENT_BITS, SEGMENTS = 1 << 25, 16
#: Bytes of text for each key, about: where lines are shorter, more of them are suspected wrongly.
KEY_BYTES = 40
#: Keys that a task collects before it sets their bits, and before it holds them against the filters.
HELD, HELD_KEYS = 500_000, 2_000_000
#: A filter is folded as long as no more than this part of its bits is set.
FILL = 0.25


def line_key(line: str, least: int) -> bytes | None:
    """The key of a line: stripped, A-Z in lower case, as UTF-8; None if it has fewer than ``least`` code points."""
    line = line.strip(SPACE)
    return line.encode().lower() if len(line) >= least else None


class Shape:
    """How keys fall into segments and bits."""

    def __init__(self, text_bytes: int):
        keys = max(1, text_bytes // KEY_BYTES)
        self.segments = max(SEGMENTS, -(-keys * BITS // SEGMENT_BITS))
        self.bits = 1 << (max(512, -(-keys * BITS // self.segments)) - 1).bit_length()  # a power of two, as folding needs

    def segment(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(40)) % np.uint64(self.segments)).astype(np.int64)

    def places(self, h: np.ndarray) -> np.ndarray:
        """The bits of each key, a row a key."""
        step = (h >> np.uint64(32)) | np.uint64(1)
        return ((h[:, None] + np.arange(1, PROBES + 1, dtype=np.uint64) * step[:, None]) % np.uint64(self.bits)).astype(np.uint32)


def squeezed(places: np.ndarray) -> bytes:
    """Sorted distinct bits, compressed."""
    return zstandard.compress(np.diff(np.unique(places), prepend=np.uint32(0)).astype("<u4").tobytes(), 1)


def restored(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.decompress(data), "<u4"), dtype=np.int64)


def _filters(batches: Iterator[pa.RecordBatch], shape: Shape, least: int) -> Iterator[pa.RecordBatch]:
    """A partition's filters: (segment, bits seen once, bits seen twice)."""

    def built(held: list[int]) -> pa.RecordBatch:
        h, n = np.unique(np.array(held, np.uint64), return_counts=True)
        order = np.argsort(shape.segment(h), kind="stable")
        h, n = h[order], n[order]
        seg = shape.segment(h)
        first = np.flatnonzero(np.diff(seg, prepend=-1))
        parts = [(x, y) for x, y in zip(np.split(h, first[1:]), np.split(n, first[1:]), strict=True)]
        return pa.RecordBatch.from_pydict({
            "segment": pa.array(seg[first], pa.int64()), "once": pa.array([squeezed(shape.places(x)) for x, _ in parts], pa.binary()),
            "twice": pa.array([squeezed(shape.places(x[y > 1])) for x, y in parts], pa.binary()),
        })

    held: list[int] = []
    for _, texts in text_chunks(batches, "text"):
        for text in texts:
            keys = {line_key(x, least) for x in (text or "").split("\n")}
            held.extend(xxhash.xxh3_64_intdigest(k) for k in keys if k is not None)
        if len(held) > HELD:
            yield built(held)
            held = []
    if held:
        yield built(held)


def merged(pieces: list[tuple[bytes, bytes]], bits: int) -> np.ndarray:
    """The twice-seen filter of a segment, a flag a bit: seen twice by a partition, or once by two."""
    once, twice = np.zeros(bits, bool), np.zeros(bits, bool)
    for a, b in pieces:
        new = restored(a)
        twice[new[once[new]]] = True
        once[new] = True
        twice[restored(b)] = True
    return twice


def folded(flags: np.ndarray) -> np.ndarray:
    """The filter as bytes, folded in half while few enough of its bits are set; a power of two of bits in any case."""
    while len(flags) > 512:
        half = flags[: len(flags) // 2] | flags[len(flags) // 2 :]
        if half.mean() > FILL:
            break
        flags = half
    return np.packbits(flags)


def _merge(table: pa.Table, bits: int) -> pa.Table:
    """The segment's twice-seen filter; no row if nothing was seen twice."""
    twice = merged(list(zip(table.column("once").to_pylist(), table.column("twice").to_pylist(), strict=True)), bits)
    found = [folded(twice).tobytes()] if twice.any() else []
    return pa.table({"segment": table.column("segment").slice(0, len(found)), "filter": pa.array(found, pa.binary())})


def holds(filter_: bytes, places: np.ndarray) -> np.ndarray:
    """Which keys (a row of bits each) a folded filter may hold."""
    f = np.frombuffer(filter_, np.uint8)
    places = places & np.uint32(8 * len(f) - 1)
    return ((f[places >> np.uint32(3)] >> (np.uint8(7) - (places & np.uint32(7)).astype(np.uint8))) & 1).all(axis=1)


def _suspects(batches: Iterator[pa.RecordBatch], filters: str, shape: Shape, least: int) -> Iterator[pa.RecordBatch]:
    """(digest, doc_id) of each key of a document that may repeat."""

    def found(docs: array, hashes: array, digests: bytearray) -> Iterator[pa.RecordBatch]:
        h, d = np.frombuffer(hashes, np.uint64), np.frombuffer(docs, np.int64)
        seg = shape.segment(h)
        order = np.argsort(seg, kind="stable")
        seg = seg[order]
        for row in stored_rows(filters):
            at = order[np.searchsorted(seg, row["segment"]) : np.searchsorted(seg, row["segment"], side="right")]
            at = at[holds(row["filter"], shape.places(h[at]))] if len(at) else at
            if len(at):
                yield pa.RecordBatch.from_pydict({"digest": pa.array([bytes(digests[16 * i : 16 * i + 16]) for i in at.tolist()], pa.binary()), "doc_id": pa.array(d[at])})

    docs, hashes, digests = array("q"), array("Q"), bytearray()
    for chunk, texts in text_chunks(batches, "text"):
        for doc, text in zip(chunk.column("doc_id").to_pylist(), texts, strict=True):
            new = {line_key(x, least) for x in text.split("\n")}
            new.discard(None)
            for k in new:
                hashes.append(xxhash.xxh3_64_intdigest(k))
                digests += hashlib.blake2b(k, digest_size=16).digest()
            docs.extend([doc] * len(new))
        if len(hashes) > HELD_KEYS:
            yield from found(docs, hashes, digests)
            docs, hashes, digests = array("q"), array("Q"), bytearray()
    if hashes:
        yield from found(docs, hashes, digests)


def repeated_lines(docs: DataFrame, *, least: int = 20, min_docs: int = 3) -> DataFrame:
    """``doc_id, drop``: for each document that loses lines, the digests of those lines' keys.

    A key of at least ``least`` code points found in ``min_docs`` (2 or more) different documents stays in the
    largest doc_id that holds it only. Rows without a doc_id are not counted and lose nothing.
    """
    if min_docs < 2:
        raise ValueError("min_docs must be 2 or more")
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    shape = Shape(d.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    pieces = d.select("text").mapInArrow(partial(_filters, shape=shape, least=least), "segment long, once binary, twice binary")

    def merge(table: pa.Table) -> pa.Table:
        return _merge(table, shape.bits)

    filters = new_path(spark, "line-filters")
    pieces.groupBy("segment").applyInArrow(merge, "segment long, filter binary").write.option("parquet.block.size", 8 << 20).option("compression", "zstd").parquet(filters)
    found = written(d.mapInArrow(partial(_suspects, filters=filters, shape=shape, least=least), "digest binary, doc_id long"), "line-suspects").distinct()
    kept = found.groupBy("digest").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).filter(F.col("n") >= min_docs)
    lost = found.join(kept.select("digest", "keeper"), "digest").filter("doc_id <> keeper")
    return written(lost.groupBy("doc_id").agg(F.collect_list("digest").alias("drop")), "lines-lost")


def _apply(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for chunk, texts in text_chunks(batches, "text"):
        drops = chunk.column("__drop").to_pylist()
        out, dropped = [], np.zeros(len(texts), np.int64)
        for i, (text, drop) in enumerate(zip(texts, drops, strict=True)):
            if drop:
                gone, lines = set(drop), text.split("\n")
                left = [x for x in lines if (k := line_key(x, least)) is None or hashlib.blake2b(k, digest_size=16).digest() not in gone]
                dropped[i], text = len(lines) - len(left), "\n".join(left)
            out.append(text)
        cols = dict(zip(chunk.schema.names, chunk.columns, strict=True)) | {"text": pa.array(out, pa.string()), "__dropped": pa.array(dropped)}
        yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


def drop_repeated_lines(docs: DataFrame, *, least: int = 20, min_docs: int = 3) -> DataFrame:
    r"""``docs`` without the lines that repeat (see ``repeated_lines``), and ``__dropped``: how many a row has lost.

    Texts are split at ``\n`` and joined again; a text that loses nothing, null or empty ones included, stays as it
    is, one that loses all is empty. Equal doc_ids are one document. Columns that start with two underscores are
    reserved; others pass through. The documents meet their list of lost lines by doc_id: Spark broadcasts the lists
    where they are small and shuffles otherwise.
    """
    lost = repeated_lines(docs, least=least, min_docs=min_docs)
    lost = lost.select(F.col("doc_id").alias("__doc"), F.col("drop").alias("__drop"))
    joined = docs.join(lost, F.col("doc_id").cast("long") == F.col("__doc"), "left").drop("__doc")
    return map_rows(joined, partial(_apply, least=least), "__dropped long").drop("__drop")


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents without the lines that three or more of them share."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.withColumn("n_lines", F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(1)).cast("long"))
    out = drop_repeated_lines(docs)
    return out.select("doc_id", F.greatest("n_lines", F.lit(1)).alias("n_lines"), F.col("__dropped").alias("n_dropped"), F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents
), keyed AS (
  SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), repeated AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT y.doc_id, y.i, y.line, r.k IS NOT NULL AND y.doc_id <> r.keeper AS gone
  FROM keyed y LEFT JOIN repeated r ON y.k = r.k
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
