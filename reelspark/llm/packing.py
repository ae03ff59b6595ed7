"""Packing documents into sequences: best fit, in decreasing order.

Overlong documents are first cut into full windows; the rests, longest first, each go to the open window with the
least room that still holds them, found by a segment tree over the remaining room. Pieces are dealt into groups of
bounded size by a hash and each group is packed by itself: with tens of thousands of pieces a group, what a group
wastes is a window or two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import text_chunks, written
from ._tokens import encoder

#: Pieces that are packed together, about.
GROUP_PIECES = 50_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class Room:
    """A segment tree over 0 to ``capacity``: which amounts of remaining room some open window has."""

    def __init__(self, capacity: int):
        self.base = 1 << capacity.bit_length()
        self.some = bytearray(2 * self.base)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, window: int) -> None:
        self.open[room].append(window)
        k = self.base + room
        while k and not self.some[k]:
            self.some[k] = 1
            k >>= 1

    def tightest(self, least: int) -> int:
        """The smallest room of at least ``least`` that a window has; -1 without one."""
        some, k = self.some, self.base + least
        while not some[k]:
            while k & 1:  # a right child: what follows it lies beside an ancestor
                k >>= 1
            if not k:
                return -1
            k += 1  # from a left child to the leaves right of it
        while k < self.base:
            k = 2 * k if some[2 * k] else 2 * k + 1
        return k - self.base

    def take(self, room: int) -> int:
        window = self.open[room].pop()
        if not self.open[room]:
            k = self.base + room
            self.some[k] = 0
            k >>= 1
            while k and not (self.some[2 * k] or self.some[2 * k + 1]):
                self.some[k] = 0
                k >>= 1
        return window


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """The window and the offset of each of ``lengths``, which descend; all are from 1 to capacity."""
    room, windows, offsets, count = Room(capacity), [], [], 0
    for n in lengths:
        r = room.tightest(n)
        if r < 0:
            w, r, count = count, capacity, count + 1
        else:
            w = room.take(r)
        windows.append(w)
        offsets.append(capacity - r)
        if r > n:
            room.put(r - n, w)
    return windows, offsets


def _pieces(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, capacity: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    enc = encoder(tokenizer, end_id)
    width = enc.dtype.itemsize
    for chunk, texts in text_chunks(batches, "text", keeps=True):
        rows = []
        for doc, ids in zip(chunk.column("doc_id").to_pylist(), enc.encode_all(texts), strict=True):
            total = len(ids) // width
            for a in range(0, total, capacity):
                part = np.frombuffer(ids, enc.dtype, min(capacity, total - a), a * width).astype("<u4").tobytes()
                rows.append((doc, a, len(part) // 4, zlib.crc32(part), total, *((part,) if keep_ids else ())))
        cols = [pa.array(c, pa.int64()) for c in list(zip(*rows, strict=True))[:5]]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        if keep_ids:
            cols, names = [*cols, pa.array([r[5] for r in rows], pa.binary())], [*names, "ids"]
        yield pa.RecordBatch.from_arrays(cols, names=names)


def _pack(table: pa.Table, capacity: int) -> pa.Table:
    table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
    windows, offsets = best_fit(table.column("length").to_pylist(), capacity)
    group = table.column("pack_group")[0].as_py() if len(table) else 0
    table = table.drop_columns(["pack_group"])
    table = table.append_column("sequence_id", pa.array((np.array(windows, np.int64) + (group << 32))))
    return table.append_column("offset", pa.array(offsets, pa.int64()))


def pack_sequences(docs: DataFrame, tokenizer: str, end_id: int, *, capacity: int = 4096, keep_ids: bool = False, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """A row a piece of ``docs`` (``doc_id`` long, ``text``), with its sequence and its offset there.

    Null text counts as empty: such a document is its end id. Ids of each document lie in exactly one piece; with
    ``keep_ids`` a piece carries them (``ids``, little-endian 32-bit). Repeated rows are packed as often as they
    come; of pieces of one length, any order is as good, and reruns agree on it but for rows without an id. Texts of any
    length are cut into full windows first. A sequence's pieces leave no gap before its padding. An empty table gives an empty table; columns other than
    ``doc_id`` and ``text`` don't reach the result, so no name can clash.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = PIECES + (", ids binary" if keep_ids else "")
    pieces = written(d.mapInArrow(partial(_pieces, tokenizer=tokenizer, end_id=end_id, capacity=capacity, keep_ids=keep_ids), schema), "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    spread = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())  # rows without an id are all alike
    pieces = pieces.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", spread), F.lit(groups)))

    def run(table: pa.Table) -> pa.Table:
        return _pack(table, capacity)

    return pieces.groupBy("pack_group").applyInArrow(run, f"{schema}, sequence_id long, offset long")


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents as word-level BPE ids, in sequences of at most 4096."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_sequences(docs, public_tokenizers.path("word_bpe_49k.json"), 2)
