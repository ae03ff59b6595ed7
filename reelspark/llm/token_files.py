"""Token-id output: Arrow stream files of fixed-size-list batches.

Documents go to files in ascending id order. A file's ids are cut into sequences of equal length; a record batch holds
a fixed number of them as ``ids`` (fixed-size list of the smallest unsigned type that fits the vocabulary) and
``mask`` (fixed-size list of booleans, false for the padding after the last id). Nothing is compressed, so a
memory-mapped file gives any sequence and its mask without a copy. Beside each token file lies a small Arrow stream
with ``doc_id, start, n_tokens``, start counted within the file.

A task writes under a name of its own attempt and reports the name in the manifest; what lost or repeated attempts
wrote is in no manifest and is never read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import new_path, open_store, text_chunks, written
from ._tokens import encoder

MANIFEST = "part long, tokens_path string, docs_path string, docs long, tokens long"
DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _schema(dtype: np.dtype, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])


class Writer:
    """Collects ids and writes batches of ``rows`` sequences of ``length`` ids."""

    def __init__(self, path: str, dtype: np.dtype, length: int, rows: int):
        self.schema, self.dtype, self.length, self.rows = _schema(dtype, length), dtype, length, rows
        self.sink = open_store(path, "w")
        self.out = pa.ipc.new_stream(self.sink, self.schema)
        self.held, self.size = [], 0

    def _batch(self, ids: np.ndarray, real: int) -> pa.RecordBatch:
        mask = np.zeros(len(ids), bool)
        mask[:real] = True
        cols = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        return pa.RecordBatch.from_arrays(cols, schema=self.schema)

    def add(self, ids: bytes) -> None:
        self.held.append(ids)
        self.size += len(ids)
        full = self.rows * self.length * self.dtype.itemsize
        if self.size >= full:
            data = b"".join(self.held)
            cut = len(data) // full * full
            for a in range(0, cut, full):
                ids = np.frombuffer(data, self.dtype, self.rows * self.length, a)
                self.out.write_batch(self._batch(ids, len(ids)))
            self.held, self.size = [data[cut:]], len(data) - cut

    def close(self) -> None:
        ids = np.frombuffer(b"".join(self.held), self.dtype)
        if len(ids):
            padded = np.zeros(-(-len(ids) // self.length) * self.length, self.dtype)
            padded[: len(ids)] = ids
            self.out.write_batch(self._batch(padded, len(ids)))
        self.out.close()
        self.sink.close()


class TokenFile:
    """Random access to the sequences of one token file: ``f[i]`` gives views of the i-th ids and their mask."""

    def __init__(self, path: str):
        self.source = open_store(path, "r")
        self.batches = list(pa.ipc.open_stream(self.source))
        self.rows = len(self.batches[0]) if self.batches else 1

    def __len__(self) -> int:
        return sum(map(len, self.batches))

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.Array]:
        batch, k = self.batches[i // self.rows], i % self.rows
        ids, mask = batch.column(0), batch.column(1)
        n = ids.type.list_size
        return ids.values.slice(k * n, n).to_numpy(zero_copy_only=True), mask.values.slice(k * n, n)


def _write(batches: Iterator[pa.RecordBatch], root: str, tokenizer: str, end_id: int, length: int, rows: int) -> Iterator[pa.RecordBatch]:
    enc = encoder(tokenizer, end_id)
    part, name = TaskContext.get().partitionId(), uuid.uuid4().hex
    out = None
    tokens, total = f"{root}/tokens-{part:06d}-{name}.arrow", 0
    at = f"{root}/docs-{part:06d}-{name}.arrow"
    docs = 0
    for chunk, texts in text_chunks(batches, "text", keeps=True):
        if out is None:
            out, sink = Writer(tokens, enc.dtype, length, rows), open_store(at, "w")
            index = pa.ipc.new_stream(sink, DOCS)
        counts = np.empty(len(texts), np.int64)
        for k, ids in enumerate(enc.encode_all(texts)):
            out.add(ids)
            counts[k] = len(ids) // enc.dtype.itemsize
        starts = total + np.cumsum(counts) - counts
        index.write_batch(pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array(starts), pa.array(counts)], schema=DOCS))
        total += int(counts.sum())
        docs += len(texts)
    if out is not None:
        out.close()
        index.close()
        sink.close()
        yield pa.RecordBatch.from_pydict({"part": [part], "tokens_path": [tokens], "docs_path": [at], "docs": [docs], "tokens": [total]})


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, *, length: int = 2048, rows: int = 256) -> DataFrame:
    """Write all documents (``doc_id`` long, ``text``; null text counts as empty) and return the manifest, a row a file.

    Files follow each other in ascending doc_id (null ids first; equal ids in the order of their texts' hashes; repeated
    rows are written as often as they come). Texts of any length are encoded whole and may fill many sequences. A table
    without rows gives an empty manifest and no files. Other columns aren't read, so no name can clash.
    """
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tie", F.xxhash64("text"))
    d = d.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    run = partial(_write, root=new_path(spark, "token-files"), tokenizer=tokenizer, end_id=end_id, length=length, rows=rows)
    return written(d.mapInArrow(run, MANIFEST), "manifest")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for manifest in batches:
        for f in manifest.to_pylist():
            with open_store(f["tokens_path"], "r") as source, open_store(f["docs_path"], "r") as listed:
                seqs = iter(pa.ipc.open_stream(source))
                now, used = np.empty(0, np.uint32), 0
                for docs in pa.ipc.open_stream(listed):
                    crcs = np.empty(len(docs), np.int64)
                    for k, n in enumerate(docs.column("n_tokens").to_pylist()):
                        crc = 0
                        while n:
                            if used == len(now):
                                batch = next(seqs)
                                now, used = batch.column(0).values.to_numpy(), 0
                            take = min(n, len(now) - used)
                            crc = zlib.crc32(now[used : used + take].astype("<u4").tobytes(), crc)
                            n, used = n - take, used + take
                        crcs[k] = crc
                    starts = pc.add(docs.column("start"), f["before"])
                    yield pa.RecordBatch.from_arrays([docs.column("doc_id"), starts, docs.column("n_tokens"), pa.array(crcs)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(manifest: DataFrame) -> DataFrame:
    """A row a document, from the files: ``doc_id, start`` (over all files)``, n_tokens, ids_crc32``."""
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    m = manifest.withColumn("before", F.coalesce(F.sum("tokens").over(order), F.lit(0).cast("long")))
    m = m.repartition(max(1, manifest.count()))
    return m.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_files(spark, sf_dir: str) -> DataFrame:
    """All documents as byte-level BPE ids, written and read back."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read_token_files(write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), 2))
