r"""WARC archives in seekable Zstandard bundles.

An archive is a row of independent Zstandard frames, each of some whole records, and a skippable frame with the seek
table: the sizes of all frames before and after compression and a footer, as in the public seekable format, so any
Zstandard reader can read it from end to end. The index maps a record's identifier to archive, frame and the record's
offset and length in the frame; a reader fetches and unpacks that frame only.

Pages go to archives in ascending page_id order by one shuffle of their texts. Of equal payloads the one with the
smallest page_id is a response, the others are revisits that name it. Payloads meet by their digests only: digests
that more than a ten-thousandth of all pages share, and so are at most ten thousand, are broadcast, the others are
joined by a shuffle in which no key has more rows than that. What makes a page a revisit rides to its archive as a row
of its own, sorted just before the page.

A task writes files under names of its own attempt; only those in the written index count.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import new_path, open_store, text_chunks, written

#: Fixed values of the seekable format: magic numbers of the seek table's frame and of its footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Bytes of records in a frame, and bytes of an archive, about: a record is never split.
FRAME, ARCHIVE = 1 << 18, 1 << 30
#: A digest is hot if more than one in so many pages has it.
HOT = 10_000
LEVEL = 3
INDEX = "page_id long, record_id string, archive string, frame long, offset long, length long"
RECORDS = "page_id long, record_id string, record_type string, refers_to long, url string, payload_bytes long, payload_digest string, payload string"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _line(value: str) -> str:
    """A header's value: control characters as their escapes, so that no text can end a line."""
    return "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in value)


def make_record(page_id: int | None, url: str | None, payload: bytes, first: int | None, date: str) -> tuple[str, bytes]:
    """(identifier, record): a response with the payload, or a revisit of the page ``first`` that has the same one."""
    digest = digest_of(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    rid = record_id(page_id, digest)
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {rid}", f"WARC-Date: {date}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if first is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(first, digest)}", f"X-Refers-To-Page-ID: {first}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return rid, "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, where the next record begins) of the record that begins at ``at``."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC record begins here")
    head = dict(x.split(": ", 1) for x in lines[1:])
    begin = end + 4
    stop = begin + int(head["Content-Length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("a WARC record is cut short")
    return head, data[begin:stop], stop + 4


class BundleWriter:
    """An archive that is being written: records are held until they fill a frame."""

    def __init__(self, path: str, frame: int):
        self.path, self.frame = path, frame
        self.sink, self.pack = open_store(path, "w"), zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)
        self.held, self.size, self.table, self.written = [], 0, [], 0

    def add(self, record: bytes) -> tuple[int, int]:
        """(frame, offset in it) of the record. A record that doesn't fit in what is left of a frame begins the next one."""
        if self.size and self.size + len(record) > self.frame:
            self._flush()
        at = len(self.table), self.size
        self.held.append(record)
        self.size += len(record)
        return at

    def _flush(self) -> None:
        packed = self.pack.compress(b"".join(self.held))
        self.sink.write(packed)
        self.table.append((len(packed), self.size))
        self.written += len(packed)
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.held:
            self._flush()
        entries = b"".join(struct.pack("<II", *x) for x in self.table)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(self.table), 0, SEEKABLE))
        self.sink.close()


class Bundle:
    """Random access to the frames of one archive, by the seek table at its end."""

    def __init__(self, path: str):
        self.source = open_store(path, "r")
        size = self.source.size()
        count, flags, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != SEEKABLE:
            raise ValueError(f"no seek table at the end of {path}")
        width = 12 if flags & 0x80 else 8  # with checksums of the frames or not
        table = self._read(size - 9 - count * width, count * width)
        self.sizes = [struct.unpack_from("<II", table, i * width) for i in range(count)]
        self.starts, at = [], 0
        for packed, _ in self.sizes:
            self.starts.append(at)
            at += packed

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def __len__(self) -> int:
        return len(self.sizes)

    def frame(self, i: int) -> bytes:
        packed, size = self.sizes[i]
        return zstandard.ZstdDecompressor().decompress(self._read(self.starts[i], packed), max_output_size=size)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.source.close()


def _write(batches: Iterator[pa.RecordBatch], root: str, date: str, frame: int, archive: int) -> Iterator[pa.RecordBatch]:
    part, out, n, rows = TaskContext.get().partitionId(), None, 0, []
    key, first = None, None  # of the revisit that was met last

    def index() -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["page_id", "record_id", "archive", "frame", "offset", "length"])

    name = uuid.uuid4().hex
    for chunk, texts in text_chunks(batches, "html"):
        for page, sha, url, refers, html in zip(*(chunk.column(c).to_pylist() for c in ("page_id", "sha", "url", "first")), texts, strict=True):
            if refers is not None:
                key, first = (page, sha), refers
                continue
            if out is None:
                out = BundleWriter(f"{root}/pages-{part:06d}-{n:04d}-{name}.warc.zst", frame)
            rid, record = make_record(page, url, (html or "").encode(), first if key == (page, sha) else None, date)
            rows.append((page, rid, out.path, *out.add(record), len(record)))
            if out.written >= archive:
                out.close()
                out, n = None, n + 1
            if len(rows) >= 8192:
                yield index()
                rows = []
    if out is not None:
        out.close()
    if rows:
        yield index()


def revisits(pages: DataFrame, least: int = 0, hot: int = HOT) -> DataFrame:
    """``page_id, sha, first`` for each page_id and payload that a smaller page_id has too: pages are
    ``page_id, sha, bytes``; payloads of fewer than ``least`` bytes are left alone."""
    d = written(pages.filter((F.col("bytes") >= least) & F.col("page_id").isNotNull()).select("page_id", "sha").distinct(), "page-digests")
    groups = written(d.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1"), "payload-groups")
    limit = d.count() / hot
    frequent = F.broadcast(groups.filter(F.col("n") > limit).select("sha", "first"))  # ``hot`` rows at most
    rest = groups.filter(F.col("n") <= limit).select("sha", "first")
    found = d.join(frequent, "sha").unionByName(d.join(frequent.select("sha"), "sha", "left_anti").join(rest, "sha"))
    return found.filter("page_id <> first").select("page_id", "sha", "first")


def write_archives(pages: DataFrame, *, payload: Column | None = None, least: int = 0, date: str = "1970-01-01T00:00:00Z", frame: int = FRAME, archive: int = ARCHIVE, hot: int = HOT) -> DataFrame:
    """Write a record for each row of ``pages`` (``page_id`` whole number, ``url``, ``html``) and return the index: where
    the record of each page lies (``page_id, record_id, archive, frame, offset, length``).

    The payload is ``html`` (or the column ``payload``) in UTF-8, null counts as empty. Of the pages with equal payloads of at least
    ``least`` bytes those of the smallest page_id are responses, the others revisits; pages without a page_id are
    always responses and nothing refers to them. Rows that repeat a page_id and payload are alike. Payloads are equal if
    their SHA-256 digests are. A null url leaves its header out. Records are whole in a frame, so a page of any length
    is one; its text must fit a worker's memory, as in any row. A table without rows gives an empty index and no archives.
    """
    spark = pages.sparkSession
    html = F.coalesce((F.col("html") if payload is None else payload).cast("string"), F.lit(""))
    d = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    d = d.withColumn("sha", F.unhex(F.sha2(F.encode("html", "UTF-8"), 256)))
    found = revisits(d.select("page_id", "sha", F.octet_length("html").alias("bytes")), least, hot)
    d = d.withColumn("first", F.lit(None).cast("long")).unionByName(found, allowMissingColumns=True)
    tie = F.when(F.col("page_id").isNull(), F.xxhash64("html", "url", F.monotonically_increasing_id())).otherwise(F.xxhash64("sha"))
    d = d.withColumn("tie", tie).repartitionByRange("page_id", "tie").sortWithinPartitions("page_id", "tie", F.col("first").isNull())
    d = d.select("page_id", "sha", "url", "first", "html")
    run = partial(_write, root=new_path(spark, "warc"), date=date, frame=frame, archive=archive)
    return written(d.mapInArrow(run, INDEX), "warc-index")


def _record(head: dict[str, str], block: bytes) -> tuple:
    """A row of RECORDS; ValueError where a payload isn't what its digest says."""
    http, _, body = block.partition(b"\r\n\r\n")
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = head["WARC-Type"] == "revisit"
    if not revisit and digest_of(body) != digest:
        raise ValueError(f"{head['WARC-Record-ID']}: the payload doesn't have its digest")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    number = lambda key: int(head[key]) if key in head else None
    return number("X-Page-ID"), head["WARC-Record-ID"], head["WARC-Type"], number("X-Refers-To-Page-ID"), head.get("WARC-Target-URI"), size, digest, None if revisit else body.decode()


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    long, text = pa.int64(), pa.string()
    kinds = (("page_id", long), ("record_id", text), ("record_type", text), ("refers_to", long), ("url", text), ("payload_bytes", long), ("payload_digest", text), ("payload", text))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], names=[k for k, _ in kinds])


def _read_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("archive").to_pylist():
            with Bundle(path) as bundle:
                for i in range(len(bundle)):
                    data, at, rows = bundle.frame(i), 0, []
                    while at < len(data):
                        head, block, at = parse_record(data, at)
                        rows.append(_record(head, block))
                    yield _rows(rows)


def read_archives(archives: DataFrame) -> DataFrame:
    """All records of the archives (``archive``, repeats count once), from first to last frame: ``page_id, record_id,
    record_type, refers_to, url, payload_bytes, payload_digest, payload`` (null for revisits). An archive is read by one task."""
    a = archives.select("archive").distinct()
    return a.repartition(max(1, a.count()), "archive").mapInArrow(_read_all, RECORDS)


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    path, at, bundle, data = None, None, None, b""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            if r["archive"] != path:
                if bundle:
                    bundle.source.close()
                path, at, bundle = r["archive"], None, Bundle(r["archive"])
            if r["frame"] != at:
                at, data = r["frame"], bundle.frame(r["frame"])
            head, block, _ = parse_record(data[r["offset"] : r["offset"] + r["length"]])
            rows.append(_record(head, block))
        yield _rows(rows)
    if bundle:
        bundle.source.close()


def fetch_records(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records (columns as of ``read_archives``) of the pages in ``wanted`` (``page_id``), by the index: only the frames
    that hold them are read, each once a task. Pages that aren't in the index have no row."""
    w = index.join(wanted.select("page_id").distinct(), "page_id", "left_semi").select("archive", "frame", "offset", "length")
    return w.repartitionByRange("archive", "frame").sortWithinPartitions("archive", "frame", "offset").mapInArrow(_fetch, RECORDS)


def payloads(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """``page_id, payload`` of the pages in ``wanted``: that of a revisit is read from the response that it refers to."""
    found = fetch_records(index, wanted).select("page_id", "refers_to", "payload_digest", "payload")
    found = written(found, "records")
    far = found.filter("refers_to is not null").select("refers_to").distinct().withColumnRenamed("refers_to", "page_id")
    first = fetch_records(index, far).filter("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload").alias("first_payload")).dropDuplicates(["refers_to", "payload_digest"])
    return found.join(first, ["refers_to", "payload_digest"], "left").select("page_id", F.coalesce("payload", "first_payload").alias("payload"))


def op12_warc_bundles(spark, sf_dir: str) -> DataFrame:
    """A record for every page, written and read back."""
    index = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_archives(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP12_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages
), d AS (
  SELECT *, list_aggregate(list_transform(range(8), lambda i: list_aggregate(list_transform(range(4), lambda j:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, CAST(5 * i + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * j AS INT)) % 32 AS INT) + 1, 1)), 'string_agg', '')), 'string_agg', '') AS digest FROM p
)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""
