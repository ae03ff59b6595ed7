"""What the operators of this subpackage share: written intermediate tables, distributed ranks and Arrow helpers."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows that one bucket of a distributed rank holds on average.
BUCKET_ROWS = 2048
#: Buckets whose sums one task adds up at a time.
SUPER = 1024

_OWN: dict[str, str] = {}
#: What this Python worker keeps from task to task.
_KEPT: dict[Any, Any] = {}


def shared_dir(spark: SparkSession) -> str:
    """A folder that all executors see: the one in ``spark.checkpoint.dir``. Where that is unset, a local session
    gets a temporary folder and a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        key = spark.sparkContext.applicationId
        if key not in _OWN:
            _OWN[key] = "file://" + tempfile.mkdtemp(prefix="shared-")
        found = _OWN[key]
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended, and its folder with it
        pass


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage ends there, and lost executors don't matter."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, df: DataFrame) -> None:
    """Remove a table made by ``written`` that nothing reads any more."""
    for f in df.inputFiles()[:1]:
        _remove(spark, f.rsplit("/", 1)[0])


def _store(path: str):
    """The store of a URI, of any kind that pyarrow knows, and the path in it."""
    from pyarrow import fs

    uri = path if ":" in path.split("/")[0] else f"file://{path}"
    for name in ("s3a:", "s3n:"):  # Hadoop's names of a store that pyarrow calls s3
        uri = uri.replace(name, "s3:", 1) if uri.startswith(name) else uri
    return fs.FileSystem.from_uri(uri)


def stored_rows(path: str) -> Iterator[dict]:
    """The rows of a table that Spark has written as Parquet, one at a time, in a task."""
    from pyarrow import fs, parquet

    store, at = _store(path)
    for f in sorted(store.get_file_info(fs.FileSelector(at)), key=lambda f: f.path):
        if f.base_name.startswith("part-"):
            with store.open_input_file(f.path) as source:
                for batch in parquet.ParquetFile(source).iter_batches(batch_size=1):
                    yield from batch.to_pylist()


def open_store(path: str, mode: str):
    """A stream at a URI of any store that pyarrow knows; local files are memory-mapped for reading."""
    from pyarrow import fs

    store, at = _store(path)
    if mode == "w":
        store.create_dir(at.rpartition("/")[0], recursive=True)
        return store.open_output_stream(at, compression=None)
    return pa.memory_map(at) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(at)


def map_rows(df: DataFrame, run, more: str) -> DataFrame:
    """``df.mapInArrow(run)``, which keeps the columns of ``df``, whatever their names, and adds those of the DDL ``more``."""
    plain = df.toDF(*[c if re.fullmatch(r"\w+", c) else f"__odd_{i}" for i, c in enumerate(df.columns)])
    new = StructType.fromDDL(more).fields
    return plain.mapInArrow(run, StructType([*plain.schema.fields, *new])).toDF(*df.columns, *[f.name for f in new])


def group_key(c: Column) -> Column:
    """Null and every value as a string that is never null, so that groups can be joined on."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))


def exclusive_prefix(sums: DataFrame, groups: list[str], bucket: str, values: list[str]) -> DataFrame:
    """``sums`` (one row a group and bucket) with ``<value>_before``: the sum over the group's smaller buckets.

    In two levels, so that no task holds more than ``SUPER`` buckets of a group, or one row for each ``SUPER`` of them.
    """
    s = sums.withColumn("__super", F.floor(F.col(bucket) / SUPER))
    inner = Window.partitionBy(*groups, "__super").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*groups).orderBy("__super").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    tops = s.groupBy(*groups, "__super").agg(*[F.sum(v).alias(v) for v in values])
    tops = tops.select(*groups, "__super", *[F.coalesce(F.sum(v).over(outer), zero).alias(f"__top_{v}") for v in values])
    s = s.select("*", *[F.coalesce(F.sum(v).over(inner), zero).alias(f"__in_{v}") for v in values])
    s = s.join(tops, [*groups, "__super"])
    return s.select(*groups, bucket, *values, *[(F.col(f"__in_{v}") + F.col(f"__top_{v}")).alias(f"{v}_before") for v in values])


def buckets_for(rows: int) -> int:
    """A power of two, so many buckets that each holds about BUCKET_ROWS of ``rows``."""
    return 1 << max(0, (max(rows, 1) // BUCKET_ROWS).bit_length())


def bucket_of(hashed: Column, n: int) -> Column:
    """The bucket of a 64-bit hash: its leading bits as an unsigned number. Hash order and bucket order agree."""
    bits = n.bit_length() - 1
    return F.shiftrightunsigned(hashed, 64 - bits) if bits else F.lit(0).cast("long")


def kept(key: Any, make: Callable[[], Any]) -> Any:
    """``make()``, kept for this worker's next tasks that ask for ``key``. Spark reuses workers, so the tasks of other stages give it
    back (see ``text_chunks``); of several keys the last stays."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def give_back() -> None:
    """Drops what the worker keeps, and returns to the system what it has freed, where the C library can."""
    _KEPT.clear()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def text_chunks(batches: Iterable[pa.RecordBatch], column: str, chars: int = 1 << 21, keeps: bool = False) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Parts of the batches with about ``chars`` bytes of text at most (a longer text comes alone), and their texts. Unless
    the caller ``keeps`` something, it first gives back what earlier stages left in the worker."""
    if not keeps:
        give_back()
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        sizes = [n or 0 for n in pc.binary_length(col).to_pylist()]
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > chars:
                part = batch.slice(start, i - start)
                yield part, part.column(part.schema.get_field_index(column)).to_pylist()
                start, total = i, 0
            total += n
        if start < len(sizes):
            part = batch.slice(start)
            yield part, part.column(part.schema.get_field_index(column)).to_pylist()
