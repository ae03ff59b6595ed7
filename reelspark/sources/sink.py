"""Carrying out a plan: renames that never overwrite, in an order that frees names in time, under a journal.

A file whose new name another file of the plan still holds must wait for that one. Files that wait for each other are a
chain; chains are found by pointer doubling and each is carried out by one task, in path order. Everything else is
dealt freely.

The renames are a data source writer (``spark`` format ``renames``). Before it makes a name, a task writes the file's
identity (device, inode, size and time of change), old and new path to a journal of its attempt. An attempt that
finds a file gone, or a name in the way, looks into what other attempts and earlier runs have written: the file is where the
journal says if what lies there has its identity. So a repeated or speculative task reports the names that files really
have. Outcomes go to a file of the attempt; the commit message names it, and the manifest, written once all tasks are
done, lists those of the attempts that count.
"""

from __future__ import annotations

import ctypes
import errno
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from reelspark.plans.cut import cut, shared_folder

AT_FDCWD, NO_REPLACE = -100, 1
UNSUPPORTED = (errno.EPERM, errno.EOPNOTSUPP, errno.ENOTSUP, errno.ENOSYS, errno.EXDEV)
#: Rows for the writer, entries of the journal, and outcomes.
TASKS = "file_id string, path string, new_name string, dest_name string, known array<struct<identity:string,new:string>>"
ENTRY = "identity string, old string, new string"
OUTCOME = "file_id string, done_name string, failure string"


def _rename_no_replace(source: str, dest: str) -> None:
    """Linux's rename that fails where dest exists; OSError(ENOSYS) where there is none."""
    call = getattr(ctypes.CDLL(None, use_errno=True), "renameat2", None)
    if call is None:
        raise OSError(errno.ENOSYS, "no atomic rename")
    if call(AT_FDCWD, os.fsencode(source), AT_FDCWD, os.fsencode(dest), NO_REPLACE):
        e = ctypes.get_errno()
        raise (FileExistsError if e == errno.EEXIST else OSError)(e, os.strerror(e), dest)


def rename_no_clobber(source: str, dest: str) -> None:
    """FileExistsError if dest exists, a dangling link included. A hard link makes the name or fails; where links
    aren't possible, an atomic rename that replaces nothing does, or else nothing happens but an OSError."""
    try:
        os.link(source, dest, follow_symlinks=False)
    except OSError as e:
        if e.errno not in UNSUPPORTED:
            raise
        _rename_no_replace(source, dest)
        return
    try:
        os.unlink(source)
    except FileNotFoundError:  # another attempt has removed the old name of the same file
        pass
    except OSError:
        os.unlink(dest)
        raise


def free_name(directory: str, name: str, reserved: set[str]) -> str:
    base, ext = os.path.splitext(name)
    n, out = 0, name
    while out in reserved or os.path.lexists(os.path.join(directory, out)):
        n += 1
        out = f"{base}_{n}{ext}"
    return out


def identity(path: str) -> str | None:
    """What stays the same when a file gets another name; null if nothing lies there."""
    try:
        s = os.lstat(path)
    except OSError:
        return None
    return f"{s.st_dev}:{s.st_ino}:{s.st_size}:{s.st_mtime_ns}"


class Journal:
    """What the attempts of one task write before they make a name: a file an attempt, a line a name."""

    def __init__(self, folder: str):
        os.makedirs(folder, exist_ok=True)
        self.folder, self.mine = folder, f"{uuid.uuid4().hex}.jsonl"
        self.out = open(os.path.join(folder, self.mine), "a")

    def intend(self, who: str, old: str, new: str) -> None:
        self.out.write(json.dumps({"identity": who, "old": old, "new": new}) + "\n")
        self.out.flush()
        os.fsync(self.out.fileno())

    def of_others(self, old: str) -> list[tuple[str, str]]:
        """(identity, new path) that other attempts intended for a path, the last first."""
        out = []
        for name in sorted(os.listdir(self.folder)):
            if name != self.mine:
                with open(os.path.join(self.folder, name)) as lines:
                    for line in lines:
                        try:
                            e = json.loads(line)
                        except ValueError:  # the attempt was lost while it wrote
                            continue
                        if e["old"] == old:
                            out.append((e["identity"], e["new"]))
        return out[::-1]

    def close(self) -> None:
        self.out.close()


@dataclass
class Outcomes(WriterCommitMessage):
    path: str


def _moved(path: str, known: list[tuple[str, str]]) -> str | None:
    """The name that a file which has gone from ``path`` was given, if it still is there."""
    return next((os.path.basename(new) for who, new in known if identity(new) == who), None)


def move(row: Row, journal: Journal, wanted: set[str]) -> str:
    """Move one file; the name that it has got. OSError if it can't be moved."""
    path, name = row.path, row.dest_name
    folder = os.path.dirname(path)
    known = lambda: journal.of_others(path) + [(k["identity"], k["new"]) for k in row.known or ()]
    while True:
        who = identity(path)
        if who is None:
            if done := _moved(path, known()):
                return done
            raise FileNotFoundError(errno.ENOENT, os.strerror(errno.ENOENT), path)
        dest = os.path.join(folder, name)
        journal.intend(who, path, dest)
        try:
            rename_no_clobber(path, dest)
            return name
        except FileNotFoundError:
            continue
        except FileExistsError:
            if identity(dest) == who and (who, dest) in known():  # a lost attempt's second name of this very file
                try:
                    os.unlink(path)
                except FileNotFoundError:
                    pass
                return name
            name = free_name(folder, row.new_name, wanted)
            wanted.add(name)


class RenameWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[Row]) -> Outcomes:
        task = TaskContext.get()
        part = task.partitionId() if task else 0
        journal = Journal(os.path.join(self.folder, "journal", f"{part:06d}"))
        out = os.path.join(self.folder, f"outcome-{part:06d}-{uuid.uuid4().hex}.jsonl")
        wanted: set[str] = set()
        with open(out, "w") as lines:
            for row in iterator:
                wanted.add(row.dest_name)
                try:
                    done, failure = move(row, journal, wanted), None
                except OSError as e:
                    done, failure = None, str(e)
                lines.write(json.dumps({"file_id": row.file_id, "done_name": done, "failure": failure}) + "\n")
        journal.close()
        return Outcomes(out)

    def commit(self, messages: list[Outcomes | None]) -> None:
        draft = os.path.join(self.folder, f"manifest-{uuid.uuid4().hex}")
        with open(draft, "w") as f:
            json.dump([m.path for m in messages if m], f)
        os.replace(draft, os.path.join(self.folder, "manifest.json"))

    def abort(self, messages: list[Outcomes | None]) -> None:
        """Files that were moved stay moved; the journal has their names."""


class Renames(DataSource):
    @classmethod
    def name(cls) -> str:
        return "renames"

    def schema(self) -> str:
        return TASKS

    def writer(self, schema, overwrite: bool) -> RenameWriter:
        return RenameWriter(self.options["path"])


def chains(moves: DataFrame) -> DataFrame:
    """``path, chain`` for each of the moves (``path, dest``, full paths, each once): files that wait for one another, because
    one's new name is another's old one, have the same chain, a circle of names too."""
    holder = moves.select(F.col("path").alias("to"))
    p = moves.select(F.col("path").alias("a"), F.col("dest").alias("to")).join(holder, "to").select("a", "to", F.least("a", "to").alias("low"))
    ends = p.select("a").withColumn("more", F.lit(True))
    p = cut(p.join(ends.withColumnRenamed("a", "to"), "to", "left").select("a", "to", "low", F.col("more").isNull().alias("done")))
    open_, rounds = p.filter("not done").count(), 0
    while open_ and rounds <= open_.bit_length():  # what is open after that many rounds is a circle
        far = p.select(F.col("a").alias("to"), F.col("to").alias("far"), F.col("low").alias("far_low"), F.col("done").alias("far_done"))
        p = cut(p.join(far, "to", "left").select("a", F.when(F.col("done"), F.col("to")).otherwise(F.col("far")).alias("to"), F.least("low", "far_low").alias("low"), (F.col("done") | F.col("far_done")).alias("done")))
        rounds += 1
    linked = p.select(F.col("a").alias("path"), F.when(F.col("done"), F.col("to")).otherwise(F.col("low")).alias("chain"))
    return moves.select("path").join(linked, "path", "left").select("path", F.coalesce("chain", "path").alias("chain"))


def earlier(spark, journal: str) -> DataFrame:
    """``path, known`` from the journals of all earlier runs in a folder."""
    entries = spark.read.schema(ENTRY).option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").option("mode", "DROPMALFORMED").json(f"file://{journal}")
    return entries.filter("old is not null and new is not null").groupBy(F.col("old").alias("path")).agg(F.collect_set(F.struct("identity", "new")).alias("known"))


def apply(planned: DataFrame, dry_run: bool = False, journal: str | None = None) -> DataFrame:
    """The plan (as of ``plans.pipeline.plan``; file_ids differ) with ``status`` as carried out: errors where a file has gone. A
    name that was taken meanwhile gets the next suffix that is free on disk and that no other file of the plan's task wants.

    The renames are done once, here. With a ``journal`` (a folder that all executors see), a plan that was broken off
    can be applied again: files that were moved then are reported by the names they have. Else the journal lasts as long as the call.
    All executors must see the files.
    """
    if dry_run:
        return cut(planned)
    spark = planned.sparkSession
    p = cut(planned.withColumn("file_id", F.col("file_id").cast("string")))
    root = journal or shared_folder(spark, "renames")
    folder = os.path.join(root, uuid.uuid4().hex)
    os.makedirs(folder)
    todo = p.filter("status = 'renamed'")
    order = chains(todo.select("path", F.concat(F.regexp_extract("path", r"^(.*/)?[^/]*$", 1), "dest_name").alias("dest")).dropDuplicates(["path"]))
    rows = todo.select("file_id", "path", "new_name", "dest_name").join(order, "path").join(earlier(spark, root), "path", "left")
    rows = rows.repartition("chain").sortWithinPartitions("chain", "path").select("file_id", "path", "new_name", "dest_name", "known")
    spark.dataSource.register(Renames)
    rows.write.format("renames").mode("append").save(folder)
    with open(os.path.join(folder, "manifest.json")) as f:
        files = json.load(f)
    done = spark.read.schema(OUTCOME).json([f"file://{x}" for x in files]) if files else spark.createDataFrame([], OUTCOME)
    out = p.join(done, "file_id", "left").withColumns({
        "dest_name": F.coalesce("done_name", "dest_name"), "status": F.when(F.col("failure").isNotNull(), "error").otherwise(F.col("status")), "reason": F.coalesce("failure", "reason"),
    })
    kind = dict(planned.dtypes)["file_id"]
    return cut(out.withColumn("file_id", F.col("file_id").cast(kind)).select(planned.columns))
