"""A directory from scan to renames, and the command line for it (``python -m reelspark``)."""

from __future__ import annotations

import argparse
import os
import re
import shutil
import sys
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.functions import names, paths
from reelspark.operators import render as R
from reelspark.plans.cut import cut
from reelspark.plans.lookups import library_at
from reelspark.plans.pipeline import Options, counters, plan
from reelspark.sources import scan, sink
from reelspark.sources.probe import COMMAND, probe_files


def process_directory(spark: SparkSession, directory: str, options: Options | None = None, *, dry_run: bool = False, recursive: bool = True, prober: tuple[str, ...] | None = None) -> tuple[DataFrame, tuple[int, int, int]]:
    """The plan of all video files below a directory as it was carried out (with ``dry_run``: as it would be), and how
    many files were renamed, were seen and failed. prober: the command that prints a file's container facts as JSON;
    files that are skipped aren't probed."""
    found = scan.find_video_files(spark, directory, recursive=recursive).select("path")
    files = cut(found.withColumn("file_id", F.monotonically_increasing_id()))
    options = replace(options or Options(), moves=not dry_run)
    if prober is not None and options.probes is None:
        going = files.filter((paths.supplementary_reason(F.col("path")) == "") & ~names.is_multi_episode(names.basename(F.col("path"))))
        options = replace(options, probes=cut(probe_files(going, prober)))
    done = sink.apply(cut(plan(files, options)), dry_run)
    c = counters(done).first()
    return done, (c.renamed, c.total, c.errors)


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="reelspark", description="Rename video files by what their names and catalogs say.")
    p.add_argument("title", nargs="?", default="", help="name of the show or film, instead of what file names say")
    p.add_argument("-t", "--title", dest="title_opt", default="", metavar="TITLE", help="the same as the argument")
    p.add_argument("-sn", "--season-number", type=int, default=0, help="season of all files")
    p.add_argument("-p", "--pattern", default="", help="template of new names")
    p.add_argument("-n", "--dry-run", action="store_true", help="show new names, rename nothing")
    p.add_argument("-l", "--language", default="", help="language of new names, a code such as en; files whose titles aren't known in it are skipped")
    p.add_argument("--library", default="", metavar="FOLDER", help="tables of catalogs to look titles up in")
    p.add_argument("--probe", action="store_true", help="read container facts, where a prober is installed")
    p.add_argument("-d", "--directory", default="", help="where the files are; the current directory by default")
    return p.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0; 1 where the directory or the library doesn't exist, the language or template is none or a rename failed; 130 where
    it was interrupted."""
    a = arguments(argv)
    try:
        return _run(a, spark)
    except KeyboardInterrupt:
        print("interrupted", file=sys.stderr)
        return 130
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


def _run(a: argparse.Namespace, spark: SparkSession | None) -> int:
    if a.language and not re.fullmatch(r"[a-z]{2,6}(?:-[a-z]+)*", a.language):
        raise ValueError(f"unknown language code {a.language!r}")
    R.fields_of(a.pattern)
    if a.library and not os.path.isdir(a.library):
        raise ValueError(f"library not found: {a.library}")
    directory = os.path.abspath(a.directory or os.getcwd())
    if not os.path.isdir(directory):
        print(f"error: directory not found: {directory}", file=sys.stderr)
        return 1
    spark = spark or SparkSession.builder.appName("reelspark").getOrCreate()
    raw = a.title.strip() or a.title_opt.strip()
    known = spark.range(1).select(names.clean_title(F.lit(raw))).first()[0] if raw else ""
    library = replace(library_at(spark, os.path.abspath(a.library), a.language or "en"), explicit=bool(a.language)) if a.library else None
    options = Options(known_title=known, template=a.pattern, season=a.season_number, library=library)
    prober = COMMAND if a.probe and shutil.which(COMMAND[0]) else None
    done, (renamed, total, errors) = process_directory(spark, directory, options, dry_run=a.dry_run, prober=prober)
    for r in done.filter("status <> 'unchanged'").orderBy("path").toLocalIterator():
        print(f"{r.status}: {r.path} -> {r.dest_name} {r.reason}".rstrip())
    print(f"{renamed} of {total} files {'would be ' if a.dry_run else ''}renamed")
    if errors:
        print(f"{errors} failed", file=sys.stderr)
    return int(errors > 0)
