"""Container facts from an external prober, as JSON; a file that can't be probed has null."""

from __future__ import annotations

import json
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

COMMAND = ("ffprobe", "-v", "quiet", "-print_format", "json", "-show_streams", "-show_format")
SECONDS = 30


def probe_one(path: str, command: tuple[str, ...] = COMMAND, seconds: float = SECONDS) -> str | None:
    try:
        out = subprocess.run([*command, path], capture_output=True, timeout=seconds, check=True).stdout.decode()
        json.loads(out)
        return out
    except (OSError, subprocess.SubprocessError, ValueError):
        return None


def probe_files(files: DataFrame, command: tuple[str, ...] = COMMAND) -> DataFrame:
    """``file_id, json`` of files (``file_id, path``)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"file_id": b["file_id"], "json": [probe_one(p, command) for p in b["path"]]})

    return files.select("file_id", "path").mapInPandas(run, "file_id long, json string")
