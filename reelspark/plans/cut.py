"""Cutting lineage: a table that later steps read several times is computed once, in the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _checkpoint_dir(spark: SparkSession) -> str:
    """Without a checkpoint folder, a local session gets a temporary one and a cluster an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df.checkpoint()``."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """The same rows, dealt to all cores: for work that costs far more than reading its rows, which a small file leaves to few tasks."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the checkpoint folder, as a path of the file system; ValueError if that folder is in another store."""
    root = _checkpoint_dir(spark)
    scheme, _, rest = root.rpartition(":")
    if scheme not in ("", "file"):
        raise ValueError("the checkpoint folder isn't in the file system; name another folder")
    path = os.path.join("/" + rest.lstrip("/"), f"{name}-{uuid.uuid4().hex}")
    os.makedirs(path)
    return path
