"""How often each provider has been right, kept over all runs as the state of a stream.

Files arrive with their opinions; each is voted on by itself, and every field with two voters or more gives its voters a
win or a loss. The state of a provider and field is the sum of its wins and when it was last heard of, in the time of the
files; a provider that isn't heard of for ``days`` loses its score. State is kept by Spark in the query's checkpoint, so a
restarted query goes on where the last one stopped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from reelspark.operators import voting

SCHEMA = "provider string, field string, score double, heard timestamp"
STATE = "score double, heard long"


def wins(files: DataFrame) -> DataFrame:
    """``provider, field, at, won`` for each voter of a field with two or more; files: ``file_id, at, opinions`` (see
    ``voting.ballots``). A row at a time, so batches and streams alike."""
    b = voting.ballots(files).withColumn("voters", F.transform("all", lambda o: o["provider"])).filter(F.size("voters") >= 2)
    v = voting.judged(voting.agreed(b))
    v = v.select("at", "field", "providers", F.explode("voters").alias("provider"))
    return v.select("provider", "field", "at", F.array_contains("providers", F.col("provider")).cast("double").alias("won"))


def _update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, days: float) -> Iterator[pd.DataFrame]:
    provider, field = key
    if state.hasTimedOut:
        _, heard = state.get
        state.remove()
        yield pd.DataFrame([(provider, field, None, pd.Timestamp(heard, unit="ms"))], columns=["provider", "field", "score", "heard"])
        return
    score, heard = state.get if state.exists else (0.0, 0)
    for f in frames:
        score += float(f["won"].sum())
        heard = max(heard, int(f["at"].max().timestamp() * 1000))
    state.update((score, heard))
    state.setTimeoutTimestamp(max(int(heard + days * 86_400_000), state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame([(provider, field, score, pd.Timestamp(heard, unit="ms"))], columns=["provider", "field", "score", "heard"])


def running_scores(files: DataFrame, days: float = 365, late: str = "1 day") -> DataFrame:
    """A stream of ``provider, field, score, heard``: the new score of each provider and field that a batch changes, null for one
    that is forgotten. files: a stream as of ``wins``; those later than ``late`` behind the newest are left out, as a
    watermark does."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        return _update(key, frames, state, days)

    w = wins(files.withWatermark("at", late))
    return w.groupBy("provider", "field").applyInPandasWithState(update, SCHEMA, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def current(updates: DataFrame) -> DataFrame:
    """``provider, field, score`` for ``voting.verdicts``, from all updates with the ``batch`` that wrote them: the last of each."""
    last = updates.groupBy("provider", "field").agg(F.max_by(F.struct("score"), "batch").alias("u"))
    return last.select("provider", "field", "u.score").filter("score is not null")
