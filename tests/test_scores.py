"""Scores of providers as the state of a stream, against one batch."""

import datetime
import random

from pyspark.sql import functions as F

from reelspark.operators import voting
from reelspark.streaming.scores import current, running_scores

OPINION = "struct<feed_ord:int,provider:string,field:string,value:string,confidence:double,weak:boolean,qid:string>"
SCHEMA = f"file_id long, at timestamp, opinions array<{OPINION}>"
NAMES = ["filename", "dirname", "file", "wikipedia", "tvmaze", "tmdb"]


def file(i, day, r):
    ops = [(k, p, f, r.choice(values), r.choice([0.5, 0.9, None]), r.random() < 0.2, None)
           for f, values in (("season", ["1", "2"]), ("title", ["Dark", "dark ", "Darkness", "Drak", "", None]), ("year", ["2001", "2002"])) for k, p in enumerate(NAMES) if r.random() < 0.6]
    return (i, datetime.datetime(2024, 1, 1) + datetime.timedelta(days=day), ops)


def test_scores_of_a_stream(spark, tmp_path):
    """Many batches, with a restart of the query between them, give what one batch gives; who isn't heard of is forgotten."""
    r = random.Random(1)
    rows = [file(i, i // 20, r) for i in range(100)]
    whole = spark.createDataFrame(rows, SCHEMA)
    opinions = whole.select("file_id", F.explode("opinions").alias("o")).select("file_id", "o.*")
    want = {(x.provider, x.field): x.score for x in voting.update_scores(opinions, voting.vote(opinions)).collect()}
    assert len(want) > 10
    said = []

    def run(days):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in/*")
        put = lambda b, n: said.extend((*r, n) for r in b.collect())
        q = running_scores(stream, days).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/at").foreachBatch(put)
        q.trigger(availableNow=True).start().awaitTermination()

    def now():
        return {(x.provider, x.field): x.score for x in current(spark.createDataFrame(said, "provider string, field string, score double, heard timestamp, batch long")).collect()}

    for k in range(5):  # five files, the query is started three times
        spark.createDataFrame(rows[k * 20 : k * 20 + 20], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        if k in (1, 2, 4):
            run(30)
    assert now() == want
    gone = (rows[0][0], datetime.datetime(2024, 6, 1), [(0, "tmdb", "year", "1", 0.9, False, None), (1, "tvmaze", "year", "1", 0.9, False, None)])
    for k in (5, 6):
        spark.createDataFrame([gone], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        run(30)
    assert now() == {("tmdb", "year"): want["tmdb", "year"] + 2, ("tvmaze", "year"): want["tvmaze", "year"] + 2}
