"""Versioned tables, caches and names that batches take."""

import os
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from reelspark.operators import allocate
from reelspark.plans.pipeline import Options, plan
from reelspark.sources.cache import Cache
from reelspark.sources.store import Snapshot, Store
from reelspark.streaming.arrivals import Reservations, plan_arrivals, plan_batch


def numbers(spark, *n):
    return spark.createDataFrame([(i,) for i in n], "n long")


def held(store, version=None):
    return sorted(r.n for r in store.read(version).collect())


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_versions(spark, tmp_path, scheme):
    s = Store(spark, f"{scheme}{tmp_path}/t", "n long", compact=3)
    assert held(s) == [] and s.snapshot() == Snapshot()
    for i in range(1, 11):
        s.append(numbers(spark, i))
        assert held(s) == list(range(1, i + 1)) and len(s.snapshot().dirs) <= 4  # rereads stay as they are
    assert held(s, 1) == [1] and held(s, 3) == [1, 2, 3]
    before = s.snapshot().version
    assert s.vacuum(keep=1, seconds=0) > 5 and held(s) == list(range(1, 11)) and s.snapshot().version == before
    with pytest.raises(ValueError):
        s.read(1)


def test_two_writers(spark, tmp_path):
    """Writers at the same time, compacting too, lose nothing; a version is published once."""
    stores = [Store(spark, f"{tmp_path}/t", "n long", compact=4) for _ in range(3)]
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda i: stores[i % 3].append(numbers(spark, i)), range(18)))
    assert held(stores[0]) == list(range(18))
    assert not stores[1]._publish(Snapshot(1, ["x"])) and held(stores[0]) == list(range(18))
    os.makedirs(f"{tmp_path}/t/data/left-by-a-lost-writer")
    assert held(stores[2]) == list(range(18))


def test_batches_once(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/t", "n long", compact=2)
    for batch in (0, 1, 1, 0, 2, 2, 3):
        s.append(numbers(spark, batch), "a", batch)
    s.append(numbers(spark, 9), "b", 0)
    assert held(s) == [0, 1, 2, 3, 9] and s.snapshot().batches == {"a": 3, "b": 0}


def test_cache(spark, tmp_path):
    c, calls = Cache(spark, str(tmp_path / "c"), "k string, v string", ["k"], compact=3), []

    def fetch(m):
        calls.append(sorted(r.k for r in m.collect()))
        return m.filter("k <> 'none'").withColumn("v", F.upper("k"))

    at = lambda days: F.expr(f"timestamp '2024-01-01 00:00:00' + interval {days} days")
    w = spark.createDataFrame([("a",), ("b",), ("none",), ("a",)], "k string")
    get = lambda days: {r.k: r.v for r in c.looked_up(w, fetch, at(days)).collect()}
    want = {"a": "A", "b": "B", "none": None}
    assert get(0) == want and get(1) == want and calls == [["a", "b", "none"]]
    assert get(2) == want and calls[1:] == [["none"]]  # nothing found is asked again sooner
    assert get(8) == want and calls[2:] == [["a", "b", "none"]]
    c.add(spark.createDataFrame([("a", "new")], "k string, v string"), at(9))
    c.add(spark.createDataFrame([("a", "old")], "k string, v string"), at(3))
    assert {r.k: r.v for r in c.read(at(9)).collect()} == {"a": "new", "b": "B", "none": None}
    assert len(c.store.snapshot().dirs) <= 4 and c.read(at(30)).count() == 0


def paths(seed):
    r = random.Random(seed)
    out = [f"/{r.choice('ab')}/{r.choice(['The.Matrix.1999', 'The Matrix (1999)', 'The Matrix (1999)_1', 'Gone.Girl.2014', 'x'])}{r.choice(['', '.1080p', '.720p'])}.mkv" for _ in range(40)]
    return list(dict.fromkeys(out))


def test_batches_in_any_cut(spark, tmp_path, seed=1):
    """However files are cut into batches, no two get one name, and none gets one that lies beside it."""
    r, files = random.Random(seed), paths(seed)
    names = Reservations(spark, str(tmp_path / "names"))
    cuts = sorted(r.sample(range(1, len(files)), 2))
    given, stayed = [], set()
    for b, (i, j) in enumerate(zip([0, *cuts], [*cuts, len(files)])):
        batch = spark.createDataFrame([(k, files[k]) for k in range(i, j)], "file_id long, path string")
        rows = plan_batch(batch, b, names).collect()
        if b == 1:  # a batch that is repeated gives the same names
            assert {x.file_id: x.dest_name for x in plan_batch(batch, b, names).collect()} == {x.file_id: x.dest_name for x in rows}
        given += [x.dest_name for x in rows if x.status == "renamed"]
        for x in rows:
            folder, old = x.path.rpartition("/")[::2]
            assert x.status != "renamed" or (folder, x.dest_name) not in stayed
            stayed |= {(folder, old)} if x.status != "renamed" else set()
    assert len(given) == len(set(given)) > 5
    assert names.store.read().count() == len(files)


def test_arrivals(spark, tmp_path):
    (tmp_path / "in").mkdir()
    names = Reservations(spark, str(tmp_path / "names"))
    out = {}

    def sink(planned, number):
        out.update({r.path: (r.dest_name, number) for r in planned.collect()})

    for i in range(3):
        spark.createDataFrame([(i, f"/m{i}/The.Matrix.1999.mkv")], "file_id long, path string").write.parquet(str(tmp_path / "in" / str(i)))
        stream = spark.readStream.schema("file_id long, path string").parquet(f"{tmp_path}/in/*")
        plan_arrivals(stream, sink, str(tmp_path / "at"), names).awaitTermination()
    assert sorted(out.values()) == [("The Matrix (1999).mkv", 0), ("The Matrix (1999)_1.mkv", 1), ("The Matrix (1999)_2.mkv", 2)]


def test_reserved_names(spark):
    w = spark.createDataFrame([(1, "/a/x", "/a", "N.mkv"), (2, "/a/y", "/a", "N.mkv"), (3, "/b/z", "/b", "N_3.mkv"), (4, "/b/zz", "/b", "M")], "file_id long, path string, dir string, new_name string")
    taken = spark.createDataFrame([("N.mkv",), ("N_2.mkv",), ("N_3.mkv",), ("other",)], "name string")
    got = {r.file_id: r.dest_name for r in allocate.allocate(w, reserved=taken).collect()}
    assert got == {1: "N_1.mkv", 2: "N_4.mkv", 3: "N_3_1.mkv", 4: "M"}
    assert plan(spark.createDataFrame([], "file_id long, path string"), Options(names=lambda w: (w.select("dir", F.col("new_name").alias("name")), w.select(F.col("new_name").alias("name"))))).count() == 0
