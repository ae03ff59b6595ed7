"""Ranked search and joins by frequency against plain versions of themselves."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from reelspark.operators import catalogs, joins, search


def plain_search(titles, queries, k):
    words = lambda s: re.findall(r"[^\W_]+", s.lower())
    docs = {i: words(t) for i, t in titles if t and words(t)}
    n, total = len(docs), sum(map(len, docs.values()))
    df = Counter(w for d in docs.values() for w in set(d))
    weight = lambda w: math.floor(1000 * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)))
    out = []
    for q in {q for q in queries if q is not None}:
        asked = set(words(q))
        scored = []
        for i, d in docs.items():
            tf = Counter(d)
            s = sum(weight(w) * tf[w] * 22 * total // (10 * tf[w] * total + 3 * total + 9 * len(d) * n) for w in asked & set(d))
            if s:
                scored.append((-s, i, sum(weight(w) for w in asked & set(d)) / sum(map(weight, asked))))
        out += [(q, r + 1, i, round(m, 9)) for r, (_, i, m) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def corpus():
    """A word that two thirds of all titles hold, rare ones, titles alike, repeated words, other scripts and no words."""
    out = []
    for i in range(400):
        out.append((i * 3, " ".join(filter(None, ["The" if i % 3 else "", f"w{i % 7}", f"x{i % 31}", "Тьма" if i % 11 == 0 else "", f"only{i}" if i % 50 == 0 else "", "the the" if i % 13 == 0 else ""]))))
    return [*out, (5000, None), (5001, ""), (5002, "!!"), (4999, "w1 x1"), (-1, "w1 x1")]


@pytest.mark.parametrize("block,k", [(4, 3), (64, 1), (256, 10)])
def test_search(spark, monkeypatch, block, k):
    monkeypatch.setattr(search, "BLOCKS", 2)
    monkeypatch.setattr(search, "QUERIES", 5)
    queries = [None, "", "?", "nothing known", "the", "The THE the", "тьма", "w1 x1", "x1, w1!", "the only50 w1", "the w2 x3 unknown", *(f"the w{i % 7} x{i % 31}" for i in range(40))]
    index = search.build_index(spark.createDataFrame(corpus(), "id long, name string").repartition(3), block)
    assert index.blocks.agg(F.max(F.size("entries"))).first()[0] <= block
    got = search.search(spark.createDataFrame([(q,) for q in queries], "query string"), index, k).collect()
    assert sorted((r["query"], r["rank"], r["id"], round(r["score"], 9)) for r in got) == plain_search(corpus(), queries, k)
    names = dict(corpus())
    assert all(r.name == names[r.id] for r in got)


@pytest.mark.parametrize("k", [1, 3, 50])
def test_copies_are_one_posting(spark, k):
    """Titles of the same words cost what one of them does, whatever their order, and come out by their ids."""
    titles = [(i * 7 % 600, ("a b c", "c B a!", "b c", "a c c", f"d{i % 5} b")[i % 5]) for i in range(600)]
    index = search.build_index(spark.createDataFrame(titles, "id long, name string").repartition(3))
    assert index.blocks.agg(F.sum(F.size("entries"))).first()[0] == 9
    queries = ["a b", "B, a", "a c", "c", "d4 a b c", "b unknown"]
    got = search.search(spark.createDataFrame([(q,) for q in queries], "query string"), index, k).collect()
    assert sorted((r["query"], r["rank"], r["id"], round(r["score"], 9)) for r in got) == plain_search(titles, queries, k)


def test_nothing_to_find(spark):
    none = spark.createDataFrame([], "id long, name string")
    index = search.build_index(none)
    assert search.search(spark.createDataFrame([("a",)], "query string"), index).count() == 0
    full = search.build_index(spark.createDataFrame([(1, "a")], "id long, name string"))
    assert search.search(spark.createDataFrame([], "query string"), full).count() == 0


def test_look_ups_through_the_search(spark):
    index = search.build_index(spark.createDataFrame([(1, "Dark Matter"), (2, "Dark"), (3, "The Office"), (4, "Office Space")], "id long, name string"))
    titles = spark.createDataFrame([("Dark!",), ("the office",), ("Matter of dark",), ("No such show",)], "title string")
    assert {r.title: r.show_id for r in catalogs.search_shows(titles, catalogs.show_hits(titles, index)).collect()} == {"Dark!": 2, "the office": 3}
    hits = catalogs.page_hits(titles, index).collect()
    assert [(r["rank"], r.page) for r in sorted(hits, key=lambda r: r["rank"]) if r["query"] == "Dark!"] == [(1, "Dark"), (2, "Dark Matter")]


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("most", [1, 3, 256])
def test_frequent_join(spark, how, most):
    left = spark.createDataFrame([("a" if i % 3 else ["b", "c", None, "d"][i // 3 % 4], i) for i in range(60)], "k string, v int")
    right = spark.createDataFrame([("a", 1), ("b", 2), ("x", 3)], "k string, w int")
    key = lambda rows: sorted(map(tuple, rows), key=repr)
    got, want = joins.frequent_join(left, right, ["k"], how, most), left.join(right, ["k"], how)
    assert got.columns == want.columns and key(got.collect()) == key(want.collect())
    assert joins.frequent_join(left.limit(0), right, ["k"], how, most).count() == 0
