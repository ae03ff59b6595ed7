"""Joins and their components against brute force."""

import re
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspark.llm import embedding_dedup, ngram_join
from reelspark.llm.components import connected_components

from .conftest import prose


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(rows, k, t):
    sets = defaultdict(set)
    for d, text in rows:
        if d is not None:
            sets[d].add(shingles(text, k))
    parent = {d: d for d in sets}
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i:]:
            for x in sets[a]:
                for y in sets[b]:
                    if a != b and x and y and Fraction(len(x & y), len(x | y)) >= t:
                        p, q = find(parent, a), find(parent, b)
                        parent[max(p, q)] = min(p, q)
    return {d: find(parent, d) for d in ids}


@pytest.mark.parametrize("k,num,den", [(3, 90, 100), (5, 4, 5)])
def test_ngram_join(spark, docs, none, k, num, den):
    extra = []
    for i in range(60):  # chains of edits around the threshold, and texts that share a passage
        w = prose(100 + i // 6, 30 + 9 * (i // 6)).split()
        for j in range(i % 6):
            w[(7 * j + 3) % len(w)] = f"edit{j}"
        extra.append((1000 + i, " ".join(w)))
        extra.append((2000 + i, prose(77, 52) + " " + prose(500 + i, 8 + i)))
    d = docs.select("doc_id", "text", "id", "n", "key").unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    got = ngram_join.ngram_components(d, k=k, num=num, den=den).collect()
    rows = [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()]
    want = brute(rows, k, Fraction(num, den))
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id is not None} == set(want.items())
    assert all(r.component_id is None for r in got if r.doc_id is None)
    assert sorted(r.n_shingles for r in got) == sorted(len(shingles(t, k)) for _, t in rows)
    assert len({c for c in want.values()}) < len(want)
    if k == 5:
        kept = ngram_join.one_of_each(d)
        assert sorted(r.doc_id for r in kept.filter("doc_id is not null").select("doc_id").distinct().collect()) == sorted(set(want.values()))
        assert ngram_join.ngram_components(none).count() == 0


def test_sets_that_share_a_name_by_chance(spark):
    """With names of three bits nearly all sets share one; no link and no set is mistaken for another."""
    rows = []
    for i in range(40):
        w = prose(300 + i // 4, 60).split()
        w[10 + i % 4] = "edit"
        rows.append((i, " ".join(w if i % 4 else w[:30])))
    rows += [(100, rows[5][1]), (101, rows[8][1])]
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), bits=3).collect()}
    assert got == brute(rows, 5, Fraction(4, 5)) and len(set(got.values())) > 15


def test_allocation_follows_the_data():
    """Where subsets of n-grams are shared widely, deletions buy larger segments; where they aren't, none are used."""
    rng = np.random.default_rng(5)
    own = [ngram_join.mix(rng.integers(0, 1 << 62, 300).astype(np.uint64)) for _ in range(60)]
    common = [ngram_join.mix(rng.choice(3000, 300, replace=False).astype(np.uint64)) for _ in range(60)]
    few, many = ngram_join.measured_rates(own, 10**6), ngram_join.measured_rates(common, 10**6)
    assert few[0] < 1e3 < many[0] and 0.02 <= many[1] <= 0.5
    band = ngram_join.bisect_right(ngram_join.bands(90, 100), 300) - 1
    assert ngram_join.allocation(band, 90, 100, few)[1] == 0 < ngram_join.allocation(band, 90, 100, (1e5, 0.1))[1]
    assert ngram_join.measured_rates([], 0) == ngram_join.RATES == ngram_join.measured_rates(own[:1], 5)


def test_a_row_without_an_id_before_its_copies(spark):
    """The first row of a text in its partition has no doc_id: the text's links to near copies stay."""
    w = prose(11, 200).split()
    near = [" ".join([*w[:i], "changed", *w[i + 1 :]]) for i in (100, 150)]
    rows = [(None, " ".join(w)), (3, " ".join(w)), (None, near[0]), (2, near[0]), (1, near[1]), (9, prose(12, 50))]
    d = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_components(d, k=5, num=4, den=5).collect()}
    assert got == {None: None, 1: 1, 2: 1, 3: 1, 9: 9}
    assert sorted(r.doc_id or 0 for r in ngram_join.one_of_each(d).collect()) == [0, 0, 1, 9]


def test_keys_meet_for_every_link():
    rng = np.random.default_rng(3)
    for num, den, rates in ((90, 100, ngram_join.RATES), (4, 5, ngram_join.RATES), (1, 2, ngram_join.RATES), (90, 100, (1e6, 0.9)), (4, 5, (1e5, 0.8)), (4, 5, (1e-3, 0.02))):
        for _ in range(400):
            n = int(rng.integers(2, 150))
            base = rng.integers(0, 1 << 63, 4 * n + 8).astype(np.uint64)
            a, cut, more = base[:n], int(rng.integers(0, n // 2 + 1)), int(rng.integers(0, n + 1))
            b = np.concatenate([a[cut:], base[n : n + more]])
            inter, union = n - cut, n + more
            if inter * den < num * union or not cut + more:
                continue
            found = []
            for s in (a, b):
                t = ngram_join.mix(np.unique(s))
                band = ngram_join.bisect_right(ngram_join.bands(num, den), len(t)) - 1
                found.append(np.concatenate([ngram_join.keys(t, band, True, num, den, rates), ngram_join.keys(t, band - 1, False, num, den, rates) if band else t[:0]]))
            meets = lambda p, q: np.intersect1d(p[p & np.uint64(2) > 0] >> np.uint64(2), q[q & np.uint64(1) > 0] >> np.uint64(2)).size
            assert meets(*found) or meets(*found[::-1])


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 50 + i) for i in range(20)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.id: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and all(got[i] == 50 for i in range(50, 70)) and got[100] == 50 and got[201] == 200
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("how", [{}, {"cell": 20, "block": 16}])
def test_vectors(spark, how):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(12, 16))
    x = np.concatenate([centers[i % 12] + rng.normal(size=16) * s for i in range(150) for s in (0.05, 0.25)]).reshape(-1, 16).astype(np.float32)
    rows = [(i, v.tolist(), int(i % 2), "extra", 1) for i, v in enumerate(x)] + [(1000 + i, x[0].tolist(), 0, "copy", 1) for i in range(5)]
    bad = [(2000, None, 0, "", 1), (2001, [0.0] * 16, 0, "", 1), (2002, [float("nan")] + [1.0] * 15, 0, "", 1), (2003, [None] + [1.0] * 15, 0, "", 1), (2004, x[0].tolist(), None, "", 1), (2005, [], 0, "", 1), (2006, [float("inf")] * 16, 0, "", 1), (2007, [1.0, 2.0], 0, "", 1), (None, x[0].tolist(), 0, "", 1)]
    schema = "vec_id long, embedding array<float>, label int, id string, n int"
    df = spark.createDataFrame(rows + bad, schema)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(df, **how).collect()}
    v = np.array([r[1] for r in rows], np.float64)
    u, lab, ids = v / np.linalg.norm(v, axis=1, keepdims=True), np.array([r[2] for r in rows]), [r[0] for r in rows]
    linked = (u @ u.T >= 0.93) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(linked, False)
    parent = {i: i for i in ids}
    for i, j in zip(*np.nonzero(linked)):
        p, q = find(parent, ids[i]), find(parent, ids[j])
        parent[max(p, q)] = min(p, q)
    assert {i: got[i] for i in ids} == {i: (int(n), find(parent, i)) for i, n in zip(ids, linked.sum(axis=1))}
    assert linked.any() and all(got[b[0]] == (0, b[0]) for b in bad)
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0
