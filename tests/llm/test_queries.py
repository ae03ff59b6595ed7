"""Every registered query of the subpackage against its contract, on the whole tables of the smallest size."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

import __spark_entry__ as entry

from .test_groups import brute, find, shingles
from .test_models import plain_counts
from .test_rows import P, reference_ids, water_fill

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    read = lambda t: spark.read.parquet(f"{DATA}/{t}.parquet").collect()
    return {t: read(t) for t in ("documents", "embeddings", "labels")}


def rows(spark, n):
    (name,) = (q for q in entry.queries() if q.startswith(f"op{n}_"))
    return entry.queries()[name](spark, DATA).collect()


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_op1(spark, tables):
    texts = [(r.doc_id, r.text) for r in tables["documents"]]
    want = brute(texts, 3, Fraction(9, 10))
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in rows(spark, 1)} == {(d, len(shingles(t, 3)), want[d]) for d, t in texts}


def test_op2(spark, tables):
    got = {r.vec_id: r for r in rows(spark, 2)}
    v = {r.vec_id: np.array(r.embedding, float) for r in tables["embeddings"] if r.embedding}
    label = {r.vec_id: r.label for r in tables["embeddings"]}
    ok = [i for i, x in v.items() if np.isfinite(x).all() and x.any() and label[i] is not None]
    parent, links = {i: i for i in got}, Counter()
    for a in ok:
        for b in ok:
            if a < b and label[a] == label[b] and v[a] @ v[b] / np.sqrt((v[a] @ v[a]) * (v[b] @ v[b])) >= 0.93:
                links[a] += 1
                links[b] += 1
                p, q = find(parent, a), find(parent, b)
                parent[max(p, q)] = min(p, q)
    assert len(got) == len(tables["embeddings"])
    assert all((r.n_links, r.component_id, r.kept) == (links[i], find(parent, i), find(parent, i) == i) for i, r in got.items())


def test_op3(spark, tables):
    got = {r.doc_id: r for r in rows(spark, 3)}
    langs = {r.lang for r in tables["documents"]} - {None}
    for d in tables["documents"]:
        r = got[d.doc_id]
        assert r.held_out == (fold(d.doc_id, 3) == 1) and 0 <= r.score <= 1
        assert r.lang_pred in langs if any(map(str.isalpha, d.text or "")) else r.lang_pred == "und"
    held = [d for d in tables["documents"] if got[d.doc_id].held_out and d.lang and got[d.doc_id].lang_pred != "und"]
    assert np.mean([got[d.doc_id].lang_pred == d.lang for d in held]) > 0.95


def test_op4(spark, tables):
    docs = sorted(tables["documents"], key=lambda d: d.doc_id)
    ids = reference_ids("byte_bpe_50k.json", [d.text for d in docs])
    starts = np.cumsum([0, *map(len, ids)])
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows(spark, 4)) == [(d.doc_id, s, len(i), crc(i)) for d, s, i in zip(docs, starts, ids)]


def test_op5(spark, tables):
    got = {r.doc_id: r for r in rows(spark, 5)}
    size = {d.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", d.text or "")) for d in tables["documents"]}
    by = defaultdict(list)
    for d in tables["documents"]:
        by[d.source].append(d.doc_id)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    totals = [sum(size[i] for i in by[s]) for s in names]
    for s, total, target in zip(names, totals, water_fill(totals, [[3, 1, 2][i % 3] for i in range(len(names))], 1.5)):
        mine = [got[i] for i in by[s]]
        assert all((r.size, r.source_size) == (size[r.doc_id], total) and abs(r.target - target) < 1e-6 and 0 <= r.taken <= 2 * r.size for r in mine)
        assert abs(sum(r.taken for r in mine) - target) < 1
    assert all(len(r.positions) == 0 if not r.taken else list(r.positions) == sorted(r.positions) and r.position == r.positions[0] for r in got.values())
    again = {r.doc_id: r for r in rows(spark, 5)}
    assert again == got


def test_op6(spark, tables):
    ids = dict(zip([d.doc_id for d in tables["documents"]], reference_ids("word_bpe_49k.json", [d.text for d in tables["documents"]])))
    got, seqs, pieces = rows(spark, 6), defaultdict(list), defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append(r)
        pieces[r.doc_id].append(r)
    for d, i in ids.items():
        own = sorted(pieces[d], key=lambda r: r.start)
        assert [r.start for r in own] == list(np.cumsum([0, *(r.length for r in own)])[:-1]) and sum(r.length for r in own) == len(i) == own[0].doc_tokens
        assert all(r.ids_crc32 == crc(i[r.start : r.start + r.length]) for r in own)
    for s in seqs.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == list(np.cumsum([0, *(r.length for r in s)])[:-1]) and sum(r.length for r in s) <= 4096
    assert len(seqs) <= -(-sum(map(len, ids.values())) // 4096) + 1


def test_op7(spark, tables):
    got = {r.doc_id: r for r in rows(spark, 7)}
    for d in tables["documents"]:
        r = got[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_counts(d.text or "")
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and r.kept == (not r.base_failed and r.score >= 0.5)
    quality = {r.doc_id: r.quality for r in tables["labels"]}
    clean = [got[i].kept for i, q in quality.items() if q == 1 and i in got and not got[i].base_failed]
    assert np.mean(clean) > 0.9


def test_op8(spark, tables):
    got = rows(spark, 8)
    assert sorted(r.doc_id for r in got) == sorted(d.doc_id for d in tables["documents"])
    assert all(r.held_out == (fold(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_op9(spark, tables):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for d in tables["documents"]:
        for x in (d.text or "").split("\n"):
            holders[key(x)].add(d.doc_id)
    gone = {k: max(v) for k, v in holders.items() if len(k) >= 20 and len(v) >= 3}
    want = {}
    for d in tables["documents"]:
        lines = (d.text or "").split("\n")
        left = [x for x in lines if gone.get(key(x), d.doc_id) == d.doc_id]
        want[d.doc_id] = (len(lines), len(lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest())
    assert gone and {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in rows(spark, 9)} == want


def test_op10(spark, tables):
    got = {r.doc_id: r for r in rows(spark, 10)}
    shards = defaultdict(list)
    for d in tables["documents"]:
        raw, r = (d.text or "").encode(), got[d.doc_id]
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
        shards[r.shard].append(r)
    assert set(shards) == set(range(24)) and max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in shards.values())
    total = Counter(r.source for r in got.values())
    for v in shards.values():
        mine = Counter(r.source for r in v)
        assert all(abs(mine[s] - n * len(v) / len(got)) <= 2 for s, n in total.items())


@pytest.mark.parametrize("name", ["op1_ngram_join", "op2_embedding_dedup", "op9_line_dedup", "op11_hard_negatives", "op12_warc_bundles"])
def test_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    cur = c.execute(entry.oracle_sql()[name])
    cols = [x[0] for x in cur.description]
    df = entry.queries()[name](spark, DATA)
    assert sorted(df.columns) == sorted(cols) and sorted((tuple(r[x] for x in cols) for r in df.collect()), key=repr) == sorted(cur.fetchall(), key=repr)


def test_the_vocabularies_are_parameters():
    assert P.path("byte_bpe_50k.json") and P.path("word_bpe_49k.json")
