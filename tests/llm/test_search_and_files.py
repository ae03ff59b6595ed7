"""Hard negatives, WARC bundles and periodic runs against plain versions of themselves."""

import base64
import hashlib
import re
import zlib

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from reelspark.llm import hard_negatives, periodic_runs, warc

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def query(spark, n, d=DATA):
    (name,) = (q for q in entry.queries() if q.startswith(f"op{n}_"))
    return entry.queries()[name](spark, d)


# --- hard negatives ---------------------------------------------------------------------------------------------------


def plain_negatives(rows, step, k=5):
    """rows: (vec_id, label, vector)."""
    fine = [(i, y, [int(np.floor(256 * float(c))) for c in x]) for i, y, x in rows if i is not None and y is not None and x is not None and all(c is not None and np.isfinite(c) for c in x)]
    out = []
    for i, y, x in fine:
        if i % step:
            continue
        scored = sorted((-sum(a * b for a, b in zip(x, z)), j, w) for j, w, z in fine if len(z) == len(x))
        for ps, p, _ in [s for s in scored if s[2] == y and s[1] != i][:k]:
            near = [s for s in scored if s[2] != y and -80 * ps <= -100 * s[0] <= -100 * ps][:k]
            out += [(i, p, r + 1, n, -ps, -ns) for r, (ns, n, _) in enumerate(near)]
    return sorted(out)


def test_op11(spark):
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 and r.label is not None else r.label, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    df = query(spark, 11)
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = plain_negatives(rows, 100)
    assert want and sorted(map(tuple, df.collect())) == want


@pytest.mark.parametrize("block", [1 << 7, 1 << 25])
def test_hard_negatives(spark, monkeypatch, block):
    """Nulls, non-finite components, ties, several lengths, large numbers and repeated rows; blocks and files of a few rows."""
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", block)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    inf, nan = float("inf"), float("nan")
    rows = [(i, i % 3, [((i * 7) % 5) / 4, ((i * 11) % 3) / 4, 1.0]) for i in range(60)]
    rows += [(100, None, [1.0, 1.0, 1.0]), (102, 1, None), (104, 1, [1.0, None, 1.0]), (106, 2, [inf, 1.0, 1.0]), (108, 2, [nan, 1.0, 1.0]), (110, 0, [0.0, 0.0, 0.0]), (112, 1, [-1.0, -0.5, 0.25])]
    rows += [(200 + i, i % 2, [float(i + 1), 2.0]) for i in range(8)] + [(300 + i, i % 2, [1e5 + i, 3e5]) for i in range(8)] + [(400, 0, []), (402, 0, []), (403, 1, []), (404, 1, [5e6, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<double>, anchor string")
    got = hard_negatives.hard_negatives(df.repartition(3), F.col("vec_id") % 2 == 0)
    want = plain_negatives([r for r in rows if r[0] != 404], 2)  # that vector is too long
    assert len(want) > 100 and sorted(map(tuple, got.collect())) == want
    twice = hard_negatives.hard_negatives(df.filter("vec_id in (0, 1, 3, 4)").unionAll(df.filter("vec_id in (1, 3)")), F.col("vec_id") == 0).collect()
    assert sorted(r.negative_id for r in twice) == [1, 1, 1, 1, 4, 4] and all(r.positive_id == 3 for r in twice)
    assert hard_negatives.hard_negatives(df.limit(0), F.lit(True)).count() == 0
    assert hard_negatives.hard_negatives(df.filter("label = 1"), F.lit(True)).count() == 0


# --- WARC bundles -----------------------------------------------------------------------------------------------------


def base32_sha1(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def plain_pages(rows):
    """(page_id, bytes, digest, type, refers_to) of each (page_id, html)."""
    first = {}
    for i, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, h in rows:
        f = first.get(h or "")
        response = i is None or f == i
        out.append((i, len((h or "").encode()), base32_sha1(h), "response" if response else "revisit", None if response else f))
    return sorted(out, key=repr)


def test_op12(spark):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()]
    got = query(spark, 12).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=repr) == plain_pages(rows)


def pages():
    long = "<p>" + "ünïcode &amp; text \r\n\r\n" * 5000
    texts = [None, "", "a", "a", None, "a", long, long, "WARC/1.1\r\n\r\n", "x\x00y", "", "last"]
    out = [(i * 3, None if i % 4 == 0 else f"http://h/{i}\r\nX: y", t) for i, t in enumerate(texts)]
    return [*out, out[2], (None, "http://n/", "a"), (None, None, None), (-7, "u", "last")]


@pytest.mark.parametrize("hot", [1, 10_000])
def test_warc(spark, tmp_path, hot):
    """Every record from end to end, by the index, and by a plain reader of Zstandard; payloads through revisits."""
    df = spark.createDataFrame([(*r, "x") for r in pages()], "page_id long, url string, html string, first string").repartition(3)
    index = warc.write_archives(df, frame=2000, archive=20_000, hot=hot)
    got = warc.read_archives(index).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == plain_pages([(r[0], r[2]) for r in pages()])
    texts = {(r[0], base32_sha1(r[2])): r[2] or "" for r in pages()}
    assert all((r.payload is None) == (r.record_type == "revisit") and r.payload in (None, texts[r.page_id, r.payload_digest]) for r in got)
    listed = index.collect()
    assert len(listed) == len(pages()) and len({(r.archive, r.frame) for r in listed}) > 3
    for path in {r.archive for r in listed}:
        raw = open(path.removeprefix("file://"), "rb").read()
        plain = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
        with warc.Bundle(path) as b:
            assert b"".join(b.frame(i) for i in range(len(b))) == plain
        at, n = 0, 0
        while at < len(plain):
            _, _, at = warc.parse_record(plain, at)
            n += 1
        assert n == sum(r.archive == path for r in listed)
    wanted = spark.createDataFrame([(9,), (15,), (18,), (21,), (999,)], "page_id long")
    assert sorted(r.page_id for r in warc.fetch_records(index, wanted).collect()) == [9, 15, 18, 21]
    assert {r.page_id: r.payload for r in warc.payloads(index, wanted).collect()} == {9: "a", 15: "a", 18: pages()[6][2], 21: pages()[6][2]}
    few = warc.read_archives(warc.write_archives(df, least=2, hot=hot)).filter("record_type = 'revisit'").collect()
    assert sorted((r.page_id, r.refers_to) for r in few) == [(21, 18), (33, -7)]
    none = warc.write_archives(df.limit(0))
    assert none.count() == 0 and warc.read_archives(none).count() == 0


def test_warc_refuses_what_is_damaged(tmp_path):
    path = str(tmp_path / "a.warc.zst")
    w = warc.BundleWriter(path, 100)
    rid, record = warc.make_record(1, "u", b"payload", None, "1970-01-01T00:00:00Z")
    w.add(record)
    w.close()
    head, block, end = warc.parse_record(record)
    assert head["WARC-Record-ID"] == rid and end == len(record)
    with pytest.raises(ValueError):
        warc._record(head, block.replace(b"payload", b"Payload"))
    with pytest.raises(ValueError):
        warc.parse_record(record[:-1])
    open(path, "ab").write(b"more than a footer")
    with pytest.raises(ValueError):
        warc.Bundle(path)


# --- periodic runs ----------------------------------------------------------------------------------------------------


def plain_runs(x, least, times):
    """All runs, by comparing the words with themselves at each distance."""
    x, out = np.asarray(x), []
    for q in range(1, len(x) // times + 1):
        same = np.concatenate([[False], x[:-q] == x[q:], [False]])
        edge = np.flatnonzero(np.diff(same.astype(np.int8)))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            n = b - a + q
            if n >= times * q and not any(s <= a and a + n <= s + m and r < q for s, m, r in out):
                out.append((a, n, q))
    return sorted((r for r in out if r[1] >= least), key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40), st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(0, 6), st.lists(st.integers(0, 2), max_size=20))
def test_runs(a, root, k, b):
    x = [*a, *root * k, *b, *root * 2]
    got = [v.tolist() for v in periodic_runs.find_runs(np.array(x))]
    assert sorted(zip(*got)) == sorted(plain_runs(x, 2, 2))
    docs = [[b"%d" % w for w in d] for d in (a, x, [], x, b)]
    for least, times in ((24, 3), (2, 2), (7, 3)):
        found = periodic_runs.runs_of(docs, least, times)
        assert [found.get(i, []) for i in range(5)] == [plain_runs([int(w) for w in d], least, times) if d else [] for d in docs]


def test_long_texts(monkeypatch):
    """One word over and over, Fibonacci words, and long repeats; many comparisons at a time or few."""
    a, b = [0], [0, 1]
    while len(b) < 1500:
        a, b = b, b + a
    far = list(range(700))
    for pairs in (1 << 19, 1000):
        monkeypatch.setattr(periodic_runs, "PAIRS", pairs)
        for x in ([0] * 3000, b, far + far + far[:650], [*far, *([1, 2, 3] * 20), *far]):
            got = list(zip(*[v.tolist() for v in periodic_runs.find_runs(np.array(x))]))
            assert [r for r in got if r[1] >= 3 * r[2]] == plain_runs(x, 1, 3)


def test_how_much_a_run_repeats():
    assert periodic_runs.repeated(24, 3) == 16 and periodic_runs.repeated(2, 2) == 1 and periodic_runs.repeated(9, 2) == 5


def plain_row(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    ids = {}
    runs = plain_runs([ids.setdefault(w, len(ids)) for w in words], 24, 3) if words else []
    gone = {i for a, m, q in runs for i in range(a + q, a + m)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    lines = "".join(f"{a},{m},{q}\n" for a, m, q in runs)
    return (doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], sha(lines), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_op13(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    got = {r.doc_id: tuple(r) for r in query(spark, 13).collect()}
    assert len(got) == len(docs) and sum(r[1] > 0 for r in got.values()) > 10
    for d in docs:
        assert got[d.doc_id] == plain_row(d.doc_id, d.text)


def test_periodic_runs(spark, docs, none):
    """Nulls, empty and very long texts, repeated rows, clashing columns and other white space."""
    got = periodic_runs.periodic_runs(docs)
    assert got.columns == [*docs.columns, "__n_words", "__runs", "__collapsed"] and got.count() == docs.count()
    for r in got.collect():
        words = WORD.findall(r.text or "")
        ids = {}
        want = plain_runs([ids.setdefault(w, len(ids)) for w in words], 24, 3) if 0 < len(words) < 3000 else []
        if len(words) < 3000:
            assert r["__n_words"] == len(words) and [tuple(x) for x in r["__runs"]] == want
    t = spark.createDataFrame([(i, " ".join("ab") + " " + " ".join(["x y", "z"] * 12) + "\n" * i) for i in range(3)], "n long, text string")
    assert [(r["__runs"][0].start, r["__runs"][0].length, r["__collapsed"]) for r in periodic_runs.periodic_runs(t).collect()] == [(1, 24, "a b x y z")] * 3
    assert periodic_runs.periodic_runs(none).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(docs, times=1)
