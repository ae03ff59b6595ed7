"""Mixing, sharding, packing, token files and line dedup against plain versions of themselves."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspark.llm import _tokens, line_dedup, mixing, packing, sharding, token_files

from .conftest import prose, rows

P = pytest.importorskip("public_tokenizers")


def reference_ids(name, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(name))
    return [np.array([*e.ids, 2], "<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_sharding(docs, none):
    ident = [F.col("doc_id"), F.xxhash64("text")]
    for shards in (1, 3, 24):
        a = sharding.interleaved_shards(docs, F.col("source"), ident, shards).collect()
        assert len(a) == docs.count()
        by = defaultdict(list)
        for r in a:
            by[r["__shard"]].append(r)
        assert all(sorted(r["__slot"] for r in v) == list(range(len(v))) for v in by.values())
        sizes = [len(by[s]) for s in range(shards)]
        assert max(sizes) - min(sizes) <= 1
        total = Counter(r.source for r in a)
        for v in by.values():
            for s, n in total.items():
                assert abs(sum(r.source == s for r in v) - n * len(v) / len(a)) <= len(total)
    again = sharding.interleaved_shards(docs.repartition(3), F.col("source"), ident, 24).collect()
    key = lambda rows: sorted((str(r.doc_id), str(r.text)[:50], r["__shard"], r["__slot"]) for r in rows)
    assert key(again) == key(a)
    assert sharding.interleaved_shards(none, F.col("source"), ident, 24).count() == 0


def water_fill(sizes, weights, share):
    total, cap, out, open_ = sum(sizes) * share, [2 * s for s in sizes], {}, set(range(len(sizes)))
    while True:
        w = sum(weights[i] for i in open_)
        level = (total - sum(out.values())) / w if w else 0
        over = [i for i in open_ if level * weights[i] > cap[i] + 1e-9]
        if not over:
            return [out.get(i, level * weights[i]) for i in range(len(sizes))]
        for i in over:
            out[i] = cap[i]
            open_.discard(i)


@pytest.mark.parametrize("whole", [False, True])
def test_mixing(docs, none, whole):
    size = mixing.word_count(F.col("text"))
    m = mixing.curriculum(docs, size, F.col("source"), [F.col("doc_id"), F.xxhash64("text")], whole=whole)
    rows = m.collect()
    assert len(rows) == docs.count()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert all(r["__size"] == count(r.text) and 0 <= r["__taken"] <= 2 * r["__size"] for r in rows)
    names = sorted({r.source for r in rows if r.source is not None}, key=lambda s: s.encode()) + [None]
    sizes = [sum(r["__size"] for r in rows if r.source == s) for s in names]
    for s, n, t in zip(names, sizes, water_fill(sizes, [[3, 1, 2][i % 3] for i in range(len(names))], 1.5)):
        mine = [r for r in rows if r.source == s]
        assert all(r["__source_size"] == n and abs(r["__target"] - t) < 1e-6 for r in mine)
        assert abs(sum(r["__taken"] for r in mine) - t) <= (max(r["__size"] for r in mine) if whole else 0.51)
    order = [r["__position"] for r in mixing.in_order(m).select("__position").collect()]
    assert order == sorted(order) and all(0 <= p <= 1 for p in order)
    assert mixing.curriculum(none, size, F.col("source"), [F.col("doc_id")], whole=whole).count() == 0


def test_schedules_are_inverted(spark):
    q = [i / 200 for i in range(201)]
    for turn, knots in enumerate(mixing.SCHEDULES):
        got = [r[0] for r in spark.createDataFrame([(x,) for x in q], "q double").coalesce(1).select(mixing.time_of(F.col("q"), F.lit(turn))).collect()]
        t = np.linspace(0, 1, 20001)
        w = np.interp(t, *zip(*knots))
        demand = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2)])
        assert np.allclose(np.interp(got, t, demand / demand[-1]), q, atol=1e-4)


def test_token_files(docs, none):
    path = P.path("byte_bpe_50k.json")
    manifest = token_files.write_token_files(docs, path, 2, length=64, rows=4)
    got = token_files.read_token_files(manifest).collect()
    want = Counter((r.doc_id, len(i), zlib.crc32(i.tobytes())) for r, i in zip(docs.collect(), reference_ids("byte_bpe_50k.json", [r.text for r in docs.collect()])))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    by_start = sorted(got, key=lambda r: r.start)
    assert [r.doc_id if r.doc_id is not None else -100 for r in by_start] == sorted(r.doc_id if r.doc_id is not None else -100 for r in got)
    assert [r.start for r in by_start] == list(np.cumsum([0, *(r.n_tokens for r in by_start)])[:-1])
    m = manifest.orderBy("part").first()
    f = token_files.TokenFile(m.tokens_path)
    ids = np.concatenate([f[i][0] for i in range(len(f))])
    mask = np.concatenate([f[i][1].to_numpy(zero_copy_only=False) for i in range(len(f))])
    assert mask.sum() == m.tokens and len(ids) % 64 == 0 and not ids[~mask].any()
    assert token_files.read_token_files(token_files.write_token_files(none, path, 2)).count() == 0


ODD_TEXTS = [
    None, "", " ", "\n", "a\n", "\na", " a", "a ", "a\n\nb", "a \nb", "a\n b", "a<|endoftext|>b c", "<|startoftext|>", "x\0y z", "don't 'll\n's", "ÅǺ é́ İ Σας ΣΑΣ.", "a\tb c\td",
    "1 2\n3", "’s x\n’s", "word, word. Word,. word.,\nword. \u00a0x", "e\u0301. e\u0301,", "ﬁ ﬀ, ½. Ⅷ,", "日本語. 한국어, हिन्दी.", "क़. x", "w" * 300 + ". " + "w" * 300, "a.b,c.d", ". , .,", "😀. 😀,",
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_is_the_library(name):
    enc = _tokens.Encoder(P.path(name), 2, remembered=40)  # starts anew all the time
    texts = [*ODD_TEXTS, *[r[1] for r in rows()], *ODD_TEXTS, *[" ".join(ODD_TEXTS[1:]), "\n".join(ODD_TEXTS[1:])]] * 2
    want = [i.astype(enc.dtype).tobytes() for i in reference_ids(name, texts)]
    assert enc.encode_all(texts) == want
    assert [enc.encode_all([t])[0] for t in texts] == want


def test_encoder_cuts_very_long_texts_and_survives_equal_hashes(monkeypatch):
    text = prose(3, 3000) + "\n\n" + prose(4, 3000)
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        enc = _tokens.Encoder(P.path(name), 2)
        want = reference_ids(name, [text])[0].astype(enc.dtype).tobytes()
        with monkeypatch.context() as m:
            m.setattr(_tokens, "PART", 1000)
            assert enc.encode_all([text]) == [want]
        enc = _tokens.Encoder(P.path(name), 2)
        enc.key.spans = lambda data, s, e: (e - s).astype(np.uint64)  # all pieces of a length have one key
        assert enc.encode_all([text, "a b c", "x"]) == [want, *(i.astype(enc.dtype).tobytes() for i in reference_ids(name, ["a b c", "x"]))]


@pytest.mark.parametrize("group", [50_000, 7])
def test_packing(docs, none, group):
    path, cap = P.path("word_bpe_49k.json"), 256
    got = packing.pack_sequences(docs, path, 2, capacity=cap, keep_ids=True, group_pieces=group).collect()
    want = Counter(i.tobytes() for i in reference_ids("word_bpe_49k.json", [r.text for r in docs.collect()]))
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append(r)
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for v in seqs.values():
        v.sort(key=lambda r: r.offset)
        assert [r.offset for r in v] == list(np.cumsum([0, *(r.length for r in v)])[:-1]) and sum(r.length for r in v) <= cap
    assert sum(r.length for r in got) == sum(len(b) // 4 * n for b, n in want.items())
    one = [r for r in got if r.doc_id == 16]
    assert b"".join(r.ids for r in sorted(one, key=lambda r: r.start)) in want and all(r.length == cap for r in one if r.start + r.length < r.doc_tokens)
    assert packing.pack_sequences(none, path, 2).count() == 0


@pytest.mark.parametrize("lengths", [[5, 5, 4, 3, 3, 2, 2, 1], [10, 10, 1, 1], [1] * 25, [], [9, 8, 7, 6, 5, 4, 3, 2, 1]])
def test_best_fit(lengths):
    windows, offsets = packing.best_fit(lengths, 10)
    room = []
    for n in lengths:
        fits = [(r, i) for i, r in enumerate(room) if r >= n]
        room.append(10 - n) if not fits else room.__setitem__(min(fits)[1], min(fits)[0] - n)
    used = Counter()
    for n, w, o in zip(lengths, windows, offsets):
        assert o == used[w]
        used[w] += n
    assert sorted(10 - x for x in used.values()) == sorted(room)


def test_line_dedup(docs, none):
    seen = defaultdict(set)
    keys = lambda t: [(x, line_dedup.line_key(x, 20)) for x in (t or "").split("\n")]
    data = docs.collect()
    for r in data:
        if r.doc_id is not None:
            for _, k in keys(r.text):
                if k is not None:
                    seen[k].add(r.doc_id)
    repeated = {k: max(v) for k, v in seen.items() if len(v) >= 3}
    assert repeated
    want = Counter()
    for r in data:
        lines = keys(r.text)
        left = [x for x, k in lines if r.doc_id is None or k not in repeated or repeated[k] == r.doc_id]
        want[r.doc_id, "\n".join(left) if r.text is not None else None, len(lines) - len(left)] += 1
    out = line_dedup.drop_repeated_lines(docs)
    assert Counter((r.doc_id, r.text, r["__dropped"]) for r in out.collect()) == want
    assert out.columns == [*docs.columns, "__dropped"]
    assert line_dedup.drop_repeated_lines(none).count() == 0


def test_merged_filters():
    """Keys of two partitions, or twice in one, are in the merged filter; few others are."""
    shape = line_dedup.Shape(60_000 * line_dedup.KEY_BYTES)
    h = np.random.default_rng(0).integers(0, 1 << 63, 60_000).astype(np.uint64)
    h = h[shape.segment(h) == 3]
    n = len(h) // 5
    once = [h[: 2 * n], h[n : 3 * n], h[3 * n : 4 * n], h[4 * n :]]
    twice = [h[:0], h[:0], h[3 * n : 3 * n + 50], h[:0]]
    f = line_dedup.merged([(line_dedup.squeezed(shape.places(a)), line_dedup.squeezed(shape.places(b))) for a, b in zip(once, twice)], shape.bits)
    hit = f[shape.places(h)].all(axis=1)
    assert hit[n : 2 * n].all() and hit[3 * n : 3 * n + 50].all() and hit[:n].mean() < 0.02 and hit[3 * n + 50 :].mean() < 0.02


def test_line_dedup_columns_of_any_name(spark):
    rows = [(i, "x" * 30 + "\nown", 1.5, "b") for i in range(4)]
    d = spark.createDataFrame(rows, "doc_id int, text string, `a``b` double, `digest` string")
    out = line_dedup.drop_repeated_lines(d, min_docs=2)
    assert out.columns == [*d.columns, "__dropped"] and sorted((r.doc_id, r.text) for r in out.collect()) == [(0, "own"), (1, "own"), (2, "own"), (3, "x" * 30 + "\nown")]


def test_line_dedup_goes_through_many_segments(spark, monkeypatch):
    """Hundreds of segments, keys held in small lots, filters folded to what repeats: nothing that repeats is missed."""
    monkeypatch.setattr(line_dedup, "SEGMENTS", 300)
    monkeypatch.setattr(line_dedup, "HELD_KEYS", 500)
    monkeypatch.setattr(line_dedup, "HELD", 300)
    texts = ["\n".join(f"line number {(i * 37 + j * j) % (900 if j % 3 else 100_000)} of a document, twenty" for j in range(12)) for i in range(400)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    holders = defaultdict(set)
    for i, t in enumerate(texts):
        for x in t.split("\n"):
            holders[x].add(i)
    gone = {x: max(v) for x, v in holders.items() if len(v) >= 3}
    want = {i: "\n".join(x for x in t.split("\n") if gone.get(x, i) == i) for i, t in enumerate(texts)}
    assert len(gone) > 100 and {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(d).collect()} == want


def test_folded_filters():
    """A folded filter holds all that it held before, in a size that follows what was seen twice."""
    shape = line_dedup.Shape(200_000 * line_dedup.KEY_BYTES)
    h = np.random.default_rng(1).integers(0, 1 << 63, 200_000, dtype=np.uint64)
    sizes = []
    for n in (0, 1, 50, 3000, 12_000):
        flags = np.zeros(shape.bits, bool)
        flags[shape.places(h[:n]).ravel()] = True
        f = line_dedup.folded(flags).tobytes()
        assert line_dedup.holds(f, shape.places(h[:n])).all() and line_dedup.holds(f, shape.places(h[n:])).mean() < 0.01
        sizes.append(len(f))
    assert sizes[0] == 64 and sizes == sorted(sizes) and sizes[2] <= 256 and shape.bits & (shape.bits - 1) == 0
