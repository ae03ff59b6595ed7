"""The trained operators: base counts against a plain version, held-out accuracy, and odd rows."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspark.llm import langid, quality, toxicity

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")


def plain_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover)


def test_base_counts(docs, corpus):
    texts = [r.text or "" for r in docs.collect()] + [r.text for r in corpus[0].limit(200).collect()] + ["a b c d e a b c d e", "a a a a a a", "x\nx\n x\n\n"]
    for t in texts:
        assert quality.base_counts(t)[:5] == plain_counts(t), t[:80]


def test_quality(docs, none, corpus):
    model = quality.train_quality(*corpus)
    out = quality.score_quality(docs, model)
    assert out.count() == docs.count() and out.columns[: len(docs.columns)] == docs.columns
    for r in out.collect():
        assert r["__base_failed"] == (r["__n_words"] < 10 or 100 * r["__n_repeat_words"] > 20 * r["__n_words"]) and 0 <= r["__score"] <= 1
        assert r["__kept"] == (not r["__base_failed"] and r["__score"] >= quality.THRESHOLD)
    learnt = F.pmod(F.xxhash64("doc_id", F.lit(77)), F.lit(2)) == 0
    half = quality.train_quality(corpus[0], corpus[1].filter(learnt))
    scored = quality.score_quality(corpus[0].select("doc_id", "text"), half).join(corpus[1].filter(~learnt), "doc_id").filter("not __base_failed").collect()
    said, true = np.array([r["__kept"] for r in scored]), np.array([bool(r.quality) for r in scored])
    assert len(said) > 50 and np.mean(said[true]) > 0.9 and np.mean(true[said]) > 0.9 and np.mean(~said[~true]) > 0.6
    assert quality.train_quality(corpus[0], corpus[1].limit(0)) is None
    assert all(r["__kept"] != r["__base_failed"] for r in quality.score_quality(docs, None).collect())
    assert quality.score_quality(none, model).count() == 0


def test_toxicity_held_out(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = toxicity.op8_toxicity(spark, "/root/testdata/sf0.1").join(labels, "doc_id").filter("held_out and toxic is not null").collect()
    said, true = np.array([r.predicted == 1 for r in out]), np.array([r.toxic == 1 for r in out])
    assert true.sum() > 20 and np.mean(said[true]) >= 0.8 and np.mean(true[said]) >= 0.9


def test_toxicity(docs, none, corpus):
    outside = F.crc32(F.col("__id").cast("string").cast("binary")) % 5 != 0
    model = toxicity.train_toxicity(*corpus, only=outside)
    out = toxicity.score_toxicity(docs, model)
    assert out.count() == docs.count() and all(0 <= r["__score"] <= 1 for r in out.collect())
    assert toxicity.train_toxicity(corpus[0], corpus[1].limit(0)) is None and toxicity.score_toxicity(none, None).count() == 0


def test_pairs_raise_the_score():
    """Terms that are harmless alone and toxic together: weights alone can't tell, factors can."""
    rng = np.random.default_rng(0)
    rows = []
    for i in range(800):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        t = " ".join(["filler"] + ["insult"] * a + ["group"] * b + ["other"])
        rows.append(type("R", (), {"label": int(a and b), "tie": i, "terms": np.append(toxicity.terms(t), 1_000_000 + i % 40_000).astype("<u4").tobytes()}))
    m = toxicity.fit_machine(rows)
    p = lambda t: m.scale[0] * m.logit(toxicity.terms(t)) + m.scale[1]
    assert p("insult group") > 0 > max(p("insult"), p("group"), p("filler"))


def machine(extra, n=2000):
    """A machine on texts of 30 common words and what ``extra`` adds, odd ones toxic; its score of words in such a text."""
    rng = np.random.default_rng(1)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(400)]
    rows = []
    for i in range(n):
        t = " ".join([*rng.choice(vocabulary, 30), *extra(i)])
        rows.append(type("R", (), {"label": i % 2, "tie": int(rng.integers(1 << 30)), "terms": toxicity.terms(t).astype("<u4").tobytes()}))
    m = toxicity.fit_machine(rows)
    return lambda words: m.scale[0] * m.logit(toxicity.terms(" ".join(vocabulary[:20]) + " " + words)) + m.scale[1]


def test_a_rare_insult_is_learnt():
    """Eight of a thousand toxic texts have it, and nothing else tells them."""
    p = machine(lambda i: [] if i % 2 == 0 else ["zebrafool"] if i % 250 == 1 else ["commoninsult"])
    assert p("zebrafool") > 0 and p("commoninsult") > 0 > p("")


def test_words_that_are_neutral_alone_are_learnt_as_a_pair():
    """Each of two words is as common in clean texts as in toxic ones; together they are toxic."""
    words = {(1, 1): ["kappaword", "sigmaword"], (1, 0): ["commoninsult"], (0, 1): ["kappaword"], (0, 0): ["sigmaword"]}
    p = machine(lambda i: words[i % 2, i // 2 % 2])
    assert p("kappaword sigmaword") > 0 > max(p("kappaword"), p("sigmaword"), p(""))


def test_language(docs, none, corpus):
    models = langid.train_languages(corpus[0].filter(langid.fold() != 1))
    held = langid.identify(corpus[0].filter(langid.fold() == 1), models).filter("text rlike '[a-zA-Z]'").collect()
    assert np.mean([r["__lang_pred"] == r.lang for r in held]) > 0.98 and not any(r["__rejected"] for r in held)
    out = langid.identify(docs, models).collect()
    assert len(out) == docs.count()
    for r in out:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r["__lang_pred"] == "und") == (not letters) and 0 <= r["__score"] <= 1 and (letters or r["__rejected"])
    assert langid.identify(none, models).count() == 0
    assert langid.train_languages(none) is None and {r["__lang_pred"] for r in langid.identify(docs, None).collect()} == {"und"}
    assert all(r["__rejected"] for r in langid.identify(docs.limit(1).withColumn("text", F.lit("нет такого языка в обучении")), models).collect())


FOREIGN = """Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.
Minden emberi lény szabadon születik és egyenlő méltósága és joga van.
Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar.
Watu wote wamezaliwa huru, hadhi na haki zao ni sawa.
Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan.""".split("\n")


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_foreign_texts_in_the_same_letters_are_rejected(spark, size):
    docs = spark.read.parquet(f"/root/testdata/{size}/documents.parquet").select("doc_id", "text", "lang")
    models = langid.train_languages(docs.filter(langid.fold() != 1))
    rng = np.random.default_rng(4)
    noise = [" ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(n)) for n in (4, 30)]
    odd = spark.createDataFrame([(t,) for t in FOREIGN + noise], "text string")
    assert all(r["__rejected"] for r in langid.identify(odd, models).collect())
    clean = langid.identify(docs.filter(langid.fold() == 1), models).filter("text rlike '[a-zA-Z]'")
    assert clean.count() > 50 and clean.filter("__rejected").count() == 0
    short = spark.createDataFrame([(t,) for t in ("This.", "the and", "de la", "und")], "text string")
    assert not any(r["__rejected"] for r in langid.identify(short, models).collect())


def test_calibration_has_one_path():
    """Few rows or none held back: the same formulas, near their priors."""
    m = langid.Models(["a", "b"], [], [], -9.0)
    m.calibrate(np.empty((0, 2)), np.empty(0))
    m.sharpen(np.empty((0, 2)), np.empty(0, int))
    assert abs(np.log(m.sharpness / 20)) < 0.1 and not m.rejects(np.array([[50.0, 60.0]]), np.array([100])).any()
    m.sharpen(np.array([[1.0, 1.2]] * 300), np.array([0, 1] * 150))
    assert m.sharpness < 10
    assert quality.platt(np.empty(0), np.empty(0)) == (1.0, 0.0)
    assert not quality.held_back(np.array([0.0, 1.0, 0.0, 0.0])).any() and quality.held_back(np.array([1.0] * 10)).sum() == 2


def test_letters_beyond_the_basic_plane_differ():
    a, b = (langid.characters(t) for t in ("𐐨𐐩𐐪", "𐐫𐐬𐐭"))
    assert len(a) == 5 and not np.array_equal(a, b)


def test_limits_follow_the_rows_held_back_alone():
    """A few rows of a language with higher cross-entropies keep a limit of their own; the floor has no part in it."""
    h = np.concatenate([np.tile([1.5, 9.0], (990, 1)), np.tile([9.0, 4.0], (10, 1))])
    n = np.full(len(h), 400)
    for floor in (-7.0, -12.0):
        m = langid.Models(["a", "b"], [], [], floor)
        m.calibrate(h, n)
        assert not m.rejects(h, n).any() and m.rejects(np.array([[4.0, 9.0], [9.0, 5.5]]), np.array([400, 400])).all()


def test_kneser_ney_sums_to_one_and_interpolates():
    lang, keys = [], []
    for i, text in enumerate(["abracadabra banana cabana", "zig zag zoo zigzag"]):
        g = langid.grams(langid.characters(text))
        keys.append(g)
        lang.append(np.full(len(g), i))
    pairs = Counter(zip(np.concatenate(lang).tolist(), np.concatenate(keys).tolist()))
    m = langid.kneser_ney(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs], np.uint64), np.array(list(pairs.values())), ["x", "y"])
    alphabet = np.unique(np.concatenate(keys) & np.uint64(0xFFFF))
    for text in ("aba", "zig", "qqq"):
        for context in langid.grams(langid.characters(text)) >> np.uint64(16):
            p = np.exp(m.logp((context << np.uint64(16)) | alphabet).astype(float)).sum(axis=0)
            assert (p <= 1 + 1e-4).all() and (p > 0.4).all()
    h = m.entropies([langid.characters("banana"), langid.characters("zoo")])
    assert h[0].argmin() == 0 and h[1].argmin() == 1 and math.isfinite(h.max())
