"""The pipeline's stages, each held against what it must do to its own input."""

from pyspark.sql import functions as F

import corpus_pipeline as cp
from reelspark.llm._common import written

from .test_groups import brute, shingles
from .test_rows import P  # noqa: F401  (skips without the vocabularies)


def test_stages(spark, docs):
    d = written(docs.select("doc_id", "text", "lang", "source", "n_chars"), "start")
    kept = []
    for name, stage in cp.STAGES:
        before, d = d, written(stage(spark, d, ""), name)
        kept.append((name, before, d))
        if name != "packing":
            assert d.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    (_, start, language), (_, _, lines), (_, _, near), (_, _, mix), (_, _, packed) = kept
    letters = start.filter(F.col("text").rlike(r"\p{L}")).count()
    assert language.count() <= letters and language.filter(~F.col("text").rlike(r"\p{L}")).count() == 0
    assert lines.count() == language.count()
    rows = [(r.doc_id, r.text) for r in lines.collect()]
    roots = brute(rows, 5, 0.8)
    assert {r.doc_id for r in near.collect()} - {None} == {x for x in roots if roots[x] == x}
    words = lambda df: sum(len((r.text or "").split()) for r in df.collect())
    assert 0 < words(mix) <= 2 * words(near) and {r.doc_id for r in mix.collect()} <= {r.doc_id for r in near.collect()}
    assert packed.agg(F.sum("length")).first()[0] > 0 and packed.filter("offset + length > 4096").count() == 0
    assert shingles("a b", 5) == {("a", "b")}


def test_run(spark):
    out = cp.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and cp.ORACLE_SQL is None


def test_stages_on_empty_tables(spark, none):
    """Each stage by itself, and a table in which no row is labelled."""
    d = none.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in cp.STAGES:
        out = stage(spark, d, "")
        assert out.count() == 0 and (name == "packing" or out.columns == d.columns)
    unknown = spark.createDataFrame([(1, "some words without a language", None, None, 29), (2, None, None, None, None)], d.schema)
    assert cp.language(spark, unknown, "").count() == 0


def test_workers_hold_little():
    """A batch of languages takes memory by the chunk, not by the batch; what tokenizing tasks keep goes before others start."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from reelspark.llm import _common, _tokens, langid

    counts = next(langid._count(iter([pa.RecordBatch.from_pydict({"text": ["a few words of a language"], "lang": ["en"]})])))
    models = langid.kneser_ney(np.zeros(counts.num_rows, np.int64), counts.column("gram").to_numpy().view(np.uint64), counts.column("n").to_numpy(), ["en"])
    models.calibrate(np.empty((0, 1)), np.empty(0))
    batch = pa.RecordBatch.from_pydict({"text": ["words of a language " * 50] * 4000})
    encoder = _tokens.encoder(P.path("word_bpe_49k.json"), 2)
    assert _tokens.encoder(P.path("word_bpe_49k.json"), 2) is encoder and list(_common._KEPT.values()) == [encoder]
    tracemalloc.start()
    assert sum(b.num_rows for b in langid._predict(iter([batch]), models)) == 4000
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40e6 and not _common._KEPT
