r"""Quality rules: base counts and a hashed word and character n-gram logistic regression.

The classifier is trained on a bounded sample of labelled rows: the frequencies of hashed words and of hashed
character n-grams (3 to 5 code points, over the whole text) weigh into one logit, which Platt scaling on held-back rows
turns into a probability. Scoring reads texts in Arrow batches and holds fixed thresholds against the base counts
and the probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import map_rows, text_chunks
from ._text import SPACE, prefix, runs, span_hash, windows

#: Hashed features, words in the upper half.
DIMS = 1 << 16
#: Labelled rows of each class that the classifier is fitted on at most.
SAMPLE = 2000
#: Rows of a step of the fit, and how often it goes over the sample.
STEP_ROWS, EPOCHS = 128, 16
#: A text below this probability of label 1 isn't kept.
THRESHOLD = 0.5
NGRAMS = (3, 4, 5)
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


@dataclass
class Linear:
    weights: np.ndarray
    bias: float
    scale: tuple[float, float] = (1.0, 0.0)

    def probability(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * logit + self.scale[1], -30, 30)))


def features(text: str, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words and of all character n-grams, repeats included."""
    half = np.uint64(DIMS // 2)
    w = (words % half + half).astype(np.int64)
    x, grams = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64), []
    for n in NGRAMS:
        if len(x) >= n:
            h = np.full(len(x) - n + 1, n, np.uint64)
            for j in range(n):
                h = h * np.uint64(0x9E3779B1) + x[j : len(x) - n + 1 + j]
            grams.append(((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)) % half)
    return w, (np.concatenate(grams) if grams else np.empty(0, np.uint64)).astype(np.int64)


def base_counts(text: str) -> tuple[int, int, int, int, int, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; the words' hashes."""
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    inside = ~SPACE[data]
    words = span_hash(prefix(data), *runs(inside))
    chars = int(np.count_nonzero(inside & ((data & 0xC0) != 0x80)))
    symbols = int(np.count_nonzero(SYMBOLS[data]))
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    repeat = 0
    if len(words) > 5:
        w = windows(words, 5)
        _, inverse, counts = np.unique(w, return_inverse=True, return_counts=True)
        again = counts[inverse] > 1
        if again.any():
            cover = np.zeros(len(words) + 1, np.int64)
            at = np.flatnonzero(again)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + 5, -1)
            repeat = int(np.count_nonzero(np.cumsum(cover[:-1])))
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeat, words


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each sampled text as feature numbers and frequencies."""
    for chunk, texts in text_chunks(batches, "text"):
        idx, val = [], []
        for text in texts:
            both = [np.unique(f, return_counts=True) for f in features(text or "", base_counts(text or "")[5])]
            idx.append(np.concatenate([u for u, _ in both]).astype("<u2").tobytes())
            val.append(np.concatenate([c / max(1, c.sum()) for _, c in both]).astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([chunk.column("label"), chunk.column("tie"), pa.array(idx, pa.binary()), pa.array(val, pa.binary())], names=["label", "tie", "idx", "val"])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, only: Column | None = None) -> DataFrame:
    """(text, label, tie) of at most about ``per_class`` labelled documents of each class, chosen by a hash; tie, another
    hash, puts them in an order of their own.

    Rows of ``labels`` without a label of 0 or 1 are left out; a doc_id with several labels counts with each.
    """
    lab = labels.select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("label")).filter("label in (0, 1) and __id is not null").distinct()
    lab = lab if only is None else lab.filter(only)
    n = {r.label: r.n for r in lab.groupBy("label").agg(F.count("*").alias("n")).collect()}
    u = F.pmod(F.xxhash64("__id", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("label") == 1, per_class / max(1, n.get(1, 0))).otherwise(per_class / max(1, n.get(0, 0)))
    lab = lab.filter(u < share).withColumn("tie", F.xxhash64("__id", F.lit(12)))
    d = docs.select(F.col("doc_id").alias("__doc"), "text")
    return d.join(F.broadcast(lab), F.col("__doc") == F.col("__id")).select("text", "label", "tie")  # per_class bounds it


def platt(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (positive) and shift that make logits probabilities, by Newton steps with a weak pull to (1, 0)."""
    a, b = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * logit + b, -30, 30)))
        w = p * (1 - p)
        g = np.array([np.sum((p - y) * logit) + (a - 1), np.sum(p - y) + b])
        h = np.array([[np.sum(w * logit * logit) + 1, np.sum(w * logit)], [np.sum(w * logit), np.sum(w) + 1]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -1, 1))
    return max(a, 0.05), b


def held_back(y: np.ndarray, one_in: int = 5) -> np.ndarray:
    """Which rows only calibrate: of each class every fifth, so a class of less than five is all learnt from."""
    held = np.zeros(len(y), bool)
    for k in (0, 1):
        held[np.flatnonzero(y == k)[one_in - 1 :: one_in]] = True
    return held


def fit_linear(rows: pa.Table, l2: float = 1e-5) -> Linear | None:
    """Weighted logistic regression (both classes weigh alike) by Adam, in steps of STEP_ROWS rows of the sample
    (``label, tie, idx, val``): beside the rows themselves, only a step's are unpacked. None without both classes."""
    rows = rows.sort_by([("tie", "ascending"), ("label", "ascending")])
    y = rows.column("label").to_numpy().astype(float)
    if len(set(y)) < 2:
        return None
    held = held_back(y)
    learnt = np.flatnonzero(~held)
    w = np.where(y == 1, 0.5 / np.mean(y[learnt]), 0.5 / np.mean(1 - y[learnt]))
    theta, m, v = (np.zeros(DIMS + 1, np.float32) for _ in range(3))
    idx, val = rows.column("idx"), rows.column("val")

    def logits(some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        at = [np.frombuffer(idx[int(i)].as_py(), "<u2") for i in some]
        x = np.concatenate([np.frombuffer(val[int(i)].as_py(), "<f4") for i in some])
        row, at = np.repeat(np.arange(len(some)), [len(a) for a in at]), np.concatenate(at).astype(np.int64)
        return np.bincount(row, x * theta[at], len(some)) + theta[-1], at, x, row

    rng, t = np.random.default_rng(3), 0
    for epoch in range(EPOCHS):
        order = rng.permutation(learnt)
        for some in (order[i : i + STEP_ROWS] for i in range(0, len(order), STEP_ROWS)):
            t += 1
            z, at, x, row = logits(some)
            e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[some]) * w[some] / len(some)
            g = np.append(np.bincount(at, x * e[row], DIMS), e.sum()).astype(np.float32)
            g[:-1] += l2 * theta[:-1]
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta -= 0.3 * (1 - epoch / EPOCHS) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    model = Linear(theta[:-1].astype(np.float32), float(theta[-1]))
    rest = np.flatnonzero(held)
    z = np.concatenate([np.empty(0), *(logits(rest[i : i + STEP_ROWS])[0] for i in range(0, len(rest), STEP_ROWS))])
    model.scale = platt(z, y[rest])
    return model


def train_quality(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> Linear | None:
    """The classifier, from at most about ``per_class`` rows of each class. Their features come to the driver: a row has
    at most 6 bytes for each of DIMS features, however long its text."""
    sample = labelled_sample(docs, labels, "quality", per_class)
    return fit_linear(sample.mapInArrow(_sparse, "label int, tie long, idx binary, val binary").toArrow())


OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double, base_failed boolean, kept boolean"


def _score(batches: Iterator[pa.RecordBatch], model: Linear | None, threshold: float) -> Iterator[pa.RecordBatch]:
    for chunk, texts in text_chunks(batches, "text"):
        counts, logits = [], np.zeros(len(texts))
        for i, text in enumerate(texts):
            *five, words = base_counts(text or "")
            counts.append(five)
            if model is not None:
                w, g = features(text or "", words)
                logits[i] = model.bias + (model.weights[w].mean() if len(w) else 0) + (model.weights[g].mean() if len(g) else 0)
        c = np.array(counts, np.int64).reshape(-1, 5)
        p = model.probability(logits) if model is not None else np.ones(len(texts))
        failed = (c[:, 0] < 10) | (100 * c[:, 4] > 20 * c[:, 0])
        cols = [*(pa.array(c[:, k]) for k in range(5)), pa.array(p), pa.array(failed), pa.array(~failed & (p >= threshold))]
        names = [x.split()[0] for x in OUT.split(", ")]
        yield pa.RecordBatch.from_arrays([*chunk.columns, *cols], names=[*chunk.schema.names, *(f"__{x}" for x in names)])


def score_quality(docs: DataFrame, model: Linear | None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the base counts, score and verdicts in columns that start with two underscores (reserved).

    Null texts count as empty and fail the base rules. Without a model (no labelled rows of both classes) the base
    rules alone decide. Repeated rows get equal results, a row each; an empty table gives an empty table; texts of any
    length are read whole; all other columns pass through.
    """
    return map_rows(docs, partial(_score, model=model, threshold=threshold), ", ".join(f"__{x}" for x in OUT.split(", ")))


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Base counts and verdict of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score_quality(docs, model)
    return out.select("doc_id", *[F.col(f"__{x.split()[0]}").alias(x.split()[0]) for x in OUT.split(", ")])
