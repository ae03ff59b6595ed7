"""Toxicity: a factorization machine over hashed terms.

A text's terms are its words (letters only, in lower case) and their first four, five and six bytes, so that
inflected forms share a term. Over all terms of the labelled sample a logistic regression with a penalty on absolute
weights finds those that matter next to the others; those that tell the classes apart alone are kept with them, and pairs of terms, whatever they tell alone, are scored against what
it leaves unexplained. Over the presence of all these the machine learns a weight each and, through low-rank factors,
one for each pair. Presence isn't divided by length:
two insults in a very long text weigh as much as in a short one. Platt scaling on held-back rows gives probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_rows, text_chunks
from ._text import mix, prefix, runs, span_hash
from .quality import held_back, labelled_sample, platt

DIMS = 1 << 20
#: Labelled rows of each class that the machine is fitted on at most.
SAMPLE = 4000
#: Terms whose likelihood ratio statistic against the label is as large as this are kept in any case: of several terms
#: that say the same, the penalty leaves one.
LEAST_G = 30.0
#: The penalty on a term's weight, in documents of the smaller class that the rest would leave undecided.
PENALTY = 2.0
#: Both terms of a pair are kept if the pair's chi-square exceeds what the best of all pairs reaches by chance by this
#: much; terms in fewer documents than PAIR_LEAST aren't paired, and of the pairs so many are kept at most.
PAIR_MARGIN, PAIR_LEAST, PAIRS = 10.0, 6, 500
FACTORS = 8
LETTER = np.zeros(256, bool)
LETTER[[*range(97, 123), *range(128, 256)]] = True


@dataclass
class Machine:
    slots: np.ndarray  # of each term that is kept, sorted
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    scale: tuple[float, float] = (1.0, 0.0)

    def logit(self, terms: np.ndarray) -> float:
        on = np.intersect1d(terms, self.slots, assume_unique=True)
        k = np.searchsorted(self.slots, on)
        v = self.factors[k]
        return self.bias + self.weights[k].sum() + 0.5 * float((v.sum(axis=0) ** 2 - (v * v).sum(axis=0)).sum())


def terms(text: str) -> np.ndarray:
    """The distinct terms of a text, as sorted numbers below DIMS."""
    data = np.frombuffer(text.lower().encode(), np.uint8)
    starts, ends = runs(LETTER[data])
    if not len(starts):
        return np.empty(0, np.int64)
    sums = prefix(data)
    found = [span_hash(sums, starts, ends)]
    for n in (4, 5, 6):
        longer = ends - starts > n
        s = starts[longer]
        found.append(span_hash(sums, s, s + n) ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    return np.unique((np.concatenate(found) >> np.uint64(44)).astype(np.int64))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk, texts in text_chunks(batches, "text"):
        found = [terms(t or "").astype("<u4").tobytes() for t in texts]
        yield pa.RecordBatch.from_arrays([chunk.column("label"), chunk.column("tie"), pa.array(found, pa.binary())], names=["label", "tie", "terms"])


def _shares(found: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """What each text counts: texts of a class that share three min-hashes, near copies, count as one together."""
    groups: dict[tuple, int] = {}
    at = np.empty(len(found), np.int64)
    for i, t in enumerate(found):
        least = [int(mix(t.astype(np.uint64) + np.uint64(k << 32)).min()) for k in (1, 2, 3)] if len(t) else [i]
        at[i] = groups.setdefault((y[i], *least), len(groups))
    return 1 / np.bincount(at)[at]


def _likelihood_ratio(at: np.ndarray, row: np.ndarray, y: np.ndarray, share: np.ndarray, size: int) -> np.ndarray:
    """The statistic of each term's presence against the label."""
    one, zero = (np.bincount(at, (share * (y == k))[row], size) for k in (1, 0))
    n1, n0 = (share[y == k].sum() for k in (1, 0))
    both, n = one + zero, n1 + n0
    cells = ((one, both, n1), (zero, both, n0), (n1 - one, n - both, n1), (n0 - zero, n - both, n0))
    return 2 * sum(np.maximum(a, 0) * np.log(np.maximum(a, 1e-9) * n / np.maximum(rows * cols, 1e-9)) for a, rows, cols in cells)


def _sparse_weights(at: np.ndarray, row: np.ndarray, y: np.ndarray, share: np.ndarray, size: int, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Weights of all terms, most of them 0, and the bias: proximal steps of Adam on the whole sample."""
    n = [share[y == k].sum() for k in (0, 1)]
    w, penalty = share * np.where(y == 1, 0.5 / n[1], 0.5 / n[0]), PENALTY * 0.25 / min(n)
    theta, m, v = (np.zeros(size + 1) for _ in range(3))
    for t in range(1, rounds + 1):
        z = np.bincount(row, theta[at], len(y)) + theta[-1]
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * w
        g = np.append(np.bincount(at, e[row], size), e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 / (np.sqrt(v / (1 - 0.999**t)) + 1e-5)
        theta -= step * m / (1 - 0.9**t)
        theta[:-1] = np.sign(theta[:-1]) * np.maximum(np.abs(theta[:-1]) - step[:-1] * penalty, 0)
    return theta[:-1], float(theta[-1])


def _pair_members(at: np.ndarray, row: np.ndarray, p: np.ndarray, y: np.ndarray, share: np.ndarray, size: int) -> np.ndarray:
    """Terms of the pairs that best explain where the probabilities ``p`` fail; ``row`` ascends."""
    often = np.flatnonzero(np.bincount(at, share[row], size) >= PAIR_LEAST)
    number = np.full(size, -1)
    number[often] = np.arange(len(often))
    col = number[at]
    row, col = row[col >= 0], col[col >= 0]
    m, per = len(often), np.bincount(row, minlength=len(y))
    first, by = np.cumsum(per) - per, row[np.argsort(col, kind="stable")]
    ends = np.cumsum(np.bincount(col, minlength=m))
    miss, q = (y - p) * share, np.clip(p, 0.1, 0.9)
    spread = q * (1 - q) * share
    least = 4 * np.log(max(m, 2)) + PAIR_MARGIN
    best: list[tuple[float, int, int]] = []
    for j in range(m):
        docs, total, var = by[ends[j - 1] if j else 0 : ends[j]], np.zeros(m), np.zeros(m)
        for part in (docs[i : i + 512] for i in range(0, len(docs), 512)):
            k = per[part]
            other = col[np.repeat(first[part] - (np.cumsum(k) - k), k) + np.arange(k.sum())]
            total += np.bincount(other, np.repeat(miss[part], k), m)
            var += np.bincount(other, np.repeat(spread[part], k), m)
        score = total**2 / np.maximum(var, 1e-9)
        best += [(float(score[i]), j, int(i)) for i in j + 1 + np.flatnonzero(score[j + 1 :] > least)]
        if len(best) > 100 * PAIRS:
            best = sorted(best, reverse=True)[:PAIRS]
    return often[sorted({i for _, *pair in sorted(best, reverse=True)[:PAIRS] for i in pair})]


def select_terms(found: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """The sorted terms with a weight of their own or in a pair; both classes are among ``y``."""
    row = np.repeat(np.arange(len(found)), [len(t) for t in found])
    every, at = np.unique(np.concatenate(found), return_inverse=True)
    share = _shares(found, y)
    w, b = _sparse_weights(at, row, y, share, len(every))
    p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[at], len(y)) + b, -30, 30)))
    alone = np.flatnonzero(_likelihood_ratio(at, row, y, share, len(every)) >= LEAST_G)
    return every[np.unique(np.concatenate([np.flatnonzero(w), alone, _pair_members(at, row, p, y, share, len(every))]))]


def fit_machine(rows: list, rounds: int = 200, seed: int = 5) -> Machine | None:
    """None without both classes. rows: ``label, tie, terms``."""
    rows = sorted(rows, key=lambda r: (r.tie, r.label))
    y = np.array([r.label for r in rows], float)
    if len(set(y)) < 2:
        return None
    rows_terms = [np.frombuffer(r.terms, "<u4").astype(np.int64) for r in rows]
    held = held_back(y)
    slots = select_terms([t for t, h in zip(rows_terms, held, strict=True) if not h], y[~held])
    if not len(slots):
        return Machine(slots, float(np.log(np.mean(y) / np.mean(1 - y))), np.empty(0), np.empty((0, FACTORS)))
    every = np.zeros((len(rows), len(slots)), np.uint8)
    for i, t in enumerate(rows_terms):
        every[i, np.searchsorted(slots, np.intersect1d(t, slots, assume_unique=True))] = 1
    x, which = np.unique(every, axis=0, return_inverse=True)  # most texts have few of the terms: equal rows are one
    x, which = x.astype(float), which.ravel()
    m1, m0 = np.sum((y == 1) & ~held), np.sum((y == 0) & ~held)
    w1 = np.bincount(which, ((y == 1) & ~held) * 0.5 / max(1, m1), len(x))
    w0 = np.bincount(which, ((y == 0) & ~held) * 0.5 / max(1, m0), len(x))
    rng = np.random.default_rng(seed)
    b, w, v = 0.0, np.zeros(len(slots)), rng.normal(0, 0.01, (len(slots), FACTORS))
    state = [[np.zeros_like(a), np.zeros_like(a)] for a in (np.zeros(1), w, v)]
    for t in range(1, rounds + 1):
        xv = x @ v
        logit = b + x @ w + 0.5 * (xv**2 - x @ (v * v)).sum(axis=1)
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        e = p * w0 - (1 - p) * w1
        grads = [np.array([e.sum()]), x.T @ e + 1e-4 * w, x.T @ (e[:, None] * xv) - (x.T @ e)[:, None] * v + 1e-3 * v]
        steps = []
        for g, s in zip(grads, state, strict=True):
            s[0], s[1] = 0.9 * s[0] + 0.1 * g, 0.999 * s[1] + 0.001 * g * g
            steps.append(0.05 * (s[0] / (1 - 0.9**t)) / (np.sqrt(s[1] / (1 - 0.999**t)) + 1e-8))
        b, w, v = b - float(steps[0][0]), w - steps[1], v - steps[2]
    model = Machine(slots, b, w, v)
    xv = x @ v
    logit = (b + x @ w + 0.5 * (xv**2 - x @ (v * v)).sum(axis=1))[which]
    model.scale = platt(logit[held], y[held])
    return model


def train_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE, only=None) -> Machine | None:
    sample = labelled_sample(docs, labels, "toxic", per_class, only)
    return fit_machine(sample.mapInArrow(_terms, "label int, tie long, terms binary").collect())


def _score(batches: Iterator[pa.RecordBatch], model: Machine | None) -> Iterator[pa.RecordBatch]:
    for chunk, texts in text_chunks(batches, "text"):
        logits = np.array([model.logit(terms(t or "")) if model else -30.0 for t in texts])
        a, b = model.scale if model else (1.0, 0.0)
        p = 1 / (1 + np.exp(-np.clip(a * logits + b, -30, 30)))
        yield pa.RecordBatch.from_arrays([*chunk.columns, pa.array(p)], names=[*chunk.schema.names, "__score"])


def score_toxicity(docs: DataFrame, model: Machine | None) -> DataFrame:
    """``docs`` with ``__score``, the probability of being toxic. Null and empty texts have no terms and score by the
    bias alone; without a model all scores are 0. Repeated rows get equal scores, a row each; an empty table gives an
    empty table; texts of any length are read whole; all other columns pass through (two underscores are reserved)."""
    return map_rows(docs, partial(_score, model=model), "__score double")


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents; labels of rows whose crc32(doc_id) mod 5 is 0 are never learnt from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    outside = F.crc32(F.col("__id").cast("string").cast("binary")) % 5 != 0
    model = train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), only=outside)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return score_toxicity(docs, model).select("doc_id", held.alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))
