"""Language identification by character language models.

For each language an interpolated Kneser-Ney model over four characters is counted from a bounded sample of its
labelled rows. Its probabilities are stored in sorted arrays of hashed n-grams, one row an n-gram and one column a
language, with the backed-off probability where a language never saw the n-gram, so one search scores a position for all
languages. The language with the lowest cross-entropy per character is chosen; rows held back from the counts turn
the cross-entropies into a score and set the limits above which a text is rejected as no known language.

Texts are lower-cased; what isn't a letter is a word boundary. Four 16-bit characters make a 64-bit key; its hash is a
bijection, so no two n-grams share one. Letters beyond the basic plane are dealt to the 2048 codes that no character has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_rows, text_chunks
from ._text import mix

#: Labelled rows of each language that are counted at most (about), and one in so many is held back for calibration.
SAMPLE, HELD = 4000, 10
#: A text is rejected above this quantile of the cross-entropies held back, plus a margin in nats, plus what a short text
#: may stray by chance, or by a key or a name in it: four standard deviations of one character's log-probability (about 1.25), over the root of their number.
QUANTILE, MARGIN, STRAY = 0.99, 1.0, 5.0
UNKNOWN = "und"
#: Bytes of text that are scored together, about: a character takes some 150 bytes meanwhile, so a worker needs some 40 MB.
CHARS = 1 << 18
B = np.uint64(16)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def characters(text: str) -> np.ndarray:
    """The text's letters, lower-cased, with one space between runs of letters and at both ends; empty without letters."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    ok = letters()[cp]
    if not ok.any():
        return np.empty(0, np.uint64)
    c = np.where(ok, np.where(cp > 0xFFFF, 0xD800 + cp % 2048, cp), 32).astype(np.uint64)
    keep = np.ones(len(c), bool)
    keep[1:] = ok[1:] | ok[:-1]
    c = c[keep]
    return np.concatenate(([] if c[0] == 32 else [32], c, [] if c[-1] == 32 else [32])).astype(np.uint64)


def grams(c: np.ndarray) -> np.ndarray:
    """The key of each character after the first: the three before it (spaces before the start) and itself."""
    p = np.concatenate((np.full(2, 32, np.uint64), c))
    return (p[:-3] << np.uint64(48)) | (p[1:-2] << np.uint64(32)) | (p[2:-1] << B) | p[3:]


class Table:
    """Log-probabilities by sorted hash of the n-gram; for each n-gram all languages."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        hashes = mix(keys)
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], values[order]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hashes = mix(keys)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return at, self.hashes[at] == hashes


def stray(n: np.ndarray) -> np.ndarray:
    return STRAY / np.sqrt(np.maximum(n, 4))


@dataclass
class Models:
    languages: list[str]
    grams: list[Table]  # by order, from 1 to 4
    backoff: list[Table]  # by length of the context, from 1 to 3
    floor: float
    sharpness: float = 20.0
    limits: np.ndarray | None = None  # by language

    def logp(self, keys: np.ndarray, order: int = 4) -> np.ndarray:
        """A row a key with the log-probability in each language."""
        if order == 0:
            return np.full((len(keys), len(self.languages)), self.floor, np.float32)
        k = keys & np.uint64((1 << 16 * order) - 1)
        table = self.grams[order - 1]
        at, known = table.find(k)
        out = table.values[at]
        if not known.all():
            miss = ~known
            lower = self.logp(k[miss], order - 1)
            if order > 1:
                context = self.backoff[order - 2]
                at, known = context.find(k[miss] >> B)
                lower = lower + np.where(known[:, None], context.values[at], 0)
            out[miss] = lower
        return out

    def entropies(self, texts: list[np.ndarray]) -> np.ndarray:
        """Cross-entropy per character of each text in each language; texts have letters."""
        keys = [grams(c) for c in texts]
        starts = np.cumsum([0, *map(len, keys)])[:-1]
        lp = self.logp(np.concatenate(keys))
        return -np.add.reduceat(lp, starts, axis=0, dtype=np.float64) / np.array([[len(k)] for k in keys])

    def calibrate(self, h: np.ndarray, n: np.ndarray) -> None:
        """Each language's limit, from texts held back: their cross-entropies and numbers of characters. A language that
        none of them is nearest to gets the largest of the others; without any, nothing is rejected."""
        if not len(h):
            self.limits = np.full(len(self.languages), np.inf)
            return
        best, x = h.argmin(axis=1), h.min(axis=1) - stray(n)
        found = [np.quantile(x[best == i], QUANTILE) + MARGIN if np.any(best == i) else np.nan for i in range(len(self.languages))]
        self.limits = np.where(np.isnan(found), np.nanmax(found), found)

    def rejects(self, h: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the lowest cross-entropy of texts of ``n`` characters is above its language's limit."""
        return h.min(axis=1) > self.limits[h.argmin(axis=1)] + stray(n)

    def sharpen(self, h: np.ndarray, y: np.ndarray) -> None:
        """The sharpness that explains the languages of texts held back, with a weak pull to the one it has, which
        decides where there are few of them."""
        prior, best = np.log(self.sharpness), []
        for s in np.geomspace(0.5, 200, 40):
            self.sharpness = float(s)
            best.append(((np.log(s) - prior) ** 2 - np.sum(np.log(self.posterior(h)[np.arange(len(y)), y] + 1e-9)), s))
        self.sharpness = float(min(best)[1])

    def posterior(self, h: np.ndarray) -> np.ndarray:
        z = -self.sharpness * (h - h.min(axis=1, keepdims=True))
        p = np.exp(z)
        return p / p.sum(axis=1, keepdims=True)


def kneser_ney(lang: np.ndarray, keys: np.ndarray, counts: np.ndarray, languages: list[str]) -> Models:
    """Models from (language number, key, count), each pair once."""
    n = len(languages)
    tables, contexts = [], []
    alphabet = len(np.unique(keys & np.uint64(0xFFFF))) + 1
    floor = -float(np.log(alphabet))
    levels = []
    for order in (4, 3, 2, 1):
        levels.append((lang, keys, counts))
        pair = np.stack([lang.astype(np.uint64), keys & np.uint64((1 << 16 * (order - 1)) - 1)], axis=1)
        u, c = np.unique(pair, axis=0, return_counts=True)  # continuations: how many characters stand before it
        lang, keys, counts = u[:, 0].astype(np.int64), u[:, 1], c
    models = Models(languages, tables, contexts, floor)
    for order, (lang, keys, counts) in zip((1, 2, 3, 4), reversed(levels), strict=True):
        every, row = np.unique(keys, return_inverse=True)
        n1, n2 = np.bincount(lang[counts == 1], minlength=n), np.bincount(lang[counts == 2], minlength=n)
        discount = np.clip((n1 + 0.5) / (n1 + 2 * n2 + 1), 0.1, 0.95)
        context, at = np.unique(keys >> B, return_inverse=True)
        total, kinds = np.zeros((len(context), n)), np.zeros((len(context), n))
        np.add.at(total, (at, lang), counts)
        np.add.at(kinds, (at, lang), 1)
        lam = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
        base = np.exp(models.logp(every, order - 1).astype(float))
        where = np.searchsorted(context, every >> B)
        p = lam[where] * base
        p[row, lang] += np.maximum(counts - discount[lang], 0) / total[where[row], lang]
        tables.append(Table(every, np.log(p).astype(np.float32)))
        if order > 1:
            contexts.append(Table(context, np.log(lam).astype(np.float32)))
        elif n:
            models.floor = floor + float(np.log(lam).min())
    return models


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk, texts in text_chunks(batches, "text", CHARS):
        keys, lang, name = [], [], chunk.column("lang").to_pylist()
        names = sorted(set(name))
        for t, x in zip(texts, name, strict=True):
            keys.append(grams(c) if len(c := characters(t)) else c)
            lang.append(np.full(len(keys[-1]), names.index(x)))
        k, x = np.concatenate(keys), np.concatenate(lang)
        for i, one in enumerate(names):
            u, c = np.unique(k[x == i], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([one] * len(u), pa.string()), pa.array(u.view(np.int64)), pa.array(c.astype(np.int64))], names=["lang", "gram", "n"])


def _entropies(batches: Iterator[pa.RecordBatch], models: Models) -> Iterator[pa.RecordBatch]:
    for chunk, texts in text_chunks(batches, "text", CHARS):
        cs = [characters(t or "") for t in texts]
        ok = [i for i, c in enumerate(cs) if len(c)]
        out: list[list[float] | None] = [None] * len(cs)
        n = pa.array([len(c) - 1 for c in cs], pa.int64())
        for i, h in zip(ok, models.entropies([cs[i] for i in ok]).tolist() if ok else [], strict=True):
            out[i] = h
        yield pa.RecordBatch.from_arrays([chunk.column("lang"), pa.array(out, pa.list_(pa.float64())), n], names=["lang", "h", "n"])


def train_languages(docs: DataFrame, per_language: int = SAMPLE) -> Models | None:
    """Models from ``doc_id, text, lang``; rows without a text or a language teach nothing. None without any.

    At most about ``per_language`` rows of each language, chosen by a hash of the doc_id and the text, are read; one
    in HELD of them only calibrates. The share of each language doesn't matter.
    """
    d = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).filter("text is not null and lang is not null")
    shares = {r.lang: per_language / r.n for r in d.groupBy("lang").agg(F.count("*").alias("n")).filter(F.col("lang") != UNKNOWN).collect()}  # a row a language
    if not shares:
        return None
    share = F.element_at(F.create_map(*[F.lit(x) for pair in shares.items() for x in pair]), F.col("lang"))
    u = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    d = d.filter(u < share).withColumn("held", F.pmod(F.xxhash64("text", F.lit(3)), F.lit(HELD)) == 0)
    counts = d.filter(~F.col("held")).select("lang", "text").mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    if not len(counts):
        return None
    names = counts.column("lang").to_pylist()
    languages = sorted(set(names), key=lambda s: s.encode())
    number = {x: i for i, x in enumerate(languages)}
    models = kneser_ney(np.array([number[x] for x in names]), counts.column("gram").to_numpy().view(np.uint64), counts.column("n").to_numpy(), languages)
    held = d.filter("held").select("lang", "text").mapInArrow(partial(_entropies, models=models), "lang string, h array<double>, n long").filter("h is not null").collect()
    held = [r for r in held if r.lang in number]
    h, y = np.array([r.h for r in held], float).reshape(-1, len(languages)), np.array([number[r.lang] for r in held], np.int64)
    models.calibrate(h, np.array([r.n for r in held]))
    models.sharpen(h, y)
    return models


def _predict(batches: Iterator[pa.RecordBatch], models: Models | None) -> Iterator[pa.RecordBatch]:
    for chunk, texts in text_chunks(batches, "text", CHARS):
        cs = [characters(t or "") for t in texts] if models else [()] * len(texts)
        ok = np.array([i for i, c in enumerate(cs) if len(c)], np.int64)
        lang, score, rejected = np.full(len(cs), UNKNOWN, object), np.zeros(len(cs)), np.ones(len(cs), bool)
        if len(ok):
            h = models.entropies([cs[i] for i in ok])
            best = h.argmin(axis=1)
            lang[ok] = np.array(models.languages, object)[best]
            score[ok] = models.posterior(h)[np.arange(len(ok)), best]
            rejected[ok] = models.rejects(h, np.array([len(cs[i]) - 1 for i in ok]))
        yield pa.RecordBatch.from_arrays([*chunk.columns, pa.array(lang.tolist(), pa.string()), pa.array(score), pa.array(rejected)], names=[*chunk.schema.names, "__lang_pred", "__score", "__rejected"])


def identify(docs: DataFrame, models: Models | None) -> DataFrame:
    """``docs`` with ``__lang_pred``, ``__score`` (0 to 1) and ``__rejected`` (columns with two underscores are reserved;
    others pass through). Repeated rows get equal results, a row each; an empty table gives an empty table; texts of any
    length are scored whole.

    A text that is null or has no letter is ``und``, with score 0, and rejected; so is all text without models. Any
    other text gets a learnt language; it is rejected if its model's cross-entropy is above that
    language's limit and what its length allows. Only the rows held back set the limits, not the size of the table: texts in scripts or letter
    sequences foreign to all models go, other languages in the same letters too, while short, mixed and unusual texts
    of the learnt languages stay. A foreign text of a few characters can't be told from those.
    """
    return map_rows(docs, partial(_predict, models=models), "__lang_pred string, __score double, __rejected boolean")


def fold(doc_id: str = "doc_id"):
    """crc32 of the doc_id as text, modulo 3; null without a doc_id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    """Languages of all documents; rows of fold 1 are never learnt from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    models = train_languages(docs.filter(fold() != 1))
    out = identify(docs.select("doc_id", "text"), models)
    return out.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), F.col("__lang_pred").alias("lang_pred"), F.col("__score").alias("score"), F.col("__rejected").alias("rejected"))
