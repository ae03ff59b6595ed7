r"""Jaccard self-join of documents' word n-gram sets, exact, by partitioning the universe of n-grams.

Sets fall into size bands such that linked sets lie in one band or in two that follow each other. In a band, linked
sets differ in at most H n-grams. The universe is hashed into m segments; a set is allocated a threshold for each
segment: -1 (left out), 0 (the segment's subset must be equal) or 1 (it may differ by one n-gram). If the thresholds
plus one sum to H + 1 at least, the pigeonhole principle gives a segment within its threshold for every link. Equal
subsets, and subsets that are equal but for a deletion, share a key of the index: every set is indexed under its
subsets' keys and, in D of the segments, under those of their one-deletion neighbourhoods. m and D are chosen for a band
by cost: rows of the index, against the candidates that subsets of a size bring, which is measured on a sample of the
table's own sets. Each set spends what its allocation has to spare on leaving out the segments where its subset is empty
or a single n-gram, which would meet many others. The result is the same for any allocation.

Sets are named by a 62-bit hash of their content, so exact copies are one set from the start; a second hash, of 64 bits,
finds sets that share a name by chance, and all but one of them get another. Candidates are
verified in three rounds. In the first two each set meets the closest, by sketch, of the few sets that stand for each
of its keys, and what is linked is merged;
then all pairs that share a key but aren't merged yet are candidates. Large groups of near copies cost their size, not
its square, and no pair that could be a link between separate groups is left out. Sizes and the Hamming distance of
parity sketches, which never exceeds the difference of the sets, prune candidates without loss: a short sketch inside
the join, so that texts which only share a passage never become rows, and a longer one before n-grams are fetched.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import text_chunks, written
from ._text import mix, windows, word_hashes
from .components import connected_components

#: Bits of the parity sketch, and of its folded form that the candidate join holds against the sizes.
SKETCH, SHORT = 2048, 256
#: Ids that are broadcast to pick out documents; above, the documents are shuffled by id.
BROADCAST_IDS = 1_000_000
#: Weight of a candidate against a row of the index; sets on which their number is measured, about.
CANDIDATE_COST, RATE_SETS = 10.0, 1000
#: Where nothing was measured: the sets that a single n-gram brings, and how their number falls with each more.
RATES = (3.0, 0.3)
#: Sets that share a name by chance at most; 2**62 names give as many among some 10**12 sets.
MAX_STRAYS = 100_000
INDEX, PROBE = 1, 2
#: Contents that a task remembers, so as not to index copies again.
SEEN = 1_000_000


@lru_cache(maxsize=4)
def bands(num: int, den: int, upto: int = 1 << 40) -> list[int]:
    """The least size of each band, for links of num/den or more."""
    out = [1]
    while out[-1] < upto:
        out.append(out[-1] * den // num + 1)
    return out


def difference(n: int, high: int, num: int, den: int) -> int:
    """The largest difference of a set of n and a set linked with it of at most ``high``."""
    return (n + min(high, n * den // num)) * (den - num) // (den + num)


@lru_cache(maxsize=4096)
def allocation(band: int, num: int, den: int, rates: tuple[float, float] = RATES) -> tuple[int, int]:
    """(m, D) of a band: the segments, and those with one-deletion neighbourhoods. (0, 0): only equal sets link.

    rates: the candidates that a subset of one n-gram brings, and the factor for each more. Subsets' sizes are Poisson;
    those of a size below two are left out where a set has something to spare, and aren't counted.
    """
    one, fall = rates

    def bring(size: float) -> float:
        size = max(size, 0.0)
        return one / fall * max(0.0, math.exp(-size * (1 - fall)) - math.exp(-size) * (1 + size * fall))

    low, high = bands(num, den)[band], bands(num, den)[band + 1] - 1
    h = difference(high * den // num, high, num, den)  # of the largest set that probes here
    best = (0.0, 0, 0) if not h else None
    for m in range(max(1, (h + 2) // 2), h + 10) if h else ():
        size = low / m
        d = max(0, h + 1 + math.ceil(1.5 * m * math.exp(-size)) - m)
        if d <= m:
            cost = m + d * size + CANDIDATE_COST * (m * bring(size) + d * size * bring(size - 1))
            best = min(best or (cost, m, d), (cost, m, d))
    return best[1:] if best else (h + 1, h + 1)


def keys(s: np.ndarray, band: int, home: bool, num: int, den: int, rates: tuple[float, float] = RATES) -> np.ndarray:
    """The keys under which a set (of mixed hashes) is indexed and probes, flags in the low bits; for a lower band
    than its own, only those with which it probes."""
    m, d = allocation(band, num, den, rates)
    high = bands(num, den)[band + 1] - 1
    if not m or not home and high * den < len(s) * num:
        return np.empty(0, np.uint64)
    spare = m + d - (difference(len(s), high, num, den) + 1)
    seg = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    sums, seg = np.zeros(m, np.uint64), seg.astype(np.int64)
    np.add.at(sums, seg, s)
    sizes = np.bincount(seg, minlength=m)
    theta = np.zeros(m, np.int64)
    theta[:d] = 1
    order = np.argsort(sizes, kind="stable")
    for j in order[: np.count_nonzero(sizes <= 1)]:
        if theta[j] + 1 <= spare:
            spare -= theta[j] + 1
            theta[j] = -1
    down = np.flatnonzero(theta == 1)[:spare]
    theta[down] = 0
    rest = order[theta[order] == 0][: spare - len(down)]
    theta[rest] = -1
    salt = np.uint64((band + 1) << 32) + np.arange(m, dtype=np.uint64)
    flag = np.where(theta >= 0, PROBE, 0) | (INDEX if home else 0)
    own = (mix(sums * np.uint64(0x9E3779B97F4A7C15) + mix(salt)) & ~np.uint64(3)) | flag.astype(np.uint64)
    out = [own if home else own[theta >= 0]]
    if d:
        at = np.flatnonzero(seg < d)
        at = at if home else at[theta[seg[at]] == 1]
        g = seg[at]
        less = mix((sums[g] - s[at]) * np.uint64(0x9E3779B97F4A7C15) + mix(salt[g])) & ~np.uint64(3)
        out.append(less | (np.where(theta[g] == 1, PROBE, 0) | (INDEX if home else 0)).astype(np.uint64))
    return np.concatenate(out)


def ngrams(text: str, k: int) -> np.ndarray:
    """The sorted set of hashes of a text's k-word n-grams (all words as one, if fewer)."""
    return np.unique(windows(word_hashes(text.encode().lower()), k))


def content(s: np.ndarray, bits: int = 62) -> int:
    """A 62-bit hash of a set, times 4: keys' flags go below it. Fewer bits are for tests."""
    h = mix(np.array([np.add.reduce(mix(s))], np.uint64) + np.uint64(len(s))) << np.uint64(62 - bits)
    return int((h & ~np.uint64(3))[0].view(np.int64))


def check(s: np.ndarray) -> int:
    """A second hash of a set, of 64 bits."""
    return int(mix(np.array([np.add.reduce(mix(s ^ np.uint64(0x6A09E667F3BCC909)))], np.uint64))[0].view(np.int64))


class Names:
    """The name of each set: its content's hash, or, of those that share one by chance, for all but one the second hash."""

    def __init__(self, strays: dict[int, int], bits: int):
        self.strays, self.bits = strays, bits

    def of(self, s: np.ndarray) -> int:
        name = content(s, self.bits)
        return (check(s) & ~3) if self.strays and name in self.strays and check(s) != self.strays[name] else name


def measured_rates(sets: list[np.ndarray], whole: int) -> tuple[float, float]:
    """``rates`` of ``allocation``, from distinct sets (of mixed hashes) sampled among ``whole``.

    Each set is split into segments of several numbers; for subsets of each size, the other sets that have the same
    subset are counted. Sets that look like another's near copy are left out: their pairs have to be found anyway.
    """
    least = np.array([np.sort(mix(s))[:32] if len(s) >= 32 else np.resize(np.sort(mix(s)), 32) for s in sets if len(s)], np.uint64).reshape(-1, 32)
    sets, kept = [s for s in sets if len(s)], []
    for i in range(len(sets)):
        if not kept or not np.any(np.count_nonzero(np.isin(least[kept], least[i]), axis=1) >= 16):
            kept.append(i)
    sets = [sets[i] for i in kept]
    if len(sets) < 2:
        return RATES
    trials, hits = np.zeros(9), np.zeros(9)
    for m in (1 << k for k in range(0, 13, 2)):
        found, sizes = [], []
        for s in sets:
            seg = (((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)).astype(np.int64)
            sums = np.zeros(m, np.uint64)
            np.add.at(sums, seg, s)
            n = np.bincount(seg, minlength=m)
            some = (n > 0) & (n < 9)
            found.append(sums[some] + mix(np.flatnonzero(some).astype(np.uint64)))
            sizes.append(n[some])
        _, at, times = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
        size = np.concatenate(sizes)
        trials += np.bincount(size, minlength=9)
        hits += np.bincount(size, times[at] - 1, 9)
    rate = (hits + 0.01) / (trials + 0.01) * whole / len(sets)
    z = np.flatnonzero((hits > 3) & (np.arange(9) > 0))
    fall = float(np.exp(np.polyfit(z, np.log(rate[z]), 1, w=np.sqrt(hits[z]))[0])) if len(z) > 1 else RATES[1]
    return max(float(rate[1]), 1e-3), min(max(fall, 0.02), 0.9)


MEMBERS = "doc_id long, id long, check long, n long, sketch array<long>, h0 long, h1 long, h2 long, h3 long, sampled array<long>"


def _members(batches: Iterator[pa.RecordBatch], k: int, bits: int, share: float) -> Iterator[pa.RecordBatch]:
    """The content of each document and, where a partition first meets it with a doc_id, its parity sketches; the sets of
    a share of all contents, chosen by their hash."""
    seen: set[int] = set()
    for chunk, texts in text_chunks(batches, "text"):
        ids, checks, sizes, sketches, shorts, sampled = [], [], [], [], [], []
        for doc, text in zip(chunk.column("doc_id").to_pylist(), texts, strict=True):
            s = ngrams(text or "", k)
            sizes.append(len(s))
            ids.append(content(s, bits) if len(s) else None)
            checks.append(check(s) if len(s) else None)
            if doc is None or not len(s) or checks[-1] in seen:
                sketches.append(None), shorts.append([None] * 4), sampled.append(None)
                continue
            if len(seen) < SEEN:
                seen.add(checks[-1])
            sampled.append(s.view(np.int64) if (checks[-1] & ((1 << 32) - 1)) < share * (1 << 32) else None)
            parity = (np.bincount((s & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1).astype(np.uint8)
            sketches.append(np.packbits(parity).view(np.int64))
            shorts.append(np.packbits(np.bitwise_xor.reduce(parity.reshape(-1, SHORT), axis=0)).view(np.int64).tolist())
        long, longs = pa.int64(), pa.list_(pa.int64())
        cols = [chunk.column("doc_id"), pa.array(ids, long), pa.array(checks, long), pa.array(sizes, long), pa.array(sketches, longs)]
        yield pa.RecordBatch.from_arrays([*cols, *(pa.array([h[i] for h in shorts], long) for i in range(4)), pa.array(sampled, longs)], names=["doc_id", "id", "check", "n", "sketch", "h0", "h1", "h2", "h3", "sampled"])


def _keys(batches: Iterator[pa.RecordBatch], k: int, num: int, den: int, names: Names, rates: tuple[float, float]) -> Iterator[pa.RecordBatch]:
    """(key, id with the key's flags) of each content that a partition meets first."""
    seen: set[int] = set()
    for _, texts in text_chunks(batches, "text"):
        found, ids = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
        for text in texts:
            s = ngrams(text, k)
            if not len(s) or (c := names.of(s)) in seen:
                continue
            if len(seen) < SEEN:
                seen.add(c)
            t, b = mix(s), bisect_right(bands(num, den), len(s)) - 1
            for x in (keys(t, b, True, num, den, rates), keys(t, b - 1, False, num, den, rates) if b else ()):
                if len(x):
                    found.append(x & ~np.uint64(3))
                    ids.append((x & np.uint64(3)) | np.uint64(c & 0xFFFFFFFFFFFFFFFF))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (found, ids)], names=["key", "id"])


def _sets(batches: Iterator[pa.RecordBatch], k: int, names: Names) -> Iterator[pa.RecordBatch]:
    for _, texts in text_chunks(batches, "text"):
        sets = [ngrams(t, k) for t in texts]
        yield pa.RecordBatch.from_arrays([pa.array([names.of(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["id", "set"])


def _verified(pairs: DataFrame, docs: DataFrame, members: DataFrame, k: int, num: int, den: int, names: Names) -> DataFrame:
    """The links among ``pairs`` (``a, b`` contents)."""
    sides = members.filter("sketch is not null").groupBy("id").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min("doc_id").alias("doc"))
    side = lambda x: sides.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"), F.col("doc").alias(f"d{x}"))
    p = pairs.join(side("a"), "a").join(side("b"), "b")
    p = p.filter(f"least(na, nb) * {den} >= greatest(na, nb) * {num}")
    distance = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    p = written(p.filter(distance * (den + num) <= (F.col("na") + F.col("nb")) * (den - num)).select("a", "b", "da", "db", "na", "nb"), "candidates")
    ids = written(p.select(F.col("da").alias("doc")).union(p.select("db")).distinct(), "candidate-docs")
    few = ids.count() <= BROADCAST_IDS
    d = docs.join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("doc"), "left_semi")
    sets = d.select("text").mapInArrow(partial(_sets, k=k, names=names), "id long, set array<long>")
    sets = written(sets, "candidate-sets").dropDuplicates(["id"])
    p = p.join(sets.select(F.col("id").alias("a"), F.col("set").alias("xa")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("xb")), "b")
    both = F.size(F.array_intersect("xa", "xb"))
    return written(p.filter(both * den >= (F.col("na") + F.col("nb") - both) * num).select("a", "b"), "verified")


def ngram_components(docs: DataFrame, *, k: int = 5, num: int = 4, den: int = 5, bits: int = 62) -> DataFrame:
    r"""``doc_id, n_shingles, component_id``: a row a row of ``docs`` (``doc_id`` long, ``text``).

    Words are runs of ``[^\x20\x09-\x0D]`` with A-Z in lower case; a set holds the k-word n-grams, or all words as one
    if there are fewer. Two documents link when their sets' Jaccard similarity is num/den or more, in whole numbers.
    component_id is the smallest doc_id reachable by links. Texts without words, and null texts, have empty sets and
    link with nothing; so do rows without a doc_id, whose component is null. Repeated rows each give a row; an empty
    table gives an empty table; other columns don't reach the result. Texts of any length are read whole; the set of
    one lies in one task. ``bits`` of the sets' names are for tests.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    whole = docs.count()
    made = written(docs.mapInArrow(partial(_members, k=k, bits=bits, share=RATE_SETS / max(whole, 1)), MEMBERS), "ngram-members")
    twins = made.filter("id is not null").groupBy("id").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).filter("lo <> hi")
    strays = {r.id: r.lo for r in twins.select("id", "lo").take(MAX_STRAYS + 1)}  # in all likelihood none
    if len(strays) > MAX_STRAYS:
        raise ValueError("too many sets share a name")
    names = Names(strays, bits)
    if strays:
        odd = docs.sparkSession.createDataFrame(list(strays.items()), "id long, lo long")
        made = made.join(F.broadcast(odd), "id", "left").withColumn("id", F.when(F.col("check") != F.col("lo"), F.col("check").bitwiseAND(~3)).otherwise(F.col("id"))).drop("lo")
    members = made.filter("id is not null and doc_id is not null")
    sample = members.filter("sampled is not null").dropDuplicates(["id"]).select("sampled").toArrow()  # RATE_SETS, about
    rates = measured_rates([mix(x.values.to_numpy().view(np.uint64)) for x in sample.column("sampled")], whole)
    rows = docs.filter("doc_id is not null and text is not null").select("text").mapInArrow(partial(_keys, k=k, num=num, den=den, names=names, rates=rates), "key long, id long")
    bare, flag = F.col("id").bitwiseAND(~3), F.col("id").bitwiseAND(3)
    w = Window.partitionBy("key")
    rows = rows.select("key", "id", F.min(bare).over(w).alias("lo"), F.max(bare).over(w).alias("hi"), F.max(F.col("id").bitwiseAND(PROBE)).over(w).alias("p"), F.min(F.when(F.col("id").bitwiseAND(INDEX) > 0, bare)).over(w).alias("hub"))
    rows = rows.filter("lo <> hi and p > 0 and hub is not null").select("key", bare.alias("id"), flag.alias("flag"), "hub")
    shared = written(rows.groupBy("key", "id", "hub").agg(F.bit_or("flag").alias("flag")), "shared-keys")
    shape = members.filter("sketch is not null").groupBy("id").agg(*[F.first(c).alias(c) for c in ("n", "h0", "h1", "h2", "h3")])
    shared = written(shared.drop("hub").join(shape, "id"), "shared-shapes")
    apart = lambda x, y: " + ".join(f"bit_count({x}h{i} ^ {y}h{i})" for i in range(4))
    could = lambda x, y: f"{x}root <> {y}root and least({x}n, {y}n) * {den} >= greatest({x}n, {y}n) * {num} and ({apart(x, y)}) * {den + num} <= ({x}n + {y}n) * {den - num}"

    def unmerged(roots: DataFrame | None) -> DataFrame:
        """Rows of keys that more than one group shares."""
        if roots is None:
            return shared.withColumn("root", F.col("id"))
        rows = shared.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
        return rows.select("*", F.min("root").over(w).alias("lo"), F.max("root").over(w).alias("hi")).filter("lo <> hi").drop("lo", "hi")

    def nearest(rows: DataFrame) -> DataFrame:
        """For each set the closest, by sketch, of those that stand for its keys: each key's first and last indexed
        set, and the set before it."""
        whole = F.struct("id", "root", "n", "h0", "h1", "h2", "h3")
        indexed = F.when(F.col("flag").bitwiseAND(INDEX) > 0, whole)
        rows = rows.select("*", F.min(indexed).over(w).alias("first"), F.max(indexed).over(w).alias("last"), F.lag(whole).over(w.orderBy("id")).alias("prior"))
        stands = ("first", "last", "prior")
        rows = rows.select("id", *[F.expr(f"case when {could('', c + '.')} then struct({apart('', c + '.')} as d, {c}.id as b) end").alias(c) for c in stands])
        best = rows.groupBy("id").agg(*[F.min(c).alias(c) for c in stands])
        return best.select(F.col("id").alias("a"), F.explode(F.array(*[f"{c}.b" for c in stands])).alias("b")).filter("b is not null").distinct()

    links, roots = None, None
    for _ in range(2):
        new = _verified(nearest(unmerged(roots)), docs, members, k, num, den, names)
        links = new if links is None else links.union(new)
        roots = connected_components(links)
    left = written(unmerged(roots), "unmerged")
    x, y = left.filter(F.col("flag").bitwiseAND(PROBE) > 0).alias("x"), left.filter(F.col("flag").bitwiseAND(INDEX) > 0).alias("y")
    pairs = x.join(y, F.expr(f"x.key = y.key and {could('x.', 'y.')}")).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
    roots = connected_components(links.union(_verified(pairs, docs, members, k, num, den, names)))
    least = members.groupBy("id").agg(F.min("doc_id").alias("least")).join(roots, "id", "left")
    whole = least.filter("root is not null").groupBy("root").agg(F.min("least").alias("whole"))
    least = least.join(whole, "root", "left").select("id", F.coalesce("whole", "least").alias("least"))
    out = made.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("id")).alias("id")).join(least, "id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """``docs`` without the documents whose component has a smaller doc_id (see ``ngram_components``).

    Rows without a doc_id, and those without words, stay; rows that repeat the doc_id that stays all stay, and those of one
    that goes all go. Columns pass through whatever their names, but for ``__gone``; an empty table gives an empty table.
    """
    gone = written(ngram_components(docs, **how).filter("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct(), "near-copies")
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, F.col("doc_id") == F.col("__gone"), "left_anti")


def op1_ngram_join(spark, sf_dir: str) -> DataFrame:
    """All documents by 3-word shingles at 0.9."""
    return ngram_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, num=90, den=100)


OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words
), each AS (
  SELECT doc_id, unnest(s) AS g FROM sets
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM each x JOIN each y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b WHERE 100 * n >= 90 * (len(p.s) + len(q.s) - n)
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.other)::BIGINT AS component_id FROM sets s JOIN reach r USING (doc_id) GROUP BY ALL
"""
