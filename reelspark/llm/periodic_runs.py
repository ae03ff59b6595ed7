r"""Periodic runs of words by Gusfield and Stoye's method for tandem repeats.

A square is a stretch of words that is some words twice over. Of each document:

1. Suffixes are sorted by doubling; the names of all stretches of 2**k words answer how far two places agree, forwards
   and backwards. A document whose suffixes differ within the fewest words that a long enough run repeats has none.
2. Its Lempel-Ziv blocks give a leftmost-covering set of squares: the leftmost occurrence of every square lies across
   a block's boundary, within the block of its middle and the one after (Main and Lorentz's extensions).
3. Those that are the leftmost of their words mark the suffix tree, as an interval of the suffix array and a depth.
   From each mark a walk follows suffix links: the square without its first word, and with that word again at its end,
   is marked if it occurs. Where the text itself goes on like that, whole stretches of the walk are taken at once.
   That completes the vocabulary. Squares of repeated roots are left out; their roots' squares cover the same runs.
4. All occurrences of the vocabulary (there are O(n log n) of squares with primitive roots), sorted by period and
   place, merge into runs: places in a row are one run.

All steps are exact. Words of different documents are different codes, so many documents are worked on at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import map_rows, text_chunks
from ._text import mix

#: Words that are worked on at a time (a longer document comes alone), and pairs of places that are compared at a time.
WORDS, PAIRS = 1 << 18, 1 << 19

RUNS = "__n_words long, __runs array<struct<start:bigint,length:bigint,period:bigint>>, __collapsed string"


def _ranges(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the range, value) for all values of the ranges start, start + 1, ... of so many values each."""
    of = np.repeat(np.arange(len(starts)), counts)
    return of, starts[of] + np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)


class Suffixes:
    """The sorted suffixes of an array of codes."""

    def __init__(self, codes: np.ndarray):
        self.n = n = len(codes)
        self.codes = np.append(codes, -1)
        #: names[k][i]: equal for equal stretches of 2**k codes; a stretch that the end cuts short equals no other.
        self.names: list[np.ndarray] = []
        _, rank, counts = np.unique(codes, return_inverse=True, return_counts=True)
        rank = (np.cumsum(counts) - counts)[rank]  # the place of the first of its class among the sorted suffixes
        open_ = np.flatnonzero(counts[np.searchsorted(np.cumsum(counts), rank, side="right")] > 1)
        width = 1
        while True:
            self.names.append(np.append(rank, -1))
            if not len(open_):
                break
            ahead = np.where(open_ + width < n, rank[np.minimum(open_ + width, n - 1)], -1) + 1
            key = rank[open_] * (n + 1) + ahead
            order = np.argsort(key, kind="stable")
            open_, key = open_[order], key[order]
            old = rank[open_]
            at = np.arange(len(open_))
            first = np.maximum.accumulate(np.where(np.diff(key, prepend=-1) != 0, at, 0))  # of the new class
            base = np.maximum.accumulate(np.where(np.diff(old, prepend=-1) != 0, at, 0))  # of the old one
            rank = rank.copy()
            rank[open_] = old + first - base
            alone = (first == at) & (np.append(first[1:], len(at)) == at + 1)
            alone &= np.append(first[1:] != first[:-1], True)
            open_ = open_[~alone]
            width *= 2
        self.rank = rank
        self.order = np.empty(n, np.int64)
        self.order[rank] = np.arange(n)
        self.common = np.zeros(n, np.int64)  # with the suffix before it
        self.common[1:] = self.ahead(self.order[:-1], self.order[1:])
        #: least[k][x]: the least of ``common`` over x - 2**k + 1 ... x.
        self.least = [self.common]
        while len(last := self.least[-1]) and last.max() > 0 and 1 << len(self.least) < n:
            w = 1 << (len(self.least) - 1)
            new = np.full(n, -1)
            new[w:] = np.minimum(last[w:], last[:-w])
            self.least.append(new)

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many codes from i and from j on agree; i and j differ and may be n."""
        start = i
        i, j = i.copy(), j.copy()
        for k in range(len(self.names) - 1, -1, -1):
            step = (self.names[k][i] == self.names[k][j]).astype(np.int64) << k
            i += step
            j += step
        return i - start

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many codes up to i and up to j, both included, agree; i and j differ and may be -1."""
        start = i
        i, j = i.copy(), j.copy()
        for k in range(len(self.names) - 1, -1, -1):
            w = 1 << k
            a, b = np.maximum(i - w + 1, -1), np.maximum(j - w + 1, -1)
            step = ((self.names[k][a] == self.names[k][b]) & (a >= 0) & (b >= 0)).astype(np.int64) << k
            i -= step
            j -= step
        return start - i

    def interval(self, at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last sorted suffix that share so many codes with the suffix of this place."""
        lo, hi = at.copy(), at.copy()
        for k in range(len(self.least) - 1, -1, -1):
            w, t = 1 << k, self.least[k]
            lo -= (t[lo] >= depth).astype(np.int64) << k
            up = hi + w
            hi += ((up < self.n) & (t[np.minimum(up, self.n - 1)] >= depth)).astype(np.int64) << k
        return lo, hi

    def seen_before(self) -> np.ndarray:
        """For each place, how many codes from there on occur from an earlier place on."""
        order, common = self.order.tolist(), self.common.tolist()
        found = [0] * self.n
        places, lefts = [], []  # places that grow, and what the suffix of each shares with the one below it
        for place, shared in zip(order, common, strict=True):
            while places and places[-1] > place:
                last = places.pop()
                if shared > found[last]:
                    found[last] = shared
                left = lefts.pop()
                if left < shared:
                    shared = left
            found[place] = shared if places else 0
            places.append(place)
            lefts.append(shared)
        return np.array(found, np.int64)


def _blocks(seen: np.ndarray) -> np.ndarray:
    """Starts of the Lempel-Ziv blocks, and the end."""
    steps, at, out = np.maximum(seen, 1).tolist(), 0, []
    while at < len(steps):
        out.append(at)
        at += steps[at]
    return np.array([*out, at], np.int64)


def _covering(s: Suffixes, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of squares, such that the leftmost occurrence of every square is one of them, or lies right of
    one with squares of its period at all places between."""
    starts, periods = [], []
    begin, end, after = cuts[:-1], cuts[1:], np.append(cuts[2:], cuts[-1])

    def boundaries(at: np.ndarray, longest: np.ndarray, right: bool) -> None:
        total = np.cumsum(longest)
        for a in range(0, int(total[-1]) if len(total) else 0, PAIRS):  # some pairs (boundary, period) at a time
            pair = np.arange(a, min(a + PAIRS, int(total[-1])))
            of = np.searchsorted(total, pair, side="right")
            h, k = at[of], pair - (total[of] - longest[of]) + 1
            q = h - k if right else h + k
            fine = (q >= 0) & (q < s.n)
            h, k, q = h[fine], k[fine], q[fine]
            fine = s.codes[h] == s.codes[q] if right else s.codes[h - 1] == s.codes[q - 1]
            h, k, q = h[fine], k[fine], q[fine]
            fwd, back = s.ahead(h, q), s.behind(h - 1, q - 1)
            fine = fwd + back >= k
            first = np.maximum(np.minimum(h, q) - back, q - k + 1 if right else h - k)
            starts.append(first[fine])
            periods.append(k[fine])

    inner = end < s.n
    boundaries(end[inner], (end - begin)[inner], True)  # the boundary lies in the second half
    boundaries(begin[1:], (after - begin)[1:], False)  # in the first half, or in the middle
    return (np.concatenate(starts), np.concatenate(periods)) if starts else (np.empty(0, np.int64),) * 2


def _primitive(s: Suffixes, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Isn't the square's root a repetition itself?"""
    fine, rest, r = np.ones(len(start), bool), period.copy(), 2
    most = int(period.max()) if len(period) else 0
    while r <= most:
        at = np.flatnonzero(rest % r == 0)
        if len(at):
            part = period[at] // r
            fine[at] &= s.ahead(start[at], start[at] + part) < period[at] - part
            while len(at):
                rest[at] //= r
                at = at[rest[at] % r == 0]
            most = int(rest.max())
        r += 1 if r == 2 else 2
        if r * r > most > 1:  # what is left of each is a prime
            left = np.unique(rest[rest > 1])
            r = int(left[left >= r].min()) if np.any(left >= r) else most + 1
    return fine


def _vocabulary(s: Suffixes, start: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first sorted suffix, period) of every square that the walks from these reach."""
    known = np.empty(0, np.int64)
    scale = s.n + 1
    while len(start):
        last = start + s.ahead(start, start + period) - period  # the text itself goes on up to there
        key = period * scale + last
        order = np.lexsort((start, key))
        order = order[np.diff(key[order], prepend=-1) != 0]  # of walks along one run, the longest
        start, period, last = start[order], period[order], last[order]
        of, place = _ranges(start, last - start + 1)
        lo, _ = s.interval(s.rank[place], 2 * period[of])
        marks = lo * scale + period[of]
        ends = marks[np.cumsum(last - start + 1) - 1]
        new = np.setdiff1d(marks, known)
        _, first = np.unique(ends, return_index=True)
        go = first[np.isin(ends[first], new, assume_unique=True)]
        known = np.union1d(known, new)
        z, k = last[go], period[go]
        depth, word = 2 * k - 1, s.codes[z]
        lo, hi = s.interval(s.rank[z + 1], depth)  # the suffix link
        high = hi + 1
        while np.any(lo < high):  # the first of them that goes on with a word not below the square's first
            mid = (lo + high) // 2
            low = (lo < high) & (s.codes[np.minimum(s.order[np.minimum(mid, s.n - 1)] + depth, s.n)] < word)
            high = np.where((lo < high) & ~low, mid, high)
            lo = np.where(low, mid + 1, lo)
        there = lo <= hi
        at = s.order[np.minimum(lo, s.n - 1)]
        there &= s.codes[at + np.where(there, depth, 0)] == word
        start, period = at[there], k[there]
    return known // scale, known % scale


def find_runs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of every run of two periods or more, by start and period."""
    s = Suffixes(codes)
    seen = s.seen_before()
    start, period = _covering(s, _blocks(seen))
    fine = seen[start] < 2 * period  # the leftmost of its words
    start, period = start[fine], period[fine]
    fine = _primitive(s, start, period)
    at, period = _vocabulary(s, start[fine], period[fine])
    lo, hi = s.interval(at, 2 * period)
    of, suffix = _ranges(lo, hi - lo + 1)
    place, period = s.order[suffix], period[of]
    order = np.lexsort((place, period))
    place, period = place[order], period[order]
    new = np.flatnonzero((np.diff(place, prepend=-2) != 1) | (np.diff(period, prepend=0) != 0))
    last = np.append(new, len(place))[1:] - 1
    start, period = place[new], period[new]
    length = place[last] - start + 2 * period
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def repeated(least: int, times: int) -> int:
    """How many words at least a run repeats at the distance of its period."""
    return min(max(least, times * q) - q for q in range(1, max(least, 1) + 1))


def _suspects(codes: np.ndarray, counts: np.ndarray, width: int) -> np.ndarray:
    """Documents (of so many codes each) in which some stretch of ``width`` codes may occur twice; none that does is missing."""
    doc = np.repeat(np.arange(len(counts)), counts)
    h = mix(codes.astype(np.uint64) + np.uint64(1)) + mix(doc.astype(np.uint64))
    size = 1
    while size < width and len(h) > size:
        more = min(size, width - size)  # stretches of size + more codes
        h = mix(h[:-more] * np.uint64(0x9E3779B97F4A7C15) + h[more:])
        size += more
    if size < width:
        return np.empty(0, np.int64)
    at = np.flatnonzero(doc[: len(h)] == doc[width - 1 : width - 1 + len(h)])
    order = np.argsort(h[at], kind="stable")
    twice = h[at][order][1:] == h[at][order][:-1]
    return np.unique(doc[at[order[1:][twice]]])


def runs_of(docs: list[list[bytes]], least: int, times: int) -> dict[int, list[tuple[int, int, int]]]:
    """By the number of the document: its runs of ``least`` words and ``times`` periods or more."""
    counts = np.array([len(d) for d in docs], np.int64)
    ids: dict[bytes, int] = {}
    codes = np.array([ids.setdefault(w, len(ids)) for d in docs for w in d], np.int64)
    first = np.cumsum(counts) - counts
    todo = _suspects(codes, counts, repeated(least, times)).tolist()
    out: dict[int, list[tuple[int, int, int]]] = {}
    while todo:
        some, total = [], 0
        while todo and (not some or total + counts[todo[0]] <= WORDS):
            total += counts[todo[0]]
            some.append(todo.pop(0))
        mine = np.concatenate([codes[first[d] : first[d] + counts[d]] + i * len(ids) for i, d in enumerate(some)])
        start, length, period = find_runs(mine)
        fine = length >= np.maximum(least, times * period)
        starts = np.cumsum(counts[some]) - counts[some]
        of = np.searchsorted(starts, start[fine], side="right") - 1
        for d, a, n, q in zip(of.tolist(), (start[fine] - starts[of]).tolist(), length[fine].tolist(), period[fine].tolist(), strict=True):
            out.setdefault(some[d], []).append((a, n, q))
    return out


def _map(batches: Iterator[pa.RecordBatch], least: int, times: int) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for chunk, texts in text_chunks(batches, "text"):
        docs = [(t or "").encode().split() for t in texts]  # bytes are split at \x20 and \x09-\x0D only
        runs = runs_of(docs, least, times)
        collapsed = []
        for i, words in enumerate(docs):
            if i in runs:
                keep = np.ones(len(words), bool)
                for a, n, q in runs[i]:
                    keep[a + q : a + n] = False
                words = [words[j] for j in np.flatnonzero(keep)]
            collapsed.append(b" ".join(words).decode())
        more = [
            pa.array([len(d) for d in docs], pa.int64()), pa.array([[{"start": a, "length": n, "period": q} for a, n, q in runs.get(i, ())] for i in range(len(docs))], kind),
            pa.array(collapsed, pa.string()),
        ]
        yield pa.RecordBatch.from_arrays([*chunk.columns, *more], names=[*chunk.schema.names, "__n_words", "__runs", "__collapsed"])


def periodic_runs(docs: DataFrame, *, least: int = 24, times: int = 3) -> DataFrame:
    r"""``docs`` with the runs of its column ``text`` (a string): ``__n_words``, ``__runs`` (by start, then period) and
    ``__collapsed``, the text without what a run repeats, its words joined by one space.

    Words are ``[^\x20\x09-\x0D]+``. A run is a stretch of ``least`` words and ``times`` (2 or more) periods at least
    that no neighbouring word extends; its period is the smallest one. Of a run its first period is kept, unless
    another run drops it. Null and empty texts have no words, no runs and an empty text. Rows are independent: equal
    rows, ids, nulls in other columns and empty tables need no care, and nothing is shuffled. Texts of any length are
    worked on whole; one of n words takes about 16 n log2(n) bytes. Other columns pass through; names that start with two
    underscores are reserved.
    """
    if times < 2:
        raise ValueError("times must be 2 or more")
    return map_rows(docs, partial(_map, least=least, times=times), RUNS)


def planted(doc_id: Column, text: Column) -> Column:
    """The text, of every tenth document with a tail that repeats (the contract of the query)."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.size(words)
    a = F.pmod(g, n).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
    tail = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    made = F.array_join(F.slice(F.concat(F.slice(words, F.lit(1), a), tail), F.lit(1), n), " ")
    return F.when((F.pmod(h, F.lit(10)) == 0) & (n > 0), made).otherwise(text)


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """All documents. Where doc_id is null, no tail is made to repeat."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    d = periodic_runs(docs.withColumn("text", planted(F.col("doc_id"), F.col("text"))).select("doc_id", "text")).drop("text")
    fewer = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    best = F.aggregate("__runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), lambda b, r: F.when(fewer(b, r), r).otherwise(b))
    lines = F.array_join(F.transform("__runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    d = d.select("doc_id", F.size("__runs").cast("long").alias("n_runs"), best.alias("b"), sha(lines).alias("runs_sha256"), sha(F.col("__collapsed")).alias("collapsed_sha256"))
    return d.select("doc_id", "n_runs", "b.start", "b.length", "b.period", F.expr("b.length * 1000 div b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
