r"""Exact, cached use of a ``tokenizers`` vocabulary.

Both supported kinds of vocabulary split a text into pre-tokens before any merge is made, and no pre-token crosses the
cuts made here, so a text's ids are the ids of its pieces, one after another. Natural text repeats words all the time:
a worker cuts and hashes the pieces of many texts at once, looks them up in a table of the ids that the library gave
for pieces it met before, and gathers them. A piece is known by 96 bits of hash. New pieces are encoded by the library;
a word of letters alone is one pre-token and goes to the library's model at once. What might be split in another way
(rare white space, special tokens spelt out in a text) is encoded whole, as the library does by default.
"""

from __future__ import annotations

import os
import re
import struct

import numpy as np

from ._common import kept
from ._text import mix

#: Characters on which Python, Rust and Unicode may disagree about white space: such texts are encoded whole.
ODD = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff]")
ODD_ASCII = "\x1c\x1d\x1e\x1f"
#: Pieces that a worker remembers before it starts anew, and the longest (in bytes).
REMEMBERED, LONGEST = 2_000_000, 64
BATCH = 8192
#: Texts that are cut together have about so many characters; longer ones are encoded in parts of so many.
TOGETHER, PART = 1 << 18, 1 << 22
#: A place where a pre-token begins, whatever surrounds it.
SURE = re.compile(r"(?<=[^\s]) (?=[^\s])")
#: Between texts; never a byte of UTF-8.
END = 255
_codes = np.arange(256)
WHITE = np.isin(_codes, [9, 10, 11, 12, 13, 32, END])
ALNUM = np.isin(_codes, [*range(48, 58), *range(65, 91), *range(97, 123)])
STOP = np.isin(_codes, [ord("."), ord(",")])


class Polynomial:
    """Hashes of spans of bytes: a polynomial from prefix sums, shifted to position 0 by the inverse of its odd base."""

    def __init__(self, base: int, dtype):
        self.dtype, self.base, self.inverse = dtype, base, pow(base, -1, 1 << 8 * np.dtype(dtype).itemsize)
        self.weights = [np.ones(0, dtype)] * 2

    def spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self.weights[0]) < len(data):
            for i, b in enumerate((self.base, self.inverse)):
                w = np.full(max(2 * len(data), 1 << 16), b, self.dtype)
                w[0] = 1
                self.weights[i] = np.multiply.accumulate(w, dtype=self.dtype)
        sums = np.zeros(len(data) + 1, self.dtype)
        np.cumsum((data.astype(self.dtype) + self.dtype(1)) * self.weights[0][: len(data)], out=sums[1:])
        return (sums[ends] - sums[starts]) * self.weights[1][starts] + (ends - starts).astype(self.dtype) * self.dtype(0x9E3779B1)


class Ids:
    """Ids by hash: an open-addressing table of entries, each a run of one long array of ids."""

    def __init__(self, dtype: np.dtype, most: int):
        self.most, self.dtype = most, dtype
        self.bits = (2 * most).bit_length()
        self.clear()

    def clear(self) -> None:
        self.keys, self.entry = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        self.count = self.used = 0
        self.check, self.start, self.size = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.ids = np.zeros(1 << 18, self.dtype)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key (never 0); -1 without one."""
        at, out = self._slots(keys), np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        while len(open_):
            there = self.keys[at]
            hit = there == keys
            out[open_[hit]] = self.entry[at[hit]]
            on = ~hit & (there != 0)
            open_, keys, at = open_[on], keys[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out

    def append(self, checks: np.ndarray, found: list[bytes]) -> np.ndarray:
        """New entries, without keys."""
        data = np.frombuffer(b"".join(found), self.dtype)
        sizes = np.array([len(b) for b in found], np.int64) // self.dtype.itemsize
        n, m = self.count + len(found), self.used + len(data)
        for name, least in (("check", n), ("start", n), ("size", n), ("ids", m)):
            if len(old := getattr(self, name)) < least:
                new = np.zeros(max(least, 2 * len(old)), old.dtype)
                new[: len(old)] = old
                setattr(self, name, new)
        new = np.arange(self.count, n)
        self.check[new], self.size[new], self.start[new] = checks, sizes, self.used + np.cumsum(sizes) - sizes
        self.ids[self.used : m] = data
        self.count, self.used = n, m
        return new

    def put(self, keys: np.ndarray, entries: np.ndarray) -> None:
        """Keys that differ and aren't in the table."""
        at = self._slots(keys)
        while len(keys):
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[free]
            mine = free & (self.keys[at] == keys)
            self.entry[at[mine]] = entries[mine]
            keys, entries, at = keys[~mine], entries[~mine], (at[~mine] + 1) & ((1 << self.bits) - 1)

    def gather(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the entries, and the number of ids before each entry and after the last."""
        size = self.size[entries].astype(np.int64)
        before = np.concatenate(([0], np.cumsum(size)))
        return self.ids[np.repeat(self.start[entries] - before[:-1], size) + np.arange(before[-1])], before


def _byte_characters() -> dict[int, str]:
    """The characters by which byte-level vocabularies write bytes: printable ones of Latin-1 stand for themselves, the
    others for what follows 255."""
    own = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b}
    return {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in own)}


class Encoder:
    """Ids of whole texts, as little-endian unsigned integers of ``dtype``; ``end_id`` is appended to each text."""

    def __init__(self, path: str, end_id: int, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tokenize = self.tok.model.tokenize
        self.dtype = np.dtype("<u2" if max(self.tok.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4")
        self.packs = [struct.Struct(f"<{n}{'H' if self.dtype.itemsize == 2 else 'I'}").pack for n in range(LONGEST)]
        self.end = np.array([end_id], self.dtype).tobytes()
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.normalizer = self.tok.normalizer
        self.drops_space = self.normalizer is not None
        self.table = _byte_characters()
        self.known = Ids(self.dtype, remembered)
        self.key, self.check = Polynomial(0x5851F42D4C957F2D, np.uint64), Polynomial(0x2C1B3C6D, np.uint32)

    def packed(self, ids: list[int]) -> bytes:
        return self.packs[len(ids)](*ids) if len(ids) < len(self.packs) else np.array(ids, self.dtype).tobytes()

    def direct(self, texts: list[str]) -> list[bytes]:
        """The library's own result for each text."""
        out = []
        for i in range(0, len(texts), BATCH):
            out += [self.packed(e.ids) for e in self.tok.encode_batch_fast(texts[i : i + BATCH], add_special_tokens=False)]
        return out

    def _word(self, piece: str) -> str | None:
        """A piece as the model takes it, if it is one pre-token of letters, after a space or not."""
        before, word = "", piece
        if self.drops_space:
            word = piece.lower() if piece.isascii() else self.normalizer.normalize_str(piece)
        elif piece[0] == " ":
            before, word = self.table[32], piece[1:]
        if not word.isalpha():
            return None
        return before + (word if word.isascii() else word.encode().decode("latin-1").translate(self.table))

    def pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece."""
        words = list(map(self._word, pieces))
        rest = iter(self.direct([p for p, w in zip(pieces, words, strict=True) if w is None]))
        return [next(rest) if w is None else self.packed([t.id for t in self.tokenize(w)]) for w in words]

    def _cuts(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r"""Starts and ends of the pieces of texts that END follows. A piece is a run without white space; a full stop
        or comma at its end that follows an ASCII letter or digit is a piece of its own. Where white space counts, a
        run of it gives its last character away: a space to the piece that follows, others to a piece of their own."""
        white = WHITE[data]
        before = np.concatenate(([True], white[:-1]))
        after = np.concatenate((white[1:], [True]))
        stop = STOP[data] & after
        stop[1:] &= ALNUM[data[:-1]]
        if self.drops_space:
            inside = ~white
            starts = inside & (before | stop)
        else:
            inside = data != END
            previous = np.concatenate(([END], data[:-1]))
            starts = np.where(white, ~before | (previous == END) | ~after, before & (previous != 32)) & inside | stop
        more = np.append(starts[1:] | ~inside[1:], True)
        return np.flatnonzero(starts), np.flatnonzero(inside & more) + 1

    def _together(self, texts: list[str]) -> list[bytes]:
        raw = b"".join([t.encode() + b"\xff" for t in texts])
        data = np.frombuffer(raw, np.uint8)
        starts, ends = self._cuts(data)
        known = self.known
        if known.count + len(starts) > known.most and known.count:
            known.clear()
        keys, checks = mix(self.key.spans(data, starts, ends)) | np.uint64(1), self.check.spans(data, starts, ends)
        entries = known.find(keys)
        long = ends - starts > LONGEST
        new = np.flatnonzero((entries < 0) & ~long)
        own, first, at = np.unique(keys[new], return_index=True, return_inverse=True)
        cut = lambda where: self.pieces([raw[s:e].decode() for s, e in zip(starts[where].tolist(), ends[where].tolist(), strict=True)])
        if len(new):
            made = known.append(checks[new[first]], cut(new[first]))
            if known.count <= known.most:
                known.put(own, made)
            entries[new] = made[at]
        count, used = known.count, known.used
        if long.any():
            where = np.flatnonzero(long)
            entries[where] = known.append(checks[where], cut(where))
        ids, before = known.gather(entries)
        known.count, known.used = count, used
        wrong = known.check[entries] != checks
        places = np.flatnonzero(data == END)
        last = np.searchsorted(starts, places)
        bounds = before[last]
        out = [ids[a:b].tobytes() for a, b in zip([0, *bounds[:-1].tolist()], bounds.tolist(), strict=True)]
        for i in np.unique(np.searchsorted(last, np.flatnonzero(wrong), "right")).tolist():  # two pieces have one key
            out[i] = self.direct([texts[i]])[0]
        return out

    def _whole(self, text: str) -> bool:
        """Whether only the library itself may cut the text."""
        odd = any(c in text for c in ODD_ASCII) if text.isascii() else ODD.search(text) is not None
        return odd or any(s in text for s in self.special)

    def _parts(self, text: str) -> list[str]:
        """A very long text in parts of bounded size, cut where a pre-token begins."""
        out, start = [], 0
        while len(text) - start > PART and (m := SURE.search(text, start + PART)):
            out.append(text[start : m.start()])
            start = m.start()
        return [*out, text[start:]]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """For each text its ids and the end id, as bytes. Null counts as empty."""
        out = [b""] * len(texts)
        groups, size = [[]], 0
        for i, t in enumerate(texts):
            if not t:
                continue
            if self._whole(t):
                out[i] = self.direct([t])[0]
            elif len(t) > PART:
                out[i] = b"".join(self._together([p])[0] for p in self._parts(t))
            else:
                if size > TOGETHER:
                    groups, size = [*groups, []], 0
                groups[-1].append(i)
                size += len(t)
        for group in filter(None, groups):
            for i, ids in zip(group, self._together([texts[i] for i in group]), strict=True):
                out[i] = ids
        return [ids + self.end for ids in out]


def encoder(path: str, end_id: int) -> Encoder:
    """One encoder a Python worker, for all tasks that tokenize; workers are reused from task to task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return kept(("encoder", path, end_id), lambda: Encoder(path, end_id))
