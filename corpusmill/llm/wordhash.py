"""Words of Arrow text columns as 64-bit hashes, by numpy over the UTF-8 bytes: no Python object for a word.

A word is a run of ASCII letters, digits and bytes of other scripts; punctuation marks of U+2000-U+2FFF and no-break spaces separate, and each character from
U+3000 on is a word of its own, for scripts without spaces. A word's hash is a polynomial over its bytes (prefix sums make it a difference of two
entries), mixed. Case is folded before, by the caller's lower().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """base**j and its inverse's powers modulo 2**64, as far as asked for."""

    def __init__(self):
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, CHUNK + 1)
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, BASE, np.uint64)], dtype=np.uint64)
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, pow(BASE, -1, 1 << 64), np.uint64)], dtype=np.uint64)
        return self.up, self.down


def byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


def word_bytes() -> np.ndarray:
    ok = np.zeros(256, bool)
    for c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_":
        ok[c] = True
    ok[128:] = True
    return ok


class Words:
    """The words of one chunk: doc (row in the batch), hash, and the places of their bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int, powers: Powers, values: np.ndarray, ok: np.ndarray):
        self.data = data
        is_word = ok[data]
        e2 = np.flatnonzero(data == 0xE2)
        for d in (0, 1, 2):
            is_word[np.minimum(e2 + d, max(0, len(data) - 1))] = False
        c2 = np.flatnonzero(data[:-1] == 0xC2)
        c2 = c2[data[c2 + 1] == 0xA0]
        is_word[c2] = is_word[c2 + 1] = False
        begins = is_word & (data >= 0xE3)
        begins &= (data & 0xC0) == 0xC0
        after = np.zeros(len(data) + 1, bool)
        after[offsets] = True
        wide = begins.copy()  # a wide character also ends where it ends
        ends_wide = np.flatnonzero(wide)
        if len(ends_wide):
            size = np.where(data[ends_wide] >= 0xF0, 4, 3)
            after[np.minimum(ends_wide + size, len(data))] = True
        start = is_word.copy()
        start[1:] &= ~is_word[:-1] | begins[1:] | after[1:-1]
        stop = is_word.copy()
        stop[:-1] &= ~is_word[1:] | begins[1:] | after[1:-1]
        self.start, self.stop = np.flatnonzero(start), np.flatnonzero(stop) + 1
        self.up, self.down = powers.of(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * self.up[: len(data)], out=self.sums[1:])
        self.doc = (np.searchsorted(offsets, self.start, side="right") - 1 + first).astype(np.int64)
        self.hash = self.of(self.stop)

    def of(self, stop: np.ndarray) -> np.ndarray:
        """Hashes of the words' bytes up to stop."""
        return mix((self.sums[stop] - self.sums[self.start]) * self.down[self.start] + np.uint64(1))

    def prefix(self, n: int) -> np.ndarray:
        """Hashes of the first n bytes; the hash's place tells it from a word. Words of up to n bytes: of the whole."""
        return mix(self.of(np.minimum(self.start + n, self.stop)) + np.uint64(n))


class WordReader:
    def __init__(self):
        self.powers, self.values, self.ok = Powers(), byte_values(), word_bytes()

    def words(self, data: np.ndarray, offsets: np.ndarray, first: int) -> Words:
        return Words(data, offsets, first, self.powers, self.values, self.ok)

    def cut(self, data: np.ndarray, at: int) -> int:
        """A place at or before at + 1 where data can be cut without cutting a word, else the first one after it; the end if there is none."""
        if at >= len(data):
            return len(data)
        free = ~self.ok | (np.arange(256) >= 0xE3)  # a separator, or the first byte of a character that is a word
        for lo, hi in ((at // 2, at + 1), *((x, x + at) for x in range(at + 1, len(data), at))):
            places = np.flatnonzero(free[data[lo:hi]])
            if len(places):
                return lo + int(places[-1 if lo < at else 0])
        return len(data)

    def read(self, column: pa.Array, take):
        """take(Words), a tuple of arrays, for a column of strings in chunks of whole texts of about CHUNK bytes; null is empty.

        A longer text is read in pieces, so that memory for it is what take keeps of each; their arrays come joined.
        """
        column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
        n = len(column)
        if not n:
            return
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
        raw = column.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
        lo = 0
        while lo < n:
            hi = min(n, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK, side="right")) - 1))
            part = data[offsets[lo] : offsets[hi]]
            if 0 < len(part) <= CHUNK:
                yield take(self.words(part, offsets[lo : hi + 1] - offsets[lo], lo))
            elif len(part):
                pieces = []
                while len(part):
                    end = max(1, self.cut(part, CHUNK))
                    pieces.append(take(self.words(part[:end], np.array([0, end]), lo)))
                    part = part[end:]
                yield tuple(map(np.concatenate, zip(*pieces)))
            lo = hi


def hash_word(word: str) -> int:
    """The hash of one lower-case word (no separators in it)."""
    return int(next(WordReader().read(pa.array([word], pa.string()), lambda w: (w.hash,)))[0][0])
