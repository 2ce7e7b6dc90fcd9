"""Vectorised text kernels over Arrow string columns: bytes, words, lines and packed byte n-grams.

All kernels work on blocks of about a megabyte, so that their memory doesn't follow the batch or
the longest text. Hashes are 64-bit polynomials over random byte values, finished by a mixer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
U = np.uint64
_MIX1, _MIX2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_R = 0x9E3779B97F4A7C13  # odd, 3 mod 8: differences of its powers hold few factors of two
_RINV = pow(_R, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTES = np.random.default_rng(20240601).integers(0, 1 << 64, 256, dtype=np.uint64)
_BYTES_LOWER = _BYTES[LOWER]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Tables:
    n = 0


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """r**i and r**-i modulo 2**64 for i up to n; kept for the worker's life up to four blocks."""
    if n > _Tables.n:
        size = max(n, BLOCK + 4096)
        tables = _powers(_R, size), _powers(_RINV, size)
        if size > 4 * BLOCK:
            return tables
        _Tables.n, _Tables.r, _Tables.rinv = size, *tables
    return _Tables.r, _Tables.rinv


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * _MIX1
    x = (x ^ (x >> U(27))) * _MIX2
    return x ^ (x >> U(31))


def byte_view(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its n+1 offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    binary = pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type)
    if col.null_count:
        col = col.fill_null(b"" if binary else "")
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    bufs = col.buffers()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(bufs[1], np.int64 if large else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8)[offs[0] : offs[-1]] if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def slices(offs: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes; a longer row is alone."""
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _cuts(data: np.ndarray, starts: np.ndarray, is_break: np.ndarray) -> Iterator[tuple[int, int]]:
    """Blocks that end at a break byte or at a row's start, so that no word is cut."""
    n, at = len(data), 0
    while at < n:
        to = min(n, at + BLOCK)
        if to < n:
            row = starts[np.searchsorted(starts, to, "right") - 1]
            back = np.flatnonzero(is_break[data[max(at, to - 4096) : to]])
            cut = max(int(row), max(at, to - 4096) + int(back[-1]) + 1 if len(back) else 0)
            if cut <= at:
                step = to
                while step < n:
                    ahead = np.flatnonzero(is_break[data[step : step + BLOCK]])
                    nxt = int(np.searchsorted(starts, step, "left"))
                    row = int(starts[nxt]) if nxt < len(starts) else n
                    found = step + int(ahead[0]) + 1 if len(ahead) else n
                    if min(row, found) <= step + BLOCK or step + BLOCK >= n:
                        step = min(row, found)
                        break
                    step += BLOCK
                cut = min(step, n)
            to = cut
        yield at, to
        at = to


def _spans(data: np.ndarray, offs: np.ndarray, is_break: np.ndarray, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row, start and end of every maximal run of bytes that aren't breaks, within rows."""
    row_starts = offs[:-1]
    hashes, begins, ends = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in _cuts(data, row_starts, is_break):
        part = data[a:b]
        inside = ~is_break[part]
        first = np.zeros(b - a + 1, bool)
        first[0] = first[-1] = True
        lo, hi = np.searchsorted(row_starts, [a, b])
        first[row_starts[lo:hi] - a] = True
        before = np.empty(b - a, bool)
        before[0] = False
        before[1:] = inside[:-1]
        start = np.flatnonzero(inside & (first[:-1] | ~before))
        after = np.empty(b - a, bool)
        after[-1] = False
        after[:-1] = inside[1:]
        end = np.flatnonzero(inside & (first[1:] | ~after)) + 1
        r, rinv = powers(b - a)
        sums = np.empty(b - a + 1, np.uint64)
        sums[0] = 0
        np.cumsum(lut[part] * r[: b - a], out=sums[1:])
        hashes.append(mix((sums[end] - sums[start]) * rinv[start]))
        begins.append(start + a)
        ends.append(end + a)
    begin = np.concatenate(begins)
    return np.concatenate(hashes), np.searchsorted(offs, begin, "right") - 1, begin, np.concatenate(ends)


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row, start and end of every word."""
    return _spans(data, offs, SPACE, _BYTES)


def words(data: np.ndarray, offs: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and row of every word ``[^\\x20\\x09-\\x0D]+``; lower: A-Z count as a-z."""
    return _spans(data, offs, SPACE, _BYTES_LOWER if lower else _BYTES)[:2]


_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True


def lines_with_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and row of every line split at \\n that holds a word."""
    hashes, row, begin, _ = _spans(data, offs, _NEWLINE, _BYTES)
    if not len(hashes):
        return hashes, row
    wordy = np.add.reduceat(~SPACE[data], begin, dtype=np.int64) > 0  # a span runs to the next; newlines between are spaces
    return hashes[wordy], row[wordy]


def windows(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and first index of every run of n items within a row."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :])
    out = np.zeros(len(at), np.uint64)
    for j in range(n):
        out = (out + hashes[at + j]) * U(_R)
    return mix(out), at


def by_row(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Keys that are equal only where hash and row are."""
    return mix(hashes + mix(row.astype(np.uint64) * U(0xD6E8FEB86659FD93) + U(1)))


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.diff(np.append(at, len(keys)))


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, counts
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(counts, at)


class KeyCounter:
    """Counts of 64-bit keys in bounded memory: ``full`` says when to emit what is held."""

    def __init__(self, limit: int = 1_000_000):
        self.limit, self.parts, self.size = limit, [], 0

    def add(self, keys: np.ndarray) -> None:
        got = counted(keys)
        self.parts.append(got)
        self.size += len(got[0])
        if self.size > self.limit:
            self.pack()

    def pack(self) -> None:
        if len(self.parts) > 1:
            self.parts = [merged(np.concatenate([p[0] for p in self.parts]), np.concatenate([p[1] for p in self.parts]))]
        self.size = len(self.parts[0][0]) if self.parts else 0

    @property
    def full(self) -> bool:
        return self.size > self.limit * 2 // 3

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self.pack()
        out = self.parts[0] if self.parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.parts, self.size = [], 0
        return out


def grams(data: np.ndarray, offs: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of packed (order+1)-byte grams, one for each byte and one for each row's end.

    A row is read as ``order`` bytes 0xFF, its bytes, one byte 0xFF (never part of UTF-8).
    Gives keys (the last byte is the predicted one), the rows of the block and where in keys each
    row begins. A row over a block long comes in several blocks.
    """
    for i, j in slices(offs):
        if j - i == 1 and offs[j] - offs[i] > BLOCK:
            text, n = data[offs[i] : offs[j]], int(offs[j] - offs[i])
            for s in range(0, n + 1, BLOCK):
                e = min(n + 1, s + BLOCK)
                body = text[max(0, s - order) : min(e, n)]
                head = np.full(order - (s - max(0, s - order)), 0xFF, np.uint8)
                yield _packed(np.concatenate([head, body, np.full(int(e > n), 0xFF, np.uint8)]), order), np.array([i]), np.zeros(1, np.int64)
            continue
        n, lens = j - i, np.diff(offs[i : j + 1])
        begin = (offs[i:j] - offs[i]) + np.arange(n) * (order + 1)
        real = np.ones(int(lens.sum()) + n * (order + 1), bool)
        for k in range(order):
            real[begin + k] = False
        wanted = real[order:].copy()  # a gram is named by its first byte's place
        real[begin + order + lens] = False
        buf = np.full(len(real), 0xFF, np.uint8)
        buf[real] = data[offs[i] : offs[j]]
        yield _packed(buf, order)[wanted], np.arange(i, j), (offs[i:j] - offs[i]) + np.arange(n)


def _packed(buf: np.ndarray, order: int) -> np.ndarray:
    n = len(buf) - order
    key = buf[:n].astype(np.uint64)
    for k in range(1, order + 1):
        key <<= U(8)
        key |= buf[k : n + k]
    return key


_SPREAD = U(0x9E3779B97F4A7C15)


class HashedArray:
    """A sorted array of hashes with a directory over their leading bits.

    Keys are multiplied by an odd constant, which loses nothing, so a hit is exact.
    """

    def __init__(self, keys: np.ndarray):
        h = keys.astype(np.uint64) * _SPREAD
        self.order = np.argsort(h)
        self.hashes = np.append(h[self.order], U(0xFFFFFFFFFFFFFFFF))
        self.n = len(keys)
        bits = max(4, int(2 * self.n).bit_length())
        self.shift = U(64 - bits)
        self.first = np.searchsorted(self.hashes[:-1], np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places in the sorted order, -1 where a key is absent."""
        h = keys * _SPREAD
        at = self.first[(h >> self.shift).astype(np.int64)]
        got = self.hashes[at]
        hit = got == h
        left = np.flatnonzero(got < h)
        while len(left):
            at[left] += 1
            got = self.hashes[at[left]]
            hit[left] = got == h[left]
            left = left[got < h[left]]
        hit &= at < self.n
        at[~hit] = -1
        return at
