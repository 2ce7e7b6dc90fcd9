"""Pattern packing of tokenised documents by non-negative least squares.

Documents are cut into pieces of at most ``size`` tokens, lengths are counted, and the driver plans
from that histogram of ``size`` entries alone: lengths go to bins, all patterns of at most
``parts`` bins that fill a sequence are enumerated, non-negative least squares fits their repeat
counts to the histogram, the counts are rounded down, and what remains is packed best fit, longest
first, into the gaps and into new sequences. The plan names runs of equal sequences, so a piece
needs only its rank among the pieces of its length to find its place.

Defined cases: a null text is empty and has the end token alone; repeated rows are packed each; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunk_cache import ChunkCache, runs
from .textbatch import HashedArray, byte_view, slices, word_spans
from .workspace import Workspace

SIZE = 4096
BINS = 64
PARTS = 4
END_ID = 1
#: documents of one length are ranked in buckets; about so many in each
BUCKET_ROWS = 20_000
#: entries of a Python worker's caches, about 100 bytes each
WORDS, NEW, STEMS = 300_000, 150_000, 400_000


# --- tokens -------------------------------------------------------------------------------------


def word_encoder(path: str):
    """ids of many white-space-free chunks under a tokenizer for which white space is a boundary."""
    import os
    import unicodedata

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    def encode_many(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, lens = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for i in range(0, len(chunks), 1000):
            part = chunks[i : i + 1000]
            joined = " ".join(part)
            if joined.isascii() or unicodedata.is_normalized("NFC", joined):
                got = tokenizer.encode(joined, add_special_tokens=False)
                begin = np.cumsum([0, *(len(c) + 1 for c in part)])
                at = np.fromiter((o[0] for o in got.offsets), np.int64, len(got.ids))
                ids.append(np.array(got.ids, np.int32))
                lens.append(np.diff(np.searchsorted(at, begin)))
            else:
                each = [g.ids for g in tokenizer.encode_batch(part, add_special_tokens=False)]
                ids.append(np.array([x for g in each for x in g], np.int32))
                lens.append(np.array([len(g) for g in each], np.int64))
        return np.concatenate(ids), np.concatenate(lens)

    return encode_many


_PUNCTUATION = ".,;:!?"


class WordTokens:
    """ids of texts by their words: known words are found by hash in a sorted array, others in a cache of stems.

    A word of ASCII characters has the ids of its lower-cased stem and those of one punctuation mark
    after a letter or digit, as the tokenizer lowers and cuts there too. New words wait in a
    dictionary; with ``NEW`` of them the array is built anew from the words used more than once.
    """

    def __init__(self, path: str):
        encode = word_encoder(path)
        self.marks = {p: int(encode([p])[0][0]) for p in _PUNCTUATION if len(encode([p])[0]) == 1}
        self.stems = ChunkCache(encode, STEMS)
        self._hold(np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int64))

    def _hold(self, keys: np.ndarray, flat: np.ndarray, length: np.ndarray) -> None:
        self.keys, self.flat, self.length = [keys], [flat], [length]
        self.start = np.cumsum(length) - length
        self.known, self.new, self.n = HashedArray(keys), {}, len(keys)
        self.uses = np.ones(self.n + NEW + 1, np.int64)

    def _rebuild(self) -> None:
        keys, flat, length = (np.concatenate(x) for x in (self.keys, self.flat, self.length))
        start = np.cumsum(length) - length
        least = 2 if (self.uses[: self.n] >= 2).sum() <= WORDS else int(np.partition(self.uses[: self.n], -WORDS)[-WORDS]) + 1
        kept = np.flatnonzero(self.uses[: self.n] >= least)
        self._hold(keys[kept], flat[runs(start[kept], length[kept])], length[kept])

    def ids(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows in a row and where each row's end."""
        hashes, row, begin, end = word_spans(data, offs)
        if len(self.new) > NEW // 2:
            self._rebuild()
        at = self.known.find(hashes).astype(np.int64)
        miss = np.flatnonzero(at < 0)
        at = self.known.order[at] if len(self.known.order) else at
        if len(miss):
            u, first, back = np.unique(hashes[miss], return_index=True, return_inverse=True)
            place = np.fromiter(map(self.new.get, u.tolist(), repeat(-1)), np.int64, len(u))
            absent = np.flatnonzero(place < 0)
            if len(absent) > NEW // 2 - 1:  # more at once than may wait: without holding them
                self.uses = np.concatenate([self.uses, np.ones(len(absent), np.int64)])
            if len(absent):
                where = miss[first[absent]]
                raw = data.tobytes()
                flat, length = self._by_stems([raw[b:e].decode() for b, e in zip(begin[where].tolist(), end[where].tolist(), strict=True)])
                place[absent] = np.arange(self.n, self.n + len(absent))
                self.new.update(zip(u[absent].tolist(), place[absent].tolist(), strict=True))
                self.keys.append(u[absent]), self.flat.append(flat), self.length.append(length)
                self.start = np.concatenate([self.start, (self.start[-1] + self.length[-2][-1] if self.n else 0) + np.cumsum(length) - length])
                self.n += len(absent)
            at[miss] = place[back]
        self.uses[: self.n] += np.bincount(at, minlength=self.n)[: self.n]
        if len(self.flat) > 1:
            self.flat, self.length = [np.concatenate(self.flat)], [np.concatenate(self.length)]
        lens = self.length[0][at]
        after = np.concatenate([[0], np.cumsum(lens)])
        return self.flat[0][runs(self.start[at], lens)], after[np.searchsorted(row, np.arange(1, len(offs)))]

    def _by_stems(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        stems, marks = [], np.full(len(chunks), -1, np.int32)
        for k, c in enumerate(chunks):
            if c.isascii() and "<|" not in c:  # special tokens are told before lowering
                if c[-1:] in self.marks and len(c) > 1 and c[-2].isalnum():
                    marks[k] = self.marks[c[-1]]
                    c = c[:-1]
                c = c.lower()
            stems.append(c)
        ids, ends = self.stems.ids(stems, np.arange(1, len(stems) + 1))
        has = marks >= 0
        return np.insert(ids, ends[has], marks[has]), np.diff(ends, prepend=0) + has


@lru_cache(maxsize=1)
def cached_tokens(path: str) -> WordTokens:
    """Kept for the Python worker's life: its later tasks begin with the words that it has met."""
    return WordTokens(path)


def token_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """id, piece, start, length and ids_crc32 of each piece of each row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = cached_tokens(path)
        for batch in batches:
            data, offs = byte_view(batch.column(1))
            row, piece, start, length, crc = [], [], [], [], []
            for i, j in slices(offs):
                all_ids, ends = tokens.ids(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                begin = 0
                for k, end in enumerate(ends.tolist()):
                    ids = np.append(all_ids[begin:end], end_id).astype("<u4")
                    begin = end
                    for p, s in enumerate(range(0, len(ids), size)):
                        cut = ids[s : s + size]
                        row.append(i + k), piece.append(p), start.append(s), length.append(len(cut)), crc.append(zlib.crc32(cut.tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["id", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


# --- the plan -----------------------------------------------------------------------------------


def patterns(bins: int, parts: int) -> list[tuple[int, ...]]:
    """All non-increasing tuples of at most ``parts`` bins that sum to ``bins``."""

    def fill(left: int, most: int, n: int) -> Iterator[tuple[int, ...]]:
        if left == 0:
            yield ()
        elif n:
            for b in range(min(left, most), 0, -1):
                if b * n >= left:
                    for rest in fill(left - b, b, n - 1):
                        yield (b, *rest)

    return list(fill(bins, bins, parts))


def nnls(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """Non-negative least squares by active sets."""
    m, n = a.shape
    x, active = np.zeros(n), np.zeros(n, bool)
    gram, target = a.T @ a, a.T @ b
    for _ in range(3 * m):
        w = target - gram @ x
        w[active] = -np.inf
        k = int(np.argmax(w))
        if w[k] <= tolerance * max(1.0, np.abs(target).max()):
            break
        active[k] = True
        while True:
            at = np.flatnonzero(active)
            s = np.linalg.lstsq(gram[np.ix_(at, at)], target[at], rcond=None)[0]
            if s.min() > 0:
                x[:] = 0
                x[at] = s
                break
            bad = s <= 0
            old = x[at]
            step = np.min(old[bad] / np.maximum(old[bad] - s[bad], 1e-300))
            x[at] = old + step * (s - old)
            active[at[(x[at] <= 1e-12) & bad]] = False
            x[~active] = 0
            if not active.any():
                break
    return x


class Plan:
    """Runs of equal sequences over a histogram of lengths 1 to size."""

    def __init__(self, histogram: np.ndarray, size: int = SIZE, bins: int = BINS, parts: int = PARTS):
        self.size, self.left = size, histogram.astype(np.int64).copy()
        self.runs: list[list] = []  # [lengths, repeats]
        self.open: dict[int, list[int]] = {}  # runs by the room that is left
        self.rooms: list[int] = []
        bins = min(bins, size)
        while size % bins:
            bins -= 1
        self._patterns(bins, parts)
        self._best_fit()
        self._index()

    def _longest(self, most: int, least: int = 1) -> int:
        """The longest length from least to most of which some remain, or 0."""
        part = np.flatnonzero(self.left[least : most + 1])
        return least + int(part[-1]) if len(part) else 0

    def _put(self, lengths: list[int], repeats: int) -> None:
        room = self.size - sum(lengths)
        self.runs.append([lengths, repeats])
        if room:
            if room not in self.open:
                bisect.insort(self.rooms, room)
                self.open[room] = []
            self.open[room].append(len(self.runs) - 1)

    def _patterns(self, bins: int, parts: int) -> None:
        width = self.size // bins
        full = int(self.left[self.size])
        if full:
            self.left[self.size] = 0
            self._put([self.size], full)
        counts = self.left[1:].reshape(bins, width).sum(1)
        if not counts.any():
            return
        found = [p for p in patterns(bins, parts) if all(counts[b - 1] for b in p)]
        if not found:
            return
        a = np.zeros((bins, len(found)))
        for k, p in enumerate(found):
            for b in p:
                a[b - 1, k] += 1
        weight = np.sqrt(np.arange(1, bins + 1) / bins)  # long documents are the hard ones to place
        x = np.floor(nnls(a * weight[:, None], counts * weight) + 1e-6).astype(np.int64)
        for k in sorted(np.flatnonzero(x), key=lambda k: found[k], reverse=True):
            held = self.left[1:].reshape(bins, width).sum(1)
            todo = [([], min(int(x[k]), *(int(held[b - 1]) // found[k].count(b) for b in found[k])))]
            for place, b in enumerate(found[k]):
                last, after = place == len(found[k]) - 1, []
                for lengths, repeats in todo:
                    room = self.size - sum(lengths)
                    while repeats:  # the last part may use the room that the others' bins left
                        n = self._longest(room if last else min(room, b * width), (b - 1) * width + 1)
                        if not n:
                            for each in lengths:
                                self.left[each] += repeats
                            break
                        m = min(repeats, int(self.left[n]))
                        self.left[n] -= m
                        after.append(([*lengths, n], m))
                        repeats -= m
                todo = after
            for lengths, repeats in todo:
                self._put(lengths, repeats)

    def _best_fit(self) -> None:
        for n in np.flatnonzero(self.left)[::-1].tolist():
            while self.left[n]:
                at = bisect.bisect_left(self.rooms, n)
                if at < len(self.rooms):
                    room = self.rooms[at]
                    k = self.open[room].pop()
                    if not self.open[room]:
                        del self.open[room], self.rooms[at]
                    lengths, repeats = self.runs[k]
                    m = min(repeats, int(self.left[n]))
                    self.left[n] -= m
                    if m < repeats:
                        self.runs[k][1] = repeats - m
                        if room not in self.open:
                            bisect.insort(self.rooms, room)
                            self.open[room] = []
                        self.open[room].append(k)
                        self._put([*lengths, n], m)
                    else:
                        self.runs[k] = [[*lengths, n], m]
                        room -= n
                        if room:
                            if room not in self.open:
                                bisect.insort(self.rooms, room)
                                self.open[room] = []
                            self.open[room].append(k)
                else:
                    each = min(self.size // n, int(self.left[n]))
                    m = int(self.left[n]) // each
                    self.left[n] -= m * each
                    self._put([n] * each, m)

    def _index(self) -> None:
        """Segments by length: first rank, first sequence and offset; ranks count pieces of a length."""
        first, rows = 0, []
        for lengths, repeats in self.runs:
            offset = 0
            for n in lengths:
                rows.append((n, repeats, first, offset))
                offset += n
            first += repeats
        self.sequences = first
        table = np.array(sorted(rows), np.int64).reshape(-1, 4)
        self.segment_length, repeats, self.sequence, self.offset = (np.ascontiguousarray(table[:, k]) for k in range(4))
        before = np.concatenate([[0], np.cumsum(repeats)])
        self.start = before[:-1]
        self.first = np.searchsorted(self.segment_length, np.arange(self.size + 2))
        self.base = before[self.first]
        del self.left, self.open, self.rooms

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the rank-th piece (from 0) of each length."""
        at = self.base[length] + rank
        k = np.searchsorted(self.start, at, "right") - 1
        return self.sequence[k] + at - self.start[k], self.offset[k]


# --- the operator -------------------------------------------------------------------------------


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """A row for each piece: id, piece, start, length, ids_crc32, sequence_id and offset."""
    spark = docs.sparkSession
    ws = Workspace(spark, "packing")
    # rows of one id may be many: a number of the row, kept with it, deals them out too
    pieces = ws.write(token_pieces(docs, path, id_col, text_col, size, end_id).withColumn("salt", F.monotonically_increasing_id()), "pieces")
    histogram = np.zeros(size + 1, np.int64)
    for n, count in pieces.groupBy("length").count().collect():  # ``size`` rows at most
        histogram[n] = count
    plan = spark.sparkContext.broadcast(Plan(histogram, size))
    buckets = max(64, -(-int(histogram.max()) // BUCKET_ROWS))
    rows = pieces.withColumn("bucket", F.pmod(F.xxhash64("id", "piece", "salt"), F.lit(buckets)).cast("int"))
    per = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    # buckets of a length: a bounded number of sums, however many pieces the length has
    before = per.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("id", "piece", "start", "ids_crc32"))
    ranked = rows.withColumn("own", own).join(before, ["length", "bucket"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("own") - 1).alias("rank"))
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
            sequence, offset = plan.value.place(length, rank)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    placed = ranked.mapInArrow(run, f"id {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.withColumnRenamed("id", id_col)
