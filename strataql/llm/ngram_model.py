"""Byte n-gram models from Spark counts: prediction by partial matching and modified Kneser-Ney.

Counting: each task packs every byte with its ``order`` predecessors into one integer and counts
those in bounded memory; Spark sums them. A model is compiled on the driver from the summed counts
into sorted hash arrays, in shards: all contexts that end in the same two bytes lie in one shard, so
that each position of a text needs one shard alone. A pair of bytes with too many grams is divided
by the byte before it, and so on; the few shorter grams that its parts share (256 of each length)
are counted apart. So a shard holds at most ``max_entries`` grams (or the 256 of one whole context),
which bounds what is collected and broadcast; more grams mean more passes over the texts, not a
coarser model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbatch import HashedArray, KeyCounter, U, byte_view, counted, grams, merged

COUNT_SCHEMA = "kind int, key long, n long"
GRAM, WORD, TOTAL = 0, 1, 2


def count_batch(kind: int, taken: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    keys, counts = taken
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], names=["kind", "key", "n"])


def count_grams(texts: DataFrame, order: int) -> DataFrame:
    """(kind, key, n) of all (order+1)-byte grams of the only column, summed over the table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = KeyCounter()
        for batch in batches:
            for keys, _, _ in grams(*byte_view(batch.column(0)), order):
                held.add(keys)
                if held.full:
                    yield count_batch(GRAM, held.take())
        yield count_batch(GRAM, held.take())

    return summed(texts.mapInArrow(count, COUNT_SCHEMA))


def summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy("kind", "key").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Range:
    """Contexts of one shard: those that end in the ``depth`` bytes of ``suffix``, the byte before them
    from lo to hi and not in ``skip``. At depth 0 lo, hi and skip are the last two bytes together."""

    lo: int
    hi: int
    depth: int = 0
    suffix: int = 0
    skip: tuple[int, ...] = ()

    @property
    def whole(self) -> bool:
        return not self.depth and not self.skip and (self.lo, self.hi) == (0, 0xFFFF)

    def own(self, keys: np.ndarray) -> np.ndarray:
        """Whether each gram's context is in the range."""
        at = (keys >> U(8 * (self.depth + 1))) & U(0xFF if self.depth else 0xFFFF)
        out = (at >= U(self.lo)) & (at <= U(self.hi))
        if self.skip:
            out &= ~np.isin(at, np.array(self.skip, np.uint64))
        return out & (((keys >> U(8)) & _mask(self.depth)) == U(self.suffix)) if self.depth else out

    def rows(self):
        """The same of the column ``key``."""
        at = F.shiftrightunsigned("key", 8 * (self.depth + 1)).bitwiseAND(F.lit(0xFF if self.depth else 0xFFFF))
        out = at.between(self.lo, self.hi)
        if self.skip:
            out = out & ~at.isin(*self.skip)
        return out & (_suffix(self.depth) == self.suffix) if self.depth else out


def _suffix(depth: int):
    return F.shiftrightunsigned("key", 8).bitwiseAND(F.lit((1 << (8 * depth)) - 1))


@dataclass
class Shard:
    """Grams whose contexts are in a range. ``upper``: those grams of 3 to depth + 1 bytes that end in its
    suffix and a byte, by their length, with sums (or numbers of longer grams) over all ranges."""

    range: Range
    keys: np.ndarray = field(repr=False)
    counts: np.ndarray = field(repr=False)
    upper: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict, repr=False)


def _divided(sizes: dict[int, int], most: int, last: int, deeper: bool, depth: int = 0, suffix: int = 0) -> tuple[list[Range], list[int]]:
    """Ranges that cover places 0 to last but the hot ones, and those: places too large for one shard."""
    hot = sorted(at for at, n in sizes.items() if n > most) if deeper else []
    cuts, lo, held = [], 0, 0
    for at, n in sorted(sizes.items()):
        if at in hot:
            continue
        if held and held + n > most:
            cuts.append((lo, at - 1))
            lo, held = at, 0
        held += n
    return [Range(a, b, depth, suffix, tuple(x for x in hot if a <= x <= b)) for a, b in [*cuts, (lo, last)]], hot


def shard_ranges(counts: DataFrame, max_entries: int, order: int) -> list[Range]:
    sizes = {r[0]: r[1] for r in counts.groupBy(_suffix(2).alias("pair")).count().collect()}  # 65,536 at most
    out, hot = _divided(sizes, max_entries, 0xFFFF, order > 2)
    depth = 2
    while hot:
        # the byte before each hot suffix: 256 rows for each, and there are at most grams / max_entries of them
        parts: dict[int, dict[int, int]] = {}
        for s, n in counts.filter(_suffix(depth).isin(hot)).groupBy(_suffix(depth + 1).alias("s")).count().collect():
            parts.setdefault(s & ((1 << (8 * depth)) - 1), {})[s >> (8 * depth)] = n
        again = []
        for suffix in hot:
            ranges, bytes_ = _divided(parts[suffix], max_entries, 0xFF, depth + 1 < order, depth, suffix)
            out += ranges
            again += [x << (8 * depth) | suffix for x in bytes_]
        depth, hot = depth + 1, again
    return out


def fetch_shard(counts: DataFrame, within: Range, order: int, distinct: bool) -> Shard:
    got = counts.filter(within.rows()).select("key", "n").toArrow()
    keys, n = (got.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("key", "n"))
    keys = keys.astype(np.int64).view(np.uint64)
    place = np.argsort(keys)
    upper = {}
    for k in range(3, within.depth + 2):
        suffix = within.suffix & ((1 << (8 * (k - 1))) - 1)
        before = F.shiftrightunsigned("key", 8 * k).bitwiseAND(F.lit(0xFF))
        of = counts.filter(_suffix(k - 1) == suffix).groupBy(F.col("key").bitwiseAND(F.lit(0xFF)).alias("s"))
        rows = sorted(of.agg((F.count_distinct(before) if distinct else F.sum("n")).alias("n")).collect())  # 256 at most
        upper[k] = np.array([suffix << 8 | r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int64)
    return Shard(within, keys[place], n.astype(np.int64)[place], upper)


def _mask(length: int) -> np.uint64:
    return U((1 << (8 * length)) - 1)


def _suffix_levels(shard: Shard, order: int, distinct: bool) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Counts by gram length from order+1 down to 2: sums, or (distinct) numbers of longer grams."""
    levels = {order + 1: (shard.keys, shard.counts)}
    for k in range(order, 1, -1):
        if k in shard.upper:
            levels[k] = shard.upper[k]
            continue
        keys, n = levels[k + 1]
        short = keys & _mask(k)
        levels[k] = counted(short) if distinct else merged(short, n)
    return levels


def _pair_table(keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = np.zeros(65536, np.int64)
    np.add.at(out, keys.astype(np.int64), n)
    return out


def _by_context(keys: np.ndarray, *sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Contexts of sorted grams, the context's place for each gram, and sums over each context."""
    ctx = keys >> U(8)
    at = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]])) if len(ctx) else np.zeros(0, np.int64)
    place = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(ctx))))
    return ctx[at], place, [np.add.reduceat(s, at) if len(at) else s[:0] for s in sums]


# --- prediction by partial matching -------------------------------------------------------------


class PPMTable:
    """One shard of a trie of byte contexts with method D escapes and symbol exclusion.

    At context c, symbol s has (2n-1)/2T, an escape d/2T. After an escape from c, the shorter
    context c' loses all symbols seen after c: T' and d' are what remains. As whatever follows c
    also follows c', T' and d' depend on c alone and are stored with it. Below the empty context,
    the symbols not seen at all are equally likely.
    """

    def __init__(self, shard: Shard, order: int, pairs: np.ndarray):
        self.order, self.range = order, shard.range
        levels = _suffix_levels(shard, order, distinct=False)
        single = pairs.reshape(256, 256).sum(0)
        two = np.arange(65536, dtype=np.uint64)[pairs > 0]
        levels[2] = (two, pairs[pairs > 0])
        one = np.arange(256, dtype=np.uint64)[single > 0]
        levels[1] = (one, single[single > 0])
        log = np.log10
        self.level: dict[int, tuple] = {}
        below = None
        for k in range(1, order + 2):
            keys, n = levels[k]
            ctx, place, (total, kinds) = _by_context(keys, n, np.ones_like(n))
            num = log(2.0 * n - 1)
            full, esc = num - log(2.0 * total)[place], log(kinds / (2.0 * total))
            if k == 1:
                self.unseen = max(1, 256 - int(kinds[0])) if len(kinds) else 256
                rest, rest_esc = np.zeros(len(ctx)), np.zeros(len(ctx))
                self.root_esc = float(esc[0]) if len(esc) else 0.0
            else:
                low_keys, low_n, low_ctx, low_total, low_kinds = below
                shared = low_n[np.searchsorted(low_keys, keys & _mask(k - 1))]
                parent = np.searchsorted(low_ctx, ctx & _mask(k - 2)) if k > 2 else np.zeros(len(ctx), np.int64)
                left = low_total[parent] - np.bincount(place, shared, len(ctx)).astype(np.int64)
                fresh = low_kinds[parent] - kinds
                some = (left > 0) & (fresh > 0)
                rest = np.where(some, log(np.where(some, 2.0 * left, 1)), 0)
                rest_esc = np.where(some, log(np.where(some, fresh, 1)) - rest, 0)
            below = keys, n, ctx, total, kinds
            f = np.float32
            if k <= 2:
                dense = {"num": np.zeros(256**k, f), "full": np.ones(256**k, f), "esc": np.ones(256 ** (k - 1), f), "rest": np.zeros(256 ** (k - 1), f), "rest_esc": np.zeros(256 ** (k - 1), f)}
                g, c = keys.astype(np.int64), ctx.astype(np.int64)
                dense["num"][g], dense["full"][g] = num, full
                dense["esc"][c], dense["rest"][c], dense["rest_esc"][c] = esc, rest, rest_esc
                self.level[k] = dense
            else:
                found, contexts = HashedArray(keys), HashedArray(ctx)
                self.level[k] = (found, num[found.order].astype(f), full[found.order].astype(f), contexts, *(x[contexts.order].astype(f) for x in (esc, rest, rest_esc)))
                del found.order, contexts.order

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's last byte after the bytes before it."""
        out = np.zeros(len(keys))
        top = self.order + 1
        if top >= 3:
            at = self.level[top][0].find(keys)
            hit = at >= 0
            out[hit] = self.level[top][2][at[hit]]
            left = np.flatnonzero(~hit)
        else:
            left = np.arange(len(keys))
        sub = keys[left]
        n = len(left)
        acc, after = np.zeros(n), np.zeros(n, bool)
        rest, rest_esc = np.zeros(n, np.float32), np.zeros(n, np.float32)
        for k in range(top, 0, -1):
            if not len(left):
                return out
            if k >= 3:
                found, num, full, contexts, e, r, re = self.level[k]
                gram = sub & _mask(k)
                at = found.find(gram) if k < top else np.full(len(sub), -1)
                hit = at >= 0
                value = np.where(after[hit], num[at[hit]] - rest[hit], full[at[hit]])
                c = contexts.find(gram >> U(8))
                there = c >= 0
            else:
                d = self.level[k]
                gram = (sub & _mask(k)).astype(np.int64)
                hit = d["full"][gram] <= 0
                value = np.where(after[hit], d["num"][gram[hit]] - rest[hit], d["full"][gram[hit]])
                e, r, re, c = d["esc"], d["rest"], d["rest_esc"], gram >> 8
                there = e[c] <= 0
            out[left[hit]] = acc[hit] + value
            go = ~hit
            left, sub, acc, after, rest, rest_esc, c, there = (x[go] for x in (left, sub, acc, after, rest, rest_esc, c, there))
            acc[there] += np.where(after[there], rest_esc[there], e[c[there]])
            rest[there], rest_esc[there] = r[c[there]], re[c[there]]
            after |= there
        out[left] = acc - np.log10(self.unseen)
        return out


# --- modified Kneser-Ney ------------------------------------------------------------------------


def discounts(of: np.ndarray) -> tuple[float, float, float]:
    """D1, D2 and D3+ from the numbers of grams seen once to four times; fixed where those are too few."""
    n1, n2, n3, n4 = (float(x) for x in of[1:5])
    if min(n1, n2, n3, n4) <= 0:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(float(np.clip(k - (k + 1) * y * b / a, 0.05, k - 0.05)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def _less(n: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(n, 3)]


class KNTable:
    """One shard of an interpolated modified Kneser-Ney model of bytes, natural logarithms.

    The longest grams have their counts, shorter ones the number of distinct bytes before them.
    """

    def __init__(self, shard: Shard, order: int, pairs: np.ndarray, of: dict[int, np.ndarray]):
        self.order, self.range = order, shard.range
        levels = _suffix_levels(shard, order, distinct=True)
        single = (pairs.reshape(256, 256) > 0).sum(0) if order >= 2 else pairs.reshape(256, 256).sum(0)
        d = discounts(of[1])
        total = max(1, single.sum())
        left = _less(single, d).sum() / total if single.sum() else 1.0
        p1 = np.maximum(single - _less(single, d), 0) / total + left / 256
        d, table = discounts(of[2]), pairs.reshape(256, 256)
        total = table.sum(1)
        taken = _less(table, d)
        with np.errstate(invalid="ignore", divide="ignore"):
            p2 = np.where(total[:, None] > 0, np.maximum(table - taken, 0) / total[:, None] + (taken.sum(1) / total)[:, None] * p1[None, :], p1[None, :])
        self.pairs = np.log(p2).astype(np.float32).reshape(-1)
        low_keys, low_p = np.arange(65536, dtype=np.uint64), p2.reshape(-1)
        self.level: dict[int, tuple] = {}
        for k in range(3, order + 2):
            keys, n = levels[k]
            taken = _less(n, discounts(of[k]))
            ctx, place, (total, mass) = _by_context(keys, n, taken)
            back = mass / total if len(total) else mass
            p = (n - taken) / total[place] + back[place] * low_p[np.searchsorted(low_keys, keys & _mask(k - 1))]
            found, contexts = HashedArray(keys), HashedArray(ctx)
            self.level[k] = found, np.log(p)[found.order].astype(np.float32), contexts, np.log(back)[contexts.order].astype(np.float32)
            del found.order, contexts.order
            low_keys, low_p = keys, p

    def log(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys))
        left, sub = np.arange(len(keys)), keys
        for k in range(self.order + 1, 2, -1):
            found, p, contexts, back = self.level[k]
            gram = sub & _mask(k) if k <= self.order else sub
            at = found.find(gram)
            hit = at >= 0
            out[left[hit]] += p[at[hit]]
            left, gram = left[~hit], gram[~hit]
            c = contexts.find(gram >> U(8))
            there = c >= 0
            out[left[there]] += back[c[there]]
            sub = sub[~hit]
            if not len(left):
                return out
        out[left] += self.pairs[(sub & U(0xFFFF)).astype(np.int64)]
        return out


# --- from counts to shards ----------------------------------------------------------------------


def _own_levels(shard: Shard, levels: dict[int, tuple[np.ndarray, np.ndarray]], seen: set[tuple[int, int]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The levels that no shard before has told: parts of one suffix share its shorter grams."""
    out, r = {}, shard.range
    for k, level in levels.items():
        if r.depth and k <= r.depth + 1:
            mark = k, r.suffix & ((1 << (8 * max(2, k - 1))) - 1)
            if mark in seen:
                continue
            seen.add(mark)
        out[k] = level
    return out


def ppm_shards(counts: DataFrame, order: int, max_entries: int) -> Iterator[PPMTable]:
    ranges = shard_ranges(counts, max_entries, order)
    first = [fetch_shard(counts, ranges[0], order, False)]
    pairs, seen = np.zeros(65536, np.int64), set()
    for i, r in enumerate(ranges):
        s = first[0] if i == 0 else fetch_shard(counts, r, order, False)
        own = _own_levels(s, _suffix_levels(s, order, distinct=False), seen)
        if 2 in own:
            pairs += _pair_table(*own[2])
    for i, r in enumerate(ranges):
        yield PPMTable(first.pop() if i == 0 else fetch_shard(counts, r, order, False), order, pairs)


def kn_shards(counts: DataFrame, order: int, max_entries: int) -> Iterator[KNTable]:
    ranges = shard_ranges(counts, max_entries, order)
    first = [fetch_shard(counts, ranges[0], order, True)]
    pairs, of, seen = np.zeros(65536, np.int64), {k: np.zeros(6, np.int64) for k in range(1, order + 2)}, set()
    for i, r in enumerate(ranges):
        s = first[0] if i == 0 else fetch_shard(counts, r, order, True)
        for k, (keys, n) in _own_levels(s, _suffix_levels(s, order, distinct=True), seen).items():
            if k == 2:
                pairs += _pair_table(keys, n)
            else:
                of[k] += np.bincount(np.minimum(n, 5), minlength=6)
    single = (pairs.reshape(256, 256) > 0).sum(0)
    of[2], of[1] = (np.bincount(np.minimum(x, 5), minlength=6) for x in (pairs, single))
    for i, r in enumerate(ranges):
        yield KNTable(first.pop() if i == 0 else fetch_shard(counts, r, order, True), order, pairs, of)


def sums_by_row(log_of, table, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of log_of(grams) and number of grams for each row, over the grams of the table's shard."""
    out, count = np.zeros(len(offs) - 1), np.zeros(len(offs) - 1, np.int64)
    whole = table.range.whole
    for keys, rows, begin in grams(data, offs, table.order):
        if whole:
            values = log_of(keys)
        else:
            own = np.flatnonzero(table.range.own(keys))
            values = np.zeros(len(keys))
            values[own] = log_of(keys[own])
        out[rows] += np.add.reduceat(values, begin)
        count[rows] += np.diff(np.append(begin, len(keys)))
    return out, count
