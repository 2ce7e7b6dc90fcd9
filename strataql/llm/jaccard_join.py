"""N-gram Jaccard join with adaptive multi-match prefixes: classes of near-duplicate documents.

A document's set holds its distinct ``N``-word shingles; two documents link when their sets' Jaccard
similarity is ``PERCENT`` hundredths or more, and a class is what links reach.

Equal sets are classed by digest first. The others are sorted by estimated frequency, ties by hash:
shingles seen twice or more in a task, or in a sample of one document in ``SAMPLE``, are counted,
and the ``HOT`` most frequent have estimates; all others come first. The estimate bears on cost alone:
any one order of all documents' shingles finds every link. (Counting every shingle of all documents
by a shuffle wrote 2.5 times the input, with what it spilled.) With overlap t needed, two linked documents share at least l shingles among their first
n - t + l. Each document picks its own l from multiples of least_matches(n): a longer prefix meets
more candidates, of which fewer share l shingles, and the cheaper total by these estimates wins. A pair
must share the smaller l of its two. A shingle that one prefix alone holds is dropped after a single
shuffle, and so is a document that shares too few with all others together. Where pairs are made,
their two sizes shorten both prefixes further (the overlap needed by both). A pair is met first in its
two shortest prefixes (l = 1), as one row for each shingle of the longer ones would be many more, and
must then share its own l in those.

What is left is verified on whole sets. As classes are wanted, pairs of large groups aren't all
made: each document is first verified with one leader that shares most of its prefix, and then every
pair that still lies in two classes is made, so no link between classes is lost. The list of a
shingle that many documents share is cut into blocks, and a pair of blocks is one group of a join.

``linked`` also counts each document's links. Links lie within classes, so all pairs of a class's
different sets are verified, a set once for all its copies, which count by their number. Sets whose
sizes allow a link are dealt out to blocks, and a pair of blocks is one multiplication of matrices;
pairs are never rows.

Defined cases: a text without words, or null, has an empty set and is a class alone; fewer than N
words are one shingle; rows of one id with different texts, or without id, are documents each, and
a class is named by its smallest id; repeated rows are returned each, but are one document among the
links; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .textbatch import HashedArray, KeyCounter, U, byte_view, mix, slices, windows, words
from .workspace import Workspace, trim

N = 5
PERCENT = 75
#: shingles whose frequency is broadcast; those beyond it count as rare, which costs time alone
HOT = 1 << 18
#: an estimate from which a shingle's rows are dealt out over SALTS lists
HEAVY, SALTS = 20_000, 64
#: one document in SAMPLE has all its shingles counted for the order
SAMPLE = 16
#: multiples of least_matches(n) that l is chosen from
STEPS = (1, 2, 3, 4)
#: costs of a prefix row, of meeting a candidate in its list and of verifying one shingle, and the
#: other documents that a shingle of unknown frequency is taken to have
ROW, MEET, VERIFY, UNKNOWN = 1.0, 1.0, 0.05, 0.2
#: bits of a bitmap of ids, by their number; beyond MOST_BITS / 4 ids a join takes its place
LEAST_BITS, MOST_BITS = 1 << 23, 1 << 28
#: documents in a block of a shingle's list where pairs are made
LIST_ROWS = 2048
#: a block's shingles and sets, on average, where links are counted; CELLS of a matrix at once
BLOCK_SHINGLES, BLOCK_SETS, CELLS = 400_000, 1024, 1 << 21


def shingle_sets(data: np.ndarray, offs: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, in a row, and their n+1 bounds."""
    rows = len(offs) - 1
    keys, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, j in slices(offs):
        found, row = words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], lower=True)
        if not len(found):
            continue
        got, begin = windows(found, row, n)
        key, key_row = [got], [row[begin]]
        count = np.bincount(row, minlength=j - i)
        first = np.cumsum(count) - count
        for k in range(1, n):
            short = np.flatnonzero(count == k)
            if len(short):
                h = np.full(len(short), k, np.uint64)
                for w in range(k):
                    h = mix(h + found[first[short] + w])
                key.append(h)
                key_row.append(short)
        key, key_row = np.concatenate(key), np.concatenate(key_row)
        order = np.lexsort((key, key_row))
        key, key_row = key[order], key_row[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (key_row[1:] != key_row[:-1])])
        keys.append(key[new])
        at.append(key_row[new] + i)
    return np.concatenate(keys), np.searchsorted(np.concatenate(at), np.arange(rows + 1))


def _digests(keys: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, from two sums over mixed members."""
    n = np.diff(bounds).astype(np.uint64)
    out = []
    for salt in (U(0x2545F4914F6CDD1D), U(0x9E6C63D0876A9A47)):
        total = np.concatenate([[U(0)], np.cumsum(mix(keys * salt + salt), dtype=np.uint64)])
        out.append(mix((total[bounds[1:]] - total[bounds[:-1]]) ^ (n * salt)).view(np.int64))
    return out[0], out[1]


def _first_pass(rows: DataFrame, n: int) -> DataFrame:
    """kind 0: id, size and digest of each row's set; kind 1: shingles seen twice or more in a task, and how often; kind 2: those of sampled rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, some = KeyCounter(1_000_000), KeyCounter(500_000)
        names = ["kind", "id", "n", "d1", "d2"]

        def counts_of(counter: KeyCounter, kind: int, least: int, id_type: pa.DataType) -> pa.RecordBatch:
            keys, counts = counter.take()
            keys, counts = keys[counts >= least], counts[counts >= least]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.nulls(len(keys), id_type), pa.array(counts), pa.array(keys.view(np.int64)), pa.array(np.zeros(len(keys), np.int64))], names=names)

        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            data, offs = byte_view(batch.column(1))
            for i, j in slices(offs):
                keys, bounds = shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], n)
                seen.add(keys)
                picked = np.flatnonzero(batch.column(2).to_numpy(zero_copy_only=False)[i:j])
                some.add(np.concatenate([keys[:0], *(keys[bounds[k] : bounds[k + 1]] for k in picked)]))
                d1, d2 = _digests(keys, bounds)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(j - i, np.int32)), batch.column(0).slice(i, j - i), pa.array(np.diff(bounds)), pa.array(d1), pa.array(d2)], names=names)
                if seen.full:
                    yield counts_of(seen, 1, 2, id_type)
                if some.full:
                    yield counts_of(some, 2, 1, id_type)
        if id_type is not None:
            yield counts_of(seen, 1, 2, id_type)
            yield counts_of(some, 2, 1, id_type)

    sampled = F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0
    return rows.select("id", "text", sampled.alias("sampled")).mapInArrow(run, f"kind int, id {rows.schema['id'].dataType.simpleString()}, n long, d1 long, d2 long")


def least_matches(n):
    """The smallest l of a set of n shingles; grows with n, so a partner's l is bounded by one's own size."""
    return 1 + n // 25


def _fewest(n: str, percent: int):
    """A bound on the shingles that a document of n shares with any linked one, among their prefixes."""
    return F.floor(F.floor(F.col(n) * percent / 100) / 25) + 1


def prefixes(keys: np.ndarray, bounds: np.ndarray, hot: HashedArray, often: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each set its prefix: shingles, rows, estimated frequencies and places of them, and each row's l."""
    sizes = np.diff(bounds)
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = hot.find(keys)
    df = np.where(at >= 0, often[at], 0) if len(often) else np.zeros(len(keys), np.int64)
    order = np.lexsort((keys, df, row))  # keys are hashes: no order of their own
    keys, df = keys[order], df[order]
    need = (percent * sizes + 99) // 100
    met = np.concatenate([[0], np.cumsum(np.where(df > 0, df, UNKNOWN))])
    base = least_matches(sizes)
    best, cost = base.copy(), np.full(len(sizes), np.inf)
    for k in STEPS:
        matches = np.minimum(base * k, np.maximum(need, base))
        end = bounds[:-1] + np.minimum(sizes - need + matches, sizes)
        f = met[end] - met[bounds[:-1]]
        now = ROW * (end - bounds[:-1]) + MEET * f + VERIFY * sizes * f / matches
        best, cost = np.where(now < cost, matches, best), np.minimum(now, cost)
    length = np.where(sizes > 0, np.minimum(sizes - need + best, sizes), 0)
    place = np.arange(len(keys)) - bounds[:-1][row]
    taken = place < length[row]
    return keys[taken], row[taken], df[taken], place[taken], best


def _slot(bits: int, column: str = "id"):
    return F.pmod(F.xxhash64(column), F.lit(bits)).cast("int")


def _bits_for(ids: int) -> int:
    """The size of a bitmap for so many ids: a power of two, or 0 where none of bounded size would help."""
    return 0 if 4 * ids > MOST_BITS else max(LEAST_BITS, 1 << (4 * ids - 1).bit_length())


def _bitmap(ids: DataFrame, bits: int):
    """A broadcast bitmap of the slots that the only column's ids have."""
    words = ids.select(_slot(bits, ids.columns[0]).alias("s")).groupBy(F.shiftright("s", 5).alias("w")).agg(F.expr("bit_or(shiftleft(1L, s & 31))").alias("b")).toArrow()
    out = np.zeros(bits >> 5, np.uint32)  # bits / 32 rows at most
    out[words.column("w").to_numpy()] = words.column("b").to_numpy().astype(np.uint32)
    del words
    trim()
    return ids.sparkSession.sparkContext.broadcast(out)


def _picked(rows: DataFrame, wanted: DataFrame, bits: int):
    """Rows of wanted ids, and a few others: what to read, and what to do with its batches.

    A bitmap spares the shuffle of all rows; where it would be too large, a join does it.
    """
    if not bits:
        return rows.join(wanted.select(F.col(wanted.columns[0]).alias("id")).distinct(), "id", "left_semi").select(rows.columns), lambda batch: batch
    bitmap = _bitmap(wanted, bits)

    def pick(batch: pa.RecordBatch) -> pa.RecordBatch:
        return _marked(batch, bitmap, batch.num_columns - 1).select(batch.schema.names[:-1])

    return rows.withColumn("slot", _slot(bits)), pick


def _near(rows: DataFrame, wanted: DataFrame, bits: int) -> DataFrame:
    read, pick = _picked(rows, wanted, bits)
    return read.mapInArrow(lambda batches: (pick(batch) for batch in batches), rows.schema) if bits else read


def _marked(batch: pa.RecordBatch, bitmap, slot: int) -> pa.RecordBatch:
    """The rows whose slot is in the bitmap: all that were put in, and a few others."""
    s = batch.column(slot).to_numpy(zero_copy_only=False)
    return batch.take(pa.array(np.flatnonzero((bitmap.value[s >> 5] >> (s & 31).astype(np.uint32)) & 1)))


def _prefix_rows(rows: DataFrame, firsts: DataFrame, shared, n: int, percent: int, bits: int) -> DataFrame:
    """The prefix of the set of each row of firsts, and of some that copy another's."""
    read, pick = _picked(rows.select("id", "text"), firsts, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_keys, hot_n = shared.value
        hot = HashedArray(hot_keys)
        often = hot_n[hot.order]
        done: set[int] = set()  # equal sets of one task send their prefix once
        for batch in batches:
            batch = pick(batch)
            data, offs = byte_view(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j in slices(offs):
                keys, bounds = shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], n)
                d1, _ = _digests(keys, bounds)
                fresh = np.ones(j - i, bool)
                for k, d in enumerate(d1.tolist()):
                    fresh[k] = d not in done
                    done.add(d)
                if len(done) > 500_000:
                    done.clear()
                sizes = np.diff(bounds)
                token, row, df, place, need = prefixes(keys, bounds, hot, often, percent)
                keep = fresh[row]
                token, row, df, place = token[keep], row[keep], df[keep], place[keep]
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(ids[i:j][row]), pa.array(sizes[row].astype(np.int32)), pa.array(need[row].astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(df >= HEAVY)], names=["token", "id", "n", "need", "place", "heavy"])

    return read.mapInArrow(run, "token long, id long, n int, need int, place int, heavy boolean")


def _sets_of(rows: DataFrame, wanted: DataFrame, n: int, bits: int) -> DataFrame:
    """id and set of the wanted ids, and of a few others."""
    read, pick = _picked(rows.select("id", "text"), wanted, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = pick(batch)
            data, offs = byte_view(part.column(1))
            for i, j in slices(offs):
                keys, bounds = shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], n)
                yield pa.RecordBatch.from_arrays([part.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(keys.view(np.int64)))], names=["id", "items"])

    return read.mapInArrow(run, "id long, items array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) with ``linked``, by their whole sets."""
    a, b = (sets.select(F.col("id").alias(c), F.col("items").alias(f"{c}_items")) for c in ("u", "v"))
    both = F.size(F.array_intersect("u_items", "v_items"))
    union = F.size("u_items") + F.size("v_items") - both
    return pairs.select("u", "v").join(a, "u").join(b, "v").select("u", "v", (100 * both >= percent * union).alias("linked"))


def _long_enough(a: str, b: str, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _links(lists: DataFrame, sets: DataFrame, ws: Workspace, percent: int, bits: int) -> DataFrame:
    """Verified links (u, v) that join all classes of the documents in lists."""
    # first the leader that each list already names; a document tries the one that it shares most with
    met = ws.write(lists.filter(F.col("id") != F.col("lead")).groupBy("id", "lead", "n", "lead_n").agg(F.count("*").alias("shared")), "met")
    pairs = met.filter(_long_enough("n", "lead_n", percent) & (F.col("shared") >= _fewest("n", percent))).groupBy("id").agg(F.max_by("lead", F.struct("shared", "lead")).alias("v"))
    got = ws.write(_verified(pairs.select(F.col("id").alias("u"), "v"), sets, percent), "verified-0")
    tried, links = got.select("u", "v"), got.filter("linked").select("u", "v")
    found = ws.write(components(links, ws, "round-0"), "classes-0")
    # a list whose documents are in one class has no more to tell
    of = lambda c: found.select(F.col("id").alias(c), F.col("component").alias(f"{c}_class"))
    split = met.select("id", "lead").join(of("id"), "id", "left").join(of("lead"), "lead", "left").filter(F.coalesce("id_class", "id") != F.coalesce("lead_class", "lead")).select("id", "lead")
    left = lists.join(split, ["id", "lead"], "left_semi").select("token").union(lists.filter("heavy").select("token")).distinct()
    lists = ws.write(lists.join(left, "token", "left_semi").select("token", "id", "n", "need", "place"), "lists-left")
    # then every pair of two classes that shares enough
    rows = ws.write(lists.join(found, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component"), "lists-classed")
    mixed = rows.groupBy("token").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.ceil(F.count("*") / LIST_ROWS).alias("blocks")).filter("low < high").select("token", "blocks")
    rows = rows.join(mixed, "token").withColumn("block", F.pmod(F.xxhash64("id", "token"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).select("token", "low", "high", "block", "id", "n", "need", "place", "c")
    a, b = rows.alias("a"), rows.alias("b")
    # Sizes a and b need an overlap of o, so l shingles are shared among the first a - o + l and b - o + l.
    # Pairs are seeded with l = 1, the shortest prefixes, then must have their own l.
    need, overlap = F.least("a.need", "b.need"), F.ceil(percent * (F.col("a.n") + F.col("b.n")) / (100 + percent))
    same_list = (F.col("a.token") == F.col("b.token")) & (F.col("a.low") == F.col("b.low")) & (F.col("a.high") == F.col("b.high"))
    once = (F.col("a.id") > F.col("b.id")) & ((F.col("a.low") == F.col("a.high")) | (F.col("a.block") != F.col("b.block")))
    seeds = (F.col("a.place") < F.col("a.n") - overlap + 1) & (F.col("b.place") < F.col("b.n") - overlap + 1)
    near = a.join(b, same_list & once & (F.col("a.c") != F.col("b.c")) & _long_enough("a.n", "b.n", percent) & seeds)
    near = near.select(F.col("a.id").alias("u"), F.col("b.id").alias("v"), need.alias("need"), (F.col("a.n") - overlap + need).alias("x"), (F.col("b.n") - overlap + need).alias("y")).distinct()
    held = lists.groupBy("id").agg(F.collect_list(F.struct("place", "token")).alias("p"))
    near = near.join(held.withColumnsRenamed({"id": "u", "p": "p"}), "u").join(held.withColumnsRenamed({"id": "v", "p": "q"}), "v")
    early = lambda p, n: F.transform(F.filter(p, lambda t: t["place"] < F.col(n)), lambda t: t["token"])
    pairs = near.filter(F.size(F.array_intersect(early("p", "x"), early("q", "y"))) >= F.col("need")).select("u", "v")
    before = tried.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    pairs = ws.write(pairs.join(before, ["u", "v"], "left_anti"), "pairs")
    ids = pairs.select("u").union(pairs.select("v"))
    got = ws.write(_verified(pairs, _near(sets, ids, bits), percent), "verified-1")
    return links.union(got.filter("linked").select("u", "v"))


def pair_counts(keys: np.ndarray, bounds: np.ndarray, left: np.ndarray, right: np.ndarray, weight: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Of each set the weight of other sets that link to it, over all pairs of a left and a right one.

    Where left and right are the same sets, each pair counts once for either end.
    """
    sizes, k = np.diff(bounds), len(bounds) - 1
    _, column, times = np.unique(keys, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(k), sizes)
    shared = times[column] > 1  # others meet nowhere
    column, row = column[shared], row[shared]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    column = np.cumsum(np.concatenate([[False], column[1:] != column[:-1]])) if len(column) else column
    both = np.zeros((len(left), len(right)))
    columns = int(column[-1]) + 1 if len(column) else 1
    width = min(columns, max(1, CELLS // k))
    ends = np.searchsorted(column, np.arange(0, columns + width, width))
    for step, (i, j) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        cells = np.zeros((k, width), np.float32)
        cells[row[i:j], column[i:j] - step * width] = 1
        both += cells[left] @ cells[right].T
    a, b = sizes[left][:, None], sizes[right][None, :]
    link = (100 * both >= percent * (a + b - both)) & (left[:, None] != right[None, :])
    out = np.zeros(k, np.int64)
    out[left] += link @ weight[right]
    if not np.array_equal(left, right):
        out[right] += link.T @ weight[left]
    return out


def _tally(members: DataFrame, items: DataFrame, ws: Workspace, percent: int, bits: int) -> DataFrame:
    """rep and n: the weight of the different sets that link to each member (rep, id, n, weight, component)."""
    # sizes of a link lie in one band or in two that follow each other
    band = F.floor(F.log(F.col("n")) / (float(np.log(max(100 / percent, 1.01))) * (1 + 1e-9)))
    members = members.withColumn("band", band)
    bands = members.groupBy("component", "band").agg(F.count("*").alias("sets"), F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_SETS)).alias("m"))
    bands = ws.write(bands, "bands")
    same = bands.filter("sets > 1").select("component", F.col("band").alias("x"), F.col("band").alias("y"), F.col("m").alias("y_m"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("i"))
    same = same.select("component", "x", "i", "y", F.explode(F.sequence("i", F.col("y_m") - 1)).alias("j"))
    a, b = bands.select("component", F.col("band").alias("x"), F.col("m").alias("x_m")), bands.select("component", F.col("band").alias("y"), F.col("m").alias("y_m"))
    next_to = a.join(b, "component").filter(F.col("y") == F.col("x") + 1)
    next_to = next_to.select("component", "x", "y", "y_m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("x_m") - 1)).alias("i"))
    next_to = next_to.select("component", "x", "i", "y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("y_m") - 1)).alias("j"))
    unit = ["component", "x", "i", "y", "j"]
    units = same.union(next_to)
    left = units.select(*unit, F.col("x").alias("band"), F.col("i").alias("slot"), F.lit(0).alias("side"))
    right = units.filter("x != y or i != j").select(*unit, F.col("y").alias("band"), F.col("j").alias("slot"), F.lit(1).alias("side"))
    dealt = members.join(bands.drop("sets"), ["component", "band"]).withColumn("slot", F.pmod(F.xxhash64("rep"), F.col("m"))).drop("m", "n")
    placed = ws.write(dealt.join(left.union(right), ["component", "band", "slot"]).select(*unit, "side", "rep", "id", "weight"), "units")
    whole = placed.join(_near(items, placed.select("id").distinct(), bits), "id").select(*unit, "side", "rep", "weight", "items")

    def counts(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        lists = table.column("items").combine_chunks()
        bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        keys = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        side, weight = (table.column(c).to_numpy() for c in ("side", "weight"))
        first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        x, i, y, j = (table.column(c)[0].as_py() for c in unit[1:])
        got = pair_counts(keys, bounds, first, first if (x, i) == (y, j) else second, weight, percent)
        return pa.RecordBatch.from_arrays([table.column("rep").combine_chunks(), pa.array(got)], names=["rep", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy() for c in range(len(unit))], 1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if held and tuple(key[i]) != last:
                    yield counts(held)
                    held = []
                held.append(batch.slice(i, j - i))
                last = tuple(key[i])
        if held:
            yield counts(held)

    found = whole.repartition(*unit).sortWithinPartitions(*unit).mapInArrow(run, "rep long, n long")
    return ws.write(found.groupBy("rep").agg(F.sum("n").alias("n")), "tally")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, percent: int = PERCENT) -> DataFrame:
    """id, n_shingles and component_id of each row."""
    return _join(docs, id_col, text_col, n, percent, False)


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, percent: int = PERCENT) -> DataFrame:
    """id, n_shingles, component_id and n_links of each row: how many other documents link to it."""
    return _join(docs, id_col, text_col, n, percent, True)


def _join(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int, count: bool) -> DataFrame:
    spark = docs.sparkSession
    ws = Workspace(spark, "jaccard_join")
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    first = ws.write(_first_pass(rows, n), "first", ["kind"])
    found = first.filter("kind = 0")
    names = None
    if _ambiguous(found):
        rows = ws.write(rows.withColumn("name", F.col("id")).withColumn("id", F.monotonically_increasing_id()), "rows")
        names = rows.select("id", "name")
        rows = rows.select("id", "text")
        first = ws.write(_first_pass(rows, n), "first-of-rows", ["kind"])
        found = first.filter("kind = 0")
    bits = _bits_for(found.count())
    sets = found.filter("n > 0")
    of_set = ws.write(sets.groupBy("d1", "d2", "n").agg(F.min("id").alias("rep")), "sets")
    told = first.filter("kind > 0").groupBy("d1", "kind").agg(F.sum("n").alias("n")).filter("n > 1").withColumn("n", F.when(F.col("kind") == 1, F.col("n")).otherwise(F.col("n") * SAMPLE))
    top = told.groupBy("d1").agg(F.max("n").alias("n")).orderBy(F.desc("n"), "d1").limit(HOT).toArrow()
    hot = tuple(top.column(c).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("d1", "n"))
    shared = spark.sparkContext.broadcast((hot[0].view(np.uint64), hot[1]))
    del top
    # one row of each set, as far as a bitmap can tell; a few copies do no harm
    tokens = _prefix_rows(rows, of_set.select("rep"), shared, n, percent, bits).withColumn("salt", F.when(F.col("heavy"), F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(0).cast("int"))
    own = Window.partitionBy("token", "salt")
    lists = tokens.withColumns({"times": F.count("*").over(own), "lead": F.min(F.struct("id", "n")).over(own)}).filter(F.col("heavy") | (F.col("times") > 1))
    shared_rows = ws.write(lists.select("token", "id", "n", "need", "place", "heavy", F.col("lead.id").alias("lead"), F.col("lead.n").alias("lead_n")), "shared")
    enough = shared_rows.groupBy("id", "n").agg(F.count("*").alias("t")).filter(F.col("t") >= _fewest("n", percent))
    lists = ws.write(_near(shared_rows, enough.select("id"), bits), "lists")
    ws.drop("shared")
    items = ws.write(_sets_of(rows, lists.select("id").distinct(), n, bits), "items")
    links = _links(lists, items, ws, percent, bits)
    # links between first documents of sets: copies take their set's class afterwards
    rep = ws.write(sets.join(of_set, ["d1", "d2", "n"]).select("id", "rep").distinct(), "reps")
    first_of = lambda c: rep.select(F.col("id").alias(c), F.col("rep").alias(f"{c}_rep"))
    links = links.join(first_of("u"), "u").join(first_of("v"), "v").select(F.col("u_rep").alias("u"), F.col("v_rep").alias("v")).filter("u != v")
    reached = ws.write(components(links, ws, "final").select(F.col("id").alias("rep"), "component"), "classes")
    classed = rep.join(reached, "rep", "left").select("id", F.coalesce("component", "rep").alias("component"))
    member = classed.withColumnRenamed("id", "member")
    out = found.join(member, F.col("id") == F.col("member"), "left").select("id", "n", F.coalesce("component", "id").alias("component"))
    counted = ["n_links"] if count else []
    if count:
        # rows of one id and set are one document
        docs_of = sets if names is None else sets.join(names.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"))
        name = F.col("id" if names is None else "name")
        weights = docs_of.groupBy("d1", "d2", "n").agg((F.count_distinct(name) + F.count_if(name.isNull())).alias("weight"))
        weighed = ws.write(of_set.join(weights, ["d1", "d2", "n"]).select("d1", "d2", "n", "rep", "weight"), "weighed")
        # a set's prefix may have come from a copy of its first document
        sent = items.select("id").join(rep, "id").groupBy("rep").agg(F.min("id").alias("id"))
        members = sent.join(weighed, "rep").join(reached, "rep").select("rep", "id", "n", "weight", "component")
        tally = _tally(ws.write(members, "members"), items, ws, percent, bits).withColumnRenamed("n", "other")
        links_of = weighed.join(tally, "rep", "left").select("rep", (F.col("weight") - 1 + F.coalesce("other", F.lit(0))).alias("n_links"))
        links_of = rep.join(links_of, "rep").select(F.col("id").alias("member"), "n_links")
        out = out.join(links_of, F.col("id") == F.col("member"), "left").select("id", "n", "component", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    if names is not None:
        named = out.join(names, "id")
        least = named.groupBy("component").agg(F.min("name").alias("least"))
        out = named.join(least, "component").select(F.col("name").alias("id"), "n", F.col("least").alias("component"), *counted)
    return out.select(F.col("id").cast(id_type).alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.col("component").cast(id_type).alias("component_id"), *counted)


def _ambiguous(found: DataFrame) -> bool:
    """Whether an id is null or has rows with different sets."""
    return bool(found.groupBy("id").agg(F.count_distinct("n", "d1", "d2").alias("m")).filter("m > 1 or id is null").take(1))
