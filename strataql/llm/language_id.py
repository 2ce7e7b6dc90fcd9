"""Language identification by nearest centroids of TF-IDF n-gram vectors.

A text's vector: its byte 1- to 3-grams (A-Z lower-cased, any run of ASCII bytes that aren't letters
read as one space, so that symbols don't pass for a language) hashed to ``DIMS`` places,
log(1 + count) times the inverse document frequency, length 1. The frequencies are counted over all training rows.
Each language gets ``clusters`` centroids by spherical k-means over a bounded sample: up to
``max_rows`` different rows, those of smallest hash of id and text. A sampled text, of any length, is
counted whole where it lies, so that only vectors reach the driver. The prediction is
the language of the nearest centroid by cosine. ``rejected`` marks texts that lie further from it
than all but one in ``REJECT`` of its own sample; their nearest language is reported still.

Defined cases: ``und`` with score 0 for a null text or one without a letter, or if nothing was
learned; training rows with null language or empty or null text are not learned from; repeated rows
are one row of the sample and predicted each; a tie between languages goes to the one that sorts
first; a language whose sampled rows hold no letter has no centroid; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textbatch import BLOCK, LOWER, U, byte_view, slices
from .workspace import small_batches, trim

DIMS = 4096
CLUSTERS = 3
MAX_ROWS = 400
#: rows by hash that are looked at for the sample, as a multiple of it: copies among them count once
LOOK = 8
REJECT = 200
GROUP = 64


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # (languages x clusters, DIMS)
    owner: np.ndarray  # language of each centroid
    least: np.ndarray  # cosine below which a centroid rejects


_LETTERS = np.where((np.arange(256) >= 128) | ((LOWER >= 97) & (LOWER <= 122)), LOWER, 32).astype(np.uint8)


def _letters(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows' letters, lowered, with one space for each run of other bytes."""
    low = _LETTERS[data]
    kept = low != 32
    kept[1:] |= low[:-1] != 32
    first = offs[:-1][offs[:-1] < offs[1:]]
    kept[first] = True
    return low[kept], np.concatenate([[0], np.cumsum(kept, dtype=np.int64)])[offs]


def _slots(low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    two = (low[:-1].astype(np.uint32) * np.uint32(0x9E3779B1) + low[1:].astype(np.uint32) * np.uint32(0x85EBCA6B)) >> np.uint32(20)
    three = (low[:-2].astype(np.uint32) * np.uint32(0xC2B2AE35) + low[1:-1].astype(np.uint32) * np.uint32(0x27D4EB2F) + low[2:].astype(np.uint32) * np.uint32(0x165667B1)) >> np.uint32(20)
    return low.astype(np.int64), two.astype(np.int64), three.astype(np.int64)


def counts(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Counts of the rows' grams in groups of few rows; a long row is counted block by block."""
    for i0, j0 in slices(offs):
        part0, at0 = _letters(data[offs[i0] : offs[j0]], offs[i0 : j0 + 1] - offs[i0])
        yield from _counted(part0, at0, i0)


def _counted(data: np.ndarray, offs: np.ndarray, base: int) -> Iterator[tuple[int, int, np.ndarray]]:
    rows = len(offs) - 1
    for i in range(0, rows, GROUP):
        j = min(i + GROUP, rows)
        m, out = j - i, np.zeros((j - i) * DIMS, np.int64)
        for a in range(int(offs[i]), int(offs[j]), BLOCK):
            b = min(a + BLOCK, int(offs[j]))
            part = data[a : min(b + 2, int(offs[j]))]
            row = np.repeat(np.arange(m), np.clip(np.minimum(offs[i + 1 : j + 1], a + len(part)) - np.maximum(offs[i:j], a), 0, None))
            for k, slot in enumerate(_slots(part)):
                n = min(len(slot), b - a)
                same = row[:n] == row[k : n + k]
                out += np.bincount((row[:n] * DIMS + slot[:n])[same], minlength=m * DIMS)
        yield base + i, base + j, out.reshape(m, DIMS)


def vectors(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(count).astype(np.float32) * idf
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def _k_means(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from far-apart first members; fewer centroids than k if rows are alike."""
    chosen = [int(np.argmax(x @ x.mean(0)))]
    while len(chosen) < min(k, len(x)):
        near = (x @ x[chosen].T).max(1)
        if near.min() > 0.999:
            break
        chosen.append(int(np.argmin(near)))
    c = x[chosen]
    for _ in range(15):
        own = np.argmax(x @ c.T, 1)
        c = np.stack([x[own == i].sum(0) if (own == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.sqrt((c * c).sum(1, keepdims=True)), 1e-12)
    return c


def _sample(rows: DataFrame, max_rows: int) -> DataFrame:
    """Up to max_rows different rows (lang, id, h, text) of each language, by the smallest hash.

    A threshold from the language's number of different rows (a sketch's, a twentieth off at most, of a
    margin of ``LOOK`` times) leaves few rows before any of them moves; equal rows are dropped first
    within their task, then between tasks.
    """
    h = F.xxhash64("id", "text")
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct(h).alias("n")).select("lang", (F.lit(float(LOOK * max_rows)) / F.col("n")).alias("share"))
    place = F.shiftrightunsigned(h, 11) / float(1 << 53)
    near = rows.withColumn("h", h).join(F.broadcast(sizes), "lang").filter(place < F.col("share")).select("lang", "id", "h", "text")

    def different(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True))
            new = []
            for i, k in enumerate(keys):
                if k not in seen:
                    seen.add(k)
                    new.append(i)
            if new:
                yield batch.take(pa.array(new))

    once = near.mapInArrow(different, near.schema).dropDuplicates(["lang", "h"])
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("rank") <= max_rows).drop("rank")


def _sampled_counts(sample: DataFrame) -> DataFrame:
    """lang, h and the counts of the grams of each sampled text, as slots and times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, count in counts(*byte_view(batch.column(2))):
                row, slot = np.nonzero(count)
                bounds = pa.array(np.searchsorted(row, np.arange(j - i + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (slot.astype(np.int32), count[row, slot].astype(np.int64))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), *lists], names=["lang", "h", "slots", "times"])

    return sample.select("lang", "h", "text").mapInArrow(run, "lang string, h long, slots array<int>, times array<long>")


def fit(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", clusters: int = CLUSTERS, max_rows: int = MAX_ROWS) -> Model:
    """Learns from rows with a language and a text; the model holds clusters vectors for each language."""
    small_batches(train.sparkSession)
    rows = train.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).filter(F.col("lang").isNotNull() & (F.octet_length("text") > 0))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            data, offs = byte_view(batch.column(0))
            n += len(offs) - 1
            for _, _, count in counts(data, offs):
                total += (count > 0).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS + 1)), pa.array(np.append(total, n))], names=["slot", "n"])

    df = {r[0]: r[1] for r in rows.select("text").mapInArrow(frequencies, "slot long, n long").groupBy("slot").agg(F.sum("n")).collect()}
    n = df.get(DIMS, 0)
    idf = np.log((1 + n) / (1 + np.array([df.get(i, 0) for i in range(DIMS)]))).astype(np.float32) + np.float32(0.05)
    by: dict[str, list[tuple[int, np.ndarray]]] = {}
    got = _sampled_counts(_sample(rows, max_rows)).toArrow()  # max_rows vectors a language at most
    for lang, h, slots, times in zip(*(got.column(c).to_pylist() for c in ("lang", "h")), *(got.column(c).combine_chunks() for c in ("slots", "times")), strict=True):
        if len(slots.values):
            x = np.zeros(DIMS, np.int64)
            x[slots.values.to_numpy()] = times.values.to_numpy()
            by.setdefault(lang, []).append((h, vectors(x[None, :], idf)[0]))
    del got
    langs = sorted(by)
    centroids, owner, least = [], [], []
    for place, lang in enumerate(langs):
        x = np.stack([v for _, v in sorted(by[lang], key=lambda row: row[0])])
        c = _k_means(x, clusters)
        sims = x @ c.T
        own = sims.argmax(1)
        for k in range(len(c)):
            mine = np.sort(sims[own == k, k])
            centroids.append(c[k])
            owner.append(place)
            least.append(mine[len(mine) // REJECT] if len(mine) else 0.0)
    trim()
    return Model(langs, idf, np.array(centroids, np.float32).reshape(-1, DIMS), np.array(owner, np.int64), np.array(least, np.float32))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score (the cosine, 0 to 1) and rejected of each row."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letters"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            data, offs = byte_view(batch.column(2))
            n = len(offs) - 1
            best, sim, far = np.full(n, -1), np.zeros(n), np.zeros(n, bool)
            for i, j, count in counts(data, offs) if m.langs else ():
                s = vectors(count, m.idf) @ m.centroids.T
                k = s.argmax(1)
                top = s[np.arange(j - i), k]
                best[i:j], sim[i:j], far[i:j] = m.owner[k], np.clip(top, 0, 1), top < m.least[k]
            named = np.array([*m.langs, "und"], object)
            letters = np.array(batch.column(1).to_pylist(), bool) & (best >= 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(named[np.where(letters, best, -1)], pa.string()), pa.array(np.where(letters, sim, 0.0)), pa.array(far | ~letters)], names=["id", "lang_pred", "score", "rejected"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)
