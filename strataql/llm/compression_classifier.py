"""Quality classifier by compression: dictionaries of good and of bad text.

A zstandard dictionary is trained from labelled text of each class. A text's feature is the size
under the bad dictionary less the size under the good one, divided by its bytes; a logistic curve,
fitted on sampled rows that no dictionary has seen and weighted to the true shares of the classes,
makes it a probability. The sample is bounded: ``max_rows`` labelled ids of each class, those of the
smallest hash, with one text each, of which ``max_bytes`` bytes are learned from; a longer text gives
them in ``PIECES`` pieces spread evenly over all of it. Scoring compresses whole texts.

Defined cases: null and empty texts have feature 0; null labels, null ids and labels of absent ids
are ignored; repeated labels count each in the classes' shares and once in the sample; of several
texts of an id the one of smallest hash is learned from; with one class alone (or none) every score
is that class's share (0.5); repeated rows are scored each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textbatch import byte_view
from .workspace import small_batches, trim

MAX_ROWS = 3000
MAX_BYTES, PIECES = 32_768, 32
DICT_BYTES = 112_640
LEVEL = 3


@dataclass
class Model:
    good: bytes
    bad: bytes
    slope: float
    bias: float


def _dictionary(samples: list[bytes], size: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too little text to train from: its own end serves as content
        return b"".join(samples)[-size:]


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        make = lambda d: zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d) if d else None)
        self.good, self.bad = make(model.good), make(model.bad)

    def features(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        view, out = memoryview(np.ascontiguousarray(data)), np.zeros(len(offs) - 1)
        for i, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
            if b > a:
                text = view[a:b]
                out[i] = (len(self.bad.compress(text)) - len(self.good.compress(text))) / (b - a)
        return out

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.model.slope * self.features(data, offs) + self.model.bias, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Newton's method with a small ridge on the slope of the scaled feature."""
    scale = float(x.std()) or 1.0
    a = np.stack([x / scale, np.ones(len(x))], 1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        grad = a.T @ (w * (y - p)) - np.array([1e-3, 0]) * beta
        hess = (a * (w * p * (1 - p))[:, None]).T @ a + np.diag([1e-3, 1e-9])
        step = np.linalg.solve(hess, grad)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0] / scale), float(beta[1])


def _learned(max_bytes: int):
    """Of each id and label of a task the text of smallest hash, or the pieces of it to learn from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        schema = None
        for batch in batches:
            schema = pa.schema([*list(batch.schema)[:3], pa.field("text", pa.binary())])
            for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                mark = batch.column(2)[i].as_py()
                if key not in held or mark < held[key][0]:
                    held[key] = mark, pieces(batch.column(3)[i].as_py().encode(), max_bytes)
        if held:
            columns = [[k[0] for k in held], [k[1] for k in held], [v[0] for v in held.values()], [v[1] for v in held.values()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def pieces(text: bytes, max_bytes: int = MAX_BYTES) -> bytes:
    """The text, or max_bytes of it in pieces at even distances from its start to its end."""
    if len(text) <= max_bytes:
        return text
    size = max(1, max_bytes // PIECES)
    starts = np.linspace(0, len(text) - size, max_bytes // size).astype(np.int64).tolist()
    return b"".join(text[a : a + size] for a in starts)


def fit(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Model:
    """``train``: a condition on the id column of labels for the rows to learn from."""
    small_batches(docs.sparkSession)
    known = labels.filter(train & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    shares = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    different = known.distinct()
    sampled = [different.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(max_rows) for y in (0, 1)]
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.octet_length("text") > 0)
    met = texts.join(F.broadcast(sampled[0].union(sampled[1])), "id").select("id", "y", F.xxhash64("text").alias("mark"), "text")
    one = met.mapInArrow(_learned(max_bytes), f"id {met.schema['id'].dataType.simpleString()}, y int, mark long, text binary").groupBy("id", "y").agg(F.min_by("text", "mark").alias("text"))
    got = one.select("y", "text", F.xxhash64("id").alias("h")).toArrow()  # 2 * max_rows rows of max_bytes at most
    rows = sorted(zip(got.column("h").to_pylist(), got.column("y").to_pylist(), got.column("text").to_pylist(), strict=True))
    total = sum(shares.values())
    by = {y: [t for _, c, t in rows if c == y] for y in (0, 1)}
    if min(map(len, by.values())) < 2:
        share = 0.5 if not total else (shares.get(1, 0) + 1e-3) / (total + 2e-3)
        return Model(b"", b"", 0.0, float(np.log(share / (1 - share))))
    model = Model(_dictionary(by[1][::2], DICT_BYTES), _dictionary(by[0][::2], DICT_BYTES), 0.0, 0.0)
    rest = [(t, y) for y in (0, 1) for t in by[y][1::2]]
    x = Scorer(model).features(*byte_view(pa.array([t for t, _ in rest], pa.binary())))
    y = np.array([y for _, y in rest])
    w = np.where(y == 1, shares[1] / total / (y == 1).sum(), shares[0] / total / (y == 0).sum()) * len(y)
    model.slope, model.bias = _logistic(x, y, w)
    del got, rows, by, rest
    trim()
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of each row."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scorer.scores(*byte_view(batch.column(1))))], names=["id", "score"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, that score ``least`` or more."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            yield batch.filter(pa.array(scorer.scores(*byte_view(batch.column(at))) >= least))

    return docs.mapInArrow(run, docs.schema)
