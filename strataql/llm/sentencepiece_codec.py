"""SentencePiece encoding and decoding with an Aho-Corasick automaton and a Viterbi search.

The automaton holds all ordinary pieces. One pass over a text gives, at each place, the pieces that
end there (the automaton follows its output links); each relaxes the best score of its end. Of
equal scores the longer last piece wins. A character that no piece covers costs ``UNKNOWN_PENALTY``
below the lowest score and becomes byte pieces, or the unknown piece where the model has none.

This is the unigram search: with a model trained as BPE it takes the same pieces and scores, and
maximises their sum instead of merging by rank. Where no piece goes on after a space mark inside
it, texts fall into chunks at space marks and line feeds, whose ids a cache keeps.

Defined cases: a null text is encoded as null and an empty one as no ids; null ids decode to null;
U+2581 in a text decodes to a space; repeated rows are encoded each; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunk_cache import ChunkCache
from .textbatch import byte_view, slices
from .workspace import small_batches

MARK = "▁"
UNKNOWN_PENALTY = 10.0


class Codec:
    """Pieces and scores of a model file, with its automaton; made once in each Python worker."""

    def __init__(self, path: str, cache_limit: int = 250_000):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i) for i in range(n)]
        self.special = {i for i in range(n) if special[i]}
        self.byte_id = {int(self.pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.id_byte = {i: b for b, i in self.byte_id.items()}
        self.unknown = model.unk_id()
        scores = {i: model.get_score(i) for i in range(n) if not special[i]}
        self.unknown_score = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for i, s in scores.items():
            self.automaton.add_word(self.pieces[i], (len(self.pieces[i]), s, i))
        self.automaton.make_automaton()
        inner = any(MARK in p.lstrip(MARK) for i, p in enumerate(self.pieces) if i in scores)
        feed = any("\n" in self.pieces[i] for i in scores)
        self.chunks = None if inner else re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+" if feed else f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n").findall
        self.cache = ChunkCache(self._encode_chunks, cache_limit)

    def viterbi(self, text: str) -> list[int]:
        """Ids of a text with marks for spaces."""
        n = len(text)
        worst, unknown = -1e300, self.unknown_score
        best, size, ident = [0.0] + [worst] * n, [0] * (n + 1), [0] * (n + 1)
        done = 0  # places up to here have their best score
        for last, (length, score, i) in self.automaton.iter(text) if len(self.automaton) else ():
            end = last + 1
            while done < end - 1:
                done += 1
                if best[done - 1] + unknown > best[done]:
                    best[done], size[done], ident[done] = best[done - 1] + unknown, 1, -1
            s = best[end - length] + score
            if s > best[end] or (s == best[end] and length > size[end]):
                best[end], size[end], ident[end] = s, length, i
        while done < n:
            done += 1
            if best[done - 1] + unknown > best[done]:
                best[done], size[done], ident[done] = best[done - 1] + unknown, 1, -1
        ids, at = [], n
        while at:
            i = ident[at]
            if i >= 0:
                ids.append(i)
            elif self.byte_id:
                ids += [self.byte_id.get(b, self.unknown) for b in reversed(text[at - 1 : at].encode())]
            else:
                ids.append(self.unknown)
            at -= size[at]
        return ids[::-1]

    def _encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [self.viterbi(c) for c in chunks]
        return np.array([i for g in got for i in g], np.int32), np.array([len(g) for g in got], np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row and where each text's end."""
        if self.chunks is None:
            got = [self.viterbi(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
            return np.array([i for g in got for i in g], np.int32), np.cumsum([len(g) for g in got], dtype=np.int64)
        chunks: list[str] = []
        ends = np.zeros(len(texts), np.int64)
        for k, t in enumerate(texts):
            if t:
                chunks += self.chunks(MARK + t.replace(" ", MARK))
            ends[k] = len(chunks)
        return self.cache.ids(chunks, ends)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: runs of byte pieces read as UTF-8 (broken ones as U+FFFD), one leading space dropped."""
        out, raw = [], bytearray()
        for i in ids:
            b = self.id_byte.get(i)
            if b is not None:
                raw.append(b)
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if i == self.unknown:
                out.append(" ⁇ ")
            elif i not in self.special:
                out.append(self.pieces[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        text = "".join(out).replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=1)
def cached_codec(path: str) -> Codec:
    """Kept for the Python worker's life."""
    return Codec(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ids (array<int>) of each row."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = cached_codec(path)
        for batch in batches:
            for i, j, ids, ends in _encoded(codec, batch.column(1)):
                part = batch.slice(i, j - i)
                empty = part.column(1).is_null().to_numpy(zero_copy_only=False)
                offs = pa.array(np.append(0, ends).astype(np.int32), mask=np.append(empty, False))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offs, pa.array(ids))], names=["id", "ids"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", id_col)


def _encoded(codec: Codec, col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    _, offs = byte_view(col)
    for i, j in slices(offs):
        yield i, j, *codec.encode(col.slice(i, j - i).to_pylist())


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and text of each row of ids."""
    small_batches(rows.sparkSession)
    rows = rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = cached_codec(path)
        for batch in batches:
            texts = [None if ids is None else codec.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_ids, ids_crc32 (little-endian unsigned 32-bit), n_bytes_ids and lossless of each row.

    Encodes and decodes in one pass, so that ids needn't be written: piece texts are joined in numpy
    order and compared with the text.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = cached_codec(path)
        names = [" ⁇ " if i == codec.unknown else "" if i in codec.special else p.replace(MARK, " ") for i, p in enumerate(codec.pieces)]
        is_byte = np.zeros(len(names), bool)
        is_byte[list(codec.id_byte)] = True
        for batch in batches:
            n_ids, crc, n_byte, same = [], [], [], []
            for i, j, ids, ends in _encoded(codec, batch.column(1)):
                begin = 0
                raw = np.concatenate([[0], np.cumsum(is_byte[ids])])
                for text, end in zip(batch.column(1).slice(i, j - i).to_pylist(), ends.tolist(), strict=True):
                    own = ids[begin:end]
                    n_ids.append(end - begin)
                    crc.append(zlib.crc32(own.astype("<u4").tobytes()))
                    n_byte.append(int(raw[end] - raw[begin]))
                    back = codec.decode(own.tolist()) if n_byte[-1] else "".join(map(names.__getitem__, own.tolist()))[1:]
                    same.append(back == (text or "").replace(MARK, " "))
                    begin = end
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n_ids, crc, n_byte)), pa.array(same, pa.bool_())], names=["id", "n_ids", "ids_crc32", "n_byte_ids", "lossless"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_ids long, ids_crc32 long, n_byte_ids long, lossless boolean").withColumnRenamed("id", id_col)
