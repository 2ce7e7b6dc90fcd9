"""Quality rules: counts of a text's form, then perplexity bands by language.

The n-gram model is modified Kneser-Ney over bytes, counted by Spark over all rows and kept in
sorted hash arrays (ngram_model). A row's perplexity is taken per byte. Each language has a lower
and an upper band around its median, as wide as ``width`` times the distance between its quartiles
on that side (``least_spread`` of log perplexity at least), from all rows that pass the base rules.
The quartiles are those of a histogram of log perplexity with cells of ``CELL``, so that bands depend
on the rows alone and not on how they are dealt out;
for a text of n bytes both are wider by sqrt(SHORT / n), as short texts scatter more.

Defined cases: a null text is empty and fails the base rules; a null language is a language of its
own; repeated rows are judged each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ngram_model as M
from .textbatch import SPACE, by_row, byte_view, lines_with_words, slices, windows, words
from .workspace import Workspace, trim

ORDER = 3
MAX_ENTRIES = 3_000_000
WIDTH = 6.0
LEAST_SPREAD = 0.02
SHORT = 100
CELL = 0.001
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: code points: bytes that aren't continuations; inside words: that aren't spaces
CHAR = np.array([(b & 0xC0) != 0x80 for b in range(256)]) & ~SPACE
WINDOW = 8


def _sums(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offs[1:]] - total[offs[:-1]]


def form_counts(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each row."""
    n = len(offs) - 1
    out = {k: np.zeros(n, np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    for i, j in slices(offs):
        part, at, m = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], j - i
        found, row = words(part, at)
        out["n_words"][i:j] = np.bincount(row, minlength=m)
        out["word_chars"][i:j] = _sums(CHAR[part], at)
        out["n_symbols"][i:j] = _sums(SYMBOLS[part], at)
        lines, line_row = lines_with_words(part, at)
        _, first = np.unique(by_row(lines, line_row), return_index=True)
        out["n_dup_lines"][i:j] = np.bincount(line_row, minlength=m) - np.bincount(line_row[first], minlength=m)
        keys, begin = windows(found, row, WINDOW)
        keys = by_row(keys, row[begin])
        order = np.sort(keys)
        twice = np.unique(order[1:][order[1:] == order[:-1]])
        if len(twice):
            place = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
            begin = begin[twice[place] == keys]
            cover = np.zeros(len(found) + 1, np.int64)
            np.add.at(cover, begin, 1)
            np.add.at(cover, begin + WINDOW, -1)
            out["n_repeat_words"][i:j] = np.bincount(row[np.cumsum(cover[:-1]) > 0], minlength=m)
    return out


def measure(docs: DataFrame, ws: Workspace, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """id, mark (a hash of the text), lang, the form counts and log_ppl of each row, written."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = ws.write(M.count_grams(rows.select("text"), order), "counts")
    id_type = rows.schema["id"].dataType.simpleString()
    names = ["id", "mark", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_sum", "n_grams"]
    schema = f"id {id_type}, mark long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_sum double, n_grams long"
    out = None
    for number, shard in enumerate(M.kn_shards(counts, order, max_entries)):
        model = spark.sparkContext.broadcast(shard)

        def score(batches: Iterator[pa.RecordBatch], model=model, first: bool = number == 0) -> Iterator[pa.RecordBatch]:
            table = model.value
            for batch in batches:
                data, offs = byte_view(batch.column(3))
                form = form_counts(data, offs) if first else dict.fromkeys(names[3:8], np.zeros(len(offs) - 1, np.int64))
                value, n = M.sums_by_row(table.log, table, data, offs)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(form[k]) for k in names[3:8]), pa.array(value), pa.array(n)], names=names)

        part = ws.write(rows.mapInArrow(score, schema), f"measured-{number}")
        model.unpersist()
        del shard, model, score
        trim()
        if out is None:
            out = part
        else:  # equal rows have equal sums, so one of them is enough
            more = part.groupBy("id", "mark").agg(F.first("log_sum").alias("more")).withColumnsRenamed({"id": "id2", "mark": "mark2"})
            out = out.join(more, out["id"].eqNullSafe(more["id2"]) & (out["mark"] == more["mark2"])).withColumn("log_sum", F.col("log_sum") + F.col("more")).drop("id2", "mark2", "more")
    return out.withColumn("log_ppl", -F.col("log_sum") / F.col("n_grams")).drop("log_sum")


def quartiles(cells: DataFrame) -> DataFrame:
    """of and q, the three quartiles, from (of, cell, n): the middle of the cell in which each lies."""
    up_to = F.sum("n").over(Window.partitionBy("of").orderBy("cell"))
    total = F.sum("n").over(Window.partitionBy("of"))
    ranked = cells.withColumns({"up_to": up_to, "total": total})
    at = lambda share: F.min(F.when(F.col("up_to") >= share * F.col("total"), (F.col("cell") + 0.5) * CELL))
    return ranked.groupBy("of").agg(F.array(*(at(share) for share in (0.25, 0.5, 0.75))).alias("q"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, width: float = WIDTH, least_spread: float = LEAST_SPREAD, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """The form counts, base_failed, log_ppl, the language's band and kept of each row."""
    ws = Workspace(docs.sparkSession, "quality_rules")
    rows = measure(docs, ws, id_col, text_col, lang_col, order, max_entries)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    cells = rows.filter(~F.col("base_failed")).groupBy(F.col("lang").alias("of"), F.floor(F.col("log_ppl") / CELL).alias("cell")).agg(F.count("*").alias("n"))
    q = quartiles(cells)
    below, above = (F.greatest(a - b, F.lit(least_spread)) for a, b in ((F.col("q")[1], F.col("q")[0]), (F.col("q")[2], F.col("q")[1])))
    bands = q.select("of", F.col("q")[1].alias("middle"), (width * below).alias("below"), (width * above).alias("above"))
    wider = 1 + F.sqrt(SHORT / F.col("n_grams"))
    out = rows.join(bands, rows["lang"].eqNullSafe(bands["of"]), "left").withColumns({"ppl_low": F.col("middle") - F.col("below") * wider, "ppl_high": F.col("middle") + F.col("above") * wider})
    kept = ~F.col("base_failed") & F.col("log_ppl").between(F.col("ppl_low"), F.col("ppl_high"))
    return out.select(F.col("id").alias(id_col), "mark", F.col("lang").alias(lang_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "log_ppl", "ppl_low", "ppl_high", F.coalesce(kept, F.lit(False)).alias("kept"))
