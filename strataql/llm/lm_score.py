"""LM scoring by prediction by partial matching, with a unigram word model as the base.

``lm_score`` learns from the rows marked as training, counts over all of them, and scores every
row. The trie of byte contexts is pretrained: see ngram_model for escapes, exclusion and shards.
Words frequent in training (``hot_words`` of them at most) have their counts broadcast; all other
occurrences meet their counts in a join, pre-aggregated by row.

Defined cases: a null text is empty (it still has its end); a null id counts as the text ''; repeated
rows are scored each; without training rows all bytes are equally likely; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ngram_model as M
from .textbatch import HashedArray, KeyCounter, byte_view, grams, slices, words
from .workspace import Workspace, trim

ORDER = 5
MAX_ENTRIES = 3_000_000
HOT_WORDS = 1 << 17


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text modulo n; a null id counts as ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def _training_counts(train: DataFrame, order: int) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        byte_grams, vocabulary = KeyCounter(), KeyCounter()
        n_words = n_rows = 0
        for batch in batches:
            data, offs = byte_view(batch.column(0))
            n_rows += len(offs) - 1
            for keys, _, _ in grams(data, offs, order):
                byte_grams.add(keys)
                if byte_grams.full:
                    yield M.count_batch(M.GRAM, byte_grams.take())
            for i, j in slices(offs):
                found, _ = words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], lower=True)
                n_words += len(found)
                vocabulary.add(found)
                if vocabulary.full:
                    yield M.count_batch(M.WORD, vocabulary.take())
        yield M.count_batch(M.GRAM, byte_grams.take())
        yield M.count_batch(M.WORD, vocabulary.take())
        yield M.count_batch(M.TOTAL, (np.arange(2, dtype=np.uint64), np.array([n_words, n_rows])))

    return M.summed(train.mapInArrow(count, M.COUNT_SCHEMA))


def lm_score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, max_entries: int = MAX_ENTRIES, hot_words: int = HOT_WORDS) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of each row.

    ``held_out``: rows not to learn from. ``max_entries`` bounds a broadcast part of the model,
    ``hot_words`` the broadcast word counts.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "lm_score")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    counts = ws.write(_training_counts(rows.filter(~F.col("held_out")).select("text"), order), "counts", ["kind"])
    sums = {r[0]: r[1] for r in counts.filter(F.col("kind") == M.TOTAL).select("key", "n").collect()}
    n_words, n_rows = sums.get(0, 0), sums.get(1, 0)
    vocabulary = counts.filter(F.col("kind") == M.WORD).select("key", "n")
    held = {r[0]: r[1] for r in counts.groupBy("kind").count().collect()}
    n_distinct = held.get(M.WORD, 0)
    rows = rows.withColumn("uid", F.monotonically_increasing_id())
    if held.get(M.GRAM, 0) > max_entries:  # several passes must agree on the rows' numbers
        rows = ws.write(rows, "rows")
    total, kinds = n_words + n_rows, n_distinct + (n_rows > 0)
    denominator = total + 0.5 * (kinds + 1)
    top = vocabulary.orderBy(F.desc("n"), "key").limit(hot_words).toArrow()
    hot_keys, hot_n = (top.column(c).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "n"))
    rest = n_distinct > len(hot_keys)
    least = int(hot_n.min()) if len(hot_n) else 0
    common = spark.sparkContext.broadcast((hot_keys.view(np.uint64), hot_n))
    end_log, unknown_log = np.log10((n_rows + 0.5) / denominator), np.log10(0.5 / denominator)
    shards = M.ppm_shards(counts.filter(F.col("kind") == M.GRAM), order, max_entries)
    scored = None
    for number, shard in enumerate(shards):
        first = number == 0
        model = spark.sparkContext.broadcast(shard)

        def score(batches: Iterator[pa.RecordBatch], first: bool = first, model=model) -> Iterator[pa.RecordBatch]:
            table = model.value
            hot = HashedArray(common.value[0])
            known_log = np.append(np.log10((common.value[1][hot.order] + 0.5) / denominator), unknown_log)
            for batch in batches:
                data, offs = byte_view(batch.column(2))
                n = len(offs) - 1
                value, _ = M.sums_by_row(table.log10, table, data, offs)
                tokens, known, base = np.ones(n, np.int64), np.full(n, int(n_rows > 0), np.int64), np.full(n, end_log)
                rare = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32))]
                for i, j in slices(offs) if first else ():
                    found, row = words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], lower=True)
                    at = hot.find(found)
                    tokens[i:j] += np.bincount(row, minlength=j - i)
                    base[i:j] += np.bincount(row, known_log[at], j - i)
                    known[i:j] += np.bincount(row[at >= 0], minlength=j - i)
                    if rest:
                        found, row = found[at < 0], row[at < 0]
                        o = np.lexsort((found, row))
                        found, row = found[o], row[o]
                        new = np.flatnonzero(np.concatenate([[True], (found[1:] != found[:-1]) | (row[1:] != row[:-1])])) if len(found) else np.zeros(0, np.int64)
                        rare.append((found[new], row[new] + i, np.diff(np.append(new, len(found))).astype(np.int32)))
                keys, row, tf = (np.concatenate(x) for x in zip(*rare, strict=True))
                bounds = pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (keys.view(np.int64), tf)]
                yield pa.RecordBatch.from_arrays([batch.column(3), batch.column(0), batch.column(1), *(pa.array(x) for x in (tokens, known, base, value)), *lists, pa.array(np.full(n, number, np.int32))], names=["uid", "id", "held_out", "tokens", "known", "base", "value", "keys", "tf", "shard"])

        id_type = rows.schema["id"].dataType.simpleString()
        schema = f"uid long, id {id_type}, held_out boolean, tokens long, known long, base double, value double, keys array<long>, tf array<int>, shard int"
        part = ws.write(rows.mapInArrow(score, schema), f"scored-{number}")
        model.unpersist()
        del shard, model, score
        trim()
        # Later shards add to the first one's rows.
        scored = part if scored is None else scored.join(part.select("uid", F.col("value").alias("more")), "uid").withColumn("value", F.col("value") + F.col("more")).drop("more")
    out = scored.select("uid", "id", "held_out", "tokens", "known", "base", "value")
    if rest:
        rare = scored.select("uid", F.inline(F.arrays_zip("keys", "tf")).alias("key", "tf"))
        cold = vocabulary.filter(F.col("n") <= least)
        gain = F.log10((F.col("n") + 0.5) / F.lit(0.5))
        # A row's rare words miss the broadcast table and were charged as unknown; those known in training get back the difference.
        found = rare.join(cold, "key").groupBy("uid").agg(F.sum(F.col("tf") * gain).alias("gain"), F.sum("tf").alias("found"))
        out = out.join(found, "uid", "left").withColumns({"base": F.col("base") + F.coalesce("gain", F.lit(0.0)), "known": F.col("known") + F.coalesce("found", F.lit(0))})
    return out.select(
        F.col("id").alias(id_col), "held_out", F.col("tokens").alias("n_tokens"), F.col("known").cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("value").alias("score"),
    )
