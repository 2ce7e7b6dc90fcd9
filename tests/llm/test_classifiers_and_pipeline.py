"""Held-out accuracy of the classifiers, and the pipeline end to end."""

import re
import zlib

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from strataql.llm import compression_classifier, language_id, queries


@pytest.fixture(scope="module")
def big():
    return "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark, big):
    got = queries.op7_language_id(spark, big).join(spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(got) == 1000
    held = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    for r in got:
        assert 0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert (r.lang_pred == "und") == (not re.search(r"[^\W\d_]", r.text))


def test_language_odd_rows(spark):
    rows = [(1, "der die das und ist nicht", "de"), (2, "the and of is not a", "en"), (3, None, "en"), (4, "123 !!", "de"), (5, "das und der", None), (6, "x" * 3_000_000 + " the", "en"), (None, "the of", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"score": F.lit(1), "letters": F.lit(0)})
    model = language_id.fit(df)
    got = {r.doc_id: r for r in language_id.predict(df, model).collect()}
    assert got[1].lang_pred == got[5].lang_pred == "de" and got[2].lang_pred == got[None].lang_pred == "en"
    assert got[3].lang_pred == got[4].lang_pred == "und" and got[3].score == 0 and got[6].lang_pred in ("de", "en")
    untaught = language_id.fit(df.filter("false"))
    assert {r.lang_pred for r in language_id.predict(df, untaught).collect()} == {"und"}
    assert language_id.predict(df.filter("false"), model).count() == 0


def test_quality_held_out_accuracy(spark, big):
    got = queries.op8_compression_classifier(spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").filter("held_out").collect()
    good, bad = ([r.score for r in got if r.quality == y] for y in (1, 0))
    wins = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert wins > 0.9
    assert sum(r.predicted == r.quality for r in got) >= 0.88 * len(got)


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a fine text about cats and dogs. " * 3), (2, "@@ ## $$ %% " * 9), (3, None), (4, ""), (4, ""), (None, "x")], "doc_id long, text string").withColumns({"y": F.lit(1), "score": F.lit("s")})
    for labels in ([], [(1, 1)], [(1, None), (2, 0), (99, 1)]):
        model = compression_classifier.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"), F.lit(True))
        got = compression_classifier.score(docs, model).collect()
        assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    many = docs.crossJoin(spark.range(8).withColumnRenamed("id", "k")).withColumn("doc_id", F.col("doc_id") * 100 + F.col("k"))
    labels = many.filter("doc_id is not null").select("doc_id", F.when(F.col("doc_id") < 200, 1).otherwise(0).alias("quality"))
    model = compression_classifier.fit(many, labels, F.lit(True))
    by = {r.doc_id: r.score for r in compression_classifier.score(docs, model).collect()}
    assert by[1] > by[2]
    assert compression_classifier.score(docs.filter("false"), model).count() == 0


def test_copies_and_long_rows_of_a_language(spark):
    """A hundred thousand equal rows are one row of the sample; a language of long texts alone is learned."""
    copies = spark.range(100_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same and the same").alias("text"), F.lit("en").alias("lang"))
    others = spark.createDataFrame([(i, f"der die {i} das und {i * 7} nicht", "de") for i in range(40)] + [(900 + i, "et la le pas " * 9000 + str(i), "fr") for i in range(3)], "doc_id long, text string, lang string")
    rows = copies.union(others)
    assert {(r.lang, r["count"]) for r in language_id._sample(rows.withColumnRenamed("doc_id", "id"), 30).groupBy("lang").count().collect()} == {("en", 1), ("de", 30), ("fr", 3)}
    model = language_id.fit(rows, max_rows=30)
    assert model.langs == ["de", "en", "fr"]
    found = language_id.predict(spark.createDataFrame([(1, "la le"), (2, "the same"), (3, "das und")], "doc_id long, text string"), model)
    assert [r.lang_pred for r in found.orderBy("doc_id").collect()] == ["fr", "en", "de"]


def test_copies_and_long_rows_of_a_class(spark, monkeypatch):
    """Repeated rows, repeated labels and many texts of one id reach the driver once; long rows teach by pieces."""
    copies = spark.range(100_000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("@# $% "), (F.col("id") % 5).cast("string")).alias("text"))
    good = spark.createDataFrame([(100 + i, f"a fine and sober text {i} " * 9000) for i in range(4)], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 0)] * 50 + [(8, 0)] + [(100 + i, 1) for i in range(4)], "doc_id long, quality int")
    docs = copies.union(good).union(spark.createDataFrame([(8, "%% && ##")], "doc_id long, text string"))
    seen = []
    monkeypatch.setattr(compression_classifier, "_dictionary", lambda samples, size: seen.append(samples) or b"".join(samples)[-size:])
    model = compression_classifier.fit(docs, labels, F.lit(True))
    assert sorted(len(x) for x in seen) == [1, 2] and all(len(t) <= compression_classifier.MAX_BYTES for x in seen for t in x)
    assert model.good and model.bad
    text = bytes(range(256)) * 4096
    assert len(compression_classifier.pieces(text)) == compression_classifier.MAX_BYTES and compression_classifier.pieces(b"ab") == b"ab"


def plain_stages(spark, docs, sf):
    """The ids that each stage keeps, recomputed row by row."""
    import numpy as np
    import pyarrow as pa
    import zstandard
    from test_joins_and_search import brute
    from test_text_and_models import brute_form, kn

    from strataql.llm import ngram_model as M
    from strataql.llm import textbatch as T
    from strataql.llm.quality_rules import CELL, LEAST_SPREAD, SHORT, WIDTH

    rows = docs.collect()
    model = compression_classifier.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"), F.lit(True))
    size = lambda d, b: len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d)).compress(b))

    def good(t):
        b = (t or "").encode()
        x = (size(model.bad, b) - size(model.good, b)) / len(b) if b else 0.0
        return model.slope * x + model.bias >= 0

    rows = [r for r in rows if good(r.text)]
    yield "quality_classifier", {r.doc_id for r in rows}
    table = kn([r.text or "" for r in rows], 3)
    measured = []
    for r in rows:
        (total,), (n,) = M.sums_by_row(table.log, table, *T.byte_view(pa.array([r.text], pa.string())))
        words, _, _, _, repeated = brute_form(r.text or "")
        measured.append((r, -total / n, n, words < 20 or 100 * repeated > 30 * words))
    bands = {}
    for lang in {r.lang for r in rows}:
        cells = sorted(int(np.floor(x / CELL)) for r, x, _, bad in measured if r.lang == lang and not bad)
        if cells:
            low, middle, high = ((cells[-(-len(cells) * k // 4) - 1] + 0.5) * CELL for k in (1, 2, 3))
            bands[lang] = middle, WIDTH * max(middle - low, LEAST_SPREAD), WIDTH * max(high - middle, LEAST_SPREAD)
    wide = lambda n: 1 + (SHORT / n) ** 0.5
    rows = [r for r, x, n, bad in measured if not bad and bands[r.lang][0] - bands[r.lang][1] * wide(n) <= x <= bands[r.lang][0] + bands[r.lang][2] * wide(n)]
    yield "quality_rules", {r.doc_id for r in rows}
    first = {c for _, _, c in brute([(r.doc_id, r.text) for r in rows])}
    rows = [r for r in rows if r.doc_id in first]
    yield "ngram_jaccard_join", first
    yield "pattern_packing", {r.doc_id: r.text for r in rows}


def test_pipeline_equals_plain_stages(spark, sf):
    import tokenizers

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plain = dict(plain_stages(spark, docs, sf))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).checkpoint() if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else stage(spark, docs, sf)
        assert {r.doc_id for r in docs.select("doc_id").collect()} == plain[name], name
    encoder = tokenizers.Tokenizer.from_file(queries.tokenizer_path(queries.TOKENIZER))
    got = {}
    for r in corpus_pipeline.run(spark, sf).collect():
        got.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    assert set(got) == set(plain["pattern_packing"])
    for i, text in plain["pattern_packing"].items():
        n = len(encoder.encode(text or "", add_special_tokens=False).ids) + 1
        assert sorted(got[i]) == [(k, 4096 * k, min(4096, n - 4096 * k)) for k in range(-(-n // 4096))]


def test_pipeline_keeps_columns_of_any_name(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns({"_mark": F.lit(3), "_id": F.lit("x"), "id": F.lit(1), "component_id": F.lit(2)})
    out = corpus_pipeline.jaccard_stage(spark, docs, sf)
    assert out.columns == docs.columns and {r["_mark"] for r in out.select("_mark").distinct().collect()} == {3}


def test_pipeline_stages(spark, sf, tmp_path):
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "ngram_jaccard_join", "pattern_packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = str(tmp_path / name)
        stage(spark, docs, sf).write.parquet(out)
        docs = spark.read.parquet(out)
        kept = [r.doc_id for r in docs.select("doc_id").collect()]
        assert set(kept) <= before and kept
        if name != "pattern_packing":
            assert docs.columns == columns and len(kept) == len(set(kept))
        before = set(kept)
    final = {r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").collect()}
    assert final == before


def test_pipeline_stages_survive_odd_tables(spark, sf):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0)]
    odd = spark.createDataFrame(rows, spark.read.parquet(f"{sf}/documents.parquet").schema)
    for df in (odd, odd.filter("false")):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, df, sf).collect()
