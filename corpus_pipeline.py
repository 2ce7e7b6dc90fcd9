"""Corpus pipeline: quality classifier, quality rules, near-duplicate classes, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. The first three
return the columns of documents, the last one a row for each packed piece. A null or repeated row,
an empty table and extra columns are treated as each operator's module says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataql.llm import compression_classifier, jaccard_join, packing
from strataql.llm.quality_rules import quality_rules
from strataql.llm.queries import TOKENIZER, tokenizer_path
from strataql.llm.workspace import Workspace

#: the classifier, the rules' bands, the classes and the plan aren't expressible in SQL
ORACLE_SQL = None


def _semi(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of docs whose id and text are among kept (id, mark)."""
    right = kept.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).distinct()
    return docs.join(right, docs["doc_id"].eqNullSafe(right["_id"]) & (F.xxhash64(docs["text"]) == right["_mark"]), "left_semi")


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier scores 0.5 or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return compression_classifier.keep_good(docs, compression_classifier.fit(docs, labels, F.lit(True)))


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their language's perplexity bands."""
    return _semi(docs, quality_rules(docs).filter("kept"))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each near-duplicate class, once."""
    found = jaccard_join.classes(docs)
    first = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_id")).distinct()
    rows = docs.join(first, docs["doc_id"].eqNullSafe(first["_id"]), "left_semi")
    mark = "_mark"
    while mark in docs.columns:
        mark += "_"
    return rows.withColumn(mark, F.xxhash64("text")).dropDuplicates(["doc_id", mark]).drop(mark)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents and their places in sequences."""
    return packing.pack(docs, tokenizer_path(TOKENIZER))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier_stage),
    ("quality_rules", quality_rules_stage),
    ("ngram_jaccard_join", jaccard_stage),
    ("pattern_packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = ws.write(stage(spark, docs, sf_dir), name)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
