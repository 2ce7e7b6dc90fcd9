"""Full-text search over a postings table: boolean and prefix queries, phrases, NEAR, and bm25.

Postings are one row for each term of each document, with its positions; every query operator is a
filter, a join or an aggregation of them, so a rare term touches few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def postings(docs: DataFrame, id_col: str, text_col: str, tokenizer: str = "unicode") -> DataFrame:
    """(doc, term, positions, tf); tokenizers: unicode (letters and digits, lower case), ascii, trigram."""
    text = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    if tokenizer == "trigram":
        terms = F.when(F.char_length(text) >= 3, F.transform(F.sequence(F.lit(1), F.char_length(text) - 2), lambda i: F.substr(text, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))
    else:
        pattern = r"[^\p{L}\p{N}]+" if tokenizer == "unicode" else r"[^a-z0-9]+"
        terms = F.filter(F.split(text, pattern), lambda w: w != "")
    rows = docs.select(F.col(id_col).alias("doc"), F.posexplode(terms).alias("at", "term"))
    return rows.groupBy("doc", "term").agg(F.array_sort(F.collect_list("at")).alias("positions")).withColumn("tf", F.size("positions"))


def lengths(posts: DataFrame) -> DataFrame:
    return posts.groupBy("doc").agg(F.sum("tf").alias("length"))


def with_term(posts: DataFrame, term: str, prefix: bool = False) -> DataFrame:
    """Documents that hold a term, with its positions."""
    hit = F.col("term").startswith(term) if prefix else F.col("term") == term
    return posts.filter(hit).groupBy("doc").agg(F.flatten(F.collect_list("positions")).alias("positions"))


def all_of(posts: DataFrame, terms: list[str]) -> DataFrame:
    return posts.filter(F.col("term").isin(terms)).groupBy("doc").agg(F.count_distinct("term").alias("n")).filter(F.col("n") == len(set(terms))).select("doc")


def any_of(posts: DataFrame, terms: list[str]) -> DataFrame:
    return posts.filter(F.col("term").isin(terms)).select("doc").distinct()


def none_of(docs: DataFrame, posts: DataFrame, terms: list[str]) -> DataFrame:
    """docs (doc) without any of the terms."""
    return docs.join(any_of(posts, terms), "doc", "left_anti")


def phrase(posts: DataFrame, terms: list[str]) -> DataFrame:
    """Documents where the terms follow one another, with how often."""
    starts = None
    for i, t in enumerate(terms):
        own = with_term(posts, t).withColumn("k", F.lit(i)).select("doc", F.transform("positions", lambda p: p - F.col("k")).alias("s"))
        starts = own if starts is None else starts.join(own.withColumnRenamed("s", "more"), "doc").select("doc", F.array_intersect("s", "more").alias("s"))
    return starts.select("doc", F.size("s").alias("n")).filter("n > 0")


def near(posts: DataFrame, a: str, b: str, distance: int = 10) -> DataFrame:
    """Documents where two terms stand at most ``distance`` words apart."""
    x, y = with_term(posts, a).withColumnRenamed("positions", "x"), with_term(posts, b).withColumnRenamed("positions", "y")
    close: Column = F.exists("x", lambda p: F.exists("y", lambda q: F.abs(p - q) - 1 <= distance))
    return x.join(y, "doc").filter(close).select("doc")


def bm25(posts: DataFrame, terms: list[str]) -> DataFrame:
    """(doc, score) of documents that hold any of the terms; lower is better, as in the dialect."""
    sizes = lengths(posts)
    stats = sizes.agg(F.count("*").alias("docs"), F.avg("length").alias("mean"))
    hits = posts.filter(F.col("term").isin(terms))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    scored = hits.join(F.broadcast(df), "term").join(sizes, "doc").crossJoin(F.broadcast(stats))  # one row each, and as many as there are terms
    idf = F.greatest(F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return scored.groupBy("doc").agg((-F.sum(part)).alias("score"))


def highlight(text: Column, terms: list[str], opening: str = "<b>", closing: str = "</b>") -> Column:
    import re

    pattern = r"(?i)(?<![\p{L}\p{N}])(" + "|".join(re.escape(t) for t in terms) + r")(?![\p{L}\p{N}])"
    return F.regexp_replace(text, pattern, f"{opening}$1{closing}")


def snippet(text: Column, terms: list[str], words: int = 16, opening: str = "<b>", closing: str = "</b>") -> Column:
    """A run of words around the first match, highlighted."""
    parts = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    clean = F.transform(parts, lambda w: F.lower(F.regexp_replace(w, r"[^\p{L}\p{N}]", "")))
    first = F.array_min(F.filter(F.array(*(F.array_position(clean, t) for t in terms)), lambda p: p > 0))
    start = F.greatest(F.coalesce(first, F.lit(1)) - words // 2, F.lit(1)).cast("int")
    return highlight(F.array_join(F.slice(parts, start, F.lit(words)), " "), terms, opening, closing)
