"""Connected components by alternating large and small stars, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

ROUNDS = 100


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Links each node's larger (or smaller) neighbours to the smallest node near it."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if larger else both.filter(F.col("v") < F.col("u"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    told = near.join(least, "u")
    moved = told.filter(F.col("v") > F.col("u")) if larger else told
    out = moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not larger:
        out = out.union(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def _unfinished(state: DataFrame) -> DataFrame:
    """Nodes that hang on two others, or that others hang on while they hang on one: none once all are stars."""
    ends = state.select(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).union(state.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).filter("hangs > 1 or (hangs = 1 and holds = 1)")


def components(edges: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """(id, component): for each node of edges (u, v), the smallest node that it reaches.

    Nodes without an edge aren't listed. Every round is written, so lineage doesn't grow. It ends when
    every component is a star around its smallest node, and fails if that takes more than ``ROUNDS``.
    """
    ordered = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter(F.col("u") != F.col("v")).distinct()
    state = ws.write(ordered, f"{name}-0")
    for step in range(1, ROUNDS + 1):
        if not _unfinished(state).take(1):
            break
        state = ws.write(_star(_star(state, larger=True), larger=False), f"{name}-{step}")
        ws.drop(f"{name}-{step - 1}")
    else:
        if _unfinished(state).take(1):
            raise RuntimeError(f"components aren't found after {ROUNDS} rounds")
    return state.select(F.col("u").alias("id"), F.col("v").alias("component")).union(state.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
