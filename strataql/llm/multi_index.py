"""Exact top-k search over binary codes by incremental multi-index hashing, in DataFrame functions.

A vector's code has the signs of its first 64 values. The code falls into four segments of 16 bits,
each with an index of its own. Radius by radius, every open query probes each index with all values
at just that distance from its segment. After radius r, all codes within 4(r+1)-1 bits are known,
so a query is closed once its k nearest rows lie within that; the last radius is 16 and complete.

Equal codes are one entry, with its k smallest ids, and equal query codes one query, so copies cost
nothing more. Ties go to the smaller id; a query finds its own row too.

The index is written once as a table in buckets by segment, value and list part, and every radius
reads it as it lies: probes alone are shuffled. A value that more than ``LIST`` codes share is cut
into parts by a hash of the code, and its probes go to every part; how many parts a value has is a
table of at most 4 * 65,536 rows, which is broadcast.

Defined cases: null vectors and null ids aren't indexed and have no answer; missing, null and NaN
values count as no sign; with fewer than k rows all are returned; repeated rows count each; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace

SEGMENTS, WIDTH = 4, 16
#: codes in a part of a value's list, on average, and entries in a bucket of the index
LIST, BUCKET = 4096, 1_000_000


def segments(vector: Column) -> Column:
    """The four segments of a vector's code: bit i of segment s is the sign of value 16s+i."""

    def bit(s: int, i: int) -> Column:
        v = F.get(vector, F.lit(s * WIDTH + i))
        return F.when((v > 0) & ~F.isnan(v), 1 << i).otherwise(0)

    def segment(s: int) -> Column:
        out = bit(s, 0)
        for i in range(1, WIDTH):
            out = out + bit(s, i)
        return out

    return F.array(*(segment(s) for s in range(SEGMENTS)))


def code_of(parts: Column) -> Column:
    out = parts[0].cast("long")
    for s in range(1, SEGMENTS):
        out = out.bitwiseOR(F.shiftleft(parts[s].cast("long"), s * WIDTH))
    return out


def _masks(radius: int) -> Column:
    """All 16-bit values with so many bits, as one array literal (a node for each would swell the plan)."""
    values = ",".join(str(sum(1 << i for i in c)) for c in combinations(range(WIDTH), radius))
    return F.split(F.lit(values), ",").cast("array<int>")


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query id, neighbor id, distance and rank (from 1) of the k nearest rows of each query row."""
    ws = Workspace(vectors.sparkSession, "multi_index")
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), is_query.alias("asked"), segments(F.col(vec_col)).alias("parts"))
    rows = ws.write(rows.withColumn("code", code_of(F.col("parts"))), "codes")
    rank = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    entries = ws.write(rows.select("code", "id").withColumn("rank", rank).filter(F.col("rank") <= k).groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")), "entries")
    part = lambda s: F.shiftrightunsigned("code", s * WIDTH).bitwiseAND(F.lit(0xFFFF)).cast("int")
    probe = lambda df: df.select("*", F.posexplode(F.array(*(part(s) for s in range(SEGMENTS)))).alias("segment", "value"))
    sizes = probe(entries).groupBy("segment", "value").agg(F.ceil(F.count("*") / LIST).cast("int").alias("parts")).filter("parts > 1")
    sizes = ws.write(sizes, "sizes")  # SEGMENTS * 2**WIDTH rows at most
    parts = F.coalesce("parts", F.lit(1))
    listed = probe(entries).join(F.broadcast(sizes), ["segment", "value"], "left").withColumn("part", F.pmod(F.xxhash64("code"), parts).cast("int")).drop("parts")
    spark = vectors.sparkSession
    table = f"multi_index_{uuid.uuid4().hex}"
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), SEGMENTS * entries.count() // BUCKET + 1)
    where = ["segment", "value", "part"]
    listed.repartition(buckets, *where).write.option("path", f"{ws.path}/index").bucketBy(buckets, *where).sortBy(*where).saveAsTable(table)
    index = spark.table(table)
    asked = rows.filter("asked").select("code").distinct()
    best = Window.partitionBy("query").orderBy("distance", F.col("ids")[0])
    open_, closed, found = ws.write(asked.withColumnRenamed("code", "query"), "asked"), None, None
    for radius in range(WIDTH + 1):
        probes = probe(open_.select("query", F.col("query").alias("code"))).select("query", "segment", F.explode(F.transform(_masks(radius), lambda m: F.col("value").bitwiseXOR(m))).alias("value"))
        probes = probes.join(F.broadcast(sizes), ["segment", "value"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
        # each query makes thousands of probes, which no estimate shows: neither side may be broadcast
        hits = probes.join(index.hint("merge"), where).select("query", "code", "ids", F.bit_count(F.col("query").bitwiseXOR(F.col("code"))).alias("distance"))
        if found is not None:
            hits = hits.union(found.join(open_, "query", "left_semi").select(hits.columns))
        # a code may be met by several segments or radii: one row of each, then the k best
        hits = hits.dropDuplicates(["query", "code"]).withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k).drop("place")
        found = ws.write(hits, f"found-{radius}")
        within = F.sum(F.when(F.col("distance") <= SEGMENTS * (radius + 1) - 1, F.size("ids")).otherwise(0))
        state = found.groupBy("query").agg(within.alias("within"))
        done = state.filter((F.col("within") >= k) | F.lit(radius == WIDTH)).select("query")
        now = found.join(done, "query", "left_semi")
        closed = now if closed is None else closed.union(now)
        open_ = ws.write(open_.join(done, "query", "left_anti"), f"open-{radius}")
        if not open_.take(1):
            break
    spark.sql(f"DROP TABLE IF EXISTS {table}")  # the rows found are tables of their own
    near = closed.select("query", "distance", F.explode("ids").alias("neighbor")).withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("distance", "neighbor"))).filter(F.col("rank") <= k)
    out = rows.filter("asked").select(F.col("id").alias(id_col), F.col("code").alias("query")).join(near, "query")
    return out.select(id_col, F.col("neighbor").alias("neighbor_id"), F.col("distance").cast("int").alias("distance"), "rank")
