"""Queries of the reference's operators over the driver's tables, with DuckDB's SQL for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataql import streaming
from strataql.engine import Engine

from . import changes, fulltext, spatial
from .catalog import Q

Query = Callable[[SparkSession, str], DataFrame]
PARAMS = {"params_bound": {"r": 2, "k": 5}}


def _dialect(name: str, text: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark).load(sf_dir)
        if "nation_names" in text:
            engine.register("nation_names", spark.table("nation").select("n_name"))
        return engine.sql(text, PARAMS.get(name))

    return run


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _stock(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """An old table of suppliers and a delta: every third supplier moved up, and new ones."""
    old = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    new = old.filter("s_suppkey % 3 = 0").select(F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey")).otherwise(F.col("s_suppkey") + 100000).alias("s_suppkey"), F.concat("s_name", F.lit("+")).alias("s_name"), (F.col("s_acctbal") + 1).alias("s_acctbal"))
    return old, new


_OLD = "o AS (SELECT s_suppkey, s_name, s_acctbal FROM supplier)"
_NEW = "n AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey ELSE s_suppkey + 100000 END AS s_suppkey, s_name || '+' AS s_name, s_acctbal + 1 AS s_acctbal FROM supplier WHERE s_suppkey % 3 = 0)"
_BOTH = f"WITH {_OLD}, {_NEW}"


_STOCK = (
    "CREATE TABLE stock (s_suppkey BIGINT PRIMARY KEY, s_name TEXT, s_acctbal REAL)",
    "INSERT INTO stock SELECT s_suppkey, s_name, s_acctbal FROM supplier",
    "CREATE VIEW delta AS SELECT CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey ELSE s_suppkey + 100000 END AS s_suppkey, s_name || '+' AS s_name, s_acctbal + 1 AS s_acctbal FROM supplier WHERE s_suppkey % 3 = 0",
)


def _statements(*texts: str) -> Query:
    """What the last of some statements gives, after the stock table and its delta were made."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark).load(sf_dir)
        out = None
        for text in (*_STOCK, *texts):
            out = engine.sql(text)
        return out

    return run


dml_insert = _statements("INSERT INTO stock (s_suppkey, s_name, s_acctbal) SELECT s_suppkey + 1000000, s_name, 7.5 FROM delta")
dml_insert_ignore = _statements("INSERT OR IGNORE INTO stock SELECT * FROM delta")
dml_replace = _statements("REPLACE INTO stock SELECT * FROM delta")
dml_upsert = _statements("INSERT INTO stock SELECT * FROM delta WHERE true ON CONFLICT (s_suppkey) DO UPDATE SET s_acctbal = s_acctbal + excluded.s_acctbal WHERE excluded.s_acctbal > 1000")
dml_update = _statements("UPDATE stock SET s_acctbal = s_acctbal * 2 WHERE s_suppkey % 5 = 0")
dml_update_from = _statements("UPDATE stock SET s_name = d.s_name FROM delta AS d WHERE d.s_suppkey = stock.s_suppkey")
dml_delete_where = _statements("DELETE FROM stock WHERE s_acctbal < 3000")
dml_delete_limit = _statements("DELETE FROM stock WHERE s_acctbal > 0 ORDER BY s_acctbal, s_suppkey LIMIT 10")
dml_returning = _statements("DELETE FROM stock WHERE s_acctbal < 3000 RETURNING s_suppkey, upper(s_name) AS gone")
dml_with = _statements("WITH rich AS (SELECT s_suppkey FROM stock WHERE s_acctbal > 5000) DELETE FROM stock WHERE s_suppkey IN (SELECT s_suppkey FROM rich)")
ddl_table_as = _statements("CREATE TABLE poor AS SELECT s_suppkey, s_name FROM stock WHERE s_acctbal < 0", "SELECT * FROM poor")
ddl_view = _statements("DELETE FROM stock WHERE s_acctbal < 0", "CREATE VIEW names(k, v) AS SELECT s_suppkey, s_name FROM stock", "SELECT v, k FROM names")
ddl_alter = _statements("ALTER TABLE stock ADD COLUMN kind TEXT DEFAULT 'old'", "ALTER TABLE stock RENAME COLUMN s_name TO label", "ALTER TABLE stock DROP COLUMN s_acctbal", "SELECT * FROM stock")
pragma_table_info = _statements("PRAGMA table_info(stock)")
ddl_cascade = _statements(
    "CREATE TABLE part_of (id BIGINT, supplier BIGINT REFERENCES stock(s_suppkey) ON DELETE CASCADE)",
    "INSERT INTO part_of SELECT p_partkey, s_suppkey FROM part JOIN stock ON s_suppkey = p_size",
    "DELETE FROM stock WHERE s_acctbal < 3000",
    "SELECT * FROM part_of",
)


def dml_violations(spark, sf_dir):
    orders, customer = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer")
    return changes.violations(orders, not_null=["o_orderstatus"], unique=[["o_custkey"]], checks={"price": F.col("o_totalprice") > 1000}, references=[("o_custkey", customer.filter("c_custkey > 3"), "c_custkey")])


def changeset_diff(spark, sf_dir):
    old, new = _stock(spark, sf_dir)
    got = changes.changeset(old, changes.insert_or_replace(changes.delete(old, F.col("s_suppkey") % 7 == 0), new, ["s_suppkey"]), ["s_suppkey"])
    return got.select("op", "s_suppkey", F.col("old.s_name").alias("before"), F.col("new.s_name").alias("after"))


def changeset_apply(spark, sf_dir):
    old, new = _stock(spark, sf_dir)
    after = changes.insert_or_replace(old, new, ["s_suppkey"])
    back = changes.invert(changes.changeset(old, after, ["s_suppkey"]))
    return changes.apply_changeset(after, back, ["s_suppkey"])


def changeset_concat(spark, sf_dir):
    old, new = _stock(spark, sf_dir)
    after = changes.insert_or_replace(old, new, ["s_suppkey"])
    last = changes.delete(after, F.col("s_suppkey") > 100000)
    both = changes.combine(changes.changeset(old, after, ["s_suppkey"]), changes.changeset(after, last, ["s_suppkey"]), ["s_suppkey"])
    return both.select("op", "s_suppkey", F.col("new.s_name").alias("after"))


def fts_bm25(spark, sf_dir):
    posts = fulltext.postings(_table(spark, sf_dir, "part"), "p_partkey", "p_name")
    return fulltext.bm25(posts, ["red", "bolt"]).select(F.col("doc").alias("p_partkey"), F.round("score", 9).alias("score"))


def fts_boolean(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    posts = fulltext.postings(part, "p_partkey", "p_name")
    found = fulltext.none_of(fulltext.any_of(posts, ["red", "blue"]), posts, ["ring"])
    return found.select(F.col("doc").alias("p_partkey"))


def fts_phrase_index(spark, sf_dir):
    posts = fulltext.postings(_table(spark, sf_dir, "part"), "p_partkey", "p_name")
    return fulltext.phrase(posts, ["small", "ring"]).select(F.col("doc").alias("p_partkey"), "n")


def fts_highlight(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", fulltext.highlight(F.col("p_name"), ["red"]).alias("h"))


def geo_grid_join(spark, sf_dir):
    place = lambda t, k, n, b: t.select(F.col(k), (F.col(n) + F.lit(0.0)).alias(f"{k}_x"), (F.col(b) / 100).alias(f"{k}_y"))
    a = place(_table(spark, sf_dir, "customer"), "c_custkey", "c_nationkey", "c_acctbal")
    b = place(_table(spark, sf_dir, "supplier"), "s_suppkey", "s_nationkey", "s_acctbal")
    return spatial.within_distance(a, b, 2.0, "c_custkey_x", "c_custkey_y", "s_suppkey_x", "s_suppkey_y").select("c_custkey", "s_suppkey")


def range_join_binned(spark, sf_dir):
    part = _table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    spans = _table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("low"), (F.col("s_acctbal") + 5.0).alias("high"))
    return spatial.range_join(part, spans, "p_retailprice", "low", "high", 50.0).select("s_suppkey", "p_partkey")


def rtree_box(spark, sf_dir):
    rows = _table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("x1"), (F.col("p_size") + 2).alias("x2"), F.col("p_retailprice").alias("y1"), (F.col("p_retailprice") + 10).alias("y2"))
    return spatial.in_box(rows, {"x": ("x1", "x2", 10, 12), "y": ("y1", "y2", 950, 1000)}).select("p_partkey")


def stream_tumbling(spark, sf_dir):
    got = streaming.windowed(_table(spark, sf_dir, "events"), "ts", "1 hour", [F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("v")], keys=["event_type"])
    return got.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", "v")


def stream_sliding(spark, sf_dir):
    got = streaming.windowed(_table(spark, sf_dir, "events"), "ts", "2 hours", [F.count("*").alias("n")], slide="1 hour")
    return got.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("start"), "n")


def stream_sessions(spark, sf_dir):
    got = streaming.sessions(_table(spark, sf_dir, "events"), "ts", "30 minutes", [F.count("*").alias("n")], ["user_id"])
    return got.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


OPERATORS: dict[str, tuple[Query, str]] = {
    "dml_insert": (dml_insert, f"{_BOTH} SELECT * FROM o UNION ALL SELECT s_suppkey + 1000000, s_name, 7.5 FROM n"),
    "dml_insert_ignore": (dml_insert_ignore, f"{_BOTH} SELECT * FROM o UNION ALL SELECT * FROM n WHERE s_suppkey NOT IN (SELECT s_suppkey FROM o)"),
    "dml_replace": (dml_replace, f"{_BOTH} SELECT * FROM o WHERE s_suppkey NOT IN (SELECT s_suppkey FROM n) UNION ALL SELECT * FROM n"),
    "dml_upsert": (dml_upsert, f"{_BOTH} SELECT coalesce(o.s_suppkey, n.s_suppkey) AS s_suppkey, coalesce(o.s_name, n.s_name) AS s_name, CASE WHEN o.s_suppkey IS NULL THEN n.s_acctbal WHEN n.s_acctbal > 1000 THEN o.s_acctbal + n.s_acctbal ELSE o.s_acctbal END AS s_acctbal FROM o FULL JOIN n ON o.s_suppkey = n.s_suppkey"),
    "dml_update": (dml_update, f"WITH {_OLD} SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 5 = 0 THEN s_acctbal * 2 ELSE s_acctbal END AS s_acctbal FROM o"),
    "dml_update_from": (dml_update_from, f"{_BOTH} SELECT o.s_suppkey, coalesce(n.s_name, o.s_name) AS s_name, o.s_acctbal FROM o LEFT JOIN n ON o.s_suppkey = n.s_suppkey"),
    "dml_delete_where": (dml_delete_where, f"WITH {_OLD} SELECT * FROM o WHERE NOT s_acctbal < 3000"),
    "dml_delete_limit": (dml_delete_limit, f"WITH {_OLD} SELECT * FROM o WHERE s_suppkey NOT IN (SELECT s_suppkey FROM o WHERE s_acctbal > 0 ORDER BY s_acctbal, s_suppkey LIMIT 10)"),
    "dml_returning": (dml_returning, "SELECT s_suppkey, upper(s_name) AS gone FROM supplier WHERE s_acctbal < 3000"),
    "dml_with": (dml_with, f"WITH {_OLD} SELECT * FROM o WHERE NOT s_acctbal > 5000"),
    "ddl_table_as": (ddl_table_as, "SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal < 0"),
    "ddl_view": (ddl_view, "SELECT s_name AS v, s_suppkey AS k FROM supplier WHERE NOT s_acctbal < 0"),
    "ddl_alter": (ddl_alter, "SELECT s_suppkey, s_name AS label, 'old' AS kind FROM supplier"),
    "ddl_cascade": (ddl_cascade, "SELECT p_partkey AS id, s_suppkey AS supplier FROM part JOIN supplier ON s_suppkey = p_size WHERE NOT s_acctbal < 3000"),
    "pragma_table_info": (pragma_table_info, "SELECT * FROM (VALUES (0, 's_suppkey', 'BIGINT', 1, NULL, 1), (1, 's_name', 'TEXT', 0, NULL, 0), (2, 's_acctbal', 'REAL', 0, NULL, 0)) AS t(cid, name, type, \"notnull\", dflt_value, pk)"),
    "dml_violations": (dml_violations, "SELECT * FROM (SELECT 'NOT NULL o_orderstatus' AS rule, count(*) AS n FROM orders WHERE o_orderstatus IS NULL UNION ALL SELECT 'UNIQUE o_custkey', count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'CHECK price', count(*) FROM orders WHERE NOT o_totalprice > 1000 UNION ALL SELECT 'FOREIGN KEY o_custkey', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey > 3)) WHERE n > 0"),
    "changeset_diff": (changeset_diff, f"{_BOTH}, a AS (SELECT * FROM o WHERE s_suppkey % 7 <> 0 AND s_suppkey NOT IN (SELECT s_suppkey FROM n) UNION ALL SELECT * FROM n) SELECT CASE WHEN o.s_suppkey IS NULL THEN 'insert' WHEN a.s_suppkey IS NULL THEN 'delete' ELSE 'update' END AS op, coalesce(o.s_suppkey, a.s_suppkey) AS s_suppkey, o.s_name AS before, a.s_name AS after FROM o FULL JOIN a ON o.s_suppkey = a.s_suppkey WHERE o.s_suppkey IS NULL OR a.s_suppkey IS NULL OR o.s_name <> a.s_name"),
    "changeset_apply": (changeset_apply, f"WITH {_OLD} SELECT * FROM o"),
    "changeset_concat": (changeset_concat, f"{_BOTH} SELECT 'update' AS op, n.s_suppkey, n.s_name AS after FROM n JOIN o ON o.s_suppkey = n.s_suppkey"),
    "fts_bm25": (fts_bm25, "WITH t AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part), l AS (SELECT p_partkey, count(*) AS dl FROM t GROUP BY 1), h AS (SELECT p_partkey, w, count(*) AS f FROM t WHERE w IN ('red', 'bolt') GROUP BY 1, 2), d AS (SELECT w, count(*) AS df FROM h GROUP BY 1) SELECT h.p_partkey, round(-sum(greatest(ln(((SELECT count(*) FROM l) - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM l)))), 9) AS score FROM h JOIN d USING (w) JOIN l USING (p_partkey) GROUP BY 1"),
    "fts_boolean": (fts_boolean, "SELECT p_partkey FROM part WHERE (list_contains(string_split(p_name, ' '), 'red') OR list_contains(string_split(p_name, ' '), 'blue')) AND NOT list_contains(string_split(p_name, ' '), 'ring')"),
    "fts_phrase_index": (fts_phrase_index, "SELECT p_partkey, 1 AS n FROM part WHERE p_name = 'small ring'"),
    "fts_highlight": (fts_highlight, "SELECT p_partkey, replace(p_name, 'red', '<b>red</b>') AS h FROM part"),
    "geo_grid_join": (geo_grid_join, "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON sqrt(pow(c_nationkey - s_nationkey, 2) + pow((c_acctbal - s_acctbal) / 100, 2)) <= 2.0"),
    "range_join_binned": (range_join_binned, "SELECT s_suppkey, p_partkey FROM supplier JOIN part ON p_retailprice BETWEEN s_acctbal AND s_acctbal + 5.0"),
    "rtree_box": (rtree_box, "SELECT p_partkey FROM part WHERE p_size <= 12 AND p_size + 2 >= 10 AND p_retailprice <= 1000 AND p_retailprice + 10 >= 950"),
    "stream_tumbling": (stream_tumbling, "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY 1, 2"),
    "stream_sliding": (stream_sliding, "SELECT strftime(date_trunc('hour', ts) - INTERVAL 1 HOUR * k, '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM events, (VALUES (0), (1)) AS s(k) GROUP BY 1"),
    "stream_sessions": (stream_sessions, "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k"),
}


def queries() -> dict[str, Query]:
    return {name: _dialect(name, text) for name, (text, _) in Q.items()} | {name: f for name, (f, _) in OPERATORS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in Q.items() if sql} | {name: sql for name, (_, sql) in OPERATORS.items()}
