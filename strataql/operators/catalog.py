"""Queries over the driver's tables: the dialect's SQL, and DuckDB's SQL for the same rows.

Each entry covers a row of the inventory. ``D`` are dialect queries; where the text is valid for
DuckDB too and means the same, the second is None.
"""

from __future__ import annotations

import re

Q: dict[str, tuple[str, str | None]] = {}


def _by_row(name: str, dialect: str, duck: str) -> None:
    """A query of functions whose first text is each row's: it depends on a column, so nothing folds."""
    given = re.sub(r"(\b(?!strftime\b)[a-z_0-9]+\(|strftime\('[^']*', )('(?:[^']|'')*')", r"\1iif(n_nationkey >= 0, \2, NULL)", dialect)
    Q[name] = (f"{given} FROM nation", f"{duck} FROM nation")


def _q(name: str, dialect: str, duck: str | None = "") -> None:
    Q[name] = (dialect, dialect if duck == "" else duck)


# --- scans, filters, projections ----------------------------------------------------------------
_q("scan_all", "SELECT * FROM nation")
_q("scan_projected", "SELECT o_orderkey, o_orderpriority FROM orders")
_q("filter_conj", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 30 AND l_discount < 0.05 AND (l_returnflag = 'R' OR l_linestatus = 'O')")
_q("filter_between_in_like", "SELECT p_partkey, p_name FROM part WHERE p_size BETWEEN 5 AND 20 AND p_type IN ('ECONOMY', 'SMALL') AND p_name LIKE '%RING%'", "SELECT p_partkey, p_name FROM part WHERE p_size BETWEEN 5 AND 20 AND p_type IN ('ECONOMY', 'SMALL') AND p_name ILIKE '%RING%'")
_q("filter_truthiness", "SELECT n_nationkey FROM nation WHERE n_regionkey AND NOT (n_nationkey % 2)", "SELECT n_nationkey FROM nation WHERE n_regionkey <> 0 AND n_nationkey % 2 = 0")
_q("filter_in_empty", "SELECT count(*) AS n FROM nation WHERE n_nationkey IN () OR n_regionkey NOT IN ()", "SELECT count(*) AS n FROM nation")
_q("filter_in_table", "SELECT n_name FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name < 'B') AND 'AFRICA' NOT IN nation_names", "SELECT n_name FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name < 'B')")
_q("point_lookup", "SELECT c_name, c_acctbal FROM customer WHERE c_custkey = 7")
_q("key_in_list", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (1, 5, 9, 400, 90000)")
_q("key_range", "SELECT o_orderkey FROM orders WHERE o_orderkey BETWEEN 100 AND 140 AND o_orderkey <> 120")
_q("case_expr", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS code FROM orders")
_q("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
_q("order_limit_offset", "SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10 OFFSET 5")
_q("limit_comma", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 5, 7", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 7 OFFSET 5")
_q("limit_negative", "SELECT n_nationkey FROM nation ORDER BY 1 LIMIT -1", "SELECT n_nationkey FROM nation")
_q("topn", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 20")
_q("nulls_order", "SELECT c_custkey, nullif(c_nationkey, 3) AS x FROM customer ORDER BY x DESC NULLS FIRST, c_custkey LIMIT 20")
_q("values_source", "SELECT n_name, column2 AS b FROM nation JOIN (VALUES (0, 'x'), (1, 'y'), (2, NULL)) ON n_regionkey = column1", "SELECT n_name, b FROM nation JOIN (VALUES (0, 'x'), (1, 'y'), (2, NULL)) AS v(k, b) ON n_regionkey = k")
_q("constant_source", "SELECT n_nationkey, t.* FROM nation, (SELECT 1 AS a, 'x' AS b, 2.5 AS c, NULL IS NULL AS d) AS t", "SELECT n_nationkey, 1 AS a, 'x' AS b, 2.5::DOUBLE AS c, 1 AS d FROM nation")
_q("from_subquery", "SELECT t.k, t.n FROM (SELECT n_regionkey, count(*) FROM nation GROUP BY 1) AS t(k, n) WHERE t.n > 1")
_q("alias_in_where", "SELECT o_orderkey, o_totalprice / 1000.0 AS thousands FROM orders WHERE thousands > 400 ORDER BY thousands", "SELECT o_orderkey, o_totalprice / 1000.0 AS thousands FROM orders WHERE o_totalprice / 1000.0 > 400")
_q("spatial_box", "SELECT c_custkey FROM customer WHERE c_acctbal BETWEEN 100.0 AND 900.0 AND c_nationkey BETWEEN 3 AND 9")

# --- operators ----------------------------------------------------------------------------------
_q("fn_int_div", "SELECT o_orderkey, o_orderkey / 7 AS q, o_orderkey % 7 AS r, o_orderkey / 0 AS z, 7.5 / 2 AS h FROM orders", "SELECT o_orderkey, o_orderkey // 7 AS q, o_orderkey % 7 AS r, NULL::BIGINT AS z, 7.5::DOUBLE / 2 AS h FROM orders")
_q("op_overflow", "SELECT n_nationkey, n_nationkey * 9223372036854775807 AS a, 9223372036854775807 + 1 AS b, n_nationkey + 2 AS c FROM nation", "SELECT n_nationkey, n_nationkey * 9223372036854775807::DOUBLE AS a, 9223372036854775808::DOUBLE AS b, n_nationkey + 2 AS c FROM nation")
_q("op_concat", "SELECT c_custkey || '-' || c_mktsegment AS s, 'x' || NULL AS n FROM customer", "SELECT c_custkey::VARCHAR || '-' || c_mktsegment AS s, NULL AS n FROM customer")
_q("op_bits", "SELECT n_nationkey, n_nationkey & 6 AS a, n_nationkey | 8 AS o, ~n_nationkey AS i, n_nationkey << 3 AS l, n_nationkey >> 1 AS r, 1 << 64 AS big, 8 << -2 AS back FROM nation", "SELECT n_nationkey, n_nationkey & 6 AS a, n_nationkey | 8 AS o, ~n_nationkey AS i, n_nationkey * 8 AS l, n_nationkey >> 1 AS r, 0 AS big, 2 AS back FROM nation")
_q("op_compare_mixed", "SELECT c_custkey, c_custkey < 'abc' AS a, c_custkey = cast(c_custkey AS TEXT) AS b, c_mktsegment > 5 AS c, cast(c_custkey AS TEXT) > 5 AS d, c_custkey > '5' AS e, c_custkey + 0 = '5' AS f, cast(c_nationkey AS TEXT) BETWEEN 1 AND '2' AS g, cast(c_custkey AS TEXT) IN (7, '8') AS h FROM customer", "SELECT c_custkey, 1 AS a, 1 AS b, (c_mktsegment > '5')::INT AS c, (c_custkey::VARCHAR > '5')::INT AS d, (c_custkey > 5)::INT AS e, 0 AS f, (c_nationkey::VARCHAR BETWEEN '1' AND '2')::INT AS g, (c_custkey IN (7, 8))::INT AS h FROM customer")
_q("op_is_distinct", "SELECT a.n_nationkey AS i, b.n_nationkey AS j, nullif(a.n_regionkey, 1) IS nullif(b.n_regionkey, 2) AS same, nullif(a.n_regionkey, 1) IS NOT DISTINCT FROM nullif(b.n_regionkey, 2) AS also, (nullif(a.n_regionkey, 1) = b.n_regionkey) IS TRUE AS t, (nullif(a.n_regionkey, 1) = b.n_regionkey) IS NOT FALSE AS f FROM nation a, nation b", "SELECT a.n_nationkey AS i, b.n_nationkey AS j, (nullif(a.n_regionkey, 1) IS NOT DISTINCT FROM nullif(b.n_regionkey, 2))::INT AS same, (nullif(a.n_regionkey, 1) IS NOT DISTINCT FROM nullif(b.n_regionkey, 2))::INT AS also, coalesce(nullif(a.n_regionkey, 1) = b.n_regionkey, false)::INT AS t, coalesce(nullif(a.n_regionkey, 1) = b.n_regionkey, true)::INT AS f FROM nation a, nation b")
_q("op_kleene", "SELECT n_nationkey, x AND y AS a, x OR y AS o, NOT x AS n FROM (SELECT n_nationkey, nullif(n_regionkey % 3, 2) AS x, nullif(n_nationkey % 3, 2) AS y FROM nation)", "SELECT n_nationkey, (x::BOOL AND y::BOOL)::INT AS a, (x::BOOL OR y::BOOL)::INT AS o, (NOT x::BOOL)::INT AS n FROM (SELECT n_nationkey, nullif(n_regionkey % 3, 2) AS x, nullif(n_nationkey % 3, 2) AS y FROM nation)")
_q("op_collate", "SELECT count(*) AS n FROM region WHERE r_name COLLATE NOCASE = 'asia' OR 'x ' COLLATE RTRIM = 'y'", "SELECT count(*) AS n FROM region WHERE lower(r_name) = 'asia'")
_q("fn_like_glob", "SELECT p_partkey FROM part WHERE p_name GLOB '*r?ng' OR p_name REGEXP '^b.*t$' OR p_name LIKE 'small\\_%' ESCAPE '\\'", "SELECT p_partkey FROM part WHERE p_name GLOB '*r?ng' OR regexp_matches(p_name, '^b.*t$')")
_q("row_value_cmp", "SELECT n_nationkey FROM nation WHERE (n_regionkey, n_nationkey) > (2, 10) AND (n_regionkey, n_nationkey) <> (3, 3)")
_q("row_value_in", "SELECT n_name FROM nation WHERE (n_regionkey, n_nationkey) IN (SELECT r_regionkey, r_regionkey + 5 FROM region)")
_q("params_bound", "SELECT n_name FROM nation WHERE n_regionkey = :r AND n_nationkey > :k", "SELECT n_name FROM nation WHERE n_regionkey = 2 AND n_nationkey > 5")

# --- joins --------------------------------------------------------------------------------------
_q("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000")
_q("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000")
_q("join_right", "SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey AND o_totalprice > 450000")
_q("join_full", "SELECT p_partkey, s_suppkey FROM part FULL JOIN supplier ON p_partkey = s_suppkey * 30")
_q("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
_q("join_comma", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey")
_q("join_using", "SELECT k, a.v AS x, b.v AS y FROM (SELECT n_regionkey AS k, n_name AS v FROM nation) AS a JOIN (SELECT r_regionkey AS k, r_name AS v FROM region) AS b USING (k)")
_q("join_natural", "SELECT * FROM (SELECT n_regionkey AS k, n_name FROM nation) AS a NATURAL JOIN (SELECT r_regionkey AS k, r_name FROM region) AS b")
_q("join_natural_full", "SELECT k, v, w FROM (SELECT n_regionkey + 2 AS k, min(n_name) AS v FROM nation GROUP BY 1) AS x NATURAL FULL JOIN (SELECT r_regionkey AS k, r_name AS w FROM region) AS y")
_q("join_theta", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey > b.n_regionkey")
_q("join_range", "SELECT s_suppkey, p_partkey FROM supplier JOIN part ON p_retailprice BETWEEN s_acctbal AND s_acctbal + 5.0")
_q("join_multi_key", "SELECT count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber")
_q("join_computed_key", "SELECT a.o_orderkey AS x, b.o_orderkey AS y FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1")
_q("join_self", "SELECT a.c_custkey AS x, b.c_custkey AS y FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_custkey < b.c_custkey WHERE a.c_mktsegment = b.c_mktsegment")
_q("join_chain4", "SELECT r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN orders ON o_custkey = c_custkey GROUP BY r_name")
_q("join_star", "SELECT s_name, p_brand, sum(l_quantity) AS q FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE p_size < 5 GROUP BY 1, 2")
_q("join_nested_parens", "SELECT count(*) AS n FROM region LEFT JOIN (nation JOIN customer ON c_nationkey = n_nationkey) ON n_regionkey = r_regionkey")
_q("join_left_reduced", "SELECT count(*) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 100000")
_q("join_indexed_by", "SELECT count(*) AS n FROM orders INDEXED BY some_index WHERE o_custkey = 3", "SELECT count(*) AS n FROM orders WHERE o_custkey = 3")
_q("semi_in", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
_q("semi_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
_q("anti_not_in_null", "SELECT count(*) AS n FROM nation WHERE n_regionkey NOT IN (SELECT CASE WHEN r_regionkey > 2 THEN NULL ELSE r_regionkey END FROM region)")
_q("anti_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")

# --- aggregates ---------------------------------------------------------------------------------
_q("agg_global", "SELECT count(*) AS n, sum(l_linenumber) AS s, min(l_quantity) AS lo, max(l_quantity) AS hi, round(avg(l_quantity), 6) AS a FROM lineitem", "SELECT count(*) AS n, sum(l_linenumber)::BIGINT AS s, min(l_quantity) AS lo, max(l_quantity) AS hi, round(avg(l_quantity), 6) AS a FROM lineitem")
_q("agg_count_only", "SELECT count(*) AS n FROM orders")
_q("agg_empty_total", "SELECT count(*) AS n, sum(l_quantity) AS s, total(l_quantity) AS t FROM lineitem WHERE l_quantity < 0", "SELECT 0 AS n, NULL::DOUBLE AS s, 0.0::DOUBLE AS t")
_q("agg_group", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q, count(*) AS n FROM lineitem WHERE l_shipdate < '1998-09-02' GROUP BY 1, 2")
_q("agg_group_expr", "SELECT o_orderkey % 10 AS b, count(*) AS n FROM orders GROUP BY o_orderkey % 10")
_q("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING n > 12 AND max(o_totalprice) > 100000")
_q("agg_filter", "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 200000) AS big, sum(o_orderkey) FILTER (WHERE o_orderkey % 2 = 0) AS even FROM orders GROUP BY 1", "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 200000) AS big, (sum(o_orderkey) FILTER (WHERE o_orderkey % 2 = 0))::BIGINT AS even FROM orders GROUP BY 1")
_q("agg_distinct_multi", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS s, count(DISTINCT l_partkey) AS p, sum(DISTINCT l_linenumber) AS l FROM lineitem GROUP BY 1", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS s, count(DISTINCT l_partkey) AS p, sum(DISTINCT l_linenumber)::BIGINT AS l FROM lineitem GROUP BY 1")
_q("agg_median_pct", "SELECT l_returnflag, median(l_quantity) AS m, percentile(l_extendedprice, 25) AS p, percentile_disc(l_extendedprice, 75) AS d FROM lineitem GROUP BY 1", "SELECT l_returnflag, median(l_quantity) AS m, quantile_cont(l_extendedprice, 0.25) AS p, quantile_disc(l_extendedprice, 0.75) AS d FROM lineitem GROUP BY 1")
_q("agg_stddev", "SELECT l_returnflag, round(stddev(l_quantity), 6) AS s, round(stddev_pop(l_quantity), 6) AS p FROM lineitem GROUP BY 1")
_q("agg_listagg_order", "SELECT n_regionkey, group_concat(n_name, '; ' ORDER BY n_name DESC) AS names, string_agg(DISTINCT n_regionkey, ',') AS k FROM nation GROUP BY 1", "SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_name DESC) AS names, n_regionkey::VARCHAR AS k FROM nation GROUP BY 1")
_q("agg_json_group", "SELECT n_regionkey, json_group_array(n_name ORDER BY n_name) AS a, json_group_object(n_name, n_nationkey ORDER BY n_name) AS o FROM nation GROUP BY 1", "SELECT n_regionkey, '[' || string_agg('\"' || n_name || '\"', ',' ORDER BY n_name) || ']' AS a, '{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' ORDER BY n_name) || '}' AS o FROM nation GROUP BY 1")
_q("agg_bare_max", "SELECT o_custkey, max(o_totalprice) AS m, o_orderkey, o_orderstatus FROM orders GROUP BY o_custkey", "SELECT o_custkey, max(o_totalprice) AS m, arg_max(o_orderkey, o_totalprice) AS o_orderkey, arg_max(o_orderstatus, o_totalprice) AS o_orderstatus FROM orders GROUP BY o_custkey")
_q("agg_bare_last_wins", "SELECT max(o_totalprice) AS hi, min(o_totalprice) AS lo, o_orderkey FROM orders", "SELECT max(o_totalprice) AS hi, min(o_totalprice) AS lo, arg_min(o_orderkey, o_totalprice) AS o_orderkey FROM orders")
_q("agg_two_phase", "SELECT avg(n) AS a, max(n) AS m FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)")
_q("agg_over_text", "SELECT c_mktsegment, sum(c_custkey || 'abc') AS s, total(c_mktsegment) AS t FROM customer GROUP BY 1", "SELECT c_mktsegment, sum(c_custkey)::DOUBLE AS s, 0.0::DOUBLE AS t FROM customer GROUP BY 1")
_q("agg_collate", "SELECT count(DISTINCT iif(c_custkey % 2, lower(c_mktsegment), c_mktsegment) COLLATE NOCASE) AS n FROM customer", "SELECT count(DISTINCT lower(c_mktsegment)) AS n FROM customer")

# --- windows ------------------------------------------------------------------------------------
_W = "PARTITION BY o_custkey ORDER BY o_orderkey"
_q("win_rank_family", "SELECT n_nationkey, row_number() OVER w AS rn, rank() OVER w2 AS r, dense_rank() OVER w2 AS d, round(percent_rank() OVER w2, 9) AS p, round(cume_dist() OVER w2, 9) AS c FROM nation WINDOW w AS (ORDER BY n_nationkey), w2 AS (ORDER BY n_regionkey)")
_q("win_ntile", "SELECT o_orderkey, ntile(4) OVER (ORDER BY o_orderkey) AS q FROM orders")
_q("win_ntile_dynamic", "SELECT n_nationkey, ntile(n + 2) OVER (ORDER BY n_nationkey) AS q FROM nation, (SELECT 1 AS n)", "SELECT n_nationkey, ntile(3) OVER (ORDER BY n_nationkey) AS q FROM nation")
_q("win_lag_lead", f"SELECT o_orderkey, lag(o_totalprice) OVER ({_W}) AS a, lead(o_totalprice, 2, -1.0) OVER ({_W}) AS b FROM orders")
_q("win_lag_dynamic", "SELECT n_nationkey, lag(n_name, n_regionkey + 1, 'none') OVER (ORDER BY n_nationkey) AS l FROM nation")
_q("win_first_last_nth", f"SELECT o_orderkey, first_value(o_orderkey) OVER ({_W}) AS f, last_value(o_orderkey) OVER ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l, nth_value(o_orderkey, 2) OVER ({_W}) AS n FROM orders")
_q("win_nth_dynamic", "SELECT n_nationkey, nth_value(n_name, n_regionkey + 1) OVER (ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS v FROM nation", "SELECT n_nationkey, (SELECT b.n_name FROM nation b WHERE b.n_nationkey = a.n_regionkey) AS v FROM nation a")
_q("win_rows", f"SELECT o_orderkey, round(sum(o_totalprice) OVER ({_W} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 2) AS s, count(*) OVER ({_W} ROWS 3 PRECEDING) AS n FROM orders")
_q("win_range", "SELECT n_nationkey, count(*) OVER (ORDER BY n_nationkey RANGE BETWEEN 3 PRECEDING AND 1 FOLLOWING) AS n, sum(n_nationkey) OVER (ORDER BY n_regionkey) AS s FROM nation", "SELECT n_nationkey, count(*) OVER (ORDER BY n_nationkey RANGE BETWEEN 3 PRECEDING AND 1 FOLLOWING) AS n, (sum(n_nationkey) OVER (ORDER BY n_regionkey))::BIGINT AS s FROM nation")
_q("win_groups", "SELECT l_orderkey, l_linenumber, sum(l_linenumber) OVER (PARTITION BY l_suppkey ORDER BY l_quantity GROUPS BETWEEN 1 PRECEDING AND 2 FOLLOWING) AS s FROM lineitem", "SELECT l_orderkey, l_linenumber, (sum(l_linenumber) OVER (PARTITION BY l_suppkey ORDER BY l_quantity GROUPS BETWEEN 1 PRECEDING AND 2 FOLLOWING))::BIGINT AS s FROM lineitem")
for _name, _what in (("current", "CURRENT ROW"), ("group", "GROUP"), ("ties", "TIES")):
    _f = f"RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE {_what}"
    _q(f"win_exclude_{_name}", f"SELECT n_nationkey, sum(n_nationkey) OVER (ORDER BY n_regionkey {_f}) AS s, count(*) OVER (ORDER BY n_regionkey {_f}) AS n, min(n_nationkey) OVER (ORDER BY n_regionkey {_f}) AS m FROM nation", f"SELECT n_nationkey, (sum(n_nationkey) OVER (ORDER BY n_regionkey {_f}))::BIGINT AS s, count(*) OVER (ORDER BY n_regionkey {_f}) AS n, min(n_nationkey) OVER (ORDER BY n_regionkey {_f}) AS m FROM nation")
_q("win_exclude_rows", f"SELECT o_orderkey, round(sum(o_totalprice) OVER ({_W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW), 2) AS s FROM orders")
_q("win_filter", "SELECT n_nationkey, count(*) FILTER (WHERE n_nationkey % 2 = 0) OVER (ORDER BY n_nationkey) AS n, sum(n_nationkey) FILTER (WHERE n_regionkey > 1) OVER () AS s FROM nation", "SELECT n_nationkey, count(*) FILTER (WHERE n_nationkey % 2 = 0) OVER (ORDER BY n_nationkey) AS n, (sum(n_nationkey) FILTER (WHERE n_regionkey > 1) OVER ())::BIGINT AS s FROM nation")
_q("win_named_chain", "SELECT o_orderkey, round(sum(o_totalprice) OVER (w1 ORDER BY o_orderkey), 2) AS s FROM orders WINDOW w1 AS (PARTITION BY o_custkey)", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 2) AS s FROM orders")
_q("win_over_agg", "SELECT o_custkey, sum(o_totalprice) AS t, rank() OVER (ORDER BY sum(o_totalprice) DESC) AS r FROM orders GROUP BY o_custkey")
_q("win_group_concat", "SELECT n_nationkey, group_concat(n_name, '|') OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS s FROM nation", "SELECT n_nationkey, string_agg(n_name, '|') OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS s FROM nation")

# --- sets and common table expressions ------------------------------------------------------------
_q("union_all", "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")
_q("union", "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey + 3 FROM region")
_q("intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
_q("except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
_q("setop_left_assoc", "SELECT n_regionkey AS x FROM nation UNION SELECT r_regionkey + 2 FROM region INTERSECT SELECT r_regionkey + 1 FROM region UNION ALL SELECT n_nationkey FROM nation EXCEPT SELECT r_regionkey FROM region WHERE r_regionkey < 2", "(((SELECT n_regionkey AS x FROM nation UNION SELECT r_regionkey + 2 FROM region) INTERSECT SELECT r_regionkey + 1 FROM region) UNION ALL SELECT n_nationkey FROM nation) EXCEPT SELECT r_regionkey FROM region WHERE r_regionkey < 2")
_q("setop_mixed_types", "SELECT n_nationkey AS x FROM nation UNION ALL SELECT c_acctbal FROM customer")
_q("setop_order", "SELECT n_name AS x FROM nation UNION SELECT r_name FROM region ORDER BY x DESC LIMIT 5")
_q("cte", "WITH big AS MATERIALIZED (SELECT * FROM orders WHERE o_totalprice > 300000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY 1) SELECT * FROM per WHERE n > 1", "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 300000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY 1) SELECT * FROM per WHERE n > 1")
_q("cte_nested", "WITH a(x) AS (SELECT n_regionkey FROM nation) SELECT x, (WITH b AS (SELECT 2 AS y) SELECT y FROM b) AS y FROM (WITH c AS (SELECT x FROM a WHERE x > 1) SELECT DISTINCT x FROM c)", "SELECT DISTINCT n_regionkey AS x, 2 AS y FROM nation WHERE n_regionkey > 1")
_q("cte_recursive", "WITH RECURSIVE c(k, d) AS (SELECT p_partkey, 0 FROM part UNION ALL SELECT k / 2, d + 1 FROM c WHERE k > 0) SELECT k, d, count(*) AS n FROM c GROUP BY k, d", "WITH RECURSIVE c(k, d) AS (SELECT p_partkey, 0 FROM part UNION ALL SELECT k // 2, d + 1 FROM c WHERE k > 0) SELECT k, d, count(*) AS n FROM c GROUP BY k, d")
_q("cte_recursive_union", "WITH RECURSIVE r(x) AS (SELECT n_nationkey FROM nation WHERE n_regionkey = 0 UNION SELECT b.n_nationkey FROM r JOIN nation b ON b.n_regionkey = r.x % 5) SELECT x FROM r")
_q("cte_recursive_limit", "WITH RECURSIVE c(x) AS (SELECT max(c_custkey) FROM customer UNION ALL SELECT x + 2 FROM c LIMIT 6) SELECT x FROM c", "SELECT max(c_custkey) + 2 * i AS x FROM customer, range(6) AS r(i) GROUP BY i")
_q("cte_recursive_priority", "WITH RECURSIVE t(n, d) AS (SELECT 1, 0 UNION ALL SELECT n * 2 + k.i, d + 1 FROM t, (VALUES (0), (1)) AS k(i) WHERE d < 3 ORDER BY 2 DESC LIMIT 9) SELECT n, d FROM t", "SELECT * FROM (VALUES (1, 0), (2, 1), (4, 2), (8, 3), (9, 3), (5, 2), (10, 3), (11, 3), (3, 1)) AS t(n, d)")

# --- subqueries ---------------------------------------------------------------------------------
_q("scalar_first_row", "SELECT (SELECT n_name FROM nation ORDER BY n_name DESC) AS last_name", "SELECT max(n_name) AS last_name FROM nation")
_q("scalar_corr", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer")
_q("scalar_corr_theta", "SELECT n_nationkey, (SELECT max(b.n_nationkey) FROM nation b WHERE b.n_nationkey < a.n_nationkey) AS prev FROM nation a")
_q("exists_or", "SELECT c_custkey FROM customer WHERE c_acctbal < 0 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
_q("in_corr", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > c_acctbal)")

_q("skip_level_corr", "SELECT c_custkey FROM customer w WHERE EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = w.c_custkey AND EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = w.c_nationkey AND s.s_suppkey < b.o_orderkey))")
_q("agg_promoted", "SELECT n_regionkey, (SELECT sum(n_nationkey)) AS s, (SELECT count(*) + 1) AS n FROM nation GROUP BY 1", "SELECT n_regionkey, sum(n_nationkey)::BIGINT AS s, count(*) + 1 AS n FROM nation GROUP BY 1")

_q("scalar_corr_expression", "SELECT a.o_orderkey, (SELECT b.o_totalprice FROM orders b WHERE b.o_orderkey = a.o_orderkey + 1) AS next FROM orders a", "SELECT a.o_orderkey, b.o_totalprice AS next FROM orders a LEFT JOIN orders b ON b.o_orderkey = a.o_orderkey + 1")
_q("scalar_corr_ordered", "SELECT c_custkey, (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 1) AS top FROM customer", "SELECT c_custkey, top FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS top FROM orders GROUP BY 1) ON o_custkey = c_custkey")
_q("in_as_value", "SELECT n_nationkey, n_regionkey IN (SELECT nullif(r_regionkey, 2) FROM region WHERE r_regionkey < 3) AS i, n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey < 3) AS o, n_regionkey IN (SELECT r_regionkey FROM region WHERE r_regionkey > 9) AS e FROM nation", "SELECT n_nationkey, CASE WHEN n_regionkey < 2 THEN 1 END AS i, (n_regionkey >= 3)::INT AS o, 0 AS e FROM nation")
_q("distinct_order_expr", "SELECT DISTINCT c_mktsegment FROM customer ORDER BY length(c_mktsegment), c_mktsegment LIMIT 3")
_q("real_text", "SELECT l_orderkey, l_linenumber, l_extendedprice || '' AS p, cast(l_quantity * 1e17 AS TEXT) AS big, quote(l_quantity / 1e6) AS small, cast(2.0 * l_quantity / 3 AS TEXT) = cast(2.0 * l_quantity / 3 AS TEXT) AS same FROM lineitem WHERE l_quantity < 10", "SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice = floor(l_extendedprice) THEN printf('%.1f', l_extendedprice) ELSE l_extendedprice::VARCHAR END AS p, l_quantity::INT || '.0e+17' AS big, l_quantity::INT || '.0e-06' AS small, 1 AS same FROM lineitem WHERE l_quantity < 10")
_q("cast_clamped", "SELECT c_custkey, cast(c_acctbal * 1e30 AS INTEGER) AS a FROM customer", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 9223372036854775807 WHEN c_acctbal < 0 THEN -9223372036854775808 ELSE 0 END AS a FROM customer")
_q("like_ascii", "SELECT n_nationkey, 'É' || n_name LIKE 'é%' AS a, 'É' || n_name LIKE 'É' || lower(n_name) AS b FROM nation", "SELECT n_nationkey, 0 AS a, 1 AS b FROM nation")
_q("fn_date_by_row", "SELECT o_orderkey, date(o_orderdate, (o_custkey % 40) || ' days') AS d, date(o_orderdate, 'start of month', '-' || (o_custkey % 5) || ' months') AS m FROM orders", "SELECT o_orderkey, strftime(o_orderdate + INTERVAL 1 DAY * (o_custkey % 40), '%Y-%m-%d') AS d, strftime(date_trunc('month', o_orderdate) - INTERVAL 1 MONTH * (o_custkey % 5), '%Y-%m-%d') AS m FROM orders")

# --- functions ----------------------------------------------------------------------------------
_q("fn_text", "SELECT p_partkey, length(p_name) AS l, upper(p_name) AS u, lower(p_type) AS d, trim('  ' || p_name || ' ') AS t, ltrim(p_name, 'br') AS lt, replace(p_name, ' ', '_') AS r, instr(p_name, 'i') AS i, concat(p_name, NULL, p_size) AS c, concat_ws('-', p_brand, NULL, p_size) AS w FROM part", "SELECT p_partkey, length(p_name) AS l, upper(p_name) AS u, lower(p_type) AS d, p_name AS t, ltrim(p_name, 'br') AS lt, replace(p_name, ' ', '_') AS r, instr(p_name, 'i') AS i, p_name || p_size AS c, p_brand || '-' || p_size AS w FROM part")
_q("fn_substr_edge", "SELECT p_partkey, substr(p_name, 0, 2) AS a, substr(p_name, -3, 2) AS b, substr(p_name, 3, -2) AS c, substr(p_name, 2) AS d, substr(p_name, -99, 100) AS e FROM part", "SELECT p_partkey, left(p_name, 1) AS a, left(right(p_name, 3), 2) AS b, left(p_name, 2) AS c, substr(p_name, 2) AS d, p_name AS e FROM part")
_q("fn_math", "SELECT l_orderkey, l_linenumber, round(sqrt(l_quantity), 6) AS s, floor(l_extendedprice) AS f, ceil(l_extendedprice) AS c, abs(-l_linenumber) AS a, round(power(l_quantity, 2), 3) AS p, sign(-l_quantity) AS g, round(ln(l_quantity), 6) AS n, round(log(100 + l_quantity), 6) AS l, mod(l_linenumber, 3) AS m FROM lineitem", "SELECT l_orderkey, l_linenumber, round(sqrt(l_quantity), 6) AS s, floor(l_extendedprice) AS f, ceil(l_extendedprice) AS c, l_linenumber AS a, round(l_quantity * l_quantity, 3) AS p, -1 AS g, round(ln(l_quantity), 6) AS n, round(log10(100 + l_quantity), 6) AS l, (l_linenumber % 3)::DOUBLE AS m FROM lineitem")
_q("fn_trig", "SELECT n_nationkey, round(sin(n_nationkey), 9) AS s, round(cos(n_nationkey), 9) AS c, round(atan2(n_nationkey, 3), 9) AS a, round(degrees(n_nationkey), 6) AS d, round(pi(), 9) AS p, acos(2.0) AS bad FROM nation", "SELECT n_nationkey, round(sin(n_nationkey), 9) AS s, round(cos(n_nationkey), 9) AS c, round(atan2(n_nationkey, 3), 9) AS a, round(degrees(n_nationkey), 6) AS d, round(pi(), 9) AS p, NULL::DOUBLE AS bad FROM nation")
_q("fn_round", "SELECT l_orderkey, l_linenumber, round(l_quantity / 4) AS a, round(-l_quantity / 4) AS b, round(l_quantity / 8, 2) AS c, trunc(-l_quantity / 4) AS d FROM lineitem", "SELECT l_orderkey, l_linenumber, round(l_quantity / 4) AS a, round(-l_quantity / 4) AS b, round(l_quantity / 8, 2) AS c, trunc(-l_quantity / 4) AS d FROM lineitem")
_q("fn_null_choice", "SELECT coalesce(NULL, c_acctbal) AS a, ifnull(NULL, 5) AS b, nullif(c_custkey, 3) AS c, iif(c_acctbal > 0, 'pos', 'neg') AS d, min(c_custkey, 10) AS e, max(c_custkey, NULL) AS f FROM customer", "SELECT c_acctbal AS a, 5 AS b, nullif(c_custkey, 3) AS c, CASE WHEN c_acctbal > 0 THEN 'pos' ELSE 'neg' END AS d, least(c_custkey, 10) AS e, NULL::BIGINT AS f FROM customer")
_q("fn_hex_quote", "SELECT hex(n_name) AS h, quote(n_name || '''') AS q, typeof(n_nationkey) AS t, typeof(1.5) AS r, unicode('é') AS u, char(233, 8364) AS c, octet_length('é') AS o FROM nation", "SELECT hex(encode(n_name)) AS h, '''' || n_name || '''''''' AS q, 'integer' AS t, 'real' AS r, 233 AS u, 'é€' AS c, 2 AS o FROM nation")
_q("fn_printf", "SELECT printf('%05d|%-6s|%.2f|%x|%,d|%%|%q', n_nationkey, n_name, 2.5, 255, 1234567, 'it''s') AS p FROM nation", "SELECT lpad(n_nationkey::VARCHAR, 5, '0') || '|' || rpad(n_name, greatest(length(n_name), 6)::INT, ' ') || '|2.50|ff|1,234,567|%|it''''s' AS p FROM nation")
_by_row("fn_soundex", "SELECT soundex('Robert') AS a, soundex('Rupert') AS b, soundex('123') AS c", "SELECT 'R163' AS a, 'R163' AS b, '?000' AS c")
_by_row("fn_cast_prefix", "SELECT cast('12abc' AS INTEGER) AS a, cast('x' AS INTEGER) AS b, cast('3.7e1z' AS REAL) AS c, cast(5.9 AS INTEGER) AS d, cast(7 AS TEXT) AS e, cast('yes' AS BOOLEAN) AS f, '10' + '5' AS g", "SELECT 12 AS a, 0 AS b, 37.0::DOUBLE AS c, 5 AS d, '7' AS e, 1 AS f, 15.0::DOUBLE AS g")
_q("fn_date_parts", "SELECT o_orderkey, date(o_orderdate) AS d, time(o_orderdate) AS t, strftime('%Y-%m %j %H:%M:%S %w', o_orderdate) AS f, unixepoch(o_orderdate) AS u FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate, '%H:%M:%S') AS t, strftime(o_orderdate, '%Y-%m %j %H:%M:%S %w') AS f, epoch(o_orderdate)::BIGINT AS u FROM orders")
_by_row("fn_date_modifiers", "SELECT date('2024-01-31', '+1 month') AS a, date('2024-03-15', 'start of month', '-1 day') AS b, datetime('2024-02-28 23:30', '+45 minutes') AS c, date('2024-03-05', 'weekday 1') AS d, date('2024-02-31') AS e, date('nonsense') AS f, datetime(0, 'unixepoch') AS g, julianday('2000-01-01 12:00') AS h, date('2023-02-29', '+1 year') AS i", "SELECT '2024-03-02' AS a, '2024-02-29' AS b, '2024-02-29 00:15:00' AS c, '2024-03-11' AS d, '2024-03-02' AS e, NULL AS f, '1970-01-01 00:00:00' AS g, 2451545.0::DOUBLE AS h, '2024-03-01' AS i")
_by_row("fn_strftime", "SELECT strftime('%e|%f|%I %p|%k|%l|%u|%U|%W|%V|%G|%g|%R|%T|%s|%J', '2024-03-05 15:04:05.678') AS a, strftime('%Q', '2024-03-05') AS b", "SELECT ' 5|05.678|03 PM|15| 3|2|09|10|10|2024|24|15:04|15:04:05|1709651045|' || '2460375.127843495' AS a, NULL AS b")
_by_row("fn_timediff", "SELECT timediff('2024-03-05 12:00', '2023-01-02 13:30') AS a, timediff('2023-01-02', '2024-03-05') AS b", "SELECT '+0001-02-02 22:30:00.000' AS a, '-0001-02-03 00:00:00.000' AS b")
_q("fn_date_tumbling", "SELECT strftime('%Y-%m-%d %H:00', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY 1, 2", "SELECT strftime(ts, '%Y-%m-%d %H:00') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY 1, 2")
_q("fn_json_extract", "SELECT event_id, json_extract(props, '$.k') AS k, props ->> '$.k' AS t, json_type(props, '$.k') AS y, json_valid(props) AS v FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.k') AS t, 'integer' AS y, 1 AS v FROM events")
_by_row("fn_json_edit", "SELECT json_set('{\"a\":1,\"b\":[1,2]}', '$.b[#]', 3, '$.c.d', 'x') AS a, json_remove('{\"a\":1,\"b\":[1,2]}', '$.b[0]') AS b, json_patch('{\"a\":1,\"b\":2}', '{\"a\":null,\"c\":3}') AS c, json_array_length('[1,2,3]') AS d, json('{ \"x\" : 1.50 }') AS e", """SELECT '{"a":1,"b":[1,2,3],"c":{"d":"x"}}' AS a, '{"a":1,"b":[2]}' AS b, '{"b":2,"c":3}' AS c, 3 AS d, '{"x":1.50}' AS e""")
_q("fn_json_build", "SELECT json_object('k', n_nationkey, 'n', n_name, 'a', json_array(1, 2.5, NULL, 'q')) AS j, json_quote('a\"b') AS q FROM nation", """SELECT '{"k":' || n_nationkey || ',"n":"' || n_name || '","a":[1,2.5,null,"q"]}' AS j, '"a\\"b"' AS q FROM nation""")
_q("fn_json_each", "SELECT n_nationkey, je.key AS k, je.value AS v FROM nation, json_each(json_array(n_nationkey, n_name)) AS je", "SELECT n_nationkey, k, v FROM (SELECT n_nationkey, '0' AS k, n_nationkey::VARCHAR AS v FROM nation UNION ALL SELECT n_nationkey, '1', n_name FROM nation)")
_q("fn_json_tree", "SELECT n_nationkey, fullkey, type, atom FROM nation, json_tree(json_object('a', json_array(n_nationkey, n_name)))", "SELECT n_nationkey, fullkey, type, atom FROM nation, LATERAL (VALUES ('$', 'object', NULL), ('$.a', 'array', NULL), ('$.a[0]', 'integer', n_nationkey::VARCHAR), ('$.a[1]', 'text', n_name)) AS t(fullkey, type, atom)")
_q("fn_generate_series", "SELECT r_regionkey, value FROM region, generate_series(1, r_regionkey + 5, 2)", "SELECT r_regionkey, unnest(generate_series(1, r_regionkey + 5, 2)) AS value FROM region")
_q("fn_regex", "SELECT p_partkey, regexp_like(p_name, '^R', 'i') AS l, regexp_replace(p_name, '[aeiou]', '<\\&>') AS f, regexp_replace(p_name, '[aeiou]', '', 'g') AS g, regexp_substr(p_name, '[a-z]+', 1, 2) AS s, regexp_count(p_name, 'e') AS c, regexp_instr(p_name, ' ') AS i FROM part", "SELECT p_partkey, regexp_matches(p_name, '^r', 'i')::INT AS l, regexp_replace(p_name, '([aeiou])', '<\\1>') AS f, regexp_replace(p_name, '[aeiou]', '', 'g') AS g, string_split(p_name, ' ')[2] AS s, len(regexp_extract_all(p_name, 'e')) AS c, instr(p_name, ' ') AS i FROM part")
_by_row("fn_trigram", "SELECT similarity('word', 'two words') AS a, similarity('', '') AS b, similarity('abc', 'abc') AS c, show_trgm('cat') AS d, word_similarity('word', 'two words') AS e", "SELECT 4.0::DOUBLE / 11 AS a, 1.0::DOUBLE AS b, 1.0::DOUBLE AS c, '{\"  c\",\" ca\",\"at \",\"cat\"}' AS d, 4.0::DOUBLE / 7 AS e")
_q("fn_typeof", "SELECT typeof(o_orderkey) AS a, typeof(o_totalprice) AS b, typeof(o_orderstatus) AS c, typeof(NULL) AS d FROM orders LIMIT 3", "SELECT 'integer' AS a, 'real' AS b, 'text' AS c, 'null' AS d FROM range(3)")
_by_row("fn_hash_unistr", "SELECT hex(sha3('abc')) AS h, unistr('a\\00e9b') AS u, hex(zeroblob(3)) AS z", "SELECT '3A985DA74FE225B2045C172D6BD390BD855F086E3E9D525B46BFE24511431532' AS h, 'aéb' AS u, '000000' AS z")

# --- full text ----------------------------------------------------------------------------------
_q("fts_match", "SELECT p_partkey FROM part WHERE to_tsvector('simple', p_name) @@ to_tsquery('simple', 'red & !ring')", "SELECT p_partkey FROM part WHERE list_contains(string_split(p_name, ' '), 'red') AND NOT list_contains(string_split(p_name, ' '), 'ring')")
_q("fts_phrase_prefix", "SELECT p_partkey FROM part WHERE to_tsvector('simple', p_name) @@ to_tsquery('simple', 'small <-> ri:*')", "SELECT p_partkey FROM part WHERE p_name LIKE '%small ri%'")
_by_row("fts_vector", "SELECT to_tsvector('The quick brown foxes jumped over the lazy dogs') AS v, plainto_tsquery('The fat cats') AS p, websearch_to_tsquery('\"fat cats\" -mouse') AS w, ts_headline('english', 'Two cats sat', to_tsquery('cat')) AS h, numnode(to_tsquery('a1 & b1 | c1')) AS n", """SELECT '''brown'':3 ''dog'':9 ''fox'':4 ''jump'':5 ''lazi'':8 ''quick'':2' AS v, '''fat'' & ''cat''' AS p, '''fat'' <-> ''cat'' & !''mouse''' AS w, 'Two <b>cats</b> sat' AS h, 5 AS n""")
_q("fts_rank", "SELECT p_partkey, round(ts_rank(to_tsvector('simple', p_name), to_tsquery('simple', 'red | bolt')), 9) AS r FROM part", "SELECT p_partkey, round((list_contains(string_split(p_name, ' '), 'red')::INT + list_contains(string_split(p_name, ' '), 'bolt')::INT) * 0.1 / (1 + 0.1 * len(string_split(p_name, ' '))), 9) AS r FROM part")

# --- geometry -----------------------------------------------------------------------------------
_PT = "st_point(c_nationkey - 12, c_acctbal / 200.0)"
_q("geo_distance", f"SELECT c_custkey, round(st_distance({_PT}, 'POINT(1 2)'), 6) AS d, st_astext({_PT}) = st_astext({_PT}) AS same FROM customer", "SELECT c_custkey, round(sqrt(pow(c_nationkey - 13, 2) + pow(c_acctbal / 200.0 - 2, 2)), 6) AS d, 1 AS same FROM customer")
_q("geo_sphere", f"SELECT c_custkey, round(st_distancesphere({_PT}, 'POINT(0 0)'), 3) AS m FROM customer", "SELECT c_custkey, round(2 * 6371008.8 * asin(sqrt(pow(sin(radians(-(c_acctbal / 200.0)) / 2), 2) + cos(radians(c_acctbal / 200.0)) * pow(sin(radians(-(c_nationkey - 12)) / 2), 2))), 3) AS m FROM customer")
_q("geo_dwithin", f"SELECT c_custkey FROM customer WHERE st_dwithin({_PT}, 'POINT(0 10)', 8.0)", "SELECT c_custkey FROM customer WHERE sqrt(pow(c_nationkey - 12, 2) + pow(c_acctbal / 200.0 - 10, 2)) <= 8.0")
_q("geo_predicates", f"SELECT c_custkey, st_contains('POLYGON((-5 -5,-5 15,5 15,5 -5,-5 -5))', {_PT}) AS c, st_intersects('POLYGON((-5 -5,-5 15,5 15,5 -5,-5 -5))', {_PT}) AS i FROM customer", "SELECT c_custkey, (abs(c_nationkey - 12) < 5 AND c_acctbal / 200.0 > -5 AND c_acctbal / 200.0 < 15)::INT AS c, (abs(c_nationkey - 12) <= 5 AND c_acctbal / 200.0 BETWEEN -5 AND 15)::INT AS i FROM customer")
_by_row("geo_measures", "SELECT st_area('POLYGON((0 0,4 0,4 3,0 3,0 0),(1 1,2 1,2 2,1 2,1 1))') AS a, st_length('LINESTRING(0 0,3 4,3 8)') AS l, st_perimeter('POLYGON((0 0,4 0,4 3,0 3,0 0))') AS p, st_astext(st_centroid('POLYGON((0 0,4 0,4 2,0 2,0 0))')) AS c, st_npoints('LINESTRING(0 0,1 1)') AS n, st_geometrytype('POINT(1 2)') AS t, st_astext(st_envelope('LINESTRING(0 0,2 3)')) AS e, st_asgeojson('POINT(1 2.5)') AS g", """SELECT 11.0::DOUBLE AS a, 9.0::DOUBLE AS l, 14.0::DOUBLE AS p, 'POINT(2 1)' AS c, 2 AS n, 'POINT' AS t, 'POLYGON((0 0,0 3,2 3,2 0,0 0))' AS e, '{"type":"Point","coordinates":[1,2.5]}' AS g""")
_by_row("geo_relations", "SELECT st_touches('POLYGON((0 0,1 0,1 1,0 1,0 0))', 'POLYGON((1 0,2 0,2 1,1 1,1 0))') AS t, st_overlaps('POLYGON((0 0,2 0,2 2,0 2,0 0))', 'POLYGON((1 1,3 1,3 3,1 3,1 1))') AS o, st_crosses('LINESTRING(0 0,2 2)', 'LINESTRING(0 2,2 0)') AS c, st_disjoint('POINT(0 0)', 'POINT(1 1)') AS d, st_equals('LINESTRING(0 0,1 1)', 'LINESTRING(1 1,0 0)') AS e, st_within('POINT(1 1)', 'POLYGON((0 0,2 0,2 2,0 2,0 0))') AS w", "SELECT 1 AS t, 1 AS o, 1 AS c, 1 AS d, 1 AS e, 1 AS w")
_by_row("geo_poly", "SELECT geopoly_area('[[0,0],[2,0],[2,2],[0,2],[0,0]]') AS a, geopoly_bbox('[[0,0],[2,1],[0,2],[0,0]]') AS b, geopoly_contains_point('[[0,0],[2,0],[2,2],[0,2],[0,0]]', 1, 1) AS c, geopoly_overlap('[[0,0],[2,0],[2,2],[0,2],[0,0]]', '[[5,5],[6,5],[6,6],[5,5]]') AS o", "SELECT 4.0::DOUBLE AS a, '[[0,0],[2,0],[2,2],[0,2],[0,0]]' AS b, 2 AS c, 0 AS o")
_q("geo_knn", f"SELECT c_custkey FROM customer ORDER BY {_PT} <-> 'POINT(0 10)', c_custkey LIMIT 7", "SELECT c_custkey FROM customer ORDER BY sqrt(pow(c_nationkey - 12, 2) + pow(c_acctbal / 200.0 - 10, 2)), c_custkey LIMIT 7")
