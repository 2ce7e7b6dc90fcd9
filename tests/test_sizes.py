"""Queries whose tables grew: whole results where the small tables gave no sign."""


def test_recursion_of_more_than_a_million_rows(engine, spark):
    engine.register("many", spark.range(400_000))
    got = engine.sql("WITH RECURSIVE c(k, d) AS (SELECT id, 0 FROM many UNION ALL SELECT k, d + 1 FROM c WHERE d < 3) SELECT d, count(*) AS n FROM c GROUP BY d")
    assert sorted(tuple(r) for r in got.collect()) == [(d, 400_000) for d in range(4)]


def test_exists_in_exists_makes_no_pairs(engine, spark):
    engine.register("w", spark.createDataFrame([(1, 1, 1), (2, 1, 2), (3, 2, 1), (4, None, 1), (5, 3, 3)], "id bigint, k bigint, j bigint"))
    engine.register("a", spark.createDataFrame([(1, 5), (1, 2), (2, None), (3, 9)], "k bigint, y bigint"))
    engine.register("b", spark.createDataFrame([(1, 4.0), (1, None), (2, 5.0), (None, 0.0)], "j bigint, x double"))
    for op, yes in (("<", [1]), ("<=", [1, 2]), (">", [1, 2]), (">=", [1, 2])):
        exists = f"EXISTS (SELECT 1 FROM a WHERE a.k = w.k AND EXISTS (SELECT 1 FROM b WHERE b.j = w.j AND x {op} y))"
        got = engine.sql(f"SELECT id FROM w WHERE {exists}")
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Cross" not in plan and "NestedLoop" not in plan
        assert sorted(r.id for r in got.collect()) == yes
        no = engine.sql(f"SELECT id FROM w WHERE NOT {exists}")
        assert sorted(r.id for r in no.collect()) == sorted({1, 2, 3, 4, 5} - set(yes))


def test_equal_sums_are_peers_in_any_order(engine, spark):
    groups = {1: [0.1, 0.2, 0.3], 2: [0.3, 0.2, 0.1, None], 3: [-1e16, 0.5, 1e16], 4: [0.5], 5: [1e300, 1e300], 6: [None], 7: [float("inf"), 1.0], 8: [-1e-10], 9: [1e-10, -2e-10]}
    engine.register("z", spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g int, v double").coalesce(1))
    got = engine.sql("SELECT g, sum(v) AS t, total(v) AS u, avg(v) AS a, sum(v) FILTER (WHERE v > 0) AS p, rank() OVER (ORDER BY sum(v) DESC) AS r FROM z GROUP BY g")
    found = {r.g: tuple(r)[1:] for r in got.collect()}
    assert {g: r[4] for g, r in found.items()} == {7: 1, 5: 2, 1: 3, 2: 3, 3: 5, 4: 5, 8: 7, 9: 7, 6: 9}
    assert found[1][:4] == (0.6, 0.6, 0.6 / 3, 0.6) and found[3][:4] == (0.5, 0.5, 0.5 / 3, 1e16) and found[6][:4] == (None, 0.0, None, None)
    assert found[8][:4] == (-1e-10, -1e-10, -1e-10, None)
    for over in ("(ORDER BY t)", "w"):
        alias = engine.sql(f"SELECT g, sum(v) AS t, dense_rank() OVER {over} AS r FROM z WHERE g < 3 GROUP BY g WINDOW w AS (ORDER BY total(v))")
        assert sorted((r.g, r.t, r.r) for r in alias.collect()) == [(1, 0.6, 1), (2, 0.6, 1)]


def test_pairs_of_large_groups_are_dealt_in_blocks(engine, spark):
    rows = [(i, i % 2 if i % 50 else None, i // 3 if i % 70 else None, f"n{i}") for i in range(1400)]
    engine.register("big", spark.createDataFrame(rows, "id bigint, g bigint, k bigint, name string"))
    want = sorted((a[0], b[3]) for a in rows for b in rows if None not in (a[1], b[1], a[2], b[2]) and a[1] == b[1] and a[2] < b[2])
    for text in ("SELECT a.id, b.name FROM big a JOIN big b ON a.g = b.g AND a.k < b.k", "SELECT q.id, p.name FROM big AS p, big AS q WHERE p.k > q.k AND q.g = p.g"):
        got = engine.sql(text)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan and "collect_list" in plan
        assert sorted(tuple(r) for r in got.collect()) == want
    counted = engine.sql("SELECT a.g, count(*) AS n FROM big a JOIN big b ON a.g = b.g AND a.k < b.k GROUP BY a.g HAVING count(*) > 1 ORDER BY a.g DESC")
    n = {g: sum(rows[a][1] == g for a, _ in want) for g in (1, 0)}
    assert [tuple(r) for r in counted.collect()] == list(n.items())
    some = engine.sql("SELECT a.id, b.id AS other FROM big a JOIN big b ON a.g = b.g AND a.k < b.k WHERE a.id < 3")
    assert "collect_list" not in some._jdf.queryExecution().executedPlan().toString()
