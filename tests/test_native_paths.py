"""Points and simple words go through built-in functions, and give what the UDFs' functions give."""

import math

import pytest

from strataql.functions import fts

TEXTS = ["red ring", "Red's bolt", "o'neil RED", "'s red", "a''b's", "ÉTÉ été", "x_y z", "", "   ", "½ 12 red9", "red red", "ΟΔΟΣ red", "K3 İx", None]
QUERIES = ["red", "red & !ring", "bolt | ring", "oneil", "!red", "re:*", "(red & bolt) | x", "été", "'s'", "red <-> ring", "12 & red9"]
POINTS = [(0.0, 0.0), (3.5, -4.25), (-1e9, 2.0), (0.1, 1 / 3), (None, 1.0), (2.0, None)]


@pytest.fixture(scope="module")
def made(spark):
    from strataql.engine import Engine

    texts = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(POINTS)], "i int, x double, y double")
    return Engine(spark).register("texts", texts).register("points", points)


def python_in(df) -> bool:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "Python" in plan or "Arrow" in plan


@pytest.mark.parametrize("query", QUERIES)
def test_words_match_as_vectors_do(made, query):
    got = made.sql(f"SELECT i, to_tsvector('simple', t) @@ to_tsquery('simple', '{query.replace(chr(39), chr(39) * 2)}') AS m FROM texts")
    tree = fts.parsed(fts.to_tsquery("simple", query))
    want = {i: None if t is None else int(fts.matches(fts.parse_vector(fts.render(fts.vector("simple", t))), tree)) for i, t in enumerate(TEXTS)}
    assert {r.i: None if r.m is None else int(r.m) for r in got.collect()} == want
    assert python_in(got) == ("<->" in query)


@pytest.mark.parametrize("query", ["red", "red NOT ring", "bolt OR ring", "re*", "red bolt", '"red ring"'])
def test_bare_queries(made, query):
    got = {r.i: None if r.m is None else int(r.m) for r in made.sql(f"SELECT i, t MATCH '{query}' AS m FROM texts").collect()}
    assert got == {i: None if t is None else int(fts.fts_match(t, query)) for i, t in enumerate(TEXTS)}


def test_constant_queries_of_english(made):
    got = made.sql("SELECT i FROM texts WHERE to_tsvector(t) @@ to_tsquery('rings')")
    assert [r.i for r in got.collect()] == [0]


def test_points_are_arithmetic(made):
    got = made.sql("SELECT i, st_distance(st_point(x, y), 'POINT(1 2)') AS d, st_point(x, y) <-> 'SRID=4326;POINT(1 2)' AS k, st_x(st_point(x, y)) AS x, st_y('POINT(3 4)') AS y, st_dwithin(st_point(x, y), st_point(0, 0), 6) AS w FROM points")
    for r in got.collect():
        x, y = POINTS[r.i]
        if None in (x, y):
            assert (r.d, r.k, r.x, r.y, r.w) == (None, None, None, 4.0, None)
        else:
            assert r.d == r.k == pytest.approx(math.dist((x, y), (1, 2)), rel=1e-15)
            assert (r.x, r.y, int(r.w)) == (x, 4.0, int(math.hypot(x, y) <= 6))
    assert not python_in(got)


def test_other_shapes_keep_their_function(made):
    got = made.sql("SELECT st_distance(st_point(x, y), 'LINESTRING(0 -1,10 -1)') AS d, st_distance(st_point(x, y), 'POINT EMPTY') AS e FROM points WHERE i = 0").collect()
    assert [(r.d, r.e) for r in got] == [(1.0, None)]


def test_nearest_is_a_top_n_without_python(engine):
    got = engine.sql("SELECT c_custkey FROM customer ORDER BY st_point(c_nationkey, c_acctbal) <-> 'POINT(5 500)', c_custkey LIMIT 10")
    assert not python_in(got) and "TakeOrdered" in got._jdf.queryExecution().executedPlan().toString()
