"""Statements that change tables, and values, against the standard library's sqlite3."""

import sqlite3

import pytest

from strataql.engine import Engine
from strataql.functions.fts import stem
from strataql.sql.lexer import SqlError

ROWS = [(1, "apple", 1.5, 10), (2, "Banana", -2.0, None), (3, None, 1e14, 3), (4, "10", 123456789.0, -7), (5, "é", 1e-5, 0), (6, "4x", 0.25, 9)]


@pytest.fixture(scope="module")
def both(spark):
    engine = Engine(spark).register("t", spark.createDataFrame(ROWS, "id bigint, s string, r double, n bigint"))
    db = sqlite3.connect(":memory:", isolation_level=None)
    db.execute("CREATE TABLE t (id INTEGER, s TEXT, r REAL, n INTEGER)")
    db.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", ROWS)
    return engine, db


def plain(rows):
    return sorted((tuple(float(x) if isinstance(x, int | float) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT a.id, (SELECT b.s FROM t b WHERE b.id = a.id + 1) FROM t a",
        "SELECT id, n IN (SELECT n FROM t), n NOT IN (SELECT NULL) FROM t",
        "SELECT id FROM t WHERE NOT (id IN (SELECT n FROM t) OR id > 5)",
        "SELECT id * 9223372036854775807, 9223372036854775807 + 1 FROM t",
        "SELECT r || '', quote(r), cast(r AS TEXT) FROM t",
        "SELECT id, s > 5, s = 10, s BETWEEN 1 AND 'b', n > '5', s IN (10, 'apple'), s IS 10, '10' = 10 FROM t",
        "SELECT 'É' LIKE 'é', s LIKE '%PP%', CAST(1e30 AS INTEGER), CAST('99999999999999999999' AS INTEGER) FROM t",
        "SELECT DISTINCT s, n FROM t ORDER BY n + 1, upper(s)",
        "SELECT id, date('2024-01-31', n || ' days'), datetime('2024-01-01', '-0' || id || ':30') FROM t",
    ],
)
def test_values(both, sql):
    engine, db = both
    assert plain(engine.sql(sql).collect()) == plain(db.execute(sql).fetchall())


SCRIPT = """CREATE TABLE u (k INTEGER PRIMARY KEY, n INTEGER DEFAULT 3, note TEXT NOT NULL DEFAULT 'x')
INSERT INTO u (k, n, note) VALUES (1, 10, 'a'), (2, 20, 'b'), (5, NULL, 'c')
INSERT INTO u (note) VALUES ('auto')
INSERT OR IGNORE INTO u VALUES (1, 99, 'no'), (7, 70, 'yes')
REPLACE INTO u VALUES (2, 21, 'bb')
INSERT INTO u VALUES (1, 5, 'p'), (9, 9, 'q') ON CONFLICT (k) DO UPDATE SET n = n + excluded.n, note = note || excluded.note RETURNING k, n
UPDATE u SET n = t.n FROM t WHERE t.id = u.k AND t.n IS NOT NULL
DELETE FROM u WHERE n IS NULL OR k = 9 RETURNING *
WITH big AS (SELECT k FROM u WHERE n > 9) UPDATE u SET note = 'big' WHERE k IN (SELECT k FROM big)
ALTER TABLE u ADD COLUMN extra TEXT DEFAULT 'e'
CREATE VIEW v AS SELECT k, note, extra FROM u
SELECT * FROM v
PRAGMA table_info(u)
SELECT * FROM u"""


def test_script(both):
    engine, db = both
    for sql in SCRIPT.split("\n"):
        want = db.execute(sql).fetchall()
        got = engine.sql(sql)
        if sql.startswith(("SELECT", "PRAGMA")) or "RETURNING" in sql:
            assert plain(got.collect()) == plain(want), sql
    for bad in ("INSERT INTO u (k) VALUES (1)", "INSERT INTO u VALUES (50, 1, NULL, 'e')", "UPDATE u SET nope = 1", "DROP TABLE nope", "CREATE TABLE u (a INTEGER)"):
        with pytest.raises(SqlError):
            engine.sql(bad)


def test_stems():
    words = {"running": "run", "jumped": "jump", "foxes": "fox", "lazy": "lazi", "source": "source", "agreed": "agree", "need": "need", "hoping": "hope", "hopped": "hop", "ponies": "poni", "ties": "tie", "bus": "bus", "boss": "boss", "played": "play", "government": "govern", "quickly": "quick"}
    assert {w: stem(w) for w in words} == words
