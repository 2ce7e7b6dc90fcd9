"""Recursive common table expressions.

One recursive arm under UNION ALL is Spark's own. Other shapes (UNION, several arms, LIMIT inside)
run level by level: each frontier is checkpointed, so lineage stays short, and UNION drops rows seen
before. ORDER BY makes the queue a priority queue, which is run row by row on the driver.
"""

from __future__ import annotations

import heapq
import tempfile
from itertools import count

from pyspark.sql import DataFrame, SparkSession

from strataql.plans.typed import E, ident, to_type
from strataql.sql import nodes as N
from strataql.sql.lexer import SqlError

_SQL = {"int": "BIGINT", "bool": "BIGINT", "real": "DOUBLE", "text": "STRING", "json": "STRING", "blob": "BINARY", "null": "STRING"}
MAX_LEVELS = 10_000


def durable(df: DataFrame) -> DataFrame:
    """Cut off from its lineage by a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="strataql-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def _arms(body) -> list[tuple[str, object]]:
    if isinstance(body, N.SetOp):
        return [*_arms(body.left), (body.op, body.right)]
    return [("", body)]


class Recursion:
    numbers = count()

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __call__(self, emitter, name: str, columns: list[str] | None, query: N.Query) -> tuple[str, list[tuple[str, str]], str | None]:
        from strataql.plans.emit import _mentions

        arms = _arms(query.body)
        base = [a for a in arms if not _mentions(a[1], name)]
        steps = [a for a in arms if _mentions(a[1], name)]
        if not base or not steps:
            raise SqlError(f"circular reference: {name}")
        start = base[0][1]
        for op, arm in base[1:]:
            start = N.SetOp(op, start, arm)
        sql, cols = emitter.body(start, None)
        cols = [(n, k if k != "null" else "text") for n, k in (zip(columns, [k for _, k in cols], strict=True) if columns else cols)]

        def shaped(text: str, have) -> str:
            names = [f"c{i}" for i in range(len(have))]
            items = [f"cast({to_type(E(n, h), k).sql} AS {_SQL.get(k, 'STRING')}) AS {ident(c)}" if k in _SQL else f"{n} AS {ident(c)}" for n, (_, h), (c, k) in zip(names, have, cols, strict=True)]
            return f"SELECT {', '.join(items)} FROM ({text}) AS __s({', '.join(names)})"

        first = shaped(sql, cols)
        if len(steps) == 1 and steps[0][0] == "UNION ALL" and query.limit is None and not query.order:
            emitter.ctes[-1][name.lower()] = (ident(name), cols)
            arm, have = emitter.body(steps[0][1], None)
            return ident(name), cols, f"{first} UNION ALL {shaped(arm, have)}"
        distinct = steps[-1][0] == "UNION"
        limit = emitter._constant(query.limit) if query.limit is not None else None
        skip = (emitter._constant(query.offset) if query.offset is not None else 0) or 0
        need = None if limit is None or limit < 0 else limit + skip

        def step(view: str) -> DataFrame:
            emitter.ctes[-1][name.lower()] = (view, cols)
            out = None
            for _, arm in steps:
                text, have = emitter.body(arm, None)
                df = self.spark.sql(shaped(text, have))
                out = df if out is None else out.union(df)
            return out

        if query.order:
            result = self._by_priority(first, step, query, cols, distinct, need)
        else:
            result = self._by_level(first, step, distinct, need)
        if need is not None:
            result = result.limit(need).offset(skip) if skip else result.limit(need)
        view = f"__recursive{next(self.numbers)}"
        result.createOrReplaceTempView(view)
        return view, cols, None

    def _by_level(self, first: str, step, distinct: bool, need: int | None) -> DataFrame:
        frontier = self.spark.sql(first)
        seen = frontier = durable(frontier.distinct() if distinct else frontier)
        rows = frontier.count() if need is not None else 0
        for _ in range(MAX_LEVELS):
            if need is not None and rows >= need:
                return seen
            view = f"__frontier{next(self.numbers)}"
            frontier.createOrReplaceTempView(view)
            new = step(view)
            frontier = durable(new.subtract(seen) if distinct else new)
            self.spark.catalog.dropTempView(view)
            if frontier.isEmpty():
                return seen
            rows += frontier.count() if need is not None else 0
            seen = seen.union(frontier)
        raise SqlError("recursion goes too deep")

    def _by_priority(self, first: str, step, query: N.Query, cols, distinct: bool, need: int | None) -> DataFrame:
        keys = []
        for o in query.order:
            at = o.x.value - 1 if isinstance(o.x, N.Lit) else next(i for i, (c, _) in enumerate(cols) if c.lower() == o.x.name.lower())
            keys.append((at, o.descending))

        class Key(tuple):
            def __lt__(self, other):
                for (at, down), a, b in zip(keys, self[:-1], other[:-1], strict=True):
                    if a != b:
                        if a is None or b is None:
                            return (a is None) != down
                        return (a > b) if down else (a < b)
                return self[-1] < other[-1]

        start = self.spark.sql(first)
        order, queue, out, met = count(), [], [], set()

        def push(rows) -> None:
            for r in rows:
                t = tuple(r)
                if distinct and t in met:
                    continue
                met.add(t)
                heapq.heappush(queue, (Key((*(t[at] for at, _ in keys), next(order))), t))

        push(start.collect())
        while queue and (need is None or len(out) < need):
            if len(out) > MAX_LEVELS:
                raise SqlError("recursion goes too deep")
            _, row = heapq.heappop(queue)
            out.append(row)
            view = f"__frontier{next(self.numbers)}"
            self.spark.createDataFrame([row], start.schema).createOrReplaceTempView(view)
            push(step(view).collect())
        return self.spark.createDataFrame(out, start.schema)
