"""Statements that change tables: each makes a new state of the table from the old one, as a plan.

A table's state is a DataFrame under its name; a change is a query over the state before, written as
a syntax tree and emitted like any SELECT, so its expressions follow the dialect. A new state is
written in the shared folder, so that plans don't grow with the number of changes. Rows meet by their
key with joins on hash partitions; nothing is collected but the counts of broken constraints. Rows
that ORDER BY … LIMIT or a join picks out of a table are told by its key, or without a declared one
by a number that is given to each row of the state and written in the shared folder.

Defined cases: a NULL key is equal to no other; of new rows with equal keys the last by all columns
is taken (the first for OR IGNORE and DO NOTHING); RETURNING gives the changed rows as they are
after the change, of DELETE before it; FAIL and ROLLBACK end as ABORT does, with nothing changed.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from itertools import count
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataql.sql import nodes as N
from strataql.sql import statements as S
from strataql.sql.lexer import SqlError

from . import changes
from .recursive import durable

if TYPE_CHECKING:
    from strataql.engine import Engine

ROW = "__row"


@dataclass
class Rules:
    """What a table was declared with."""

    columns: dict[str, S.Column] = field(default_factory=dict)
    keys: list[list[str]] = field(default_factory=list)
    primary: bool = False
    checks: list[N.Expr] = field(default_factory=list)
    references: list[S.Reference] = field(default_factory=list)


def spark_type(declared: str) -> str:
    """The Spark type by a declared type's affinity."""
    if "INT" in declared or "BOOL" in declared:
        return "bigint"
    if any(w in declared for w in ("CHAR", "CLOB", "TEXT")):
        return "string"
    if "BLOB" in declared or not declared:
        return "binary" if declared else "string"
    return "double"


class Statements:
    numbers = count()

    def __init__(self, engine: Engine):
        self.engine = engine

    def run(self, s, params=None) -> DataFrame:
        return getattr(self, "_" + type(s).__name__.lower())(s, params)

    # --- helpers

    def _state(self, name: str) -> DataFrame:
        if self.engine.columns(name) is None:
            raise SqlError(f"no such table: {name}")
        return self.engine.spark.table(name)

    def _rules(self, name: str) -> Rules:
        return self.engine.rules.get(name.lower(), Rules())

    def _view(self, df: DataFrame, stem: str) -> str:
        name = f"__{stem}{next(self.numbers)}"
        self.engine.register(name, df)
        return name

    def _select(self, columns, source, where=None, ctes=(), params=None) -> DataFrame:
        return self.engine.run(N.Query(N.Core(list(columns), source, where), list(ctes)), params)

    def _keep(self, table: str, state: DataFrame) -> DataFrame:
        state = durable(state)
        self.engine.register(table, state)
        return state

    def _as_columns(self, rows: DataFrame, like: DataFrame) -> DataFrame:
        return rows.select([F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in like.schema.fields])

    def _returned(self, returning, rows: DataFrame, table: str, new: DataFrame, params) -> DataFrame:
        if returning is None:
            return new
        return self._select(returning, N.Table(self._view(rows, "returned"), table), params=params)

    def _numbered(self, table: str) -> tuple[DataFrame, list[str]]:
        """The state with columns that tell its rows apart."""
        state, rules = self._state(table), self._rules(table)
        if rules.primary:
            return state, rules.keys[0]
        return durable(state.withColumn(ROW, F.monotonically_increasing_id())), [ROW]

    def _check(self, table: str, rows: DataFrame, whole: DataFrame | None) -> None:
        """Raises at the first kind of constraint that rows break; whole: the state in which keys must differ."""
        rules = self._rules(table)
        for c in rules.columns.values():
            if c.not_null and rows.filter(F.col(f"`{c.name}`").isNull()).take(1):
                raise SqlError(f"NOT NULL constraint failed: {table}.{c.name}")
        if rules.checks:
            view = self._view(rows, "checked")
            for check in rules.checks:
                if self._select([(N.Lit(1, "int"), None)], N.Table(view, table), N.Truth(check, False, False)).take(1):
                    raise SqlError(f"CHECK constraint failed: {table}")
        for keys in rules.keys if whole is not None else ():
            twice = whole.dropna(subset=keys).groupBy(*keys).count().filter("count > 1")
            if twice.take(1):
                raise SqlError(f"UNIQUE constraint failed: {', '.join(f'{table}.{k}' for k in keys)}")
        for r in rules.references:
            parent = self._state(r.parent).select([F.col(k).alias(f"__{i}") for i, k in enumerate(self._parent_keys(r))])
            on = [F.col(c) == F.col(f"__{i}") for i, c in enumerate(r.columns)]
            if rows.dropna(subset=r.columns).join(parent, on, "left_anti").take(1):
                raise SqlError("FOREIGN KEY constraint failed")

    def _parent_keys(self, r: S.Reference) -> list[str]:
        return r.keys or self._rules(r.parent).keys[0]

    # --- changes

    def _insert(self, s: S.Insert, params) -> DataFrame:
        old, rules = self._state(s.table), self._rules(s.table)
        given = s.columns or ([f.name for f in old.schema.fields] if s.query is not None else [])
        rows = self.engine.run(s.query, params) if s.query is not None else self.engine.spark.range(1).select()
        if len(rows.columns) != len(given):
            raise SqlError(f"table {s.table} has {len(given)} columns but {len(rows.columns)} values were supplied")
        rows = rows.toDF(*given) if given else rows
        for c in old.columns:
            if c.lower() not in {g.lower() for g in given}:
                spec = rules.columns.get(c.lower())
                value = F.expr(self.engine.expression(spec.default)) if spec is not None and spec.default is not None else F.lit(None)
                rows = rows.withColumn(c, value)
        new = self._as_columns(rows, old)
        for c in rules.columns.values():
            if c.auto:  # a key that isn't given goes on from the largest
                top = old.agg(F.coalesce(F.max(c.name), F.lit(0))).first()[0]
                missing = new.filter(F.col(c.name).isNull())
                if missing.take(1):
                    numbered = durable(missing.withColumn(ROW, F.monotonically_increasing_id()))
                    numbered = numbered.withColumn(c.name, F.row_number().over(Window.orderBy(ROW)).cast("bigint") + F.lit(top)).drop(ROW)
                    new = new.filter(F.col(c.name).isNotNull()).unionByName(numbered)
        if s.conflicts:
            state, touched = self._upsert(s, old, new, params)
        elif s.action in ("IGNORE", "REPLACE") and rules.keys:
            state, touched = old, new
            for keys in rules.keys:
                if s.action == "IGNORE":
                    touched = changes.insert_or_ignore(old.limit(0), touched, keys).join(state.select(keys), keys, "left_anti").select(old.columns)
                else:
                    touched = changes.insert_or_replace(old.limit(0), touched, keys)
                    state = state.join(touched.select(keys), keys, "left_anti").select(old.columns)
            state = state.unionByName(touched)
        else:
            state, touched = changes.insert(old, new), new
        touched = durable(touched) if s.returning or rules.columns else touched
        self._check(s.table, touched, state)
        return self._returned(s.returning, touched, s.table, self._keep(s.table, state), params)

    def _upsert(self, s: S.Insert, old: DataFrame, new: DataFrame, params) -> tuple[DataFrame, DataFrame]:
        rules, rest, state, touched = self._rules(s.table), new, old, None
        for c in s.conflicts:
            for keys in [c.keys] if c.keys else rules.keys:
                hits = rest.join(state.select(keys), keys, "left_semi").select(new.columns)
                rest = rest.join(state.select(keys), keys, "left_anti").select(new.columns)
                if c.sets is None:
                    rest = changes.insert_or_ignore(old.limit(0), rest, keys)
                    continue
                last = changes.insert_or_replace(old.limit(0), hits, keys).withColumn("__new", F.lit(1))
                on = None
                for k in keys:
                    term = N.Binary("=", N.Col(k, s.table), N.Col(k, "excluded"))
                    on = term if on is None else N.Binary("AND", on, term)
                source = N.Join("LEFT", N.Table(self._view(state, "old"), s.table), N.Table(self._view(last, "new"), "excluded"), on)
                hit = N.Is(N.Col("__new", "excluded"), N.Lit(None, "null"), True)
                hit = N.Binary("AND", hit, N.Truth(c.where, True, False)) if c.where is not None else hit
                columns = self._set_columns(state, c.sets, hit, s.table)
                both = durable(self._select([*columns, (hit, "__hit")], source, params=params))
                state = self._as_columns(both.drop("__hit"), old)
                mine = self._as_columns(both.filter("__hit = 1").drop("__hit"), old)
                touched = mine if touched is None else touched.unionByName(mine)
                rest = changes.insert_or_replace(old.limit(0), rest, keys)
        return state.unionByName(rest), rest if touched is None else touched.unionByName(rest)

    def _set_columns(self, state: DataFrame, sets, hit: N.Expr | None, alias: str):
        """The columns of a state after SET, where ``hit`` holds."""
        made: dict[str, N.Expr] = {}
        for names, x in sets:
            items = x.items if isinstance(x, N.Row) else [x]
            if len(items) != len(names):
                raise SqlError(f"{len(names)} columns assigned {len(items)} values")
            made |= {n.lower(): i for n, i in zip(names, items, strict=True)}
        unknown = set(made) - {c.lower() for c in state.columns}
        if unknown:
            raise SqlError(f"no such column: {min(unknown)}")
        out = []
        for c in state.columns:
            x = made.get(c.lower())
            plain = N.Col(c, alias)
            out.append((plain if x is None else x if hit is None else N.Case(None, [(hit, x)], plain), c))
        return out

    def _picked(self, s, state: DataFrame, keys: list[str], params) -> DataFrame:
        """Keys of the rows that WHERE, ORDER BY and LIMIT leave, and the new values of UPDATE … FROM."""
        alias = s.alias or s.table
        source = N.Table(self._view(state, "state"), alias)
        body = N.Core([(N.Col(k, alias), k) for k in keys], source, s.where)
        return self.engine.run(N.Query(body, list(s.ctes), order=s.order, limit=s.limit, offset=s.offset), params)

    def _update(self, s: S.Update, params) -> DataFrame:
        old, alias = self._state(s.table), s.alias or s.table
        if s.source is None and s.limit is None:
            hit = N.Truth(s.where, True, False) if s.where is not None else N.Lit(True, "bool")
            both = self._select([*self._set_columns(old, s.sets, hit, alias), (hit, "__hit")], N.Table(s.table, alias), ctes=s.ctes, params=params)
        else:
            state, keys = self._numbered(s.table)
            if s.source is not None:
                source = N.Join("CROSS", N.Table(self._view(state, "state"), alias), s.source)
                shown = self._set_columns(old, s.sets, None, alias)
                found = self._select([*((N.Col(k, alias), f"__k{i}") for i, k in enumerate(keys)), *((x, f"__n{i}") for i, (x, _) in enumerate(shown))], source, s.where, s.ctes, params)
                values = [f"__n{i}" for i in range(len(shown))]
                one = found.groupBy(*[f"__k{i}" for i in range(len(keys))]).agg(F.max(F.struct(*values)).alias("__v"))  # of several matches one
                on = [F.col(f"`{k}`") == F.col(f"__k{i}") for i, k in enumerate(keys)]
                joined = state.join(one, on, "left")
                hit = F.col("__v").isNotNull()
                both = joined.select(*[F.when(hit, F.col(f"__v.__n{i}")).otherwise(F.col(f"`{c}`")).alias(c) for i, c in enumerate(old.columns)], hit.cast("int").alias("__hit"))
            else:
                chosen = self._picked(s, state, keys, params).withColumn("__hit", F.lit(1))
                marked = self._view(state.join(chosen, keys, "left"), "marked")
                hit = N.Is(N.Col("__hit", alias), N.Lit(None, "null"), True)
                both = self._select([*self._set_columns(old, s.sets, hit, alias), (hit, "__hit")], N.Table(marked, alias), params=params)
        both = durable(both)
        new = self._as_columns(both.drop("__hit"), old)
        touched = self._as_columns(both.filter("__hit = 1").drop("__hit"), old)
        self._check(s.table, touched, new)
        self.engine.register(s.table, new)
        return self._returned(s.returning, touched, s.table, new, params)

    def _delete(self, s: S.Delete, params) -> DataFrame:
        old, alias = self._state(s.table), s.alias or s.table
        columns = [(N.Col(c, alias), c) for c in old.columns]
        if s.limit is None:
            where = s.where or N.Lit(True, "bool")
            gone = self._select(columns, N.Table(s.table, alias), where, s.ctes, params)
            new = self._select(columns, N.Table(s.table, alias), N.Truth(where, True, True), s.ctes, params)
        else:
            state, keys = self._numbered(s.table)
            chosen = self._picked(s, state, keys, params)
            gone = state.join(chosen, keys, "left_semi").select(old.columns)
            new = state.join(chosen, keys, "left_anti").select(old.columns)
        gone, new = self._as_columns(gone, old), self._as_columns(new, old)
        self._orphans(s.table, gone)
        return self._returned(s.returning, gone, s.table, self._keep(s.table, new), params)

    def _orphans(self, table: str, gone: DataFrame) -> None:
        """What declared references do to rows of other tables whose parent goes."""
        for child, rules in list(self.engine.rules.items()):
            for r in rules.references:
                if r.parent.lower() != table.lower():
                    continue
                rows = self._state(child)
                keys = gone.select([F.col(k).alias(f"__{i}") for i, k in enumerate(self._parent_keys(r))]).distinct()
                on = [F.col(c) == F.col(f"__{i}") for i, c in enumerate(r.columns)]
                hit = rows.join(keys, on, "left_semi")
                if r.on_delete in ("NO ACTION", "RESTRICT"):
                    if hit.take(1):
                        raise SqlError("FOREIGN KEY constraint failed")
                elif r.on_delete == "CASCADE":
                    self._orphans(child, hit)
                    self._keep(child, rows.join(keys, on, "left_anti"))
                else:
                    default = lambda c: F.expr(self.engine.expression(rules.columns[c.lower()].default)) if r.on_delete == "SET DEFAULT" and rules.columns[c.lower()].default is not None else F.lit(None)  # noqa: B023, E731
                    kept = rows.join(keys.withColumn("__gone", F.lit(True)), on, "left")
                    now = [F.when(F.col("__gone"), default(c)).otherwise(F.col(c)).cast(rows.schema[c].dataType).alias(c) if c in r.columns else F.col(c) for c in rows.columns]
                    self._keep(child, kept.select(now))

    # --- tables

    def _createtable(self, s: S.CreateTable, params) -> DataFrame:
        if s.name.lower() in self.engine.tables or s.name.lower() in self.engine.views:
            if s.if_absent:
                return self._state(s.name)
            raise SqlError(f"table {s.name} already exists")
        if s.query is not None:
            made = self.engine.run(s.query, params)
        else:
            made = self.engine.spark.createDataFrame([], ", ".join(f"`{c.name}` {spark_type(c.type)}" for c in s.columns))
            for c in s.columns:
                c.not_null |= s.primary and c.name in s.keys[0] and not c.auto
            self.engine.rules[s.name.lower()] = Rules({c.name.lower(): c for c in s.columns}, s.keys, s.primary, s.checks, s.references)
        self.engine.register(s.name, made)
        return made

    def _createview(self, s: S.CreateView, params) -> DataFrame:
        if s.name.lower() in self.engine.views and not s.if_absent:
            raise SqlError(f"view {s.name} already exists")
        self.engine.views.setdefault(s.name.lower(), (s.query, s.columns))
        return self.engine.run(N.Query(N.Core([(N.Star(), None)], N.Table(s.name))), params)

    def _drop(self, s: S.Drop, params) -> DataFrame:
        name = s.name.lower()
        if s.kind == "VIEW" and name in self.engine.views:
            del self.engine.views[name]
        elif s.kind == "TABLE" and name in self.engine.tables:
            del self.engine.tables[name]
            self.engine.rules.pop(name, None)
            self.engine.spark.catalog.dropTempView(s.name)
        elif not s.if_present:
            raise SqlError(f"no such {s.kind.lower()}: {s.name}")
        return self.engine.catalog()

    def _alter(self, s: S.Alter, params) -> DataFrame:
        old, rules = self._state(s.table), self._rules(s.table)
        have = {c.lower() for c in old.columns}
        if s.action in ("rename column", "drop") and s.name.lower() not in have:
            raise SqlError(f"no such column: {s.name}")
        if s.action == "rename":
            self._drop(S.Drop("TABLE", s.table, False), params)
            self.engine.rules[s.new.lower()] = rules
            self.engine.register(s.new, old)
            return old
        if s.action == "rename column":
            new = old.withColumnRenamed(s.name, s.new)
            if s.name.lower() in rules.columns:
                rules.columns[s.new.lower()] = replace(rules.columns.pop(s.name.lower()), name=s.new)
                rules.keys = [[s.new if k.lower() == s.name.lower() else k for k in keys] for keys in rules.keys]
        elif s.action == "add":
            if s.column.name.lower() in have:
                raise SqlError(f"duplicate column name: {s.column.name}")
            value = F.expr(self.engine.expression(s.column.default)) if s.column.default is not None else F.lit(None)
            new = old.withColumn(s.column.name, value.cast(spark_type(s.column.type)))
            rules.columns[s.column.name.lower()] = s.column
        else:
            if any(s.name.lower() in map(str.lower, keys) for keys in rules.keys):
                raise SqlError(f"cannot drop column {s.name}: it is part of a key")
            new = old.drop(s.name)
            rules.columns.pop(s.name.lower(), None)
        self.engine.register(s.table, new)
        return new

    # --- telling

    def _explain(self, s: S.Explain, params) -> DataFrame:
        if not isinstance(s.statement, N.Query):
            raise SqlError("EXPLAIN is for queries")
        mode = {"": "FORMATTED", "QUERY PLAN": "", "ANALYZE": "COST"}[s.mode]
        return self.engine.spark.sql(f"EXPLAIN {mode} {self.engine.emitted(s.statement, params)}")

    def _analyze(self, s: S.Analyze, params) -> DataFrame:
        names = [s.table] if s.table else sorted(self.engine.tables)
        out = None
        for n in names:
            one = self._state(n).agg(F.lit(n).alias("tbl"), F.count("*").alias("stat"))
            out = one if out is None else out.union(one)
        return out

    def _pragma(self, s: S.Pragma, params) -> DataFrame:
        make = self.engine.spark.createDataFrame
        if s.name in ("table_info", "table_xinfo"):
            rules, cols = self._rules(s.argument), self.engine.columns(s.argument) or []
            shown = {"int": "INTEGER", "real": "REAL", "text": "TEXT", "blob": "BLOB"}
            rows = []
            for i, (c, kind) in enumerate(cols):
                spec = rules.columns.get(c.lower())
                key = rules.keys[0].index(c) + 1 if rules.primary and c in rules.keys[0] else 0
                default = self.engine.expression(spec.default) if spec is not None and spec.default is not None else None
                rows.append((i, c, spec.type if spec is not None else shown.get(kind, ""), int(spec is not None and spec.not_null), default, key))
            return make(rows, "cid bigint, name string, type string, notnull bigint, dflt_value string, pk bigint")
        if s.name == "foreign_key_list":
            rows = [(i, k, r.parent, c, self._parent_keys(r)[k], "NO ACTION", r.on_delete) for i, r in enumerate(self._rules(s.argument).references) for k, c in enumerate(r.columns)]
            return make(rows, "id bigint, seq bigint, `table` string, `from` string, `to` string, on_update string, on_delete string")
        if s.name == "index_list":
            rules = self._rules(s.argument)
            rows = [(i, f"sqlite_autoindex_{s.argument}_{i + 1}", 1, "pk" if rules.primary and not i else "u", 0) for i in range(len(rules.keys))]
            return make(rows, "seq bigint, name string, `unique` bigint, origin string, partial bigint")
        if s.name == "table_list":
            rows = [("main", n, "table", len(c)) for n, c in sorted(self.engine.tables.items())] + [("main", n, "view", 0) for n in sorted(self.engine.views)]
            return make(rows, "schema string, name string, type string, ncol bigint")
        if s.name == "collation_list":
            from strataql.functions import registry

            return make([(i, n) for i, n in enumerate(["RTRIM", "NOCASE", "BINARY", *registry.COLLATIONS])], "seq bigint, name string")
        if s.name == "database_list":
            return make([(0, "main", "")], "seq bigint, name string, file string")
        raise SqlError(f"no such pragma: {s.name}")
