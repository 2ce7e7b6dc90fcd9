"""The engine: dialect SQL in, DataFrames out.

``Engine(spark).register(name, df)`` makes a table known; ``sql(text, params)`` parses, rewrites and
plans a SELECT, and Catalyst runs it. ``translate`` shows the Spark SQL. Statements that change a
table give its new state under the same name, as a DataFrame, or the rows of RETURNING.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import PandasUDFType, pandas_udf, udtf

from .functions import registry
from .functions.arrow import batch_udf
from .operators.recursive import Recursion
from .operators.statements import Rules, Statements
from .plans.emit import Columns, Emitter, Scope
from .plans.typed import E, as_value
from .sql import nodes as N
from .sql.lexer import statements
from .sql.parser import parse
from .sql.statements import Pragma, parse_statement

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
_KINDS = {"tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "float": "real", "double": "real", "string": "text", "binary": "blob", "boolean": "bool", "timestamp": "ts", "timestamp_ntz": "ts", "date": "ts"}


def kind_of(spark_type: str) -> str:
    return _KINDS.get(spark_type, "real" if spark_type.startswith("decimal") else "any")


def columns_of(df: DataFrame) -> Columns:
    return [(f.name, kind_of(f.dataType.simpleString())) for f in df.schema.fields]


class Engine:
    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, {}
        self.views: dict[str, tuple[N.Query, list[str] | None]] = {}
        self.rules: dict[str, Rules] = {}
        if not getattr(spark, "_strataql_installed", False):
            registry.install(spark)
            spark.conf.set("spark.sql.cteRecursionLevelLimit", "1000")
            spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
            spark._strataql_installed = True

    def register(self, name: str, df: DataFrame) -> Engine:
        """Makes a DataFrame a table of this name for dialect SQL."""
        df.createOrReplaceTempView(name)
        self.tables[name.lower()] = columns_of(df)
        return self

    def load(self, folder: str, names: Iterable[str] = TABLES) -> Engine:
        """Registers Parquet tables ``folder/name.parquet``."""
        for name in names:
            self.register(name, self.spark.read.parquet(f"{folder}/{name}.parquet"))
        return self

    # --- extensions

    def function(self, name: str, fn: Callable, returns: str = "string", arity: int = 1) -> Engine:
        """A scalar function of one row's values, run over Arrow batches; None comes as None."""
        self.spark.udf.register(f"u_{name}", batch_udf(fn, returns, arity, strict=False))
        registry.FUNCTIONS[name.lower()] = (arity, arity, lambda a: E(f"u_{name}({', '.join(as_value(x).sql for x in a)})", kind_of(returns)))
        return self

    def aggregate(self, name: str, fn: Callable[[list], Any], returns: str = "double") -> Engine:
        """An aggregate of the list of a group's values; the group must fit a task's memory."""

        def over(values: pd.Series) -> Any:
            return fn(values.tolist())

        self.spark.udf.register(f"u_{name}", pandas_udf(over, returns, PandasUDFType.GROUPED_AGG))
        registry.AGGREGATES[name.lower()] = lambda a, distinct, order, where: E(f"u_{name}({as_value(a[0]).sql})", kind_of(returns))
        return self

    def table_function(self, name: str, cls: type, schema: str) -> Engine:
        """A table function from a class with ``eval``; its arguments may name columns to its left."""
        self.spark.udtf.register(f"u_{name}", udtf(cls, returnType=schema))
        cols = [(c.split()[0], kind_of(c.split()[1])) for c in schema.split(", ")]
        registry.TABLE_FUNCTIONS[name.lower()] = (lambda a: f"u_{name}({', '.join(as_value(x).sql for x in a)})", cols)
        return self

    def collation(self, name: str, key: Callable[[str], str]) -> Engine:
        """A collation by a sort key: texts are equal, and ordered, as their keys are."""
        self.spark.udf.register(f"u_key_{name}", batch_udf(key, "string", 1))
        registry.COLLATIONS[name.upper()] = f"u_key_{name}"
        return self

    def columns(self, name: str) -> Columns | None:
        if name.lower() in ("sqlite_master", "sqlite_schema"):
            rows = [("table", t, t) for t in sorted(self.tables) if not t.startswith(("__", "sqlite_"))] + [("view", v, v) for v in sorted(self.views)]
            df = self.spark.createDataFrame(rows, "type string, name string, tbl_name string")
            df.createOrReplaceTempView(name)
            return columns_of(df)
        got = self.tables.get(name.lower())
        if got is None and self.spark.catalog.tableExists(name):
            got = columns_of(self.spark.table(name))
        return got

    def emitted(self, query: N.Query, params: Mapping[str, Any] | Sequence | None = None) -> str:
        emitter = Emitter(self.columns, Recursion(self.spark), params, self.views, self._pragma)
        emitter.spread = max(emitter.spread, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        return emitter.query(query)[0]

    def _pragma(self, name: str, argument: str | None) -> tuple[str, Columns]:
        told = Statements(self)._pragma(Pragma(name, argument), None)
        told.createOrReplaceTempView(f"pragma_{name}")
        return f"pragma_{name}", columns_of(told)

    def expression(self, x: N.Expr) -> str:
        """The Spark SQL of an expression without columns, such as a default."""
        return as_value(Emitter(self.columns).expr(x, Scope())).sql

    def run(self, query: N.Query, params: Mapping[str, Any] | Sequence | None = None) -> DataFrame:
        return self.spark.sql(self.emitted(query, params))

    def translate(self, text: str, params: Mapping[str, Any] | Sequence | None = None) -> str:
        """The Spark SQL of a SELECT."""
        return self.emitted(parse(text), params)

    def sql(self, text: str, params: Mapping[str, Any] | Sequence | None = None) -> DataFrame:
        """The rows of a SELECT, PRAGMA, EXPLAIN or RETURNING; the new state of a table that is changed."""
        got = parse_statement(text)
        return self.run(got, params) if isinstance(got, N.Query) else Statements(self).run(got, params)

    def script(self, text: str) -> list[DataFrame]:
        """The results of a script's statements, in order."""
        return [self.sql(s) for s in statements(text)]

    def catalog(self) -> DataFrame:
        """Tables and their columns: name, column, kind and place."""
        rows = [(t, c, k, i) for t, cols in sorted(self.tables.items()) for i, (c, k) in enumerate(cols)]
        return self.spark.createDataFrame(rows, "table_name string, column_name string, kind string, place int")
