"""Row functions as Arrow UDFs: a batch of columns in, one column out, None for any None argument."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql.functions import arrow_udf

_TYPES = {"string": pa.string(), "double": pa.float64(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}


def batch_udf(fn: Callable, returns: str, arity: int, strict: bool = True):
    """``fn`` of one row's values over whole Arrow batches; strict: not called with a None."""
    kind = _TYPES[returns]

    def over(cols: tuple[pa.Array, ...]) -> pa.Array:
        rows = zip(*(c.to_pylist() for c in cols), strict=True)
        return pa.array([None if strict and None in r else fn(*r) for r in rows], kind)

    def one(a: pa.Array) -> pa.Array:
        return over((a,))

    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        return over((a, b))

    def three(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        return over((a, b, c))

    def four(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
        return over((a, b, c, d))

    def five(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array, e: pa.Array) -> pa.Array:
        return over((a, b, c, d, e))

    def seven(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array, e: pa.Array, f: pa.Array, g: pa.Array) -> pa.Array:
        return over((a, b, c, d, e, f, g))

    return arrow_udf({1: one, 2: two, 3: three, 4: four, 5: five, 7: seven}[arity], returns)


def register_all(spark, made: dict[str, tuple]) -> None:
    """made: name to (fn, returns, arity) or (fn, returns, arity, strict)."""
    for name, spec in made.items():
        spark.udf.register(name, batch_udf(*spec))
