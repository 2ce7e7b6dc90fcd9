"""Syntax trees of the dialect."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


class Expr:
    pass


@dataclass
class Lit(Expr):
    value: Any
    type: str  # int, real, text, blob, null, bool


@dataclass
class Param(Expr):
    name: str | int


@dataclass
class Col(Expr):
    name: str
    table: str | None = None


@dataclass
class Star(Expr):
    table: str | None = None


@dataclass
class Unary(Expr):
    op: str
    x: Expr


@dataclass
class Binary(Expr):
    op: str
    a: Expr
    b: Expr


@dataclass
class Is(Expr):
    a: Expr
    b: Expr
    negated: bool


@dataclass
class Truth(Expr):
    """x IS [NOT] TRUE or FALSE"""

    x: Expr
    value: bool
    negated: bool


@dataclass
class Between(Expr):
    x: Expr
    low: Expr
    high: Expr
    negated: bool


@dataclass
class In(Expr):
    x: Expr
    items: list[Expr] | None
    query: Query | None
    negated: bool


@dataclass
class Match(Expr):
    """LIKE, GLOB, REGEXP or MATCH"""

    op: str
    x: Expr
    pattern: Expr
    escape: Expr | None
    negated: bool


@dataclass
class Exists(Expr):
    query: Query


@dataclass
class Sub(Expr):
    query: Query


@dataclass
class Case(Expr):
    base: Expr | None
    whens: list[tuple[Expr, Expr]]
    other: Expr | None


@dataclass
class Cast(Expr):
    x: Expr
    type: str


@dataclass
class Collate(Expr):
    x: Expr
    name: str


@dataclass
class Row(Expr):
    items: list[Expr]


@dataclass
class Frame:
    unit: str  # ROWS, RANGE or GROUPS
    start: tuple[str, Expr | None]
    end: tuple[str, Expr | None]
    exclude: str | None = None


@dataclass
class Window:
    base: str | None = None
    partition: list[Expr] = field(default_factory=list)
    order: list[Order] = field(default_factory=list)
    frame: Frame | None = None


@dataclass
class Func(Expr):
    name: str
    args: list[Expr]
    star: bool = False
    distinct: bool = False
    order: list[Order] = field(default_factory=list)
    where: Expr | None = None
    over: Window | str | None = None


@dataclass
class Order:
    x: Expr
    descending: bool = False
    nulls: str | None = None


@dataclass
class Table:
    name: str
    alias: str | None = None
    columns: list[str] | None = None


@dataclass
class Derived:
    query: Query
    alias: str | None = None
    columns: list[str] | None = None


@dataclass
class TableFunc:
    name: str
    args: list[Expr]
    alias: str | None = None


@dataclass
class Join:
    kind: str  # INNER, LEFT, RIGHT, FULL, CROSS
    left: Any
    right: Any
    on: Expr | None = None
    using: list[str] | None = None
    natural: bool = False


@dataclass
class Core:
    columns: list[tuple[Expr, str | None]]
    source: Any = None
    where: Expr | None = None
    group: list[Expr] = field(default_factory=list)
    having: Expr | None = None
    windows: dict[str, Window] = field(default_factory=dict)
    distinct: bool = False


@dataclass
class Values:
    rows: list[list[Expr]]


@dataclass
class SetOp:
    op: str  # UNION, UNION ALL, INTERSECT, EXCEPT
    left: Any
    right: Any


@dataclass
class Query:
    body: Any
    ctes: list[tuple[str, list[str] | None, Query]] = field(default_factory=list)
    recursive: bool = False
    order: list[Order] = field(default_factory=list)
    limit: Expr | None = None
    offset: Expr | None = None
