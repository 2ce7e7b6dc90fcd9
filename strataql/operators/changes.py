"""Changes to tables as DataFrames: inserts, upserts, updates, deletes, constraints and changesets.

Every function takes the old state and gives the new one; nothing is modified in place. Rows are
matched by key with joins on hash partitions of the key, never collected. As in SQL, a null key is
equal to no other: such rows never conflict, and changesets leave them out.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _on(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & (a[k] == b[k])
    return out


def _last(rows: DataFrame, keys: list[str], order: list[str] | None, descending: bool = True) -> DataFrame:
    """The last (or first) row of each key in the given order; all columns order where none is given."""
    order = order or rows.columns
    by = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    keyed = F.lit(True)
    for k in keys:
        keyed = keyed & F.col(k).isNotNull()
    alone = rows.filter(~keyed)
    rows = rows.filter(keyed)
    return alone.union(rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).filter("__n = 1").drop("__n"))


def insert(old: DataFrame, new: DataFrame, defaults: Mapping[str, Column] | None = None) -> DataFrame:
    """old and new rows; columns that new lacks take their default, or null."""
    for c in old.columns:
        if c not in new.columns:
            new = new.withColumn(c, (defaults or {}).get(c, F.lit(None)).cast(old.schema[c].dataType))
    return old.unionByName(new.select([F.col(c).cast(old.schema[c].dataType).alias(c) for c in old.columns]))


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Rows of new whose key is taken are left out; of equal new keys the first in order enters."""
    first = _last(new, keys, order, descending=False)
    return insert(old, first.join(old.select(keys), _on(first, old, keys), "left_anti"))


def insert_or_replace(old: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """New rows take the place of old ones of their key; of equal new keys the last in order stays."""
    last = _last(new, keys, order)
    return insert(old.join(last.select(keys), _on(old, last, keys), "left_anti"), last)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], updates: Mapping[str, Column], where: Column | None = None, order: list[str] | None = None) -> DataFrame:
    """INSERT … ON CONFLICT (keys) DO UPDATE SET: updates name columns of ``old.`` and ``excluded.``.

    One new row of a key is applied: the last in order. Without updates a conflict does nothing.
    """
    last = _last(new, keys, order)
    a, b = old.withColumn("__old", F.lit(True)).alias("old"), last.withColumn("__new", F.lit(True)).alias("excluded")
    match = F.lit(True)
    for k in keys:
        match = match & (F.col(f"old.{k}") == F.col(f"excluded.{k}"))
    both = F.col("__old").isNotNull() & F.col("__new").isNotNull()
    applies = both & F.coalesce(where, F.lit(False)) if where is not None else both

    def value(c: str) -> Column:
        out = F.when(F.col("__old").isNull(), F.col(f"excluded.{c}"))
        if c in updates:
            out = out.when(applies, updates[c])
        return out.otherwise(F.col(f"old.{c}")).cast(old.schema[c].dataType).alias(c)

    return a.join(b, match, "full").select([value(c) for c in old.columns])


def update(old: DataFrame, updates: Mapping[str, Column], where: Column | None = None) -> DataFrame:
    hit = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    return old.select([F.when(hit, updates[c]).otherwise(F.col(c)).cast(old.schema[c].dataType).alias(c) if c in updates else F.col(c) for c in old.columns])


def update_from(old: DataFrame, source: DataFrame, on: list[tuple[str, str]], updates: Mapping[str, Column], order: list[str] | None = None) -> DataFrame:
    """UPDATE … FROM: columns of ``old.`` and ``source.``; of several matches the last in order wins."""
    last = _last(source, [b for _, b in on], order).withColumn("__hit", F.lit(True))
    match = F.lit(True)
    for a, b in on:
        match = match & (F.col(f"old.{a}") == F.col(f"source.{b}"))
    joined = old.alias("old").join(last.alias("source"), match, "left")
    return joined.select([F.when(F.col("__hit"), updates[c]).otherwise(F.col(f"old.{c}")).cast(old.schema[c].dataType).alias(c) if c in updates else F.col(f"old.{c}") for c in old.columns])


def delete(old: DataFrame, where: Column) -> DataFrame:
    return old.filter(~F.coalesce(where, F.lit(False)))


def first_rows(old: DataFrame, where: Column, order: list[Column], keys: list[str], limit: int) -> DataFrame:
    """Keys of the rows that UPDATE or DELETE … ORDER BY … LIMIT touches."""
    return old.filter(where).orderBy(*order).limit(limit).select(keys)


def violations(rows: DataFrame, *, not_null: list[str] = (), unique: list[list[str]] = (), checks: Mapping[str, Column] | None = None, references: list[tuple[str, DataFrame, str]] = ()) -> DataFrame:
    """(rule, n) for every constraint that rows break."""
    out = None

    def add(rule: str, bad: DataFrame) -> None:
        nonlocal out
        one = bad.agg(F.lit(rule).alias("rule"), F.count("*").alias("n")).filter("n > 0")
        out = one if out is None else out.union(one)

    for c in not_null:
        add(f"NOT NULL {c}", rows.filter(F.col(c).isNull()))
    for keys in unique:
        whole = rows
        for k in keys:
            whole = whole.filter(F.col(k).isNotNull())
        add(f"UNIQUE {', '.join(keys)}", whole.groupBy(*keys).count().filter("count > 1"))
    for name, check in (checks or {}).items():
        add(f"CHECK {name}", rows.filter(~check))
    for c, parent, key in references:
        add(f"FOREIGN KEY {c}", rows.filter(F.col(c).isNotNull()).join(parent.select(F.col(key).alias("__k")).distinct(), F.col(c) == F.col("__k"), "left_anti"))
    return out if out is not None else rows.sparkSession.createDataFrame([], "rule string, n bigint")


# --- changesets ---------------------------------------------------------------------------------


def changeset(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each changed key: op (insert, update, delete), the key, and structs old and new."""
    a, b = (df.dropna(subset=keys).select(*[F.col(k).alias(f"__{k}") for k in keys], F.struct(*old.columns).alias(side)) for df, side in ((old, "old"), (new, "new")))
    joined = a.join(b, [f"__{k}" for k in keys], "full")
    op = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").otherwise("update")
    return joined.filter(~F.col("old").eqNullSafe(F.col("new"))).select(op.alias("op"), *[F.col(f"__{k}").alias(k) for k in keys], "old", "new")


def apply_changeset(rows: DataFrame, changes: DataFrame, keys: list[str], replace_conflicts: bool = False) -> DataFrame:
    """Rows after the changes. A row that isn't as the change saw it stays, unless conflicts are replaced."""
    have = rows.select(*[F.col(k).alias(f"__{k}") for k in keys], F.struct(*rows.columns).alias("now"))
    told = changes.select(*[F.col(k).alias(f"__{k}") for k in keys], "op", "old", "new")
    joined = have.join(told, [f"__{k}" for k in keys], "full")
    fits = F.lit(True) if replace_conflicts else F.col("now").eqNullSafe(F.col("old"))
    after = F.when(F.col("op").isNotNull() & fits, F.col("new")).otherwise(F.col("now"))
    return joined.select(after.alias("r")).filter("r IS NOT NULL").select("r.*").select(rows.columns)


def invert(changes: DataFrame) -> DataFrame:
    op = F.when(F.col("op") == "insert", "delete").when(F.col("op") == "delete", "insert").otherwise(F.col("op"))
    keys = [c for c in changes.columns if c not in ("op", "old", "new")]
    return changes.select(op.alias("op"), *keys, F.col("new").alias("old"), F.col("old").alias("new"))


def combine(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """One changeset with the effect of two in turn; what ends as it began is left out."""
    a = first.select(*keys, F.lit(True).alias("__a"), F.col("old").alias("old1"), F.col("new").alias("new1"))
    b = second.select(*keys, F.lit(True).alias("__b"), F.col("old").alias("old2"), F.col("new").alias("new2"))
    joined = a.join(b, keys, "full").withColumns({"old": F.when(F.col("__a").isNotNull(), F.col("old1")).otherwise(F.col("old2")), "new": F.when(F.col("__b").isNotNull(), F.col("new2")).otherwise(F.col("new1"))})
    op = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").otherwise("update")
    return joined.filter(~F.col("old").eqNullSafe(F.col("new"))).select(op.alias("op"), *keys, "old", "new")


def rebase(local: DataFrame, remote: DataFrame, keys: list[str], local_wins: bool = True) -> DataFrame:
    """Local changes as they read after the remote ones; on the same key the winner's new row stands."""
    r = remote.select(*keys, F.col("new").alias("theirs"), F.lit(True).alias("__r"))
    joined = local.join(r, keys, "left")
    old = F.when(F.col("__r").isNotNull(), F.col("theirs")).otherwise(F.col("old"))
    moved = joined.withColumn("old", old)
    if not local_wins:
        moved = moved.filter(F.col("__r").isNull())
    op = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").otherwise("update")
    return moved.filter(~F.col("old").eqNullSafe(F.col("new"))).select(op.alias("op"), *keys, "old", "new")
