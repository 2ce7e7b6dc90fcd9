"""Python data sources for folders, zip archives and SQLite files on a path that all workers mount."""

from __future__ import annotations

import os
import sqlite3
import stat
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual


class Part(InputPartition):
    def __init__(self, value):
        self.value = value


class FolderSource(DataSource):
    """Files below ``path``: name, mode, modified and size; one partition for each folder."""

    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return "name string, mode string, modified bigint, size bigint, folder boolean"

    def reader(self, schema):
        return _FolderReader(self.options["path"])


class _FolderReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [Part(d) for d, _, _ in os.walk(self.path)]

    def read(self, partition) -> Iterator[tuple]:
        for e in sorted(os.scandir(partition.value), key=lambda e: e.name):
            s = e.stat()
            yield e.path, stat.filemode(s.st_mode), int(s.st_mtime), s.st_size, e.is_dir()


class ZipSource(DataSource):
    """Members of a zip archive: name, size, packed size, method and data; read in ranges of members."""

    @classmethod
    def name(cls) -> str:
        return "zipfile"

    def schema(self) -> str:
        return "name string, size bigint, packed bigint, method int, data binary"

    def reader(self, schema):
        return _ZipReader(self.options["path"], int(self.options.get("members", "256")))


class _ZipReader(DataSourceReader):
    def __init__(self, path: str, step: int):
        self.path, self.step = path, step

    def partitions(self):
        with zipfile.ZipFile(self.path) as z:
            n = len(z.infolist())
        return [Part(i) for i in range(0, n, self.step)] or [Part(0)]

    def read(self, partition) -> Iterator[tuple]:
        with zipfile.ZipFile(self.path) as z:
            for i in z.infolist()[partition.value : partition.value + self.step]:
                yield i.filename, i.file_size, i.compress_size, i.compress_type, None if i.is_dir() else z.read(i)


_SPARK = {"INT": "bigint", "CHAR": "string", "CLOB": "string", "TEXT": "string", "BLOB": "binary", "REAL": "double", "FLOA": "double", "DOUB": "double"}
_SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def affinity_type(declared: str) -> str:
    declared = (declared or "").upper()
    return next((t for word, t in _SPARK.items() if word in declared), "double" if declared else "binary")


class SqliteSource(DataSource):
    """A table of a SQLite file: options path, table and parts; row-number ranges are the partitions."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            cols = db.execute(f'PRAGMA table_info("{self.options["table"]}")').fetchall()
        return ", ".join(f"`{c[1]}` {affinity_type(c[2])}" for c in cols)

    def reader(self, schema):
        return _SqliteReader(self.options["path"], self.options["table"], schema, int(self.options.get("parts", "4")))


class _SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, schema, parts: int):
        self.path, self.table, self.names, self.parts = path, table, [f.name for f in schema.fields], parts
        self.kinds = [f.dataType.simpleString() for f in schema.fields]
        self.where: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            sign = _SIGNS.get(type(f))
            if sign and len(f.attribute) == 1 and isinstance(f.value, int | float | str):
                self.where.append((f.attribute[0], sign, f.value))
            else:
                yield f

    def partitions(self):
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        if low is None:
            return [Part((0, 0))]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [Part((a, min(a + step - 1, high))) for a in range(low, high + 1, step)]

    def read(self, partition) -> Iterator[tuple]:
        cols = ", ".join(f'"{c}"' for c in self.names)
        terms = "".join(f' AND "{c}" {s} ?' for c, s, _ in self.where)
        made = {"bigint": int, "double": float, "string": str, "binary": lambda v: v if isinstance(v, bytes) else str(v).encode()}
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            for row in db.execute(f'SELECT {cols} FROM "{self.table}" WHERE rowid BETWEEN ? AND ?{terms}', (*partition.value, *(v for *_, v in self.where))):
                yield tuple(None if v is None else made[k](v) for v, k in zip(row, self.kinds, strict=True))


_DECLARED = {"bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "tinyint": "INTEGER", "boolean": "INTEGER", "double": "REAL", "float": "REAL", "binary": "BLOB"}


def write_sqlite(df: DataFrame, path: str, table: str) -> None:
    """A table of one SQLite file, streamed partition by partition through the driver (an export format)."""
    cols = ", ".join(f'"{f.name}" {_DECLARED.get(f.dataType.simpleString(), "TEXT")}' for f in df.schema.fields)
    marks = ", ".join("?" * len(df.columns))
    plain = {"bigint", "int", "smallint", "tinyint", "boolean", "double", "float", "binary", "string"}
    with sqlite3.connect(path) as db:
        db.execute(f'CREATE TABLE IF NOT EXISTS "{table}" ({cols})')
        texts = [f.dataType.simpleString() not in plain for f in df.schema.fields]
        for row in df.toLocalIterator():
            db.execute(f'INSERT INTO "{table}" VALUES ({marks})', [bytes(v) if isinstance(v, bytearray) else str(v) if t and v is not None else v for v, t in zip(row, texts, strict=True)])
