"""A read-only SQLite source for Spark's Python data source API: ``spark.dataSource.register(SQLite)``."""

from __future__ import annotations

import sqlite3

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_KINDS = {"INTEGER": "long", "INT": "long", "BIGINT": "long", "REAL": "double", "DOUBLE": "double", "FLOAT": "double"}


class SQLite(DataSource):
    """Options: path, table, and partitions (row-id ranges read in parallel; default 1)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def _open(self):
        return sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True)

    def schema(self) -> str:
        with self._open() as db:
            cols = db.execute(f"pragma table_info({_quoted(self.options['table'])})").fetchall()
        if not cols:
            raise ValueError(f"no table {self.options['table']}")
        return ", ".join(f"`{c[1]}` {_KINDS.get((c[2] or '').upper(), 'string')}" for c in cols)

    def reader(self, schema):
        return _Reader(dict(self.options), [f.name for f in schema.fields], [f.dataType.simpleString() for f in schema.fields])


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, options, names, kinds):
        self.options, self.names, self.kinds = options, names, kinds

    def _open(self):
        return sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True)

    def partitions(self):
        with self._open() as db:
            low, high = db.execute(f"select min(rowid), max(rowid) from {_quoted(self.options['table'])}").fetchone()
        if low is None:
            return [_Range(0, 0)]
        n = int(self.options.get("partitions", 1))
        step = -(-(high - low + 1) // n)
        return [_Range(a, min(high + 1, a + step)) for a in range(low, high + 1, step)]

    def read(self, part):
        cast = [{"bigint": int, "double": float}.get(k, str) for k in self.kinds]
        with self._open() as db:
            cols = ", ".join(map(_quoted, self.names))
            for row in db.execute(f"select {cols} from {_quoted(self.options['table'])} where rowid >= ? and rowid < ?", (part.low, part.high)):
                yield tuple(None if v is None else f(v) for f, v in zip(cast, row))
