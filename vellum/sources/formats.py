"""Vaults and SQLite graph files as Spark data sources.

    formats.register(spark)
    spark.read.format("vault").load(folder)
    spark.read.format("graphfile").option("table", "edges").load(path)

Both read folders that every executor sees.
"""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith
from pyspark.sql.types import StructType

from ..operators.ontology import Ontology, default
from .vault import NOTES, PRIVATE, parsed

#: Bytes of files, and rows, of a partition.
PARTITION_BYTES, PARTITION_ROWS = 32 << 20, 200_000


@dataclass
class Files(InputPartition):
    paths: list[tuple[str, float]]


class VaultReader(DataSourceReader):
    """Notes of the visible Markdown files. Filters on rel (equal, in, prefix) choose files before any is opened."""

    def __init__(self, root: str, ontology: str | None, schema: StructType):
        self.root, self.ontology, self.columns = root, ontology, schema
        self.tests: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) == ("rel",) and isinstance(f, (EqualTo, In, StringStartsWith)):
                self.tests.append(f)
            else:
                yield f

    def _wanted(self, rel: str) -> bool:
        for f in self.tests:
            ok = rel == f.value if isinstance(f, EqualTo) else rel in f.value if isinstance(f, In) else rel.startswith(f.value)
            if not ok:
                return False
        return True

    def partitions(self) -> list[InputPartition]:
        parts, now, held = [], [], 0
        for folder, below, names in os.walk(self.root):
            below[:] = sorted(n for n in below if n not in PRIVATE and not n.startswith("_"))
            for name in sorted(names):
                if not name.lower().endswith(".md") or name.startswith((".", "_")) or name in PRIVATE:
                    continue
                path = Path(folder, name)
                rel = path.relative_to(self.root).as_posix()
                if not self._wanted(rel):
                    continue
                stat = path.stat()
                now.append((rel, stat.st_mtime_ns // 1_000_000 / 1e3))
                held += stat.st_size
                if held >= PARTITION_BYTES:
                    parts.append(Files(now))
                    now, held = [], 0
        return [*parts, Files(now)] if now or not parts else parts

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.columns)
        onto = Ontology.from_text(self.ontology) if self.ontology else default()
        for at in range(0, len(partition.paths), 200):
            rows = [{"rel": rel, "mtime": mtime, **parsed(Path(self.root, rel).read_bytes(), onto)} for rel, mtime in partition.paths[at : at + 200]]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


class VaultSource(DataSource):
    """The notes of a vault; files that are no UTF-8 have valid = false and no text."""

    @classmethod
    def name(cls) -> str:
        return "vault"

    def schema(self) -> str:
        return NOTES

    def reader(self, schema: StructType) -> VaultReader:
        root = self.options["path"].removeprefix("file://")
        own = Path(root, "99-system/ontology.yml")
        return VaultReader(root, own.read_text(encoding="utf-8-sig") if own.exists() else None, schema)


@dataclass
class Rows(InputPartition):
    first: int | None
    last: int | None


class GraphFileReader(DataSourceReader):
    """Rows of one table or view of a SQLite file, opened read-only; tables go by ranges of rowid."""

    def __init__(self, path: str, table: str, columns: list[str]):
        self.path, self.table, self.columns = path, table, columns

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(Path(self.path).as_uri() + "?mode=ro", uri=True)

    def partitions(self) -> list[InputPartition]:
        con = self._open()
        try:
            low, high = con.execute(f"select min(rowid), max(rowid) from {_name(self.table)}").fetchone()
        except sqlite3.Error:  # a view has none
            return [Rows(None, None)]
        finally:
            con.close()
        return [Rows(None, None)] if low is None else [Rows(at, min(at + PARTITION_ROWS, high + 1)) for at in range(low, high + 1, PARTITION_ROWS)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        con = self._open()
        try:
            where, given = ("", ()) if partition.first is None else (" where rowid >= ? and rowid < ?", (partition.first, partition.last))
            yield from con.execute(f"select {', '.join(map(_name, self.columns))} from {_name(self.table)}{where}", given)
        finally:
            con.close()


def _name(x: str) -> str:
    return '"' + x.replace('"', '""') + '"'


class GraphFileSource(DataSource):
    """A table of a SQLite file: option table, one of its tables or views."""

    @classmethod
    def name(cls) -> str:
        return "graphfile"

    def _columns(self) -> list[tuple[str, str]]:
        path, table = self.options["path"].removeprefix("file://"), self.options["table"]
        con = sqlite3.connect(Path(path).resolve().as_uri() + "?mode=ro", uri=True)
        try:
            found = con.execute(f"pragma table_info({_name(table)})").fetchall()
        finally:
            con.close()
        if not found:
            raise ValueError(f"no table {table} in {path}")
        kinds = {"REAL": "double", "INTEGER": "long", "INT": "long"}
        return [(c[1], kinds.get(str(c[2]).upper(), "string")) for c in found]

    def schema(self) -> str:
        return ", ".join(f"`{c}` {kind}" for c, kind in self._columns())

    def reader(self, schema: StructType) -> GraphFileReader:
        path = str(Path(self.options["path"].removeprefix("file://")).resolve())
        return GraphFileReader(path, self.options["table"], schema.names)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VaultSource)
    spark.dataSource.register(GraphFileSource)


def graph_file(spark: SparkSession, path: str) -> dict:
    """The tables and views of a SQLite graph file, for sqlgate.query()."""
    con = sqlite3.connect(Path(path).resolve().as_uri() + "?mode=ro", uri=True)
    try:
        names = [r[0] for r in con.execute("select name from sqlite_master where type in ('table', 'view') and name not like 'sqlite_%' order by name")]
    finally:
        con.close()
    return {n: spark.read.format("graphfile").option("table", n).load(path) for n in names}
