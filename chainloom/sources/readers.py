"""Readers: every format becomes a DataFrame of text columns for the gate."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from chainloom.operators.gate import GateResult, gate

#: Accepted suffixes, and table names that are tried first.
SUFFIXES = {".csv": "csv", ".txt": "csv", ".json": "json", ".jsonl": "json", ".xml": "xml", ".db": "sqlite", ".sqlite": "sqlite", ".sqlite3": "sqlite", ".parquet": "parquet"}
TABLE_HINTS = ("observations", "transactions", "traffic", "records", "events", "flows", "packets", "data")


def as_text(df: DataFrame) -> DataFrame:
    """Every column as text, lists joined with ``|``; header names stripped."""
    cells = [(F.array_join(F.col(f"`{f.name}`").cast("array<string>"), "|") if isinstance(f.dataType, T.ArrayType) else F.col(f"`{f.name}`").cast("string")).alias(f.name.strip()) for f in df.schema]
    return df.select(*cells)


def separator(spark: SparkSession, path: str, sample: int = 8192) -> str:
    """The most frequent of comma, semicolon and tab in the first line; comma where none occurs."""
    head = spark.read.text(path).limit(1).collect()
    line = head[0][0][:sample] if head else ""
    return max(",;\t", key=lambda s: (line.count(s), s == ","))


def scan_csv(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """CSV or TXT as text; no type inference, no null tokens, byte-order mark dropped from the header."""
    raw = spark.read.option("header", True).option("sep", sep or separator(spark, path)).option("multiLine", False).option("nullValue", "\u0000").option("emptyValue", "").csv(path)
    return raw.toDF(*(c.lstrip("﻿").strip() for c in raw.columns))


def scan_json(spark: SparkSession, path: str) -> DataFrame:
    """Records of a bare array, of an array one or two wrappers deep, of JSON lines, or one record."""
    lines = path.endswith(".jsonl")
    raw = spark.read.option("multiLine", not lines).option("primitivesAsString", True).json(path)

    def records(kind: T.StructType, prefix: str, depth: int) -> str | None:
        for f in kind:
            if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
                return f"{prefix}`{f.name}`"
        for f in kind if depth else ():
            if isinstance(f.dataType, T.StructType) and (found := records(f.dataType, f"{prefix}`{f.name}`.", depth - 1)):
                return found
        return None

    at = records(raw.schema, "", 1)
    return as_text(raw.select(F.inline(F.col(at))) if at else raw)


def scan_xml(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """Repeated ``row_tag`` elements; repeated grandchildren are joined with ``|``."""
    raw = spark.read.format("xml").option("rowTag", row_tag).option("inferSchema", False).load(path)
    cells = []
    for f in raw.schema:
        kind, c = f.dataType, F.col(f"`{f.name}`")
        if isinstance(kind, T.StructType) and len(kind):
            inner = c.getField(kind[0].name)
            cells.append((F.array_join(inner.cast("array<string>"), "|") if isinstance(kind[0].dataType, T.ArrayType) else inner.cast("string")).alias(f.name))
        else:
            cells.append((F.array_join(c.cast("array<string>"), "|") if isinstance(kind, T.ArrayType) else c.cast("string")).alias(f.name))
    return raw.select(*cells)


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


class _Rows(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    """Ranges of rowid, one read-only connection per task; the file must be visible to the executors."""

    def __init__(self, path: str, table: str, columns: list[str], tasks: int) -> None:
        self.path, self.table, self.columns, self.tasks = path, table, columns, tasks

    def partitions(self) -> list[InputPartition]:
        with _open(self.path) as con:
            low, high = con.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        if low is None:
            return [_Rows(0, 0)]
        step = -(-(high - low + 1) // self.tasks)
        return [_Rows(at, min(high + 1, at + step)) for at in range(low, high + 1, step)]

    def read(self, partition: _Rows) -> Iterator[tuple]:
        names = ", ".join(f'CAST("{c}" AS TEXT)' for c in self.columns)
        with _open(self.path) as con:
            yield from con.execute(f'SELECT {names} FROM "{self.table}" WHERE rowid >= ? AND rowid < ?', (partition.low, partition.high))


class SqliteSource(DataSource):
    """``spark.read.format("sqlite_table")`` with options path, table (optional) and tasks."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def _table(self) -> str:
        with _open(self.options["path"]) as con:
            names = [r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%'")]
            if wanted := self.options.get("table"):
                if wanted not in names:
                    raise ValueError(f"no table {wanted!r}; tables are {', '.join(sorted(names))}")
                return wanted
            if not names:
                raise ValueError("the database has no tables")
            hinted = [n for h in TABLE_HINTS for n in names if h in n.lower()]
            return hinted[0] if hinted else max(names, key=lambda n: (con.execute(f'SELECT count(*) FROM "{n}"').fetchone()[0], n))

    def _columns(self) -> list[str]:
        with _open(self.options["path"]) as con:
            return [r[1] for r in con.execute(f'PRAGMA table_info("{self._table()}")')]

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c, T.StringType()) for c in self._columns()])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return SqliteReader(self.options["path"], self._table(), schema.names, int(self.options.get("tasks", "8")))


def scan_sqlite(spark: SparkSession, path: str, table: str | None = None, tasks: int = 8) -> DataFrame:
    """A table of a SQLite file as text; without a name the first hinted table, else the largest."""
    spark.dataSource.register(SqliteSource)
    reader = spark.read.format("sqlite_table").option("path", path).option("tasks", tasks)
    return (reader.option("table", table) if table else reader).load()


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def scan_raw(spark: SparkSession, path: str, table: str | None = None, row_tag: str = "record") -> DataFrame:
    """The reader that the suffix names; others are refused."""
    kind = SUFFIXES.get(PurePosixPath(path).suffix.lower())
    if kind is None:
        raise ValueError(f"unsupported file type: {path}; supported are {', '.join(sorted(SUFFIXES))}")
    if kind == "sqlite":
        return scan_sqlite(spark, path, table)
    if kind == "xml":
        return scan_xml(spark, path, row_tag)
    return {"csv": scan_csv, "json": scan_json, "parquet": lambda s, p: as_text(scan_parquet(s, p))}[kind](spark, path)


def scan_any(spark: SparkSession, path: str, table: str | None = None, row_tag: str = "record") -> GateResult:
    """Reader and gate in one."""
    return gate(scan_raw(spark, path, table, row_tag))


def from_dataframe(df: DataFrame) -> GateResult:
    """The gate over a frame that is already there, lists or text."""
    return gate(as_text(df))


def load_ground_truth(spark: SparkSession, entities: str, addresses: str) -> DataFrame:
    """``(address, entity_id, label, typology)`` from the two label files."""
    kinds = spark.read.option("header", True).csv(entities).select("entity_id", F.col("label").cast("int").alias("label"), "typology")
    return spark.read.option("header", True).csv(addresses).select("address", "entity_id").join(kinds, "entity_id", "left").select("address", "entity_id", "label", "typology")
