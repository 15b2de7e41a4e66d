"""SQLite as a source and a sink of Spark.

The source reads a file, or a folder of files with the same table. A partition is a range of row ids of one file, and its query names the
wanted columns only. Filters go into that query where the column's declared kind makes SQLite's comparison agree with Spark's; Spark
applies every filter once more, so a pushed one has only to keep all rows that may pass.

Columns follow their declared affinity: integer, real, text or blob, others text. Values of another kind than their column's
(SQLite allows them) are read as null, but integers in a real column, and numbers in a text column, which are converted.

The sink writes one file a task, each with the table and its indexes, into a folder that changes at once (see parts). Coalesce to one
partition for a single file.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterable, Iterator
from contextlib import closing
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith
from pyspark.sql.types import BinaryType, BooleanType, ByteType, DataType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructField, StructType

from mortise.sources.parts import PartsWriter, listed, local

SUFFIXES = (".sqlite", ".sqlite3", ".db")
ROWS = 500_000
BATCH = 10_000
_COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
_SPARK = {"integer": LongType(), "real": DoubleType(), "text": StringType(), "blob": BinaryType()}
_ARROW = {"integer": pa.int64(), "real": pa.float64(), "text": pa.string(), "blob": pa.binary()}
_READ = {
    "integer": "CASE WHEN typeof({c}) = 'integer' THEN {c} END",
    "real": "CASE WHEN typeof({c}) IN ('integer', 'real') THEN CAST({c} AS REAL) END",
    "text": "CASE WHEN typeof({c}) <> 'blob' THEN CAST({c} AS TEXT) END",
    "blob": "CASE WHEN typeof({c}) = 'blob' THEN {c} END",
}


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def affinity(declared: str) -> str:
    """Of a declared column type, by SQLite's rules; a column without a type, and the numeric affinity, are read as text."""
    kind = declared.upper()
    if "INT" in kind:
        return "integer"
    if any(k in kind for k in ("CHAR", "CLOB", "TEXT")):
        return "text"
    if "BLOB" in kind:
        return "blob"
    return "real" if any(k in kind for k in ("REAL", "FLOA", "DOUB")) else "text"


def opened(file: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{file.replace('%', '%25').replace('?', '%3f').replace('#', '%23')}?mode=ro", uri=True)


def declared(file: str, table: str) -> dict[str, str]:
    with closing(opened(file)) as db:
        found = {r[1]: r[2] for r in db.execute(f"PRAGMA table_info({quoted(table)})")}
    if not found:
        raise ValueError(f"{file} has no table {table}")
    return found


@dataclass
class Rows(InputPartition):
    file: str
    first: int | None
    last: int | None


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.path, self.table, self.rows, self.names = options["path"], options["table"], int(options.get("rows", ROWS)), schema.names
        self.conditions: list[str] = []
        self.values: list = []
        files = listed(self.path, SUFFIXES)
        self.declared = declared(files[0], self.table) if files else {}
        self.kinds = {n: affinity(t) for n, t in self.declared.items()}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            self.push(f)
            yield f

    def push(self, f: Filter) -> None:
        column = getattr(f, "attribute", (None,))[0]
        kind = self.kinds.get(column)
        # a text affinity is not given by a missing or numeric type, which are read as text too
        exact = kind in ("integer", "real") or kind == "text" and any(k in self.declared[column].upper() for k in ("CHAR", "CLOB", "TEXT"))
        if not exact or len(f.attribute) > 1:
            return
        fits = (lambda v: isinstance(v, str)) if kind == "text" else (lambda v: isinstance(v, int | float) and not isinstance(v, bool) and v == v)
        name = quoted(column) + (" COLLATE BINARY" if kind == "text" else "")
        if type(f) in _COMPARED and fits(f.value):
            self.conditions.append(f"{name} {_COMPARED[type(f)]} ?")
            self.values.append(f.value)
        elif isinstance(f, In) and 0 < len(f.value) <= 500 and all(map(fits, f.value)):
            self.conditions.append(f"{name} IN ({', '.join('?' * len(f.value))})")
            self.values += f.value
        elif isinstance(f, StringStartsWith) and kind == "text":
            self.conditions.append(f"{name} >= ?")
            self.values.append(f.value)
        elif isinstance(f, IsNotNull):
            self.conditions.append(f"{quoted(column)} IS NOT NULL")

    def partitions(self) -> list[Rows]:
        out = []
        for file in listed(self.path, SUFFIXES):
            with closing(opened(file)) as db:
                (view,) = db.execute("SELECT count(*) FROM sqlite_master WHERE type = 'view' AND lower(name) = lower(?)", [self.table]).fetchone()
                try:
                    low, high = (0, None) if view else db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
                except sqlite3.OperationalError:  # a table without row ids
                    low, high = 0, None
            if high is None and low is not None:
                out.append(Rows(file, None, None))
                continue
            if low is not None:
                out += [Rows(file, at, min(high, at + self.rows - 1)) for at in range(low, high + 1, self.rows)]
        return out

    def query(self, partition: Rows) -> tuple[str, list]:
        """The SQL that reads a partition, and its parameters."""
        columns = ", ".join(_READ[self.kinds[n]].format(c=quoted(n)) for n in self.names) or "NULL"
        ranged = [] if partition.first is None else [f"rowid BETWEEN {partition.first} AND {partition.last}"]
        where = " AND ".join(ranged + self.conditions)
        return f"SELECT {columns} FROM {quoted(self.table)}" + (f" WHERE {where}" if where else ""), self.values

    def read(self, partition: Rows | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there are no partitions
            return
        kinds = [_ARROW[self.kinds[n]] for n in self.names]
        with closing(opened(partition.file)) as db:
            found = db.execute(*self.query(partition))
            while rows := found.fetchmany(BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=self.names)


def sink_type(kind: DataType) -> str:
    if isinstance(kind, LongType | IntegerType | ShortType | ByteType | BooleanType):
        return "INTEGER"
    return "REAL" if isinstance(kind, DoubleType | FloatType) else "BLOB" if isinstance(kind, BinaryType) else "TEXT"


class SqliteWriter(PartsWriter):
    suffix = ".sqlite"

    def __init__(self, options: dict, schema: StructType, overwrite: bool) -> None:
        super().__init__(options["path"], overwrite)
        self.table, self.schema = options["table"], schema
        self.indexes = [[c.strip() for c in group.split(",")] for group in options.get("indexes", "").split(";") if group.strip()]
        for c in {c for group in self.indexes for c in group} - set(schema.names):
            raise ValueError(f"no column {c} to index")

    def fill(self, file: str, batches: Iterable[pa.RecordBatch]) -> None:
        text = [sink_type(f.dataType) == "TEXT" and not isinstance(f.dataType, StringType) for f in self.schema]
        with closing(sqlite3.connect(file, isolation_level=None)) as db:
            db.execute("PRAGMA journal_mode = OFF")
            db.execute("PRAGMA synchronous = OFF")
            db.execute(f"CREATE TABLE {quoted(self.table)} ({', '.join(f'{quoted(f.name)} {sink_type(f.dataType)}' for f in self.schema)})")
            db.execute("BEGIN")
            put = f"INSERT INTO {quoted(self.table)} VALUES ({', '.join('?' * len(self.schema))})"
            for b in batches:
                columns = [[None if v is None else str(v) for v in c.to_pylist()] if t else c.to_pylist() for c, t in zip(b.columns, text, strict=True)]
                db.executemany(put, zip(*columns, strict=True))
            for k, group in enumerate(self.indexes):
                db.execute(f"CREATE INDEX {quoted(f'idx_{k}_' + '_'.join(group))} ON {quoted(self.table)} ({', '.join(map(quoted, group))})")
            db.execute("COMMIT")

    def blank(self) -> str:
        name = "part-none.sqlite" if not self.overwrite else f"part-{self.job}.sqlite"
        self.fill(f"{self.staging}/{name}", [])
        return name


class SqliteSource(DataSource):
    """Options: path, table; reading: columns (comma-separated; all), rows (row ids a partition); writing: indexes ("a;b,c" makes two)."""

    @classmethod
    def name(cls) -> str:
        return "mortise_sqlite"

    def schema(self) -> StructType:
        files = listed(self.options["path"], SUFFIXES)
        if not files:
            raise FileNotFoundError(f"no SQLite file in {self.options['path']}")
        found = {n: affinity(t) for n, t in declared(files[0], self.options["table"]).items()}
        wanted = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()] or list(found)
        if missing := [c for c in wanted if c not in found]:
            raise ValueError(f"no column {', '.join(missing)} in {self.options['table']}")
        return StructType([StructField(n, _SPARK[found[n]]) for n in wanted])

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> SqliteWriter:
        return SqliteWriter(self.options, schema, overwrite)


def _registered(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteSource)


def read_sqlite(spark: SparkSession, path: str, table: str, columns: list[str] | None = None, rows: int = ROWS) -> DataFrame:
    """A table of the SQLite files at path; filters on the result are pushed into their queries."""
    _registered(spark)
    return spark.read.format(SqliteSource.name()).options(path=local(path), table=table, columns=",".join(columns or []), rows=rows).load()


def write_sqlite(df: DataFrame, path: str, table: str, indexes: list[list[str]] = [], mode: str = "overwrite") -> None:  # noqa: B006
    """df as SQLite files in the folder path, each with the indexes given; mode is overwrite or append."""
    _registered(df.sparkSession)
    df.write.format(SqliteSource.name()).mode(mode).options(path=local(path), table=table, indexes=";".join(map(",".join, indexes))).save()
