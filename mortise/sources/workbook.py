"""Workbooks (.xlsx) as a source and a sink of Spark.

The source gives every used row of every sheet as (file, sheet, row, cells): a partition is a sheet, cells are texts as the workbook has
them (numbers in their written form, booleans as true and false, dates as their day numbers, missing and empty cells null). Equality
on file or sheet is pushed and leaves other sheets unread. read_workbook() makes a table of it by the header row, and tables with
different headers are united by column name.

The sink writes (sheet, cells) rows: one workbook a task, rows in the order they come, into a folder that changes at once (see parts).
A sheet that is full goes on in "<name> (2)" and so on.
"""

from __future__ import annotations

import os
import re
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import ArrayType, NumericType, StructType

from mortise.sources.parts import PartsWriter, listed, local

SUFFIXES = (".xlsx", ".xlsm")
CELLS = "file string, sheet string, row long, cells array<string>"
SINK = "sheet string, cells array<struct<number: double, text: string>>"
#: Fixed value: rows that a sheet can hold.
SHEET_ROWS = 1_048_576
# Namespaces of the file format.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_OFFICE = "http://schemas.openxmlformats.org"


def sheets(book: zipfile.ZipFile) -> dict[str, str]:
    """Sheet name -> member of the archive, in the workbook's order."""
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    found = {}
    for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
        target = targets[s.get(f"{_REL}id")]
        found[s.get("name")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    return found


def shared_texts(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as f:
        for _, e in ElementTree.iterparse(f):
            if e.tag == f"{_MAIN}si":
                out.append(_text(e))
                e.clear()
    return out


def _text(e: ElementTree.Element) -> str:
    """The text of a string item, without phonetic hints."""
    runs = [t for child in e for t in ([child] if child.tag == f"{_MAIN}t" else child.findall(f"{_MAIN}t") if child.tag == f"{_MAIN}r" else [])]
    return re.sub(r"_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), "".join(t.text or "" for t in runs))


def column_number(reference: str) -> int:
    """0 for A1, 26 for AA7."""
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def rows_of(book: zipfile.ZipFile, member: str) -> Iterator[tuple[int, list[str | None]]]:
    """Row numbers from 0 and cells; rows without a value are left out."""
    texts = shared_texts(book)
    with book.open(member) as f:
        at = -1
        for _, e in ElementTree.iterparse(f):
            if e.tag != f"{_MAIN}row":
                continue
            at = int(e.get("r")) - 1 if e.get("r") else at + 1
            cells: list[str | None] = []
            for c in e.iter(f"{_MAIN}c"):
                k = column_number(c.get("r")) if c.get("r") else len(cells)
                cells += [None] * (k + 1 - len(cells))
                kind, value = c.get("t", "n"), c.findtext(f"{_MAIN}v")
                if kind == "inlineStr":
                    inner = c.find(f"{_MAIN}is")
                    cells[k] = _text(inner) if inner is not None else None
                elif value is not None:
                    cells[k] = texts[int(value)] if kind == "s" else str(value == "1").lower() if kind == "b" else None if kind == "e" else value
            e.clear()
            if any(cells):
                yield at, [v or None for v in cells]


@dataclass
class Sheet(InputPartition):
    file: str
    name: str
    member: str


class WorkbookReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.wanted = options["path"], {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute in (("file",), ("sheet",)):
                values = set(f.value) if isinstance(f, In) else {f.value}
                name = f.attribute[0]
                self.wanted[name] = self.wanted[name] & values if name in self.wanted else values
            else:
                yield f

    def partitions(self) -> list[Sheet]:
        out = []
        for file in listed(self.path, SUFFIXES):
            if "file" not in self.wanted or file in self.wanted["file"]:
                with zipfile.ZipFile(file) as book:
                    out += [Sheet(file, name, member) for name, member in sheets(book).items() if "sheet" not in self.wanted or name in self.wanted["sheet"]]
        return out

    def read(self, partition: Sheet | None) -> Iterator[tuple]:
        if partition is None:  # there are no sheets
            return
        with zipfile.ZipFile(partition.file) as book:
            for at, cells in rows_of(book, partition.member):
                yield partition.file, partition.name, at, cells


class WorkbookWriter(PartsWriter):
    suffix = ".xlsx"

    def fill(self, file: str, batches: Iterable[pa.RecordBatch], limit: int = SHEET_ROWS) -> None:
        names: list[str] = []
        used: dict[str, int] = {}
        with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as book:
            out, current, n = None, None, 0
            for b in batches:
                for sheet, cells in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if out is None or sheet != current or n == limit:
                        if out is not None:
                            out.write(b"</sheetData></worksheet>")
                            out.close()
                        current, n = sheet, 0
                        base = re.sub(r"[\[\]:*?/\\]", "_", sheet or "Sheet")[:25]
                        used[base] = used.get(base, 0) + 1
                        names.append(base if used[base] == 1 else f"{base} ({used[base]})")
                        out = book.open(f"xl/worksheets/sheet{len(names)}.xml", "w", force_zip64=True)
                        out.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN[1:-1]}"><sheetData>'.encode())
                    n += 1
                    out.write(self.row(n, cells or []).encode())
            if out is None:
                names.append("Sheet")
                book.writestr("xl/worksheets/sheet1.xml", f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN[1:-1]}"><sheetData></sheetData></worksheet>')
            else:
                out.write(b"</sheetData></worksheet>")
                out.close()
            kinds = f'<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
            kinds += "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(names) + 1))
            book.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="{_OFFICE}/package/2006/content-types">{kinds}</Types>')
            book.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{_OFFICE}/package/2006/relationships"><Relationship Id="rId1" Type="{_REL[1:-1]}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            entries = "".join(f'<sheet name={quoteattr(name)} sheetId="{k}" r:id="rId{k}"/>' for k, name in enumerate(names, 1))
            book.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{_REL[1:-1]}"><sheets>{entries}</sheets></workbook>')
            links = "".join(f'<Relationship Id="rId{k}" Type="{_REL[1:-1]}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(names) + 1))
            book.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{_OFFICE}/package/2006/relationships">{links}</Relationships>')

    @staticmethod
    def row(number: int, cells: list[dict | None]) -> str:
        out = []
        for k, cell in enumerate(cells):
            name, m = "", k + 1
            while m:
                m, c = divmod(m - 1, 26)
                name = chr(65 + c) + name
            if cell and cell["number"] is not None and cell["number"] == cell["number"] and abs(cell["number"]) != float("inf"):
                v = cell["number"]
                out.append(f'<c r="{name}{number}"><v>{int(v) if v == int(v) and abs(v) < 2**53 else repr(v)}</v></c>')
            elif cell and cell["text"]:
                text = re.sub(r"_(?=x[0-9A-Fa-f]{4}_)|[\x00-\x08\x0b\x0c\r\x0e-\x1f\ufffe\uffff]", lambda m: f"_x{ord(m[0]):04X}_", cell["text"])
                out.append(f'<c r="{name}{number}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>')
        return f'<row r="{number}">{"".join(out)}</row>'


class WorkbookSource(DataSource):
    """Option: path, a workbook or a folder of them."""

    @classmethod
    def name(cls) -> str:
        return "mortise_workbook"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema: StructType) -> WorkbookReader:
        return WorkbookReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(self.options["path"], overwrite)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """file, sheet, row, cells of all sheets of the workbooks at path."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WorkbookSource)
    return spark.read.format(WorkbookSource.name()).options(path=local(path)).load()


def by_header(cells: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """file, sheet, row and a column of text for each header name: the first row of each sheet is its header, and sheets are united by name.

    Without columns the names are those of all headers, in order of name. A sheet that lacks a name has null there; of a name that
    a header repeats the first counts; blank header cells are no columns.
    """
    heads = cells.groupBy("file", "sheet").agg(F.min_by(F.struct("row", F.transform("cells", lambda c: F.trim(c)).alias("names")), "row").alias("head")).select("file", "sheet", F.col("head.row").alias("head_at"), "head.names")
    if columns is None:
        columns = [r[0] for r in heads.select(F.explode("names").alias("n")).where("n <> ''").distinct().orderBy("n").collect()]  # names of columns, not rows
    rows = cells.join(heads, ["file", "sheet"]).where("row > head_at")
    cell = lambda name: F.get("cells", F.nullif(F.array_position("names", F.lit(name)), F.lit(0)).cast("int") - 1)
    return rows.select("file", "sheet", "row", *(cell(c).alias(c) for c in columns))


def read_workbook(spark: SparkSession, path: str, sheet: str | None = None, schema: str | None = None) -> DataFrame:
    """The rows of the sheets (of one name, or all) as a table; with a schema its columns and types, values that don't parse being null."""
    cells = read_cells(spark, path)
    cells = cells.where(F.col("sheet") == sheet) if sheet is not None else cells
    if schema is None:
        return by_header(cells).drop("file", "sheet", "row")
    wanted = StructType.fromDDL(schema)
    rows = by_header(cells, wanted.names)
    typed = [F.coalesce(F.col(f.name).try_cast(f.dataType), F.col(f.name).try_cast("double").try_cast(f.dataType)) if isinstance(f.dataType, NumericType) else F.col(f.name).try_cast(f.dataType) for f in wanted]
    return rows.select(*typed).toDF(*wanted.names)


def blocks(cells: DataFrame, starts: dict[str, int], width: int, names: list[str], skip: int = 0) -> DataFrame:
    """file, sheet, row, block and a column of text for each of names: sheets without a header whose blocks of width columns stand side by side.

    starts gives the first column of each block. Rows before skip, and rows in which a block is empty, are left out.
    """
    part = F.explode(F.array(*(F.struct(F.lit(b).alias("block"), F.slice(F.concat("cells", F.array_repeat(F.lit(None).cast("string"), at + width)), at + 1, width).alias("v")) for b, at in starts.items())))
    rows = cells.where(F.col("row") >= skip).select("file", "sheet", "row", part.alias("x")).where(F.exists("x.v", lambda v: v.isNotNull()))
    return rows.select("file", "sheet", "row", "x.block", *(F.get("x.v", F.lit(k)).alias(n) for k, n in enumerate(names)))


def as_cells(df: DataFrame, sheet: Column | str) -> DataFrame:
    """Rows for the sink: df's values, numbers as numbers and all else as text, on the named sheet."""
    def cell(c: str, kind) -> Column:  # noqa: ANN001
        number = isinstance(kind, NumericType)
        exact = number and kind.simpleString() not in ("float", "double")
        value = F.col(f"`{c}`")
        text = value.cast("string") if not isinstance(kind, ArrayType | StructType) else F.to_json(value)
        as_number = F.when(F.abs(value) < 2**53, value.cast("double")) if exact else value.cast("double")  # longer ones keep their digits as text
        return F.struct((as_number if number else F.lit(None).cast("double")).alias("number"), text.alias("text"))

    return df.select((F.lit(sheet) if isinstance(sheet, str) else sheet).alias("sheet"), F.array(*(cell(f.name, f.dataType) for f in df.schema)).alias("cells"))


def write_workbook(tables: dict[str, DataFrame], path: str, rows: int | None = None, mode: str = "overwrite") -> None:
    """One workbook at path (a folder with one .xlsx file) with a sheet for each table, header first; at most `rows` rows of each, if given.

    A report is one file and so one task's work; for large tables use write_workbooks().
    """
    some = None
    for k, (name, df) in enumerate(tables.items()):
        head = df.sparkSession.createDataFrame([(name, [(None, c) for c in df.columns])], SINK)
        body = as_cells(df if rows is None else df.limit(rows), name)
        both = head.withColumn("at", F.lit(-1).cast("long")).unionByName(body.withColumn("at", F.monotonically_increasing_id())).withColumn("table_at", F.lit(k))
        some = both if some is None else some.unionByName(both)
    _save(some.repartition(1).sortWithinPartitions("table_at", "at").select("sheet", "cells"), path, mode)


def write_workbooks(df: DataFrame, path: str, sheet: str = "Sheet1", mode: str = "overwrite") -> None:
    """A folder of workbooks, one for each partition of df, each with the header and its rows."""
    head = [(None, c) for c in df.columns]
    body = as_cells(df, sheet)
    from_rows = body.schema

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = False
        for b in batches:
            if b.num_rows and not begun:
                begun = True
                cells = pa.array([[{"number": n, "text": t} for n, t in head]], b.schema.field(1).type)
                yield pa.RecordBatch.from_arrays([pa.array([sheet], b.schema.field(0).type), cells], schema=b.schema)
            yield b

    _save(body.mapInArrow(headed, from_rows), path, mode)


def _save(df: DataFrame, path: str, mode: str) -> None:
    df.sparkSession.dataSource.register(WorkbookSource)
    os.makedirs(local(path), exist_ok=True)
    df.write.format(WorkbookSource.name()).mode(mode).options(path=local(path)).save()
