"""SQLite files and workbooks as sources and sinks."""

import json
import os
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNull, StringStartsWith

from mortise.sources import parts, sqlite, workbook

SCHEMA = "id long, year int, title string, score double, raw binary"


@pytest.fixture
def articles(tmp_path):
    path = str(tmp_path / "a.db")
    with sqlite3.connect(path) as db:
        db.execute('CREATE TABLE articles (id INTEGER PRIMARY KEY, "Publication Year" INTEGER, title TEXT, score REAL, raw BLOB, loose)')
        db.executemany("INSERT INTO articles VALUES (?, ?, ?, ?, ?, ?)", [(i, 1990 + i % 10, f"t{i % 7}", i / 4, bytes([i % 256]), i) for i in range(1, 1001)])
        db.execute("INSERT INTO articles VALUES (5000, NULL, NULL, NULL, NULL, NULL)")
        db.execute("INSERT INTO articles VALUES (5001, 'unknown', 12, 3, 'text', 'x')")
        db.execute("CREATE VIEW recent AS SELECT id, title FROM articles WHERE id > 990")
    return path


def test_scan_types_partitions_and_columns(spark, articles):
    df = sqlite.read_sqlite(spark, articles, "articles", rows=300)
    assert df.dtypes == [("id", "bigint"), ("Publication Year", "bigint"), ("title", "string"), ("score", "double"), ("raw", "binary"), ("loose", "string")]
    assert df.rdd.getNumPartitions() == 17 and df.count() == 1002
    by = {r.id: r for r in df.where("id >= 5000").collect()}
    assert tuple(by[5000])[1:] == (None,) * 5 and tuple(by[5001])[1:] == (None, "12", 3.0, None, "x")
    few = sqlite.read_sqlite(spark, articles, "articles", ["score", "id"])
    assert few.columns == ["score", "id"] and few.agg(F.sum("score")).first()[0] == sum(i / 4 for i in range(1, 1001)) + 3
    assert [r.title for r in sqlite.read_sqlite(spark, articles, "recent").orderBy("id").limit(1).collect()] == [f"t{991 % 7}"]
    with pytest.raises(Exception, match="no table"):
        sqlite.read_sqlite(spark, articles, "nothing").collect()
    with pytest.raises(Exception, match="no column"):
        sqlite.read_sqlite(spark, articles, "articles", ["absent"]).collect()


def test_filters_reach_the_query(spark, articles):
    reader = sqlite.SqliteReader({"path": articles, "table": "articles"}, sqlite.SqliteSource({"path": articles, "table": "articles", "columns": "id,title"}).schema())
    filters = [EqualTo(("Publication Year",), 1995), In(("title",), ("t1", "t2")), StringStartsWith(("title",), "t"), GreaterThan(("score",), 1.5), EqualTo(("loose",), "7"), EqualTo(("title",), 7), IsNull(("score",))]
    assert list(reader.pushFilters(filters)) == filters  # Spark applies all of them once more
    sql, values = reader.query(reader.partitions()[0])
    assert '"Publication Year" = ?' in sql and '"title" COLLATE BINARY IN (?, ?)' in sql and '"title" COLLATE BINARY >= ?' in sql and '"score" > ?' in sql and '"loose"' not in sql and "IS NULL" not in sql
    assert values == [1995, "t1", "t2", "t", 1.5] and '"raw"' not in sql and "rowid BETWEEN 1 AND 5001" in sql
    df = sqlite.read_sqlite(spark, articles, "articles")
    found = df.where((F.col("Publication Year") == 1995) & F.col("title").isin("t1", "t2") & (F.col("score") > 1.5))
    assert sorted(r.id for r in found.collect()) == [i for i in range(1, 1001) if i % 10 == 5 and i % 7 in (1, 2) and i / 4 > 1.5]
    for condition in ("title = '12'", "loose = '7'", "`Publication Year` is null", "score < 0.5 or score is null", "title like 't3%'", "not (score > 2)", "`Publication Year` in (1991, null)", "loose > '99'"):
        assert sorted(r.id for r in df.where(condition).collect()) == sorted(r.id for r in df.cache().where(condition).collect()), condition
        df.unpersist()


def test_round_trip_replace_append_and_indexes(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = [(1, 2000, "a", 0.5, b"x"), (2, None, None, None, None), (3, 2001, "quote ' \" é", -1e300, b"\x00"), (-4, 2001, "", 0.0, b"")]
    df = spark.createDataFrame(rows, SCHEMA)
    sqlite.write_sqlite(df.repartition(2), path, "t", [["year"], ["title", "year"]])
    assert sorted(map(tuple, sqlite.read_sqlite(spark, path, "t").collect())) == sorted((a, b, c, d, None if e is None else bytearray(e)) for a, b, c, d, e in rows)
    for file in parts.listed(path, sqlite.SUFFIXES):
        with sqlite3.connect(file) as db:
            assert {r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'index'")} == {"idx_0_year", "idx_1_title_year"}
            assert "idx_0_year" in str(db.execute("EXPLAIN QUERY PLAN SELECT * FROM t WHERE year = 2001").fetchall())
    sqlite.write_sqlite(df.limit(1), path, "t", mode="append")
    assert sqlite.read_sqlite(spark, path, "t").count() == 5
    sqlite.write_sqlite(df.where("id = 3"), path, "t")
    assert [r.id for r in sqlite.read_sqlite(spark, path, "t").collect()] == [3]
    assert len([n for n in os.listdir(path) if n.endswith(".sqlite")]) == 1 and not any(n.startswith(".staging") for n in os.listdir(path))
    sqlite.write_sqlite(df.where("id > 99"), path, "t")
    got = sqlite.read_sqlite(spark, path, "t")
    assert got.columns == df.columns and got.collect() == []
    dated = spark.sql("select date'2020-01-02' d, cast(1.50 as decimal(5,2)) m, true b, array(1, 2) l")
    sqlite.write_sqlite(dated, path, "t")
    assert tuple(sqlite.read_sqlite(spark, path, "t").first()) == ("2020-01-02", "1.50", 1, "[1, 2]")


def test_an_aborted_write_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "out")
    sqlite.write_sqlite(spark.range(10).withColumn("x", F.lit("a")), path, "t")
    before = json.load(open(f"{path}/_current"))
    with pytest.raises(Exception):
        sqlite.write_sqlite(spark.range(100).repartition(4).withColumn("x", F.when(F.col("id") == 50, F.raise_error(F.lit("broken"))).otherwise("b")), path, "t")
    assert json.load(open(f"{path}/_current")) == before and sqlite.read_sqlite(spark, path, "t").where("x = 'a'").count() == 10
    assert not any(n.startswith(".staging") for n in os.listdir(path))
    with pytest.raises(Exception, match="no column"):
        sqlite.write_sqlite(spark.range(3), path, "t", [["absent"]])


def test_workbook_round_trip(spark, tmp_path):
    path = str(tmp_path / "book")
    one = spark.createDataFrame([(1, "a & <b>", 0.5), (2, None, None), (3, "é\u0001 _x0041_ \n line", -1e300), (2**60, " pad ", 7.0)], "id long, name string, value double")
    two = spark.createDataFrame([("x", True)], "k string, flag boolean")
    workbook.write_workbook({"first": one, "second": two, "none": two.where("false")}, path)
    (file,) = parts.listed(path, workbook.SUFFIXES)
    cells = workbook.read_cells(spark, path)
    assert [r.sheet for r in cells.select("sheet").distinct().orderBy("sheet").collect()] == ["first", "none", "second"]
    got = workbook.read_workbook(spark, path, "first", "id long, name string, value double")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, one.collect()))
    assert list(map(tuple, workbook.read_workbook(spark, file, "second").collect())) == [("true", "x")]
    assert workbook.read_workbook(spark, path, "none").collect() == [] and workbook.read_workbook(spark, path, "none").columns == ["flag", "k"]
    workbook.write_workbook({"capped": spark.range(50)}, path, rows=20)
    assert workbook.read_workbook(spark, path, "capped", "id int").count() == 20


def test_workbooks_of_partitions_and_sheets_that_are_full(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "books")
    df = spark.range(1000).select("id", (F.col("id") * 0.25).alias("q")).repartition(4)
    workbook.write_workbooks(df, path)
    assert len(parts.listed(path, workbook.SUFFIXES)) == 4
    assert sorted(map(tuple, workbook.read_workbook(spark, path, schema="id long, q double").collect())) == [(i, i / 4) for i in range(1000)]
    workbook.write_workbooks(df.where("id < 3"), path, mode="append")
    assert workbook.read_workbook(spark, path, schema="id long").count() == 1003
    import pyarrow as pa

    rows = [("s", [{"number": float(k), "text": None}]) for k in range(5)] + [("s/t", [{"number": None, "text": "z"}])]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], names=["sheet", "cells"])
    file = str(tmp_path / "full.xlsx")
    workbook.WorkbookWriter(str(tmp_path), True).fill(file, [batch], limit=2)
    with zipfile.ZipFile(file) as book:
        assert list(workbook.sheets(book)) == ["s", "s (2)", "s (3)", "s_t"]


def foreign(path, sheets, shared):
    """A workbook as other programs write it: shared strings, rich text, gaps, booleans, errors, absolute targets."""
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="x{k}"/>' for k, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="x{k}" Target="/xl/worksheets/s{k}.xml"/>' for k in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">' + "".join(shared) + "</sst>")
        for k, rows in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{k}.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{rows}</sheetData></worksheet>')


def test_foreign_workbooks_united_by_name(spark, tmp_path):
    root = tmp_path / "in" / "deep"
    root.mkdir(parents=True)
    shared = ["<si><t>name</t></si>", "<si><r><t>va</t></r><r><t>lue</t></r><rPh><t>no</t></rPh></si>", "<si><t>a</t></si>"]
    head = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row>'
    foreign(root / "p.xlsx", {"S": head + '<row r="3"><c r="A3" t="s"><v>2</v></c><c r="C3"><v>1.5E1</v></c></row><row r="4"/><row r="5"><c r="C5" t="e"><v>#N/A</v></c><c r="D5" t="b"><v>1</v></c></row>'}, shared)
    foreign(root / "q.xlsx", {"S": '<row><c t="inlineStr"><is><t>value</t></is></c><c t="inlineStr"><is><t>more</t></is></c></row><row><c><v>2</v></c><c t="str"><v>m</v></c></row>', "T": ""}, shared)
    (root / "~$p.xlsx").write_text("lock file")
    cells = workbook.read_cells(spark, str(tmp_path / "in"))
    assert sorted((os.path.basename(r.file), r.sheet, r.row, tuple(r.cells)) for r in cells.collect()) == [
        ("p.xlsx", "S", 0, ("name", None, "value")), ("p.xlsx", "S", 2, ("a", None, "1.5E1")), ("p.xlsx", "S", 4, (None, None, None, "true")), ("q.xlsx", "S", 0, ("value", "more")), ("q.xlsx", "S", 1, ("2", "m")),
    ]
    table = workbook.read_workbook(spark, str(tmp_path / "in"), "S")
    assert table.columns == ["more", "name", "value"]
    assert sorted(map(tuple, table.collect()), key=str) == sorted([(None, "a", "1.5E1"), (None, None, None), ("m", None, "2")], key=str)
    typed = workbook.read_workbook(spark, str(tmp_path / "in"), "S", "value int, absent string")
    assert sorted(map(tuple, typed.collect()), key=str) == sorted([(15, None), (None, None), (2, None)], key=str)
    reader = workbook.WorkbookReader({"path": str(tmp_path / "in")})
    assert list(reader.pushFilters([EqualTo(("sheet",), "T"), IsNull(("row",))])) == [IsNull(("row",))] and [p.name for p in reader.partitions()] == ["T"]


def test_blocks_side_by_side(spark):
    rows = [("f", "s", 0, ["title"]), ("f", "s", 1, ["a", "1", "2", None, "b", "3"]), ("f", "s", 2, [None, None, None, None, "c", "4", "5"]), ("f", "s", 3, [])]
    cells = spark.createDataFrame(rows, workbook.CELLS)
    got = workbook.blocks(cells, {"left": 0, "right": 4}, 3, ["x", "y", "z"], skip=1)
    assert {(r.row, r.block, r.x, r.y, r.z) for r in got.collect()} == {(1, "left", "a", "1", "2"), (1, "right", "b", "3", None), (2, "right", "c", "4", "5")}
