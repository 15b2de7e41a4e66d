"""Each of the library's own queries against its SQL twin, and small operators on hand-made frames."""

import os

import duckdb
import pytest

from mortise import registry
from mortise.operators import ensembles, relations, statistics, texts
from mortise.sources import readers
from mortise.streaming import events

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def db():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        con.sql(f"create view {t} as select * from read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def plain(v):
    return "null" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_query_equals_twin(spark, db, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*cols).collect())
    want = db.sql(f"select {', '.join(f'{chr(34)}{c}{chr(34)}' for c in cols)} from ({registry.oracles()[name]})").fetchall()
    assert got == sorted(tuple(map(plain, r)) for r in want)


def test_nulls_and_ties(spark):
    df = spark.createDataFrame([(None, 1.0), (" ", 3.0), ("a", None), ("a", 5.0)], "k string, v double")
    got = {r.k: (r.n, r.delta) for r in statistics.group_summary(df, ["k"], "v").collect()}
    assert got == {"unknown": (2, -1.0), "a": (1, 2.0)}
    runs = spark.createDataFrame([(1, 1.0, 0.0), (1, 2.0, 0.0), (2, None, 1.0)], "id int, p double, w double")
    by = {r.id: r for r in ensembles.by_id(runs, "id", "p", "w").collect()}
    assert by[1].weighted is None and by[1].trimmed == 1.5 and by[2].n == 0
    top = relations.top_of(spark.createDataFrame([(1, 1, 2), (1, 2, 2), (1, 3, 1)], "g int, i int, v int"), ["g"], [statistics.F.col("v").desc(), statistics.F.col("i")], 2)
    assert [r.i for r in top.orderBy("place").collect()] == [1, 2]


def test_chunks_cover(spark):
    text = "".join(chr(97 + i % 26) for i in range(8000))
    got = texts.chunk_windows(spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "x" * 3600)], "k int, t string"), "k", "t").collect()
    assert [(r.k, r.start, len(r.piece)) for r in sorted(got, key=lambda r: (r.k, r.start))] == [(1, 0, 3600), (1, 3300, 3600), (1, 6600, 1400), (4, 0, 3600)]


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\nnot json\n[1]\n{"a": 2}\n')
    assert [r.a for r in readers.read_lines(spark, str(tmp_path / "a.jsonl"), "a int").orderBy("a").collect()] == [1, 2]
    (tmp_path / "e.txt").write_text("x1  -1.5 ok\nx2\nx3 abc bad\n")
    assert [(r.id, r.value, r.status) for r in readers.read_energies(spark, str(tmp_path / "e.txt")).orderBy("id").collect()] == [("x1", -1.5, "ok"), ("x2", None, None), ("x3", None, "bad")]
    (tmp_path / "s.cif").write_text("data_x\n_cell_length_a 4.5\n_cell_length_b 5\n_cell_length_c 6\n_cell_angle_alpha 90\n_cell_angle_beta 90\n_cell_angle_gamma 120\nloop_\n _atom_site_type_symbol\n _atom_site_label\n _atom_site_fract_x\n _atom_site_fract_y\n _atom_site_fract_z\n Ag Ag1 0.0 0.5 0.25\n O O1 0.1(2) 0.2 0.3\n")
    got = readers.read_cif_sites(spark, str(tmp_path)).orderBy("idx").collect()
    assert [(r.structure_id, r.a, r.gamma, r.symbol, r.fx, r.fz) for r in got] == [("s", 4.5, 120.0, "Ag", 0.0, 0.25), ("s", 4.5, 120.0, "O", 0.1, 0.3)]


def test_stream_equals_table(spark, tmp_path):
    path = f"{SF}/events.parquet"
    source = str(tmp_path / "in")
    spark.read.parquet(path).repartition(3).write.parquet(source)
    q = events.tumbling(events.event_stream(spark, source, spark.read.parquet(path).schema.simpleString()[7:-1].replace(":", " ")), late="60 days").writeStream.outputMode("complete").format("memory").queryName("tumble").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(str, spark.table("tumble").selectExpr("start", "event_type", "n").collect())) == sorted(map(str, events.tumbling(spark.read.parquet(path)).selectExpr("start", "event_type", "n").collect()))
