"""Readers and writers on small files."""

import json

from mortise.sources import simulations as sim


def test_poscar(spark, tmp_path):
    (tmp_path / "a_POSCAR").write_text("t\n 2.0\n 1 0 0\n 0 1 0\n 0 0 1.5\n Ti O\n 1 2\nSelective dynamics\nDirect\n0 0 0 T T T\n0.5 0.5 0.5 F F F\n0.1 0.2 x T T T\n")
    (tmp_path / "b_POSCAR").write_text("t\n1\n1 0 0\n0 1 0\n0 0 1\n1 1\nCartesian\n0 0 0\n1 1 1\n")
    (tmp_path / "c_POSCAR").write_text("")
    got = [(r.path[-8:], r.symbol, r.direct, r.x, r.z, r.lattice[2][2]) for r in sim.read_poscar_sites(spark, str(tmp_path)).orderBy("path", "idx").collect()]
    assert got == [("a_POSCAR", "Ti", True, 0.0, 0.0, 3.0), ("a_POSCAR", "O", True, 0.5, 0.5, 3.0), ("a_POSCAR", "O", True, 0.1, None, 3.0), ("b_POSCAR", "X1", False, 0.0, 0.0, 1.0), ("b_POSCAR", "X2", False, 1.0, 1.0, 1.0)]


def test_last_energy(spark, tmp_path):
    (tmp_path / "OSZICAR").write_text(" 1 F= -.1E+02 E0= -.1D+02 d\n 2 F= x E0= -.25E+02 d\n")
    (tmp_path / "OSZICAR2").write_text("nothing")
    assert [(r.energy, r.steps) for r in sim.read_last_energy(spark, str(tmp_path)).orderBy("path").collect()] == [(-25.0, 2), (None, 0)]


def test_paragraphs(spark, tmp_path):
    (tmp_path / "x.xml").write_text("<TEI><p>before</p><div><head>One</head><p>a <b>bold</b>\n word</p><p/><p> </p></div><div><head n='2'>Two</head><p>c</p></TEI>")
    assert [(r.head, r.text) for r in sim.read_paragraphs(spark, str(tmp_path)).orderBy("ordinal").collect()] == [("BODY", "before"), ("One", "a bold word"), ("Two", "c")]


def test_records_and_append(spark, tmp_path):
    df = spark.createDataFrame([(1, "ask", "say"), (2, " ", "say"), (3, None, "x"), (1, "ask", "say")], "id int, q string, a string")
    got = [json.loads(r.value) for r in sim.instruction_records(df, "q", "a").collect()]
    assert got == [{"instruction": "ask", "input": "", "output": "say"}] * 2
    path = str(tmp_path / "out")
    assert (sim.append_new(df, path, "id"), sim.append_new(df, path, "id"), sim.append_new(spark.createDataFrame([(9, "n", "m")], df.schema), path, "id")) == (3, 0, 1)
