"""Vectors held against queries in blocks, with ties, nulls and odd lengths."""

from mortise.operators import relations, retrieval


def test_copies_nulls_and_lengths(spark):
    rows = [(i, [1.0, 2.0]) for i in range(20)] + [(20, None), (21, [1.0]), (22, [None, 1.0]), (23, [0.0, 0.0]), (24, [2.0, 1.0])]
    df = spark.createDataFrame([(*x, 1.0) for x in rows], "id long, v array<double>, y double")
    asked = df.where("id = 5 or id = 24")
    got = {(x.q_id, x.place): (x.id, x.cosine) for x in relations.cosine_topk(df, asked, "id", "v", 24).collect()}
    assert [got[5, k][0] for k in range(1, 25)] == [i for i in range(20) if i != 5] + [24, 20, 21, 22, 23]
    assert [got[24, k][0] for k in (1, 2, 20)] == [0, 1, 19] and got[24, 21] == (20, None)
    assert [(x.id, x.estimate, x.distance) for x in retrieval.knn_mean(asked.where("id = 5"), df, "id", "v", "y", 3).collect()] == [(5, 1.0, 0.0)]
    assert relations.cosine_topk(df, asked.where("false"), "id", "v", 2).collect() == []
