"""Queries in blocks give what a broadcast of them gives."""

import numpy as np

from mortise.operators import relations, retrieval


def test_blocks_of_queries(spark, monkeypatch):
    r = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, [float(x) for x in r.normal(size=4)], float(i)) for i in range(60)], "id long, v array<float>, y double")
    asked = rows.where("id % 3 = 0")
    answers = lambda: (sorted(map(tuple, relations.cosine_topk(rows, asked, "id", "v", 3).collect())), sorted((x.id, round(x.estimate, 9), round(x.distance, 9)) for x in retrieval.knn_mean(asked, rows, "id", "v", "y", 3).collect()))
    whole = answers()
    monkeypatch.setattr(relations, "QUERY_BLOCK", 7)
    monkeypatch.setattr(relations, "ROW_BLOCK", 9)
    plan = relations.cosine_topk(rows, asked, "id", "v", 3)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and answers() == whole and len(whole[0]) == 60 and len(whole[1]) == 20
