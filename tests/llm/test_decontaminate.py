"""Decontamination: the number of parts changes no result, and items without an id count."""

import pytest

from mortise.llm import decontaminate

TEXTS = ["the first passage of all", "one more passage to be found here", "no part of it"]


@pytest.mark.parametrize("size", [2_000_000, 20])
def test_rows_are_judged_by_themselves(spark, monkeypatch, size):
    monkeypatch.setattr(decontaminate, "PART_BYTES", size)
    bench = spark.createDataFrame([(1, TEXTS[0]), (None, TEXTS[1])], "item_id long, text string")
    rows = [(7, TEXTS[0]), (7, TEXTS[1]), (None, TEXTS[0]), (None, TEXTS[2]), (None, None), (8, TEXTS[0]), (8, TEXTS[0]), (9, TEXTS[0] + " " + TEXTS[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in decontaminate.contamination(docs, bench).collect())
    first, second = (5, 5, ["1"], True), (7, 7, [], True)
    assert got == sorted([(7, *first), (7, *second), (0, *first), (0, 4, 0, [], False), (0, 0, 0, [], False), (8, *first), (8, *first), (9, 12, 12, ["1"], True)])
    assert sorted(r.text or "" for r in decontaminate.keep_clean(docs, bench).collect()) == ["", TEXTS[2]]
