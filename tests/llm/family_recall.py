"""python tests/llm/family_recall.py [SIZE...]: recall of line dedup in families of similar lines that don't link, each with one near copy."""

import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
from mortise.llm import line_dedup  # noqa: E402
from mortise.session import local_session  # noqa: E402


def shingles(x):
    return {x[j : j + 8] for j in range(len(x) - 7)}


spark = local_session(8, "8g")
spark.sparkContext.setLogLevel("ERROR")
for size in map(int, sys.argv[1:] or ["2000", "10000"]):
    for shared in (160, 180):
        r = np.random.default_rng(size + shared)
        line = lambda n: "".join(r.choice(list("abcdefghij"), n))  # noqa: B023, E731
        template = line(shared)
        own = [template + line(220 - shared) for _ in range(size)]
        copies = [x[:-12] + line(12) for x in own]
        linked = {i for i in range(size) if 100 * len(shingles(own[i]) & shingles(copies[i])) >= 80 * len(shingles(own[i]) | shingles(copies[i]))}
        report = line_dedup.line_report(spark.createDataFrame(list(enumerate(own + copies)), "doc_id long, text string").repartition(16))
        gone = {x.doc_id - size for x in report.where("n_removed > 0").collect()}
        print(f"family of {size}, {shared} of 220 characters shared: found {len(gone & linked)} of {len(linked)}, removed otherwise {len(gone - linked)}", flush=True)
