"""Recall 1 against brute force, with ties, repeated rows and vectors that take no part."""

import numpy as np
import pytest

from trackmill.llm import neighbours as N


def brute(rows, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for i in sorted({i for i, _ in good if i % 5 == 0}):
        x = min((v for j, v in good if j == i), key=list)
        found = []
        for j, y in good:
            if j != i and len(x) == len(y):
                s = 0.0
                for a, b in zip(x, y, strict=True):
                    s += a * b
                found.append((-s, j))
        if found:
            out[i] = sorted(found)[:k]
    return out


@pytest.mark.parametrize(("candidates", "queries"), [(8192, 4096), (37, 11)])
def test_matches_brute_force(spark, candidates, queries):
    rng = np.random.default_rng(8)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=12)]) for i in range(300)]
    rows[7] = (7, rows[5][1])
    rows[8] = (8, rows[5][1])
    rows[9] = (9, [1e6 * x for x in rows[9][1]])
    rows += [rows[10], (300, None), (301, [0.0] * 12), (302, [float("nan")] * 12), (303, [float("inf")] + [0.0] * 11), (305, [1.0, None] + [0.0] * 10), (310, [1.0, 2.0]), (311, [2.0, 1.0]), (None, [1.0] * 12), (320, [])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, d int, side int")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = {}
    for r in N.nearest(df, "id % 5 = 0", 6, candidates=candidates, queries=queries).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
        assert r["rank"] == len(got[r["query_id"]])
    assert got == brute(rows, 6)


def test_empty(spark):
    df = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert N.nearest(df.limit(0), "id % 5 = 0", 6).count() == 0
    assert N.nearest(df, "id % 5 = 0", 6).count() == 0
