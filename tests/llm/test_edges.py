"""Edge cases of language identification and neighbours: clashing names, ties, long texts, products out of range."""

from trackmill.llm import language_id as L
from trackmill.llm import neighbours as N


def test_language_edges(spark):
    rows = [(i, w, x) for i, (w, x) in enumerate([("alpha beta gamma shared", "aa"), ("delta epsilon zeta shared", "bb")] * 20)]
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    long = "delta epsilon " * 100_000
    docs = [(1, "alpha beta", "x", 5), (2, long, "x", 5), (3, "shared", "x", 5), (3, "shared", "x", 5), (None, "12 !", "x", 5), (4, None, "x", 5), (5, "alpha " * 5 + long, "x", 5)]
    got = L.identify(spark.createDataFrame(docs, "doc_id long, text string, lang_pred string, score int"), model)
    assert got.columns == ["doc_id", "lang_pred", "score"]
    found = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["lang_pred"]) for r in got.collect())
    # Both languages know "shared" equally well: the first of them is taken.
    assert found == [(-1, "und"), (1, "aa"), (2, "bb"), (3, "aa"), (3, "aa"), (4, "und"), (5, "bb")]
    assert L.identify(spark.createDataFrame(docs, "doc_id long, text string, a string, b int").limit(0), model).count() == 0
    none = L.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r["lang_pred"] for r in L.identify(spark.createDataFrame([(1, "alpha")], "doc_id long, text string"), none).collect()} == {"und"}


def test_products_beyond_doubles(spark):
    big = 1e200
    rows = [(0, [big, big]), (1, [big, big]), (2, [1.0, 1.0]), (3, [big, -big]), (4, [-big, -big]), (5, [1e-200, 1e-200])]
    got = [(r["rank"], r["vec_id"], r["score"]) for r in N.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "id = 0", 10).orderBy("rank").collect()]
    assert [g[1] for g in got] == [1, 2, 5, 3, 4]
    assert got[0][2] == float("inf") and got[1][2] == 2e200 and got[3][2] == got[4][2] == -float("inf")
