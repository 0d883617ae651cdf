"""The pipeline's stages where keys are null or repeated, columns are more than those of documents, texts are very long, and tables are empty."""

import random

import pytest

import corpus_pipeline as P

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
COLUMNS = ["doc_id", "lang", "n_chars", "source", "text"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame([(0, "the secret answer of this benchmark is forty two and a half")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def text(seed, n=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(["ba", "ko", "ri", "ten", "lu"]) for _ in range(3)) for _ in range(n))


def run(spark, docs, folder):
    """Rows of each stage but the last, then the last's."""
    out = []
    for name, stage in P.STAGES:
        docs = P.materialize(stage(spark, docs, folder), f"edge-{name}")
        out.append(docs)
        if name != P.STAGES[-1][0]:
            assert sorted(docs.columns) == COLUMNS
    return out


def test_keys_and_columns(spark, folder):
    leak = "the secret answer of this benchmark is forty two and a half"
    rows = [(1, text(1)), (1, text(2)), (2, text(1)), (None, text(3)), (None, text(4) + " " + leak), (5, leak + " " + text(5)), (5, text(6)), (6, None), (7, ""), (8, text(8)), (8, text(8))]
    docs = spark.createDataFrame([(k, t, "en", "s", 1, 3, "m") for k, t in rows], SCHEMA + ", rank int, __mark string".replace("__mark", "mark"))
    known, one, clean, safe, packed = run(spark, docs, folder)
    assert known.count() == 9 and {r.text for r in known.collect()} == {t for _, t in rows if t}
    # 2 repeats 1's first text, 8 repeats itself; texts that share a key stay.
    assert sorted((r.doc_id, r.text) for r in one.where("doc_id is not null").collect()) == sorted([(1, text(1)), (1, text(2)), (5, leak + " " + text(5)), (5, text(6)), (8, text(8))])
    assert one.where("doc_id is null").count() == 2
    assert sorted(((r.doc_id or 0), r.text) for r in clean.collect()) == sorted([(1, text(1)), (1, text(2)), (0, text(3)), (5, text(6)), (8, text(8))])
    assert safe.count() == 5 and packed.count() >= 5


def test_a_very_long_text(spark, folder):
    docs = spark.createDataFrame([(1, text(1, 600_000), "en", "s", 0), (2, text(2), "en", "s", 0)], SCHEMA)
    *_, safe, packed = run(spark, docs, folder)
    assert safe.count() == 2
    pieces = packed.where("doc_id = 1").selectExpr("count(*) as n", "sum(length) as length", "max(start) as last").first()
    assert pieces.n > 1000 and pieces.length > 1024 * (pieces.n - 1)


def test_empty_tables(spark, folder):
    assert [d.count() for d in run(spark, spark.createDataFrame([], SCHEMA), folder)] == [0] * 5
