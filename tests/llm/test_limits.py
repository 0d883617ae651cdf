"""What was beyond a limit or a key once: null and shared keys, long names and words, many words, files of few records."""

import numpy as np
import pytest

from trackmill.llm import binary_output, decontamination, language_id, secrets
from trackmill.llm import jaccard_join as J
from trackmill.llm.tokens import tokenizer_path

SCHEMA = "doc_id long, text string"


def words(a, b):
    return " ".join(f"w{i}" for i in range(a, b))


def test_rows_with_null_keys_link(spark):
    # 0 to 60 and 1 to 61 link, as do 1 to 61 and 2 to 62; without the text between them they do not.
    rows = [(5, words(0, 60)), (None, words(3, 63)), (6, words(6, 66)), (None, words(300, 360)), (None, words(300, 360)), (None, ""), (None, None)]
    got = sorted(map(tuple, J.jaccard_components(spark.createDataFrame(rows, SCHEMA), 4, 85, 100).collect()), key=str)
    assert got == sorted([(5, 57, 5), (None, 57, 5), (6, 57, 5), (None, 57, None), (None, 57, None), (None, 0, None), (None, 0, None)], key=str)
    kept = sorted(map(tuple, J.one_of_each(spark.createDataFrame(rows, SCHEMA), 4, 85, 100).collect()), key=str)
    assert kept == sorted([(5, words(0, 60)), (None, words(300, 360)), (None, ""), (None, None)], key=str)


def test_texts_that_share_a_key_stay(spark):
    a, b, c = words(0, 40), words(100, 140), words(200, 240)
    rows = [(1, a, 9), (1, b, 9), (2, a, 9), (3, c, 7), (3, c, 5), (4, c, 1)]
    kept = J.one_of_each(spark.createDataFrame(rows, SCHEMA + ", n int"), 5, 80, 100).collect()
    assert sorted(map(tuple, kept)) == [(1, a, 9), (1, b, 9), (3, c, 5)]
    items = spark.createDataFrame([(0, words(100, 130))], "item_id long, text string")
    rows = spark.createDataFrame([(1, a), (1, b), (None, b), (None, a), (2, None)], SCHEMA)
    assert sorted(map(tuple, decontamination.decontaminate(rows, items).collect()), key=str) == sorted([(1, a), (None, a), (2, None)], key=str)


def test_an_index_of_many_sets_is_as_large_as_one_of_few():
    for band in J.bands(2000, 85, 100):
        rows = []
        for sets in (250_000, 2_000_000, 15_000_000):
            m, k, _ = J.allocate(band, sets, 85, 100)
            rows.append(m + (band[0] + band[1]) / 2 if k else m)
        # Sets of few elements are alike in segments too often: all of their elements, and a few rows more, at most.
        assert max(rows) <= (1.5 * max(min(rows), 1) if band[0] > 30 else band[1] + 3), (band, rows)


def test_deletion_neighbourhoods_give_the_same_components(spark, monkeypatch):
    rng = np.random.default_rng(4)
    texts = []
    for _ in range(40):
        base = [f"w{x}" for x in rng.integers(0, 3000, rng.integers(5, 120))]
        for _ in range(3):
            t = list(base)
            for _ in range(rng.integers(0, 4)):
                t[rng.integers(0, len(t))] = f"v{rng.integers(0, 99)}"
            texts.append(" ".join(t))
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    want = sorted(map(tuple, J.jaccard_components(docs, 3, 80, 100).collect()))
    real = J.allocate

    def deletions(band, sets, num, den):
        m = real(band, sets, num, den)[0]
        h = J.most_differing(band, num, den)
        return ((h + 2) // 2, (h + 2) // 2, 0) if m else (0, 0, 0)

    monkeypatch.setattr(J, "allocate", deletions)
    assert sorted(map(tuple, J.jaccard_components(docs, 3, 80, 100).collect())) == want


def test_long_secret_names_and_words():
    text = "SECRET_KEY_BASE_OF_THE_PRODUCTION_SERVER_OF_ANOTHER_DEPARTMENT=abcdefgh"
    found = secrets.candidates("set " + text)
    assert [("set " + text)[a:b] for a, b in found] == ["abcdefgh"]
    word = "donaudampfschifffahrt"
    assert word in set(secrets.pieces(word + "12", "", "")) and secrets.Language({}).covered(word, {word}) == 1.0


def test_all_words_of_the_sample_are_known(spark):
    rows = [(i, " ".join(f"{lang}{j:05d}".translate(str.maketrans("0123456789", "abcdefghij")) for j in range(i * 400, i * 400 + 400)), lang) for i in range(100) for lang in ("xx", "yy")]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.tables[0][0]) == 80_000


@pytest.mark.parametrize("most", [0, 30])
def test_starts_where_files_are_limited(spark, most):
    docs = spark.createDataFrame([(i, words(0, i % 7)) for i in range(400)], SCHEMA)
    spark.conf.set("spark.sql.files.maxRecordsPerFile", most)
    try:
        rows = binary_output.encode_to_files(docs, tokenizer_path("word_bpe_49k.json"), 1).orderBy("key").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    before = np.concatenate([[0], np.cumsum([r["n_tokens"] for r in rows])[:-1]])
    assert [r["start"] for r in rows] == before.tolist() and [r["key"] for r in rows] == list(range(400))
