"""Dictionary and transitions cover all documents, and a match is described whole."""

import hashlib

from pyspark.sql import functions as F

from trackmill.llm import secrets as S


def features(spark, monkeypatch, rows):
    """Features of each key's finding as scan_secrets has them."""
    seen = {}
    write = S.materialize

    def keep(df, label):
        seen[label] = write(df, label)
        return seen[label]

    monkeypatch.setattr(S, "materialize", keep)
    S.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string"))
    return {r["key"]: r for r in seen["secret-features"].collect()}


def test_words_of_rare_documents_count(spark, monkeypatch):
    # 3,000 documents of one language; a rare one's two words stand in the two with the largest crc32 of key.
    last = [r["id"] for r in spark.range(3000).orderBy(F.desc(F.crc32(F.col("id").cast("string").cast("binary")))).limit(2).collect()]
    rows = [(i, "the words of most documents") for i in range(3000)]
    rows[last[0]] = (last[0], "zquvel brontik beside zquvel-brontik-7")
    rows[last[1]] = (last[1], "brontik zquvel, x9f3k2q8z1w7 and")
    got = features(spark, monkeypatch, rows)
    assert got[last[0]]["f_covered"] > 0.7 and got[last[0]]["f_transition"] > -6
    assert got[last[0]]["rule"] == 0.0 and got[last[1]]["f_covered"] == 0 and got[last[1]]["f_words_near"] == 2


def test_more_words_than_any_limit(spark, monkeypatch):
    name = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(5))
    rows = [(i, " ".join(name(j) for j in range(i % 10 * 3000, i % 10 * 3000 + 3000))) for i in range(30)]
    # Each of these words stands twice by itself, fewer times than 30,000 others.
    rows += [(100, "zzyrare-zzxrare-1"), (101, "zzpwhat-zzqwhat-1"), (102, "zzyrare zzxrare"), (103, "zzxrare zzyrare")]
    got = features(spark, monkeypatch, rows)
    assert got[100]["f_covered"] == 14 / 17 and got[101]["f_covered"] == 0


def test_long_match_is_described_whole(spark, monkeypatch):
    long = "x1" * 150 + "-heating" * 100
    got = features(spark, monkeypatch, [(1, long), (2, "heating heating")])
    assert abs(got[1]["f_covered"] - 700 / len(long)) < 1e-9


def test_candidates_without_digits_and_in_long_texts(spark):
    mixed, other = "aBcDeFgHiJkLmNoPqRsT", "getUseraccountinformation"
    long = "word " * 700_000
    rows = [(1, f"x {mixed} y {other} z"), (2, long + "password=135299847ac0e0f0dc " + long), (3, None), (4, "")]
    found = S.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    # By hand: the run whose case changes often, and the assigned value behind 3.5 million characters.
    assert {(r["key"], r["match"], r["start"]) for r in found} == {(1, mixed, 2), (2, "135299847ac0e0f0dc", len(long) + len("password="))}


def test_boundary_of_what_can_be_fitted(spark):
    rows = lambda n: [(i, f"password={hashlib.md5(b'%d' % i).hexdigest()} b 10.0.{i}.201:8080 c") for i in range(1, n + 1)]
    few = S.scan_secrets(spark.createDataFrame(rows(S.FIT_LEAST - 1), "doc_id long, text string")).collect()
    assert len(few) == S.FIT_LEAST - 1 and {r["score"] for r in few} == {1.0}
    enough = S.scan_secrets(spark.createDataFrame(rows(S.FIT_LEAST), "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in enough} == set(range(1, S.FIT_LEAST + 1))


def test_held_out_findings(spark):
    import random

    from tests.llm.test_secrets import corpus

    rows, _ = corpus(random.Random(7), 700)
    got = {(r["label"], r["found"]): r["n"] for r in S.held_out(spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, source string")).collect()}
    right, wrong = got.get((1.0, True), 0), got.get((0.0, True), 0)
    assert right > 20 and right >= 0.95 * (right + wrong) and got.get((1.0, False), 0) <= 0.1 * right
