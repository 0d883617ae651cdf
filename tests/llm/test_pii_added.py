"""Spans that the base rules miss are added by the trees, look-alikes are not; with few labels nothing is added."""

import random

from pyspark.sql import functions as F

from trackmill.llm import pii as P


def corpus(n, seed=5, plant=True):
    """Documents with base spans, look-alikes and, in every fourth, a planted span of another form."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    words = lambda k: " ".join(word() for _ in range(k))
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    rows, planted = [], []
    for i in range(n):
        area, line = str(rng.randrange(200, 999)), digits(4)
        base = [f"+1 ({area}) 555-{line}", f"{word()}.{digits(2)}@{word()}" + rng.choice([".example.com", ".com", ".org"]), f"call +49 {digits(3)} {digits(4)} {digits(2)}"][i % 3]
        like = [f"id={digits(11)}", f"{digits(9)}abc", f"{word()}@{word()}", f"no {digits(16)}7", f"x{digits(4)}-{digits(4)}"][i % 5]
        text = f"{words(6)} {base} {words(5)} {like} {words(4)} "
        if plant and i % 4 == 0:
            span, kind = [(f"1 ({area}) 555-{line}", "phone"), (f"{word()}.{digits(2)} (at) {word()} dot example dot com", "email"), (f"{word()}.{digits(2)}[at]{word()}[dot]com", "email")][i // 4 % 3]
            planted.append((i, kind, len(text), len(text) + len(span)))
            text += span + " "
        rows.append((i, text + words(3)))
    return rows, planted


def test_planted_spans_are_added(spark):
    rows, planted = corpus(600)
    found = P.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).where("not base and kind is not null").select("key", "kind", "start", "stop").collect()
    got = {tuple(r) for r in found}
    right = {p for p in planted if p in got}
    assert len(right) >= 0.8 * len(planted), len(right) / len(planted)
    assert len(got - set(planted)) <= 0.05 * len(got), sorted(got - set(planted))[:9]


def test_copies_do_not_fill_the_sample_and_few_labels_add_nothing(spark):
    rows, planted = corpus(600)
    copies = [(1000 + i, f"a copy +1 (200) 555-0000 of one and id={10**10}") for i in range(3000)]
    found = P.find_pii(spark.createDataFrame(rows + copies, "doc_id long, text string")).where("not base and kind is not null")
    assert found.where(F.col("key") < 1000).count() >= 0.8 * len(planted)
    few = spark.createDataFrame(rows[: P.FIT_LEAST - 1], "doc_id long, text string")
    assert P.find_pii(few).where("not base and kind is not null").count() == 0


def test_forms_beyond_the_old_limits_are_proposed(spark):
    local, host = "n" * 70, "h" * 300
    rows = [(1, f"mail {local} (at) {host} dot example dot com now"), (2, "a 10[.]0[.]0[.]1 b"), (3, " ".join("1234567890" * 9)), (4, "10 (dot) 300 (dot) 0 (dot) 1"), (5, "4111.1111.1111.1111 x")]
    got = {(r["key"], r["kind"], r["match"], r["valid"]) for r in P.spans(spark.createDataFrame(rows, "doc_id long, text string")).where("not base and kind is not null").collect()}
    assert (1, "email", f"{local} (at) {host} dot example dot com", True) in got
    assert (2, "ip", "10[.]0[.]0[.]1", True) in got and (4, "ip", "10 (dot) 300 (dot) 0 (dot) 1", False) in got
    assert (5, "card", "4111.1111.1111.1111", True) in got
    assert not any(k == 3 for k, *_ in got)
