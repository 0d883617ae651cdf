"""Variants against a plain version that compares all words."""

import random
import re
import zlib

import pytest

from trackmill.llm import spelling

SCHEMA = "doc_id long, text string"


def edits(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts):
    near = {w: [x for x in counts if edits(w, x)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n, len(near[w]), form[w], counts[form[w]] if form[w] else None, root))
    return sorted(out)


def plain_words(docs):
    counts = {}
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] = counts.get(run, 0) + 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def got(spark, counts, **options):
    return sorted(map(tuple, spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"), **options).collect()))


def test_words(spark):
    random.seed(5)
    stems = ["".join(random.choice("abcÀéÿZ") for _ in range(random.randint(3, 9))) for _ in range(60)]
    docs = [(random.choice([None, *range(40)]), random.choice([None, "", *(" ".join(random.choices(stems, k=80)) + random.choice("-×.9_") for _ in range(30))])) for _ in range(120)]
    docs += [(i, "Straße straße STRASSE x×yyyyyy÷zzzzz " * 3) for i in range(300)]
    assert {r.word: r.n for r in spelling.words_of(spark.createDataFrame(docs, SCHEMA)).collect()} == plain_words(docs)


@pytest.mark.parametrize("block", [7, 1024])
def test_variants_equal_all_pairs(spark, block):
    random.seed(block)
    counts = {}
    for _ in range(900):  # few letters, so many words are near and repeat letters
        w = "".join(random.choice("ab") for _ in range(random.randint(5, 10)))
        counts[w] = random.choice([3, 3, 4, 6, 8, 12, 25, 60, 200])
    for w in ["straße", "strasse", "strase", "strałe", "na\U0001f600ve", "naïve", "a" * 60, "a" * 61, "a" * 59 + "b", "b" + "a" * 60, "aaaaaaaa" * 5000]:
        counts[w] = random.randint(3, 90)
    assert got(spark, counts, block=block) == plain_variants(counts)


def test_one_hot_tile(spark):
    counts = {f"constant{a}{b}ending": 3 + (ord(a) * ord(b)) % 50 for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"}
    assert got(spark, counts, block=64) == got(spark, counts) == plain_variants(counts)


def test_chains_of_forms(spark):
    counts = {"a" * (5 + i): 3 * 2**i for i in range(20)}
    rows = got(spark, counts)
    assert rows == plain_variants(counts) and {r[5] for r in rows} == {"a" * 24}


def test_empty(spark):
    assert got(spark, {}) == []
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "1 2 3 ab")], SCHEMA)
    assert spelling.variants(spelling.words_of(docs)).collect() == []


def test_extra_columns(spark):
    docs = spark.createDataFrame([(i, "lattern lantern lantern latern " * 3, "w", 1, 2) for i in range(6)], SCHEMA + ", word string, n int, run int")
    rows = sorted(map(tuple, spelling.variants(spelling.words_of(docs)).collect()))
    assert rows == plain_variants(plain_words([(i, "lattern lantern lantern latern " * 3) for i in range(6)]))
