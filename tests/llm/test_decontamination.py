"""Containment against brute force, by both paths."""

import random
import re

import pytest

from trackmill.llm import decontamination as D


def shingle_set(text, size=5):
    w = re.findall(r"[a-z0-9]+", (text or "").lower())
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


@pytest.mark.parametrize("bound", [D.BROADCAST_SHINGLES, 0])
def test_matches_brute_force(spark, bound):
    rng = random.Random(2)
    word = lambda: rng.choice("ab cd ef gh ij".split()) + str(rng.randrange(30))
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 5, 6, 12, 30, 80])))) for i in range(25)] + [(90, None), (91, "..."), (None, "a null item holds these six words")]
    items.append(items[3])
    docs = []
    for i in range(120):
        text = [word() for _ in range(rng.choice([0, 3, 40, 900]))]
        if rng.random() < 0.5:
            inner = (rng.choice(items)[1] or "").split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                if inner:
                    inner[rng.randrange(len(inner))] = "changed"
            at = rng.randrange(len(text) + 1)
            text[at:at] = [w.upper() + rng.choice([",", ".", ""]) for w in inner]
        docs.append((i, rng.choice([" ", "\n"]).join(text), 1, "z"))
    docs += [(900, None, 1, "z"), (None, "so A null item, holds these six words. ok", 1, "z"), docs[5], (901, items[0][1], 1, "z")]
    want = []
    for d, t, *_ in docs:
        for i, x in items:
            s = shingle_set(x)
            both = len(s & shingle_set(t))
            if s and both * 100 >= 80 * len(s):
                want.append((d, i, len(s), both))
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id int, n string")
    got = D.contained_items(d, spark.createDataFrame(items, "item_id long, text string"), broadcast_shingles=bound)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key) and len(want) > 20
    kept = D.decontaminate(d, spark.createDataFrame(items, "item_id long, text string"), broadcast_shingles=bound)
    assert kept.columns == d.columns and {r[0] for r in kept.collect()} == {r[0] for r in docs} - {r[0] for r in want if r[0] is not None}


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "one two three four five six")], "doc_id long, text string")
    i = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    assert D.contained_items(d.limit(0), i).count() == 0
    assert D.contained_items(d, i.limit(0)).count() == 0
    assert D.contained_items(d, i).count() == 1
