"""Items under five words inside longer documents, by both paths, against brute force; long texts and long items too."""

import random
import re

import pytest

from trackmill.llm import decontamination as D


def word_list(text):
    return re.findall(r"[a-z0-9]+", (text or "").lower())


def runs(w, k):
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


@pytest.mark.parametrize("bound", [D.BROADCAST_SHINGLES, 0])
def test_short_items_are_found_inside(spark, bound):
    rng = random.Random(12)
    word = lambda: rng.choice("ab cd ef gh".split()) + str(rng.randrange(9))
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 3, 4, 5, 9, 40, 300])))) for i in range(60)] + [(90, "What is two plus?"), (91, "yes"), (92, " ".join(word() for _ in range(20_000)))]
    docs = [(i, " ".join(word() for _ in range(rng.choice([2, 50, 400])))) for i in range(60)]
    docs += [(100, "So. What is two, PLUS? Four."), (101, "yes it is, yes"), (102, "yes"), (103, "x " * 60_000 + items[-1][1] + " x" * 60_000), (104, items[-1][1][:-10_000]), (105, items[7][1] + " " + items[8][1])]
    want = set()
    for d, t in docs:
        w = word_list(t)
        sets = {k: runs(w, k) for k in (3, 4, 5)}
        for i, x in items:
            v = word_list(x)
            k = len(v) if 3 <= len(v) < 5 else 5
            s = runs(v, k)
            if not s:
                if v == w:
                    want.add((d, i))
            elif 100 * len(s & sets[k]) >= 80 * len(s):
                want.add((d, i))
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} long, text string")
    got = D.contained_items(frame(docs, "doc_id"), frame(items, "item_id"), broadcast_shingles=bound, least_words=3)
    found = [(r["doc_id"], r["item_id"]) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want
    assert {(100, 90), (102, 91), (103, 92), (104, 92)} <= want and not {(101, 91)} & want
