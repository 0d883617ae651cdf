"""Held-out accuracy, the backoff rule on a small model, and edge cases."""

import math

import numpy as np
import pytest

from trackmill.llm import language_id as L

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def found(spark):
    from trackmill.llm.registry import op2_language_id

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    return op2_language_id(spark, SF).join(docs, "doc_id").collect()


def test_held_out_accuracy(found):
    held = [r for r in found if r["held_out"] and r["lang"]]
    assert len(found) == 1000 and len(held) > 100
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in found)


def brute(counts, text, orders):
    """Word-first backoff with plain dictionaries. counts[order][lang]: frequency by word or n-gram."""
    langs = sorted({x for c in counts for x in c})
    logs = [{x: {w: math.log10(n / sum(c[x].values())) for w, n in c[x].items()} for x in c} for c in counts]
    low = [min((v for x in t.values() for v in x.values()), default=0) - 1 for t in logs]
    scores, n = dict.fromkeys(langs, 0.0), 0
    for word in "".join(ch if ch.isalpha() else " " for ch in text.lower()).split():
        for order in (0, *range(orders, 0, -1)):
            padded = word if order < 2 else f" {word} "
            parts = [word] if not order else [padded[i : i + order] for i in range(len(padded) - order + 1)]
            parts = [p for p in parts if any(p in t for t in logs[order].values())]
            if parts:
                for x in langs:
                    scores[x] += sum(logs[order].get(x, {}).get(p, low[order]) for p in parts) / len(parts)
                n += 1
                break
    return max(langs, key=lambda x: scores[x]) if n else langs[0]


def test_backoff_matches_plain_dictionaries(spark):
    texts = {"aa": ["the cat sat on Thé mat", "a cat that sings"], "bb": ["le chat dort ici", "un chien, un chat et l'été"]}
    rows = [(i, t, x) for i, (x, t) in enumerate((x, t) for x, ts in texts.items() for t in ts)]
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_order=3)
    counts = []
    for order in range(4):
        c = {}
        for x, ts in texts.items():
            c[x] = {}
            for t in ts:
                for w in "".join(ch if ch.isalpha() else " " for ch in t.lower()).split():
                    p = w if order < 2 else f" {w} "
                    for g in [w] if not order else [p[i : i + order] for i in range(len(p) - order + 1)]:
                        c[x][g] = c[x].get(g, 0) + 1
        counts.append(c)
    tests = ["cats", "chats et chiens", "the", "zzqq", "été", "singing matters", "dormir", "un cat", "x" * 5000 + " chat"]
    assert [p[0] for p in model.predict(tests)] == [brute(counts, t, 3) for t in tests]


def test_edges(spark):
    rows = [(1, "hello there", "en"), (2, "hola que tal", "es"), (3, None, "en"), (4, "12 34 !", None), (None, "", "es"), (1, "hello there", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(docs)
    got = L.identify(docs.withColumn("score_", docs.doc_id), model).collect()
    assert [r["lang_pred"] for r in got] == ["en", "es", "und", "und", "und", "en"]
    assert L.identify(docs.limit(0), model).count() == 0
    empty = L.fit(docs.limit(0))
    assert {r["lang_pred"] for r in L.identify(docs, empty).collect()} == {"und"}
    assert np.isclose(got[2]["score"], 0)
