"""Large components that nearly link: the join compares their classes, but makes no pair of each two of them."""

import random

from trackmill.llm import jaccard_join as J


def texts(rng, words, far, count):
    """Near copies of two texts of that many words, which differ in far words."""
    base = [f"w{rng.randrange(10**9)}" for _ in range(words)]
    other = list(base)
    for at in range(10, words - 10, (words - 20) // far)[:far]:
        other[at] = f"x{at}"
    out = []
    for t in (base, other):
        for _ in range(count):
            near = list(t)
            near[rng.randrange(words)] = f"y{rng.randrange(10**9)}"
            out.append(" ".join(near))
    return out


def test_near_misses_of_large_components_make_few_pairs(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 16)
    docs = [(i, t) for i, t in enumerate(texts(random.Random(5), 400, 9, 40))]
    kept = {}
    was = J.materialize
    monkeypatch.setattr(J, "materialize", lambda df, label: kept.setdefault(label, []).append(was(df, label)) or kept[label][-1])
    got = J.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), 5, 80, 100)
    sets = [set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for _, t in docs]
    links = [(a, b) for a in range(80) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert links and not [1 for a, b in links if (a < 40) != (b < 40)]
    assert all(r["component_id"] == (0 if r["doc_id"] < 40 else 40) for r in got.collect())
    assert "jaccard-pairs" in kept and kept["jaccard-open"][0].count() > 0
    assert sum(x.count() for x in kept["jaccard-pairs"]) < 160  # 1600 pairs of different components


def test_links_of_blocks_and_of_equal_groups_are_found(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 3)
    rng = random.Random(8)
    for far in (2, 3):
        docs = [(i, t) for i, t in enumerate(texts(rng, 200, far, 12))]
        sets = [set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for _, t in docs]
        root = list(range(len(docs)))
        for a in range(len(docs)):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    x, y = sorted((root[a], root[b]))
                    root = [x if r == y else r for r in root]
        got = {r["doc_id"]: r["component_id"] for r in J.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), 5, 80, 100).collect()}
        assert got == dict(enumerate(root))
