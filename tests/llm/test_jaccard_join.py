"""Components against brute force over all pairs."""

import random
import re

from trackmill.llm import jaccard_join as J

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_of(texts, size):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        out.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    return out


def brute(rows, size, num, den):
    ids, sets = [r[0] for r in rows], sets_of([r[1] for r in rows], size)
    comp = list(range(len(rows)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                comp[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)] = min(least.get(find(i), x), x)
    return sorted(((x if x is not None else -1), len(s), (least.get(find(i)) if s else x) if (s or x is not None) else None) for i, (x, s) in enumerate(zip(ids, sets, strict=True)))


def near(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
    return words


def corpus(rng):
    texts = []
    for _ in range(60):
        n = rng.choice([1, 2, 3, 4, 5, 6, 8, 9, 10, 11, 12, 15, 20, 40, 90, 300])
        base = [rng.choice("ab cd ef gh ij kl mn op".split()) + str(rng.randrange(40)) for _ in range(n)]
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 3, 8])):
            edits = rng.randrange(0, max(2, n // 20))
            texts.append(rng.choice([" ", "\n", " \t "]).join(near(rng, base, edits)))
    chain = [f"c{i}" for i in range(60)]
    for i in range(12):
        texts.append(" ".join(chain[:i] and [*(f"d{j}" for j in range(i)), *chain[i:]] or chain))
    return texts + [None, "", "  ", "SAME Case", "same case", texts[0].upper(), texts[0]]


def test_components_match_all_pairs(spark):
    rng = random.Random(11)
    texts = corpus(rng)
    rng.shuffle(texts)
    rows = [(i, t, 5, "x") for i, t in enumerate(texts)] + [(3, texts[3], 5, "x"), (None, texts[5], 5, "x"), (None, "nobody else has this one at all", 5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, digest string")
    for size, num, den in ((4, 85, 100), (5, 80, 100), (2, 6, 10)):
        got = J.jaccard_components(docs, size, num, den).collect()
        want = brute(rows, size, num, den)
        assert sorted(((r["doc_id"] if r["doc_id"] is not None else -1), r["n_shingles"], r["component_id"]) for r in got) == want
    kept = J.one_of_each(docs, 5, 80, 100)
    assert kept.columns == docs.columns
    firsts = {c for k, _, c in brute(rows, 5, 80, 100) if k == c}
    ids = [r["doc_id"] for r in kept.collect() if r["doc_id"] is not None]
    assert sorted(ids) == sorted(firsts)


def test_every_allocation_finds_all_pairs():
    import numpy as np

    rng = np.random.default_rng(1)
    for num, den in ((85, 100), (80, 100)):
        limits = J.bands(400, num, den)
        lows = np.array([b[0] for b in limits])
        for sets in (10, 10**6, 10**12):
            plan = [J.allocate(b, sets, num, den) for b in limits]
            for band, (m, k, e) in zip(limits, plan, strict=True):
                assert not m or m + k - e >= J.most_differing(band, num, den) + 1
            for _ in range(300):
                n = int(rng.integers(6, 340))
                a = rng.integers(0, 1 << 63, n).astype(np.uint64)
                b = a[: n - int(rng.integers(0, n // 6 + 1))]
                b = np.concatenate([b, rng.integers(0, 1 << 63, int(rng.integers(0, n // 6 + 1))).astype(np.uint64)])
                both = len(np.intersect1d(a, b))
                if den * both < num * (len(a) + len(b) - both) or both == len(a) == len(b):
                    continue
                s = [J.sketch(np.unique(x), num, den) for x in (a, b)]
                assert J.sketches_differ(*s) <= (len(a) + len(b)) * (den - num) // (den + num)
                sig = []
                for s in (a, b):
                    band = int(np.searchsorted(lows, len(s), "right")) - 1
                    sig.append({x for level in {band, max(band - 1, 0)} for x in J.signatures(s, level, *plan[level]).tolist()})
                assert sig[0] & sig[1]


def test_drifted_group_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 7)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(90)]
    rows = [(i, " ".join(near(rng, base, rng.randrange(0, 7)))) for i in range(150)]
    got = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100).collect()
    want = brute(rows, 4, 85, 100)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want and 20 < len({c for _, _, c in want}) < 140


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert J.jaccard_components(docs, 4, 85, 100).count() == 0
    assert J.one_of_each(docs, 4, 85, 100).count() == 0
