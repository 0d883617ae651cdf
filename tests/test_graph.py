import random

from trackmill.operators.graph import connected_components


def brute(pairs):
    parent = {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent.setdefault(a, a), parent.setdefault(b, b)
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components_match_union_find(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, i) for i in range(501, 540)] + [(i, 400) for i in range(520, 530)]
    loose = [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(90)]
    pairs = chain + star + loose + [(7, 7), (8, 9), (9, 8)]
    got = connected_components(spark.createDataFrame(pairs + [(None, 4)], "src long, dst long"))
    assert {r["node"]: r["component"] for r in got.collect()} == brute(pairs)


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
