"""Trees and proofs against a plain version in Python."""

import hashlib
import zlib

import pytest

from trackmill.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in ("doc_id", "source", "lang", "n_chars", "text")))


def up(nodes):
    """Root of nodes, and for each the levels of (left, right) siblings."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for path, a in zip(paths, at, strict=True):
            run = level[a // 8 * 8 : a // 8 * 8 + 8]
            path.append(("".join(run[: a % 8]), "".join(run[a % 8 + 1 :])))
        level, at = [h(*level[i : i + 8]) for i in range(0, len(level), 8)], [a // 8 for a in at]
    return level[0] if level else None, paths


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    out, roots = [], []
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        roots.append(up([leaf(r) for r in groups[g]]))
    root, tops = up([r for r, _ in roots])
    for g, (subroot, paths), top in zip(names, roots, tops, strict=True):
        for r, path in zip(groups[g], paths, strict=True):
            start = dict(r)
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["text"] is not None:
                start["text"] = "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])
            fold = leaf(start)
            for a, b in path + top:
                fold = h(a, fold, b)
            out.append((r["doc_id"], leaf(r), subroot, root, h(*(a + b for a, b in path + top)), fold, fold == root))
    return sorted(out, key=str)


def check(spark, rows, schema=SCHEMA):
    got = merkle.tampering_report(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)


def row(i, text="Some Text", lang="en", source="s", n=9):
    return {"doc_id": i, "text": text, "lang": lang, "source": source, "n_chars": n}


def test_sizes_around_runs_and_blocks(spark):
    rows = [row(i, f"Text {i}", lang) for lang, n in (("en", 1300), ("de", 512), ("fr", 513), ("es", 65), ("it", 64), ("pt", 9), ("nl", 8), ("sv", 1), ("", 2), (None, 7)) for i in range(n)]
    check(spark, rows)


def test_more_groups_than_a_run(spark):
    check(spark, [row(i, "x" * i, f"l{i % 75}") for i in range(160)])


def test_nulls_ties_and_repeated_rows(spark):
    rows = [row(None), row(None, None, None, None, None), row(3), row(3), row(3, "Other"), row(3, None), row(4, ""), row(5, "É" * 5), row(6, "A" * 300_000)]
    check(spark, rows + rows)


@pytest.mark.parametrize("n", [1, 2, 9])
def test_lone_groups(spark, n):
    check(spark, [row(i) for i in range(n)])


def test_empty_and_extra_columns(spark):
    assert merkle.tampering_report(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [row(i) | {"rank": "x", "n": 3, "block": None, "path": "p", "digest": "d", "grp": "g", "kids": i} for i in range(20)]
    got = merkle.tampering_report(spark.createDataFrame(rows, SCHEMA + ", rank string, n int, block string, path string, digest string, grp string, kids long"))
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)


def test_tampered_rows_fail_alone(spark):
    rows = [row(i, "UPPER" if i % 2 else "lower") for i in range(600)]
    for r in merkle.tampering_report(spark.createDataFrame(rows, SCHEMA)).collect():
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 3 != 0 or r.doc_id % 2 == 0)
