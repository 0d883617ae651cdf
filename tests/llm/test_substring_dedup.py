"""Spans against a plain version; planted passages are caught and clean documents left alone."""

import random

import numpy as np

from trackmill.llm import substring_dedup as S
from trackmill.llm.hashing import MARKS, mix, words


def plain(texts):
    """texts: (key, text). Removed (key, start, stop) byte ranges by dictionaries."""
    places = {}
    for key, text in texts:
        raw = text.encode()
        w = words([raw], MARKS)
        sentences, run = [], []
        for i in range(len(w.hash)):
            run.append(i)
            gap = raw[w.end[i] : w.start[i + 1] if i + 1 < len(w.hash) else len(raw)]
            if any(b in b".!?\n\r" for b in gap) or i + 1 == len(w.hash) or int(mix(w.hash[i : i + 1])[0]) % 8 == 0:
                sentences.append(run)
                run = []
        for i in range(len(sentences)):
            span = []
            for j in range(i, len(sentences)):
                span += sentences[j]
                if j - i >= 2 and len(span) >= 24:
                    content = tuple(raw[w.start[x] : w.end[x]].decode().translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in span)
                    places.setdefault(content, []).append((key, int(w.start[span[0]]), int(w.end[span[-1]])))
                    break
    out = {}
    for spots in places.values():
        for key, a, b in sorted(set(spots))[1:]:
            out.setdefault(key, []).append((a, b))
    merged = set()
    for key, ranges in out.items():
        ranges.sort()
        a, b = ranges[0]
        for c, d in ranges[1:]:
            if c > b:
                merged.add((key, a, b))
                a, b = c, d
            b = max(b, d)
        merged.add((key, a, b))
    return merged


def test_matches_plain_version(spark):
    rng = random.Random(6)
    word = lambda: rng.choice(["ab", "Cd", "éf", "gh", "ij"]) + str(rng.randrange(400))
    text = lambda n: "".join(word() + rng.choice([" ", " ", " ", " ", ", ", ". ", "!\n", " | "]) for _ in range(n))
    passages = ["".join(word() + " " for _ in range(60)), text(55), text(120)]
    rows, planted, clean = [], set(), set()
    for i in range(150):
        body = text(rng.choice([0, 5, 80, 600]))
        if rng.random() < 0.3:
            at = body.rfind(" ", 0, rng.randrange(len(body) + 1)) + 1
            body = body[:at] + rng.choice(passages) + body[at:]
            planted.add(i)
        else:
            clean.add(i)
        rows.append((i, body))
    rows += [(200, rows[4][1] or "x"), (201, text(100) + passages[2] + passages[2])]
    df = spark.createDataFrame([(i, t, 1, "h") for i, t in rows] + [(300, None, 1, "h"), (301, "", 1, "h")], "doc_id long, text string, start int, hash string")
    got = {(r["doc_id"], r["start"], r["stop"]) for r in S.removed(df, every_run=False).collect()}
    assert got == plain(rows)
    caught = {k for k, _, _ in got}
    assert len(planted - caught) <= len(passages) and not (caught & clean)
    kept = {r["doc_id"]: r["text"] for r in S.without_repeats(df, every_run=False).collect()}
    for i, t in rows:
        raw, at, want = t.encode(), 0, b""
        for _, a, b in sorted(x for x in got if x[0] == i):
            want, at = want + raw[at:a], b
        assert kept[i] == (want + raw[at:]).decode()
    assert kept[300] is None and S.without_repeats(df).columns == df.columns


def test_empty_and_repeated_rows(spark):
    body = " ".join(f"w{i}." for i in range(60))
    df = spark.createDataFrame([(1, body), (1, body), (None, body), (2, body)], "doc_id long, text string")
    assert S.removed(df.limit(0)).count() == 0
    assert {r["doc_id"] for r in S.removed(df).collect()} == {1, 2}
    assert np.all([r["text"] in (body, ".") for r in S.without_repeats(df).collect()])
