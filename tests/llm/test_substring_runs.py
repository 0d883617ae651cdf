"""The registered query against a version that hashes every run of sentences; short embedded passages and tails are caught."""

import random

from trackmill.llm import registry
from trackmill.llm import substring_dedup as S
from trackmill.llm.hashing import MARKS, mix, words


def query(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return {(r["doc_id"], r["start"], r["stop"]) for r in registry.QUERIES["op4_substring_dedup"](spark, str(path)).collect()}


def every_run(rows):
    """Removed bytes of each key, from a dictionary of all runs with three sentences and 24 words at least."""
    places, out = {}, {}
    for key, text in rows:
        raw = text.encode()
        w = words([raw], MARKS)
        n = len(w.hash)
        value = [int(v) for v in mix(w.hash)]
        marked = [i + 1 == n or any(b in b".!?\n\r" for b in raw[w.end[i] : w.start[i + 1]]) for i in range(n)]
        ends = set()
        for i in range(n):
            if marked[i]:
                ends.add(i)
            if i + 12 <= n and not any(marked[i : i + 11]):
                ends.add(min(range(i, i + 12), key=lambda x: (value[x], -x)))
        ends = sorted(ends)
        begins = [0] + [e + 1 for e in ends[:-1]]
        content = [raw[a:b].decode().lower() for a, b in zip(w.start, w.end, strict=True)]
        for i, a in enumerate(begins if n else []):
            for e in ends[i + 2 :]:
                if e - a + 1 >= 24:
                    places.setdefault(tuple(content[a : e + 1]), []).append((key, int(w.start[a]), int(w.end[e])))
    for spots in places.values():
        for key, a, b in sorted(spots)[1:]:
            out.setdefault(key, set()).update(range(a, b))
    return out


def test_removes_what_every_run_would(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: rng.choice(["ab", "cd", "ef"]) + str(rng.randrange(500))
    text = lambda n, marks: "".join(word() + rng.choice(marks) for _ in range(n))
    kinds = [[" "], [" "] * 6 + [". "], [" "] * 25 + ["! "], [". "]]
    passages = [text(n, rng.choice(kinds)) for n in (51, 60, 75) for _ in range(3)]
    rows = []
    for i in range(60):
        body = text(rng.choice([0, 20, 90]), rng.choice(kinds))
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            body += (p if rng.random() < 0.7 else p[: p.index(" ", len(p) // 2) + 1]) + text(rng.choice([1, 30]), rng.choice(kinds))
        rows.append((i, body))
    rows += [(100, " ".join(["a"] * 80)), (101, "b " + " ".join(["a"] * 50) + " c"), (102, ""), (103, rows[3][1])]
    got = {}
    for key, a, b in query(spark, tmp_path, rows):
        got.setdefault(key, set()).update(range(a, b))
    assert got == every_run(rows)


def test_embedded_passages_of_51_words_and_tails(spark, tmp_path):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    plain = lambda n: " ".join(word() for _ in range(n))
    rows, at = [], {}
    for p in range(150):
        # Half stand in text without marks, half are four sentences between others.
        sentences = p % 2
        passage = ". ".join(plain(n) for n in (20, 8, 16, 7)) + "." if sentences else plain(51)
        for k in range(2):
            before = plain(30) + (". " if sentences else " ")
            rows.append((2 * p + k, before + passage + " " + plain(30)))
        at[2 * p + 1] = (len(before), len(before) + len(passage) - sentences, sentences)
    got = query(spark, tmp_path, rows)
    assert len(got) == 150 and {k for k, _, _ in got} == set(at)
    for key, a, b in got:
        first, stop, sentences = at[key]
        edge = 0 if sentences else S.GAP * 9
        assert first <= a <= first + edge and stop - edge <= b <= stop, key
