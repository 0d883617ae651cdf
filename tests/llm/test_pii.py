"""Base spans against a plain reading of the rules; added spans are extra, valid and apart."""

import hashlib
import random
import re

from trackmill.llm import pii as P

ORDER = {k: i for i, k in enumerate(P.KINDS)}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (ORDER[s[0]], s[1]))


def texts():
    rng = random.Random(4)
    pieces = ["a@b.c", "a@b.c_d@e.f", "x.y+z%1@mail-7.example.com.", "@@a@b", "a@b@c.d.e", "é@x.y", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "0001.002.3.255", "12.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111112", "41111111111111111111", "4111  1111", "+1 (449) 555-7462", "+1 (2)3-4.", "+", "+1", "+49 30 1234567 .", "++12345678", " ", "\n", "ñ", "word", "key=135299847ac0", "tel 030 1234567", "😀", "0" * 17, "a (at) b.com", "x[at]y", "-", "."]
    out = [None, "", "😀é a@b.cd 😀 10.0.0.1"] + pieces
    for _ in range(400):
        out.append("".join(rng.choice(pieces) + rng.choice(["", " ", " ", ", "]) for _ in range(rng.randrange(1, 12))))
    out += ["1" * 60_000, "a" * 60_000, "1 " * 30_000, "1." * 30_000, "a@" * 20_000, "+1" + " " * 50_000, ("mail a.b@c.de now " * 3000)]
    return out


def test_base_spans_match_plain_rules(spark):
    rows = [(i, t, "s", 3) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows + [rows[5], (None, "n@u.ll", "s", 3)], "doc_id long, text string, kind string, start int")
    got = P.digest(P.find_pii(docs)).collect()
    assert len(got) == len(rows) + 2
    by_id = dict((r[0], r[1]) for r in rows) | {None: "n@u.ll"}
    for r in got:
        want = brute(by_id[r["doc_id"]])
        listed = ",".join(":".join(map(str, s)) for s in want)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest(), by_id[r["doc_id"]]
        assert [r[f"n_{k}"] for k in P.KINDS] == [sum(s[0] == k for s in want) for k in P.KINDS]
        every = [tuple(s.split(":")) for s in r["spans"].split(",") if s]
        assert {(k, str(a), str(b)) for k, a, b in want} <= set(every)
        for k, a, b in set(every) - {(k, str(a), str(b)) for k, a, b in want}:
            assert int(a) < int(b) <= len(by_id[r["doc_id"]]) and all(int(b) <= s or int(a) >= e for _, s, e in want)


def test_redaction_and_empty(spark):
    docs = spark.createDataFrame([(1, "mail a@b.cd and 10.0.0.1."), (2, None), (3, "nothing")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in P.redact(docs).collect()} == {1: "mail <email> and <ip>.", 2: None, 3: "nothing"}
    assert P.digest(P.find_pii(docs.limit(0))).count() == 0
