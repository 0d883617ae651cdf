"""Records: exact round trip. Packing: whole, gapless and close to the bound."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

from trackmill.llm import binary_output as B
from trackmill.llm import packing as P
from trackmill.llm.tokens import UnitEncoder, tokenizer_path

TEXTS = [None, "", "one two  three.\n\nIt's 12,5 \t x", "Straße été ñandú, fin", "word " * 3000, "x" * 9000, "a\xa0b \x1c.c", "same", "same", "  lead and trail  ", "<|endoftext|> a\0b"]


def frame(spark, texts, extra=True):
    rows = [(i if i != 3 else None, t, "k", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, start int")
    return df if extra else df.select("doc_id", "text")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_units_give_the_ids_of_whole_texts(name):
    encoder = UnitEncoder(tokenizer_path(name))
    texts = [t or "" for t in TEXTS] + ["é. ò, …. ‘x’ 's don't DON'T", "日本 語 テスト。 " * 30, "a.b,c!d?e;f:g|h#i$j%k&l*m"]
    for _ in range(2):
        for text, ids in zip(texts, encoder.encode(texts), strict=True):
            assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_records_round_trip_and_damage(spark):
    path = tokenizer_path("word_bpe_49k.json")
    whole = UnitEncoder(path).tokenizer
    rows = B.encode_to_files(frame(spark, TEXTS), path, 1).orderBy("start", "n_tokens").collect()
    assert len(rows) == len(TEXTS)
    keys = [r["key"] for r in rows]
    assert keys == sorted(keys, key=lambda k: (k is not None, k))
    start = 0
    for r in rows:
        ids = whole.encode(TEXTS[3 if r["key"] is None else r["key"]] or "", add_special_tokens=False).ids + [1]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
        content = open(r["path"].removeprefix("file:"), "rb").read()[r["offset"] : r["offset"] + r["length"]]
        assert next(B.records(content))[3].tolist() == ids
        broken = bytearray(content)
        broken[len(broken) // 2] ^= 1
        with pytest.raises(ValueError):
            list(B.records(bytes(broken)))


def test_empty_table(spark):
    empty = frame(spark, TEXTS).limit(0)
    path = tokenizer_path("word_bpe_49k.json")
    assert B.encode_to_files(empty, path, 1).count() == 0
    assert P.pack_documents(empty, path, 1, 1024).count() == 0


def test_packing_is_whole_and_gapless(spark):
    path = tokenizer_path("byte_bpe_50k.json")
    whole = UnitEncoder(path).tokenizer
    rows = P.pack_documents(frame(spark, TEXTS * 7), path, 2, 64).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for doc, pieces in by_doc.items():
        if doc is None:
            continue
        ids = whole.encode((TEXTS * 7)[doc] or "", add_special_tokens=False).ids + [2]
        pieces.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces)))
        at = 0
        for r in pieces:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids) and (len(pieces) == 1 if len(ids) <= 64 else all(r["length"] == 64 for r in pieces[1:]))
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    total = sum(r["length"] for r in rows)
    assert len(by_sequence) <= 1.12 * total / 64 + 1


def test_sweeps_equal_best_fit_of_single_pieces():
    rng = np.random.default_rng(5)
    for capacity in (10, 37, 100):
        sizes = sorted(rng.integers(1, capacity + 1, 400).tolist(), reverse=True)
        bins: list[int] = []
        for s in sizes:
            fit = [g for g in bins if g >= s]
            if fit:
                bins[bins.index(min(fit))] -= s
            else:
                bins.append(capacity - s)
        counts = {s: sizes.count(s) for s in set(sizes)}
        rows = P.sweep_lengths(counts, capacity)
        assert len({first + i // each for _, lo, hi, each, first, _ in rows for i in range(hi - lo + 1)}) == len(bins)
        for s, n in counts.items():
            assert sorted(r for x in rows if x[0] == s for r in range(x[1], x[2] + 1)) == list(range(n))
