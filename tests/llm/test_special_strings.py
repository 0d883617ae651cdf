"""Ids are those of a plain tokenizer, also where a text holds the string of a special token; repeated rows have theirs each."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from trackmill.llm import binary_output as B
from trackmill.llm import packing as P
from trackmill.llm.tokens import UnitEncoder, tokenizer_path

TEXTS = ["x <|endoftext|> y", "<|startoftext|><|endoftext|>", "a<|endoftext|>b <|endoftext", "plain words", "  <|ENDOFTEXT|> z", "", "word " * 5000 + "<|endoftext|>" + " word" * 5000]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_special_strings(name):
    plain = Tokenizer.from_file(tokenizer_path(name))
    for text, ids in zip(TEXTS, UnitEncoder(tokenizer_path(name)).encode(TEXTS), strict=True):
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids


def test_queries_with_special_strings_and_repeated_rows(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3])] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    got = B.encode_to_files(docs, tokenizer_path("word_bpe_49k.json"), 1).orderBy("start").collect()
    want = [np.array(plain.encode(t, add_special_tokens=False).ids + [1], "<u4") for _, t in sorted(rows)]
    assert [(r["n_tokens"], r["ids_crc32"]) for r in got] == [(len(w), zlib.crc32(w.tobytes())) for w in want]
    pieces = P.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), 2, 1024).where("doc_id = 3").collect()
    assert len(pieces) == 3 and len({(r["sequence_id"], r["offset"]) for r in pieces}) == 3
