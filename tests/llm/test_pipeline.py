"""The pipeline on a small fixture against what each rule says by hand."""

import random
import zlib

import numpy as np

from trackmill.llm.tokens import tokenizer_path


def test_run_keeps_and_drops(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    rng = random.Random(1)
    vocabulary = {"en": "the of and retion ing that with for".split(), "de": "der die und ein mit von ist schön".split()}
    text = lambda lang, n: " ".join(rng.choice(vocabulary[lang]) + rng.choice(["", "a", "e", "o", "u"]) + rng.choice(["", "n", "r", "st"]) for _ in range(n))
    rows = [[i, text("en" if i % 3 else "de", 80), "en" if i % 3 else "de"] for i in range(60)]
    item = text("en", 30)
    rows[10][1] += " " + item
    rows[20][1] = rows[5][1]
    words = rows[7][1].split()
    words[40] = "changed"
    rows[21][1] = " ".join(words)
    hexed = ["".join(rng.choice("0123456789abcdef") for _ in range(32)) for _ in range(12)]
    for i, h in enumerate(hexed):
        rows[30 + i][1] += f" password={h} the"
        rows[45 + i][1] += f" {rng.randrange(10**15, 10**16)} the"
    rows += [[100, None, "en"], [101, "12 34 56", None], [102, "", "de"]]
    docs = spark.createDataFrame([(i, t, x, "src1", len(t or "")) for i, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {i: t for i, t, _ in rows if i not in (10, 20, 21, 100, 101, 102)}
    for i, h in enumerate(hexed):
        want[30 + i] = want[30 + i].replace(h, "<secret>")
    tokenizer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} == set(want)
    for r in got:
        ids = np.array(tokenizer.encode(want[r["doc_id"]], add_special_tokens=False).ids + [2], "<u4")
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
