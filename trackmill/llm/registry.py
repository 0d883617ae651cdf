"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from trackmill.llm import binary_output, decontamination, jaccard_join, language_id, merkle, neighbours, packing, pii, secrets, spelling, substring_dedup, url_filter, warc
from trackmill.llm.tokens import tokenizer_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    model = language_id.fit(docs.where(~held_out))
    return language_id.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), 2, 1024)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removed(table(spark, sf_dir, "documents"), every_run=True)


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), "id % 20 = 0", 20)


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), least_words=3)
    return found.withColumn("containment", F.col("n_found") / F.col("n_shingles"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents")))


def op9_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = binary_output.encode_to_files(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), 1)
    return index.select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), 4, 85, 100)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tampering_report(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.words_of(table(spark, sf_dir, "documents")))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_report(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "pipeline": corpus_pipeline.run,
    "op1_url_filter": op1_url_filter,
    "op2_language_id": op2_language_id,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_secret_scans": op6_secret_scans,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_pii": op8_pii,
    "op9_binary_output": op9_binary_output,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_warc": op13_warc,
}
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Runs of ASCII letters and digits and of other characters beyond ASCII; runs without ASCII white space.
MARKED, SPACED = r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", r"[^\x20\x09-\x0D]+"
RUNS = "list_distinct(list_transform(range(1, len(w) - {k} + 2), lambda x: array_to_string(w[x:x + {k} - 1], ' ')))"
#: CRC-32 of the bytes in the list {b}, with its table as crc.tab; parts of a leaf.
CRC_TABLE = "SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab"
CRC = "xor(4294967295, list_reduce(list_prepend(4294967295, {b}), lambda c, x: xor(c >> 8, crc.tab[(xor(c, x) & 255) + 1])))"
PART = "coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
LEAF = "sha256(" + " || ".join(PART.format(c=c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
DECIMAL = "list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii((doc_id::VARCHAR)[i])::BIGINT)"
#: UTF-8 bytes of <doc_id>:<run>, where runs hold ASCII and U+00C0 to U+00FF.
KEYED = "flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195, unicode(c)::BIGINT - 64] END))"
SIBLINGS = "coalesce(string_agg(s.digest, '' ORDER BY s.idx) FILTER (s.idx {side} n.idx), '')"
SQL: dict[str, str] = {
    "op11_merkle_manifest": f"""
WITH RECURSIVE crc AS ({CRC_TABLE}),
l AS MATERIALIZED (SELECT *, row_number() OVER () AS id, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM (
  SELECT doc_id, lang, {LEAF.format(text='text')} AS leaf, CASE WHEN {CRC.format(b=DECIMAL)} % 3 = 0 THEN {LEAF.format(text=LOWER)} ELSE {LEAF.format(text='text')} END AS start FROM documents, crc)),
n(lang, level, idx, digest) AS (SELECT lang, 0, idx, leaf FROM l UNION ALL
  SELECT lang, level + 1, idx // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM (SELECT *, count(*) OVER (PARTITION BY lang) AS many FROM n) WHERE many > 1 GROUP BY lang, level, idx // 8),
r AS MATERIALIZED (SELECT lang, arg_max(digest, level) AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx FROM n GROUP BY lang),
m(level, idx, digest) AS (SELECT 0, idx, subroot FROM r UNION ALL
  SELECT level + 1, idx // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM (SELECT *, count(*) OVER () AS many FROM m) WHERE many > 1 GROUP BY level, idx // 8),
a AS (SELECT n.lang, n.level, n.idx, {SIBLINGS.format(side='<')} AS l, {SIBLINGS.format(side='>')} AS r, count(*) AS run FROM n JOIN n s ON n.lang IS NOT DISTINCT FROM s.lang AND n.level = s.level AND n.idx // 8 = s.idx // 8 GROUP BY ALL),
b AS (SELECT n.level, n.idx, {SIBLINGS.format(side='<')} AS l, {SIBLINGS.format(side='>')} AS r FROM m n JOIN m s ON n.level = s.level AND n.idx // 8 = s.idx // 8 GROUP BY ALL),
p AS (SELECT l.id, a.level AS step, a.l, a.r FROM l JOIN a ON l.lang IS NOT DISTINCT FROM a.lang AND a.idx = l.idx // (8 ** a.level)::BIGINT WHERE a.level < (SELECT max(level) FROM n WHERE n.lang IS NOT DISTINCT FROM l.lang)
  UNION ALL SELECT l.id, 100 + b.level, b.l, b.r FROM l JOIN r ON l.lang IS NOT DISTINCT FROM r.lang JOIN b ON b.idx = r.idx // (8 ** b.level)::BIGINT WHERE b.level < (SELECT max(level) FROM m)),
g AS (SELECT l.id, coalesce(list({{'l': p.l, 'r': p.r}} ORDER BY step) FILTER (step IS NOT NULL), []) AS path FROM l LEFT JOIN p USING (id) GROUP BY l.id),
f AS (SELECT doc_id, leaf, subroot, (SELECT arg_max(digest, level) FROM m) AS root, sha256(array_to_string(list_transform(path, lambda x: x.l || x.r), '')) AS proof_sha256,
  list_reduce(list_prepend({{'l': '', 'r': start}}, path), lambda x, y: {{'l': '', 'r': sha256(y.l || x.r || y.r)}}).r AS folded_root FROM l JOIN r ON l.lang IS NOT DISTINCT FROM r.lang JOIN g USING (id))
SELECT *, folded_root = root AS verified FROM f
""",
    "op7_benchmark_decontamination": f"""
WITH i AS (SELECT item_id, regexp_extract_all({LOWER}, '{MARKED}') AS w FROM benchmark),
k AS (SELECT *, CASE WHEN len(w) BETWEEN 3 AND 4 THEN len(w) ELSE 5 END AS size FROM i WHERE len(w) > 0),
s AS (SELECT item_id, size, CASE WHEN len(w) >= size THEN {RUNS.format(k='size')} ELSE ['= ' || array_to_string(w, ' ')] END AS held FROM k),
d AS (SELECT doc_id, regexp_extract_all({LOWER}, '{MARKED}') AS w, size FROM documents CROSS JOIN (SELECT DISTINCT size FROM k)),
e AS (SELECT doc_id, size, unnest(CASE WHEN len(w) >= size THEN {RUNS.format(k='size')} WHEN len(w) > 0 THEN ['= ' || array_to_string(w, ' ')] END) AS h FROM d),
u AS (SELECT item_id, size, len(held) AS n, unnest(held) AS h FROM s),
f AS (SELECT doc_id, item_id, n AS n_shingles, count(*) AS n_found FROM u JOIN e USING (size, h) GROUP BY ALL)
SELECT doc_id, item_id, n_shingles, n_found, n_found / n_shingles AS containment FROM f WHERE 100 * n_found >= 80 * n_shingles
""",
    "op12_spelling_variants": rf"""
WITH RECURSIVE crc AS ({CRC_TABLE}),
o AS (SELECT doc_id, run, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all({LOWER}, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) WHERE length(run) >= 5 GROUP BY ALL),
h AS (SELECT run, c, {CRC.format(b=KEYED)} AS h FROM o, crc),
t AS (SELECT CASE WHEN h % 97 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, c FROM h),
w AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM t WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
i AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
s AS (SELECT word, n, i, substring(word, 1, i - 1) || '*' || substring(word, i + 1) AS held FROM i),
d AS (SELECT DISTINCT i.word, i.n, w.word AS shorter, w.n AS shorter_n FROM i JOIN w ON w.word = substring(i.word, 1, i - 1) || substring(i.word, i + 1)),
e AS (SELECT a.word, b.word AS other, b.n AS m FROM s a JOIN s b ON a.i = b.i AND a.held = b.held AND a.word != b.word
  UNION ALL SELECT word, shorter, shorter_n FROM d UNION ALL SELECT shorter, word, n FROM d),
g AS (SELECT word, count(*) AS n_near, list({{'other': other, 'm': m}} ORDER BY m DESC, other)[1] AS best FROM e GROUP BY word),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.m >= 2 * w.n THEN best.other END AS form, CASE WHEN best.m >= 2 * w.n THEN best.m END AS form_n FROM w LEFT JOIN g USING (word)),
z(word, place) AS (SELECT word, word FROM f UNION ALL SELECT z.word, f.form FROM z JOIN f ON f.word = z.place WHERE f.form IS NOT NULL)
SELECT f.*, z.place AS root FROM f JOIN z USING (word) JOIN f AS last ON last.word = z.place WHERE last.form IS NULL
""",
    "op13_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM p LEFT JOIN f USING (payload_digest)
""",
    "op10_ngram_jaccard_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({LOWER}, '{SPACED}'), []) AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) >= 4 THEN {RUNS.format(k='4')} WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS held FROM d),
e AS MATERIALIZED (SELECT doc_id, len(held) AS n, unnest(held) AS h FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n - count(*) AS whole, count(*) AS met FROM e a JOIN e b ON a.h = b.h AND a.doc_id != b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n),
l AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * met >= 85 * whole),
z(node, other) AS (SELECT a, b FROM l UNION SELECT z.node, l.b FROM z JOIN l ON l.a = z.other)
SELECT s.doc_id, len(held)::BIGINT AS n_shingles, least(s.doc_id, min(z.other)) AS component_id FROM s LEFT JOIN z ON z.node = s.doc_id GROUP BY s.doc_id, held
""",
    "op5_nearest_neighbours": """
WITH e AS (
  SELECT vec_id, embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x != 0)) > 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score
  FROM e q JOIN e c ON q.vec_id % 20 = 0 AND c.vec_id != q.vec_id AND len(c.embedding) = len(q.embedding)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
