"""A corpus from documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; run() writes each stage's rows as Parquet in the
shared folder and reads them again for the next. Null texts are rejected by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackmill.llm import decontamination, jaccard_join, language_id, packing, secrets
from trackmill.llm.tokens import tokenizer_path
from trackmill.shared import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or of no learned language clearly, go. The model is fitted on documents' own lang."""
    return language_id.in_known_language(docs.select(*COLUMNS), language_id.fit(docs))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 over five-word shingles, the one with the smallest doc_id stays."""
    return jaccard_join.one_of_each(docs, 5, 80, 100).select(*COLUMNS)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 0.8 of a benchmark item's five-word shingles, or an item of three or four words whole, go."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), least_words=3).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; all documents stay, and n_chars follows the text."""
    return secrets.redact_secrets(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens: a row for each piece of a document."""
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), 2, 1024)


STAGES = [
    ("language_id", keep_known_languages),
    ("ngram_jaccard_join", keep_one_of_each),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("secret_scans", redact_secrets),
    ("best_fit_packing", pack),
]
#: SQL has no tokenizer, language model or forest; the run is tested against a plain version on a small fixture.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
