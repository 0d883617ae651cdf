"""Bulk-synchronous best-fit packing of token sequences.

Pieces (documents, and the parts of those that are longer than a sequence) are sorted by length, each length
having its pieces in rank order; gaps of open sequences are sorted by size. A sweep takes the pieces of one
length together, from the longest length down, and matches them with their successors among the gaps: the
smallest that hold them. Where more pieces have the same successor than there are gaps of it, ranks decide:
the first ranks take it and the rest go on to the next gap, at last to new sequences. Gaps are updated and
the next sweep begins. That is best fit with decreasing lengths, done in bulk.

All pieces of a length are alike to a sweep, so sweeps run on runs (length, ranks; gap, sequences): at most one
run of pieces for each length up to the capacity, whatever the number of documents. Spark counts the lengths,
ranks the pieces (in salted groups, as one length may hold a third of all) and joins them to the intervals of
ranks that the sweeps hand out.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackmill.llm.tokens import encoder as shared_encoder
from trackmill.llm.tokens import slices, small_batches
from trackmill.shared import materialize


def sweep_lengths(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit over runs: rows (length, first rank, last rank, pieces for each sequence, first sequence, offset there).

    A piece of the row's ranks, being the i-th of them, goes to sequence first + i // pieces at offset + (i % pieces) * length.
    """
    gaps: list[int] = []  # sorted sizes of open gaps
    runs: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, number of sequences)
    opened = 0
    out = []

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in runs:
                bisect.insort(gaps, gap)
                runs[gap] = []
            runs[gap].append((first, n))

    for length in sorted((x for x in counts if x > 0), reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                first, n = runs[gap].pop()
                if not runs[gap]:
                    del runs[gap], gaps[at]
            else:
                gap, first = capacity, opened
                n = -(-left // (capacity // length))
                opened += n
            each = gap // length
            full = min(n, left // each)
            if full:
                out.append((length, rank, rank + full * each - 1, each, first, capacity - gap))
                leave(gap - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n:
                if left and left < each:
                    out.append((length, rank, rank + left - 1, left, first + full, capacity - gap))
                    leave(gap - left * length, first + full, 1)
                    rank, left, full = rank + left, 0, full + 1
                leave(gap, first + full, n - full)
    return out


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Piece lengths of a document of n tokens: only a longer one is cut, the shorter piece first."""
    if n <= capacity:
        return [n]
    head = n % capacity
    return ([head] if head else []) + [capacity] * (n // capacity)


def pieces_of(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece: key, piece, start, length, ids_crc32. Null texts count as empty, and have the end id alone."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(tokenizer)
        last = np.array([end_id], "<u4")
        for batch in slices(batches):
            columns: list[list[int | None]] = [[] for _ in range(5)]
            for k, ids in zip(batch.column("key").to_pylist(), encoder.encode(batch.column("text").to_pylist()), strict=True):
                ids, start = np.concatenate([ids.astype("<u4"), last]), 0
                for i, length in enumerate(cut_lengths(len(ids), capacity)):
                    for c, v in zip(columns, (k, i, start, length, zlib.crc32(ids[start : start + length].data)), strict=True):
                        c.append(v)
                    start += length
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["key", "piece", "start", "length", "ids_crc32"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(cut, "key long, piece long, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int, order: list[str]) -> DataFrame:
    """Add sequence_id and offset to pieces with a length from 1 to capacity; order: columns that rank pieces of a length.

    pieces has to be a written table, or else ranks could change when a lost task runs again.
    """
    spark = pieces.sparkSession
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    groups = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))  # capacity x salts rows at most
    ahead = Window.partitionBy("length").orderBy("salt")
    offsets = groups.select("length", "salt", (F.sum("n").over(ahead) - F.col("n")).alias("ahead"))
    counts = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy(*order)) - 1).join(offsets, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("ahead")).drop("salt", "ahead")
    rows: dict[int, list] = {}
    for length, lo, _, each, first, offset in sweep_lengths(counts, capacity):
        rows.setdefault(length, []).append((lo, each, first, offset))
    # One row for each length, with its intervals in order of rank.
    plan = spark.createDataFrame([(length, sorted(x)) for length, x in rows.items()], "length long, runs array<struct<lo: long, each: long, first: long, offset: long>>")
    run = F.element_at(F.filter("runs", lambda r: r["lo"] <= F.col("rank")), -1)
    placed = ranked.join(plan, "length").withColumn("run", run)
    i = F.col("rank") - F.col("run.lo")
    return placed.select(*pieces.columns, (F.col("run.first") + F.floor(i / F.col("run.each"))).cast("long").alias("sequence_id"), (F.col("run.offset") + F.pmod(i, F.col("run.each")) * F.col("length")).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode, cut and pack all documents: key, piece, start, length, ids_crc32, sequence_id, offset.

    Repeated rows are packed each; an empty table gives none.
    """
    pieces = materialize(pieces_of(docs, tokenizer, end_id, capacity, key, text), "pieces")
    packed = pack(pieces, capacity, ["key", "piece", "start", "ids_crc32"])
    return packed.select(F.col("key").alias(key), F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", "sequence_id", "offset")
