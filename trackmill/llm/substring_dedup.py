"""Repeated passages, by sliding spans of consecutive sentences.

A text is cut into sentences at final marks and line ends, and where a run without them is long after words chosen
by their hash, so that a passage is cut alike wherever it stands. A span is a run of consecutive sentences with at
least three of them and 24 words; its hash covers its words (runs of ASCII letters, digits and non-ASCII characters,
A to Z in lower case). Spans are joined over all documents by hash. The first place of a hash (smallest key, then
place) stays; sentences that any other place of it covers are removed.

With every_run (the registered query): of any 12 words without a mark the one with the smallest hash ends a sentence,
so that none is longer and shorter ones stay whole. From each sentence on, and back from each, the shortest span is
hashed. That removes what hashing every run would: a run that stands at an earlier place stands there with all its
shortest spans, and these cover it. A passage of over 50 words has a cut in its first and in its last 12 words and
thus three sentences and 28 words between them, so each is caught, but for up to 12 words at an edge that is not a
sentence's.

Without it: words end a sentence by hash % 8 in all sentences, and only the shortest span from each sentence on is
hashed. A passage of 51 words can then hold no whole span, and its last sentences can stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmill.llm.hashing import MARKS, mix, words
from trackmill.llm.tokens import chunks, slices, small_batches
from trackmill.shared import materialize

U = np.uint64
SENTENCES, WORDS, EIGHTH = 3, 24, 8
#: Words without a mark among which one ends a sentence: 51 - 2 * GAP + 1 words are WORDS at least, and more than two sentences.
GAP = 12
_END = np.zeros(256, bool)
_END[list(b".!?\n\r")] = True
CHUNK = 1 << 19


def least_of_windows(value: np.ndarray, run: np.ndarray, gap: int) -> np.ndarray:
    """Which words have the smallest value (the last of equal ones) of any gap consecutive words of a run."""
    chosen = np.zeros(len(value), bool)
    n = len(value) - gap + 1
    if n > 0:
        least, at = value[:n].copy(), np.arange(n)
        for k in range(1, gap):
            lower = value[k : k + n] <= least
            least[lower] = value[k : k + n][lower]
            at[lower] = np.flatnonzero(lower) + k
        chosen[at[run[:n] == run[gap - 1 :]]] = True
    return chosen


def sentence_spans(raw: list[bytes], sentences: int = SENTENCES, least_words: int = WORDS, long_sentence: int = EIGHTH, every_run: bool = True, gap: int = GAP) -> tuple[np.ndarray, ...]:
    """Spans of some texts: text, sentence number, sentences, words, first and end byte, hash; in order."""
    w = words(raw, MARKS)
    n = len(w.hash)
    none = np.zeros(0, np.int64)
    if not n:
        return (none,) * 6 + (np.zeros(0, np.uint64),)
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    base = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])[:-1]
    last = np.ones(n, bool)
    # A word ends its sentence if a final mark stands between it and the next word, or its hash says so.
    marks = np.concatenate([[0], np.cumsum(_END[data])])
    last[:-1] = (w.doc[1:] != w.doc[:-1]) | (marks[base[w.doc[1:]] + w.start[1:]] > marks[base[w.doc[:-1]] + w.end[:-1]])
    if every_run:
        run = np.concatenate([[0], np.cumsum(last)[:-1]])
        last |= least_of_windows(mix(w.hash), run, gap)
    else:
        last[:-1] |= mix(w.hash[:-1]) % U(long_sentence) == 0
    end = np.flatnonzero(last) + 1
    begin = np.concatenate([[0], end[:-1]])
    doc = w.doc[begin]
    # From sentence i: the first sentence j with j - i + 1 >= sentences and enough words.
    number = np.arange(len(begin))
    reach = np.maximum(np.searchsorted(end, begin + least_words), number + sentences - 1)
    inside = reach < len(begin)
    i = np.flatnonzero(inside)
    j = reach[inside]
    if every_run:
        # Back from sentence j: the last such sentence i.
        back = np.minimum(np.searchsorted(begin, end - least_words, "right") - 1, number - sentences + 1)
        more = np.flatnonzero((back >= 0) & (reach[np.maximum(back, 0)] != number))
        i, j = np.concatenate([i, back[more]]), np.concatenate([j, more])
        order = np.lexsort((j, i))
        i, j = i[order], j[order]
    same = doc[i] == doc[j]
    i, j = i[same], j[same]
    # Hash of words begin[i] .. end[j] as differences of a prefix polynomial.
    from trackmill.llm.hashing import powers

    up, down = powers(n + 1)
    sums = np.concatenate([[U(0)], np.cumsum(w.hash * up[:n])])
    value = mix((sums[end[j]] - sums[begin[i]]) * down[begin[i]])
    first = np.searchsorted(doc, doc[i])
    return doc[i], i - first, j - i + 1, end[j] - begin[i], w.start[begin[i]], w.end[end[j] - 1], value


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, text), a null text being empty."""
    return docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text", every_run: bool = True) -> DataFrame:
    """Rows (hash, key, copy, start, stop, words) of all spans; start and stop in bytes of UTF-8, copy a hash of the text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw = [t.encode() for t in batch.column("text").to_pylist()]
            for a, b in chunks(raw, CHUNK):
                doc, _, _, count, start, stop, value = sentence_spans(raw[a:b], every_run=every_run)
                at = pa.array(doc + a)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), batch.column("key").take(at), batch.column("copy").take(at), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32)), pa.array(count.astype(np.int32))], ["hash", "key", "copy", "start", "stop", "words"])

    small_batches(docs.sparkSession)
    rows = _rows(docs, key, text).withColumn("copy", F.xxhash64("text"))
    return rows.mapInArrow(cut, "hash long, key long, copy long, start int, stop int, words int")


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", every_run: bool = True) -> DataFrame:
    """Rows (key, copy, start, stop, words, first_key): every place of a span but its first, which is in first_key.

    The first places come from a pre-aggregated minimum of each hash, so a passage that stands in a third of all
    documents is a row for each task; the join back splits it (AQE).
    """
    places = spans(docs, key, text, every_run)
    place = F.struct("key", "copy", "start")
    firsts = places.groupBy("hash").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = places.join(materialize(firsts, "first-spans"), "hash")
    later = joined.where(~place.eqNullSafe(F.col("first")))
    return later.select("key", "copy", "start", "stop", "words", F.col("first.key").alias("first_key"))


def removed_ranges(docs: DataFrame, key: str = "doc_id", text: str = "text", every_run: bool = True) -> DataFrame:
    """Rows (key, copy, start, stop, spans, first_key): the runs of sentences to remove, overlapping spans joined (in bytes)."""
    from pyspark.sql import Window

    order = Window.partitionBy("key", "copy").orderBy("start", "stop")
    rows = repeated_spans(docs, key, text, every_run)
    fresh = rows.withColumn("over", F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    named = fresh.withColumn("run", F.sum(F.when(F.col("over").isNull() | (F.col("start") > F.col("over")), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return named.groupBy("key", "copy", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").alias("spans"), F.min("first_key").alias("first_key")).drop("run")


def removed(docs: DataFrame, key: str = "doc_id", text: str = "text", every_run: bool = True) -> DataFrame:
    """Rows (key, start, stop, n_spans, first_key), a row for each removed run of sentences, in bytes of UTF-8.

    first_key: the smallest key among the first places of its spans. Null and empty texts have no spans. Rows that
    repeat a key and text are one document here; null keys come before all others. Other columns are not read.
    """
    return removed_ranges(docs, key, text, every_run).select(F.col("key").alias(key), "start", "stop", F.col("spans").alias("n_spans"), F.col("first_key").alias(f"first_{key}"))


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", every_run: bool = True) -> DataFrame:
    """docs with the removed runs of sentences taken out of text; all rows stay, and rows that repeat a key and text lose the same.

    The rest of a text is as it was, white space and marks around the runs included.
    """
    ranges = removed_ranges(docs, key, text, every_run)
    cuts = ranges.groupBy("key", "copy").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("cuts"))
    named = docs.withColumn("__key", F.col(key).cast("long")).withColumn("__copy", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    cuts = cuts.select(F.col("key").alias("__cut_key"), F.col("copy").alias("__cut_copy"), F.col("cuts").alias("__cuts"))
    joined = named.join(cuts, F.col("__key").eqNullSafe(F.col("__cut_key")) & (F.col("__copy") == F.col("__cut_copy")), "left")
    raw = F.col(text).cast("binary")
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.element_at("__cuts", F.greatest(i, F.lit(1)))["stop"])
    pieces = F.transform("__cuts", lambda x, i: F.substring(raw, before(i) + 1, x["start"] - before(i)).cast("string"))
    tail = F.substring(raw, F.element_at("__cuts", -1)["stop"] + 1, F.octet_length(text)).cast("string")
    rest = F.when(F.col("__cuts").isNull(), F.col(text)).otherwise(F.concat(F.array_join(pieces, ""), tail))
    return joined.select(*(rest.alias(c) if c == text else docs[c] for c in docs.columns))
