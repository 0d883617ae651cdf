"""Language identification by words, with backoff to character n-grams.

A model holds, for each language, the log10 relative frequencies of its commonest words and n-grams, and a
penalty for those it lacks. A word that any language knows is scored by its word frequencies; another one by the
mean of its known n-grams of the longest order that has any, from max_order down to single letters, a word being
padded with spaces. A text's language is the one with the best mean over its words; words with no known
part are left out. Words are runs of letters, in lower case.

Scoring runs over many texts at once: words and n-grams are hashed, each distinct word of a chunk is scored
once, and a text's score is the mean over its words.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackmill.llm.hashing import mix, powers
from trackmill.llm.tokens import slices, small_batches
from trackmill.shared import materialize

U = np.uint64
#: Characters of text handled at once; a longer text is handled alone.
CHUNK = 1 << 18
#: Words and n-grams whose counts a task holds while it fits, about.
COUNTED = 1 << 19
#: Labelled documents of each language that a model is fitted on, at most; those with the smallest hash of key are taken.
FIT_DOCUMENTS = 3000
UNKNOWN = "und"
_LETTER = np.zeros(0x110000, bool)
_PAD = 0x110000


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _LETTER.any():
        _LETTER[:] = [chr(c).isalpha() for c in range(0x110000)]
    return _LETTER


@dataclass
class Flat:
    """The words of some texts: text number, hash, and hashes of the n-grams that begin at each padded position."""

    doc: np.ndarray
    word: np.ndarray
    value: np.ndarray  # of each character of the chunk, by code point, with spaces between words
    start: np.ndarray
    end: np.ndarray


def flatten(texts: Sequence[str]) -> Flat:
    lowered = [t.lower() for t in texts]
    data = np.frombuffer(" ".join(["", *lowered, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    begins = 1 + np.concatenate([[0], np.cumsum([len(t) + 1 for t in lowered])])
    inside = letters()[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, end = edge[0::2], edge[1::2]
    value = mix(np.where(inside, data, 32).astype(np.uint64))
    return Flat(np.searchsorted(begins, start, "right") - 1, span_hash(value, start, end), value, start, end)


def span_hash(value: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = powers(len(value) + 1)
    sums = np.concatenate([[U(0)], np.cumsum(value * up[: len(value)])])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def grams(flat: Flat, rows: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """For words (by row) padded with a space on either side: the row number within rows and hash of each n-gram."""
    start, end = flat.start[rows] - 1, flat.end[rows] + 1
    if order == 1:
        start, end = start + 1, end - 1
    count = np.maximum(end - start - order + 1, 0)
    owner = np.repeat(np.arange(len(rows)), count)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + start[owner]
    return owner, span_hash(flat.value, at, at + order)


def summed(hashes: np.ndarray, n: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes and the sums of their numbers; more: hashes and numbers that are added."""
    if more:
        hashes, n = np.concatenate([hashes, more[0]]), np.concatenate([n, more[1]])
    order = np.argsort(hashes)
    hashes, n = hashes[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    return hashes[first], np.add.reduceat(n, first)


@dataclass
class Model:
    """Sorted hashes and, for each language, log10 frequencies; tables[0] has words, tables[n] n-grams of order n."""

    langs: list[str]
    tables: list[tuple[np.ndarray, np.ndarray]]

    def look(self, order: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known, scores = self.tables[order]
        if not len(known):
            return np.zeros(len(hashes), bool), np.zeros((len(hashes), len(self.langs)), np.float32)
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        return known[at] == hashes, scores[at]

    def predict(self, texts: Sequence[str]) -> Iterator[tuple[str, float]]:
        """Language and score from 0 to 1 of each text."""
        begin = size = 0
        for i, t in enumerate(texts):
            if size and size + len(t) > CHUNK:
                yield from self._chunk(texts[begin:i])
                begin, size = i, 0
            size += len(t)
        if begin < len(texts):
            yield from self._chunk(texts[begin:])

    def _chunk(self, texts: Sequence[str]) -> list[tuple[str, float]]:
        flat = flatten(texts)
        n, k = len(texts), len(self.langs)
        if not len(flat.word) or not k:
            return [(UNKNOWN, 0.0)] * n
        words, first, back = np.unique(flat.word, return_index=True, return_inverse=True)
        known, score = self.look(0, words)
        score = np.where(known[:, None], score, 0).astype(np.float64)
        left = np.flatnonzero(~known)
        for order in range(len(self.tables) - 1, 0, -1):
            if not len(left):
                break
            owner, hashes = grams(flat, first[left], order)
            hit, value = self.look(order, hashes)
            owner, value = owner[hit], value[hit]
            count = np.bincount(owner, minlength=len(left))
            some = count > 0
            for j in range(k):
                score[left[some], j] = np.bincount(owner, value[:, j], len(left))[some] / count[some]
            known[left[some]] = True
            left = left[~some]
        use = known[back]
        doc, rows = flat.doc[use], back[use]
        count = np.bincount(doc, minlength=n)
        mean = np.stack([np.bincount(doc, score[rows, j], n) for j in range(k)], 1) / np.maximum(count, 1)[:, None]
        order = np.argsort(-mean, 1, kind="stable")
        best = order[:, 0]
        # The share of the best language if each word were one draw: from 1/k for no difference to 1.
        odds = 10.0 ** np.clip(mean - mean.max(1, keepdims=True), -30, 0)
        share = 1.0 / odds.sum(1)
        letters_in = np.bincount(flat.doc, minlength=n) > 0
        return [((self.langs[b] if c else self.langs[0], float(s) if c else 0.0) if has else (UNKNOWN, 0.0)) for b, s, c, has in zip(best.tolist(), share.tolist(), count.tolist(), letters_in.tolist(), strict=True)]


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", max_order: int = 5, fit_documents: int = FIT_DOCUMENTS) -> Model:
    """Fit on docs with a text and a language: of each language fit_documents, those with the smallest crc32 of key.

    Counts of the sample's words and n-grams are summed by Spark, and all come to the driver: as many rows as the
    sample has distinct ones, whatever the size of docs, and a score of each for each language. Languages that
    share words get a penalty for those they lack: one more than the smallest log frequency.
    """
    spark = docs.sparkSession
    small_batches(spark)
    labelled = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.crc32(F.col(key).cast("string").cast("binary")).alias("turn"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    totals = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not totals:
        return Model([], [(np.zeros(0, np.uint64), np.zeros((0, 0), np.float32))] * (max_order + 1))
    langs = sorted(totals)
    # The crc32 is even, so a threshold gives about as many; the rank below makes it exact.
    share = F.create_map(*[F.lit(x) for lang_n in totals.items() for x in (lang_n[0], int(min(1.0, 1.3 * (fit_documents + 60) / lang_n[1]) * 2**32))])
    near = labelled.where(F.col("turn") <= share[F.col("lang")])
    taken = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("turn", "text"))).where(F.col("rank") <= fit_documents)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
        size = 0
        for batch in slices(batches, limit=2 * CHUNK):
            names, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for name in sorted(set(names)):
                flat = flatten([t for t, x in zip(texts, names, strict=True) if x == name])
                if not len(flat.word):
                    continue
                for order in range(max_order + 1):
                    hashes = flat.word if not order else grams(flat, np.arange(len(flat.word)), order)[1]
                    size -= len(held.get((name, order), [()])[0])
                    held[name, order] = summed(hashes, np.ones(len(hashes), np.int64), *held.get((name, order), ()))
                    size += len(held[name, order][0])
            if size > COUNTED:
                yield from (counted(*k, *v) for k, v in held.items())
                held, size = {}, 0
        yield from (counted(*k, *v) for k, v in held.items())

    def counted(name: str, order: int, values: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([name] * len(values)), pa.array(np.full(len(values), order)), pa.array(values.view(np.int64)), pa.array(n)], ["lang", "order", "hash", "n"])

    counts = taken.select("lang", "text").repartition(spark.sparkContext.defaultParallelism).mapInArrow(count, "lang string, order long, hash long, n long").groupBy("lang", "order", "hash").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "language-counts")
    whole = counts.groupBy("lang", "order").agg(F.sum("n").alias("total"))
    top = counts.join(whole, ["lang", "order"]).select("lang", "order", "hash", "n", "total").toArrow()
    name, at, h, n, total = (top.column(c).to_numpy() for c in ("lang", "order", "hash", "n", "total"))
    place = {x: i for i, x in enumerate(langs)}
    column = np.array([place[x] for x in name], np.int64)
    tables = []
    for order in range(max_order + 1):
        of = at == order
        hashes = h[of].view(np.uint64)
        known = np.unique(hashes)
        logs = np.log10(n[of] / total[of]) if of.any() else np.zeros(0)
        scores = np.full((len(known), len(langs)), (logs.min() if len(logs) else 0) - 1, np.float32)
        scores[np.searchsorted(known, hashes), column[of]] = logs
        tables.append((known, scores))
    return Model(langs, tables)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs' columns but text, with lang_pred and score (in place of any so named). und (score 0): no text, or no letter in it.

    A text whose words have no known part at all gets the first language with score 0, and of languages that fit
    equally well the first in order of name is taken. Texts are read whole, however long; repeated rows are predicted
    each, null keys stay, and an empty model (nothing to learn from) gives und.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample it was fitted on
    others = [c for c in docs.columns if c not in (text, "lang_pred", "score")]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            found = list(shared.value.predict([t or "" for t in batch.column(text).to_pylist()]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], [*others, "lang_pred", "score"])

    schema = docs.select(*others).schema.add("lang_pred", "string").add("score", "double")
    return docs.mapInArrow(predict, schema)


def in_known_language(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """Those of docs whose text is of one of the model's languages with a score of least or more."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            found = shared.value.predict([t or "" for t in batch.column(text).to_pylist()])
            yield batch.filter(pa.array([name != UNKNOWN and score >= least for name, score in found], pa.bool_()))

    return docs.mapInArrow(known, docs.schema)
