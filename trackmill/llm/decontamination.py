"""Benchmark items inside documents, by size-partitioned MinHash containment.

Items are partitioned by their number of shingles (bands of a power of two) and by the words of a shingle. A document
that holds a share t of an item's n shingles holds one at least of the n - ceil(t n) + 1 of them with the smallest
hashes; a partition's sketches have as many as its largest item needs, so no pair that reaches t is lost, however long
the document. All shingles of all documents probe the sketches of each partition; pairs that meet are verified by
counting the item's distinct shingles that the document holds.

Words are lower-cased (A to Z) runs of ASCII letters and digits and of non-ASCII characters. An item with fewer words
than a shingle, but least_words or more, is one shingle of its own length and is found wherever its words stand in a
row; one with still fewer (the word "yes" is no leak wherever it stands) matches equal texts only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmill.llm.hashing import CHUNK, MARKS, shingles, words
from trackmill.llm.tokens import chunks, slices, small_batches
from trackmill.shared import materialize

#: Shingles of all items that may be sent to every executor (8 bytes each, and 8 for the item); more are joined by a shuffle.
BROADCAST_SHINGLES = 2_000_000
FOUND = "key long, item long, n_shingles long, n_found long"


def sketch_length(n: int, num: int, den: int) -> int:
    """Minimum hashes to keep of n shingles, for a containment of num/den."""
    return n - -(-num * n // den) + 1


def largest_of_band(n: int) -> int:
    """The largest size of the partition of items with n shingles."""
    return (1 << n.bit_length()) - 1


def shingle_hashes(texts: list[str | None], sizes: list[int]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Each text's number of words, and its shingle hashes of each size in any order, with repetitions."""
    raw = [(t or "").encode() for t in texts]
    for a, b in chunks(raw, CHUNK):
        found = words(raw[a:b], MARKS)
        parts = []
        for size in sizes:
            doc, value = shingles(found, size)
            if len(doc) and (doc[1:] < doc[:-1]).any():
                order = np.argsort(doc, kind="stable")
                doc, value = doc[order], value[order]
            parts.append((value, np.searchsorted(doc, np.arange(b - a + 1))))
        for i, n in enumerate(np.diff(found.first).tolist()):
            yield n, [value[at[i] : at[i + 1]] for value, at in parts]


def item_shingles(items: DataFrame, size: int, num: int, den: int, least_words: int) -> DataFrame:
    """Rows (id, size, hash, n, sketched) for each distinct shingle of each item. items: (id, text)."""
    sizes = [*range(least_words, size), size]

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            kinds, sets = [], []
            for n, found in shingle_hashes(batch.column("text").to_pylist(), sizes):
                kinds.append(n if least_words <= n < size else size)
                sets.append(np.unique(found[sizes.index(kinds[-1])]))
            counts = np.array([len(s) for s in sets], np.int64)
            # Smallest hashes first, as np.unique has them.
            kept = [np.arange(n) < sketch_length(largest_of_band(n), num, den) for n in counts.tolist()]
            flat = lambda parts, kind: pa.array(np.concatenate([*parts, np.zeros(0, kind)]))
            ids = batch.column("id").take(pa.array(np.repeat(np.arange(len(counts)), counts)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.repeat(np.array(kinds, np.int64), counts)), flat([s.view(np.int64) for s in sets], np.int64), pa.array(np.repeat(counts, counts)), flat(kept, bool)], ["id", "size", "hash", "n", "sketched"])

    return materialize(items.select("id", "text").mapInArrow(explode, "id long, size long, hash long, n long, sketched boolean"), "item-shingles")


def contained_items(docs: DataFrame, items: DataFrame, size: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text", item: str = "item_id", broadcast_shingles: int = BROADCAST_SHINGLES, least_words: int | None = None) -> DataFrame:
    """Rows (key, item, n_shingles, n_found) where a document holds num/den of an item's distinct shingles or more.

    least_words: items with fewer words match equal texts only; size (the default) or less.
    A row for each matching pair of rows: repeated documents and items match each. Null and empty texts match
    nothing. Null keys and items are kept as null. Texts are read whole, other columns are not. Whether the items'
    shingles are sent to all tasks or joined by a shuffle depends on their number; the rows are the same.
    """
    least_words = size if least_words is None else least_words
    small_batches(docs.sparkSession)
    named = materialize(items.select(F.col(item).cast("long").alias("item"), F.col(text).alias("text")).withColumn("id", F.monotonically_increasing_id()), "probe-items")
    shingled = item_shingles(named, size, num, den, least_words)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    few = shingled.limit(broadcast_shingles + 1).count() <= broadcast_shingles
    found = (_by_probe if few else _by_shuffle)(rows, named.select("id", "item"), shingled, num, den)
    return found.select(F.col("key").alias(key), F.col("item").alias(item), "n_shingles", "n_found")


class Partitions:
    """The items' shingles by item, and for each partition (words of a shingle, band of sizes) the sketches of its items."""

    def __init__(self, shingled: pa.Table, names: dict[int, int | None]):
        ids, size, hashes, n, sketched = (shingled.column(c).to_numpy() for c in ("id", "size", "hash", "n", "sketched"))
        hashes = hashes.view(np.uint64)
        self.ids, owner = np.unique(ids, return_inverse=True)
        order = np.lexsort((hashes, owner))
        self.hashes, self.starts = hashes[order], np.searchsorted(owner[order], np.arange(len(self.ids) + 1))
        self.items = [names[i] for i in self.ids.tolist()]
        self.sizes = sorted(set(size.tolist()))
        band = np.array([largest_of_band(x) for x in n.tolist()], np.int64)
        self.sketches: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {k: [] for k in self.sizes}
        for k, top in sorted(set(zip(size.tolist(), band.tolist(), strict=True))):
            of = np.flatnonzero((size == k) & (band == top) & sketched)
            of = of[np.argsort(hashes[of], kind="stable")]
            self.sketches[k].append((hashes[of], owner[of]))

    def candidates(self, size: int, values: np.ndarray) -> np.ndarray:
        """Numbers of the items of which a document with these shingle hashes holds a sketched one."""
        met = []
        for sketch, owner in self.sketches[size]:
            at = np.searchsorted(sketch, values)
            hit = values[sketch[np.minimum(at, len(sketch) - 1)] == values]
            if len(hit):
                hit = np.unique(hit)
                met += [owner[a:b] for a, b in zip(np.searchsorted(sketch, hit, "left"), np.searchsorted(sketch, hit, "right"), strict=True)]
        return np.unique(np.concatenate(met)) if met else np.zeros(0, np.int64)

    def held(self, item: int, values: np.ndarray) -> tuple[int, int]:
        """Shingles of an item, and how many of them are in sorted distinct values."""
        own = self.hashes[self.starts[item] : self.starts[item + 1]]
        at = np.minimum(np.searchsorted(values, own), len(values) - 1)
        return len(own), int((values[at] == own).sum())


def _by_probe(rows: DataFrame, named: DataFrame, shingled: DataFrame, num: int, den: int) -> DataFrame:
    # The number of shingles was checked, and an item with any has one row of them at least.
    table = shingled.toArrow()
    names = {r["id"]: r["item"] for r in named.join(shingled.select("id").distinct(), "id", "left_semi").collect()}
    shared = rows.sparkSession.sparkContext.broadcast(Partitions(table, names))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = shared.value
        for batch in slices(batches):
            out: list[list] = [[] for _ in range(4)]
            keys = batch.column("key")
            for i, (_, found) in enumerate(shingle_hashes(batch.column("text").to_pylist(), parts.sizes)):
                for size, values in zip(parts.sizes, found, strict=True):
                    met = parts.candidates(size, values)
                    if len(met):
                        values = np.unique(values)
                    for j in met.tolist():
                        n, count = parts.held(j, values)
                        if den * count >= num * n:
                            for column, value in zip(out, (keys[i].as_py(), parts.items[j], n, count), strict=True):
                                column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["key", "item", "n_shingles", "n_found"])

    return rows.mapInArrow(probe, FOUND)


def _by_shuffle(rows: DataFrame, named: DataFrame, shingled: DataFrame, num: int, den: int) -> DataFrame:
    """The same by joins on hashes, for any number of items. Rows are told apart by an id given once, in a written table."""
    docs = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "probe-docs")
    sizes = sorted(r["size"] for r in shingled.select("size").distinct().collect())  # as many as a shingle has words, at most

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for i, (_, found) in enumerate(shingle_hashes(batch.column("text").to_pylist(), sizes)):
                for size, values in zip(sizes, found, strict=True):
                    values = np.unique(values)
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column("row")[i].as_py()] * len(values), pa.int64()), pa.array(np.full(len(values), size)), pa.array(values.view(np.int64))], ["row", "size", "hash"])

    shape = "row long, size long, hash long"
    probes = docs.select("row", "text").mapInArrow(explode, shape)
    met = probes.join(shingled.where("sketched").select("id", "size", "hash"), ["size", "hash"]).select("row", "id").distinct()
    met = materialize(met, "probe-pairs")
    again = docs.join(met.select("row").distinct(), "row", "left_semi").select("row", "text").mapInArrow(explode, shape)
    counted = again.join(shingled.select("id", "size", "hash", "n"), ["size", "hash"]).join(met, ["row", "id"]).groupBy("row", "id", "n").agg(F.count("*").alias("n_found"))
    passed = counted.where(F.col("n_found") * den >= F.col("n") * num)
    return passed.join(docs.select("row", "key"), "row").join(named, "id").select("key", "item", F.col("n").alias("n_shingles"), "n_found")


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs without the rows whose text holds an item. Each row is judged by its own text, whatever its key, null too, and whoever shares it."""
    marked = docs.withColumn("__mark", F.xxhash64(text))
    found = contained_items(marked.select("__mark", text), items, key="__mark", text=text, **how)
    return marked.join(found.select("__mark").distinct(), "__mark", "left_anti").select(*docs.columns)
