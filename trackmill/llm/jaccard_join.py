"""Exact Jaccard self-join of word-shingle sets by partitions of their universe.

Two sets with Jaccard similarity of num/den or more differ in at most H elements, and H follows from their
sizes. Sets are banded by size so that a partner lies in the same band or the next; at each band the hashed
universe is cut into segments, and sets that differ in at most H elements agree on one of H + 1 segments. A
segment that is indexed with its one-deletion neighbourhood as well (itself, and itself without any one
element) finds sets that differ there by one element, and so counts twice: half as many segments are enough.
A cost model picks the one or the other for each band: deletions cost rows to shuffle, and small segments are
alike in unlike sets more often, which costs comparisons inside groups.

Sets that are equal are one class, found by their digest. In a group of classes that share a segment, all are
verified against the one that shares most (so a group of n near copies costs n verifications). In groups that then
hold classes of several components, all pairs of different components are compared by sketches, in blocks. Classes
that have a pair left open there are compared again by sketches of many more bits, which near misses do not pass, and
what these leave open is verified. So no link between components is lost.

Before texts are moved, pairs are compared by sketches: bit i of a set's sketch is the parity of its elements
that hash to i, so two sketches differ in no more bits than the sets do in elements, and a pair whose sketches
differ in more than a link allows is none.

Shingles are 64-bit hashes; similarity is counted on whole sets of them.
"""

from __future__ import annotations

import ctypes
import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackmill.llm.hashing import mix, shingle_sets
from trackmill.llm.tokens import slices, small_batches
from trackmill.operators.graph import connected_components
from trackmill.shared import materialize

U = np.uint64
SEGMENT, LEVEL = U(0x9FB21C651E98DF25), U(0xA24BAED4963EE407)
#: Rows of a block of a group.
BLOCK = 256
#: Bits of a sketch, and of a fine one, for each element in which partners can differ, at least.
COARSE, FINE = 3, 32
#: Cost in indexed rows of a pair that is shuffled, and of one that is compared where its group is. An indexed row is shuffled, and so are pairs with a group's pivot, of which each indexed row makes one at most.
PAIR_COST, COMPARED_COST = 3.0, 0.003
#: Probability that two unlike sets' single elements of a segment are one: lines and passages that many texts share.
COMMON = 1e-3


def relieved(parts: Iterable) -> Iterator:
    """parts one after the other; what was freed on the way is given back to the system, as a worker goes on with other tasks."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    for part in parts:
        yield part
        pa.default_memory_pool().release_unused()
        if trim:
            trim(0)


def bands(largest: int, num: int, den: int) -> list[tuple[int, int]]:
    """Size bands (smallest, largest): a set of a band has all its smaller partners there or in the band before."""
    out, low = [], 1
    while low <= largest:
        high = low * den // num
        out.append((low, high))
        low = high + 1
    return out


def most_differing(band: tuple[int, int], num: int, den: int) -> int:
    """Elements in which a set of the band and a partner of its size or larger differ, at most."""
    high = band[1]
    return (high + high * den // num) * (den - num) // (den + num)


def allocate(band: tuple[int, int], sets: int, num: int, den: int) -> tuple[int, int, int]:
    """Segments m, whether they get one-deletion neighbourhoods (k = m, else 0), and the empty ones e to allow for; (0, 0, 0) where only equal sets link.

    Empty segments say nothing, so they are not indexed where k is 0: with H + 1 + e segments, two sets of which one
    has e empty segments at most still agree on one that is not. Sets with more of them get a signature that they
    share; e is large enough for a few such sets at most to be expected.
    """
    h = most_differing(band, num, den)
    if not h:
        return 0, 0, 0
    size = (band[0] + band[1]) / 2
    pairs = (h + 2) // 2
    best = pairs + size, pairs, pairs, 0
    for e in range(0, 40):
        m = h + 1 + e
        each = size / m
        mean = m * math.exp(-band[0] / m)
        below = term = math.exp(-mean)
        for i in range(1, e + 1):
            term *= mean / i
            below += term
        single = each * math.exp(-each)
        cost = m + sets / 2 * (PAIR_COST * max(0.0, 1 - below) ** 2 + COMPARED_COST * COMMON * m * single * single)
        best = min(best, (cost, m, 0, e))
    return best[1:]


def signatures(values: np.ndarray, level: int, m: int, k: int, e: int) -> np.ndarray:
    """Hashes of a set's segments at a level: see allocate."""
    if not m:
        return np.zeros(0, np.uint64)
    segment = (((mix(values ^ LEVEL) >> U(32)) * U(m)) >> U(32)).astype(np.int64)
    sums = np.zeros(m, np.uint64)
    own = mix(values)
    np.add.at(sums, segment, own)
    salt = mix((np.arange(m, dtype=np.uint64) + U(level << 32)) * SEGMENT)
    if k:
        return np.unique(np.concatenate([mix(sums + salt), mix(sums[segment] - own + salt[segment])]))
    full = np.bincount(segment, minlength=m) > 0
    out = mix(sums[full] + salt[full])
    return out if full.sum() >= m - e else np.append(out, mix(np.array([level], np.uint64) * LEVEL))


def sketch(values: np.ndarray, num: int, den: int, least: int = COARSE) -> np.ndarray:
    """Parities of a set's elements by hash: a power of two of bits, 512 at least and least times the elements that a partner can differ in."""
    bits = 512
    while bits < least * most_differing((len(values), len(values)), num, den):
        bits *= 2
    odd = np.bincount((mix(values ^ SEGMENT) >> U(16)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def sketches_differ(a: np.ndarray, b: np.ndarray) -> int:
    """Bits in which two sketches differ; the longer one is folded."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) > len(a):
        b = np.bitwise_xor.reduce(b.reshape(-1, len(a)), 0)
    return int(np.bitwise_count((a ^ b).view(np.uint64)).sum())


def set_rows(docs: DataFrame, size: int, num: int, den: int, key: str, text: str) -> DataFrame:
    """Rows (key, mark, n, digest, sketch, fine) of docs' shingle sets; digest and sketches are null where the set is empty. mark: a hash of key and text."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in relieved(slices(batches)):
            sets = list(shingle_sets(batch.column("text").to_pylist(), size))
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            sketches = [pa.array([sketch(s, num, den, least) if len(s) else None for s in sets], pa.list_(pa.int64())) for least in (COARSE, FINE)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("mark"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), *sketches], ["key", "mark", "n", "digest", "sketch", "fine"])

    return marked(docs, key, text).mapInArrow(digest, "key long, mark long, n long, digest binary, sketch array<long>, fine array<long>")


def marked(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, mark, text). The mark tells rows apart that share a key, null too; rows alike in key and text share it."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return rows.select("key", F.xxhash64("key", "text").alias("mark"), "text")


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys, of any number of batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        values = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in keys], 1)
        cuts = np.flatnonzero((values[1:] != values[:-1]).any(1)) + 1
        if held and tuple(values[0]) != last:
            yield pa.Table.from_batches(held)
            held = []
        begin = 0
        for cut in cuts.tolist():
            yield pa.Table.from_batches([*held, batch.slice(begin, cut - begin)])
            held, begin = [], cut
        held.append(batch.slice(begin))
        last = tuple(values[-1])
    if held:
        yield pa.Table.from_batches(held)


class JaccardJoin:
    """The join of one table. rows: (key, mark, n, digest, sketch, fine); classes: (digest, cid, key, mark, n, sketch), of the row with the smallest key (null last)."""

    def __init__(self, docs: DataFrame, size: int, num: int, den: int, key: str = "doc_id", text: str = "text"):
        self.spark, self.size, self.num, self.den = docs.sparkSession, size, num, den
        small_batches(self.spark)
        self.docs = marked(docs, key, text).drop("key")
        self.rows = materialize(set_rows(docs, size, num, den, key, text), "jaccard-rows")
        classes = self.rows.where("n > 0").groupBy("digest").agg(F.min(F.struct(F.col("key").isNull().alias("null"), "key", "mark")).alias("own"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
        classes = classes.select("digest", "own.key", "own.mark", "n", "sketch")
        self.classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "jaccard-classes")

    def _plan(self) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """First size of each band, and each band's allocation; there are as many bands as the logarithm of the largest size."""
        largest = self.classes.agg(F.max("n")).first()[0] or 0
        limits = bands(largest, self.num, self.den)
        lows = [b[0] for b in limits]
        of = F.expr(f"size(filter(array({', '.join(map(str, lows)) or '0'}), x -> x <= n))")
        counts = {r["band"] - 1: r["count"] for r in self.classes.groupBy(of.alias("band")).count().collect()}
        return np.array(lows), [allocate(b, counts.get(i, 0) + counts.get(i + 1, 0), self.num, self.den) for i, b in enumerate(limits)]

    def groups(self) -> DataFrame:
        """Rows (sig, cid): classes that share a signature with another class."""
        size, (lows, plan) = self.size, self._plan()

        def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in relieved(slices(batches)):
                sigs, cids, held = [], [], 0
                wanted = batch.column("digest").to_pylist()
                for cid, want, values in zip(batch.column("cid").to_pylist(), wanted, shingle_sets(batch.column("text").to_pylist(), size), strict=True):
                    if not len(values) or hashlib.blake2b(values.tobytes(), digest_size=16).digest() != want:
                        continue  # another text with the same mark
                    band = int(np.searchsorted(lows, len(values), "right")) - 1
                    for level in {band, max(band - 1, 0)}:
                        s = signatures(values, level, *plan[level])
                        sigs.append(s)
                        cids.append(np.full(len(s), cid, np.int64))
                        held += len(s)
                    if held > 200_000:
                        yield rows(sigs, cids)
                        sigs, cids, held = [], [], 0
                if held:
                    yield rows(sigs, cids)

        def rows(sigs: list[np.ndarray], cids: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(cids))], ["sig", "cid"])

        texts = self.docs.join(self.classes.select("mark", "cid", "digest"), "mark").select("cid", "digest", "text")
        group = Window.partitionBy("sig").orderBy("cid")
        found = texts.mapInArrow(index, "sig long, cid long").withColumns({"first": F.first("cid").over(group), "next": F.lead("cid").over(group)})
        return materialize(found.where("cid != first or next is not null").select("sig", "cid"), "jaccard-groups")

    def _pairs_with(self, pairs: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
        left, right = (table.select(*(F.col(c).alias(f"{c}_{s}") for c in ["cid", *columns])) for s in "ab")
        return pairs.join(right, pairs["b"] == right["cid_b"]).join(left, pairs["a"] == left["cid_a"])

    def plausible(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b) of classes, those that sizes and sketches do not rule out."""
        num, den = self.num, self.den

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in relieved(batches):
                allowed = (batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()) * (den - num) // (den + num)
                sides = []
                for c in ("sketch_a", "sketch_b"):
                    column = batch.column(c)
                    flat, at = column.values.to_numpy(), column.offsets.to_numpy()
                    sides.append([flat[x:y] for x, y in zip(at[:-1], at[1:], strict=True)])
                mask = pa.array([sketches_differ(x, y) <= h for x, y, h in zip(*sides, allowed.tolist(), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

        close = F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num
        sketched = self._pairs_with(pairs, self.classes, ["n", "sketch"]).where(close)
        return sketched.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(compare, "a long, b long")

    def verified(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """Of distinct pairs (a, b) of classes, those that link. texts: (cid, text)."""
        size, num, den = self.size, self.num, self.den

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last: dict[int, np.ndarray] = {}
            for batch in relieved(part for whole in slices(batches, "text_a") for part in slices([whole], "text_b")):
                a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
                sets = dict(last)
                need: dict[int, str] = {}
                for ids, column in ((a, "text_a"), (b, "text_b")):
                    values = batch.column(column)
                    for i, x in enumerate(ids):
                        if x not in sets and x not in need:
                            need[x] = values[i].as_py()
                sets.update(zip(need, shingle_sets(list(need.values()), size), strict=True))
                keep = []
                for x, y in zip(a, b, strict=True):
                    s, t = sets[x], sets[y]
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    keep.append(den * both >= num * (len(s) + len(t) - both))
                last = {a[-1]: sets[a[-1]]} if a else {}
                mask = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

        return self._pairs_with(pairs, texts, ["text"]).select("a", "b", "text_a", "text_b").mapInArrow(verify, "a long, b long")

    def links(self) -> tuple[DataFrame, DataFrame]:
        """Verified links (a, b) between classes and the components (node, component) that they make."""
        entries = self.groups()
        # A text that others were made from shares most with them: it is their groups' pivot.
        shares = entries.groupBy("cid").agg(F.count("*").alias("shares"))
        pivots = entries.join(shares, "cid").groupBy("sig").agg(F.max_by("cid", F.struct("shares", -F.col("cid"))).alias("pivot"))
        pairs = entries.join(pivots, "sig").where("cid != pivot").select(F.least("cid", "pivot").alias("a"), F.greatest("cid", "pivot").alias("b")).distinct()
        found = self._verified_links(pairs)
        labels = materialize(connected_components(found, "a", "b"), "jaccard-labels")
        rest = self._rest(entries, labels)
        if rest is not None:
            found = found.unionByName(self._verified_links(rest))
            labels = materialize(connected_components(found, "a", "b"), "jaccard-labels")
        return found, labels

    def _verified_links(self, pairs: DataFrame) -> DataFrame:
        likely = materialize(self.plausible(pairs), "jaccard-likely")
        ends = likely.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
        return materialize(self.verified(likely, self._texts(self.classes.join(ends, "cid", "left_semi"))), "jaccard-links")

    def _texts(self, named: DataFrame) -> DataFrame:
        """Rows (cid, text): a text of each class named."""
        size = self.size

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in relieved(slices(batches)):
                sets = shingle_sets(batch.column("text").to_pylist(), size)
                keep = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() == d for s, d in zip(sets, batch.column("digest").to_pylist(), strict=True)]
                yield batch.filter(pa.array(keep, pa.bool_()))

        found = self.docs.join(named.select("mark", "cid", "digest"), "mark").select("cid", "digest", "text").mapInArrow(own, "cid long, digest binary, text string")
        return materialize(found.groupBy("cid").agg(F.min("text").alias("text")), "jaccard-texts")

    def _rest(self, entries: DataFrame, labels: DataFrame) -> DataFrame | None:
        """Distinct pairs to verify of groups whose classes are not of one component. None if there are no such groups.

        Groups of the same classes are gone through once. A group is dealt into blocks of BLOCK rows; each two blocks
        meet in one task, which compares all their sketches at once and returns the classes that have a pair of different
        components left open, not the pairs: near misses are as many as the square of a group. These classes
        meet again with fine sketches.
        """
        known = labels.select(F.col("node").alias("cid"), F.col("component").alias("label"))
        named = entries.join(known, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
        members = [F.bit_xor(F.xxhash64("cid", F.lit(i))).alias(f"members_{i}") for i in (0, 1)]
        split = named.groupBy("sig").agg(F.count("*").alias("size"), F.min("label").alias("lo"), F.max("label").alias("hi"), *members).where("lo != hi")
        split = split.groupBy("size", "members_0", "members_1").agg(F.min("sig").alias("sig"))
        split = materialize(split.select("sig", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "jaccard-split")
        if split.isEmpty():
            return None
        own = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
        inside = named.join(split, "sig").join(self.classes.select("cid", "n", "sketch"), "cid").withColumn("own", own)
        met = inside.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        met = met.select("sig", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cid", "label", "n", "sketch")
        schema = "sig long, i int, j int, own int, cid long, label long, n long"
        left = materialize(self._open(met, schema, False), "jaccard-open")
        wanted = self.classes.join(left.select("cid").distinct(), "cid", "left_semi").select("mark", "digest", "cid")
        fine = self.rows.select("mark", "digest", "fine").join(wanted, ["mark", "digest"]).groupBy("cid").agg(F.first("fine").alias("sketch"))
        return materialize(self._open(left.join(fine, "cid"), "a long, b long", True).distinct(), "jaccard-pairs")

    def _open(self, met: DataFrame, schema: str, pairs: bool) -> DataFrame:
        """Of blocks that meet (sig, i, j), what sketches and sizes leave open between components: pairs (a, b), or the rows that have one."""
        num, den = self.num, self.den

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: list[np.ndarray] = []
            for group in runs(batches, ["sig", "i", "j"]):
                cid, label, n, own = (group.column(c).to_numpy() for c in ("cid", "label", "n", "own"))
                # Rows of one block meet where it meets itself.
                across = group.column("i")[0] != group.column("j")[0]
                column = group.column("sketch").combine_chunks()
                flat, at = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()
                width = int(np.diff(at).min())
                folded = np.stack([np.bitwise_xor.reduce(flat[x:y].reshape(-1, width), 0) for x, y in zip(at[:-1], at[1:], strict=True)])
                has = np.zeros(len(cid), bool)
                out: list[np.ndarray] = []
                for x in range(len(cid) - 1):
                    y = np.arange(x + 1, len(cid))
                    y = y[(label[y] != label[x]) & (np.minimum(n[y], n[x]) * den >= np.maximum(n[y], n[x]) * num)]
                    if across:
                        y = y[own[y] != own[x]]
                    differ = np.bitwise_count(folded[y] ^ folded[x]).sum(1)
                    y = y[differ <= (n[y] + n[x]) * (den - num) // (den + num)]
                    if len(y):
                        has[y] = has[x] = True
                        if pairs:
                            out.append(np.stack([np.minimum(cid[y], cid[x]), np.maximum(cid[y], cid[x])]))
                if pairs and out:
                    seen.append(np.concatenate(out, 1))
                    if sum(o.shape[1] for o in seen) > 100_000:
                        yield of(seen)
                        seen = []
                elif has.any():
                    yield from group.drop_columns(["sketch"]).filter(pa.array(has)).combine_chunks().to_batches()
            if seen:
                yield of(seen)

        def of(seen: list[np.ndarray]) -> pa.RecordBatch:
            a, b = np.unique(np.concatenate(seen, 1), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        columns = ["sig", "i", "j", "own", "cid", "label", "n", "sketch"]
        dealt = met.select(*columns).repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")
        return dealt.mapInArrow(compare, schema)

    def labelled(self) -> DataFrame:
        """Rows (digest, key, mark, label) of classes: label tells their component."""
        _, labels = self.links()
        known = self.classes.join(labels.select(F.col("node").alias("cid"), F.col("component").alias("label")), "cid", "left")
        return known.select("digest", "key", "mark", F.coalesce("label", "cid").alias("label"))

    def components(self) -> DataFrame:
        """Rows (key, n_shingles, component_id), one for each row of docs."""
        known = self.labelled()
        least = known.groupBy("label").agg(F.min("key").alias("component_id"))
        of_class = known.join(least, "label").select("digest", "component_id")
        joined = self.rows.join(of_class, "digest", "left")
        return joined.select("key", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key")).alias("component_id"))


def jaccard_components(docs: DataFrame, size: int, num: int, den: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_shingles, component_id): component_id is the smallest key reachable by links of num/den or more.

    Words are lower-cased (A to Z) runs without ASCII white space; a set holds the distinct runs of size words,
    or the whole sequence where there are fewer. Empty and null texts have no set and stay alone. Repeated rows
    are in one component, each with its own row. Rows with a null key link as all others do, but a null key is never
    the smallest; a component of such rows alone is null. Texts are read whole, other columns are not.
    """
    return JaccardJoin(docs, size, num, den, key, text).components().withColumnRenamed("key", key)


def one_of_each(docs: DataFrame, size: int, num: int, den: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without those that have another in their component: the row with the smallest key (null last) stays.

    Rows are told apart by key and text: unlinked texts that share a key all stay, and so do all rows without words.
    Of kept rows alike in key and text, the one whose other columns are smallest stays.
    """
    join = JaccardJoin(docs, size, num, den, key, text)
    classes = materialize(join.labelled(), "jaccard-labelled")
    own = F.min(F.struct(F.col("key").isNull().alias("null"), "key", "mark"))
    kept = classes.groupBy("label").agg(own["mark"].alias("kept"))
    of_class = classes.join(kept, "label").select("digest", "kept")
    rows = join.rows.where("n > 0").select("digest", "mark")
    gone = rows.join(of_class, "digest").where("mark != kept").select(F.col("mark").alias("__mark")).distinct()
    told = docs.withColumn("__mark", F.xxhash64(F.col(key).cast("long"), F.col(text)))
    left = told.join(gone, "__mark", "left_anti")
    twice = materialize(rows.groupBy("mark").count().where("count > 1").select(F.col("mark").alias("__mark")), "jaccard-repeated")
    if twice.isEmpty():
        return left.select(*docs.columns)
    once = left.join(twice, "__mark", "left_semi").groupBy("__mark").agg(F.min(F.struct(*docs.columns)).alias("__row")).select("__row.*")
    return left.join(twice, "__mark", "left_anti").select(*docs.columns).unionByName(once)
