"""Groups of spelling variants: words that differ by one code point lead to the commonest of them.

A word of m code points is cut into segments of at most 4. If two words are one edit apart, the edit lies in one
segment of the longer one and all else is equal, so each word is dealt to a tile for each of its segments by what
is left and right of it: once at its own length, once as the shorter of words that are one longer. Within a tile
words stand in padded matrices of code points (those that can differ), from the left and from the right, and all
pairs of rows are compared at once: where the common prefix and the common suffix together reach the longer length
minus one, the words are one edit apart. The common prefix says where the edit is, and only the tile of that segment counts the
pair, so none is counted twice. Tiles give sums and the best neighbour for each of their words, never pairs. A
tile of many words is cut into blocks by hash, and each pair of blocks is a tile of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackmill.shared import materialize

#: ASCII letters and Latin-1 from U+00C0 on.
LETTERS = "[A-Za-zÀ-ÿ]+"
#: Code points of a segment at most; words of a block, about; rows (or bytes) of groups that a worker handles at once, about.
SEGMENT, BLOCK, ROWS, BYTES = 4, 1024, 1 << 16, 32 << 20
#: Groups of at most this many words are compared together, by diagonals.
SMALL = 12


def words_of(docs: DataFrame, key: str = "doc_id", text: str = "text", drop_one_in: int = 97, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """Words (word, n) of all texts: maximal runs of letters, A-Z lower-cased, with their number of occurrences.

    Where drop_one_in divides the CRC-32 of `<key>:<run>` (a null key reads as empty), the run loses the code
    point at that number modulo its length. Words of fewer than least_length code points or occurrences go. Null
    and empty texts and empty tables have no words; rows of one key count apart.
    """
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.explode(F.regexp_extract_all(lower, F.lit(LETTERS), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("key", F.lit(":"), "run").cast("binary"))
    runs = runs.where(F.length("run") >= least_length).select("run", h.alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % drop_one_in == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    found = runs.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
    return found.where(F.col("n") >= least_count)


def segments(longer: Column) -> Column:
    """Number of segments of a word of that many code points."""
    return F.greatest(F.lit(2), F.ceil(longer / SEGMENT)).cast("int")


def tiles(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows (tile, side, other, mine, word, n, part, long, span, whole): a word of m or m - 1 code points in a tile.

    part: the code points of the tile's segment and the one after it, which is all in which words of a tile can
    differ, unless two of what is left and right share a 64-bit hash. long: of m code points. span: the
    segment's, whole: the part's code points in a word of m. Rows of block `mine` of a large tile are compared in
    the tile (side, other) with those of the other block alone.
    """
    length = F.length("word")
    rows = words.select("word", "n", F.explode(F.array(length, length + 1)).alias("m"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), segments(F.col("m")) - 1)).alias("segment"))
    # Segment i begins at m*i div k in the longer word; in one that is a code point shorter, what follows it begins one earlier.
    k, short = segments(F.col("m")), F.col("m") - length
    begin, end = F.floor(F.col("m") * F.col("segment") / k).cast("int"), F.floor(F.col("m") * (F.col("segment") + 1) / k).cast("int")
    left, right = F.substring("word", F.lit(1), begin), F.substring("word", end + 1 - short, F.col("m"))
    whole = F.least(end + 1, F.col("m")) - begin
    rows = rows.select("word", "n", F.xxhash64("m", "segment", left, right).alias("tile"), F.substring("word", begin + 1, whole - short).alias("part"), (short == 0).alias("long"), (end - begin).alias("span"), whole.alias("whole"))
    many = rows.groupBy("tile").agg(F.count("*").alias("held")).where(F.col("held") > block)
    many = materialize(many.select("tile", F.ceil(F.col("held") / block).cast("int").alias("blocks")), "spelling-blocks")
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    dealt = rows.join(many, "tile", "left").withColumn("mine", F.coalesce(own, F.lit(0)))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    return dealt.select("tile", F.least("mine", "with").alias("side"), F.greatest("mine", "with").alias("other"), "mine", "word", "n", "part", "long", "span", "whole")


def matrix(words: list[str], from_right: bool = False) -> np.ndarray:
    """Code points of words, a row each, padded with 0; from_right: the last code point first."""
    wide = max(map(len, words))
    cells = "".join((w[::-1] if from_right else w).ljust(wide, "\0") for w in words)
    points = np.frombuffer(cells.encode("utf-32-le"), np.uint32).reshape(len(words), wide)
    return points.astype(np.uint8) if points.max() < 256 else points


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common start of each row of a and each of b (broadcast over all but the last axis)."""
    alive, out = None, None
    for j in range(a.shape[-1]):
        same = a[..., j] == b[..., j]
        alive = same if alive is None else alive & same
        if not alive.any():
            break
        out = alive.astype(np.uint16) if out is None else out + alive
    return np.zeros(np.broadcast_shapes(a.shape[:-1], b.shape[:-1]), np.uint16) if out is None else out


def one_edit(left_a, left_b, right_a, right_b, long_a, long_b, span, whole) -> np.ndarray:
    """Which pairs of rows are one edit apart, with the edit in the tile's segment."""
    prefix = common(left_a, left_b)
    return (long_a | long_b) & (prefix < span) & (prefix + common(right_a, right_b) >= whole - 1)


def compared(group: np.ndarray, within: np.ndarray, mine: np.ndarray, words: list[str], n: np.ndarray, parts: list[str], long: np.ndarray, span: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of whole groups: number of near rows, and the row of the best of them (-1: none).

    group numbers the groups and ascends; within: all rows of the group are compared, else those of one block with those of the other.
    """
    rows = len(words)
    order = np.lexsort((np.argsort(np.argsort(np.array(words, object))), -n))  # best first: largest n, then smallest word
    place = np.empty(rows, np.int64)
    place[order] = np.arange(rows)
    count, best = np.zeros(rows, np.int64), np.full(rows, rows, np.int64)
    left, right = matrix(parts), matrix(parts, True)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, rows])
    held = np.repeat(sizes, sizes)
    after = np.repeat(starts + sizes, sizes) - np.arange(rows)  # rows from this one to its group's end
    for d in range(1, min(SMALL, int(sizes.max()))):
        a = np.flatnonzero((held <= SMALL) & (after > d))
        a = a[within[a] | (mine[a] != mine[a + d])]
        if len(a):
            b = a + d
            near = one_edit(left[a], left[b], right[a], right[b], long[a], long[b], span[a], whole[a])
            for x, y in ((a[near], b[near]), (b[near], a[near])):
                np.add.at(count, x, 1)
                np.minimum.at(best, x, place[y])
    for s, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        all_rows = np.arange(s, s + size)
        first, second = (all_rows, all_rows) if within[s] else (all_rows[mine[s : s + size] == mine[s]], all_rows[mine[s : s + size] != mine[s]])
        for a in np.array_split(first, -(-len(first) // BLOCK)):
            for b in np.array_split(second, -(-len(second) // BLOCK) or 1):
                if len(b):
                    near = one_edit(left[a, None], left[None, b], right[a, None], right[None, b], long[a, None], long[None, b], span[s], whole[s])
                    count[a] += near.sum(1)
                    best[a] = np.minimum(best[a], np.where(near, place[None, b], rows).min(1))
                    if not within[s]:
                        count[b] += near.sum(0)
                        best[b] = np.minimum(best[b], np.where(near, place[a, None], rows).min(0))
    return count, np.where(best < rows, order[np.minimum(best, rows - 1)], -1)


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near counts and best neighbours of the words of sorted tile rows, whole groups at a time."""

    def done(rows: pa.Table) -> pa.RecordBatch:
        tile, side, other, mine, n, long, span, whole = (rows.column(c).to_numpy() for c in ("tile", "side", "other", "mine", "n", "long", "span", "whole"))
        words, parts = rows.column("word").to_pylist(), rows.column("part").to_pylist()
        new = (tile[1:] != tile[:-1]) | (side[1:] != side[:-1]) | (other[1:] != other[:-1])
        count, best = compared(np.r_[0, np.cumsum(new)], side == other, mine, words, n, parts, long, span, whole)
        some = np.flatnonzero(count)
        columns = [pa.array([words[i] for i in some], pa.string()), pa.array(count[some]), pa.array([words[i] for i in best[some]], pa.string()), pa.array(n[best[some]])]
        return pa.RecordBatch.from_arrays(columns, ["word", "near", "form", "form_n"])

    kept: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        kept.append(batch)
        size += len(batch)
        if size < ROWS and sum(b.nbytes for b in kept) < BYTES:
            continue
        rows = pa.Table.from_batches(kept)
        ids = [rows.column(c).to_numpy() for c in ("tile", "side", "other")]
        differs = np.flatnonzero(np.logical_or.reduce([x != x[-1] for x in ids]))
        cut = int(differs[-1]) + 1 if len(differs) else 0
        if cut:
            yield done(rows.slice(0, cut))
        kept = rows.slice(cut).to_batches()
        size = len(rows) - cut
    if size:
        yield done(pa.Table.from_batches(kept))


def neighbours(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """Of each word that has any: n_near, the number of words one edit away, and the commonest of them (best, best_n; ties: the first in code-point order)."""
    keys = ["tile", "side", "other"]
    dealt = tiles(words, block).repartition(*keys).sortWithinPartitions(*keys)
    found = dealt.mapInArrow(compare, "word string, near long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best).select("word", "n_near", F.col("best.form").alias("best"), (-F.col("best.less")).alias("best_n"))


def followed(forms: DataFrame) -> DataFrame:
    """(word, root) of a table (word, form): from each word, forms to the last. Pointers double, so rounds grow with the logarithm of the longest chain."""
    now = forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open"))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = materialize(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("open")), "spelling-roots")
        if now.where("open").isEmpty():
            return now.select("word", "root")


def variants(words: DataFrame, times: int = 2, block: int = BLOCK) -> DataFrame:
    """Each word (distinct, with its n) with its form: the commonest near word, if that is at least `times` as common.

    Returns word, n, n_near, form, form_n (null without a form) and root, the last of the forms from word on (word itself if none).
    """
    words = materialize(words.select("word", "n"), "spelling-words")
    near = neighbours(words, block)
    taken = F.col("best_n") >= times * F.col("n")
    rows = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("best")).alias("form"), F.when(taken, F.col("best_n")).alias("form_n"))
    rows = materialize(rows, "spelling-forms")
    roots = followed(rows.where("form is not null"))
    return rows.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
