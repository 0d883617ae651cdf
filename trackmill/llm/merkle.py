"""Merkle trees over a table, as nested structs that are rolled up by the digits of a rank.

Each group of rows has a tree of its own, and the groups' roots have one above them. A row's rank in its group
is written in base 8: grouping the last digit away, then the next and so on makes the nodes of one level after
another, each a struct that holds its children. This stops at blocks of 512 leaves, whatever the table's size;
blocks' digests are leaves of the next tier, so a table of 8^12 rows has four tiers. On the way back down, a
transform gives each child its siblings to the left and right and an explode sets it free with the path it has
so far, so the proofs of a block come from the block alone. A path enters a block by its key, a row for a block.

Digests are lower-case hexadecimal SHA-256. A level's last run may be shorter than 8, even one node.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackmill.shared import materialize

ARITY_BITS, DIGITS = 3, 3
ARITY = 1 << ARITY_BITS
BLOCK_BITS = ARITY_BITS * DIGITS
NO_PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(*values: Column) -> Column:
    """Digest of a row: each value's UTF-8 bytes, a colon and the value; `-` for null."""
    texts = [v.cast("string") for v in values]
    return digest(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))


def ranked(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """rows with rank, the place in the group (from 0), and n, the group's size.

    Ranges of (group, order) are sorted apart, whatever group they belong to, and go on from the counts of those
    before. Rows alike in all of these are told apart by where they were read, so they go to several ranges too.
    """
    keys = [group, *order, "__row"]
    told = rows.withColumn("__row", F.monotonically_increasing_id())
    told = materialize(told, "merkle-rows")  # the sample that ranges are drawn from reads this, not the texts
    ranged = told.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = materialize(ranged.drop("__row").withColumns({"__at": F.monotonically_increasing_id(), "__part": F.spark_partition_id()}), "merkle-ranges")
    runs = ranged.groupBy(group, "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__held"))
    mine = Window.partitionBy(group)  # a row for each range that holds some of the group
    ahead = F.coalesce(F.sum("__held").over(mine.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(group, "__part", (F.col("__first") - ahead).alias("__base"), F.sum("__held").over(mine).alias("n"))
    runs = materialize(runs, "merkle-runs")  # Spark knows its size then, and sends it round only if it is small
    return ranged.join(runs, [group, "__part"]).withColumn("rank", F.col("__at") - F.col("__base")).drop("__at", "__part", "__base")


def rolled_up(nodes: DataFrame, tier: int) -> DataFrame:
    """Blocks (grp, n, block, kids, digest) of nodes (grp, n, rank, digest, held): kids hold kids, down to the nodes.

    n counts the leaves of the lowest tier: a level is there where its nodes below are more than one.
    """
    digits = [((F.shiftright("rank", ARITY_BITS * i)) % ARITY).cast("int").alias(f"d{i}") for i in range(DIGITS)]
    rows = nodes.select("grp", "n", F.shiftright("rank", BLOCK_BITS).alias("block"), *digits, "digest", F.col("held").alias("kids"))
    rows = rows.repartition("grp", "block")  # all groupings below are within a block
    for i in range(DIGITS):
        left = [f"d{j}" for j in range(i + 1, DIGITS)]
        rows = rows.groupBy("grp", "n", "block", *left).agg(F.sort_array(F.collect_list(F.struct(f"d{i}", "digest", "kids"))).alias("kids"))
        several = F.col("n") > ARITY ** (DIGITS * tier + i)
        rows = rows.withColumn("digest", F.when(several, F.sha2(F.concat_ws("", F.col("kids.digest")), 256)).otherwise(F.col("kids")[0]["digest"]))
    return rows


def spread(blocks: DataFrame, tier: int, carried: Sequence[str]) -> DataFrame:
    """Nodes (grp, rank, digest, held, path, carried) of blocks with the path above each; path goes from the node upwards."""
    rows = blocks.withColumn("rank", F.col("block"))
    for i in reversed(range(DIGITS)):
        digests = F.col("kids.digest")
        kids = F.transform("kids", lambda kid, at: F.struct(kid.alias("kid"), F.concat_ws("", F.slice(digests, F.lit(1), at)).alias("left"), F.concat_ws("", F.slice(digests, at + 2, F.lit(ARITY))).alias("right")))  # noqa: B023  used at once
        rows = rows.select("grp", "n", "rank", "path", *carried, F.inline(kids))
        several = F.col("n") > ARITY ** (DIGITS * tier + i)
        path = F.when(several, F.concat(F.array(F.struct("left", "right")), F.col("path"))).otherwise(F.col("path"))
        rank = F.shiftleft("rank", ARITY_BITS) + F.col("kid")[f"d{i}"]
        rows = rows.select("grp", "n", rank.alias("rank"), path.alias("path"), *carried, F.col("kid.digest").alias("digest"), F.col("kid.kids").alias("kids"))
    return rows.withColumnRenamed("kids", "held")


def grown(nodes: DataFrame) -> list[DataFrame]:
    """Written tiers of blocks, lowest first; the last has a row for each group, with the group's root as digest."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    tiers: list[DataFrame] = []
    while True:
        tiers.append(materialize(rolled_up(nodes, len(tiers)), f"merkle-tier-{len(tiers)}"))
        if most <= 1 << BLOCK_BITS * len(tiers):
            return tiers
        nodes = tiers[-1].select("grp", "n", F.col("block").alias("rank"), "digest", F.lit(None).cast("string").alias("held"))


def proven(tiers: Sequence[DataFrame], above: DataFrame) -> DataFrame:
    """All nodes of the lowest tier with their paths; above: a row for each grp, with the path over its root and what to carry along."""
    carried = [c for c in above.columns if c not in ("grp", "path")]
    rows = tiers[-1].drop("digest").join(above, "grp")
    for tier in reversed(range(len(tiers))):
        rows = spread(rows, tier, carried)
        if tier:
            rows = tiers[tier - 1].drop("digest").join(rows.select("grp", F.col("rank").alias("block"), "path", *carried), ["grp", "block"])
    return rows


def manifest(rows: DataFrame, columns: Sequence[str], group: str, key: str, changed: Column | None = None) -> DataFrame:
    """Rows (key, leaf, changed, subroot, root, path), one for each of rows.

    columns: what a leaf stands for, in this order. group: a tree for each of its values, null being one; trees
    are ordered by it, null first, then as UTF-8 bytes. key: leaves' order, nulls first, equal keys by leaf;
    rows alike in all columns have equal leaves and places beside each other. changed: another digest of the row
    to carry along (see folded). path: siblings (left, right) of each level from the leaf to the root, each the
    digests joined; a lone leaf of a lone group has none. An empty table gives no rows. Other columns are not read.
    """
    label = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # null apart from, and before, the empty string
    other = F.lit(None).cast("string") if changed is None else changed
    leaves = rows.select(label.alias("grp"), F.col(key).alias("__key"), leaf(*(F.col(c) for c in columns)).alias("digest"), other.alias("__changed"))
    placed = ranked(leaves, "grp", ["__key", "digest"])
    tiers = grown(placed.select("grp", "n", "rank", "digest", F.struct("__key", "__changed").alias("held")))
    roots = tiers[-1].select(F.lit("").alias("all"), "grp", F.col("digest"))
    top = grown(ranked(roots, "all", ["grp"]).select(F.col("all").alias("grp"), "n", "rank", "digest", F.col("grp").alias("held")))
    root = top[-1].select("grp", F.col("digest").alias("root"), F.lit(None).cast(NO_PATH).alias("path")).withColumn("path", F.coalesce("path", F.array().cast(NO_PATH)))
    above = proven(top, root).select(F.col("held").alias("grp"), "path", F.col("digest").alias("subroot"), "root")
    nodes = proven(tiers, above)
    return nodes.select(F.col("held.__key").alias(key), F.col("digest").alias("leaf"), F.col("held.__changed").alias("changed"), "subroot", "root", "path")


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a path, level by level upwards, left to right; of nothing for an empty path."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda p: F.concat(p["left"], p["right"]))), 256)


def folded(path: Column, start: Column) -> Column:
    """The root that a leaf's digest leads to along a path."""
    return F.aggregate(path, start, lambda sofar, p: digest(p["left"], sofar, p["right"]))


def tampering_report(docs: DataFrame) -> DataFrame:
    """Each document's leaf, subroot, root and proof, and whether the row still proves itself after tampering.

    Leaves stand for doc_id, source, lang, n_chars and text; trees are by lang. Where 3 divides the CRC-32 of the
    decimal doc_id, A-Z of the text is lower-cased before the leaf is taken again (null doc_ids are left alone,
    null texts stay null); the proof is folded from there, with the original siblings.
    """
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    changed = F.when(chosen & (lower != F.col("text")), leaf(*(lower if c == "text" else F.col(c) for c in columns)))
    found = manifest(docs, columns, "lang", "doc_id", changed)
    found = found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded(F.col("path"), F.coalesce("changed", "leaf")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
