"""URL filtering by rules and, where none fits, by path templates of labelled purity.

Each host has a tree of path templates. A node's segments are generalised into a wildcard when they vary (numbers,
hashes, dates, long slugs), and branches of one parent that are statistically alike are merged: first those whose
shares of next segments differ little from all branches' (Hellinger distance, beyond what a branch of few pages has by
chance) and whose labelled purity does not differ significantly, into the wildcard *; then, of the rest, those with the
same commonest next segment x that are alike in the same sense, into *(x), so that several kinds of branches give
several templates. A branch that leans to bad keeps its name. All branches are tested, however many a node has, and
levels are built as long as a node has two shapes below it. A template is rejected when the smoothed share of good
pages among its labelled ones is low; smoothing starts from the host's share, and that from all pages'. purity_curve
shows on held-out labels what a threshold would reject.

Levels are built one after another with aggregations over (host, template) pairs. Rows of a hot host are
pre-aggregated by distinct shape before anything is compared, and a branch is compared with a group's sums and not
with its siblings, so no step grows with the square of a host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackmill.shared import materialize

#: A rule fits its host, all subdomains and paths that start with its own.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Smoothing weight of the host's share, in pages; and of the share of all pages in a host's.
WEIGHT = 8.0
REJECT_BELOW = 0.5
#: Branches are alike up to this Hellinger distance and this difference of purity in standard errors.
DISTANCE, ERRORS = 0.35, 2.0
WILD, LEAF = "*", "$"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, with A to Z in lower case; path: then up to ? or #. Empty without ://."""
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    after = F.coalesce(after, F.lit(""))
    host = F.regexp_extract(after, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null if none does."""
    found = verdict = F.lit(None).cast("string")
    for rule, what in sorted(rules, key=lambda r: len(r[0])):
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{start}") if start else (host == name) | host.endswith(f".{name}")
        found, verdict = F.when(fits, rule).otherwise(found), F.when(fits, what).otherwise(verdict)
    return found, verdict


def segment_shape(s: Column) -> Column:
    """A segment, or the wildcard if it looks variable."""
    bare = F.regexp_replace(s, r"\.[A-Za-z]{1,5}$", "")
    varies = bare.rlike(r"^[0-9]+$|^[0-9a-fA-F]{8,}$|^[0-9]{4}-[0-9]{2}|[0-9]{3,}|^.{25,}$|^[A-Za-z]*[-_]?[0-9]+$")
    return F.when(varies, F.lit(WILD)).otherwise(s)


def templates(pages: DataFrame, distance: float = DISTANCE, errors: float = ERRORS) -> DataFrame:
    """Rows (host, raw, n, labelled, good, template) for each distinct raw path shape, generalised. pages: (host, path, label).

    label: 1 good, 0 bad, null unknown. raw: the path's segments by shape, as an array.
    """
    sums = [F.count("*").alias("n"), F.count("label").alias("labelled"), F.sum("label").alias("good")]
    shapes = materialize(pages.withColumn("raw", raw_shape(F.col("path"))).groupBy("host", "raw").agg(*sums).withColumn("template", F.array().cast("array<string>")), "url-shapes")
    level = 0
    while True:
        rest = F.slice("raw", level + 1, F.greatest(F.size("raw"), F.lit(1)))
        # A node with one shape below it has nothing left to tell apart: that shape is its template.
        nodes = shapes.groupBy("host", "template").agg(F.min(rest).alias("lo"), F.max(rest).alias("hi")).where("lo != hi")
        nodes = materialize(nodes.select("host", "template", F.lit(True).alias("open")), "url-nodes")
        if nodes.isEmpty():
            return shapes.withColumn("template", F.concat("template", rest))
        shapes = materialize(_split(shapes.join(nodes, ["host", "template"], "left"), level, distance, errors), f"url-level{level}")
        level += 1


def _split(shapes: DataFrame, level: int, distance: float, errors: float) -> DataFrame:
    """The shapes with one more segment in the templates: that of their branch of the node, or its cluster's."""
    segment = lambda i: F.coalesce(F.try_element_at("raw", F.lit(i)), F.lit(LEAF))
    parent, branch = ["host", "template"], ["host", "template", "seg"]
    at = shapes.withColumn("seg", segment(level + 1)).withColumn("next", segment(level + 2))
    # The one pass over all shapes of a level; what follows works on a row for each branch and next segment.
    counts = [F.sum("n").alias("m"), F.sum("labelled").alias("l"), F.coalesce(F.sum("good"), F.lit(0.0)).alias("g")]
    pairs = materialize(at.where("open").where(~F.col("seg").isin(WILD, LEAF)).groupBy(*branch, "next").agg(*counts), "url-pairs")
    named = pairs.groupBy(*branch).agg(F.sum("m").alias("of"), F.sum("l").alias("labelled"), F.sum("g").alias("good"))
    # Branches that lean to bad keep their names, so that a wildcard never mixes them with the others.
    leans = (F.col("good") + 1) / (F.col("labelled") + 1) >= REJECT_BELOW
    kinds = materialize(pairs.select(*branch, "next", "m").join(named.where(leans), branch), "url-kinds")

    def merged(kinds: DataFrame, group: list[str]) -> DataFrame:
        """Branches that are alike their group as a whole."""
        whole = kinds.groupBy(*group).agg(F.sum("m").alias("all"))
        pooled = kinds.groupBy(*group, "next").agg(F.sum("m").alias("pm")).join(whole, group).withColumn("share", F.col("pm") / F.col("all"))
        pooled = materialize(pooled, "url-pooled")
        alike = kinds.join(pooled, [*group, "next"]).groupBy(*dict.fromkeys([*group, *branch]), "of", "labelled", "good").agg(F.sum(F.sqrt(F.col("m") / F.col("of") * F.col("share"))).alias("affinity"))
        alike = materialize(alike, "url-alike")
        sums = alike.groupBy(*group).agg(F.sum("labelled").alias("ln"), F.sum("good").alias("gn"), F.count("*").alias("branches"))
        tested = alike.join(sums.join(pooled.groupBy(*group).agg(F.count("*").alias("kinds")), group), group)
        share = (F.col("gn") + 1) / (F.col("ln") + 2)
        off = F.abs(F.col("good") - F.col("labelled") * share) / F.sqrt(F.greatest(F.col("labelled") * share * (1 - share), F.lit(0.25)))
        # A sample of n pages is off its own pool by (kinds - 1) / 8n in squared distance, on average.
        chance = (F.col("kinds") - 1) / (8 * F.col("of"))
        return tested.where((F.col("branches") > 1) & (1 - F.col("affinity") <= distance**2 + chance) & (off <= errors))

    wild = materialize(merged(kinds, parent).select(*branch, F.lit(WILD).alias("name")), "url-wild")
    # The others are pooled by their commonest next segment (the first in order of ties).
    left = kinds.join(wild, branch, "left_anti")
    most = left.groupBy(*branch).agg(F.max_by("next", F.struct("m", "next")).alias("most"))
    left = materialize(left.join(most, branch), "url-left")
    names = wild
    if not left.isEmpty():
        names = wild.unionByName(merged(left, [*parent, "most"]).select(*branch, F.concat(F.lit(f"{WILD}("), "most", F.lit(")")).alias("name")))
    placed = at.join(names, branch, "left")
    name = F.when(F.col("open") & (F.col("seg") != LEAF), F.array(F.coalesce("name", "seg"))).otherwise(F.array().cast("array<string>"))
    # A closed node's shape is whole from here on: its rest goes to the template at the end.
    closed = F.col("open").isNull() & (F.size("raw") > level)
    name = F.when(closed, F.array(F.element_at("raw", level + 1))).otherwise(name)
    return placed.select("host", "raw", "n", "labelled", "good", F.concat("template", name).alias("template"))


def raw_shape(path: Column) -> Column:
    """A path's non-empty segments by shape."""
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), segment_shape)


def judge(pages: DataFrame, labels: DataFrame | None, rules=RULES, key: str = "page_id", url: str = "url", label_key: str = "doc_id", label: str = "quality", weight: float = WEIGHT, reject_below: float = REJECT_BELOW) -> DataFrame:
    """Rows (key, host, path, rule, verdict, template, purity), a row for each page.

    verdict: the rule's; else block where the template's smoothed purity is below reject_below, allow otherwise.
    A page without host is judged by the same method, as of the host "". labels: (label_key, label) with label 1
    for good, label_key being the page's key; several labels of a page are averaged. Without any label every purity
    is 1. Urls are read whole, repeated rows are judged each, null keys have no label, and no pages give no rows.
    """
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))
    if labels is None:
        labelled = rows.withColumn("label", F.lit(None).cast("double"))
    else:
        given = labels.where(F.col(label).isNotNull() & F.col(label_key).isNotNull()).groupBy(F.col(label_key).alias("key")).agg(F.avg(F.col(label).cast("double")).alias("label"))
        labelled = rows.join(given, "key", "left")
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    labelled = labelled.withColumn("rule", rule).withColumn("by_rule", verdict).withColumn("raw", raw_shape(F.col("path")))
    shapes = templates(labelled)
    whole = shapes.agg(F.sum("good").alias("g"), F.sum("labelled").alias("l")).first()
    prior = (whole["g"] / whole["l"]) if whole["l"] else 1.0
    known = shapes.groupBy("host", "template").agg(F.sum("n").alias("n"), F.sum("labelled").alias("l"), F.coalesce(F.sum("good"), F.lit(0.0)).alias("g"))
    hosts = known.groupBy("host").agg(F.sum("g").alias("hg"), F.sum("l").alias("hl"))
    host_share = (F.col("hg") + weight * prior) / (F.col("hl") + weight)
    purity = known.join(hosts, "host").withColumn("purity", (F.col("g") + weight * host_share) / (F.col("l") + weight)).select("host", "template", "purity")
    by_shape = shapes.select("host", "raw", "template").join(purity, ["host", "template"])
    judged = labelled.join(by_shape, ["host", "raw"], "left")
    method = F.when(F.col("purity") < reject_below, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(F.col("key").alias(key), "host", "path", "rule", F.coalesce("by_rule", method).alias("verdict"), F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "purity")


def purity_curve(pages: DataFrame, labels: DataFrame, key: str = "page_id", label_key: str = "doc_id", label: str = "quality", steps: int = 20, **how) -> DataFrame:
    """Rows (below, pages, good) for thresholds from 1 / steps to 1: of the held-out labelled pages whose template's purity is below it, how many there are and how many are good.

    A fifth of the labels (crc32 of label_key divisible by 5) is held out; purity comes from the others. A threshold
    is worth having where few of the pages below it are good.
    """
    held = F.crc32(F.col(label_key).cast("string").cast("binary")) % 5 == 0
    judged = judge(pages, labels.where(~held), key=key, label_key=label_key, label=label, **how)
    asked = labels.where(held & F.col(label).isNotNull()).select(F.col(label_key).alias(key), F.col(label).cast("double").alias("good"))
    bins = judged.join(asked, key).groupBy(F.ceil(F.col("purity") * steps + 1e-9).alias("bin")).agg(F.count("*").alias("n"), F.sum("good").alias("good"))
    limits = pages.sparkSession.range(1, steps + 1).select(F.col("id").alias("limit"))
    joined = limits.join(F.broadcast(bins), F.col("bin") <= F.col("limit"), "left")  # steps rows on either side
    return joined.groupBy((F.col("limit") / steps).alias("below")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pages"), F.coalesce(F.sum("good"), F.lit(0.0)).alias("good"))
