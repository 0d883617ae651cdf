"""Graph operators on tables of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmill.shared import materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Rows (node, component) for every node of undirected edges; component: the smallest node reached.

    Alternating large and small stars: each round hangs neighbours below the smallest one seen, and the number
    of rounds grows with the logarithm of the longest path. A hub's edges are never gathered: its minimum is a
    pre-aggregated sum and the join back is one that AQE splits. Each round is a written table. Self loops,
    repeated edges and edges with a null end are allowed; the last add nothing.
    """
    kind = edges.schema[src].dataType
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"), F.col(src).isNotNull().alias("a"), F.col(dst).isNotNull().alias("b"))
    # Written once: whatever made the edges is not run again for the nodes.
    e = materialize(e.where("a and b").select(F.col("u").cast(kind), F.col("v").cast(kind)).distinct(), "edges")
    nodes = e.select(F.explode(F.array("u", "v")).alias("node"))
    links = e.where("u != v")
    while not _is_star_forest(links):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = materialize(hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
    return nodes.distinct().join(links.select(F.col("u").alias("node"), "v"), "node", "left").select("node", F.coalesce("v", "node").alias("component"))


def _is_star_forest(links: DataFrame) -> bool:
    """Whether every larger end has one smaller end, and that one has none."""
    roles = links.select("u", F.lit(1).alias("up")).unionByName(links.select(F.col("v").alias("u"), F.lit(0).alias("up")))
    bad = roles.groupBy("u").agg(F.sum("up").alias("ups"), F.min("up").alias("low")).where("ups > 1 or (ups = 1 and low = 0)")
    return bad.limit(1).count() == 0


def _chains(links: DataFrame) -> DataFrame:
    """Rows (a, b, head, place) of directed edges (a, b): the first edge of the chain that each is in, and its place there from 0.

    links: (a, b, before), before being the edge (a, b) that it continues, null at a head. Pointer doubling: every
    round an edge takes over what the one that it points to points to, so rounds grow with the logarithm of the
    longest chain; each is a written table. links has to be one too.
    """
    state = links.select(F.struct("a", "b").alias("edge"), F.coalesce("before", F.struct("a", "b")).alias("head"), F.when(F.col("before").isNull(), 0).otherwise(1).cast("long").alias("place"))
    while True:
        state = materialize(state, "chains")
        ahead = state.select(F.col("edge").alias("head"), F.col("head").alias("next"), F.col("place").alias("more"))
        if state.join(ahead.where("more > 0"), "head", "left_semi").isEmpty():
            return state.select("edge.a", "edge.b", "head", "place")
        state = state.join(ahead, "head").select("edge", F.col("next").alias("head"), (F.col("place") + F.col("more")).alias("place"))


def ordered_segments(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Undirected edges as paths between nodes that have not two neighbours: rows (first, second, place, node, closed).

    first and second are the first two nodes of a path, read from its smaller end; a component of nodes with two
    neighbours each is one closed path from its smallest node to its smaller neighbour, whose last row is that node
    again. Self loops and repeated edges count for nothing.
    """
    both = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a != b")
    both = materialize(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "half-edges")
    ends = both.groupBy("a").agg((F.count("*") != 2).alias("end"))
    parts = connected_components(both.where("a < b"), "a", "b")
    loops = parts.join(ends, parts["node"] == ends["a"]).groupBy("component").agg(F.max("end").alias("open")).where("not open").select(F.col("component").alias("a"), F.lit(True).alias("loop"))
    ends = materialize(ends.join(loops, "a", "left").select("a", (F.col("end") | F.col("loop").isNotNull()).alias("end"), F.col("loop").isNotNull().alias("closed")), "path-ends")
    # The edge before (a, b) is the other one into a, where a is inside a path.
    into = both.select(F.col("b").alias("a"), F.col("a").alias("from"))
    inside = both.join(ends.where("not end").select("a"), "a").join(into, "a").where("from != b")
    before = inside.select("a", "b", F.struct(F.col("from").alias("a"), F.col("a").alias("b")).alias("before"))
    links = materialize(both.join(before, ["a", "b"], "left"), "path-links")
    chains = _chains(links)
    tails = chains.groupBy("head").agg(F.max_by(F.struct(F.col("b").alias("a"), F.col("a").alias("b")), "place").alias("back"))
    kept = chains.join(tails.where("head <= back"), "head").join(ends.select("a", "closed").withColumnRenamed("a", "start"), F.col("head.a") == F.col("start"))
    rows = kept.select(F.col("head.a").alias("first"), F.col("head.b").alias("second"), F.explode(F.when(F.col("place") == 0, F.array(F.struct(F.lit(0).cast("long").alias("place"), F.col("a").alias("node")), F.struct(F.lit(1).cast("long").alias("place"), F.col("b").alias("node")))).otherwise(F.array(F.struct((F.col("place") + 1).alias("place"), F.col("b").alias("node"))))).alias("x"), "closed")
    return rows.select("first", "second", "x.place", "x.node", "closed")


def directed_paths(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Directed edges as maximal paths between nodes that have not one edge in and one out, then cycles: rows (first, second, place, node).

    A cycle without such a node starts at its smallest. Repeated edges count once.
    """
    e = materialize(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).distinct(), "directed-edges")
    out, into = e.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("o")), e.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("i"))
    nodes = out.join(into, "node", "full").select("node", (~F.coalesce((F.col("o") == 1) & (F.col("i") == 1), F.lit(False))).alias("end"))
    parts = connected_components(e, "a", "b")
    loops = parts.join(nodes, "node").groupBy("component").agg(F.max("end").alias("open")).where("not open").select(F.col("component").alias("node"), F.lit(True).alias("loop"))
    nodes = nodes.join(loops, "node", "left").select(F.col("node").alias("a"), (F.col("end") | F.col("loop").isNotNull()).alias("end"))
    inside = e.join(nodes.where("not end").select("a"), "a").join(e.select(F.col("b").alias("a"), F.col("a").alias("from")), "a")
    before = inside.select("a", "b", F.struct(F.col("from").alias("a"), F.col("a").alias("b")).alias("before"))
    links = materialize(e.join(before, ["a", "b"], "left"), "path-links")
    kept = _chains(links)
    rows = kept.select(F.col("head.a").alias("first"), F.col("head.b").alias("second"), F.explode(F.when(F.col("place") == 0, F.array(F.struct(F.lit(0).cast("long").alias("place"), F.col("a").alias("node")), F.struct(F.lit(1).cast("long").alias("place"), F.col("b").alias("node")))).otherwise(F.array(F.struct((F.col("place") + 1).alias("place"), F.col("b").alias("node"))))).alias("x"))
    return rows.select("first", "second", "x.place", "x.node")
