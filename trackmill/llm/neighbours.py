"""Nearest neighbours by inner product: a block matrix join of int8 tiles with error bounds.

Vectors are quantised to int8 with a scale of their own. A tile is the product of a block of queries and a block
of candidates: it gives every inner product with a bound on its error, from the norms of what quantisation took
away. In each tile, only pairs that can still be among a query's k nearest survive (their upper bound reaches the
k-th best lower bound); those are recomputed in double precision from the original vectors and kept in a heap of
k for each query. Heaps of several tiles are merged by rank. Nothing that could be among the k nearest is ever
dropped, so the result is exact.

Queries are a stated set; each block of them meets each block of candidates once. Blocks are dealt as a grid, so
that a task holds two blocks at a time whatever the table's size, and a vector is sent to as many tasks as there
are blocks of the other side. Candidates' blocks are large, so queries (the small side) are what is repeated.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of candidates, and of a tile's queries.
CANDIDATES, QUERIES = 8192, 4096


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes and scale of each row, the norm of what the codes stand for and that of what they leave out."""
    scale = np.abs(x).max(1) / 127.0
    scale[scale == 0] = 1.0
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    stands = codes * scale[:, None]
    return codes, scale, np.linalg.norm(stands, axis=1), np.linalg.norm(x - stands, axis=1)


def exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, summed from the first component on."""
    out = np.zeros(len(q))
    for j in range(q.shape[1]):
        out += q[:, j] * c[:, j]
    return out


def tile(queries: tuple, candidates: tuple, k: int) -> list[tuple[int, list[tuple[float, int]]]]:
    """For each query of a block with any candidates: its nearest of a block, best first. Blocks: (ids, vectors, *quantised)."""
    qid, q, qc, qs, qn, qe = queries
    cid, c, cc, cs, cn, ce = candidates
    # Products of int8 codes are whole numbers, which float32 holds exactly up to 1040 components and float64 beyond.
    kind = np.float32 if q.shape[1] * 127 * 127 < 1 << 24 else np.float64
    with np.errstate(over="ignore", invalid="ignore"):
        return _tile(queries, candidates, k, (qc.astype(kind) @ cc.astype(kind).T).astype(np.float64) * qs[:, None] * cs)


def _tile(queries: tuple, candidates: tuple, k: int, about: np.ndarray) -> list[tuple[int, list[tuple[float, int]]]]:
    qid, q, qc, qs, qn, qe = queries
    cid, c, cc, cs, cn, ce = candidates
    # <x, y> - <x', y'> = <x', y - y'> + <x - x', y>, and a little for rounding in this sum itself.
    error = (qn[:, None] * ce + qe[:, None] * (cn + ce)) * (1 + 1e-9) + 1e-12 * (qn[:, None] + qe[:, None]) * (cn + ce)
    own = qid[:, None] == cid
    # A bound that is not a number (products beyond the range of doubles) rules nothing out.
    low = about - error
    low[own | np.isnan(low)] = -np.inf
    at = min(k, low.shape[1]) - 1
    least = -np.partition(-low, at, axis=1)[:, at]
    rows, cols = np.nonzero(~own & ~(about + error < least[:, None]))
    score = exact(q[rows], c[cols])
    score[np.isnan(score)] = -np.inf
    ends = np.searchsorted(rows, np.arange(len(qid) + 1)).tolist()
    return [(int(qid[i]), heapq.nsmallest(k, zip((-score[a:b]).tolist(), cid[cols[a:b]].tolist(), strict=True))) for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False)) if a < b]


def blocks(table: pa.Table) -> tuple:
    column = table.column("v").combine_chunks()
    x = column.values.to_numpy(zero_copy_only=False).astype(np.float64)[: column.offsets[-1].as_py()].reshape(len(column), -1)
    return (table.column("id").to_numpy(), x, *quantise(x))


def usable(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    """Rows (id, v, d) that take part: no null id, not null, empty or all zero, no null or non-finite component."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(fine).withColumn("d", F.size("v"))


def nearest(vectors: DataFrame, is_query: str, k: int, id_column: str = "vec_id", vector: str = "embedding", candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each row that satisfies is_query, its k nearest by inner product.

    is_query: SQL over the column id. A row is compared with those of its own length that have another id; ties
    go to the smaller id. Every row is a candidate, also where ids repeat; of rows that repeat a query's id, the
    one with the smallest vector asks. Vectors with nothing to compare (see usable) are neither queries nor
    candidates. Fewer than k candidates are all returned. A product beyond the range of doubles is infinite, and one
    that is no number counts as minus infinity. Other columns are not read.
    """
    rows = usable(vectors, id_column, vector)
    counts = rows.agg(F.count("*").alias("c"), F.count(F.when(F.expr(is_query), 1)).alias("q")).first()
    n_c, n_q = -(-counts["c"] // candidates) or 1, -(-counts["q"] // queries) or 1
    deal = lambda n: F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("long")
    asking = rows.where(is_query).groupBy("id").agg(F.min("v").alias("v")).withColumn("d", F.size("v"))
    q = asking.select(F.lit(0).alias("side"), "id", "v", "d", deal(n_q).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(n_c - 1)).cast("array<long>")).alias("cb"))
    c = rows.select(F.lit(1).alias("side"), "id", "v", "d", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1)).cast("array<long>")).alias("qb"), deal(n_c).alias("cb"))

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        out: list[list] = [[], [], []]
        left, right = table.filter(pa.array(side == 0)), table.filter(pa.array(side == 1))
        if len(left) and len(right):
            right = blocks(right)
            for at in range(0, len(left), 512):
                for query, best in tile(blocks(left.slice(at, 512)), right, k):
                    for column, value in zip(out, ([query] * len(best), [b[1] for b in best], [-b[0] for b in best]), strict=True):
                        column.extend(value)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    met = q.unionByName(c).groupBy("qb", "cb", "d").applyInArrow(meet, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("vec_id"), "score")
