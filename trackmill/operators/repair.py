"""Repairs whose steps see each other's results, over sorted blocks of a track instead of the whole of it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackmill.functions.geo import RADIUS_QC
from trackmill.operators.cleaning import micros
from trackmill.shared import materialize

#: Rows of a block of a track.
BLOCK = 20_000


def metres_a_second(a: tuple, b: tuple) -> float | None:
    """Speed between rows (lon, lat, microseconds) on the sphere; None where a value is missing or no time passes."""
    if any(x is None or x != x for x in (*a, *b)) or b[2] <= a[2]:
        return None
    p, q = np.radians(a[1]), np.radians(b[1])
    h = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(b[0] - a[0]) / 2) ** 2
    return float(2 * RADIUS_QC * np.arcsin(np.sqrt(min(1.0, h))) * 1e9 / (b[2] - a[2]))


def speed_steps(rows: Iterator[tuple], kept: tuple | None, limit: float) -> Iterator[tuple[bool, bool, tuple | None]]:
    """For each row (lon, lat, microseconds, the same of the next row, whether there is one): kept, begins a new segment, last row kept so far.

    kept: the last row kept before. A row that is reached too fast goes if it is the last, if the next is within
    reach from the row before it, or if it leaves it too fast; else a segment begins with it.
    """
    fast = lambda a, b: (v := metres_a_second(a, b)) is not None and v > limit
    for row in rows:
        here, following = row[:3], row[3:6] if row[6] else None
        if kept is None or not fast(kept, here):
            kept, what = here, (True, False)
        elif following is None or not fast(kept, following) or fast(here, following):
            what = (False, False)
        else:
            kept, what = here, (True, True)
        yield *what, kept


def speed_repair(df: DataFrame, limit_m_s: float, max_gap_days: float | None = None, drop_singletons: bool = True, keys: Sequence[str] = ("trajectory",), order: str = "obs", block: int = BLOCK) -> DataFrame:
    """df without the rows that the older speed rule drops (see speed_steps), with part, from 0 along a track: parts begin where a fast link stays, and after gaps of more than max_gap_days.

    Parts of one row go too, if asked; the others keep their numbers. Repeated rows of one time have no speed, and neither have rows without
    a position or time: they stay. order tells the rows of a track apart.

    A track is cut into blocks of rows. All blocks are scanned at once, as if each began afresh; then those whose
    predecessor ends with another row kept than they began with are scanned again, until none is left. Scans from
    two starts meet at the first row that both keep, mostly within a few rows, so there are two rounds as a rule,
    however long the track. Each round is a written table of block ends; a scan reads sorted rows as a stream.
    """
    names = list(keys)
    w = Window.partitionBy(*names).orderBy(order)
    t = micros()
    place = ["__lon", "__lat", "__t"]
    rows = df.withColumns({"__lon": F.col("lon").cast("double"), "__lat": F.col("lat").cast("double"), "__t": t.cast("long")})
    rows = rows.withColumns({f"{c}_next": F.lead(c).over(w) for c in place} | {"__more": F.lead(F.lit(True), 1, False).over(w), "__block": F.floor((F.row_number().over(w) - 1) / block).cast("long")})
    rows = materialize(rows, "repair-rows")
    needed = [*names, "__block", order, *place, *(f"{c}_next" for c in place), "__more"]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def scanned(starts: DataFrame | None, every: bool) -> DataFrame:
        """What scans give from starts (keys, __block, __start; None: all afresh): each row's fate (every), or the last row kept of each block."""
        what = rows.select(*needed)
        start = "struct<lon:double,lat:double,t:bigint>"
        what = what.withColumn("__start", F.lit(None).cast(start)) if starts is None else what.join(starts, [*names, "__block"])
        # Flat columns: a struct would come as a dictionary a row.
        what = what.withColumns({f"__s{i}": F.col(f"__start.{c}") for i, c in enumerate(("lon", "lat", "t"))} | {"__has": F.col("__start").isNotNull()}).drop("__start")
        n = len(names)
        out_names = [*names, "__block", order, "__kept", "__new"] if every else [*names, "__block", "__elon", "__elat", "__et"]

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import itertools

            missing = lambda x: None if x is None or x != x else x
            stream = (r for b in batches for r in b[[*needed, "__s0", "__s1", "__s2", "__has"]].itertuples(index=False, name=None))
            out: list[tuple] = []
            for key, group in itertools.groupby(stream, key=lambda r: r[: n + 1]):
                first = next(group)
                kept = tuple(missing(x) for x in first[-4:-1]) if first[-1] else None
                own = [first[:-4]]
                body = itertools.chain(own, (r[:-4] for r in group))
                body, again = itertools.tee(body) if every else (body, None)
                last = kept
                for keep, new, last in speed_steps((tuple(missing(x) for x in r[n + 2 :]) for r in body), kept, limit_m_s):
                    if every:
                        out.append((*key, next(again)[n + 1], keep, new))
                        if len(out) >= 8192:
                            yield pd.DataFrame(out, columns=out_names)
                            out = []
                if not every:
                    out.append((*key, *last))
            yield pd.DataFrame(out, columns=out_names)

        dealt = what.repartition(*names, "__block").sortWithinPartitions(*names, "__block", order)
        shape = [f"`{k}` {kinds[k]}" for k in names] + ["__block long"] + ([f"`{order}` {kinds[order]}", "__kept boolean", "__new boolean"] if every else ["__elon double", "__elat double", "__et long"])
        return dealt.mapInPandas(scan, ", ".join(shape))

    state = scanned(None, False).withColumn("__start", F.lit(None).cast("struct<lon:double,lat:double,t:bigint>"))
    while True:
        state = materialize(state, "repair-ends")
        along = Window.partitionBy(*names).orderBy("__block")  # a row for each block
        ahead = F.lag(F.struct(F.col("__elon").alias("lon"), F.col("__elat").alias("lat"), F.col("__et").alias("t"))).over(along)
        told = state.withColumn("__ahead", ahead)
        wrong = materialize(told.where(~F.col("__ahead").eqNullSafe(F.col("__start"))).select(*names, "__block", F.col("__ahead").alias("__start")), "repair-again")
        if wrong.isEmpty():
            break
        fixed = scanned(wrong, False).join(wrong, [*names, "__block"])
        state = state.join(wrong.select(*names, "__block"), [*names, "__block"], "left_anti").unionByName(fixed)
    fates = scanned(state.select(*names, "__block", "__start"), True)
    kept = rows.join(fates.where("__kept").drop("__block", "__kept"), [*names, order])
    days = (F.col("__t") - F.lag("__t").over(w)) / 86_400_000_000
    cut = F.col("__new") if max_gap_days is None else F.col("__new") | F.coalesce(days > max_gap_days, F.lit(False))
    out = kept.withColumn("part", F.sum(cut.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if drop_singletons:
        out = out.withColumn("__size", F.count("*").over(Window.partitionBy(*names, "part"))).where("__size > 1")
    return out.select(*df.columns, "part")
