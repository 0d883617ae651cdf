"""Rules for profiling floats: depths of a cycle, greedy repairs inside one segment, stage counters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackmill.functions.geo import RADIUS_QC
from trackmill.operators.cleaning import micros


def park_window_depth(measurements: DataFrame, windows: DataFrame, q: float = 0.5, keys=("platform_code", "cycle_number")) -> DataFrame:
    """Quantile (linear) of pressure inside each cycle's parking window. windows: (keys, start, stop), one for each cycle."""
    inside = measurements.join(windows, list(keys)).where((F.col("time") >= F.col("start")) & (F.col("time") <= F.col("stop")))
    return inside.groupBy(*keys).agg(F.percentile("pressure", q).alias("depth"), F.count("pressure").alias("n"))


def resolve_parking_depth(cycles: DataFrame, fallback: float, platform: str = "platform_code", cycle: str = "cycle_number") -> DataFrame:
    """Representative, else inferred from adjusted, else from raw pressure, else the nearest earlier cycle's, else the next later one's, else the fallback; with its source."""
    found = F.coalesce("representative", "inferred_adjusted", "inferred_raw")
    source = F.when(F.col("representative").isNotNull(), "representative").when(F.col("inferred_adjusted").isNotNull(), "inferred_adjusted").when(F.col("inferred_raw").isNotNull(), "inferred_raw")
    w = Window.partitionBy(platform).orderBy(cycle)
    rows = cycles.withColumns({"__own": found, "__source": source})
    rows = rows.withColumns({"__before": F.last("__own", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "__after": F.first("__own", True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    name = F.coalesce("__source", F.when(F.col("__before").isNotNull(), F.lit("forward_fill")), F.when(F.col("__after").isNotNull(), F.lit("backward_fill")), F.lit("fallback"))
    return rows.withColumns({"parking_depth": F.coalesce("__own", "__before", "__after", F.lit(float(fallback))), "depth_source": name}).drop("__own", "__source", "__before", "__after")


def near_surface_cycles(cycles: DataFrame, max_surface_hours: float, min_parking_hours: float, min_ratio: float) -> DataFrame:
    """Cycles with hours near the surface and parked, and whether they fail. A missing phase counts as no time."""
    hours = lambda a, b: F.coalesce((micros(b) - micros(a)) / 3600e6, F.lit(0.0))
    rows = cycles.withColumns({"surface_hours": hours("surface_start", "surface_stop"), "parking_hours": hours("park_start", "park_stop")})
    ratio = F.col("parking_hours") / F.nullif(F.col("parking_hours") + F.col("surface_hours"), F.lit(0.0))
    rows = rows.withColumn("parking_ratio", ratio)
    return rows.withColumn("fails", (F.col("surface_hours") > max_surface_hours) | (F.col("parking_hours") < min_parking_hours) | (F.coalesce("parking_ratio", F.lit(0.0)) < min_ratio))


def _km(a: np.ndarray, b: np.ndarray) -> float:
    d = (b[0] - a[0] + 180) % 360 - 180
    p, q = np.radians(a[1]), np.radians(b[1])
    h = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(d) / 2) ** 2
    return 2 * RADIUS_QC * np.arcsin(np.sqrt(min(1.0, h)))


def _too_fast(a: np.ndarray, b: np.ndarray, limit: float) -> bool:
    """Rows are (lon, lat, day)."""
    days, km = b[2] - a[2], _km(a, b)
    return km > 0 if days <= 0 else km / days > limit


def jump_qc(df: DataFrame, max_speed: float, max_block: int = 3, keys=("trajectory", "segment")) -> DataFrame:
    """Without short blocks that two too fast links (km a day) bound and whose bridge is slow enough, first block first; then split where a fast link is left.

    Adds part. Removals change later links, so a segment is in one task, sorted, and read as a stream: a batch's links
    are measured at once, and only segments that hold a fast one are gone through, one at a time.
    """
    rows = df.drop("part")

    def fast_links(x: np.ndarray) -> np.ndarray:
        p = np.radians(x[:, 1])
        h = np.sin(np.diff(p) / 2) ** 2 + np.cos(p[:-1]) * np.cos(p[1:]) * np.sin(np.radians(np.diff(x[:, 0])) / 2) ** 2
        days, km = np.diff(x[:, 2]), 2 * RADIUS_QC * np.arcsin(np.sqrt(np.minimum(1.0, h)))
        # What is near the limit is left to the exact rule, as are links without a position.
        return ~np.where(days <= 0, km == 0, km <= max_speed * days * (1 - 1e-9))

    def repaired(x: np.ndarray, fast: np.ndarray) -> tuple[list[int], np.ndarray]:
        """Rows that stay and their parts. fast: whether the link from each row to the next is too fast; only links over removed rows are measured."""
        flags = fast.tolist()

        def too_fast(a: int, b: int) -> bool:
            return flags[a] if b == a + 1 else bool(_too_fast(x[a], x[b], max_speed))

        keep, i = list(range(len(x))), 1
        while i < len(keep):
            if too_fast(keep[i - 1], keep[i]):
                for size in range(1, max_block + 1):
                    j = i + size
                    if j < len(keep) and too_fast(keep[j - 1], keep[j]) and not too_fast(keep[i - 1], keep[j]):
                        del keep[i:j]
                        i = max(1, i - 1)
                        break
                else:
                    i += 1
            else:
                i += 1
        return keep, np.cumsum([0] + [too_fast(a, b) for a, b in zip(keep, keep[1:], strict=False)])

    def whole(table: pa.Table) -> pa.Table:
        """Rows that stay, with their parts; the table holds whole segments."""
        first = starts(table)
        days = pc.cast(pc.cast(table.column("time"), pa.timestamp("us")), pa.int64()).to_numpy() / 86400e6
        x = np.column_stack([table.column("lon").to_numpy(), table.column("lat").to_numpy(), days]).astype(float)
        fast = fast_links(x)
        bounds = np.append(first, len(x))
        fast[bounds[1:-1] - 1] = False
        stay, part = np.ones(len(x), bool), np.zeros(len(x), np.int64)
        for s in np.unique(np.searchsorted(first, np.flatnonzero(fast), "right") - 1):
            lo, hi = bounds[s], bounds[s + 1]
            for k in np.flatnonzero(fast[lo : hi - 1]):
                fast[lo + k] = _too_fast(x[lo + k], x[lo + k + 1], max_speed)
            if not fast[lo : hi - 1].any():
                continue
            keep, parts = repaired(x[lo:hi], fast[lo : hi - 1])
            stay[lo:hi] = False
            stay[lo + np.array(keep)] = True
            part[lo + np.array(keep)] = parts
        return table.append_column("part", pa.array(part)).filter(pa.array(stay)).combine_chunks()

    def starts(table: pa.Table) -> np.ndarray:
        """Rows at which a segment begins; nulls are a key too."""
        new = np.zeros(len(table), bool)
        new[0] = True
        for k in keys:
            code = pc.dictionary_encode(table.column(k).combine_chunks(), null_encoding="encode").indices.to_numpy()
            new[1:] |= code[1:] != code[:-1]
        return np.flatnonzero(new)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            # All but the last segment of a batch are whole once the next one is seen.
            own = starts(pa.Table.from_batches([batch]))
            if held and (len(own) > 1 or any(held[-1].column(k)[-1] != batch.column(k)[0] for k in keys)):
                cut = int(own[-1])
                yield from whole(pa.Table.from_batches([*held, batch.slice(0, cut)])).to_batches()
                held = [batch.slice(cut)]
            else:
                held.append(batch)
        if held:
            yield from whole(pa.Table.from_batches(held)).to_batches()

    schema = T.StructType([*rows.schema.fields, T.StructField("part", T.LongType())])
    return rows.repartition(*keys).sortWithinPartitions(*keys, "obs").mapInArrow(stream, schema)


def repair_isolated_bins(df: DataFrame, column: str, longest: int, keys=("trajectory",), order: str = "obs") -> DataFrame:
    """Short runs between equal neighbours take their value, left to right, each repair seen by the next; nulls are never changed or used."""

    def repair(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order).copy()
        v = group[column].astype(object).where(group[column].notna(), None).tolist()
        i = 0
        while i < len(v):
            j = i
            while j < len(v) and v[j] == v[i]:
                j += 1
            if 0 < i and j < len(v) and j - i <= longest and v[i] is not None and v[i - 1] is not None and v[i - 1] == v[j]:
                v[i:j] = [v[i - 1]] * (j - i)
                while i > 0 and v[i - 1] == v[i]:
                    i -= 1
                continue
            i = max(j, i + 1)
        group[column] = pd.array(v, dtype="Int64") if pd.api.types.is_numeric_dtype(group[column].dtype) else v
        return group

    return df.groupBy(*keys).applyInPandas(repair, df.schema)


def stage_counts(stages: dict[str, DataFrame], keys=("trajectory",)) -> DataFrame:
    """Rows and distinct particles of each stage."""
    out = None
    for name, df in stages.items():
        row = df.agg(F.count("*").alias("rows"), F.countDistinct(*keys).alias("particles")).select(F.lit(name).alias("stage"), "rows", "particles")
        out = row if out is None else out.unionByName(row)
    return out


def identifier(text: Column) -> Column:
    """Trimmed id; missing tokens become N/A, whole numbers lose their decimals."""
    t = F.trim(text.cast("string"))
    missing = t.isNull() | F.lower(t).isin("", "nan", "none", "null", "n/a", "na", "--")
    return F.when(missing, "N/A").when(t.rlike(r"^[+-]?[0-9]+\.0+$"), F.regexp_extract(t, r"^([+-]?[0-9]+)", 1)).otherwise(t)
