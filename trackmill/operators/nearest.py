"""The nearest row on the sphere, however far, by boxes around neighbouring rows; the nearest time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackmill.functions.geo import RADIUS, haversine, wrap_lon
from trackmill.operators.cleaning import micros
from trackmill.shared import materialize, small_batches

#: Level of the cells whose order rows are cut in.
LEVEL = 20
#: Targets of a box; where no more are equal in on, all are looked through as they come.
TOGETHER = 128
#: Boxes of targets in a larger one, and most points of a box.
SUPER, ASKS = 64, 512
#: Numbers of the largest matrix of points and targets in a task.
MATRIX = 1_000_000
DAY = 86_400_000_000


def _cell(lon: Column, lat: Column, level: int) -> tuple[Column, Column]:
    n = 1 << level
    place = lambda x: F.least(F.greatest(F.floor(x * n), F.lit(0)), F.lit(n - 1)).cast("long")
    return place((wrap_lon(lon) + 180) / 360), place((lat + 90) / 180)


def _curve(lon: Column, lat: Column) -> Column:
    """The place of a row's cell on a Z-order curve."""

    def spread(x: Column) -> Column:
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
        return x

    x, y = _cell(lon, lat, LEVEL)
    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1))


def _boxes(rows: DataFrame, on: list[str], order: list[Column | str], size: int, held: list[str], values: tuple[str, str], label: str) -> DataFrame:
    """rows (on, lon, lat, held) in order, cut into boxes of size at most: (on, box, super, rows, what bounds them, least and most of values)."""
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    lon, lat = F.radians("lon"), F.radians("lat")
    axes = {"x": F.cos(lat) * F.cos(lon), "y": F.cos(lat) * F.sin(lon), "z": F.sin(lat)}
    bounds = [f(v).alias(f"{name}_{c}") for c, v in axes.items() for name, f in (("lo", F.min), ("hi", F.max))]
    cut = sorted_rows.groupBy(*on, F.floor(F.col("__at") / size).alias("box"), F.floor(F.col("__at") / (size * SUPER)).alias("super"))
    return materialize(cut.agg(F.collect_list(F.struct(*held)).alias("rows"), *bounds, F.min(values[0]).alias("least"), F.max(values[1]).alias("most")), label)


def _near_boxes(asks: DataFrame, boxes: DataFrame, on: list[str], apart: float | None, tell: Sequence[str]) -> DataFrame:
    """asks (box, on, bounds) with tell of the boxes (on, bounds) equal in on that can hold the nearest target of some point of theirs.

    Distances are squares of chords. No point of an ask's box is farther from a target that counts than the least of the
    greatest distances to boxes that surely have one for each of its points.
    """
    sides = [f"{e}_{c}" for c in "xyz" for e in ("lo", "hi")] + ["least", "most"]
    theirs = boxes.select(*on, *tell, *(F.col(c).alias(f"t_{c}") for c in sides))
    pairs = lambda a: a.join(theirs, on) if on else a.crossJoin(F.broadcast(theirs))
    near, far = (sum((f(c) * f(c) for c in "xyz"), F.lit(0.0)) for f in (lambda c: F.greatest(F.lit(0.0), F.col(f"lo_{c}") - F.col(f"t_hi_{c}"), F.col(f"t_lo_{c}") - F.col(f"hi_{c}")), lambda c: F.greatest(F.col(f"hi_{c}") - F.col(f"t_lo_{c}"), F.col(f"t_hi_{c}") - F.col(f"lo_{c}"))))
    can = surely = F.lit(True)
    if apart is not None:
        below, above = lambda x: F.col(x) - F.col("t_least") > apart, lambda x: F.col("t_most") - F.col(x) > apart
        can = below("most") | above("least")
        surely = below("least") | above("most") | (F.col("t_most") - F.col("t_least") > 2 * apart + 1e-9 * (F.abs("t_most") + F.abs("t_least")))
    bound = pairs(asks).where(can & surely).groupBy("box").agg(F.min(far).alias("bound"))
    bounded = asks.join(bound, "box", "left")
    # Room for rounding is left.
    return pairs(bounded).where(can & (F.col("bound").isNull() | (near <= F.col("bound") + 1e-12))).select(*asks.columns, *tell)


def _unit(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    x, y = np.radians(lon), np.radians(lat)
    return np.column_stack([np.cos(y) * np.cos(x), np.cos(y) * np.sin(x), np.sin(y)])


def _nearest_in(apart: float | None):
    """Of rows (asks, targets), each ask (key, lon, lat, mine) with those of the targets (lon, lat, least, most, row) that are nearest but for rounding."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asks, targets = batch.column("asks"), batch.column("targets")
            ask, target = asks.values, targets.values
            number = lambda a, c: a.field(c).cast(pa.float64()).to_numpy(zero_copy_only=False)
            u, v = _unit(number(ask, "lon"), number(ask, "lat")), _unit(number(target, "lon"), number(target, "lat"))
            if apart is not None:
                mine, least, most = number(ask, "mine"), number(target, "least"), number(target, "most")
            ends, reach = asks.offsets.to_numpy(), targets.offsets.to_numpy()
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for a, b, c, d in zip(ends[:-1], ends[1:], reach[:-1], reach[1:], strict=True):
                if c == d:
                    continue
                step = max(1, MATRIX // int(d - c))
                for lo in range(int(a), int(b), step):
                    hi = min(int(b), lo + step)
                    near = u[lo:hi] @ v[c:d].T
                    if apart is not None:
                        near[~((mine[lo:hi, None] - least[c:d] > apart) | (most[c:d] - mine[lo:hi, None] > apart))] = -9.0
                    best = near.max(1)
                    i, j = np.nonzero((near >= best[:, None] - 1e-14) & (best[:, None] > -5))
                    if not len(i):
                        continue
                    # Chords tell small distances apart where products do not.
                    chord = np.sqrt(((u[lo + i] - v[c + j]) ** 2).sum(1))
                    first = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
                    shortest = np.repeat(np.minimum.reduceat(chord, first), np.diff(np.append(first, len(i))))
                    keep = chord <= shortest + 1e-8 * np.minimum(1.0, shortest) + 1e-14
                    found.append((lo + i[keep], c + j[keep]))
            if found:
                i, j = (pa.array(np.concatenate(x)) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([ask.take(i), target.take(j)], ["ask", "target"])

    return nearest


def nearest_row(points: DataFrame, targets: DataFrame, keys: Sequence[str], columns: Sequence[str], on: Sequence[str] = (), apart: tuple[str, float] | None = None, ties: Sequence[str] = (), radius: float = RADIUS) -> DataFrame:
    """Of each point the nearest target equal in on: (keys, columns of it, km), null where there is none at all.

    points: keys (which tell its rows apart), on, lon, lat; targets: on, lon, lat, columns. apart: a numeric column of
    both; only targets whose value differs from the point's by more than the number count. Of targets equally near, the smallest lon,
    then lat, then ties (columns of targets) is taken. Rows of either side without a position are left out, points
    then have nulls.

    Points and targets are sorted along a curve and cut into boxes of neighbours. Boxes are compared instead of rows,
    large ones of targets first, then those within: kept are those that can hold a target as near as the farthest
    place of another that surely holds one. So neither a large empty space nor a crowd far off makes many pairs, and
    what is moved are points once and a few boxes for each box of points. Where targets equal in on are few (TOGETHER
    at most), nothing is sorted by place.
    """
    inner = [*dict.fromkeys([*columns, *ties])]
    here = "lon is not null and lat is not null and not isnan(lon) and not isnan(lat)"
    on_columns = [f"__on_{c}" for c in on]
    own = F.col(apart[0]).cast("double") if apart else F.lit(None).cast("double")
    row = F.struct(*inner) if inner else F.struct(F.lit(1).alias("one"))
    placed = targets.where(here).select(*(F.col(c).alias(a) for c, a in zip(on, on_columns, strict=True)), own.alias("least"), own.alias("most"), "lon", "lat", row.alias("row"))
    # One target for each place: its first in order of ties. Where a target's row is not asked for, what counts is that there is one.
    order = F.struct(*(F.col("row")[c] for c in ties)) if ties else F.lit(0)
    by_value = ["least", "most"] if apart and columns else []
    spread = [] if by_value else [F.min("least").alias("least"), F.max("most").alias("most")]
    placed = materialize(placed.groupBy(*on_columns, *by_value, "lon", "lat").agg(F.min_by("row", order).alias("row"), *spread), "nearest-targets")
    p = points.where(here).select(*(F.col(c).alias(a) for c, a in zip(on, on_columns, strict=True)), own.alias("mine"), "lon", "lat", F.struct(*keys).alias("key"))
    p = materialize(p, "nearest-points")
    sizes = placed.groupBy(*on_columns).agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
    largest, all_targets = sizes[0] or 0, sizes[1] or 0
    if not largest:
        return points.select(*keys, *(F.lit(None).cast(targets.schema[c].dataType).alias(c) for c in columns), F.lit(None).cast("double").alias("km"))
    placing = [_curve(F.col("lon"), F.col("lat"))] if largest > TOGETHER else []
    # Few points ask in small boxes: a box that reaches far meets many.
    size = max(1, min(ASKS, ASKS * p.count() // all_targets))
    small_batches(points.sparkSession, 4 << 20)
    boxes = _boxes(placed, on_columns, [*on_columns, *placing, "lon", "lat", "least"], TOGETHER, ["lon", "lat", "least", "most", "row"], ("least", "most"), "nearest-target-boxes")
    asks = _boxes(p, on_columns, [*on_columns, *placing, "lon", "lat", *(f"key.{k}" for k in keys)], size, ["key", "lon", "lat", "mine"], ("mine", "mine"), "nearest-point-boxes")
    limit = apart[1] if apart else None
    bare = asks.drop("rows", "super")
    if largest > TOGETHER:
        sides = [F.min(f"lo_{c}").alias(f"lo_{c}") for c in "xyz"] + [F.max(f"hi_{c}").alias(f"hi_{c}") for c in "xyz"]
        large = materialize(boxes.groupBy(*on_columns, "super").agg(*sides, F.min("least").alias("least"), F.max("most").alias("most")), "nearest-large-boxes")
        # Boxes of points and of targets are numbered for themselves; equal in on and of one number is one box.
        bare = bare.withColumn("box", F.struct(*on_columns, "box"))
        bare = materialize(_near_boxes(bare, large, on_columns, limit, ["super"]), "nearest-large-pairs")
        within = boxes.withColumn("target_box", F.col("box")).drop("rows", "box")
        pairs = _near_boxes(bare, within, [*on_columns, "super"], limit, ["target_box"]).withColumn("box", F.col("box.box"))
        pairs = materialize(pairs.select(*on_columns, "box", "target_box"), "nearest-pairs")
    else:
        all_boxes = boxes.select(*on_columns, F.col("box").alias("target_box"))
        pairs = bare.select(*on_columns, "box").join(all_boxes, on_columns) if on else bare.select("box").crossJoin(F.broadcast(all_boxes))
    rows = boxes.select(*on_columns, F.col("box").alias("target_box"), F.col("rows").alias("some"))
    met = pairs.join(rows, [*on_columns, "target_box"]).groupBy(*on_columns, "box").agg(F.flatten(F.collect_list("some")).alias("targets"))
    met = met.join(asks.select(*on_columns, "box", F.col("rows").alias("asks")), [*on_columns, "box"]).select("asks", "targets")
    kinds = T.StructType([T.StructField("ask", met.schema["asks"].dataType.elementType), T.StructField("target", met.schema["targets"].dataType.elementType)])
    found = met.mapInArrow(_nearest_in(limit), kinds).select(*(F.col("ask.key")[k].alias(k) for k in keys), "target", haversine("ask.lon", "ask.lat", "target.lon", "target.lat", radius).alias("km"))
    best = found.groupBy(*keys).agg(F.min_by("target.row", F.struct("km", "target.lon", "target.lat")).alias("row"), F.min("km").alias("km"))
    return points.select(*keys).join(best.select(*keys, *(F.col("row")[c].alias(c) for c in columns), "km"), list(keys), "left")


def nearest_time(times: DataFrame, samples: DataFrame, time: str = "time") -> DataFrame:
    """Rows (time, nearest) for the distinct times: the nearest time of samples, the earlier on a tie; null where there is none.

    Times are dealt to days, which hand on the last time before and the first after (a row for each day).
    """
    sample = samples.where(F.col(time).isNotNull()).select(F.col(time).alias("t")).distinct().withColumn("own", F.col("t"))
    rows = times.where(F.col(time).isNotNull()).select(F.col(time).alias("t")).distinct().withColumn("own", F.lit(None).cast(sample.schema["t"].dataType)).withColumn("asks", F.lit(True)).unionByName(sample.withColumn("asks", F.lit(False)))
    rows = rows.withColumn("day", F.floor(micros("t") / DAY).cast("long"))
    # What follows is what came before in the order turned round: a frame that ends with its partition is gone through anew for each row.
    w, back = Window.partitionBy("day").orderBy("t"), Window.partitionBy("day").orderBy(F.desc("t"))
    rows = rows.withColumns({"before": F.last("own", True).over(w.rangeBetween(Window.unboundedPreceding, 0)), "after": F.last("own", True).over(back.rangeBetween(Window.unboundedPreceding, 0))})
    days = rows.groupBy("day").agg(F.min("own").alias("lo"), F.max("own").alias("hi"))
    over, back = Window.orderBy("day"), Window.orderBy(F.desc("day"))  # a row for each day
    days = days.select("day", F.max("hi").over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"), F.min("lo").over(back.rowsBetween(Window.unboundedPreceding, -1)).alias("later"))
    rows = rows.where("asks").join(days, "day").withColumns({"before": F.coalesce("before", "earlier"), "after": F.coalesce("after", "later")})
    since, until = micros("t") - micros("before"), micros("after") - micros("t")
    return rows.select(F.col("t").alias(time), F.when(F.col("after").isNull() | (since <= until), F.col("before")).otherwise(F.col("after")).alias("nearest"))


def nearest_field_values(points: DataFrame, field: DataFrame, columns: Sequence[str], keys: Sequence[str], time: str = "time") -> DataFrame:
    """points with the columns of the field's row that is nearest in time, then in space among that time's rows with all columns; field_time and km.

    Nulls where the field has no time, or nothing whole at the nearest one. Equal places of the field at one time give the smallest values.
    """
    when = nearest_time(points, field, time)
    asked = points.join(when.withColumnRenamed("nearest", "field_time"), time, "left")
    whole = field.where(" and ".join(f"`{c}` is not null" for c in columns)).withColumnRenamed(time, "field_time")
    asked = materialize(asked, "nearest-asked")
    found = nearest_row(asked.select(*keys, "field_time", "lon", "lat"), whole, keys, columns, ("field_time",), ties=columns)
    return asked.join(found, list(keys), "left")


def nearest_other_lines(points: DataFrame, gap: int = 3, line: str = "branch", place: str = "point", radius: float = RADIUS) -> DataFrame:
    """Of each point of a line the least distance to another line's points (other_km), and to its own line's more than gap places away (self_km)."""
    p = points.select(line, place, "lon", "lat")
    other = nearest_row(p, p, [line, place], [], apart=(line, 0), radius=radius).withColumnRenamed("km", "other_km")
    own = nearest_row(p.withColumn("__line", F.col(line)), p.withColumn("__line", F.col(line)), [line, place], [], ("__line",), (place, gap), radius=radius).withColumnRenamed("km", "self_km")
    return p.join(other, [line, place], "left").join(own, [line, place], "left")
