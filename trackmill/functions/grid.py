"""Regular longitude-latitude grids as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackmill.functions.geo import floor_mod

AGGREGATES = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "median": F.median, "std": F.stddev_samp, "count": F.count}


@dataclass(frozen=True)
class RegularGrid:
    """Half-open cells [min, max) of equal spacing, counted from the lower bounds."""

    lon_min: float
    lon_max: float
    lat_min: float
    lat_max: float
    lon_step: float
    lat_step: float

    def __post_init__(self) -> None:
        if self.lon_step <= 0 or self.lat_step <= 0 or self.lon_max <= self.lon_min or self.lat_max <= self.lat_min:
            raise ValueError("bounds must increase and steps be positive")

    @property
    def nx(self) -> int:
        return round((self.lon_max - self.lon_min) / self.lon_step)

    @property
    def ny(self) -> int:
        return round((self.lat_max - self.lat_min) / self.lat_step)

    @property
    def periodic(self) -> bool:
        return abs(self.lon_max - self.lon_min - 360.0) < 1e-9

    def contains(self, lon: Column, lat: Column) -> Column:
        return (lon >= self.lon_min) & (lon < self.lon_max) & (lat >= self.lat_min) & (lat < self.lat_max)

    def lon_bin(self, lon: Column) -> Column:
        return F.floor((lon - self.lon_min) / self.lon_step).cast("long")

    def lat_bin(self, lat: Column) -> Column:
        return F.floor((lat - self.lat_min) / self.lat_step).cast("long")

    def lon_center(self, b: Column) -> Column:
        return self.lon_min + (b + 0.5) * self.lon_step

    def lat_center(self, b: Column) -> Column:
        return self.lat_min + (b + 0.5) * self.lat_step

    def wrapped(self, lon: Column) -> Column:
        """Longitude moved by whole turns into the grid where that puts it inside."""
        return floor_mod(lon - self.lon_min, 360.0) + self.lon_min

    def assign(self, df: DataFrame, lon: str = "lon", lat: str = "lat", prefix: str = "") -> DataFrame:
        """Rows inside the grid with their bins and centres; rows outside or without a position go."""
        inside = df.where(self.contains(F.col(lon), F.col(lat)))
        bins = inside.withColumns({f"{prefix}lon_bin": self.lon_bin(F.col(lon)), f"{prefix}lat_bin": self.lat_bin(F.col(lat))})
        return bins.withColumns({f"{prefix}lon_center": self.lon_center(F.col(f"{prefix}lon_bin")), f"{prefix}lat_center": self.lat_center(F.col(f"{prefix}lat_bin"))})

    def aggregate(self, df: DataFrame, value: str, how: str = "mean", lon: str = "lon", lat: str = "lat") -> DataFrame:
        """One of AGGREGATES of a value in each cell with rows; nulls are skipped."""
        return self.assign(df, lon, lat).groupBy("lon_bin", "lat_bin", "lon_center", "lat_center").agg(AGGREGATES[how](value).alias("value"))

    def cells(self, spark) -> DataFrame:
        """All cells of the grid: nx * ny rows, made from one range."""
        rows = spark.range(self.nx * self.ny).select(F.pmod("id", F.lit(self.nx)).alias("lon_bin"), F.floor(F.col("id") / self.nx).cast("long").alias("lat_bin"))
        return rows.withColumns({"lon_center": self.lon_center(F.col("lon_bin")), "lat_center": self.lat_center(F.col("lat_bin"))})

    def densify(self, sparse: DataFrame, value: str = "value", fill: float | None = None) -> DataFrame:
        """Every cell, with fill (null by default) where sparse has none."""
        cells = self.cells(sparse.sparkSession)
        out = cells.join(sparse.select("lon_bin", "lat_bin", value), ["lon_bin", "lat_bin"], "left")
        return out if fill is None else out.withColumn(value, F.coalesce(value, F.lit(fill)))


def spacing_table(df: DataFrame, column: str, digits: int = 6) -> DataFrame:
    """One row (spacing): the smallest gap of sorted distinct values that occurs twice at least, else the smallest; null below two values."""
    from pyspark.sql import Window

    values = df.where(F.col(column).isNotNull()).select(F.round(column, digits).alias("v")).distinct()
    part = values.withColumn("p", F.floor(F.col("v") / 1000))
    last = part.groupBy("p").agg(F.max("v").alias("top"))
    before = last.withColumn("before", F.lag("top").over(Window.orderBy("p"))).select("p", "before")
    gap = F.col("v") - F.coalesce(F.lag("v").over(Window.partitionBy("p").orderBy("v")), "before")
    gaps = part.join(before, "p").select(F.round(gap, digits).alias("gap")).where("gap > 0").groupBy("gap").count()
    return gaps.agg(F.coalesce(F.min(F.when(F.col("count") > 1, F.col("gap"))), F.min("gap")).alias("spacing"))


def infer_spacing(df: DataFrame, column: str, digits: int = 6) -> float | None:
    """The spacing of spacing_table."""
    return spacing_table(df, column, digits).first()["spacing"]


def grid_from_centers(df: DataFrame, lon: str = "lon", lat: str = "lat") -> RegularGrid:
    """The grid whose cell centres are the distinct positions of df."""
    row = df.agg(F.min(lon).alias("x0"), F.max(lon).alias("x1"), F.min(lat).alias("y0"), F.max(lat).alias("y1")).first()
    dx, dy = infer_spacing(df, lon) or 1.0, infer_spacing(df, lat) or 1.0
    return RegularGrid(row["x0"] - dx / 2, row["x1"] + dx / 2, row["y0"] - dy / 2, row["y1"] + dy / 2, dx, dy)
