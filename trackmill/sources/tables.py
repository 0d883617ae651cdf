"""Reading, writing and reshaping trajectory tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
CORE = ("trajectory", "obs", "time", "lon", "lat")


def require_columns(df: DataFrame, names) -> DataFrame:
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {', '.join(missing)}")
    return df


def read_trajectories(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Read by suffix: .parquet, .csv (header; a schema is asked for), .json."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind not in ("csv", "json"):
        raise ValueError(f"unknown kind of table: {path}")
    if schema is None:
        raise ValueError("text tables need a schema")
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if kind == "csv" else reader.json(path)


def save_table(df: DataFrame, path: str, kind: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    writer = df.write.partitionBy(*partition_by)
    if kind == "parquet":
        writer.parquet(path)
    elif kind == "csv":
        # Microseconds: Spark's own format stops at milliseconds.
        writer.option("header", True).option("timestampFormat", MICROS).option("timestampNTZFormat", MICROS).csv(path)
    else:
        raise ValueError(f"unknown kind of table: {kind}")


def get_or_build(spark: SparkSession, path: str, required, build) -> DataFrame:
    """The table at path if it has every required column, else what build() returns."""
    try:
        found = spark.read.parquet(path)
    except Exception as error:  # a missing path is an AnalysisException of any reader
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        return build()
    return found if set(required) <= set(found.columns) else build()


def resolve_schema(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename configured columns to the core names; KeyError where one is missing."""
    require_columns(df, names.values())
    return df.withColumnsRenamed({v: k for k, v in names.items()})


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN is missing from here on."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def split_roles(df: DataFrame, key: str = "trajectory") -> tuple[list[str], list[str]]:
    """Metadata columns (one value a trajectory) and observation columns (arrays)."""
    arrays = [f.name for f in df.schema if isinstance(f.dataType, T.ArrayType)]
    return [c for c in df.columns if c not in arrays and c != key], arrays


def arrays_to_rows(df: DataFrame, key: str = "trajectory") -> DataFrame:
    """One row a trajectory with parallel arrays to one row an observation; shorter arrays end in nulls."""
    scalars, arrays = split_roles(df, key)
    rows = df.select(key, *scalars, F.posexplode(F.arrays_zip(*arrays)).alias("obs", "x"))
    return rows.select(key, F.col("obs").cast("long").alias("obs"), *scalars, *(F.col(f"x.{c}").alias(c) for c in arrays))


def rows_to_arrays(df: DataFrame, observed: list[str], meta: list[str] = (), key: str = "trajectory", order: str = "obs") -> DataFrame:
    """One row a trajectory: arrays in order of obs, metadata as first non-null value."""
    item = F.sort_array(F.collect_list(F.struct(order, *observed))).alias("x")
    grouped = df.groupBy(key).agg(item, *(F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in meta))
    return grouped.select(key, *meta, *(F.col(f"x.{c}").alias(c) for c in observed))


def expand_members(df: DataFrame, members: int = 5) -> DataFrame:
    """Wide lon_i, lat_i to a row for each member up to group_size; ids get _m<i>, source_trajectory keeps the old one."""
    wide = [f"{c}_{i}" for i in range(1, members + 1) for c in ("lon", "lat")]
    points = F.array(*(F.struct(F.col(f"lon_{i}").alias("lon"), F.col(f"lat_{i}").alias("lat")) for i in range(1, members + 1)))
    kept = [c for c in df.columns if c not in wide and c not in ("lon", "lat", "trajectory")]
    rows = df.select("trajectory", *kept, F.posexplode(points).alias("i", "p")).where(F.col("i") < F.col("group_size"))
    member = (F.col("i") + 1).cast("int")
    return rows.select(F.concat(F.col("trajectory").cast("string"), F.lit("_m"), member.cast("string")).alias("trajectory"), *kept, member.alias("group_member"), F.col("p.lon").alias("lon"), F.col("p.lat").alias("lat"), F.col("trajectory").alias("source_trajectory"))


def merge_files(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union by name; of rows that repeat the keys, the one of the last frame stays."""
    tagged = [f.withColumn("__file", F.lit(i)) for i, f in enumerate(frames)]
    whole = tagged[0]
    for f in tagged[1:]:
        whole = whole.unionByName(f, allowMissingColumns=True)
    return first_row(whole, keys, [F.desc("__file")]).drop("__file")


def first_row(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row for each key: the first in order. The order has to be total for a determined result."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rank = 1").drop("__rank")


def surface_fix(df: DataFrame, keys=("platform", "time", "lat", "lon"), pressure: str = "pressure", tie: str = "obs") -> DataFrame:
    """The row of least pressure of each fix; rows without pressure come last."""
    return first_row(df, list(keys), [F.asc_nulls_last(pressure), tie])


def read_profiles(spark: SparkSession, path: str, required: list[str], optional: list[str] = (), pressure: tuple[str, ...] = ("PRES_ADJUSTED", "PRES")) -> DataFrame:
    """Profile CSV: required columns, the first pressure column there is, UTC times, whole-number platforms."""
    raw = require_columns(spark.read.option("header", True).csv(path), required)
    found = next((c for c in pressure if c in raw.columns), None)
    number = lambda c: F.col(c).try_cast("double")
    code = number(required[0])
    out = raw.select(
        F.when(code == F.floor(code), code.cast("long")).otherwise(F.raise_error(F.concat(F.lit("platform is not a whole number: "), F.coalesce(required[0], F.lit("null"))))).alias("platform"),
        F.try_to_timestamp(F.col(required[1])).cast("timestamp_ntz").alias("time"), number(required[2]).alias("lat"), number(required[3]).alias("lon"),
        (number(found) if found else F.lit(None).cast("double")).alias("pressure"), *(number(c).alias(c) for c in optional if c in raw.columns),
    )
    return out.where("time is not null and lat is not null and lon is not null")


def read_drifters(spark: SparkSession, path: str) -> DataFrame:
    """Drifter CSV: ISO times, numbers, drogue length from text; rows without a valid fix go."""
    raw = require_columns(spark.read.option("header", True).csv(path), ["ID", "time", "latitude", "longitude"])
    lost = F.try_to_timestamp(F.col("drogue_lost_date")).cast("timestamp_ntz") if "drogue_lost_date" in raw.columns else F.lit(None).cast("timestamp_ntz")
    length = drogue_length(F.col("DrogueLength")) if "DrogueLength" in raw.columns else F.lit(None).cast("double")
    rows = raw.select(F.col("ID").alias("platform"), F.try_to_timestamp("time").cast("timestamp_ntz").alias("time"), F.col("latitude").try_cast("double").alias("lat"), F.col("longitude").try_cast("double").alias("lon"), lost.alias("drogue_lost"), length.alias("drogue_length"))
    return rows.where("platform is not null and time is not null and lat between -90 and 90 and lon is not null")


def drogue_length(text: Column) -> Column:
    """The first number of a text with a unit."""
    return F.regexp_extract(text, r"(-?[0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")


def read_text_fixes(spark: SparkSession, path: str, marker: str = "*END OF HEADER") -> DataFrame:
    """White-space separated fixes below a header line: any, date, time, lat, lon, at-sea flag; the id is the file's name."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value"))
    body = lines.select("file", F.explode(F.split(F.substring_index("value", marker, -1), r"\r?\n")).alias("line"))
    # What comes out of a generator is made once for a line; a filter on a projection would make it again.
    once = lambda c, name: F.explode(F.array(c)).alias(name)
    parted = body.select("file", once(F.split(F.trim("line"), r"\s+"), "f")).where("size(f) >= 6")
    f = F.col("f")
    fix = F.struct(F.try_to_timestamp(F.concat_ws(" ", f[1], f[2]), F.lit("yyyy/MM/dd HH:mm:ss")).cast("timestamp_ntz").alias("time"), f[3].try_cast("double").alias("lat"), f[4].try_cast("double").alias("lon"), f[5].try_cast("int").alias("at_sea"))
    fields = parted.select(F.regexp_extract("file", r"^([^.]+)", 1).alias("platform"), once(fix, "fix")).select("platform", "fix.*")
    return fields.where("time is not null and lat is not null and lon is not null")


def write_lines_geojson(df: DataFrame, path: str, line: str, order: str, lon: str = "lon", lat: str = "lat", properties: list[str] = ()) -> None:
    """One GeoJSON feature a row: lines in order, parted where a step crosses the antimeridian; parts of two points or more."""
    from trackmill.operators.segments import antimeridian_parts

    parts = antimeridian_parts(df, [line], order, lon).groupBy(line, "part").agg(F.sort_array(F.collect_list(F.struct(order, lon, lat))).alias("p"), *(F.first(c).alias(c) for c in properties))
    shape = F.struct(F.lit("LineString").alias("type"), F.transform("p", lambda x: F.array(x[lon], x[lat])).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(line, "part", *properties).alias("properties"), shape.alias("geometry"))
    parts.where(F.size("p") >= 2).select(F.to_json(feature).alias("value")).write.text(path)


def float_rows(raw: DataFrame, fields: dict[str, tuple[str, ...]], keep: tuple[str, ...] = ("platform_code", "cycle_number", "source_index")) -> DataFrame:
    """One row a measurement of a float: each field from the first of its columns with a value (adjusted before raw), and <field>_source, the column it came from.

    Columns that the table lacks are passed over; KeyError where it has none of a field's.
    """
    out = require_columns(raw, keep)
    found = {f: [c for c in names if c in raw.columns] for f, names in fields.items()}
    if missing := [f for f, names in found.items() if not names]:
        raise KeyError(f"no column for: {', '.join(missing)}")
    source = {f"{f}_source": F.coalesce(*(F.when(F.col(c).isNotNull(), F.lit(c)) for c in names)) for f, names in found.items()}
    return out.select(*keep, *(F.coalesce(*names).alias(f) for f, names in found.items()), *(c.alias(k) for k, c in source.items()))


def finalize_trajectory(df: DataFrame, depth: str = "depth", internal: tuple[str, ...] = (), keys: tuple[str, ...] = ("trajectory",)) -> DataFrame:
    """depth becomes z, internal columns go, and each trajectory's rows stand together in order of time."""
    return df.withColumnRenamed(depth, "z").drop(*internal).repartition(*keys).sortWithinPartitions(*keys, "time")


def with_codes(df: DataFrame, codes: DataFrame, key: str, code: str, missing: int | None = None) -> DataFrame:
    """df with the code of each key from a table of (key, code); missing where it has none."""
    joined = df.join(codes.select(key, code), key, "left")
    return joined if missing is None else joined.withColumn(code, F.coalesce(code, F.lit(missing)))


def write_by_bin(df: DataFrame, path: str, column: str = "depth_bin", keys: tuple[str, ...] = ("trajectory",)) -> None:
    """A folder for each bin that has rows, with trajectory ids and obs numbered from 0 in each."""
    from trackmill.operators.segments import numbered

    rows = df.where(F.col(column).isNotNull())
    ids = numbered(rows, [column, *keys], "__id")
    first = ids.groupBy(column).agg(F.min("__id").alias("__first"))
    placed = ids.join(first, column).select(column, *keys, (F.col("__id") - F.col("__first")).alias("__new"))
    obs = (F.row_number().over(Window.partitionBy(column, "__new").orderBy("time")) - 1).cast("long")
    out = rows.join(placed, [column, *keys]).withColumn("obs", obs).drop("trajectory").withColumnRenamed("__new", "trajectory")
    out.write.partitionBy(column).parquet(path)


def externalize_names(df: DataFrame, length: str, rate: str) -> DataFrame:
    """Internal names to public ones: _length and _rate endings become those of their units, leading x_ and y_ lon_ and lat_."""
    named = {}
    for c in df.columns:
        new = c.removesuffix("_length") + f"_{length}" if c.endswith("_length") else c.removesuffix("_rate") + f"_{rate}" if c.endswith("_rate") else c
        named[c] = "lon_" + new[2:] if new.startswith("x_") else "lat_" + new[2:] if new.startswith("y_") else new
    return df.withColumnsRenamed(named)


def numeric_columns(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Number and truth columns alone (and keep), as cross sections are exported."""
    kinds = (T.NumericType, T.BooleanType)
    return df.select(*(f.name for f in df.schema if isinstance(f.dataType, kinds) or f.name in keep))
