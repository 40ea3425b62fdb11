"""Readers of registry files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def csv(spark: SparkSession, path: str, schema: StructType | str, sep: str = ";") -> DataFrame:
    """Registry CSV: semicolons, double quotes, backslash escapes, a header. A row that doesn't fit stops the read."""
    return spark.read.csv(path, schema=schema, sep=sep, quote='"', escape="\\", header=True, mode="FAILFAST")


def ndjson(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One JSON object per line, gzip included; a row that doesn't fit stops the read."""
    return spark.read.json(path, schema=schema, mode="FAILFAST")


def rows(spark: SparkSession, data: list[tuple], schema: StructType | str) -> DataFrame:
    return spark.createDataFrame(data, schema)


def geojson(spark: SparkSession, path: str, properties: str, coordinates: str = "array<double>") -> DataFrame:
    """The features of a FeatureCollection: their properties, geometry type and coordinates."""
    schema = f"type string, features array<struct<type:string, properties:struct<{properties}>, geometry:struct<type:string, coordinates:{coordinates}>>>"
    features = spark.read.json(path, schema=schema, multiLine=True).select(F.explode("features").alias("f"))
    return features.select("f.properties.*", F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"))


def xml(spark: SparkSession, path: str, row_tag: str, schema: StructType | str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def fixed_width(spark: SparkSession, path: str, fields: list[tuple[str, int, int]], record: str | None = None) -> DataFrame:
    """Fields (name, start from 1, width) of a fixed-width file, trimmed, empty ones null; ``record`` keeps lines that begin with it."""
    lines = spark.read.text(path)
    lines = lines if record is None else lines.filter(F.col("value").startswith(record))
    return lines.select(*[F.nullif(F.trim(F.substring("value", at, width)), F.lit("")).alias(name) for name, at, width in fields])


def local_to_utc(stamp: Column, pattern: str, zone: str = "Europe/Copenhagen") -> Column:
    """A local date and time as text, in UTC; sentinels that are no date become null."""
    return F.to_utc_timestamp(F.try_to_timestamp(stamp, F.lit(pattern)), zone)


def merge_events(df: DataFrame, key: str, created: str, updated: str) -> DataFrame:
    """Rows of one key become one: the creating event's number of the first, the updating event's of the last, other columns of the last."""
    rest = [c for c in df.columns if c not in (key, created, updated)]
    return df.groupBy(key).agg(F.min(created).alias(created), F.max(updated).alias(updated), *[F.max_by(c, F.coalesce(updated, F.lit(0))).alias(c) for c in rest]).select(*df.columns)


def admit(df: DataFrame, key: str, order: list[str], ranges: list[tuple[str, str]]) -> DataFrame:
    """First row of each key; rows whose ranges are inverted or empty are dropped."""
    for lo, hi in ranges:
        df = df.filter(F.col(lo).isNull() | F.col(hi).isNull() | (F.col(lo) < F.col(hi)))
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_r = 1").drop("_r")


def new_files(listed: DataFrame, imported: int, total: str = "NA|TE", delta: str = "DA") -> DataFrame:
    """Files still to import from listed(name), which hold a kind code and a serial: those after the last imported one, from the last total on. A serial that comes twice is an error."""
    serial = F.regexp_extract("name", r"_([0-9]{5})_", 1).cast("long")
    kind = F.regexp_extract("name", rf"_({total}|{delta})[0-9]{{3}}_", 1)
    files = listed.select("name", serial.alias("serial"), kind.alias("kind"))
    if not files.groupBy("serial").count().filter("count > 1").isEmpty():
        raise ValueError("two files have the same serial")
    start = files.filter(F.col("kind").isin(total.split("|"))).agg(F.max("serial")).first()[0] or 0
    return files.filter((F.col("serial") >= start) & (F.col("serial") > imported)).orderBy("serial")


def height(z: Column) -> Column:
    """Heights to a tenth, halves upward; -9999 is missing."""
    return F.when(z != -9999, F.floor(z * 10 + 0.5) / 10)
