"""Writers and representations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_ndjson(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path, lineSep="\r\n")


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.mode("overwrite").csv(path, header=True, lineSep="\r\n")


def as_json(df: DataFrame, name: str = "json") -> DataFrame:
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(name))


def point_feature(x: Column, y: Column, properties: list[str], z: Column | None = None) -> Column:
    """A GeoJSON feature as text; with z the coordinates keep their height."""
    coordinates = F.array(x, y) if z is None else F.array(x, y, z)
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), coordinates.alias("coordinates")).alias("geometry"), F.struct(*properties).alias("properties")))


def without_repeats(points: Column) -> Column:
    """Coordinates without heights and without consecutive repeats."""
    flat = F.transform(points, lambda p: F.slice(p, 1, 2))
    return F.filter(flat, lambda p, i: (i == 0) | (p != F.get(flat, i - 1)))


def offload(df: DataFrame, key: list[str], geometry: str, most: int) -> tuple[DataFrame, DataFrame]:
    """(table with a reference in place of large geometries, blobs(ref, geometry)); equal geometries keep one reference."""
    big = F.length(geometry) > most
    ref = F.when(big, F.sha2(geometry, 256))
    table = df.withColumn("ref", ref).withColumn(geometry, F.when(~F.coalesce(big, F.lit(False)), F.col(geometry)))
    return table, df.filter(big).select(F.sha2(geometry, 256).alias("ref"), geometry).dropDuplicates(["ref"])
