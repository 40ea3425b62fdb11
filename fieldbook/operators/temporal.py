"""Joins of histories: overlap, containment, as-of."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldbook.functions import ranges


def overlap_join(a: DataFrame, b: DataFrame, on: list[str], lo: str, hi: str, outer: bool = False) -> DataFrame:
    """Pairs of versions of one key whose ranges meet, with the intersection as (lo, hi).

    With ``outer`` every version of a stays: with its own range where nothing meets it. What of a version is not covered is not listed.
    """
    left, right = a.alias("a"), b.select(*on, *[F.col(c).alias(f"_b_{c}") if c in (lo, hi) else F.col(c) for c in b.columns if c not in on]).alias("b")
    meet = reduce(lambda x, y: x & y, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in on]) & ranges.overlaps(F.col(f"a.{lo}"), F.col(f"a.{hi}"), F.col(f"b._b_{lo}"), F.col(f"b._b_{hi}"))
    start, end = ranges.intersection(F.col(f"a.{lo}"), F.col(f"a.{hi}"), F.col(f"b._b_{lo}"), F.col(f"b._b_{hi}"))
    rest = [F.col(f"a.{c}") for c in a.columns if c not in (lo, hi)] + [F.col(f"b.{c}") for c in b.columns if c not in (*on, lo, hi)]
    return left.join(right, meet, "left" if outer else "inner").select(*rest, start.alias(lo), end.alias(hi))


def overlap_join_all(tables: list[DataFrame], on: list[str], lo: str, hi: str) -> DataFrame:
    """N-way join by non-empty intersection; a table without a version of the key does not restrict."""
    return reduce(lambda x, y: overlap_join(x, y, on, lo, hi, outer=True), tables)


def valid_at(df: DataFrame, lo: str, hi: str, at: Column) -> DataFrame:
    return df.filter(ranges.contains(F.col(lo), F.col(hi), at))


def banded_join(points: DataFrame, bands: DataFrame, on: list[str], point: str, lo: str, hi: str, width: int) -> DataFrame:
    """Rows of points inside closed bands [lo, hi] of their key. Bands are listed under the cells of ``width`` they cross, so the join is on equal keys and cells."""
    cells = bands.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    at = points.withColumn("_cell", F.floor(F.col(point) / width))
    return at.join(cells, [*on, "_cell"]).filter(F.col(point).between(F.col(lo), F.col(hi))).drop("_cell")


def parity_side(number: Column) -> Column:
    """Even numbers stand on side L, odd ones on side U."""
    return F.when(number % 2 == 0, "L").otherwise("U")


def stable_rowkeys(history: DataFrame, known: DataFrame, key: list[str], lo: str, rowkey: str, numbered) -> DataFrame:
    """Rowkeys of versions: the known one of the same (key, lower bound), else the next free number."""
    same = [F.col(f"h.{k}").eqNullSafe(F.col(f"k.{k}")) for k in (*key, lo)]
    joined = history.alias("h").join(known.alias("k"), reduce(lambda a, b: a & b, same), "left").select("h.*", F.col(f"k.{rowkey}").alias(rowkey))
    top = known.agg(F.max(rowkey)).first()[0] or 0
    fresh = numbered(joined.filter(F.col(rowkey).isNull()).drop(rowkey), [*key, lo], rowkey, top)
    return joined.filter(F.col(rowkey).isNotNull()).unionByName(fresh)
