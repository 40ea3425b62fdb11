"""Half-open ranges as pairs of columns (lower, upper); a null bound is infinite."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def is_empty(lo: Column, hi: Column) -> Column:
    return F.coalesce(lo >= hi, F.lit(False))


def contains(lo: Column, hi: Column, point: Column) -> Column:
    return (lo.isNull() | (lo <= point)) & (hi.isNull() | (point < hi))


def overlaps(alo: Column, ahi: Column, blo: Column, bhi: Column) -> Column:
    """Non-empty intersection of two non-empty ranges."""
    return F.coalesce(alo < bhi, F.lit(True)) & F.coalesce(blo < ahi, F.lit(True))


def intersection(alo: Column, ahi: Column, blo: Column, bhi: Column) -> tuple[Column, Column]:
    """greatest and least skip nulls, which is what infinite bounds need here."""
    return F.greatest(alo, blo), F.least(ahi, bhi)


def merged(lo: str, hi: str) -> tuple[Column, Column]:
    """The smallest range that covers a group's ranges: an infinite bound wins."""
    return F.when(F.count_if(F.col(lo).isNull()) == 0, F.min(lo)), F.when(F.count_if(F.col(hi).isNull()) == 0, F.max(hi))


def coalesce_valid_time(df: DataFrame, key: list[str], attrs: list[str], lo: str, hi: str) -> DataFrame:
    """Islands: rows of a key that meet (upper = next lower) and agree in all attributes become one range. A gap or an overlap starts a new island."""
    w = Window.partitionBy(*key).orderBy(F.col(lo).asc_nulls_first())

    def joined(a: dict[str, Column], b: dict[str, Column]) -> Column:
        return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in attrs], a[hi].eqNullSafe(b[lo]) & b[lo].isNotNull())

    here, before, after = ({c: f(c) for c in (*attrs, lo, hi)} for f in (F.col, lambda c: F.lag(c).over(w), lambda c: F.lead(c).over(w)))
    # all in the order of one sort, and no group is gathered: of an island only the first and last rows stay, and the first one looks up its end
    ends = df.select(*key, *attrs, lo, hi, (~joined(before, here)).alias("_first"), (~joined(here, after)).alias("_last")).filter("_first or _last")
    last = F.when(here[hi].isNotNull(), F.greatest(lo, hi))  # the row before it ends at its lower bound
    found = ends.withColumn("_end", F.when(F.col("_last"), here[hi]).otherwise(F.lead(last).over(w)))
    return found.filter("_first").select(*key, *attrs, lo, F.col("_end").alias(hi))


def clip(df: DataFrame, lo: str, hi: str, cut: Column, before: bool) -> DataFrame:
    """Keep what lies before (or from) the cut: ranges beyond go, ranges across are trimmed."""
    a, b = F.col(lo), F.col(hi)
    if before:
        return df.filter(a.isNull() | (a < cut)).withColumn(hi, F.least(b, cut))
    return df.filter(b.isNull() | (b > cut)).withColumn(lo, F.greatest(a, cut))


def reopen_future(df: DataFrame, lo: str, hi: str, now: Column) -> DataFrame:
    """Versions that begin after now go; those that end after it are open."""
    return df.filter(F.col(lo).isNull() | (F.col(lo) <= now)).withColumn(hi, F.when(F.col(hi) <= now, F.col(hi)))


def became_valid(lo: Column, hi: Column, prev: Column, now: Column) -> Column:
    """Rows that began or ended between two clock readings: prev < bound <= now."""
    moved = lambda b: F.coalesce((b > prev) & (b <= now), F.lit(False))
    return moved(lo) | moved(hi)


def clock(registered: str, last: Column, now: Column, seconds: int = 120) -> Column:
    """The reading of the clock of valid time, which never goes back: the last one, now, or the latest registration that is not too far ahead of now."""
    return F.greatest(last, now, F.max(F.when(F.col(registered) <= now + F.make_interval(secs=F.lit(seconds)), F.col(registered))))


def from_change_log(df: DataFrame, key: list[str], ts: str, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """[ts, next ts) for each row of a change log; the earliest begins at minus infinity."""
    w = Window.partitionBy(*key).orderBy(ts)
    return df.withColumn(lo, F.when(F.row_number().over(w) > 1, F.col(ts))).withColumn(hi, F.lead(ts).over(w))


def fill_tail(df: DataFrame, key: list[str], lo: str, hi: str, status: str, gone: int) -> DataFrame:
    """A closing range with a given status after the last end of every key whose history ends."""
    last = df.groupBy(*key).agg(merged(lo, hi)[1].alias(lo)).filter(F.col(lo).isNotNull())
    blank = [F.col(c) if c in (*key, lo) else F.lit(gone).alias(c) if c == status else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns]
    return df.unionByName(last.select(*blank))


def fill_head(df: DataFrame, key: list[str], lo: str, hi: str, origin: Column) -> DataFrame:
    """The first version of every key, carried back to an origin before it."""
    w = Window.partitionBy(*key).orderBy(F.col(lo).asc_nulls_first())
    first = df.withColumn("_r", F.row_number().over(w)).filter((F.col("_r") == 1) & (F.col(lo) > origin)).drop("_r")
    return df.unionByName(first.withColumn(hi, F.col(lo)).withColumn(lo, origin).select(*df.columns))


def overlapping_versions(df: DataFrame, key: list[str], lo: str, hi: str) -> DataFrame:
    """Violations of "no two versions of a key overlap": the version whose upper passes the next lower."""
    w = Window.partitionBy(*key).orderBy(F.col(lo).asc_nulls_first(), F.col(hi).asc_nulls_last())
    return df.withColumn("next_lower", F.lead(lo).over(w)).filter(F.col("next_lower").isNotNull() & F.coalesce(F.col("next_lower") < F.col(hi), F.lit(True)))
