"""Change data: diff, apply, dirty keys, histories, replay."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _differs(a: str, b: str, columns: list[str]) -> Column:
    return reduce(lambda x, y: x | y, [~F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns], F.lit(False))


def diff(source: DataFrame, target: DataFrame, key: list[str], public: list[str] | None = None, deletes: bool = True) -> DataFrame:
    """operation, public and the row (old values where deleted) for every key that differs, from one full outer join.

    An update is public only if one of the ``public`` columns differs; inserts and deletes always are.
    """
    values = [c for c in target.columns if c not in key]
    s, t = source.select(*target.columns, F.lit(True).alias("_in")).alias("s"), target.withColumn("_in", F.lit(True)).alias("t")
    on = reduce(lambda x, y: x & y, [F.col(f"s.{k}") == F.col(f"t.{k}") for k in key])
    op = F.when(F.col("t._in").isNull(), "insert").when(F.col("s._in").isNull(), "delete").when(_differs("s", "t", values), "update")
    shown = F.when(F.col("t._in").isNull() | F.col("s._in").isNull(), True).otherwise(_differs("s", "t", public if public is not None else values))
    row = [F.when(F.col("s._in").isNotNull(), F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in target.columns]
    out = s.join(t, on, "full").select(op.alias("operation"), shown.alias("public"), *row).filter("operation is not null")
    return out if deletes else out.filter("operation <> 'delete'")


def diff_subset(source: DataFrame, target: DataFrame, dirty: DataFrame, key: list[str], **kw) -> DataFrame:
    """The diff of dirty keys only."""
    keys = dirty.select(*key).distinct()
    return diff(source.join(keys, key, "left_semi"), target.join(keys, key, "left_semi"), key, **kw)


def apply(target: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """The target after the changes of one transaction."""
    fresh = changes.filter("operation <> 'delete'").select(*target.columns)
    return target.join(changes.select(*key), key, "left_anti").unionByName(fresh)


def dirty_keys(old: DataFrame, view: DataFrame, changed: DataFrame, key: list[str], reference: list[str]) -> DataFrame:
    """Keys of a derived table that changed rows of a table it refers to may touch: as it was, and as its view is now."""
    refs = changed.select(*reference).distinct()
    return old.join(refs, reference, "left_semi").select(*key).unionByName(view.join(refs, reference, "left_semi").select(*key)).distinct()


def materialize(view: DataFrame, old: DataFrame, dirty: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(new table, its changes) of a derived table from its dirty keys."""
    changes = diff_subset(view, old, dirty, key)
    return apply(old, changes, key), changes


def last_operations(changes: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order])
    return changes.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def for_replica(batch: DataFrame, replica: DataFrame, key: list[str], order: list[str], op: str = "operation") -> DataFrame:
    """A batch as a replica can apply it: last operation of each key; updates of absent keys insert, inserts of present keys update, deletes of absent keys go."""
    here = replica.select(*key).distinct().withColumn("_here", F.lit(True))
    last = last_operations(batch, key, order).join(here, key, "left")
    there = F.col("_here").isNotNull()
    real = F.when((F.col(op) == "delete") & there, "delete").when((F.col(op) != "delete") & there, "update").when(F.col(op) != "delete", "insert")
    return last.withColumn(op, real).filter(F.col(op).isNotNull()).drop("_here")


def invalid_history(changes: DataFrame, key: list[str], order: list[str], op: str = "operation") -> DataFrame:
    """Operations that cannot follow the one before: insert after insert or update; update or delete after nothing or a delete."""
    before = F.lag(op).over(Window.partitionBy(*key).orderBy(*order))
    alive = F.coalesce(F.col("previous") != "delete", F.lit(False))
    return changes.withColumn("previous", before).filter(F.when(F.col(op) == "insert", alive).otherwise(~alive))


def state_differences(replayed: DataFrame, state: DataFrame, key: list[str]) -> DataFrame:
    """Rows in which a replayed history and the table disagree."""
    return diff(replayed, state, key)


def before_after(changes: DataFrame, key: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Each change with the values before it."""
    w = Window.partitionBy(*key).orderBy(*order)
    return changes.select("*", *[F.lag(c).over(w).alias(f"old_{c}") for c in columns])


def column_change_counts(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """How many updates changed each column; pairs has c and old_c."""
    return pairs.agg(F.count("*").alias("total"), *[F.count_if(~F.col(c).eqNullSafe(F.col(f"old_{c}"))).alias(c) for c in columns])


def transitions(pairs: DataFrame, column: str) -> DataFrame:
    """Histogram of (old, new) values of a column."""
    return pairs.filter(~F.col(column).eqNullSafe(F.col(f"old_{column}"))).groupBy(F.col(f"old_{column}").alias("old"), F.col(column).alias("new")).agg(F.count("*").alias("n"))


def geometry_versions(pairs: DataFrame, tx_time: Column, geometry: str) -> DataFrame:
    """changed, geo_changed and geo_version of (old_*, new) pairs of one transaction: a geometry change raises the version, an insert starts at 1."""
    moved = ~F.col(geometry).eqNullSafe(F.col(f"old_{geometry}"))
    fresh = F.col("operation") == "insert"
    return pairs.withColumn("changed", tx_time).withColumn("geo_changed", F.when(fresh | moved, tx_time).otherwise(F.col("old_geo_changed"))).withColumn("geo_version", F.when(fresh, 1).when(moved, F.col("old_geo_version") + 1).otherwise(F.col("old_geo_version")))
