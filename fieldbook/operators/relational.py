"""Filters, joins, top rows and paging that registry queries are made of."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldbook.operators.stored import stored


def any_of(column: str, values: list) -> Column:
    """One parameter with several values: OR within it; None asks for missing values."""
    known = [v for v in values if v is not None]
    tests = ([F.col(column).isin(known)] if known else []) + ([F.col(column).isNull()] if None in values else [])
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(True)


def where(df: DataFrame, params: dict[str, list | None]) -> DataFrame:
    """AND across parameters; parameters without a value don't filter."""
    for column, values in params.items():
        if values is not None:
            df = df.filter(any_of(column, values))
    return df


def page(df: DataFrame, key: list[str], number: int | None = None, size: int | None = None, most: int = 25_000) -> DataFrame:
    """Page ``number`` from 1; a size alone means the first page, a number alone pages of 20. Only paged results are ordered."""
    if number is None and size is None:
        return df
    number, size = number or 1, size or 20
    if number < 1 or size < 1 or (number > 1 and number * size > most):
        raise ValueError(f"page {number} of {size} rows is beyond the first {most} rows")
    return df.orderBy(*key).offset((number - 1) * size).limit(size)


def valid_only(df: DataFrame, status: str, good: list, essential: list[str], with_closed: bool = False, with_incomplete: bool = False) -> DataFrame:
    """Rows of a valid status with all essentials, neither null nor empty; ``with_closed`` lets all statuses in, ``with_incomplete`` rows without essentials, each by itself."""
    if not with_closed:
        df = df.filter(F.col(status).isin(good))
    for c in [] if with_incomplete else essential:
        df = df.filter(F.col(c).isNotNull() & (F.col(c).cast("string") != ""))
    return df


def exists(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    return df.join(other.select(*on), on, "left_semi")


def missing(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    return df.join(other.select(*on), on, "left_anti")


def flag_missing(df: DataFrame, other: DataFrame, on: list[str], name: str) -> DataFrame:
    """NOT EXISTS as a column: one row of each key joins, so rows don't multiply."""
    return df.join(other.select(*on).distinct().withColumn("_here", F.lit(True)), on, "left").withColumn(name, F.col("_here").isNull()).drop("_here")


def first_per_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """DISTINCT ON; the order should end in a unique column."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_r = 1").drop("_r")


def latest_as_of(df: DataFrame, key: list[str], version: str, at, op: str | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """The last version of each key up to ``at``; keys whose last operation is a delete are gone."""
    last = first_per_key(df.filter(F.col(version) <= at), key, [F.col(c).desc_nulls_last() for c in (version, *ties)])
    return last if op is None else last.filter(F.col(op) != "delete")


def numbered(df: DataFrame, order: list[str], name: str = "seq", start: int = 0) -> DataFrame:
    """start + 1, 2, ... in order. Sorted ranges are written with their range's number first, then numbered apart and offset by the rows before them.

    No task gets all rows, and a lost executor can't change which range a row is in.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = stored(df.repartitionByRange(parts, *order).withColumn("range_", F.spark_partition_id()), "ranges")
    sizes = held.groupBy("range_").agg(F.count("*").alias("n_"))
    # one row a range, so this window is as small as the number of partitions
    offsets = sizes.select(F.col("range_"), (F.sum("n_").over(Window.orderBy("range_")) - F.col("n_") + start).alias("offset_"))
    within = F.row_number().over(Window.partitionBy("range_").orderBy(*order))
    return held.join(F.broadcast(offsets), "range_").withColumn(name, (F.col("offset_") + within).cast("long")).drop("range_", "offset_")


def with_lookups(df: DataFrame, lookups: list[tuple[DataFrame, dict[str, str]]]) -> DataFrame:
    """Left joins by equal names: each lookup with its columns renamed first, so that what it shares with df is its key."""
    for other, names in lookups:
        renamed = other.select(*[F.col(c).alias(names.get(c, c)) for c in other.columns])
        df = df.join(renamed, [c for c in renamed.columns if c in df.columns], "left")
    return df


def related(df: DataFrame, relations: list[dict]) -> DataFrame:
    """Declared relations joined one after another: dict(table, name, on: {df column: its column}, many). A row becomes a struct; with ``many`` an array of its rows, by value, null where there is none."""
    for r in relations:
        keys = list(r["on"].values())
        side = r["table"].select(*[F.col(c).alias(f"{r['name']}_key_{c}") for c in keys], F.struct("*").alias(r["name"]))
        if r.get("many"):
            side = side.groupBy(*[f"{r['name']}_key_{c}" for c in keys]).agg(F.sort_array(F.collect_list(r["name"])).alias(r["name"]))
        on = reduce(lambda a, b: a & b, [F.col(mine) == F.col(f"{r['name']}_key_{c}") for mine, c in r["on"].items()])
        df = df.join(side, on, "left").drop(*[f"{r['name']}_key_{c}" for c in keys])
    return df


def nested_json(df: DataFrame, group: list[str], fields: dict[str, str], order: list[str], name: str) -> DataFrame:
    """group, name: each group's rows as JSON text of objects in order; fields maps an object's names to columns, nulls stay in it. Left joined, a key without rows has null; ``coalesce`` with '[]' makes it an empty list."""
    each = F.struct(F.struct(*order).alias("order_"), F.struct(*[F.col(c).alias(n) for n, c in fields.items()]).alias("row_"))
    return df.groupBy(*group).agg(F.to_json(F.transform(F.array_sort(F.collect_list(each)), lambda x: x["row_"]), {"ignoreNullFields": "false"}).alias(name))


def with_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Every row with the columns of a relation of one row (a clock, a union of areas), which an aggregate without keys proves."""
    return df.crossJoin(F.broadcast(one.agg(*[F.first(c).alias(c) for c in one.columns])))


def best_groups(df: DataFrame, group: list[str], score: str, edits: str, k: int) -> DataFrame:
    """The k groups of best score, then of fewest edits, then by key."""
    return df.groupBy(*group).agg(F.max(score).alias(score), F.min(edits).alias(edits)).orderBy(F.desc(score), edits, *group).limit(k)


def candidates(df: DataFrame, key: list[str], most: int) -> DataFrame:
    """At most so many rows for a ranking to choose from: those with the lowest keys, so that the choice is the same each time."""
    return df.orderBy(*key).limit(most)


def triggered_order(df: DataFrame, given: dict[str, object], orders: dict[str, list[str]], key: list[str]) -> DataFrame:
    """Ordered by what the given parameters ask for, in the order they are declared, then by key."""
    wanted = [c for p, cs in orders.items() if given.get(p) is not None for c in cs]
    return df.orderBy(*wanted, *key)


def fallback(exact: DataFrame, fuzzy: DataFrame) -> DataFrame:
    """The exact rows, or the fuzzy ones if there are none, as one plan."""
    some = exact.limit(1).select(F.lit(1).alias("_some"))
    return exact.unionByName(fuzzy.join(some, F.lit(True), "left_anti"))
