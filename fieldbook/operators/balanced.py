"""Rows dealt over as many tasks as they ask for, and joins on equal cells that stay even where one cell holds many rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one cell that stay together.
MOST = 20_000
#: Rows of a task that does much work for each.
SPREAD = 20_000


def spread(df: DataFrame, rows: int = SPREAD, on: list[str] | None = None) -> DataFrame:
    """The same rows, dealt by hash (of ``on``, if given, whose equal values stay together) over tasks of about so many: files are split by bytes, so a small file of many rows would be one task, whatever is made of each row."""
    count = df.count()
    if count <= rows:
        return df
    hashed = on or [f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(count / rows))
    return df.repartition(tasks, *[F.col(f"`{c}`") for c in hashed])


def cell_join(a: DataFrame, b: DataFrame, on: list[str], most: int = MOST) -> DataFrame:
    """a joined with b on equal cells. Rows of b in a cell of more than ``most`` are dealt over shares of it by hash, and rows of a go to all shares of their cell: the same pairs, in as many tasks as b's rows ask for.

    Counts of cells are made before the shuffle; crowded cells are few, one for ``most`` rows at least.
    """
    crowded = b.groupBy(*on).agg(F.count("*").alias("n_")).where(F.col("n_") > most).select(*on, F.ceil(F.col("n_") / most).cast("int").alias("shares_"))
    if crowded.isEmpty():
        return a.join(b, on)
    dealt = b.join(crowded, on, "left").withColumn("share_", F.when(F.col("shares_").isNull(), 0).otherwise(F.pmod(F.xxhash64(*b.columns), F.col("shares_")).cast("int"))).drop("shares_")
    every = a.join(crowded, on, "left").withColumn("share_", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("shares_") - 1, F.lit(0))))).drop("shares_")
    return every.join(dealt, [*on, "share_"]).drop("share_")
