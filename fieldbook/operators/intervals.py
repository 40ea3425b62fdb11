"""Interval sets of groups: priority, extension, boxes of two intervals, and the algebra of single intervals with open and closed ends."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a group from which on it is cut into ranges of its own, and how many.
LARGE, RANGES = 200_000, 64


# Priority


def highest(first: np.ndarray, end: np.ndarray, rank: np.ndarray, places: int) -> np.ndarray:
    """The highest rank of the intervals [first, end) over each place, -1 where there is none.

    An interval is covered by two runs whose length is a power of two; ranks are noted by run, and handed down from
    each length to the two halves of it. So n intervals take n log n steps, however long they are.
    """
    size = end - first
    level = np.frexp(np.maximum(size, 1).astype(float))[1] - 1
    levels = int(level.max(initial=0)) + 1
    above = np.full(places, -1, np.int64)
    for k in reversed(range(levels)):
        here = np.full(places, -1, np.int64)
        mine = (level == k) & (size > 0)
        np.maximum.at(here, first[mine], rank[mine])
        np.maximum.at(here, end[mine] - (1 << k), rank[mine])
        if k < levels - 1:
            np.maximum(here, above, out=here)
            half = 1 << k
            here[half:] = np.maximum(here[half:], above[:-half])
        above = here
    return above


def codes(table: pa.Table, columns: list[str]) -> np.ndarray:
    """Equal rows of some columns get equal numbers; nulls are equal."""
    out = np.zeros(table.num_rows, np.int64)
    for c in columns:
        encoded = table.column(c).combine_chunks().dictionary_encode(null_encoding="encode")
        mine = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        out = np.unique(out * (int(mine.max(initial=0)) + 1) + mine, return_inverse=True)[1]
    return out


def ranked_runs(table: pa.Table, group: list[str], order: list[str]) -> pa.Table:
    """The intervals lo_, hi_ (null: without end) of a table's groups without overlaps, and their ref_; all groups at once."""
    out_names = [*group, "lo_", "hi_", "ref_"]
    n = table.num_rows
    gid = codes(table, group)
    by = pc.sort_indices(table, sort_keys=[(c, "ascending") for c in order], null_placement="at_start").to_numpy()
    rank = np.empty(n, np.int64)
    rank[by] = np.arange(n)
    lo, hi = table.column("lo_").combine_chunks(), table.column("hi_").combine_chunks()
    both = pa.concat_arrays([lo, hi])
    place = pc.rank(both, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
    missing = both.is_null().to_numpy(zero_copy_only=False)
    top = int(place.max(initial=0)) + 1
    place = np.where(missing, np.where(np.arange(2 * n) < n, 0, top), place)
    bounds, at = np.unique(np.concatenate([gid, gid]) * (top + 1) + place, return_inverse=True)
    sample = np.zeros(len(bounds), np.int64)
    sample[at] = np.arange(2 * n)
    best = highest(at[:n], at[n:], rank, len(bounds))
    piece = np.flatnonzero(best >= 0)
    row = by[best[piece]]
    ref, owner = codes(table, ["ref_"])[row], gid[row]
    new = np.ones(len(piece), bool)
    new[1:] = (ref[1:] != ref[:-1]) | (owner[1:] != owner[:-1]) | (piece[1:] != piece[:-1] + 1)
    begin = np.flatnonzero(new)
    final = np.append(begin[1:], len(piece)) - 1 if len(piece) else begin
    columns = [table.column(c).take(row[begin]) for c in group] + [both.take(pa.array(sample[piece[begin]])), both.take(pa.array(sample[piece[final] + 1] if len(piece) else piece)), table.column("ref_").take(row[begin])]
    return pa.table(columns, names=out_names)


def resolve(df: DataFrame, group: list[str], order: list[str], lo: str, hi: str, ref: str, extend: bool = False, large: int = LARGE) -> DataFrame:
    """Per group, half-open intervals without overlaps: where rows meet, the last in the given order wins; equal neighbours that touch become one.

    A null bound is without end; inverted and empty intervals are none. With ``extend`` the groups' intervals reach without end both ways: a gap belongs to the
    interval after it, the first one begins and the last one ends without bound. Groups are worked on together, many in an Arrow table; a group of more than
    ``large`` rows is cut at quantiles of its lower bounds into ranges of their own, and only runs that meet a cut are joined afterwards.
    """
    keys = [f"o{k}_" for k in range(len(order))]
    some = F.col(lo).isNull() | F.col(hi).isNull() | (F.col(lo) < F.col(hi))
    rows = df.filter(some).select(*group, F.col(lo).alias("lo_"), F.col(hi).cast(df.schema[lo].dataType).alias("hi_"), F.col(ref).alias("ref_"), *[F.col(c).alias(k) for k, c in zip(keys, order, strict=True)])
    crowded = rows.groupBy(*group).agg(F.count("*").alias("n_"), F.percentile_approx("lo_", [k / RANGES for k in range(1, RANGES)]).alias("cuts_")).where(F.col("n_") > large)
    crowded = crowded.select(*group, F.array_distinct("cuts_").alias("cuts_"), F.lit(True).alias("large_"))
    cut = not crowded.isEmpty()
    if cut:
        same = [F.col(f"r.{g}").eqNullSafe(F.col(f"c.{g}")) for g in group]
        both = rows.alias("r").join(crowded.alias("c"), same, "left").select("r.*", "cuts_")
        first = F.when(F.col("lo_").isNull(), 0).otherwise(F.size(F.filter("cuts_", lambda x: x <= F.col("lo_"))))
        last = F.when(F.col("hi_").isNull(), F.size("cuts_")).otherwise(F.size(F.filter("cuts_", lambda x: x < F.col("hi_"))))
        listed = both.withColumn("range_", F.explode(F.when(F.col("cuts_").isNull(), F.array(F.lit(0))).otherwise(F.sequence(first, last))))
        low, high = F.get("cuts_", F.col("range_") - 1), F.get("cuts_", F.col("range_"))
        rows = listed.withColumn("lo_", F.greatest("lo_", low)).withColumn("hi_", F.least("hi_", high)).drop("cuts_")
    else:
        rows = rows.withColumn("range_", F.lit(0))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4
    dealt = rows.withColumn("bucket_", F.pmod(F.xxhash64(*group, "range_"), F.lit(parts)))
    kept = [*group, "range_"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept, "lo_", "hi_", "ref_").schema)
    runs = dealt.groupBy("bucket_").applyInArrow(lambda table: ranked_runs(table, kept, keys), schema)
    runs = _joined(runs, group, crowded) if cut else runs.drop("range_")
    if extend:
        runs = _extended(runs, group)
    return runs.select(*group, F.col("lo_").alias(lo), F.col("hi_").alias(hi), F.col("ref_").alias(ref))


def _islands(runs: DataFrame, group: list[str], new: Column) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(F.col("lo_").asc_nulls_first())
    marked = runs.withColumn("new_", F.when(new, 1).otherwise(0)).withColumn("run_", F.sum("new_").over(w))
    ends = F.max(F.struct(F.col("hi_").isNull().alias("open"), F.col("hi_").alias("hi")))["hi"]
    starts = F.min(F.struct(F.col("lo_").isNotNull().alias("closed"), F.col("lo_").alias("lo")))["lo"]
    return marked.groupBy(*group, "run_").agg(starts.alias("lo_"), ends.alias("hi_"), F.first("ref_").alias("ref_")).drop("run_")


def _joined(runs: DataFrame, group: list[str], crowded: DataFrame) -> DataFrame:
    """Runs of one ref that touch at a cut become one. Only runs with an end on a cut are looked at, at most two a range."""
    same = [F.col(f"r.{g}").eqNullSafe(F.col(f"c.{g}")) for g in group]
    both = runs.drop("range_").alias("r").join(crowded.alias("c"), same, "left").select("r.*", "cuts_")
    at_cut = F.coalesce(F.array_contains("cuts_", F.col("lo_")), F.lit(False)) | F.coalesce(F.array_contains("cuts_", F.col("hi_")), F.lit(False))
    marked = both.withColumn("at_cut_", at_cut).drop("cuts_")
    w = Window.partitionBy(*group).orderBy(F.col("lo_").asc_nulls_first())
    apart = ~(F.lag("hi_").over(w).eqNullSafe(F.col("lo_")) & F.lag("ref_").over(w).eqNullSafe(F.col("ref_")) & F.col("lo_").isNotNull())
    return marked.where(~F.col("at_cut_")).drop("at_cut_").unionByName(_islands(marked.where("at_cut_").drop("at_cut_"), group, apart))


def _extended(runs: DataFrame, group: list[str]) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(F.col("lo_").asc_nulls_first())
    whole = _islands(runs, group, ~F.lag("ref_").over(w).eqNullSafe(F.col("ref_")) | (F.row_number().over(w) == 1))
    return whole.withColumn("lo_", F.lag("hi_").over(w)).withColumn("hi_", F.when(F.lead("ref_").over(w).isNotNull() | (F.row_number().over(w) < F.count("*").over(Window.partitionBy(*group))), F.col("hi_")))


def names_extended(df: DataFrame, street: list[str], lo: str, hi: str, ref: str) -> DataFrame:
    """A street's names without end both ways: where names overlap, the one that began last holds."""
    return resolve(df, street, [lo], lo, hi, ref, extend=True)


# Boxes


def _strips(df: DataFrame, group: list[str], y0: str, y1: str) -> DataFrame:
    """A row for each strip between neighbouring y bounds of the group that a box covers, with the strip's bounds as y0_, y1_."""
    ends = df.select(*group, F.col(y0).alias("y_")).union(df.select(*group, F.col(y1))).distinct()
    w = Window.partitionBy(*group).orderBy(F.col("y_"))
    numbered = ends.select(*group, "y_", F.row_number().over(w).alias("strip_"), F.lead("y_").over(w).alias("y1_"))
    at = lambda c, name: numbered.select(*group, F.col("y_").alias(c), F.col("strip_").alias(name))
    placed = df.join(at(y0, "from_"), [*group, y0]).join(at(y1, "to_"), [*group, y1])
    listed = placed.withColumn("strip_", F.explode(F.sequence("from_", F.col("to_") - 1))).drop("from_", "to_")
    return listed.join(numbered.select(*group, "strip_", F.col("y_").alias("y0_"), "y1_"), [*group, "strip_"])


def boxes(df: DataFrame, group: list[str], order: list[str], x: tuple[str, str], y: tuple[str, str], ref: str, extend: bool = False) -> DataFrame:
    """Per group, half-open boxes (time by house number, say) without overlaps: where boxes meet, the last in the given order wins.

    The plane is swept in strips between neighbouring y bounds; in a strip boxes are intervals of x, and ``resolve`` decides. Strips that are alike
    and touch become one box again, so the result does not depend on how the boxes came. With ``extend`` every strip is extended both ways along x. Bounds of y must be
    there; bounds of x may be null, without end.
    """
    rows = df.filter(F.col(y[0]) < F.col(y[1]))
    strips = _strips(rows, group, *y)
    flat = resolve(strips, [*group, "strip_", "y0_", "y1_"], order, *x, ref, extend)
    alike = [*group, *x, ref]
    w = Window.partitionBy(*alike).orderBy("strip_")
    marked = flat.withColumn("new_", F.when(F.lag("y1_").over(w).eqNullSafe(F.col("y0_")), 0).otherwise(1)).withColumn("run_", F.sum("new_").over(w))
    return marked.groupBy(*alike, "run_").agg(F.min("y0_").alias(y[0]), F.max("y1_").alias(y[1])).select(*group, *x, *y, ref)


def streets_extended(df: DataFrame, street: list[str], x: tuple[str, str], y: tuple[str, str], ref: str, everywhere: tuple[int, int]) -> DataFrame:
    """A street's boxes extended without end in time. Boxes that reach over all house numbers (bounds ``everywhere``) are older layers: those with a bound win over them, then the later ones."""
    open_ends = F.when(F.col(y[0]) == everywhere[0], 1).otherwise(0) + F.when(F.col(y[1]) == everywhere[1], 1).otherwise(0)
    return boxes(df.withColumn("ends_", -open_ends).withColumn("begin_", F.col(x[0])), street, ["ends_", "begin_", ref], x, y, ref, extend=True)


# Single intervals. A bound with its kind is a cut of the line: before a value or after it, so all intervals are half-open between cuts


def cut_of(value: Column, after: Column | bool, upper: bool) -> Column:
    """A cut as a struct that compares: without end (null value) first if it is a lower one, last if it is an upper one."""
    end = F.lit(1 if upper else -1)
    return F.struct(F.when(value.isNull(), end).otherwise(0).alias("end"), value.alias("value"), F.when(value.isNotNull(), (F.lit(after) if isinstance(after, bool) else after).cast("int")).alias("after"))


def interval(lo: Column, hi: Column, closed: tuple[bool, bool] = (True, False)) -> Column:
    """struct(lo, hi) of cuts; the flags say whether the lower and upper bound belong to the interval."""
    return F.struct(cut_of(lo, not closed[0], False).alias("lo"), cut_of(hi, closed[1], True).alias("hi"))


def _if_any(lo: Column, hi: Column) -> Column:
    return F.when(lo < hi, F.struct(lo.alias("lo"), hi.alias("hi")))


def intersection(a: Column, b: Column) -> Column:
    """What both hold, null if nothing."""
    return _if_any(F.greatest(a["lo"], b["lo"]), F.least(a["hi"], b["hi"]))


def left_of(a: Column, b: Column) -> Column:
    """The part of a before b begins, null if there is none."""
    return _if_any(a["lo"], F.least(a["hi"], b["lo"]))


def right_of(a: Column, b: Column) -> Column:
    return _if_any(F.greatest(a["lo"], b["hi"]), a["hi"])


def merged(a: Column, b: Column) -> Column:
    """One interval of two that touch without sharing a point, null for others."""
    touch = (a["hi"] == b["lo"]) | (b["hi"] == a["lo"])
    return F.when(touch, F.struct(F.least(a["lo"], b["lo"]).alias("lo"), F.greatest(a["hi"], b["hi"]).alias("hi")))


def shown(a: Column) -> Column:
    """Text of an interval: [1,2) and the like; nothing stands for a missing end."""
    low = F.concat(F.when(a["lo"]["after"] == 0, "[").otherwise("("), F.coalesce(a["lo"]["value"].cast("string"), F.lit("")))
    high = F.concat(F.coalesce(a["hi"]["value"].cast("string"), F.lit("")), F.when(a["hi"]["after"] == 1, "]").otherwise(")"))
    return F.when(a.isNotNull(), F.concat(low, F.lit(","), high))


def meets(alo: Column, ahi: Column, blo: Column, bhi: Column, a_ends: tuple[bool, bool] = (True, False), b_ends: tuple[bool, bool] = (True, False)) -> Column:
    """Whether two intervals share a point; the ends say whether the lower and upper bound belong to an interval."""
    first = (alo <= bhi) if a_ends[0] and b_ends[1] else (alo < bhi)
    return first & ((blo <= ahi) if b_ends[0] and a_ends[1] else (blo < ahi))


def adjacent(alo: Column, ahi: Column, blo: Column, bhi: Column, a_ends: tuple[bool, bool] = (True, False), b_ends: tuple[bool, bool] = (True, False)) -> Column:
    """Whether two intervals touch without sharing a point: one bound is equal and belongs to exactly one of them."""
    return ((ahi == blo) & F.lit(a_ends[1] != b_ends[0])) | ((bhi == alo) & F.lit(b_ends[1] != a_ends[0]))

