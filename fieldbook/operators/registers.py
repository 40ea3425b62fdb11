"""Register loads: road records with their history, dumps against a table that has moved on, admission with rejects, and derived tables kept by key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldbook.functions import ranges
from fieldbook.operators import changes, feeds, relational, temporal

# Fields of a road record (name, start from 1, width); records of both kinds begin alike.
_HEAD = [("record", 1, 3), ("municipality", 4, 4), ("road", 8, 4)]
CURRENT = ("001", [*_HEAD, ("begin", 40, 12), ("address_name", 52, 20), ("name", 72, 40)])
HISTORY = ("016", [*_HEAD, ("begin", 24, 12), ("end", 36, 12), ("address_name", 48, 20), ("name", 68, 40)])


def register_time(stamp: Column, zone: str = "Europe/Copenhagen") -> Column:
    """yyyyMMddHHmm of local time as UTC: null if empty, all zeros or before 1900; unknown times and minutes (99) count as zero. Other text is an error."""
    bare = F.trim(stamp)
    day = F.when(F.substring(bare, 9, 4) == "9999", F.concat(F.left(bare, F.lit(8)), F.lit("0000"))).when(F.substring(bare, 11, 2) == "99", F.concat(F.left(bare, F.lit(10)), F.lit("00"))).otherwise(bare)
    at = F.to_timestamp_ntz(day, F.lit("yyyyMMddHHmm")).cast("timestamp_ntz")
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), at)
    return F.when((bare != "") & (bare != "0" * 12) & (at >= F.lit("1900-01-01").cast("timestamp_ntz")), utc)


def road_history(lines: DataFrame, zone: str = "Europe/Copenhagen") -> DataFrame:
    """municipality, road, address_name, name, lo, hi: versions of roads from lines(value) of a fixed-width register.

    History records that end when they begin are none; a current record has no end. Versions that touch and agree are one.
    """

    def records(kind: str, fields: list[tuple[str, int, int]]) -> DataFrame:
        part = {name: F.trim(F.substring("value", at, width)) for name, at, width in fields}
        rows = lines.where(F.col("value").startswith(kind)).select(*[c.alias(n) for n, c in part.items()])
        end = register_time(F.col("end"), zone) if "end" in part else F.lit(None).cast("timestamp_ntz")
        return rows.select(F.col("municipality").cast("int").alias("municipality"), F.col("road").cast("int").alias("road"), "address_name", "name", register_time(F.col("begin"), zone).alias("lo"), end.alias("hi"))

    past = records(*HISTORY).where(~F.coalesce(F.col("lo") == F.col("hi"), F.lit(False)))
    return ranges.coalesce_valid_time(past.unionByName(records(*CURRENT)), ["municipality", "road"], ["address_name", "name"], "lo", "hi")


def dump_changes(dump: DataFrame, table: DataFrame, key: str, events: tuple[str, str], ended: list[str], since: int | None = None) -> DataFrame:
    """The changes that a dump brings to a table that may have moved on since the dump was made.

    Rows of the table whose creating or updating event is later than the dump's last one (``since``; worked out if not given) count as they are: absent ones are added to the dump, present
    ones lend it the columns ``ended``. A dump that leaves out an event number doesn't erase the known one.
    """
    created, updated = events
    if since is None:
        since = dump.agg(F.max(F.greatest(created, updated))).first()[0]
    newer = table.where((F.col(created) > since) | (F.col(updated) > since))
    lent = newer.select(key, *[F.col(c).alias(f"newer_{c}") for c in ended], F.lit(True).alias("is_newer"))
    known = table.select(key, *[F.col(c).alias(f"known_{c}") for c in events])
    rows = dump.join(lent, key, "left").join(known, key, "left")
    for c in ended:
        rows = rows.withColumn(c, F.when(F.col("is_newer"), F.col(f"newer_{c}")).otherwise(F.col(c)))
    for c in events:
        rows = rows.withColumn(c, F.coalesce(c, f"known_{c}"))
    wanted = rows.select(*table.columns).unionByName(newer.join(dump.select(key), key, "left_anti").select(*table.columns))
    return changes.diff(wanted, table, [key])


def admitted(lines: DataFrame, schema: str, required: list[str], rowkey: str, order: list[str], ranges_of: list[tuple[str, str]], most: int = 2**31 - 1) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects(value, reason)) of lines(value) of JSON: text that is no object of the schema, missing fields and rowkeys beyond ``most`` are rejected, and
    so are all but the first of one rowkey (by ``order``, then text) and rows whose ranges are inverted or empty.

    Rows are told apart by their text, so a line that comes twice is kept once.
    """
    broken = "broken_"
    fields = f"{schema}, {broken} string"
    parsed = lines.select("value", F.from_json("value", fields, {"columnNameOfCorruptRecord": broken, "mode": "PERMISSIVE"}).alias("r"))
    wrong = [(F.col("r").isNull() | F.col(f"r.{broken}").isNotNull(), "schema")] + [(F.col(f"r.{c}").isNull(), f"missing {c}") for c in required] + [(F.col(f"r.{rowkey}") >= most, "rowkey too large")]
    bad = [(F.coalesce(F.col(f"r.{lo}") >= F.col(f"r.{hi}"), F.lit(False)), f"range {lo}") for lo, hi in ranges_of]
    # only rows that fit compete for their rowkey; the others are dealt by their text. One window over all, so lines are parsed once for both
    group = [F.when(F.col("reason").isNull(), F.col(f"r.{rowkey}")), F.when(F.col("reason").isNotNull(), F.xxhash64("value"))]
    first = F.row_number().over(Window.partitionBy(*group).orderBy(*[F.col(f"r.{c}") for c in order], "value"))
    reason = reduce(lambda c, w: c.when(w[0], w[1]), wrong[1:], F.when(*wrong[0]))
    marked = parsed.withColumn("reason", reason).withColumn("place", first)
    judged = marked.withColumn("reason", F.coalesce("reason", reduce(lambda c, w: c.when(w[0], w[1]), bad, F.when(F.col("place") > 1, "duplicate")))).drop("place")
    names = [f.name for f in lines.sparkSession.createDataFrame([], schema).schema]
    return judged.where("reason is null").select(*[F.col(f"r.{n}").alias(n) for n in names]), judged.where("reason is not null").select("value", "reason")


def selection(source: DataFrame, old: DataFrame, changed: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(new table, its changes) of a table that is some columns of another one: only the keys that changed there are looked at, and a change in other columns is none here."""
    return changes.materialize(source.select(*old.columns), old, changed.select(*key).distinct(), key)


def history_changes(bitemporal: DataFrame, changed: DataFrame, known: DataFrame, key: list[str], attrs: list[str], lo: str, hi: str, reg_to: str, rowkey: str) -> DataFrame:
    """The changes of a history by valid time from bitemporal rows of changed keys: open registrations merged, versions numbered as they were known by (key, lower bound), new ones anew, and compared by rowkey."""
    dirty = changed.select(*key).distinct()
    merged = feeds.history_of(bitemporal.join(dirty, key, "left_semi"), key, attrs, lo, hi, reg_to)
    here = known.join(dirty, key, "left_semi")
    top = known.agg(F.max(rowkey)).first()[0] or 0
    numbered = lambda df, order, name, start: relational.numbered(df, order, name, max(start, top))
    return changes.diff(temporal.stable_rowkeys(merged, here, key, lo, rowkey, numbered).select(*known.columns), here, [rowkey])


def combined_changes(old: DataFrame, new: DataFrame, known: DataFrame, key: list[str], attrs: list[str], lo: str, hi: str, cut: Column, rowkey: str) -> DataFrame:
    """The changes that an old register before the cut and a new one from it on bring to the known combined history, by rowkey."""
    merged = feeds.combined_history(old, new, key, attrs, lo, hi, cut)
    return changes.diff(temporal.stable_rowkeys(merged, known, key, lo, rowkey, relational.numbered).select(*known.columns), known, [rowkey])


# Checks


def distance_to(x: Column, y: Column, edges: Column) -> Column:
    """Distance of a point to a region's part given by its edges: 0 inside and on the border, null without edges."""
    n = F.sequence(F.lit(0), (F.size(edges) / 4 - 1).cast("int"))
    at = lambda i: (edges[i * 4], edges[i * 4 + 1], edges[i * 4 + 2], edges[i * 4 + 3])

    def far(i: Column) -> Column:
        ax, ay, bx, by = at(i)
        dx, dy = bx - ax, by - ay
        t = F.coalesce(((x - ax) * dx + (y - ay) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))
        t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
        return F.hypot(x - ax - t * dx, y - ay - t * dy)

    def crossed(i: Column) -> Column:
        ax, ay, bx, by = at(i)
        return F.coalesce(((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / F.nullif(by - ay, F.lit(0.0)) + ax), F.lit(False))

    inside = F.size(F.filter(n, crossed)) % 2 == 1
    return F.when(F.size(edges) > 0, F.when(inside, 0.0).otherwise(F.array_min(F.transform(n, far))))


def area_disagreements(rows: DataFrame, key: str, x: str, y: str, registered: str, found: str, parts: DataFrame, code: str) -> DataFrame:
    """Rows whose registered area is not the one found on the map, with their distances to both: ``there`` to the registered one, ``here`` to the found one; farthest first.

    ``parts`` are the areas' parts (``geometry.split``); the distance to an area is that to its nearest part. Areas that are not on the map have no distance.
    """
    wrong = rows.where(~F.col(registered).eqNullSafe(F.col(found)))

    def far(column: str, name: str) -> DataFrame:
        met = wrong.select(key, F.col(x).alias("x_"), F.col(y).alias("y_"), F.col(column).alias(code)).join(parts.select(code, "edges"), code)
        return met.groupBy(key).agg(F.min(distance_to(F.col("x_"), F.col("y_"), F.col("edges"))).alias(name))

    both = wrong.join(far(registered, "there"), key, "left").join(far(found, "here"), key, "left")
    return both.orderBy(F.col("there").desc_nulls_last(), key)


def dangling(df: DataFrame, reference: str, other: DataFrame, key: str) -> DataFrame:
    """Rows that refer to a row which is not there; rows that refer to nothing are fine."""
    return df.where(F.col(reference).isNotNull()).join(other.select(F.col(key).alias(reference)), reference, "left_anti")


def differing(a: DataFrame, b: DataFrame, key: list[str], column: str, names: tuple[str, str]) -> DataFrame:
    """key and both values of rows in two registers that give a column different values; a null on one side is a difference."""
    both = a.select(*key, F.col(column).alias(names[0])).join(b.select(*key, F.col(column).alias(names[1])), key)
    return both.where(~F.col(names[0]).eqNullSafe(F.col(names[1])))


