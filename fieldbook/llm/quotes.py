"""Operator 7: quotation linking of messages, in Spark expressions only.

1. Every line of a message has a quote level: the number of ``>`` that it begins with. Level 0 is the message's own text;
   a line like "On ... wrote:" right before a quote is no text of its own.
2. Quoted and own text is cut into units: all text of a level, its paragraphs and its lines, each normalised (lower case,
   single blanks) and hashed to 128 bits.
3. Quoted units are joined to own units of earlier messages by hash: the latest earlier message of the same conversation that
   has the unit, else the first message of all that has it, if that is earlier. Own units are reduced to one row for each
   hash before that second join, so a line that everybody writes makes no pairs.
4. A message replies to the message that most of its text of the lowest linked level comes from: level 1, or a deeper one where
   nothing above it is found. ``origins`` gives the message that most of each level comes from. Following replies to their root by pointer
   doubling gives threads; messages are ordered by root, then by place, so a reply always follows what it answers.

Messages are ordered by (conv_id, turn); nulls come first. Null text has no lines. A very long message is parsed whole. Repeated rows are messages of their own; a tie is decided
by row order. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut, read

# Quote marks at a line's beginning, and lines that announce a quote.
MARKS = r"^(?:[\x20\t]*>)+[\x20\t]?"
ANNOUNCES = r"(?i)^\s*(?:on\b.{0,200}\bwrote|le\b.{0,200}\ba écrit|am\b.{0,200}\bschrieb.{0,80}|el\b.{0,200}\bescribió|.{0,80}\bwrote)\s*:\s*$"
#: Shortest normalised unit that can identify a message.
LEAST = 3


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), "[^>]", ""))


def parse(messages: DataFrame) -> DataFrame:
    """row, conv_id, turn, role, own (text without quotes), max_level, quoted_lines, lines: array<struct<level, s>>."""
    lines = F.transform(F.split(F.coalesce(F.col("text"), F.lit("")), "\r?\n", -1), lambda x: F.struct(_level(x).alias("level"), F.regexp_replace(x, MARKS, "").alias("s")))
    own = F.filter(
        "lines",
        lambda x, i: (x["level"] == 0) & ~(x["s"].rlike(ANNOUNCES) & F.coalesce(F.try_element_at("lines", i + 2)["level"] > 0, F.lit(False))),
    )
    return (
        messages.select("conv_id", "turn", "role", lines.alias("lines"))
        .withColumn("own", own)
        .select(
            F.monotonically_increasing_id().alias("row"), "conv_id", "turn", "role", "lines",
            F.regexp_replace(F.array_join(F.transform("own", lambda x: x["s"]), "\n"), r"^\s+|\s+$", "").alias("own"),
            F.array_max(F.transform("lines", lambda x: x["level"])).alias("max_level"),
            F.size(F.filter("lines", lambda x: x["level"] > 0)).cast("long").alias("quoted_lines"),
        )
    )


def _units(text: Column) -> Column:
    """Distinct normalised units of a text: all of it, its paragraphs, its lines; as array<struct<h1, h2, size>>."""
    clean = lambda x: F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))
    every = F.transform(F.concat(F.array(text), F.split(text, r"\n\s*\n"), F.split(text, "\n")), clean)
    kept = F.filter(F.array_distinct(every), lambda x: F.length(x) >= LEAST)
    return F.transform(kept, lambda x: F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.reverse(x)).alias("h2"), F.length(x).alias("size")))


def link(parsed: DataFrame) -> DataFrame:
    """row, level, origin (row), size (code points shared) of every quote level and message it comes from."""
    key = ["h1", "h2"]
    own = parsed.select("row", "conv_id", "turn", F.inline(_units(F.col("own"))))
    at_level = F.explode(F.sequence(F.lit(1), "max_level"))
    text = F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == F.col("level")), lambda x: x["s"]), "\n")
    quoted = parsed.filter("max_level > 0").select("row", "conv_id", "turn", "lines", at_level.alias("level")).select("row", "conv_id", "turn", "level", F.inline(_units(text)))
    sought = quoted.select(*key).distinct()
    # only own units that somebody quotes go on
    found = own.join(sought, key, "left_semi")
    both = found.withColumn("level", F.lit(0)).unionByName(quoted)
    order = Window.partitionBy("conv_id", *key).orderBy(F.col("turn").asc_nulls_first(), "level", "row")
    origin = F.when(F.col("level") == 0, F.struct("row", "turn"))
    before = both.withColumn("origin", F.last(origin, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))).filter("level > 0")
    near = before.withColumn("near", F.when(~F.col("origin.turn").eqNullSafe(F.col("turn")), F.col("origin.row")))
    first = found.groupBy(*key).agg(F.min(F.struct("conv_id", "turn", "row")).alias("first"))
    far = near.join(first, key, "left")
    earlier = F.struct("first.conv_id", "first.turn") < F.struct("conv_id", "turn")
    got = far.select("row", "level", "size", F.coalesce("near", F.when(earlier, F.col("first.row"))).alias("origin"))
    return got.filter("origin is not null and origin <> row").groupBy("row", "level", "origin").agg(F.sum("size").alias("size"))


def roots(parents: DataFrame) -> DataFrame:
    """row, root, depth for every row of parents(row, parent), by pointer doubling."""
    up = cut(parents.select("row", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth")), "replies")
    while True:
        over = up.select(F.col("row").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        step = cut(up.join(over, "root", "left").select("row", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")), "replies")
        drop_cut(up)
        up = step
        if up.filter("moved").isEmpty():
            return up.drop("moved")


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with position (from 0) within group by order. Ranges of the sort are numbered apart and offset, so a large group needs no single task."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = cut(rows.repartitionByRange(parts, group, *order).withColumn("range", F.spark_partition_id()), "ranges")
    counts = held.groupBy(group, "range").agg(F.count("*").alias("n"))
    offsets = counts.withColumn("offset", F.sum("n").over(Window.partitionBy(group).orderBy("range")) - F.col("n")).drop("n")
    within = F.row_number().over(Window.partitionBy(group, "range").orderBy(*order)) - 1
    o = offsets.select(F.col(group).alias("_g"), F.col("range").alias("_r"), "offset")
    placed = held.withColumn("within", within).join(o, F.col(group).eqNullSafe(F.col("_g")) & (F.col("range") == F.col("_r")))
    return placed.withColumn("position", (F.col("within") + F.col("offset")).cast("long")).drop("within", "offset", "range", "_g", "_r")


def conversations(messages: DataFrame) -> DataFrame:
    """thread_conv_id, position, conv_id, turn, role, text (without quotes), max_level, quoted_lines, parent_conv_id, parent_turn, depth, origins: array<struct<level, conv_id, turn>>."""
    parsed = cut(parse(messages), "messages")
    levels = cut(link(parsed).groupBy("row", "level").agg(F.max_by("origin", F.struct("size", "origin")).alias("origin")), "origins")
    parents = cut(levels.groupBy("row").agg(F.min_by("origin", "level").alias("parent")), "parents")
    place = parsed.select(F.col("row").alias("at"), F.struct("conv_id", "turn").alias("place"))
    threads = roots(parents)
    known = parents.join(threads, "row").join(place.select(F.col("at").alias("parent"), F.col("place").alias("above")), "parent").join(place.select(F.col("at").alias("root"), F.col("place").alias("top")), "root").select("row", "above", "top", "depth")
    origins = levels.join(place, F.col("origin") == F.col("at")).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("level", "place.conv_id", "place.turn"))).alias("origins"))
    joined = parsed.drop("lines").join(known, "row", "left").join(origins, "row", "left")
    top = F.coalesce("top", F.struct("conv_id", "turn"))
    out = joined.select(top["conv_id"].alias("thread_conv_id"), top["turn"].alias("root_turn"), "conv_id", "turn", "row", "role", F.col("own").alias("text"), "max_level", "quoted_lines", F.col("above.conv_id").alias("parent_conv_id"), F.col("above.turn").alias("parent_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), F.coalesce("origins", F.array().cast("array<struct<level:int,conv_id:long,turn:long>>")).alias("origins"))
    return ranked(out, "thread_conv_id", ["root_turn", "conv_id", "turn", "row"]).drop("row")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As the SQL has it, so without the origins by level."""
    return conversations(read(spark, sf_dir, "conversations")).drop("origins")


#: For tables without quote marks: every message is its own thread, in turn order. (With quotes the tests compare with brute force.)
ORACLE = r"""
SELECT conv_id AS thread_conv_id, turn AS root_turn, conv_id, turn, role,
       regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS text,
       CAST(0 AS INTEGER) AS max_level, CAST(0 AS BIGINT) AS quoted_lines,
       CAST(NULL AS BIGINT) AS parent_conv_id, CAST(NULL AS BIGINT) AS parent_turn, CAST(0 AS BIGINT) AS depth,
       row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position
FROM conversations
"""
