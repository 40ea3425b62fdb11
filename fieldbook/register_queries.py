"""Registry queries about register loads, derived tables and checks, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldbook import sources
from fieldbook.feed_queries import _BI, _bitemporal, _hist
from fieldbook.functions import geo
from fieldbook.functions import text as tx
from fieldbook.geometry_queries import _AT, _at, _ring
from fieldbook.operators import changes, feeds, geometry, matching, registers
from fieldbook.operators.stored import shared_path
from fieldbook.queries import _TRI, _WORDS, query, t
from fieldbook.sources import sinks

# Road records: two orders are the versions of a road, begun in Januaries at midnight of local time


@query("""WITH r AS (SELECT o_orderkey // 2 AS id, CASE WHEN o_orderkey // 2 % 4 = 0 THEN 'same' ELSE o_orderpriority END AS p, CASE WHEN o_orderkey % 2 = 0 THEN 1990 ELSE 1995 END AS y, 1 + o_orderkey // 2 % 28 AS day, CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey // 2 % 3 = 0 THEN 1995 WHEN o_orderkey // 2 % 3 = 1 THEN 1993 ELSE 1990 END END AS until FROM orders),
v AS (SELECT id, p, make_timestamp(y, 1, day, 0, 0, 0) - INTERVAL 1 HOUR AS lo, make_timestamp(until, 1, day, 0, 0, 0) - INTERVAL 1 HOUR AS hi FROM r WHERE until IS DISTINCT FROM y),
n AS (SELECT *, CASE WHEN lag(hi) OVER w = lo AND lag(p) OVER w = p THEN 0 ELSE 1 END AS new FROM v WINDOW w AS (PARTITION BY id ORDER BY lo)), i AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY lo) AS run FROM n)
SELECT CAST(id // 9000 + 1 AS INTEGER) AS municipality, CAST(id % 9000 + 1 AS INTEGER) AS road, 'Ad ' || p AS address_name, 'Name ' || p AS name, min(lo) AS lo, CASE WHEN count(*) = count(hi) THEN max(hi) END AS hi FROM i GROUP BY id, p, run""")
def q_road_history(spark, d):
    """Two records a road, an ended one and a current one: those that touch and agree are one version, and records that end as they begin are none."""
    k, digits = F.col("o_orderkey"), lambda c, w: F.lpad(c.cast("string"), w, "0")
    road = F.floor(k / 2)
    head = F.concat(F.when(k % 2 == 1, "001").otherwise("016"), digits(F.floor(road / 9000) + 1, 4), digits(road % 9000 + 1, 4))
    day = lambda year: F.concat(F.lit(year), F.lit("01"), digits(1 + road % 28, 2))
    zero = F.when(k % 7 == 0, "9999").when(k % 7 == 1, "0099").otherwise("0000")
    end = F.when(road % 3 == 0, F.concat(day("1995"), F.lit("0000"))).when(road % 3 == 1, F.concat(day("1993"), F.lit("0000"))).otherwise(F.concat(day("1990"), F.lit("0000")))
    called = F.when(road % 4 == 0, "same").otherwise(F.col("o_orderpriority"))
    names = F.concat(F.rpad(F.concat(F.lit("Ad "), called), 20, " "), F.rpad(F.concat(F.lit("Name "), called), 40, " "))
    line = F.when(k % 2 == 1, F.concat(head, F.lit(" " * 28), day("1995"), zero, names)).otherwise(F.concat(head, F.lit(" " * 12), day("1990"), zero, end, names))
    return registers.road_history(t(spark, d, "orders").select(line.alias("value")))


@query("""WITH t AS (SELECT c_custkey AS id, c_name AS v, CASE WHEN c_custkey % 9 = 0 THEN 'ended' END AS until, 100 + c_custkey % 50 AS e0, CASE WHEN c_custkey % 9 = 0 THEN 160 + c_custkey % 20 END AS e1 FROM customer WHERE c_custkey % 4 <> 0),
u AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN upper(c_name) ELSE c_name END AS v, NULL AS until, CASE WHEN c_custkey % 3 = 0 THEN 100 + c_custkey % 50 END AS e0 FROM customer WHERE c_custkey % 7 <> 0),
w AS (SELECT u.id, u.v, CASE WHEN t.e1 > 170 THEN t.until END AS until, coalesce(u.e0, t.e0) AS e0, t.e1 FROM u LEFT JOIN t USING (id) UNION ALL SELECT * FROM t WHERE e1 > 170 AND id NOT IN (SELECT id FROM u))
SELECT CASE WHEN t.id IS NULL THEN 'insert' WHEN w.id IS NULL THEN 'delete' ELSE 'update' END AS operation, coalesce(w.id, t.id) AS id, CASE WHEN w.id IS NULL THEN t.v ELSE w.v END AS v, CASE WHEN w.id IS NULL THEN t.until ELSE w.until END AS until FROM w FULL JOIN t ON w.id = t.id
WHERE t.id IS NULL OR w.id IS NULL OR w.v IS DISTINCT FROM t.v OR w.until IS DISTINCT FROM t.until OR w.e0 IS DISTINCT FROM t.e0 OR w.e1 IS DISTINCT FROM t.e1""")
def q_dump_changes(spark, d):
    """A dump as of event 170 against a table with later events: rows ended since stay ended, and event numbers that the dump leaves out stay known."""
    k = F.col("c_custkey")
    c = t(spark, d, "customer")
    table = c.where("c_custkey % 4 <> 0").select(k.alias("id"), F.col("c_name").alias("v"), F.when(k % 9 == 0, "ended").alias("until"), (100 + k % 50).alias("e0"), F.when(k % 9 == 0, 160 + k % 20).alias("e1"))
    dump = c.where("c_custkey % 7 <> 0").select(k.alias("id"), F.when(k % 5 == 0, F.upper("c_name")).otherwise(F.col("c_name")).alias("v"), F.lit(None).cast("string").alias("until"), F.when(k % 3 == 0, 100 + k % 50).alias("e0"), F.lit(None).cast("long").alias("e1"))
    return registers.dump_changes(dump, table, "id", ("e0", "e1"), ["until"], 170).select("operation", "id", "v", "until")


@query("""SELECT 'row' AS part, CAST(l_orderkey AS BIGINT) AS rowkey, count(*) AS n FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS r, l_linenumber AS lo, l_quantity / 10 AS hi FROM lineitem WHERE l_partkey % 10 <> 0) WHERE r = 1 AND lo < hi GROUP BY l_orderkey
UNION ALL SELECT CASE WHEN l_partkey % 20 = 0 THEN 'schema' ELSE 'missing rowkey' END, NULL, count(*) FROM lineitem WHERE l_partkey % 10 = 0 GROUP BY 1""")
def q_admitted_json(spark, d):
    """Lines of JSON, a tenth of them broken: the first row of each rowkey with a range, and the broken ones by reason."""
    key = F.col("l_partkey")
    quoted = lambda c: F.col(c).cast("string")
    body = F.concat(F.lit('"n": '), quoted("l_linenumber"), F.lit(', "p": '), quoted("l_partkey"), F.lit(', "s": '), quoted("l_suppkey"), F.lit(', "q": '), quoted("l_quantity"), F.lit(', "lo": '), quoted("l_linenumber"), F.lit(', "hi": '), (F.col("l_quantity") / 10).cast("string"))
    line = F.when(key % 20 == 0, F.concat(F.lit('{"rowkey": "no number", '), body, F.lit("}"))).when(key % 10 == 0, F.concat(F.lit("{"), body, F.lit("}"))).otherwise(F.concat(F.lit('{"rowkey": '), quoted("l_orderkey"), F.lit(", "), body, F.lit("}")))
    rows, rejects = registers.admitted(t(spark, d, "lineitem").select(line.alias("value")), "rowkey long, n int, p long, s long, q double, lo double, hi double", ["rowkey"], "rowkey", ["n", "p", "s", "q"], [("lo", "hi")])
    broken = rejects.where("reason in ('schema', 'missing rowkey')").groupBy(F.col("reason").alias("part")).agg(F.lit(None).cast("long").alias("rowkey"), F.count("*").alias("n"))
    return rows.groupBy("rowkey").agg(F.count("*").alias("n")).select(F.lit("row").alias("part"), "rowkey", "n").unionByName(broken)


@query("""WITH o AS (SELECT c_custkey AS id, c_name AS v FROM customer WHERE c_custkey % 6 <> 0), s AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN upper(c_name) ELSE c_name END AS v FROM customer WHERE c_custkey % 10 <> 0)
SELECT CASE WHEN o.id IS NULL THEN 'insert' WHEN s.id IS NULL THEN 'delete' ELSE 'update' END AS operation, coalesce(s.id, o.id) AS id FROM s FULL JOIN o ON s.id = o.id WHERE coalesce(s.id, o.id) % 2 = 0 AND (s.v IS DISTINCT FROM o.v)""")
def q_selection(spark, d):
    """A table that is two columns of another one, brought up to date for the keys that changed there."""
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("v"), F.col("c_acctbal").alias("other"))
    now = c.where("id % 10 <> 0").withColumn("v", F.when(F.col("id") % 4 == 0, F.upper("v")).otherwise(F.col("v"))).withColumn("other", F.col("other") + 1)
    return registers.selection(now, c.where("id % 6 <> 0").select("id", "v"), c.where("id % 2 = 0"), ["id"])[1].select("operation", "id")


_KNOWN_ROWS = "kn AS (SELECT k, CASE WHEN k % 4 = 0 THEN upper(a) ELSE a END AS a, lo, hi FROM hs WHERE k % 5 <> 0)"


@query(f"""WITH {_BI}, {_KNOWN_ROWS}, h AS (SELECT * FROM hs WHERE k % 2 = 0), n AS (SELECT * FROM kn WHERE k % 2 = 0)
SELECT CASE WHEN n.k IS NULL THEN 'insert' WHEN h.k IS NULL THEN 'delete' ELSE 'update' END AS operation, coalesce(h.k, n.k) AS k, coalesce(h.lo, n.lo) AS lo, coalesce(h.a, n.a) AS a, n.k IS NULL AS fresh FROM h FULL JOIN n ON h.k = n.k AND h.lo = n.lo WHERE h.a IS DISTINCT FROM n.a OR h.hi IS DISTINCT FROM n.hi OR n.k IS NULL OR h.k IS NULL""")
def q_history_changes(spark, d):
    """Histories of changed keys against what is known of them: versions keep their rowkeys by key and beginning, new ones get the next."""
    known = _hist(spark, d).where("k % 5 <> 0").withColumn("a", F.when(F.col("k") % 4 == 0, F.upper("a")).otherwise(F.col("a"))).select((F.xxhash64("k", "lo") % 1000000007).alias("rowkey"), "k", "a", "lo", "hi")
    found = registers.history_changes(_bitemporal(spark, d), t(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k")), known, ["k"], ["a"], "lo", "hi", "reg_to", "rowkey")
    top = known.agg(F.max("rowkey").alias("top"))
    return found.join(F.broadcast(top), F.lit(True)).select("operation", "k", "lo", "a", ((F.col("rowkey") > F.col("top")) & (F.col("operation") == "insert")).alias("fresh"))


@query(f"""WITH {_BI}, b AS (SELECT k, a, lo, least(coalesce(hi, TIMESTAMP '1995-01-01'), TIMESTAMP '1995-01-01') AS hi FROM hs WHERE lo < TIMESTAMP '1995-01-01' UNION ALL SELECT k, lower(a), greatest(lo, TIMESTAMP '1995-01-01'), hi FROM hs WHERE hi IS NULL OR hi > TIMESTAMP '1995-01-01'),
f AS (SELECT *, CASE WHEN lag(hi) OVER w IS NOT DISTINCT FROM lo AND lag(a) OVER w = a THEN 0 ELSE 1 END AS n FROM b WINDOW w AS (PARTITION BY k ORDER BY lo)), c AS (SELECT k, a, min(lo) AS lo, CASE WHEN count(*) = count(hi) THEN max(hi) END AS hi FROM (SELECT *, sum(n) OVER (PARTITION BY k ORDER BY lo) AS i FROM f) GROUP BY k, a, i)
SELECT CASE WHEN h.k IS NULL THEN 'insert' WHEN c.k IS NULL THEN 'delete' ELSE 'update' END AS operation, coalesce(c.k, h.k) AS k, coalesce(c.lo, h.lo) AS lo FROM c FULL JOIN hs h ON c.k = h.k AND c.lo = h.lo WHERE c.a IS DISTINCT FROM h.a OR c.hi IS DISTINCT FROM h.hi OR h.k IS NULL OR c.k IS NULL""")
def q_combined_changes(spark, d):
    """Two registers joined at a cut, against the history that was known before: the cut's new versions come in, those that it shortens change."""
    h = _hist(spark, d).select("k", "a", "lo", "hi")
    known = h.select(F.row_number().over(registers.relational.Window.partitionBy("k").orderBy("lo")).alias("n"), "*").select((F.col("k") * 1000 + F.col("n")).cast("long").alias("rowkey"), "k", "a", "lo", "hi")
    return registers.combined_changes(h, h.withColumn("a", F.lower("a")), known, ["k"], ["a"], "lo", "hi", F.lit("1995-01-01").cast("timestamp_ntz"), "rowkey").select("operation", "k", "lo")


@query(f"""WITH {_AT}, r AS (SELECT k, x, y, CAST(floor(x / 100) * 100 + floor(y / 100) AS BIGINT) AS found, CASE WHEN k % 3 = 0 THEN CAST(floor(x / 100) * 100 + floor(y / 100) AS BIGINT) WHEN k % 3 = 1 THEN CAST(floor(x / 100) * 100 AS BIGINT) END AS registered FROM a),
z AS (SELECT DISTINCT found AS code, floor(x / 100) * 100 AS zx, floor(y / 100) * 100 AS zy FROM r)
SELECT k, registered, found, CASE WHEN z.code IS NOT NULL THEN round(sqrt(pow(greatest(zx - x, 0, x - zx - 100), 2) + pow(greatest(zy - y, 0, y - zy - 100), 2)), 6) END AS there, CAST(0 AS DOUBLE) AS here FROM r LEFT JOIN z ON z.code = registered WHERE registered IS DISTINCT FROM found""")
def q_area_disagreements(spark, d):
    """Places whose registered tile is not the one they lie in, with their distances to both."""
    at = _at(spark, d)
    code = (F.floor(F.col("x") / 100) * 100 + F.floor(F.col("y") / 100)).cast("long")
    rows = at.withColumn("found", code).withColumn("registered", F.when(F.col("k") % 3 == 0, F.col("found")).when(F.col("k") % 3 == 1, (F.floor(F.col("x") / 100) * 100).cast("long")))
    tile = at.select(code.alias("code"), (F.floor(F.col("x") / 100) * 100).alias("x"), (F.floor(F.col("y") / 100) * 100).alias("y")).distinct()
    parts = geometry.split(tile.withColumn("rings", _ring((0, 0), (100, 0), (100, 100), (0, 100))), "code", "rings")
    return registers.area_disagreements(rows, "k", "x", "y", "registered", "found", parts, "code").select("k", "registered", "found", F.round("there", 6).alias("there"), "here")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey AS reference FROM lineitem WHERE l_suppkey IS NOT NULL AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 5 <> 0)")
def q_dangling(spark, d):
    lines = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("reference"))
    return registers.dangling(lines, "reference", t(spark, d, "supplier").where("s_suppkey % 5 <> 0"), "s_suppkey").select("l_orderkey", "l_linenumber", "l_partkey", "reference")


@query("""WITH b AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment WHEN c_custkey % 3 = 1 THEN lower(c_mktsegment) END AS s FROM customer WHERE c_custkey % 8 <> 0)
SELECT c_custkey, c_mktsegment AS map, s AS register FROM customer JOIN b USING (c_custkey) WHERE c_mktsegment IS DISTINCT FROM s""")
def q_differing(spark, d):
    c = t(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("s"))
    k = F.col("c_custkey")
    other = c.where("c_custkey % 8 <> 0").withColumn("s", F.when(k % 3 == 0, F.col("s")).when(k % 3 == 1, F.lower("s")))
    return registers.differing(c, other, ["c_custkey"], "s", ("map", "register"))


@query(f"""WITH w AS (SELECT p_partkey, p_name, {_WORDS.format('p_name')} AS own, list_distinct(list_concat({_WORDS.format('p_name')}, {_WORDS.format('p_type')})) AS every FROM part),
m AS (SELECT *, len(list_filter(own, lambda x: starts_with(x, 's'))) AS a, len(list_filter(list_filter(every, lambda x: starts_with(x, 's')), lambda x: NOT list_contains(own, x))) AS c FROM w WHERE len(list_filter(every, lambda x: starts_with(x, 's'))) > 0)
SELECT p_partkey, CAST(0 AS BIGINT) AS exact, CAST(round(1000000 * a / (1.64493406685 * log2(len(own) + 1))) AS BIGINT) AS named, CAST(round(1000000 * (a + 0.2 * c) / (1.64493406685 * log2(len(every) + 1))) AS BIGINT) AS rank, CAST(levenshtein(lower(p_name), 's*') AS BIGINT) AS edits FROM m""")
def q_named_first(spark, d):
    """Parts that have a word with s: those that have it in their name first."""
    return matching.name_first(t(spark, d, "part"), "p_partkey", {"p_name": "A", "p_type": "C"}, "p_name", "s*")


@query(f"""WITH g AS (SELECT p_name, count(*) AS n, {_TRI.format('p_name')} AS a, {_TRI.format("'smal widgte'")} AS b FROM part GROUP BY p_name), x AS (SELECT p_name, n, round(1 - len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS dist FROM g),
y AS (SELECT p_name, dist, sum(n) OVER (ORDER BY dist, p_name) - n AS before FROM x), s AS (SELECT p_name FROM y WHERE before < 500 ORDER BY dist, p_name LIMIT 20)
SELECT p_partkey, p_name, CAST(levenshtein(lower(p_name), 'smal widgte') AS BIGINT) AS edits FROM part WHERE p_name IN (SELECT p_name FROM s)""")
def q_near_names(spark, d):
    return matching.near_names(t(spark, d, "part"), "p_name", "smal widgte", 500, 20, (1, 1, 1)).select("p_partkey", "p_name", "edits")


@query(f"""WITH w AS (SELECT p_partkey, p_name, {_WORDS.format('p_name')} AS own FROM part), m AS (SELECT p_partkey, p_name, CAST(round(1000000 / (1.64493406685 * log2(len(own) + 1))) AS BIGINT) AS rank FROM w WHERE list_contains(own, 'widget'))
SELECT p_partkey, rank, CAST(levenshtein(p_name, 'small widget') AS BIGINT) AS edits FROM m ORDER BY rank DESC, edits, p_partkey LIMIT 40""")
def q_rank_then_edits(spark, d):
    """Rows of one rank by the edits between their name and the query, then by key."""
    p = t(spark, d, "part")
    found = matching.match_scan(p, "p_partkey", {"p_name": "A"}, "widget").join(p.select("p_partkey", "p_name"), "p_partkey")
    return matching.by_rank_then_edits(found, F.col("p_name"), "small widget", ["p_partkey"]).limit(40).select("p_partkey", "rank", "edits")




# Files and clocks


@query("SELECT o_orderkey, o_orderpriority || ';\"x\"' AS text, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END AS price FROM orders")
def q_csv_files(spark, d):
    """Rows written as CSV and read back by their schema, quotes and missing values included."""
    o = t(spark, d, "orders").select("o_orderkey", F.concat("o_orderpriority", F.lit(';"x"')).alias("text"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice")).alias("price"), "o_custkey")
    path = shared_path(spark, "csv-files")
    sinks.write_csv(o, path, ["o_orderkey", "text", "price"])
    return sources.csv(spark, path, "o_orderkey long, text string, price double", sep=",")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS text, [CAST(o_custkey AS BIGINT), CAST(o_orderkey % 7 AS BIGINT)][1 + o_orderkey % 2] AS part FROM orders")
def q_ndjson_files(spark, d):
    """Rows written as lines of JSON, nulls and lists included, and read back by their schema."""
    k = F.col("o_orderkey")
    o = t(spark, d, "orders").select("o_orderkey", F.when(k % 3 > 0, F.col("o_orderpriority")).alias("text"), F.array(F.col("o_custkey").cast("long"), (k % 7).cast("long")).alias("parts"))
    path = shared_path(spark, "ndjson-files")
    sinks.write_ndjson(o, path)
    back = sources.ndjson(spark, path, "o_orderkey long, text string, parts array<long>")
    return back.select("o_orderkey", "text", F.col("parts")[(F.col("o_orderkey") % 2).cast("int")].alias("part"))


@query("SELECT date_trunc('day', ts + INTERVAL 1 HOUR)::TIMESTAMP AS day, count(*) AS n FROM events GROUP BY 1")
def q_local_days(spark, d):
    """Events by the day where the register is kept; all of them are of one January."""
    at = t(spark, d, "events").select(tx.local_day(F.col("ts").cast("timestamp_ntz").cast("timestamp")).cast("timestamp_ntz").alias("day"))
    return at.groupBy("day").agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE WHEN event_id % 10 > 0 THEN date_trunc('minute', ts) - INTERVAL 1 HOUR END AS utc FROM events")
def q_local_to_utc(spark, d):
    """Local minutes as text, in UTC; texts that are no date are null."""
    stamp = F.when(F.col("event_id") % 10 > 0, F.date_format("ts", "yyyyMMddHHmm")).otherwise("000000000000")
    return t(spark, d, "events").select("event_id", sources.local_to_utc(stamp, "yyyyMMddHHmm").cast("timestamp_ntz").alias("utc"))


@query("SELECT vec_id, true AS same FROM embeddings")
def q_utm_there_and_back(spark, d):
    """Degrees to metres and back give the same degrees, to a ten-millionth."""
    p = t(spark, d, "embeddings").select("vec_id", (9 + F.col("embedding")[0].cast("double") * 4).alias("lon"), (56 + F.col("embedding")[1].cast("double") * 4).alias("lat"))
    east, north = geo.to_utm32(F.col("lon"), F.col("lat"))
    lon, lat = geo.from_utm32(F.col("e"), F.col("n"))
    metres = p.select("*", east.alias("e"), north.alias("n"))
    return metres.select("vec_id", ((F.abs(lon - F.col("lon")) < 1e-7) & (F.abs(lat - F.col("lat")) < 1e-7)).alias("same"))


@query("""WITH c AS (SELECT c_custkey AS k, c_custkey % 4 = 0 AS gone FROM customer WHERE c_custkey % 6 <> 0) SELECT k, CASE WHEN gone THEN 'delete' ELSE 'update' END AS operation, false AS public FROM c WHERE gone OR k % 5 = 0""")
def q_hidden_changes(spark, d):
    """Changes of a recomputation, none of them public."""
    old = t(spark, d, "customer").where("c_custkey % 6 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    new = old.where("k % 4 <> 0").withColumn("v", F.when(F.col("k") % 5 == 0, F.upper("v")).otherwise(F.col("v")))
    return feeds.hidden(changes.diff(new, old, ["k"])).select("k", "operation", "public")
