"""Registry queries about feeds, derived tables, relations and checks, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldbook.functions import text as tx
from fieldbook.operators import balanced, changes, feeds, relational, spatial
from fieldbook.queries import _PTS, _points, big, query, t

# Feeds: orders are the events, a day of orders is a transaction


def _history(spark, d):
    op = F.when(F.col("o_orderstatus") == "F", "delete").when(F.col("o_orderstatus") == "O", "insert").otherwise("update")
    return t(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("k"), op.alias("operation"), F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long").alias("txid"), big("o_totalprice").alias("v"))


_EV = """ev AS (SELECT o_orderkey AS seq, o_custkey AS k, CASE o_orderstatus WHEN 'F' THEN 'delete' WHEN 'O' THEN 'insert' ELSE 'update' END AS operation,
CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS txid, CAST(trunc(o_totalprice) AS BIGINT) AS v FROM orders)"""


@query(f"WITH {_EV} SELECT * FROM ev WHERE seq BETWEEN 100 AND 900 AND txid <= 2000")
def q_event_range(spark, d):
    history = _history(spark, d)
    feeds.checked_sequence(history, 100)
    return feeds.events(history, history.select("txid").distinct(), "seq", "txid", seq=(100, 900), txid=(None, 2000)).select("seq", "k", "operation", "txid", "v")


@query(f"WITH {_EV}, c AS (SELECT * FROM ev WHERE seq % 7 = 0) SELECT seq AS id, CASE WHEN operation <> 'update' THEN 500 + row_number() OVER (PARTITION BY operation <> 'update' ORDER BY seq) END AS seq, CAST(42 AS BIGINT) AS txid FROM c")
def q_transaction(spark, d):
    found = _history(spark, d).filter("seq % 7 = 0").select(F.col("seq").alias("id"), "operation", (F.col("operation") != "update").alias("public"))
    done = spark.createDataFrame([(41, 500)], "txid long, seq_to long")
    return feeds.transaction(done, found, ["id"])[0].select("id", "seq", "txid")


@query("""WITH c AS (SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'street' WHEN 1 THEN 'house' ELSE 'unit' END AS tab, CASE o_orderstatus WHEN 'F' THEN 'delete' WHEN 'O' THEN 'insert' ELSE 'update' END AS operation, o_orderkey % 5 <> 0 AS public FROM orders),
p AS (SELECT *, (CASE operation WHEN 'delete' THEN -1 ELSE 1 END) * CASE tab WHEN 'street' THEN 1 WHEN 'house' THEN 2 ELSE 3 END AS place FROM c)
SELECT id, CASE WHEN public THEN 900 + row_number() OVER (PARTITION BY public ORDER BY place, id) END AS seq FROM p""")
def q_transaction_of_tables(spark, d):
    """Numbers of a transaction over three tables: deletes from units to streets, then the rest from streets to units; hidden changes have none."""
    k = F.col("o_orderkey")
    found = t(spark, d, "orders").select(k.alias("id"), F.when(k % 3 == 0, "street").when(k % 3 == 1, "house").otherwise("unit").alias("table"), F.when(F.col("o_orderstatus") == "F", "delete").when(F.col("o_orderstatus") == "O", "insert").otherwise("update").alias("operation"), (k % 5 != 0).alias("public"))
    ordered = feeds.in_table_order(found, ["street", "house", "unit"])
    done = spark.createDataFrame([(41, 900)], "txid long, seq_to long")
    return feeds.transaction(done, ordered, ["table_order", "id"])[0].select("id", "seq")


@query("""WITH t AS (SELECT c_custkey AS k, c_name AS v FROM customer WHERE c_custkey % 3 <> 0), p AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE upper(c_name) END AS v FROM customer WHERE c_custkey % 5 = 0),
x AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 7 = 0)
SELECT CASE WHEN t.k IS NULL THEN 'insert' ELSE 'update' END AS operation, k, p.v FROM p LEFT JOIN t USING (k) WHERE t.v IS DISTINCT FROM p.v
UNION ALL SELECT 'delete', k, t.v FROM t WHERE k IN (SELECT k FROM x) AND k NOT IN (SELECT k FROM p)""")
def q_puts_deletes(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    puts = c.filter("k % 5 = 0").withColumn("v", F.when(F.col("k") % 2 == 0, F.col("v")).otherwise(F.upper("v")))
    return feeds.puts_and_deletes(c.filter("k % 3 <> 0"), puts, c.filter("k % 7 = 0").select("k"), ["k"]).select("operation", "k", "v")


_BI = """bi AS (SELECT o_custkey AS k, o_orderstatus AS a, o_orderdate AS lo, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS hi, CASE WHEN o_orderkey % 11 = 0 THEN o_orderdate END AS reg_to FROM orders),
op AS (SELECT *, CASE WHEN lag(hi) OVER w IS NOT DISTINCT FROM lo AND lag(a) OVER w = a THEN 0 ELSE 1 END AS n FROM bi WHERE reg_to IS NULL AND (hi IS NULL OR hi > lo) WINDOW w AS (PARTITION BY k ORDER BY lo)),
hs AS (SELECT k, a, min(lo) AS lo, CASE WHEN count(*) = count(hi) THEN max(hi) END AS hi FROM (SELECT *, sum(n) OVER (PARTITION BY k ORDER BY lo) AS i FROM op) GROUP BY k, a, i)"""


#: Orders of a task, about: what a task sorts stays the same as the table grows.
ORDERS = 200_000


def _bitemporal(spark, d):
    dealt = balanced.spread(t(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("a"), F.col("o_orderdate").alias("lo")), ORDERS, ["k"])
    w = relational.Window.partitionBy("k").orderBy(F.col("lo").asc_nulls_first(), "seq")
    rows = dealt.select("k", "a", "lo", F.lead("lo").over(w).alias("hi"), F.when(F.col("seq") % 11 == 0, F.col("lo")).alias("reg_to"))
    return rows.filter("hi is null or hi > lo")


def _hist(spark, d):
    return feeds.history_of(_bitemporal(spark, d), ["k"], ["a"], "lo", "hi", "reg_to")


@query(f"WITH {_BI} SELECT k, a, lo, hi FROM hs")
def q_bitemporal_to_history(spark, d):
    return _hist(spark, d).select("k", "a", "lo", "hi")


@query(f"""WITH {_BI}, n AS (SELECT k, a FROM hs WHERE lo <= TIMESTAMP '1997-01-01' AND (hi IS NULL OR hi > TIMESTAMP '1997-01-01')), o AS (SELECT k, a FROM hs WHERE lo <= TIMESTAMP '1996-06-01' AND (hi IS NULL OR hi > TIMESTAMP '1996-06-01'))
SELECT CASE WHEN o.k IS NULL THEN 'insert' WHEN n.k IS NULL THEN 'delete' ELSE 'update' END AS operation, coalesce(n.k, o.k) AS k, coalesce(n.a, o.a) AS a FROM n FULL JOIN o ON n.k = o.k WHERE n.a IS DISTINCT FROM o.a""")
def q_history_to_current(spark, d):
    h, at = _hist(spark, d), lambda x: F.lit(x).cast("timestamp_ntz")
    current = feeds.current_of(h, "lo", "hi", at("1996-06-01")).select("k", "a")
    return feeds.current_changes(h, h.select("k").limit(0), current, ["k"], "lo", "hi", at("1996-06-01"), at("1997-01-01")).select("operation", "k", "a")


@query(f"""WITH {_BI}, b AS (SELECT k, a, lo, least(coalesce(hi, TIMESTAMP '1995-01-01'), TIMESTAMP '1995-01-01') AS hi FROM hs WHERE lo < TIMESTAMP '1995-01-01'
UNION ALL SELECT k, upper(a), greatest(lo, TIMESTAMP '1995-01-01'), hi FROM hs WHERE hi IS NULL OR hi > TIMESTAMP '1995-01-01'),
f AS (SELECT *, CASE WHEN lag(hi) OVER w IS NOT DISTINCT FROM lo AND lag(a) OVER w = a THEN 0 ELSE 1 END AS n FROM b WINDOW w AS (PARTITION BY k ORDER BY lo))
SELECT k, a, min(lo) AS lo, CASE WHEN count(*) = count(hi) THEN max(hi) END AS hi FROM (SELECT *, sum(n) OVER (PARTITION BY k ORDER BY lo) AS i FROM f) GROUP BY k, a, i""")
def q_combined_history(spark, d):
    h = _hist(spark, d)
    return feeds.combined_history(h, h.withColumn("a", F.upper("a")), ["k"], ["a"], "lo", "hi", F.lit("1995-01-01").cast("timestamp_ntz")).select("k", "a", "lo", "hi")


@query("SELECT CAST(1 AS BIGINT) AS txid, 'insert' AS operation, false AS public, n_nationkey, n_name FROM nation")
def q_initial_history(spark, d):
    return feeds.initial_history(t(spark, d, "nation").select("n_nationkey", "n_name"), 1)


@query("SELECT CASE WHEN s.c_custkey IS NULL THEN 'delete' ELSE 'update' END AS operation, false AS public, c.c_custkey FROM customer c LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 9 <> 0) s USING (c_custkey) WHERE s.c_custkey IS NULL OR c.c_custkey % 10 = 0")
def q_recomputed(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_name")
    fresh = c.filter("c_custkey % 9 <> 0").withColumn("c_name", F.when(F.col("c_custkey") % 10 == 0, F.lit("new")).otherwise(F.col("c_name")))
    return feeds.hidden(changes.diff(fresh, c, ["c_custkey"])).select("operation", "public", "c_custkey")


# Relations


@query("SELECT s_suppkey, s_name, n_name AS nation, r_name AS region FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def q_renamed_lookups(spark, d):
    lookups = [(t(spark, d, "nation"), {"n_nationkey": "s_nationkey", "n_name": "nation", "n_regionkey": "region_key"}), (t(spark, d, "region"), {"r_regionkey": "region_key", "r_name": "region"})]
    return relational.with_lookups(t(spark, d, "supplier"), lookups).select("s_suppkey", "s_name", "nation", "region")


@query("""SELECT r_regionkey, CASE WHEN count(n_nationkey) > 0 THEN string_agg(n_name, ',' ORDER BY n_nationkey) END AS nations, count(n_nationkey) AS n,
any_value(r_name) AS first_name FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey""")
def q_relation_list(spark, d):
    r = t(spark, d, "region")
    rows = relational.related(r, [{"table": t(spark, d, "nation"), "name": "nations", "on": {"r_regionkey": "n_regionkey"}, "many": True}, {"table": r, "name": "self", "on": {"r_regionkey": "r_regionkey"}}])
    return rows.select("r_regionkey", F.array_join(F.transform("nations", lambda x: x["n_name"]), ",").alias("nations"), F.greatest(F.size(F.coalesce("nations", F.array())), F.lit(0)).cast("long").alias("n"), F.col("self.r_name").alias("first_name"))


@query("SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), CAST((SELECT max(o_orderdate) FROM orders) AS DATE)) AS age FROM orders")
def q_one_row_cross(spark, d):
    o = t(spark, d, "orders")
    return relational.with_row(o, o.agg(F.max("o_orderdate").alias("clock"))).select("o_orderkey", F.date_diff(F.col("clock").cast("date"), F.col("o_orderdate").cast("date")).cast("long").alias("age"))


@query("SELECT p_brand, max(p_retailprice) AS p_retailprice, min(p_size) AS p_size FROM part GROUP BY p_brand ORDER BY p_retailprice DESC, p_size, p_brand LIMIT 5")
def q_best_groups(spark, d):
    return relational.best_groups(t(spark, d, "part"), ["p_brand"], "p_retailprice", "p_size", 5)


@query("SELECT p_partkey, p_name FROM (SELECT * FROM part WHERE starts_with(p_name, 's') ORDER BY p_partkey LIMIT 200) ORDER BY p_name, p_partkey LIMIT 20")
def q_bounded_candidates(spark, d):
    some = relational.candidates(t(spark, d, "part").filter(F.col("p_name").startswith("s")), ["p_partkey"], 200)
    return relational.triggered_order(some, {"by_name": "1", "by_size": None}, {"by_size": ["p_size"], "by_name": ["p_name"]}, ["p_partkey"]).limit(20).select("p_partkey", "p_name")


@query("""WITH c AS (SELECT c_custkey, c_mktsegment IN ('BUILDING', 'MACHINERY') AS good, c_custkey % 4 <> 0 AND c_custkey % 6 <> 0 AS whole FROM customer)
SELECT form, c_custkey FROM c, (VALUES ('valid', false, false), ('closed', true, false), ('incomplete', false, true), ('all', true, true)) f(form, closed, incomplete) WHERE (good OR closed) AND (whole OR incomplete)""")
def q_valid_only(spark, d):
    """The four forms of both switches; essentials are missing by null or by an empty text."""
    c = t(spark, d, "customer").withColumn("a", F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal"))).withColumn("b", F.when(F.col("c_custkey") % 6 == 0, "").otherwise(F.col("c_name")))
    forms = {"valid": (False, False), "closed": (True, False), "incomplete": (False, True), "all": (True, True)}
    each = [relational.valid_only(c, "c_mktsegment", ["BUILDING", "MACHINERY"], ["a", "b"], *f).select(F.lit(n).alias("form"), "c_custkey") for n, f in forms.items()]
    return each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3])


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 9 END AS status, 'https://api.example/orders/' || o_orderkey AS href, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(date_part('millisecond', o_orderdate) % 1000 AS VARCHAR), 3, '0') || 'Z' AS at,
' ' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') AS code FROM orders""")
def q_mapped_and_linked(spark, d):
    o = t(spark, d, "orders")
    return o.select("o_orderkey", tx.mapped(F.col("o_orderstatus"), {"F": 1, "O": 2}, 9).alias("status"), tx.link("https://api.example/orders/", F.col("o_orderkey")).alias("href"), tx.iso_utc(F.col("o_orderdate")).alias("at"), tx.postal_blank(F.col("o_orderkey") % 10000).alias("code"))


# Places and checks


def _squares(spark, value="zone"):
    ring = lambda x, y: [(x, y), (x + 0.3, y), (x + 0.3, y + 0.3), (x, y + 0.3), (x, y)]
    return spark.createDataFrame([(3, ring(-0.1, -0.1)), (1, ring(0.0, 0.0)), (2, ring(-0.4, -0.4))], f"{value} int, ring array<struct<x:double,y:double>>")


_SQ = "s(zone, x0, y0) AS (VALUES (3, -0.1, -0.1), (1, 0.0, 0.0), (2, -0.4, -0.4)), c AS (SELECT vec_id, zone FROM p, s WHERE x BETWEEN x0 AND x0 + 0.3::DOUBLE AND y BETWEEN y0 AND y0 + 0.3::DOUBLE)"


@query(f"WITH {_PTS}, {_SQ} SELECT p.vec_id, coalesce(min(zone), 9) AS zone FROM p LEFT JOIN c USING (vec_id) GROUP BY p.vec_id")
def q_zone_or_default(spark, d):
    return spatial.covering_or(_points(spark, d), _squares(spark), 0.1, "x", "y", "vec_id", "zone", 9).select("vec_id", "zone")


@query(f"WITH {_PTS}, {_SQ} SELECT DISTINCT vec_id % 7 AS place, zone FROM c")
def q_covered_pairs(spark, d):
    return spatial.covered_pairs(_points(spark, d).withColumn("place", F.col("vec_id") % 7), _squares(spark), 0.1, "x", "y", "place", "zone")


_BOX = "b AS (SELECT vec_id AS k, CAST(embedding[1] AS DOUBLE) AS x0, CAST(embedding[1] AS DOUBLE) + 0.05 AS x1, CAST(embedding[2] AS DOUBLE) AS y0, CAST(embedding[2] AS DOUBLE) + 0.03 AS y1 FROM embeddings)"


@query(f"""WITH {_BOX}, j AS (SELECT a.k AS a_key, b.k AS b_key, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS area
FROM b a, b WHERE a.k % 10 = 0 AND b.k % 10 = 1 AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1) SELECT a_key, b_key, round(area, 9) AS area FROM j WHERE area > 0.0004""")
def q_box_overlaps(spark, d):
    boxes = _points(spark, d).select(F.col("vec_id").alias("k"), F.col("x").alias("x0"), (F.col("x") + 0.05).alias("x1"), F.col("y").alias("y0"), (F.col("y") + 0.03).alias("y1"))
    a, b = boxes.filter("k % 10 = 0").withColumnRenamed("k", "a_key"), boxes.filter("k % 10 = 1").withColumnRenamed("k", "b_key")
    return spatial.box_overlaps(a, b, 0.1, 0.0004).select("a_key", "b_key", F.round("area", 9).alias("area"))


@query(f"WITH {_PTS} SELECT vec_id % 5 AS g, count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, round(avg(x), 9) AS cx, round(avg(y), 9) AS cy FROM p GROUP BY g")
def q_collected_points(spark, d):
    return spatial.hull_boxes(_points(spark, d).withColumn("g", F.col("vec_id") % 5), ["g"], "x", "y").withColumn("cx", F.round("cx", 9)).withColumn("cy", F.round("cy", 9))


@query(f"""WITH {_PTS}, l0 AS (SELECT *, count(*) OVER (PARTITION BY floor(x / 0.4), floor(y / 0.4)) AS n FROM p), l1 AS (SELECT vec_id, x, y, count(*) OVER (PARTITION BY floor(x / 0.2), floor(y / 0.2)) AS n FROM l0 WHERE n > 40)
SELECT vec_id, 0 AS level FROM l0 WHERE n <= 40 UNION ALL SELECT vec_id, 1 FROM l1 WHERE n <= 40 UNION ALL SELECT vec_id, 2 FROM l1 WHERE n > 40""")
def q_quartered_cells(spark, d):
    return spatial.quartered(_points(spark, d), "x", "y", 0.4, 40, 2).select("vec_id", "level")


@query(f"WITH {_PTS} SELECT vec_id FROM p WHERE sqrt((round(x, 3) - round(y, 3)) * (round(x, 3) - round(y, 3))) > 0.1")
def q_moved(spark, d):
    p = _points(spark, d).withColumn("z", F.lit(0.0))
    return spatial.moved(p, "x", "z", "y", "z").select("vec_id")


@query(f"WITH {_PTS} SELECT vec_id, round(sqrt((x - 0.02) * (x - 0.02) + (y - 0.01) * (y - 0.01)), 9) AS distance FROM p WHERE sqrt((x - 0.02) * (x - 0.02) + (y - 0.01) * (y - 0.01)) <= 0.15")
def q_near_place(spark, d):
    return spatial.near_place(_points(spark, d), "x", "y", 0.02, 0.01, 0.15).select("vec_id", F.round("distance", 9).alias("distance"))


@query(f"WITH {_PTS} SELECT vec_id, 'LINESTRING(' || CAST(CAST(floor(x * 1000) AS BIGINT) AS VARCHAR) || ' ' || CAST(CAST(floor(y * 1000) AS BIGINT) AS VARCHAR) || ',0 0)' AS line FROM p")
def q_lines(spark, d):
    p = _points(spark, d)
    return p.select("vec_id", spatial.line(F.floor(F.col("x") * 1000), F.floor(F.col("y") * 1000), F.lit(0), F.lit(0)).alias("line"))


@query(f"""WITH {_PTS}, {_SQ}, m AS (SELECT p.vec_id, CASE WHEN p.vec_id % 4 > 0 THEN CAST(p.vec_id % 4 AS INTEGER) END AS registered, min(zone) AS zone FROM p LEFT JOIN c USING (vec_id) GROUP BY p.vec_id)
SELECT vec_id, registered, zone FROM m WHERE registered IS DISTINCT FROM zone""")
def q_registered_elsewhere(spark, d):
    p = _points(spark, d).withColumn("registered", F.when(F.col("vec_id") % 4 > 0, (F.col("vec_id") % 4).cast("int")))
    placed = spatial.covering_or(p, _squares(spark), 0.1, "x", "y", "vec_id", "zone", None)
    return spatial.registered_elsewhere(placed, "registered", "zone").select("vec_id", "registered", "zone")


@query(f"""WITH {_PTS}, {_SQ}, m AS (SELECT c.vec_id, c.zone AS there, CAST(c.vec_id % 4 AS INTEGER) AS here, x, y FROM c JOIN p USING (vec_id))
SELECT vec_id, here, there, round(sqrt((x - (x0 + 0.15)) * (x - (x0 + 0.15)) + (y - (y0 + 0.15)) * (y - (y0 + 0.15))), 9) AS distance FROM m JOIN s ON s.zone = here WHERE here <> there""")
def q_mismatch_distances(spark, d):
    met = spatial.polygon_join(_points(spark, d), _squares(spark), 0.1, "x", "y", "zone").select("vec_id", "x", "y", F.col("zone").alias("there"), (F.col("vec_id") % 4).cast("int").alias("here"))
    centre = _squares(spark, "here").select("here", (F.col("ring")[0]["x"] + 0.15).alias("cx"), (F.col("ring")[0]["y"] + 0.15).alias("cy"))
    far = F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy"))
    return met.filter("here <> there").join(F.broadcast(centre), "here").select("vec_id", "here", "there", F.round(far, 9).alias("distance")).orderBy("distance", "vec_id")
