"""Registry queries about versions, intervals, shapes, representations and incoming files, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldbook import plans, sources
from fieldbook.functions import geo, ranges
from fieldbook.functions import text as tx
from fieldbook.operators import addresses, changes, intervals, matching, relational, shapes, spatial, spelling, temporal
from fieldbook.queries import _HIST, _PTS, _SNAP, _TRI, ORACLE, RING, _points, _two_histories, _versions, big, query, t
from fieldbook.sources import sinks

# Versions


def _at(x):
    return F.lit(x).cast("timestamp_ntz")


@query(f"""WITH {_HIST}, c AS (SELECT l_orderkey AS k, min(l_partkey) AS first_part, min(l_shipdate) AS lo FROM lineitem GROUP BY 1),
j AS (SELECT o_orderkey, o_orderstatus, n_lines, greatest(o.lo, s.lo) AS lo, least(o.hi, s.hi) AS hi FROM o LEFT JOIN s ON o_orderkey = l_orderkey AND o.lo < s.hi AND s.lo < o.hi)
SELECT o_orderkey, o_orderstatus, n_lines, first_part, greatest(j.lo, c.lo) AS lo, j.hi FROM j LEFT JOIN c ON o_orderkey = k AND c.lo < j.hi""")
def q_versions_of_three(spark, d):
    o, ship = _two_histories(spark, d)
    first = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_partkey").alias("first_part"), F.min("l_shipdate").alias("lo")).withColumn("hi", F.lit(None).cast("timestamp_ntz"))
    return temporal.overlap_join_all([o, ship, first], ["o_orderkey"], "lo", "hi")


@query("""WITH k AS (SELECT o_orderkey, 2 * o_orderkey AS rowkey FROM orders WHERE o_orderkey % 3 = 0) SELECT o_orderkey, o_orderdate, rowkey FROM orders JOIN k USING (o_orderkey)
UNION ALL SELECT o_orderkey, o_orderdate, (SELECT max(rowkey) FROM k) + row_number() OVER (ORDER BY o_orderkey, o_orderdate) FROM orders WHERE o_orderkey % 3 <> 0""")
def q_stable_rowkeys(spark, d):
    h = t(spark, d, "orders").select("o_orderkey", "o_orderdate")
    known = h.filter("o_orderkey % 3 = 0").withColumn("rowkey", big(F.col("o_orderkey") * 2))
    return temporal.stable_rowkeys(h, known, ["o_orderkey"], "o_orderdate", "rowkey", relational.numbered)


@query(f"WITH {_HIST} SELECT o_orderkey, lo, CASE WHEN hi <= TIMESTAMP '1996-01-01' THEN hi END AS hi FROM o WHERE lo <= TIMESTAMP '1996-01-01'")
def q_future_reopened(spark, d):
    return ranges.reopen_future(_two_histories(spark, d)[0].select("o_orderkey", "lo", "hi"), "lo", "hi", _at("1996-01-01"))


_CUST = "h AS (SELECT o_custkey, o_orderdate AS lo, o_orderdate + INTERVAL 30 DAY AS hi, CAST(2 AS INTEGER) AS status FROM orders)"


def _customers(spark, d):
    return t(spark, d, "orders").select("o_custkey", F.col("o_orderdate").alias("lo"), (F.col("o_orderdate") + F.expr("interval 30 days")).alias("hi"), F.lit(2).alias("status"))


@query(f"WITH {_CUST} SELECT * FROM h UNION ALL SELECT o_custkey, max(hi), NULL, 10 FROM h GROUP BY o_custkey")
def q_tail_filled(spark, d):
    return ranges.fill_tail(_customers(spark, d), ["o_custkey"], "lo", "hi", "status", 10)


@query(f"WITH {_CUST} SELECT o_custkey, lo, hi FROM h UNION ALL SELECT o_custkey, TIMESTAMP '1990-01-01', min(lo) FROM h GROUP BY o_custkey")
def q_head_filled(spark, d):
    return ranges.fill_head(_customers(spark, d).drop("status"), ["o_custkey"], "lo", "hi", _at("1990-01-01"))


@query("SELECT greatest(TIMESTAMP '1995-01-01', TIMESTAMP '1996-06-01', max(o_orderdate) FILTER (WHERE o_orderdate <= TIMESTAMP '1996-06-01' + INTERVAL 2 MINUTE)) AS clock FROM orders")
def q_clock(spark, d):
    return t(spark, d, "orders").agg(ranges.clock("o_orderdate", _at("1995-01-01"), _at("1996-06-01")).alias("clock"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_linenumber::DOUBLE AS lo, l_linenumber + floor(l_quantity / 10) AS hi FROM lineitem)
SELECT l_orderkey, l_linenumber, lo < 5 AND 3 < hi AS meets, lo <= 5 AND 3 <= hi AS meets_closed, hi = 3 OR lo = 5 AS adjacent FROM l""")
def q_interval_tests(spark, d):
    line = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").cast("double").alias("lo"), (F.col("l_linenumber") + F.floor(F.col("l_quantity") / 10)).alias("hi"))
    ends, closed = [F.col("lo"), F.col("hi"), F.lit(3.0), F.lit(5.0)], (True, True)
    return line.select("l_orderkey", "l_linenumber", intervals.meets(*ends).alias("meets"), intervals.meets(*ends, closed, closed).alias("meets_closed"), intervals.adjacent(*ends).alias("adjacent"))


@query(f"""WITH r AS ({ORACLE['q_interval_priority']}), m AS (SELECT *, CASE WHEN lag(l_partkey) OVER w = l_partkey THEN 0 ELSE 1 END AS new FROM r WINDOW w AS (PARTITION BY l_orderkey ORDER BY lo)),
i AS (SELECT *, sum(new) OVER (PARTITION BY l_orderkey ORDER BY lo) AS run FROM m), o AS (SELECT l_orderkey, run, min(lo) AS lo, max(hi) AS hi, any_value(l_partkey) AS l_partkey FROM i GROUP BY l_orderkey, run)
SELECT l_orderkey, lag(hi) OVER w AS lo, CASE WHEN lead(lo) OVER w IS NOT NULL THEN hi END AS hi, l_partkey FROM o WINDOW w AS (PARTITION BY l_orderkey ORDER BY lo)""")
def q_intervals_extended(spark, d):
    lines = t(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("double").alias("lo"), (F.col("l_linenumber") + F.col("l_quantity") / 10).alias("hi"), "l_partkey")
    return intervals.resolve(lines, ["l_orderkey"], ["l_partkey", "lo", "hi"], "lo", "hi", "l_partkey", extend=True)


@query("""WITH i AS (SELECT l_orderkey, l_linenumber, l_linenumber AS a, l_linenumber + CAST(floor(l_quantity / 10) AS INTEGER) AS b, 3 AS c, 5 AS d FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN greatest(a, c) <= least(b, d) AND NOT (a = d) THEN (CASE WHEN c >= a THEN '[3' ELSE '[' || a END) || ',' || (CASE WHEN d <= b THEN '5)' ELSE b || ']' END) END AS both,
CASE WHEN a < c THEN '[' || a || ',' || (CASE WHEN b < c THEN b || ']' ELSE '3)' END) END AS before, CASE WHEN b >= d THEN '[' || greatest(a, d) || ',' || b || ']' END AS after, CASE WHEN a = d THEN '[3,' || b || ']' END AS one FROM i""")
def q_interval_algebra(spark, d):
    """Closed intervals of lines against the half-open [3,5)."""
    line = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").cast("int").alias("lo"), (F.col("l_linenumber") + F.floor(F.col("l_quantity") / 10)).cast("int").alias("hi"))
    a, b = intervals.interval(F.col("lo"), F.col("hi"), (True, True)), intervals.interval(F.lit(3), F.lit(5))
    show = {"both": intervals.intersection(a, b), "before": intervals.left_of(a, b), "after": intervals.right_of(a, b), "one": intervals.merged(a, b)}
    return line.select("l_orderkey", "l_linenumber", *[intervals.shown(c).alias(n) for n, c in show.items()])


_BOXED = "b AS (SELECT o_custkey % 50 AS street, o_orderkey AS k, CAST(floor(o_totalprice / 40000) AS BIGINT) AS y0, CAST(floor(o_totalprice / 40000) + 1 + o_orderkey % 4 AS BIGINT) AS y1, CAST(o_orderkey % 300 AS BIGINT) AS x0, CAST(o_orderkey % 300 + 5 + o_orderkey % 70 AS BIGINT) AS x1, o_orderpriority AS ref FROM orders)"
_CELLS = f"""{_BOXED}, c AS (SELECT street, x, y, max_by(ref, k) AS ref FROM (SELECT street, k, ref, unnest(range(x0, x1)) AS x, y0, y1 FROM b), LATERAL (SELECT unnest(range(y0, y1)) AS y) GROUP BY street, x, y)"""


def _boxed(spark, d):
    o = t(spark, d, "orders")
    k, y = F.col("o_orderkey"), F.floor(F.col("o_totalprice") / 40000)
    return o.select((F.col("o_custkey") % 50).alias("street"), k.alias("k"), (k % 300).cast("long").alias("x0"), (k % 300 + 5 + k % 70).cast("long").alias("x1"), y.alias("y0"), (y + 1 + k % 4).alias("y1"), F.col("o_orderpriority").alias("ref"))


@query(f"WITH {_CELLS} SELECT street, ref, count(*) AS cells, sum(x) AS sx, sum(y) AS sy FROM c GROUP BY street, ref")
def q_boxes(spark, d):
    """Boxes of time by house number on each street, the later one on top; counted by the unit cells that each ref holds."""
    out = intervals.boxes(_boxed(spark, d), ["street"], ["k"], ("x0", "x1"), ("y0", "y1"), "ref")
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    half = lambda a, b: F.expr(f"({a} + {b} - 1) * ({b} - {a}) div 2")
    return out.groupBy("street", "ref").agg(F.sum(w * h).alias("cells"), F.sum(half("x0", "x1") * h).alias("sx"), F.sum(half("y0", "y1") * w).alias("sy"))


@query("""WITH s AS (SELECT o_custkey AS street, o_orderdate AS lo, min(o_orderpriority) AS ref FROM orders GROUP BY o_custkey, o_orderdate), m AS (SELECT *, CASE WHEN lag(ref) OVER (PARTITION BY street ORDER BY lo) = ref THEN 0 ELSE 1 END AS new FROM s),
f AS (SELECT street, lo, ref, row_number() OVER (PARTITION BY street ORDER BY lo) AS n FROM m WHERE new = 1) SELECT street, CASE WHEN n > 1 THEN lo END AS lo, lead(lo) OVER (PARTITION BY street ORDER BY n) AS hi, ref FROM f""")
def q_street_names_extended(spark, d):
    """Names that each begin at an order's day and have no end: the one that began last holds, without end both ways."""
    names = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("street"), F.col("o_orderdate").alias("lo")).agg(F.min("o_orderpriority").alias("ref"))
    return intervals.names_extended(names.withColumn("hi", F.lit(None).cast("timestamp")), ["street"], "lo", "hi", "ref")


@query("""WITH p AS (SELECT c_custkey, c_custkey % 7 = 0 AS fresh, c_nationkey AS g, CASE WHEN c_custkey % 7 <> 0 THEN c_nationkey + c_custkey % 3 END AS old_g, c_custkey % 4 AS v FROM customer)
SELECT c_custkey, CASE WHEN fresh OR g IS DISTINCT FROM old_g THEN TIMESTAMP '2020-01-02' ELSE TIMESTAMP '2019-01-01' END AS geo_changed, CAST(CASE WHEN fresh THEN 1 WHEN g IS DISTINCT FROM old_g THEN v + 1 ELSE v END AS BIGINT) AS geo_version FROM p""")
def q_geometry_versions(spark, d):
    k = F.col("c_custkey")
    pairs = t(spark, d, "customer").select("c_custkey", F.when(k % 7 == 0, "insert").otherwise("update").alias("operation"), F.col("c_nationkey").alias("g"), F.when(k % 7 != 0, F.col("c_nationkey") + k % 3).alias("old_g"), _at("2019-01-01").alias("old_geo_changed"), big(k % 4).alias("old_geo_version"))
    return changes.geometry_versions(pairs, _at("2020-01-02"), "g").select("c_custkey", "geo_changed", big("geo_version").alias("geo_version"))


@query(f"WITH {_SNAP} SELECT operation, c_custkey FROM chg WHERE operation <> 'delete'")
def q_delta_file(spark, d):
    return changes.diff(*_versions(spark, d), ["c_custkey"], deletes=False).select("operation", "c_custkey")


@query(f"WITH {_SNAP} SELECT operation, c_custkey FROM chg")
def q_state_differences(spark, d):
    return changes.state_differences(*_versions(spark, d), ["c_custkey"]).select("operation", "c_custkey")


# Shapes


@query(f"WITH {_PTS} SELECT vec_id, CAST(round(200 - atan2(y, x) * 400 / (2 * pi()), 2) AS DOUBLE) AS direction FROM p")
def q_text_direction(spark, d):
    return _points(spark, d).select("vec_id", geo.text_direction(F.col("x"), F.col("y")).cast("double").alias("direction"))


_XY = "CAST(floor(x * 1000) AS BIGINT) AS i, CAST(floor(y * 1000) AS BIGINT) AS j"


def _whole(spark, d):
    return _points(spark, d).select("vec_id", F.floor(F.col("x") * 1000).alias("i"), F.floor(F.col("y") * 1000).alias("j"))


@query(f"""WITH {_PTS}, q AS (SELECT vec_id, {_XY} FROM p)
SELECT '{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' || i || ',' || j || ',7]}},"properties":{{"vec_id":' || vec_id || '}}}}' AS feature FROM q""")
def q_point_features(spark, d):
    return _whole(spark, d).select(sinks.point_feature(F.col("i"), F.col("j"), ["vec_id"], F.lit(7).cast("long")).alias("feature"))


@query(f"""WITH {_PTS}, q AS (SELECT vec_id, {_XY} FROM p) SELECT vec_id, i || ' ' || j || CASE WHEN i = 5 * (i // 5) AND j = 5 * (j // 5) THEN '' ELSE ',' || 5 * (i // 5) || ' ' || 5 * (j // 5) END AS line FROM q WHERE i > 0 AND j > 0""")
def q_flat_lines(spark, d):
    five = lambda c: F.floor(F.col(c) / 5) * 5
    p = _whole(spark, d).filter("i > 0 and j > 0")
    pts = F.array(F.array("i", "j", F.lit(1).cast("long")), F.array("i", "j", F.lit(2).cast("long")), F.array(five("i"), five("j"), F.lit(3).cast("long")))
    return p.select("vec_id", F.array_join(F.transform(sinks.without_repeats(pts), lambda q: F.array_join(q.cast("array<string>"), " ")), ",").alias("line"))


@query(f"WITH {_PTS}, q AS (SELECT vec_id, {_XY} FROM p) SELECT vec_id, 'SRID=25832; MultiLineStringZ((' || i || ' ' || j || ' 1, 0 0 2))' AS shape FROM q")
def q_shape_text(spark, d):
    n = lambda v: F.lit(v).cast("long")
    return _whole(spark, d).select("vec_id", shapes.ewkt("LineString", F.array(F.array("i", "j", n(1)), F.array(n(0), n(0), n(2))), z=True, multi=True).alias("shape"))


@query(f"WITH {_PTS} SELECT vec_id, round(x + 5, 6) AS x, round(y + 5, 6) AS y FROM p")
def q_visual_centre(spark, d):
    def square(side, off=0.0):
        corners = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
        return F.array(F.array(*[F.array(F.col("x") + off + a * side, F.col("y") + off + b * side) for a, b in corners]))

    p = _points(spark, d).select("vec_id", shapes.visual_centre(F.array(square(2.0, 20.0), square(10.0))).alias("c"))
    return p.select("vec_id", F.round("c.x", 6).alias("x"), F.round("c.y", 6).alias("y"))


@query(f"WITH {_PTS} SELECT vec_id, round(x + 2, 6) AS x, round(y, 6) AS y FROM p")
def q_line_centre(spark, d):
    at = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    p = _points(spark, d).select("vec_id", shapes.nearest_to_centroid(F.array(at(0.0, 0.0), at(1.0, 0.0), at(4.0, 0.0))).alias("c"))
    return p.select("vec_id", F.round("c.x", 6).alias("x"), F.round("c.y", 6).alias("y"))


@query(f"WITH {_PTS} SELECT vec_id FROM p WHERE " + " AND ".join(f"({bx} - ({ax})) * (y - ({ay})) - ({by} - ({ay})) * (x - ({ax})) > 0" for (ax, ay), (bx, by) in zip(RING, RING[1:], strict=False)))
def q_polygon_interior(spark, d):
    return spatial.within_polygon(_points(spark, d), "x", "y", RING, boundary=False).select("vec_id")


# Representations and order


@query("""SELECT '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' AS json FROM region""")
def q_json_rows(spark, d):
    return sinks.as_json(t(spark, d, "region").select("r_regionkey", "r_name"))


@query("SELECT doc_id, CASE WHEN length(text) > 500 THEN sha256(text) END AS ref, CASE WHEN NOT coalesce(length(text) > 500, false) THEN text END AS text FROM documents")
def q_offloaded(spark, d):
    return sinks.offload(t(spark, d, "documents").select("doc_id", "text"), ["doc_id"], "text", 500)[0].select("doc_id", "ref", "text")


@query("SELECT DISTINCT sha256(text) AS ref, length(text) AS size FROM documents WHERE length(text) > 500")
def q_offloaded_blobs(spark, d):
    return sinks.offload(t(spark, d, "documents").select("doc_id", "text"), ["doc_id"], "text", 500)[1].select("ref", big(F.length("text")).alias("size"))


_FLOORS, _DOORS = [None, "kl2", "kl", "st", "1", "10", "loft"], [None, "tv", "mf", "th", "2", "x1"]


@query("SELECT c_custkey FROM customer ORDER BY c_custkey % 7, c_custkey % 6, c_custkey LIMIT 60")
def q_floor_door_order(spark, d):
    k = F.col("c_custkey")
    pick = lambda values, n: F.get(F.array(*[F.lit(v).cast("string") for v in values]), (k % n).cast("int"))
    c = t(spark, d, "customer").select("c_custkey", pick(_FLOORS, 7).alias("floor"), pick(_DOORS, 6).alias("door"))
    return c.orderBy(tx.sort_rank_floor(F.col("floor")), tx.sort_rank_door(F.col("door")), "c_custkey").limit(60).select("c_custkey")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, o_orderdate AS lo, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate END AS hi FROM orders) ORDER BY hi IS NOT NULL, lo NULLS FIRST, o_orderkey LIMIT 50")
def q_version_order(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("lo"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate")).alias("hi"))
    return o.orderBy(*addresses.version_order("lo", "hi"), "o_orderkey").limit(50).select("o_orderkey")


@query("SELECT p_partkey, label, place FROM part, unnest(list_distinct([p_name, p_brand])) u(label), unnest(list_distinct([p_type, 'here'])) v(place)")
def q_variants(spark, d):
    p = t(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", F.lit("here").alias("here"), F.lit(None).cast("string").alias("none"))
    return matching.variants(p, {"label": ["p_name", "p_brand", "none"], "place": ["p_type", "here"]}).select("p_partkey", "label", "place")


@query(f"""WITH g AS (SELECT k, p_name, {_TRI.format('p_name')} AS a, {_TRI.format("'smal widgte'")} AS b FROM (SELECT min(p_partkey) AS k, p_name FROM part GROUP BY p_name)), s AS (SELECT k, p_name FROM g ORDER BY round(1 - len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6), p_name LIMIT 40)
SELECT k, p_name, CAST(levenshtein(p_name, 'smal widgte') AS BIGINT) AS edits FROM s ORDER BY edits, p_name LIMIT 10""")
def q_fuzzy_names(spark, d):
    names = t(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("k"))
    near = matching.trigram_top(names, "p_name", "smal widgte", "p_name", 40)
    return near.select("k", "p_name", big(F.levenshtein("p_name", F.lit("smal widgte"))).alias("edits")).orderBy("edits", "p_name").limit(10)


@query("""WITH k AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS word FROM part), f AS (SELECT word, replace(replace(word, 'small', 'smaal'), 'wid', 'whid') AS other FROM k)
SELECT word, array_to_string(list_sort([word, other]), ' ') AS synonyms FROM f WHERE other <> word""")
def q_synonym_groups(spark, d):
    found = spelling.synonym_groups(t(spark, d, "part").select("p_name").distinct(), "p_name", [("small", "smaal", True), ("wid", "whid", False)])
    return found.select("word", F.array_join("synonyms", " ").alias("synonyms"))


@query("SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS nation FROM supplier")
def q_chosen_representation(spark, d):
    tables = {"customer": t(spark, d, "customer"), "supplier": t(spark, d, "supplier")}
    asked = {"kind": "supplier", "format": "csv"}
    rows = plans.choose_table(tables, asked, "kind", "customer").withColumn("nation", big("s_nationkey"))
    offered = {("json", "nested"): ["s_suppkey", F.struct("s_name", "nation").alias("properties")], ("csv", "flat"): ["s_suppkey", "s_name", "nation"]}
    return plans.represent(rows, offered, asked)


# Incoming files


@query("SELECT 'N_' || CASE WHEN n_nationkey = 10 THEN 'TE' ELSE 'DA' END || '000_' || lpad(CAST(n_nationkey AS VARCHAR), 5, '0') || '_2019' AS name, CAST(n_nationkey AS BIGINT) AS serial FROM nation WHERE n_nationkey > 12")
def q_new_files(spark, d):
    k = F.col("n_nationkey")
    name = F.concat(F.lit("N_"), F.when(k == 10, "TE").otherwise("DA"), F.lit("000_"), F.lpad(k.cast("string"), 5, "0"), F.lit("_2019"))
    return sources.new_files(t(spark, d, "nation").select(name.alias("name")), imported=12).select("name", "serial")


@query("SELECT user_id, min(event_id) AS created, max(event_id) AS updated, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def q_merged_events(spark, d):
    e = t(spark, d, "events").select("user_id", F.col("event_id").alias("created"), F.col("event_id").alias("updated"), "event_type")
    return sources.merge_events(e, "user_id", "created", "updated")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber < l_quantity / 10 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) = 1")
def q_admitted(spark, d):
    lines = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity") / 10).alias("hi"))
    return sources.admit(lines, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], [("l_linenumber", "hi")]).select("l_orderkey", "l_linenumber")


@query(f"WITH {_PTS} SELECT vec_id, CASE WHEN vec_id % 5 <> 0 THEN floor(x * 100 * 10 + 0.5) / 10 END AS z FROM p")
def q_heights(spark, d):
    return _points(spark, d).select("vec_id", sources.height(F.when(F.col("vec_id") % 5 == 0, -9999.0).otherwise(F.col("x") * 100)).alias("z"))
