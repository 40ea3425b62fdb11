"""The registry operators on the driver's tables: name -> (query, SQL). SQL is None where it cannot express the operator; tests cover those."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldbook import streaming
from fieldbook.functions import geo, ranges
from fieldbook.functions import text as tx
from fieldbook.operators import changes, intervals, matching, relational, spatial, temporal
from fieldbook.plans import Parameter, Resource

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def big(c) -> F.Column:
    return F.col(c).cast("long") if isinstance(c, str) else c.cast("long")


# Filters, joins, paging


def star(spark: SparkSession, d: str) -> DataFrame:
    """orders with customer, nation and region; the small dimensions are left to the optimizer to broadcast by their size."""
    o, c, n, r = (t(spark, d, x) for x in ("orders", "customer", "nation", "region"))
    return o.join(c, o.o_custkey == c.c_custkey, "left").join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left")


ORDERS = Resource(["o_orderkey"], {"nation": Parameter("n_name"), "status": Parameter("o_orderstatus"), "priority": Parameter("o_orderpriority")})


@query("""SELECT o_orderkey, c_name, n_name, r_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey IN (1, 2, 3) AND o_orderstatus IN ('F', 'O') ORDER BY o_orderkey LIMIT 25 OFFSET 25""")
def q_star_filter_page(spark, d):
    rows = ORDERS.query(star(spark, d).filter(F.col("n_nationkey").isin(1, 2, 3)), {"status": "F|O", "side": "2", "per_side": "25"}, validate=True)
    return rows.select("o_orderkey", "c_name", "n_name", "r_name", "o_totalprice")


@query("""SELECT c_custkey, n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 2) ON c_nationkey = n_nationkey
WHERE n_nationkey = 1 OR n_nationkey IS NULL""")
def q_null_or_filter(spark, d):
    n = t(spark, d, "nation").filter("n_regionkey < 2")
    both = t(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return relational.where(both, {"n_nationkey": [1, None]}).select("c_custkey", "n_name")


def _orders_of(spark, d, year):
    return t(spark, d, "orders").filter(F.col("o_orderdate").between(f"{year}-01-01 00:00:00", f"{year}-12-31 23:59:59")).select(F.col("o_custkey").alias("c_custkey"))


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND year(o_orderdate) = 1996)")
def q_semi_exists(spark, d):
    return relational.exists(t(spark, d, "customer"), _orders_of(spark, d, 1996), ["c_custkey"]).select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND year(o_orderdate) = 1996)")
def q_anti_missing(spark, d):
    return relational.missing(t(spark, d, "customer"), _orders_of(spark, d, 1996), ["c_custkey"]).select("c_custkey", "c_name")


@query("SELECT p_partkey, NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45) AS unsold FROM part")
def q_not_exists_flag(spark, d):
    sold = t(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return relational.flag_missing(t(spark, d, "part"), sold, ["p_partkey"], "unsold").select("p_partkey", "unsold")


@query("SELECT c_custkey, count(o_orderkey) AS n_open FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY c_custkey")
def q_join_on_condition(spark, d):
    both = t(spark, d, "customer").join(t(spark, d, "orders"), (F.col("o_custkey") == F.col("c_custkey")) & (F.col("o_orderstatus") == "P"), "left")
    return both.groupBy("c_custkey").agg(F.count("o_orderkey").alias("n_open"))


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^[a-m][a-z]+ [n-z]')")
def q_regex_filter(spark, d):
    return t(spark, d, "part").filter(F.col("p_name").rlike("^[a-m][a-z]+ [n-z]")).select("p_partkey", "p_name")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE NOT (c_acctbal < 0)")
def q_negated_filter(spark, d):
    return t(spark, d, "customer").filter(~(F.col("c_acctbal") < 0)).select("c_custkey", "c_acctbal")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def q_in_subquery(spark, d):
    n = t(spark, d, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"))
    return relational.exists(t(spark, d, "supplier"), n, ["s_nationkey"]).select("s_suppkey", "s_name")


def _line_order():
    return [F.col(c) for c in ("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]


@query("""SELECT l_orderkey, l_partkey, l_shipdate FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r
FROM lineitem) WHERE r = 1""")
def q_lateral_first(spark, d):
    return relational.first_per_key(t(spark, d, "lineitem"), ["l_orderkey"], _line_order()).select("l_orderkey", "l_partkey", "l_shipdate")


@query("""SELECT o_orderkey, lo, hi FROM orders LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey
WHERE o_orderstatus = 'P'""")
def q_scalar_pre_agg(spark, d):
    spans = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("lo"), F.max("l_shipdate").alias("hi"))
    return t(spark, d, "orders").filter("o_orderstatus = 'P'").join(spans, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "lo", "hi")


@query("""SELECT n.n_nationkey, n.n_name, count(c.c_custkey) AS customers, (SELECT count(*) FROM supplier s WHERE s.s_nationkey = n.n_nationkey) AS suppliers
FROM nation n LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY ALL""")
def q_correlated_counts(spark, d):
    c = t(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    s = t(spark, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("suppliers"))
    both = t(spark, d, "nation").join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return both.select("n_nationkey", "n_name", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


@query("SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS nations FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def q_nested_collect(spark, d):
    n = t(spark, d, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("names"))
    return t(spark, d, "region").join(n, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("r_name", F.array_join("names", ",").alias("nations"))


# Aggregates and windows


@query("""SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p
FROM orders GROUP BY o_orderpriority""")
def q_cond_sum_pivot(spark, d):
    wide = t(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)
    return wide.select("o_orderpriority", *[F.col(s).alias(s.lower()) for s in "FOP"])


@query("SELECT md5(text) AS digest, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY md5(text) HAVING count(*) > 1")
def q_having_dups(spark, d):
    return t(spark, d, "documents").groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).filter("copies > 1")


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) r FROM orders) WHERE r = 1")
def q_distinct_on(spark, d):
    return relational.first_per_key(t(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderdate")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, greatest(l_discount, nullif(l_tax, 0.0)) AS hi, least(l_discount, nullif(l_tax, 0.0)) AS lo FROM lineitem""")
def q_greatest_least(spark, d):
    tax = F.nullif("l_tax", F.lit(0.0))
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.greatest("l_discount", tax).alias("hi"), F.least("l_discount", tax).alias("lo"))


@query("""SELECT l_partkey, CASE WHEN count(*) = count(nullif(l_shipdate, TIMESTAMP '1995-06-01')) THEN min(l_shipdate) END AS lo, max(l_shipdate) AS hi FROM lineitem GROUP BY l_partkey""")
def q_range_merge(spark, d):
    lines = t(spark, d, "lineitem").select("l_partkey", F.nullif("l_shipdate", F.lit("1995-06-01").cast("timestamp_ntz")).alias("lo"), F.col("l_shipdate").alias("hi"))
    lo, hi = ranges.merged("lo", "hi")
    return lines.groupBy("l_partkey").agg(lo.alias("lo"), hi.alias("hi"))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f, max(o_orderkey) AS last_key, max(o_orderdate) AS last_date FROM orders")
def q_global_counts(spark, d):
    return t(spark, d, "orders").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("n_f"), F.max("o_orderkey").alias("last_key"), F.max("o_orderdate").alias("last_date"))


@query("""WITH s AS (SELECT CAST(ts AS DATE) AS day, CASE WHEN event_type = 'error' THEN -1 ELSE 1 END AS x FROM events), a AS (SELECT day, sum(x) AS delta FROM s GROUP BY day)
SELECT day, CAST(delta AS BIGINT) AS delta, CAST(sum(delta) OVER (ORDER BY day) AS BIGINT) AS stock FROM a""")
def q_running_stock(spark, d):
    # summed by day first: what the running sum sorts in one place is one row a day
    e = t(spark, d, "events").select(F.to_date("ts").alias("day"), F.when(F.col("event_type") == "error", -1).otherwise(1).alias("x"))
    daily = e.groupBy("day").agg(F.sum("x").cast("long").alias("delta"))
    return daily.withColumn("stock", F.sum("delta").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC) r
FROM lineitem WHERE l_linenumber <= 3) WHERE r = 1 AND l_returnflag <> 'R'""")
def q_latest_asof(spark, d):
    lines = t(spark, d, "lineitem").withColumn("op", F.when(F.col("l_returnflag") == "R", "delete").otherwise("update"))
    return relational.latest_as_of(lines, ["l_orderkey"], "l_linenumber", 3, "op", ("l_partkey", "l_suppkey")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("SELECT o_orderkey, 1000 + row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS seq FROM orders WHERE o_orderstatus = 'P'")
def q_seq_assign(spark, d):
    rows = t(spark, d, "orders").filter("o_orderstatus = 'P'").select("o_orderkey", "o_orderdate")
    return relational.numbered(rows, ["o_orderdate", "o_orderkey"], "seq", 1000).select("o_orderkey", "seq")


@query("""SELECT event_id, user_id, lag(event_type) OVER w AS old_event_type, event_type FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id) QUALIFY lag(event_type) OVER w IS DISTINCT FROM event_type""")
def q_attr_changes(spark, d):
    seen = changes.before_after(t(spark, d, "events"), ["user_id"], ["ts", "event_id"], ["event_type"])
    return seen.filter(~F.col("event_type").eqNullSafe(F.col("old_event_type"))).select("event_id", "user_id", "old_event_type", "event_type")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def q_topk(spark, d):
    return t(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 20 OFFSET 40")
def q_offset_page(spark, d):
    return relational.page(t(spark, d, "part").select("p_partkey", "p_name"), ["p_partkey"], number=3)


@query("SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier")
def q_union_distinct(spark, d):
    return t(spark, d, "customer").select(F.col("c_nationkey").alias("nationkey")).union(t(spark, d, "supplier").select("s_nationkey")).distinct()


@query("SELECT n_nationkey AS nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def q_except_keys(spark, d):
    return t(spark, d, "nation").select(F.col("n_nationkey").alias("nationkey")).subtract(t(spark, d, "supplier").filter("s_acctbal > 5000").select("s_nationkey"))


@query("SELECT c_nationkey AS nationkey FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier")
def q_intersect_keys(spark, d):
    return t(spark, d, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("nationkey")).intersect(t(spark, d, "supplier").select("s_nationkey"))


@query("""WITH e AS (SELECT p_partkey, p_name FROM part WHERE p_name = 'no such part') SELECT * FROM e UNION ALL
SELECT p_partkey, p_name FROM part WHERE levenshtein(p_name, 'small widgt') <= 2 AND NOT EXISTS (SELECT 1 FROM e)""")
def q_fallback(spark, d):
    p = t(spark, d, "part").select("p_partkey", "p_name")
    return relational.fallback(p.filter("p_name = 'no such part'"), p.filter(F.levenshtein("p_name", F.lit("small widgt")) <= 2))


# Functions


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, lpad(CAST(l_suppkey AS VARCHAR), 8, '0') || lpad(CAST(l_linenumber AS VARCHAR), 4, '_') AS key,
CAST(l_suppkey AS VARCHAR) AS part1, CAST(l_linenumber AS VARCHAR) AS part2 FROM lineitem""")
def q_format_keys(spark, d):
    key = tx.composite_key((F.col("l_suppkey"), 8, "0"), (F.col("l_linenumber"), 4, "_"))
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", key.alias("key"))
    return rows.withColumn("part1", tx.key_part(F.col("key"), 1, 8)).withColumn("part2", tx.key_part(F.col("key"), 9, 4, "_"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '.000' AS iso FROM orders")
def q_iso_ts(spark, d):
    return t(spark, d, "orders").select("o_orderkey", tx.iso_local(F.col("o_orderdate")).alias("iso"))


@query("""SELECT c_custkey, concat_ws(', ', c_name || ' ' || CAST(c_custkey % 90 AS VARCHAR), CASE WHEN c_custkey % 3 > 0 THEN CAST(c_custkey % 3 AS VARCHAR) || '. tv' END, nullif(n_name, 'none'),
CASE WHEN length(CAST(c_nationkey AS VARCHAR)) < 4 THEN lpad(CAST(c_nationkey AS VARCHAR), 4, '0') ELSE CAST(c_nationkey AS VARCHAR) END || ' ' || c_mktsegment) AS line
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def q_address_line(spark, d):
    floor = F.when(F.col("c_custkey") % 3 > 0, (F.col("c_custkey") % 3).cast("string"))
    line = tx.address_line(F.col("c_name"), (F.col("c_custkey") % 90).cast("string"), floor, F.when(floor.isNotNull(), "tv"), F.col("n_name"), tx.padded(F.col("c_nationkey"), 4), F.col("c_mktsegment"))
    return t(spark, d, "customer").join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", line.alias("line"))


@query("SELECT p_partkey, CAST(levenshtein(p_name, 'smal widgte') AS BIGINT) AS edits FROM part")
def q_edit_distance(spark, d):
    return t(spark, d, "part").select("p_partkey", big(F.levenshtein("p_name", F.lit("smal widgte"))).alias("edits"))


_TRI = "list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query(f"""WITH g AS (SELECT p_partkey, p_name, {_TRI.format('p_name')} AS a, {_TRI.format("'smal widgte'")} AS b FROM part)
SELECT p_partkey, p_name, round(1 - len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS distance FROM g ORDER BY distance, p_partkey LIMIT 15""")
def q_trigram_topk(spark, d):
    return matching.trigram_top(t(spark, d, "part").select("p_partkey", "p_name"), "p_name", "smal widgte", "p_partkey", 15)


# Change data


def _versions(spark, d):
    """(source, target): a derived snapshot of customer against customer itself."""
    target = t(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    kept = target.filter("c_custkey % 7 <> 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 5 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return kept.unionByName(target.filter("c_custkey % 11 = 0").withColumn("c_custkey", F.col("c_custkey") + 10_000_000)), target


_SNAP = """tgt AS (SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer), src AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, c_mktsegment
FROM tgt WHERE c_custkey % 7 <> 0 UNION ALL SELECT c_custkey + 10000000, c_name, c_acctbal, c_mktsegment FROM tgt WHERE c_custkey % 11 = 0),
chg AS (SELECT CASE WHEN t.c_custkey IS NULL THEN 'insert' WHEN s.c_custkey IS NULL THEN 'delete' ELSE 'update' END AS operation,
t.c_custkey IS NULL OR s.c_custkey IS NULL OR s.c_name <> t.c_name OR s.c_mktsegment <> t.c_mktsegment AS public,
coalesce(s.c_custkey, t.c_custkey) AS c_custkey, coalesce(s.c_name, t.c_name) AS c_name, coalesce(s.c_acctbal, t.c_acctbal) AS c_acctbal, coalesce(s.c_mktsegment, t.c_mktsegment) AS c_mktsegment
FROM src s FULL JOIN tgt t ON s.c_custkey = t.c_custkey WHERE s.c_custkey IS NULL OR t.c_custkey IS NULL OR s.c_acctbal <> t.c_acctbal)"""


@query(f"WITH {_SNAP} SELECT * FROM chg")
def q_diff_ins_upd_del(spark, d):
    return changes.diff(*_versions(spark, d), ["c_custkey"], public=["c_name", "c_mktsegment"])


@query(f"WITH {_SNAP} SELECT operation, c_custkey FROM chg WHERE c_custkey % 2 = 0")
def q_diff_subset(spark, d):
    source, target = _versions(spark, d)
    dirty = source.select("c_custkey").union(target.select("c_custkey")).filter("c_custkey % 2 = 0")
    return changes.diff_subset(source, target, dirty, ["c_custkey"]).select("operation", "c_custkey")


@query(f"WITH {_SNAP} SELECT * FROM src")
def q_apply_changes(spark, d):
    source, target = _versions(spark, d)
    return changes.apply(target, changes.diff(source, target, ["c_custkey"]), ["c_custkey"])


@query(f"WITH {_SNAP} SELECT coalesce(s.c_custkey, t.c_custkey) AS c_custkey, s.c_acctbal AS new_bal, t.c_acctbal AS old_bal FROM src s FULL JOIN tgt t ON s.c_custkey = t.c_custkey WHERE s.c_acctbal IS DISTINCT FROM t.c_acctbal")
def q_full_outer_diff(spark, d):
    s, o = _versions(spark, d)
    both = s.select("c_custkey", F.col("c_acctbal").alias("new_bal")).join(o.select("c_custkey", F.col("c_acctbal").alias("old_bal")), "c_custkey", "full")
    return both.filter(~F.col("new_bal").eqNullSafe(F.col("old_bal")))


def _mat(orders: DataFrame, customers: DataFrame) -> DataFrame:
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_custkey", "c_name", "c_acctbal")


@query(f"WITH {_SNAP} SELECT DISTINCT o_orderkey FROM orders JOIN chg ON o_custkey = c_custkey")
def q_dirty_keys(spark, d):
    source, target = _versions(spark, d)
    o = t(spark, d, "orders")
    changed = changes.diff(source, target, ["c_custkey"]).select(F.col("c_custkey").alias("o_custkey"))
    return changes.dirty_keys(_mat(o, target), _mat(o, source), changed, ["o_orderkey"], ["o_custkey"])


@query(f"WITH {_SNAP} SELECT o_orderkey, o_custkey, c_name, c_acctbal FROM orders JOIN src ON o_custkey = c_custkey")
def q_ivm_equals_full(spark, d):
    source, target = _versions(spark, d)
    o = t(spark, d, "orders")
    old, view = _mat(o, target), _mat(o, source)
    changed = changes.diff(source, target, ["c_custkey"]).select(F.col("c_custkey").alias("o_custkey"))
    return changes.materialize(view, old, changes.dirty_keys(old, view, changed, ["o_orderkey"], ["o_custkey"]), ["o_orderkey"])[0]


def _operations(spark, d):
    e = t(spark, d, "events")
    return e.select("event_id", "user_id", "ts", "event_type", F.when(F.col("event_type") == "signup", "insert").when(F.col("event_type") == "error", "delete").otherwise("update").alias("operation"))


_OPS = "ops AS (SELECT event_id, user_id, ts, event_type, CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'update' END AS operation FROM events)"


@query(f"""WITH {_OPS}, l AS (SELECT * FROM ops QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT user_id, event_id, CASE WHEN operation = 'delete' THEN 'delete' WHEN user_id % 2 = 0 THEN 'update' ELSE 'insert' END AS operation FROM l WHERE operation <> 'delete' OR user_id % 2 = 0""")
def q_client_last_op(spark, d):
    ops = _operations(spark, d)
    replica = ops.select("user_id").distinct().filter("user_id % 2 = 0")
    return changes.for_replica(ops, replica, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "operation")


@query(f"""WITH {_OPS}, p AS (SELECT *, lag(operation) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM ops)
SELECT event_id, operation, previous FROM p WHERE CASE WHEN operation = 'insert' THEN coalesce(previous <> 'delete', false) ELSE NOT coalesce(previous <> 'delete', false) END""")
def q_history_invalid(spark, d):
    return changes.invalid_history(_operations(spark, d), ["user_id"], ["ts", "event_id"]).select("event_id", "operation", "previous")


@query(f"""WITH {_SNAP} SELECT count(*) AS total, count(*) FILTER (WHERE s.c_name IS DISTINCT FROM t.c_name) AS c_name, count(*) FILTER (WHERE s.c_acctbal IS DISTINCT FROM t.c_acctbal) AS c_acctbal
FROM src s JOIN tgt t ON s.c_custkey = t.c_custkey""")
def q_change_column_counts(spark, d):
    s, o = _versions(spark, d)
    pairs = s.join(o.select("c_custkey", F.col("c_name").alias("old_c_name"), F.col("c_acctbal").alias("old_c_acctbal")), "c_custkey")
    return changes.column_change_counts(pairs, ["c_name", "c_acctbal"])


@query("""WITH p AS (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old, event_type AS new FROM events)
SELECT old, new, count(*) AS n FROM p WHERE old IS DISTINCT FROM new GROUP BY old, new""")
def q_value_transitions(spark, d):
    return changes.transitions(changes.before_after(t(spark, d, "events"), ["user_id"], ["ts", "event_id"], ["event_type"]), "event_type")


@query(f"WITH {_OPS} SELECT CAST(ts AS DATE) AS tx, count(*) FILTER (WHERE operation = 'insert') AS inserts, count(*) FILTER (WHERE operation = 'update') AS updates, count(*) FILTER (WHERE operation = 'delete') AS deletes FROM ops GROUP BY 1")
def q_tx_counts(spark, d):
    wide = _operations(spark, d).groupBy(F.to_date("ts").alias("tx")).pivot("operation", ["insert", "update", "delete"]).count().na.fill(0)
    return wide.select("tx", *[F.col(c).alias(f"{c}s") for c in ("insert", "update", "delete")])


# Histories


@query("""WITH h AS (SELECT user_id, event_type, CASE WHEN row_number() OVER w > 1 THEN ts END AS lo, lead(ts) OVER w AS hi FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
f AS (SELECT *, CASE WHEN lag(hi) OVER w IS NOT DISTINCT FROM lo AND lo IS NOT NULL AND lag(event_type) OVER w IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS fresh FROM h WINDOW w AS (PARTITION BY user_id ORDER BY lo NULLS FIRST)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY lo NULLS FIRST ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT user_id, event_type, CASE WHEN count(*) = count(lo) THEN min(lo) END AS lo, CASE WHEN count(*) = count(hi) THEN max(hi) END AS hi FROM i GROUP BY user_id, event_type, island""")
def q_coalesce_valid_time(spark, d):
    history = ranges.from_change_log(t(spark, d, "events").select("user_id", "event_type", "ts"), ["user_id"], "ts").drop("ts")
    return ranges.coalesce_valid_time(history, ["user_id"], ["event_type"], "lo", "hi")


def _two_histories(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_orderdate").alias("lo"), (F.col("o_orderdate") + F.expr("interval 30 days")).alias("hi"))
    ship = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_lines"), F.min("l_shipdate").alias("lo"), (F.max("l_shipdate") + F.expr("interval 1 day")).alias("hi"))
    return o, ship


_HIST = """o AS (SELECT o_orderkey, o_orderstatus, o_orderdate AS lo, o_orderdate + INTERVAL 30 DAY AS hi FROM orders),
s AS (SELECT l_orderkey, count(*) AS n_lines, min(l_shipdate) AS lo, max(l_shipdate) + INTERVAL 1 DAY AS hi FROM lineitem GROUP BY 1)"""


@query(f"WITH {_HIST} SELECT o_orderkey, o_orderstatus, n_lines, greatest(o.lo, s.lo) AS lo, least(o.hi, s.hi) AS hi FROM o JOIN s ON o_orderkey = l_orderkey AND o.lo < s.hi AND s.lo < o.hi")
def q_temporal_overlap(spark, d):
    return temporal.overlap_join(*_two_histories(spark, d), ["o_orderkey"], "lo", "hi")


@query(f"WITH {_HIST} SELECT o_orderkey, o_orderstatus, n_lines, greatest(o.lo, s.lo) AS lo, least(o.hi, s.hi) AS hi FROM o LEFT JOIN s ON o_orderkey = l_orderkey AND o.lo < s.hi AND s.lo < o.hi")
def q_temporal_outer(spark, d):
    return temporal.overlap_join(*_two_histories(spark, d), ["o_orderkey"], "lo", "hi", outer=True)


@query(f"WITH {_HIST} SELECT o_orderkey, n_lines FROM o JOIN s ON o_orderkey = l_orderkey WHERE s.lo <= TIMESTAMP '1996-01-15' AND TIMESTAMP '1996-01-15' < s.hi")
def q_asof_snapshot(spark, d):
    _, ship = _two_histories(spark, d)
    return temporal.valid_at(ship, "lo", "hi", F.lit("1996-01-15").cast("timestamp_ntz")).select("o_orderkey", "n_lines")


@query(f"WITH {_HIST} SELECT o_orderkey FROM o WHERE (lo > TIMESTAMP '1996-01-01' AND lo <= TIMESTAMP '1996-02-01') OR (hi > TIMESTAMP '1996-01-01' AND hi <= TIMESTAMP '1996-02-01')")
def q_became_valid(spark, d):
    o, _ = _two_histories(spark, d)
    a, b = (F.lit(x).cast("timestamp_ntz") for x in ("1996-01-01", "1996-02-01"))
    return o.filter(ranges.became_valid(F.col("lo"), F.col("hi"), a, b)).select("o_orderkey")


@query(f"WITH {_HIST} SELECT o_orderkey, lo, least(hi, TIMESTAMP '1996-01-01') AS hi FROM o WHERE lo < TIMESTAMP '1996-01-01'")
def q_clip_history(spark, d):
    o, _ = _two_histories(spark, d)
    return ranges.clip(o.select("o_orderkey", "lo", "hi"), "lo", "hi", F.lit("1996-01-01").cast("timestamp_ntz"), before=True)


@query("""WITH b AS (SELECT p_partkey AS l_partkey, p_size AS lo, p_size + 9 AS hi, CASE WHEN p_partkey % 2 = 0 THEN 'L' ELSE 'U' END AS side FROM part)
SELECT l_orderkey, l_linenumber, l.l_partkey, l_suppkey, CAST(lo AS BIGINT) AS lo FROM lineitem l JOIN b ON l.l_partkey = b.l_partkey AND CAST(l_quantity AS BIGINT) BETWEEN lo AND hi
AND side = CASE WHEN CAST(l_quantity AS BIGINT) % 2 = 0 THEN 'L' ELSE 'U' END""")
def q_range_contains_parity(spark, d):
    bands = t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), big("p_size").alias("lo"), (big("p_size") + 9).alias("hi"), temporal.parity_side(F.col("p_partkey")).alias("side"))
    lines = t(spark, d, "lineitem").withColumn("q", big("l_quantity")).withColumn("side", temporal.parity_side(F.col("q")))
    return temporal.banded_join(lines, bands, ["l_partkey", "side"], "q", "lo", "hi", 10).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "lo")


@query("""WITH l AS (SELECT l_orderkey, CAST(l_linenumber AS DOUBLE) AS lo, l_linenumber + l_quantity / 10 AS hi, l_partkey FROM lineitem),
b AS (SELECT l_orderkey, lo AS x FROM l UNION SELECT l_orderkey, hi FROM l), p AS (SELECT l_orderkey, x AS lo, lead(x) OVER (PARTITION BY l_orderkey ORDER BY x) AS hi FROM b),
c AS (SELECT p.l_orderkey, p.lo, p.hi, l.l_partkey, row_number() OVER (PARTITION BY p.l_orderkey, p.lo ORDER BY l.l_partkey DESC, l.lo DESC, l.hi DESC) AS r FROM p JOIN l ON p.l_orderkey = l.l_orderkey AND l.lo <= p.lo AND p.hi <= l.hi),
n AS (SELECT *, CASE WHEN lag(hi) OVER w = lo AND lag(l_partkey) OVER w = l_partkey THEN 0 ELSE 1 END AS n FROM c WHERE r = 1 WINDOW w AS (PARTITION BY l_orderkey ORDER BY lo)),
i AS (SELECT *, sum(n) OVER (PARTITION BY l_orderkey ORDER BY lo) AS i FROM n) SELECT l_orderkey, min(lo) AS lo, max(hi) AS hi, any_value(l_partkey) AS l_partkey FROM i GROUP BY l_orderkey, i""")
def q_interval_priority(spark, d):
    lines = t(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("double").alias("lo"), (F.col("l_linenumber") + F.col("l_quantity") / 10).alias("hi"), "l_partkey")
    return intervals.resolve(lines, ["l_orderkey"], ["l_partkey", "lo", "hi"], "lo", "hi", "l_partkey")


@query("""WITH h AS (SELECT o_custkey, o_orderkey, o_orderdate AS lo, o_orderdate + INTERVAL 30 DAY AS hi FROM orders), n AS (SELECT *, lead(lo) OVER (PARTITION BY o_custkey ORDER BY lo, hi, o_orderkey) AS next_lower FROM h)
SELECT o_custkey, count(*) AS n FROM n WHERE next_lower < hi GROUP BY o_custkey""")
def q_overlap_violations(spark, d):
    h = t(spark, d, "orders").select("o_custkey", F.col("o_orderdate").alias("lo"), (F.col("o_orderdate") + F.expr("interval 30 days")).alias("hi"))
    return ranges.overlapping_versions(h, ["o_custkey"], "lo", "hi").groupBy("o_custkey").agg(F.count("*").alias("n"))


# Search and matching


_WORDS = "list_distinct(list_filter(string_split_regex(lower(regexp_replace({0}, '[\\\\./-]', ' ', 'g')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''))"


@query(f"""WITH i AS (SELECT doc_id, unnest({_WORDS.format('text')}) AS token FROM documents), m AS (SELECT doc_id, count(*) AS n, bool_or(token = 'the') AS a, bool_or(starts_with(token, 'tio')) AS b,
sum(CASE WHEN token = 'the' OR starts_with(token, 'tio') THEN 1 ELSE 0 END) AS w FROM i GROUP BY doc_id) SELECT doc_id, CAST(round(1000000 * w / (1.64493406685 * 2 * log2(n + 1))) AS BIGINT) AS rank FROM m WHERE a AND b""")
def q_fts_all_prefix(spark, d):
    return matching.match_scan(t(spark, d, "documents"), "doc_id", {"text": "A"}, "the tio", prefix_last=True)


@query(f"""WITH i AS (SELECT p_partkey, unnest({_WORDS.format('p_name')}) AS token, 'A' AS class FROM part UNION ALL SELECT p_partkey, unnest({_WORDS.format('p_type')}), 'C' FROM part),
x AS (SELECT p_partkey, token, min(class) AS class FROM i GROUP BY ALL), m AS (SELECT p_partkey, count(*) AS n, bool_or(starts_with(token, 's')) AS a, sum(CASE WHEN starts_with(token, 's') THEN CASE class WHEN 'A' THEN 1.0 ELSE 0.2 END ELSE 0 END) AS w
FROM x GROUP BY p_partkey) SELECT p_partkey, CAST(round(1000000 * CAST(w AS DOUBLE) / (1.64493406685 * log2(n + 1))) AS BIGINT) AS rank FROM m WHERE a ORDER BY rank DESC, p_partkey LIMIT 50""")
def q_fts_rank(spark, d):
    index = matching.token_index(t(spark, d, "part"), "p_partkey", {"p_name": "A", "p_type": "C"})
    return matching.match_all(index, "p_partkey", "s*").orderBy(F.desc("rank"), "p_partkey").limit(50)


@query("""WITH RECURSIVE n AS (SELECT DISTINCT p_name FROM part), d AS (SELECT p_name, 0 AS i, list_transform(range(0, 12), lambda j: j * 2) AS r FROM n
UNION ALL SELECT p_name, i + 1, list_transform(range(0, 12), lambda j: list_min(list_transform(range(0, j + 1), lambda k: least(r[k + 1] + 1, CASE WHEN k = 0 THEN 10000 ELSE r[k] + CASE WHEN substr(p_name, i + 1, 1) = substr('smal widgte', CAST(k AS INTEGER), 1) THEN 0 ELSE 3 END END) + 2 * (j - k)))) FROM d WHERE i < length(p_name))
SELECT p_partkey, p_name, 'smal widgte' AS asked, CAST(r[12] AS BIGINT) AS cost FROM part JOIN d USING (p_name) WHERE i = length(p_name) ORDER BY cost, p_partkey LIMIT 100""")
def q_weighted_score(spark, d):
    p = t(spark, d, "part").select("p_partkey", "p_name", F.lit("smal widgte").alias("asked"))
    return matching.edit_cost(p, "p_name", "asked", insert=2, update=3, delete=1).orderBy("cost", "p_partkey").limit(100)


@query("""WITH c AS (SELECT DISTINCT p_brand, p_name, levenshtein(p_name, 'smal widget') AS e FROM part), m AS (SELECT *, e = min(e) OVER (PARTITION BY p_brand) AND count(*) OVER (PARTITION BY p_brand, e) = 1 AS closest FROM c)
SELECT p_brand, p_name, CAST(e AS BIGINT) AS edits, CASE WHEN e = 0 THEN 'A' WHEN e <= 3 AND closest THEN 'B' ELSE 'C' END AS grade FROM m""")
def q_category_abc(spark, d):
    c = t(spark, d, "part").select("p_brand", "p_name").distinct().withColumn("edits", big(matching.difference(F.col("p_name"), F.lit("smal widget"))))
    best = F.min("edits").over(Window.partitionBy("p_brand"))
    same = F.count("*").over(Window.partitionBy("p_brand", "edits"))
    return c.withColumn("grade", matching.confidence(F.col("edits"), F.lit(True), F.col("edits"), (F.col("edits") == best) & (same == 1)))


@query("""WITH c AS (SELECT p_partkey, p_name, list_transform(range(0, length(p_name) + 1), lambda k: levenshtein(left(p_name, k), 'small w')) AS c FROM part),
e AS (SELECT *, list_max(list_filter(range(0, length(p_name) + 1), lambda k: k = 0 OR c[k + 1] <> c[greatest(k, 1)] + 1)) AS k FROM c)
SELECT p_partkey, CASE WHEN p_name = 'small w' THEN 0.0 WHEN starts_with(p_name, 'small w') THEN 2.0 ELSE 2 + c[k + 1] * 3.0 + CASE WHEN k < length(p_name) THEN 1 ELSE 0 END END::DOUBLE AS score FROM e""")
def q_autocomplete_score(spark, d):
    return t(spark, d, "part").select("p_partkey", matching.element_score(F.col("p_name"), F.lit("small w"), 3.0).alias("score"))


# Places


def _points(spark, d):
    return t(spark, d, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


_PTS = "p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)"


@query(f"WITH {_PTS} SELECT vec_id, round(sqrt(x * x + y * y), 9) AS distance FROM p ORDER BY sqrt(x * x + y * y), vec_id LIMIT 10")
def q_knn_point(spark, d):
    return spatial.nearest(_points(spark, d), "x", "y", 0.0, 0.0, "vec_id", 10).select("vec_id", F.round("distance", 9).alias("distance"))


@query(f"WITH {_PTS} SELECT vec_id FROM p WHERE sqrt((x - 0.05) * (x - 0.05) + (y + 0.02) * (y + 0.02)) <= 0.1")
def q_within_circle(spark, d):
    return spatial.within_circle(_points(spark, d), "x", "y", 0.05, -0.02, 0.1).select("vec_id")


@query(f"""WITH {_PTS}, j AS (SELECT a.vec_id AS a_id, b.vec_id AS b_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), b.vec_id) AS r
FROM p a, p b WHERE a.vec_id % 20 = 0 AND b.vec_id % 20 <> 0) SELECT a_id, b_id FROM j WHERE r = 1""")
def q_knn_join(spark, d):
    p = _points(spark, d)
    a = p.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("a_id"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = p.filter("vec_id % 20 <> 0").select(F.col("vec_id").alias("b_id"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return spatial.nearest_join(a, b, "a_id", "b_id", 0.02).select("a_id", "b_id")


@query(f"WITH {_PTS} SELECT a.vec_id AS a_id, b.vec_id AS b_id FROM p a, p b WHERE a.vec_id <> b.vec_id AND a.vec_id % 20 = 0 AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.02")
def q_distance_join(spark, d):
    p = _points(spark, d)
    a = p.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("a_id"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = p.select(F.col("vec_id").alias("b_id"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return spatial.distance_join(a, b, 0.02).filter("a_id <> b_id").select("a_id", "b_id")


RING = [(-0.1, -0.1), (0.15, -0.05), (0.1, 0.12), (-0.05, 0.1), (-0.1, -0.1)]


@query(f"WITH {_PTS} SELECT vec_id FROM p WHERE " + " AND ".join(f"({bx} - ({ax})) * (y - ({ay})) - ({by} - ({ay})) * (x - ({ax})) >= 0" for (ax, ay), (bx, by) in zip(RING, RING[1:], strict=False)))
def q_point_in_polygon(spark, d):
    spatial.check_ring(RING, (-1, -1, 1, 1))
    return spatial.within_polygon(_points(spark, d), "x", "y", RING).select("vec_id")


@query(f"""WITH {_PTS}, c AS (SELECT *, CAST(floor(x * 1000 / 100) AS BIGINT) AS cx, CAST(floor(y * 1000 / 100) AS BIGINT) AS cy FROM p) SELECT '100m_' || cy || '_' || cx AS cell, count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM c GROUP BY cell""")
def q_bbox_cells(spark, d):
    p = _points(spark, d).withColumn("cell", geo.grid_code(F.col("x") * 1000, F.col("y") * 1000, 100, "100m"))
    return p.groupBy("cell").agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))


@query(f"WITH {_PTS} SELECT vec_id, CASE WHEN x >= 0 AND y >= 0 THEN 1 WHEN x < 0 AND y >= 0 THEN 2 WHEN x < 0 THEN 3 ELSE 4 END AS area FROM p WHERE abs(x) < 0.5 AND abs(y) < 0.5")
def q_polygon_join(spark, d):
    boxes = [(1, 0.0, 0.0), (2, -0.5, 0.0), (3, -0.5, -0.5), (4, 0.0, -0.5)]
    ring = lambda x, y: [(x, y), (x + 0.5, y), (x + 0.5, y + 0.5), (x, y + 0.5), (x, y)]
    areas = spark.createDataFrame([(k, ring(x, y)) for k, x, y in boxes], "area int, ring array<struct<x:double,y:double>>")
    inside = _points(spark, d).filter((F.abs("x") < 0.5) & (F.abs("y") < 0.5))
    return spatial.polygon_join(inside, areas, 0.1, "x", "y", "area", first_only="vec_id").select("vec_id", "area")


@query(None)
def q_utm_roundtrip(spark, d):
    p = _points(spark, d).select("vec_id", (9 + F.col("x") * 4).alias("lon"), (56 + F.col("y") * 4).alias("lat"))
    e, n = geo.to_utm32(F.col("lon"), F.col("lat"))
    q = p.withColumn("east", e).withColumn("north", n)
    lon, lat = geo.from_utm32(F.col("east"), F.col("north"))
    return q.withColumn("off", F.greatest(F.abs(lon - F.col("lon")), F.abs(lat - F.col("lat"))))


# Streams and checks


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def q_window_tumbling(spark, d):
    return streaming.tumbling(t(spark, d, "events"), "ts", "1 hour", ["event_type"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""SELECT 'orders without lines' AS rule, count(*) AS n FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
UNION ALL SELECT 'lines without orders', count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE l_orderkey = o_orderkey)
UNION ALL SELECT 'parts of two or more suppliers', count(*) FROM (SELECT l_partkey FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) > 1)""")
def q_integrity_checks(spark, d):
    o, li = t(spark, d, "orders").select(F.col("o_orderkey").alias("k")), t(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_partkey", "l_suppkey")
    many = li.select("l_partkey", "l_suppkey").distinct().groupBy("l_partkey").count().filter("count > 1")
    rules = {"orders without lines": relational.missing(o, li, ["k"]), "lines without orders": relational.missing(li, o, ["k"]), "parts of two or more suppliers": many}
    out = None
    for name, bad in rules.items():
        one = bad.agg(F.count("*").alias("n")).select(F.lit(name).alias("rule"), "n")
        out = one if out is None else out.unionByName(one)
    return out


from fieldbook import address_queries, feed_queries, geometry_queries, history_queries, register_queries  # noqa: E402, F401  (they register themselves)
