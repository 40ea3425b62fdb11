"""Operators that SQL cannot express, and edge cases of those it can."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fieldbook import queries as registry
from fieldbook import feed_queries, sources, streaming
from fieldbook.functions import ranges
from fieldbook.functions import text as tx
from fieldbook.operators import addresses, changes, feeds, intervals, matching, relational, shapes, spatial, spelling, temporal
from fieldbook.plans import Parameter, Resource, choose_table, represent
from fieldbook.sources import sinks

SF = "/root/testdata/sf0.001"


def got_all(df):
    return [tuple(r) for r in intervals.resolve(df, ["g"], ["k"], "lo", "hi", "ref", extend=True).collect()]


def test_layered_follows_the_last_listed(spark):
    rows = [(1, k, *x) for k, x in enumerate([(0, 10, "a"), (3, 5, "b"), (5, 6, "b"), (7, 7, "c")])] + [(2, 0, 1, 2, "a"), (2, 1, 4, 5, "b")]
    df = spark.createDataFrame(rows, "g int, k int, lo int, hi int, ref string")
    got = lambda **kw: sorted(tuple(r) for r in intervals.resolve(df, ["g"], ["k"], "lo", "hi", "ref", **kw).collect())
    assert got() == [(1, 0, 3, "a"), (1, 3, 6, "b"), (1, 6, 10, "a"), (2, 1, 2, "a"), (2, 4, 5, "b")]
    assert {x for x in got_all(df) if x[0] == 2} == {(2, None, 2, "a"), (2, 2, None, "b")}
    pair = spark.createDataFrame([(0, 3, 3, 5), (0, 3, 4, 5)], "a int, b int, c int, d int")
    cols = ("a", "b", "c", "d")
    test = lambda f, *ends: [r[0] for r in pair.select(f(*map(intervals.F.col, cols), *ends)).collect()]
    assert test(intervals.meets) == [False, False] and test(intervals.meets, (True, True), (True, True)) == [True, False]
    assert test(intervals.adjacent) == [True, False] and test(intervals.adjacent, (True, True), (True, True)) == [False, False]


def test_interval_priority_query_is_disjoint(spark):
    rows = registry.q_interval_priority(spark, SF).collect()
    by = {}
    for r in rows:
        by.setdefault(r.l_orderkey, []).append((r.lo, r.hi))
    assert all(a[1] <= b[0] for v in by.values() for a, b in zip(sorted(v), sorted(v)[1:], strict=False))


def test_utm_is_exact_to_the_millimetre(spark):
    assert registry.q_utm_roundtrip(spark, SF).agg(F.max("off")).first()[0] < 2e-8
    known = spark.createDataFrame([(9.0, 0.0), (12.0, 56.0)], "lon double, lat double")
    from fieldbook.functions import geo

    e, n = geo.to_utm32(F.col("lon"), F.col("lat"))
    a, b = known.select(e.alias("e"), n.alias("n")).collect()
    assert (a.e, a.n) == (500000.0, 0.0)
    assert abs(b.e - 687071.4) < 1 and abs(b.n - 6210141.3) < 1


def test_weighted_score_ranks_the_near_name_first(spark):
    rows = registry.q_weighted_score(spark, SF).collect()
    assert [r.cost for r in rows] == sorted(r.cost for r in rows)


def test_parameters_and_pages(spark):
    r = Resource(["k"], {"a": Parameter("a", int)})
    df = spark.createDataFrame([(1, 1), (2, None), (3, 2)], "k int, a int")
    assert [x.k for x in r.query(df, {"a": "1|", "side": "1"}).collect()] == [1, 2]
    with pytest.raises(ValueError):
        r.query(df, {"b": "1"}, validate=True)
    with pytest.raises(ValueError):
        r.query(df, {"side": "2000", "per_side": "20"})


def test_infinite_bounds(spark):
    df = spark.createDataFrame([(1, None, 5), (1, 3, None)], "k int, lo int, hi int")
    lo, hi = ranges.merged("lo", "hi")
    assert df.groupBy("k").agg(lo.alias("lo"), hi.alias("hi")).first()[1:] == (None, None)
    a, b = df.filter("lo is null"), df.filter("lo is not null")
    assert temporal.overlap_join(a, b, ["k"], "lo", "hi").collect()[0][1:] == (3, 5)


def test_islands_break_at_gaps_and_overlaps(spark):
    rows = [(1, "x", None, 2), (1, "x", 2, 4), (1, "x", 5, 6), (1, "x", 5, 9), (1, "y", 9, None)]
    got = ranges.coalesce_valid_time(spark.createDataFrame(rows, "k int, v string, lo int, hi int"), ["k"], ["v"], "lo", "hi")
    assert sorted((r.lo or 0, r.hi or 99) for r in got.collect()) == [(0, 4), (5, 6), (5, 9), (9, 99)]


def _islands(rows):
    out, before = [], {}
    for k, a, lo, hi in sorted(rows, key=lambda r: (r[0], r[2] is not None, r[2] or 0)):
        if k in before and lo is not None and before[k] == (a, lo):
            out[-1].append((k, a, lo, hi))
        else:
            out.append([(k, a, lo, hi)])
        before[k] = (a, hi)
    return sorted(((x[0][0], x[0][1], x[0][2], None if any(r[3] is None for r in x) else max(r[3] for r in x)) for x in out), key=repr)


def test_islands_like_a_walk_and_without_gathered_groups(spark):
    rng = random.Random(5)
    rows = []
    for k in range(60):
        at = sorted(rng.sample(range(1, 40), rng.randint(1, 12)))
        for i, lo in enumerate(at):
            hi = at[i + 1] if i + 1 < len(at) and rng.random() < 0.8 else rng.choice([None, lo - 1, lo, lo + 1, lo + 5])
            rows.append((k if k else None, rng.choice(["x", "x", "y", None]), None if i == 0 and k % 4 == 0 else lo, hi))
    rng.shuffle(rows)
    got = ranges.coalesce_valid_time(spark.createDataFrame(rows, "k int, a string, lo int, hi int").repartition(3), ["k"], ["a"], "lo", "hi")
    want = _islands([(-1 if k is None else k, a, lo, hi) for k, a, lo, hi in rows])
    assert sorted(((-1 if r.k is None else r.k, r.a, r.lo, r.hi) for r in got.collect()), key=repr) == want
    assert "Aggregate" not in got._jdf.queryExecution().executedPlan().toString()


def test_histories_sort_a_bounded_number_of_rows_a_task(spark, monkeypatch):
    monkeypatch.setattr(feed_queries, "ORDERS", 100)
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()
    got = feed_queries.q_combined_history(spark, "/root/testdata/sf0.001")
    assert got.rdd.getNumPartitions() >= orders // 100


def test_history_is_filled_at_both_ends(spark):
    df = spark.createDataFrame([(1, 3, 5, 2)], "k int, lo int, hi int, status int")
    assert sorted((r.lo, r.hi, r.status) for r in ranges.fill_tail(df, ["k"], "lo", "hi", "status", 10).collect()) == sorted([(3, 5, 2), (5, None, 10)])
    assert sorted((r.lo, r.hi) for r in ranges.fill_head(df, ["k"], "lo", "hi", F.lit(0)).collect()) == [(0, 3), (3, 5)]


def test_replica_converges_and_repeats_harmlessly(spark, tmp_path):
    schema = "txid int, operation string, k int, v string"
    feed = tmp_path / "feed"
    spark.createDataFrame([(1, "update", 1, "a"), (2, "insert", 1, "b"), (3, "delete", 2, None), (4, "insert", 3, "c")], schema).write.parquet(str(feed))
    state = {"df": spark.createDataFrame([(3, "old")], "k int, v string")}

    def save(df):
        state["df"] = spark.createDataFrame(df.collect(), "k int, v string")

    for n in (1, 2):
        streaming.replicate(streaming.feed(spark, str(feed), schema), lambda: state["df"], save, ["k"], ["txid"], str(tmp_path / f"c{n}")).awaitTermination()
        assert sorted(map(tuple, state["df"].collect())) == [(1, "b"), (3, "c")]


def test_diff_treats_nulls_as_values(spark):
    old = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "k int, v string")
    new = spark.createDataFrame([(1, "a"), (2, None), (3, "y")], "k int, v string")
    got = changes.diff(new, old, ["k"])
    assert sorted((r.operation, r.k, r.v or "") for r in got.collect()) == [("update", 1, "a"), ("update", 2, "")]
    assert sorted((r.k, r.v or "") for r in changes.apply(old, got, ["k"]).collect()) == [(1, "a"), (2, ""), (3, "y")]
    assert changes.diff(old.limit(0), old, ["k"], deletes=False).count() == 0


def test_house_numbers_and_floors(spark):
    df = spark.createDataFrame([("12B",), ("2",), ("12",), ("x",), (None,)], "n string")
    h = tx.house_number(F.col("n"))
    got = [r.f for r in df.select(tx.format_house_number(h).alias("f"), h.alias("h")).orderBy(F.col("h").asc_nulls_last()).collect()]
    assert got[:3] == ["2", "12", "12B"]
    floors = spark.createDataFrame([(x,) for x in ("2", "st", "kl", "kl9", None, "10", "loft")], "f string")
    assert [r.f for r in floors.orderBy(tx.sort_rank_floor(F.col("f"))).collect()] == [None, "kl9", "kl", "st", "2", "10", "loft"]


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a;"b"', None), (2, "", 2.0)], "k int, s string, v double")
    sinks.write_ndjson(df, str(tmp_path / "j"))
    assert sorted(map(tuple, sources.ndjson(spark, str(tmp_path / "j"), "k int, s string, v double").collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)
    (tmp_path / "c.csv").write_text('k;s\n1;"a;b"\n2;"c\\"d"\n')
    assert [tuple(r) for r in sources.csv(spark, str(tmp_path / "c.csv"), "k int, s string").collect()] == [(1, "a;b"), (2, 'c"d')]
    (tmp_path / "f.txt").write_text("001Aa  7\n016xx\n")
    assert [tuple(r) for r in sources.fixed_width(spark, str(tmp_path / "f.txt"), [("n", 4, 4), ("z", 8, 1), ("q", 9, 3)], "001").collect()] == [("Aa", "7", None)]
    (tmp_path / "g.json").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"id":1},"geometry":{"type":"Point","coordinates":[1.5,2]}}]}')
    assert sources.geojson(spark, str(tmp_path / "g.json"), "id:int").collect()[0].coordinates == [1.5, 2.0]


def test_discovery_of_new_files(spark):
    names = [(f"X_{k}000_{n:05d}_2019",) for k, n in (("TE", 1), ("DA", 2), ("TE", 3), ("DA", 4), ("DA", 5))]
    got = sources.new_files(spark.createDataFrame(names, "name string"), imported=4)
    assert [r.serial for r in got.collect()] == [5]
    with pytest.raises(ValueError):
        sources.new_files(spark.createDataFrame([*names, names[0]], "name string"), 0)


def test_admission_merge_and_heights(spark):
    df = spark.createDataFrame([(1, 5, None, "a"), (1, None, 9, "b")], "k int, c int, u int, v string")
    assert tuple(sources.merge_events(df, "k", "c", "u").first()) == (1, 5, 9, "b")
    bad = spark.createDataFrame([(1, 1, 2), (1, 0, 3), (2, 5, 5)], "k int, lo int, hi int")
    assert [tuple(r) for r in sources.admit(bad, "k", ["lo"], [("lo", "hi")]).collect()] == [(1, 0, 3)]
    z = spark.createDataFrame([(1.25,), (-1.25,), (-9999.0,)], "z double")
    assert [r.h for r in z.select(sources.height(F.col("z")).alias("h")).collect()] == [1.3, -1.2, None]


def test_numbering_and_fallback(spark):
    df = spark.range(100).withColumn("id", 99 - F.col("id"))
    assert [r.seq - r.id for r in relational.numbered(df, ["id"], start=7).collect()] == [8] * 100
    a, b = df.filter("id < 0"), df.filter("id = 3")
    assert relational.fallback(a, b).count() == 1 and relational.fallback(df, b).count() == 100


def test_nearest_join_reaches_far_points(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0), (2, 100.0, 100.0)], "a_id int, ax double, ay double")
    b = spark.createDataFrame([(7, 1.0, 1.0), (8, -50.0, 0.0)], "b_id int, bx double, by double")
    assert sorted((r.a_id, r.b_id) for r in spatial.nearest_join(a, b, "a_id", "b_id", 0.5).collect()) == [(1, 7), (2, 7)]
    assert spatial.nearest_join(a, b.limit(0), "a_id", "b_id", 0.5).count() == 0


def test_utc_and_future(spark):
    df = spark.createDataFrame([("200001011200",), ("000000000000",)], "s string")
    got = [r.t for r in df.select(sources.local_to_utc(F.col("s"), "yyyyMMddHHmm").alias("t")).collect()]
    assert got == [dt.datetime(2000, 1, 1, 11, 0), None]


def test_execution_follows_needs_and_strategy():
    needs = {"a": [], "b": ["a"], "c": ["b"], "d": ["a", "c"], "e": []}
    assert feeds.execution_order(needs, ["b"]) == ["b", "c", "d"] and set(feeds.execution_order(needs, ["a", "e"])) == set(needs)
    ran = []
    step = lambda c, n: lambda: ran.append(c) or n
    steps = {"a": step("a", 3), "b": step("b", 0), "c": step("c", 5), "d": step("d", 1)}
    order = ["a", "b", "c", "d"]
    assert feeds.execute(order, needs, steps) == {"a": 3, "b": 0, "c": 0, "d": 1} and ran == ["a", "b", "d"]
    assert feeds.execute(order, needs, steps, "slow")["c"] == 5
    with pytest.raises(ValueError, match="not up to date"):
        feeds.execute(order, needs, steps, "verify")
    assert [feeds.client_mode(*x) for x in ((0, False, 4, 9), (5, True, 4, 9), (5, False, 4, 9), (5, False, 9, 9))] == ["download", "download", "increment", "none"]
    with pytest.raises(ValueError, match="later"):
        feeds.client_mode(5, False, 10, 9)


def test_sequences_and_empty_transactions(spark):
    history = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "seq long, txid long")
    with pytest.raises(ValueError, match="latest"):
        feeds.checked_sequence(history, 4)
    done = spark.createDataFrame([(6, 10)], "txid long, seq_to long")
    found = spark.createDataFrame([(1, "insert", True), (2, "update", False), (3, "delete", True)], "id long, operation string, public boolean")
    rows, row = feeds.transaction(done, found, ["id"])
    assert sorted((r.id, r.seq, r.txid) for r in rows.collect()) == [(1, 11, 7), (2, None, 7), (3, 12, 7)]
    assert tuple(row.first()) == (7, 11, 12, 1, 1, 1)
    assert feeds.transaction(done, found.limit(0), ["id"])[1] is None
    assert feeds.transaction(done, found.limit(0), ["id"], keep_empty=True)[1].first().txid == 7


def test_changes_of_several_tables_in_their_order(spark):
    rows = [("b", "insert"), ("a", "delete"), ("a", "update"), ("b", "delete")]
    df = spark.createDataFrame(rows, "table string, operation string")
    got = [tuple(r) for r in feeds.in_table_order(df, ["a", "b"]).orderBy("table_order").collect()]
    assert got == [("b", "delete", -2), ("a", "delete", -1), ("a", "update", 1), ("b", "insert", 2)]
    with pytest.raises(Exception, match="no such table"):
        feeds.in_table_order(df, ["a"]).collect()


def test_address_helpers(spark):
    assert addresses.asked_number("road 12 city") == ("road city", 12) and addresses.asked_number("road 12, 4000 city")[1] is None
    assert addresses.caret_wildcard("mar road", 3) == "mar* road" and addresses.caret_wildcard("mar", None) == "mar*" and addresses.caret_wildcard("mar ", 4) == "mar "
    scores = [("margrethepladsen", "margrethepladsen", 2), ("margrethepladsen", "", 2), ("margrethepladsen", "margret", 2), ("margrethepladsen", "margretepladsen", 11), ("margrethepladsen", "margretheplassen", 11), ("margrethepladsen", "margretheepladsen", 11), ("margrethepladsen", "margretepla", 11), ("margrethepladsen", "margretteplassen", 11)]
    df = spark.createDataFrame(scores, "a string, q string, w int")
    assert [r[0] for r in df.select(matching.element_score(F.col("a"), F.col("q"), F.col("w"))).collect()] == [0, 1, 2, 13, 13, 13, 14, 24]
    ring = spark.createDataFrame([([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)], [(1.0, 0.0), (1.0, 1.0), (0.0, 0.0001), (1.0, 0.0)], [(0.0, 0.0), (1.0, 0.0), (1.0, 2.0), (0.0, 0.0)])], ", ".join(f"{c} array<struct<x:double,y:double>>" for c in "abc"))
    assert tuple(ring.select(spatial.geometry_differs("a", "b"), spatial.geometry_differs("a", "c")).first()) == (False, True)


def test_spellings_are_merged_over_shared_forms(spark):
    names = spark.createDataFrame([("Sten Allé",), ("Steen",), ("Schmidt-vej",), ("Smidt",), ("Dal",), (None,), ("Dal",)], "name string")
    got = {r.word: r.synonyms for r in spelling.synonym_groups(names, "name").collect()}
    assert got == {"dal": ["dahl", "dal"], "schmidt": ["schmidt", "smidt"], "steen": ["steen", "sten"]}
    words = spark.createDataFrame([("daldal",), ("x",)], "w string").select("w", spelling.forms(F.col("w"), [("dal", "dahl", True)]).alias("f"))
    assert [sorted(r.f) for r in words.collect()] == [["dahldahl", "dahldal", "daldahl", "daldal"], ["x"]]
    assert spelling.synonym_groups(names.limit(0), "name").count() == 0


def test_visual_centre_is_as_far_inside_as_brute_force(spark):
    import numpy as np

    shell = [[0.0, 0.0], [40.0, 0.0], [40.0, 10.0], [14.0, 12.0], [10.0, 50.0], [0.0, 40.0], [0.0, 0.0]]
    hole = [[4.0, 4.0], [4.0, 9.0], [9.0, 9.0], [9.0, 4.0], [4.0, 4.0]]
    small = [[100.0, 100.0], [102.0, 100.0], [102.0, 102.0], [100.0, 100.0]]
    df = spark.createDataFrame([([[small], [shell, hole]],), ([],), (None,)], "g array<array<array<array<double>>>>")
    got = [r.c for r in df.select(shapes.visual_centre(F.col("g"), 0.1).alias("c")).collect()]
    edges = np.concatenate([np.hstack([np.array(r)[:-1], np.array(r)[1:]]) for r in (shell, hole)])
    grid = np.stack(np.meshgrid(np.arange(0, 40, 0.1), np.arange(0, 50, 0.1)), -1).reshape(-1, 2)
    best = max(shapes._clearance(part, edges).max() for part in np.array_split(grid, 50))
    assert shapes._clearance(np.array([[got[0].x, got[0].y]]), edges)[0] > best - 0.1
    assert [(c.x, c.y) for c in got[1:]] == [(None, None)] * 2
    line = spark.createDataFrame([([(0.0, 0.0), (0.0, 2.0), (2.0, 2.0)],), ([(1.0, 1.0)],), ([],), (None,)], "l array<struct<x:double,y:double>>")
    found = [r.c for r in line.select(shapes.nearest_to_centroid(F.col("l")).alias("c")).collect()]
    assert (found[0].x, found[0].y) in ((0.0, 1.5), (0.5, 2.0)) and (found[1].x, found[1].y) == (1.0, 1.0) and found[2:] == [None, None]


def test_shape_text_of_every_depth(spark):
    df = spark.createDataFrame([([1.5, 2.0], [[[0.0, 0.0], [1.0, 0.0], [0.0, 0.0]]])], "p array<double>, g array<array<array<double>>>")
    row = df.select(shapes.ewkt("Point", F.col("p")).alias("p"), shapes.ewkt("Polygon", F.col("g"), multi=True).alias("g"), shapes.ewkt("Point", F.lit(None).cast("array<double>")).alias("n")).first()
    assert row.p == "SRID=25832; Point1.5 2.0" and row.g == "SRID=25832; MultiPolygon(((0.0 0.0, 1.0 0.0, 0.0 0.0)))" and row.n is None


def test_representations_and_table_choice(spark):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    offered = {("json", "nested"): ["k", F.struct("v").alias("p")], ("csv", "flat"): ["k", "v"]}
    assert represent(df, offered, {}).columns == ["k", "p"] and represent(df, offered, {"format": "csv"}).columns == ["k", "v"]
    with pytest.raises(ValueError, match="no nested"):
        represent(df, offered, {"format": "csv", "structure": "nested"})
    assert choose_table({"a": df, "b": df.limit(0)}, {"t": "b"}, "t", "a").count() == 0 and choose_table({"a": df}, {}, "t", "a") is df
    with pytest.raises(ValueError, match="none of a"):
        choose_table({"a": df}, {"t": "x"}, "t", "a")
