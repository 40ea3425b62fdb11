"""Register loads and checks on small cases that name every rule."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fieldbook.functions import text as tx
from fieldbook.operators import matching, registers, relational


def line(kind, begin, end, name, road="0007"):
    if kind == "001":
        return f"001{'0101'}{road}" + " " * 28 + begin + f"{'ad':20}{name:40}"
    return f"016{'0101'}{road}" + " " * 12 + begin + end + f"{'ad':20}{name:40}"


def test_road_records_become_versions(spark):
    rows = [line("016", "199006150000", "199506159999", "Old"), line("001", "199506150099", "", "New"), line("016", "190001010000", "190001010000", "none"), line("016", "000000000000", "189001010000", "Always", "0008"), "999 other"]
    got = sorted((r.road, r.name, r.lo, r.hi) for r in registers.road_history(spark.createDataFrame([(x,) for x in rows], "value string")).collect())
    summer = lambda y: dt.datetime(y, 6, 14, 22)
    assert got == [(7, "New", summer(1995), None), (7, "Old", summer(1990), summer(1995)), (8, "Always", None, None)]
    with pytest.raises(Exception, match=r"(?i)pars|invalid|cannot"):
        registers.road_history(spark.createDataFrame([(line("001", "19x006150000", "", "Bad"),)], "value string")).collect()


def test_dump_keeps_what_came_after_it(spark):
    table = spark.createDataFrame([(1, "a", None, 5, None), (2, "b", "x", 6, 20), (3, "c", None, 21, None), (4, "d", None, 7, None)], "id int, v string, until string, e0 int, e1 int")
    dump = spark.createDataFrame([(1, "a", None, None, None), (2, "B", None, 6, None), (5, "e", None, 9, None)], "id int, v string, until string, e0 int, e1 int")
    got = sorted((r.operation, r.id, r.v, r.until) for r in registers.dump_changes(dump, table, "id", ("e0", "e1"), ["until"], 10).collect())
    assert got == [("delete", 4, "d", None), ("insert", 5, "e", None), ("update", 2, "B", "x")]


def test_lines_are_admitted_or_rejected_with_a_reason(spark):
    lines = ['{"rowkey": 1, "a": "x", "lo": 1, "hi": 2}', '{"rowkey": 1, "a": "y", "lo": 1, "hi": 2}', '{"rowkey": 2, "a": "x", "lo": 3, "hi": 3}', '{"rowkey": 3, "lo": 1}', "no json", '{"rowkey": "text", "a": "x"}', '{"a": "x"}', '{"rowkey": 9999999999, "a": "x"}', '{"rowkey": 4, "a": "x", "hi": 1}']
    rows, rejects = registers.admitted(spark.createDataFrame([(x,) for x in lines], "value string"), "rowkey long, a string, lo int, hi int", ["rowkey", "a"], "rowkey", ["a"], [("lo", "hi")])
    assert sorted(tuple(r) for r in rows.collect()) == [(1, "x", 1, 2), (4, "x", None, 1)]
    assert {r.value: r.reason for r in rejects.collect()} == {lines[1]: "duplicate", lines[2]: "range lo", lines[3]: "missing a", lines[4]: "schema", lines[5]: "schema", lines[6]: "missing rowkey", lines[7]: "rowkey too large"}


def test_rowkeys_stay_and_new_ones_follow(spark):
    day = lambda n: dt.datetime(2020, 1, n)
    schema = "k int, a string, lo timestamp, hi timestamp, reg_to timestamp"
    bitemporal = spark.createDataFrame([(1, "x", day(1), day(3), None), (1, "x", day(3), day(5), None), (1, "y", day(5), None, None), (1, "z", day(1), None, day(9)), (2, "x", day(1), None, None)], schema)
    known = spark.createDataFrame([(70, 1, "x", day(1), None), (71, 1, "gone", day(4), day(6)), (72, 2, "other", day(1), None)], "rowkey long, k int, a string, lo timestamp, hi timestamp")
    changed = spark.createDataFrame([(1,)], "k int")
    got = sorted((r.operation, r.rowkey, r.a) for r in registers.history_changes(bitemporal, changed, known, ["k"], ["a"], "lo", "hi", "reg_to", "rowkey").collect())
    assert got == [("delete", 71, "gone"), ("insert", 73, "y"), ("update", 70, "x")]


def test_switches_of_validity_work_apart(spark):
    df = spark.createDataFrame([(1, 2, "a"), (2, 9, "a"), (3, 2, ""), (4, 2, None), (5, 9, None)], "id int, status int, name string")
    ids = lambda **kw: {r.id for r in relational.valid_only(df, "status", [2, 3], ["name"], **kw).collect()}
    assert (ids(), ids(with_closed=True), ids(with_incomplete=True), ids(with_closed=True, with_incomplete=True)) == ({1}, {1, 2}, {1, 3, 4}, {1, 2, 3, 4, 5})


def test_distance_to_a_part(spark):
    edges = F.array(*[F.lit(float(v)) for v in (0, 0, 4, 0, 4, 0, 4, 4, 4, 4, 0, 4, 0, 4, 0, 0)])
    df = spark.createDataFrame([(1.0, 1.0), (4.0, 2.0), (7.0, 8.0), (2.0, -3.0)], "x double, y double")
    assert [r[0] for r in df.select(registers.distance_to(F.col("x"), F.col("y"), edges)).collect()] == [0.0, 0.0, 5.0, 3.0]


def test_names_with_weighted_edits(spark):
    df = spark.createDataFrame([(1, "Nørregade"), (2, "Nørregade"), (3, "Norregade"), (4, None), (5, "Søndergade")], "id int, name string")
    got = {(r.id, r.edits) for r in matching.near_names(df, "name", "Nørregad", 3, 2).collect()}
    assert got == {(1, 1), (2, 1), (3, 4)}  # a letter too many costs 1, a changed one 3


def test_text_rules_in_any_time_zone(spark):
    texts = ["Vej 5, KLD tv", "Stuenvej 3, stueplan. th", "Salvej 12, 1. sal tv", "Vej 1, 2. Sal, sal.", "Vej 1"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    assert [r[0] for r in df.select(tx.spoken(F.col("s"))).collect()] == ["Vej 5, kl tv", "Stuenvej 3, st. th", "Salvej 12, 1.  tv", "Vej 1, 2. , sal.", "Vej 1"]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "Europe/Copenhagen", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", name)
            at = spark.range(1).select(tx.iso_utc(F.timestamp_seconds(F.lit(1577880000)))).first()[0]
            assert at == "2020-01-01T12:00:00.000Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert [r[0] for r in spark.createDataFrame([(7,), (12345,)], "n int").select(tx.postal_blank(F.col("n"))).collect()] == [" 0007", " 12345"]
    rows = spark.createDataFrame([("Christian 4. gade 13B, 5. th, By, 8000 Aarhus C",), ("Road 12,st. th,1553 City",), ("10. Februar Vej 3, 1000 Town",), ("Road 4, kl., 1000 Town",), ("nothing",)], "s string")
    got = [r[0] for r in rows.select(tx.address_parts(F.col("s"))).collect()]
    assert tuple(got[0]) == ("Christian 4. gade", "13B", "5", "th", "By", "8000", "Aarhus C")
    assert (got[1].number, got[1].floor, got[1].door, got[1].postal) == ("12", "st", "th", "1553") and got[2].street == "10. Februar Vej" and got[3].floor == "kl" and got[4] is None


def test_admitted_lines_are_read_once_for_each_table(spark):
    from pyspark.sql import functions as F

    from fieldbook.operators import registers

    lines = spark.range(40).select(F.concat(F.lit('{"rowkey": '), F.when(F.col("id") % 4 == 0, F.lit('"x"')).otherwise((F.col("id") % 15).cast("string")), F.lit(', "n": '), F.col("id").cast("string"), F.lit("}")).alias("value"))
    rows, rejects = registers.admitted(lines, "rowkey long, n int", ["rowkey"], "rowkey", ["n"], [])
    assert [df._jdf.queryExecution().optimizedPlan().toString().count("Range (") for df in (rows, rejects)] == [1, 1]
    first = {k: min(i for i in range(40) if i % 4 and i % 15 == k) for k in {i % 15 for i in range(40) if i % 4}}
    assert {r.rowkey: r.n for r in rows.collect()} == first
    assert {r.reason: r["count"] for r in rejects.groupBy("reason").count().collect()} == {"schema": 10, "duplicate": 30 - len(first)}
