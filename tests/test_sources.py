"""Archives, collections and replicas in buckets: round trips, and what a failure leaves."""

import gzip
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from fieldbook import sources, streaming
from fieldbook.operators import geometry
from fieldbook.sources import archives, collections

GML = """<?xml version="1.0" encoding="UTF-8"?><w:FeatureCollection xmlns:w="w" xmlns:gml="g" xmlns:d="d">{}</w:FeatureCollection>"""
AREA = """<gml:featureMember><d:Area id="{k}"><d:code> {k} </d:code><d:name>Area {k} &amp; é</d:name><d:share>{k}.5</d:share><d:geom><gml:MultiSurface srsDimension="3">
<gml:Polygon><gml:exterior><gml:LinearRing><gml:posList>0 0 9 4 0 9 4 4 9 0 4 9 0 0 9</gml:posList></gml:LinearRing></gml:exterior>
<gml:interior><gml:LinearRing><gml:posList>1 1 9 1 2 9 2 2 9 2 1 9 1 1 9</gml:posList></gml:LinearRing></gml:interior></gml:Polygon></gml:MultiSurface></d:geom></d:Area></gml:featureMember>"""


def test_a_zip_of_many_members_is_read_by_member(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "areas.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for m in range(20):
            z.writestr(f"part{m:02}.XML", GML.format("".join(AREA.format(k=100 * m + k) for k in range(3))))
        z.writestr("readme.txt", "not read")
    df = archives.archived_xml(spark, str(tmp_path / "areas.zip"), "Area", f"`@id` long, code long, name string, share double, geom {archives.RINGS}, missing string")
    assert df.rdd.getNumPartitions() == 20
    rows = sorted(df.collect(), key=lambda r: r.code)
    assert [r.code for r in rows] == [100 * m + k for m in range(20) for k in range(3)] == [r["@id"] for r in rows]
    assert rows[0].name == "Area 0 & é" and rows[1].share == 1.5 and rows[0].missing is None
    assert [[tuple(p) for p in r] for r in rows[0].geom] == [[(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(1, 1), (1, 2), (2, 2), (2, 1), (1, 1)]]
    areas = geometry.split(df, "code", "geom").groupBy("code").agg(F.sum(geometry.area_of()).alias("a"))
    assert {r.a for r in areas.collect()} == {15.0}


def test_plain_and_gzip_files_and_an_empty_folder(spark, tmp_path):
    (tmp_path / "one").mkdir()
    (tmp_path / "one/a.gml").write_text(GML.format(AREA.format(k=1)))
    with gzip.open(tmp_path / "one/b.xml.gz", "wt") as f:
        f.write(GML.format('<d:Area id="2"><d:code>2</d:code></d:Area><d:Area><d:code/></d:Area>'))
    got = archives.archived_xml(spark, str(tmp_path / "one"), "Area", "code long, name string").collect()
    assert sorted((r.code or 0, r.name or "") for r in got) == [(0, ""), (1, "Area 1 & é"), (2, "")]
    (tmp_path / "none").mkdir()
    assert archives.archived_xml(spark, str(tmp_path / "none"), "Area", "code long").count() == 0


def test_files_are_chosen_and_read_by_their_names(spark, tmp_path):
    for serial, kind in ((3, "NA"), (4, "DA")):
        with zipfile.ZipFile(tmp_path / f"ois_bbr_CO10T_{kind}000_{serial:05}_20200101_101010.zip", "w") as z:
            z.writestr("x.XML", f"<rows><row><id>{serial}</id><v>x</v></row></rows>")
    with gzip.open(tmp_path / "ois_bbr_co10t_da000_00005_20200102_101010.gz", "wt") as f:
        f.write('{"id": 5, "v": "j"}\n{"id": 6, "v": null}\n')
    names = spark.createDataFrame([(n,) for n in os.listdir(tmp_path)] + [("ois_other_co10t_da000_00009_1_1.gz",), ("junk.zip",)], "name string")
    files = archives.described(names, "bbr")
    assert sorted((r.serial, r.total, r.format, r.entity) for r in files.collect()) == [(3, True, "xml", "co10t"), (4, False, "xml", "co10t"), (5, False, "ndjson", "co10t")]
    assert [r.serial for r in archives.to_import(files, 3).collect()] == [4, 5] and archives.to_import(files, 5).count() == 0
    got = archives.register_rows(spark, str(tmp_path), archives.to_import(files, 0), "row", "id long, v string")
    assert sorted((r.id, r.v, r.serial) for r in got.collect()) == [(3, "x", 3), (4, "x", 4), (5, "j", 5), (6, None, 5)]
    with pytest.raises(ValueError, match="missing"):
        archives.to_import(files.where("serial <> 4"), 0)
    with pytest.raises(ValueError, match="same"):
        archives.to_import(files.unionByName(files), 0)


def test_a_collection_reads_back_and_holds_its_box(spark, tmp_path):
    df = spark.range(50).select("id", F.concat(F.lit("é\""), "id").alias("name"), F.when(F.col("id") != 7, F.array(F.array(F.col("id") * 1.0, F.lit(2.0), F.lit(9.0)), F.array(F.col("id") * 1.0, F.lit(2.0), F.lit(8.0)), F.array(F.lit(-1.0), F.col("id") * 2.0, F.lit(9.0)))).alias("c")).repartition(3)
    path = str(tmp_path / "out")
    collections.write_collection(collections.features(df, "LineString", "c", ["id", "name"]), path, most=10)
    files = [f for f in os.listdir(path) if not f.startswith(("_", "."))]
    assert len(files) >= 5 and not os.path.exists(f"{path}/_writing")
    whole = json.load(open(f"{path}/_collection.json"))
    assert whole == {"crs": "EPSG:25832", "bbox": [-1.0, 0.0, 49.0, 98.0], "features": 50}
    one = json.load(open(f"{path}/{files[0]}"))
    assert one["type"] == "FeatureCollection" and one["crs"]["properties"]["name"] == "EPSG:25832" and len(one["bbox"]) == 4
    got = {r.id: (r.name, r.coordinates) for r in sources.geojson(spark, path, "id long, name string", "array<array<double>>").collect()}
    assert len(got) == 50 and got[3] == ('é"3', [[3.0, 2.0], [-1.0, 6.0]]) and got[7][1] is None
    high = json.loads(collections.features(df.where("id = 3"), "LineString", "c", ["id"], heights=True).first().feature)
    assert len(high["geometry"]["coordinates"]) == 3 and high["geometry"]["coordinates"][0] == [3.0, 2.0, 9.0]


def test_a_failed_write_leaves_no_file(spark, tmp_path):
    path = str(tmp_path / "bad")
    made = collections.features(spark.range(100).repartition(4).select("id", F.array(F.col("id") * 1.0, F.lit(0.0)).alias("c")), "Point", "c", ["id"])
    wrong = made.withColumn("feature", F.when(F.col("bbox")[0] == 77, F.raise_error(F.lit("broken"))).otherwise(F.col("feature")))
    with pytest.raises(Exception, match="broken"):
        collections.write_collection(wrong, path)
    assert not os.path.exists(path) or os.listdir(path) == []


def test_box_of_every_depth(spark):
    df = spark.createDataFrame([([[[[1.0, 2.0], [3.0, -4.0]]], [[[5.0, 0.0]]]],)], "c array<array<array<array<double>>>>")
    assert df.select(collections.box(F.col("c"), 3)).first()[0] == [1.0, -4.0, 5.0, 2.0]
    assert df.select(collections.box(F.col("c")[0][0][0], 0)).first()[0] == [1.0, 2.0, 1.0, 2.0]


def test_a_batch_rewrites_only_the_buckets_of_its_keys(spark, tmp_path):
    path, log = str(tmp_path / "replica"), str(tmp_path / "log")
    table = spark.range(1000).select("id", F.col("id").cast("string").alias("v"))
    streaming.begin_replica(table, path, ["id"], 64)
    before = {f"{d}/{f}" for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}
    batch = spark.createDataFrame([(k, "update", k, f"new{k}") for k in range(5)] + [(9, "insert", 2000 + k, "in") for k in range(3)] + [(10, "delete", 2001, None), (11, "delete", 999, None), (12, "delete", 555555, None)], "txid long, operation string, id long, v string")
    assert streaming.apply_to_buckets(batch, path, ["id"], ["txid"], 64) <= 10
    after = {f"{d}/{f}" for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}
    assert len({os.path.dirname(f) for f in before - after}) <= 10
    want = {k: f"new{k}" if k < 5 else str(k) for k in range(999)} | {2000: "in", 2002: "in"}
    assert {r.id: r.v for r in streaming.replica_rows(spark, path).collect()} == want
    streaming.apply_to_buckets(batch, path, ["id"], ["txid"], 64)  # again: nothing changes
    assert {r.id: r.v for r in streaming.replica_rows(spark, path).collect()} == want
    gone = spark.createDataFrame([(20, "delete", k, None) for k in want], "txid long, operation string, id long, v string")
    streaming.apply_to_buckets(gone, path, ["id"], ["txid"], 64)
    assert streaming.replica_rows(spark, path).count() == 0
    feed = str(tmp_path / "feed")
    schema = "txid long, operation string, id long, v string"
    for n, rows in enumerate(([(21, "insert", 1, "a"), (22, "insert", 2, "b")], [(22, "insert", 2, "b"), (23, "update", 1, "c")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(feed)
        streaming.replicate_buckets(streaming.feed(spark, feed, schema), path, log, ["id"], "txid", 64, str(tmp_path / "marks")).awaitTermination()
        assert spark.read.json(log).agg(F.max("txid")).first()[0] == 22 + n
    assert {r.id: r.v for r in streaming.replica_rows(spark, path).collect()} == {1: "c", 2: "b"}


def test_rows_as_arrays_pretty_and_as_calls(spark, tmp_path):
    df = spark.range(7).select("id", F.when(F.col("id") > 2, F.lit("é")).alias("v")).coalesce(1)
    read = lambda path: [open(f"{path}/{f}").read() for f in sorted(os.listdir(path)) if not f.startswith(("_", "."))]
    collections.write_json(df, str(tmp_path / "a"), most=3)
    assert sorted(x["id"] for text in read(tmp_path / "a") for x in json.loads(text)) == list(range(7)) and len(read(tmp_path / "a")) == 3
    assert json.loads(read(tmp_path / "a")[0])[0].keys() == {"id", "v"} and not os.path.exists(tmp_path / "a/_collection.json")
    collections.write_json(df, str(tmp_path / "b"), pretty=True)
    assert read(tmp_path / "b")[0].count("\n") > 14 and len(json.loads(read(tmp_path / "b")[0])) == 7
    collections.write_json(df, str(tmp_path / "c"), callback="show.it")
    text = read(tmp_path / "c")[0]
    assert text.startswith("show.it([") and text.endswith("]);\n") and len(json.loads(text[8:-3])) == 7
    with pytest.raises(ValueError, match="name"):
        collections.write_json(df, str(tmp_path / "d"), callback="alert(1);x")
