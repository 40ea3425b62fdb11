"""Registry queries about shapes, on places read off the first two numbers of each vector, in thousandths."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldbook.functions import geo
from fieldbook.operators import geometry, spatial
from fieldbook.queries import query, t

_AT = "a AS (SELECT vec_id AS k, floor(CAST(embedding[1] AS DOUBLE) * 1000) AS x, floor(CAST(embedding[2] AS DOUBLE) * 1000) AS y FROM embeddings)"
#: Both rectangles of each L-shaped area.
_ELL = f"{_AT}, r AS (SELECT k, x AS x0, x + 20 AS x1, y AS y0, y + 10 AS y1 FROM a UNION ALL SELECT k, x, x + 8, y + 10, y + 24 FROM a)"


def _at(spark, d):
    place = lambda k: F.floor(F.col("embedding")[k].cast("double") * 1000).cast("double")
    return t(spark, d, "embeddings").select(F.col("vec_id").alias("k"), place(0).alias("x"), place(1).alias("y"))


def _ring(*corners):
    return F.array(F.array(*[F.struct((F.col("x") + dx).cast("double").alias("x"), (F.col("y") + dy).cast("double").alias("y")) for dx, dy in [*corners, corners[0]]]))


def _ells(spark, d):
    shape = _at(spark, d).withColumn("rings", _ring((0, 0), (20, 0), (20, 10), (8, 10), (8, 24), (0, 24)))
    return geometry.split(shape, "k", "rings")


_STAR = f"""{_AT}, v AS (SELECT k, i, x + (10 + 3 * cos(7 * i * pi() / 60)) * cos(i * pi() / 60) AS px, y + (10 + 3 * cos(7 * i * pi() / 60)) * sin(i * pi() / 60) AS py FROM a, range(120) AS n(i)),
e AS (SELECT k, px - x AS ax, py - y AS ay, lead(px - x, 1) OVER w AS bx, lead(py - y, 1) OVER w AS b_y, first(px - x) OVER w AS fx, first(py - y) OVER w AS fy FROM v JOIN a USING (k) WINDOW w AS (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


@query(f"WITH {_STAR} SELECT k, round(sum(ax * coalesce(b_y, fy) - coalesce(bx, fx) * ay) / 2, 6) AS area, true AS small FROM e GROUP BY k")
def q_subdivided(spark, d):
    """Stars of 121 points, split to parts of at most 64: the parts' areas add up to the star's."""
    radius = lambda i: 10 + 3 * F.cos(7 * (i % 120) * F.pi() / 60)
    star = F.transform(F.sequence(F.lit(0), F.lit(120)), lambda i: F.struct((F.col("x") + radius(i) * F.cos((i % 120) * F.pi() / 60)).alias("x"), (F.col("y") + radius(i) * F.sin((i % 120) * F.pi() / 60)).alias("y")))
    parts = geometry.split(_at(spark, d).withColumn("rings", F.array(star)), "k", "rings")
    return parts.groupBy("k").agg(F.round(F.sum(geometry.area_of()), 6).alias("area"), (F.max(F.size(F.flatten("rings"))) <= geometry.MOST).alias("small"))


@query(f"""WITH {_ELL} SELECT p.k AS a_key, q.k AS b_key, sum((least(p.x1, q.x1) - greatest(p.x0, q.x0)) * (least(p.y1, q.y1) - greatest(p.y0, q.y0))) AS area FROM r p JOIN r q ON p.k < q.k AND p.x0 < q.x1 AND q.x0 < p.x1 AND p.y0 < q.y1 AND q.y0 < p.y1 GROUP BY p.k, q.k HAVING area > 7""")
def q_shape_overlaps(spark, d):
    """Pairs of L-shaped areas that share more than 7."""
    ells = _ells(spark, d)
    both = geometry.overlaps(ells, "k", ells.withColumnRenamed("k", "j"), "j", 40.0, wanted=F.col("a_key") < F.col("b_key"))
    return both.withColumn("area", F.round("measure", 6)).where("area > 7").select("a_key", "b_key", "area")


@query(f"WITH {_ELL}, c AS (SELECT DISTINCT floor(x / 25) AS i, floor(y / 25) AS j FROM a) SELECT DISTINCT k, CAST(i * 1000 + j AS BIGINT) AS tile FROM r JOIN c ON x0 <= i * 25 + 25 AND i * 25 <= x1 AND y0 <= j * 25 + 25 AND j * 25 <= y1")
def q_shapes_at_zero(spark, d):
    """L-shaped areas and square tiles that share a point, touching borders included."""
    at = _at(spark, d)
    tile = at.select(F.floor(F.col("x") / 25).alias("i"), F.floor(F.col("y") / 25).alias("j")).distinct().select((F.col("i") * 1000 + F.col("j")).alias("tile"), (F.col("i") * 25).alias("x"), (F.col("j") * 25).alias("y"))
    tiles = geometry.split(tile.withColumn("rings", _ring((0, 0), (25, 0), (25, 25), (0, 25))), "tile", "rings")
    return geometry.at_distance_zero(_ells(spark, d), "k", tiles, "tile", 40.0).select(F.col("a_key").alias("k"), F.col("b_key").alias("tile"))


@query(f"""WITH {_AT}, c AS (SELECT DISTINCT floor(x / 100) AS i, floor(y / 100) AS j FROM a), m AS (SELECT k, CAST(1500 + i * 100 + j AS BIGINT) AS code, least(x + 30, i * 100 + 100) - greatest(x, i * 100) AS measure FROM a JOIN c ON floor(y / 100) = j AND x < i * 100 + 100 AND i * 100 < x + 30)
SELECT k, code, max(measure) AS measure FROM (SELECT * FROM m WHERE measure > 7 AND code NOT BETWEEN 1000 AND 1999 UNION ALL SELECT k, CAST(1500 + floor(x / 100) * 100 + floor(y / 100) AS BIGINT), NULL FROM a WHERE k % 3 = 0) GROUP BY k, code""")
def q_street_codes(spark, d):
    """Streets as lines of 30, postal areas as tiles of 100; urban codes come from addresses alone."""
    at = _at(spark, d)
    lines = at.select("k", geometry.line_edges(F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + 0.5).alias("y")) for dx in (0, 12, 30)])).alias("edges"))
    code = (1500 + F.floor(F.col("x") / 100) * 100 + F.floor(F.col("y") / 100)).cast("long").alias("code")
    tile = at.select(code, (F.floor(F.col("x") / 100) * 100).alias("x"), (F.floor(F.col("y") / 100) * 100).alias("y")).distinct()
    areas = geometry.split(tile.withColumn("rings", _ring((0, 0), (100, 0), (100, 100), (0, 100))), "code", "rings")
    return geometry.street_codes(lines, "k", areas, "code", at.where("k % 3 = 0").select("k", code), 100.0).withColumn("measure", F.round("measure", 6))


@query(f"""WITH {_AT}, c AS (SELECT DISTINCT k % 3 AS g, floor(x / 50) AS i, floor(y / 50) AS j FROM a)
SELECT p.g, count(DISTINCT (p.i, p.j)) * 2500.0 AS area, (4 * count(DISTINCT (p.i, p.j)) - count(q.g)) * 50.0 AS outline FROM c p LEFT JOIN c q ON p.g = q.g AND abs(p.i - q.i) + abs(p.j - q.j) = 1 GROUP BY p.g""")
def q_area_union(spark, d):
    """The union of each group's tiles: its area and the length of its outline."""
    tile = _at(spark, d).select((F.col("k") % 3).alias("g"), (F.floor(F.col("x") / 50) * 50).alias("x"), (F.floor(F.col("y") / 50) * 50).alias("y")).distinct()
    out = geometry.union(tile.withColumn("rings", _ring((0, 0), (50, 0), (50, 50), (0, 50))), ["g"], "rings")
    legs = lambda of: F.aggregate("rings", F.lit(0.0), lambda a, r: a + F.aggregate(F.sequence(F.lit(1), F.size(r) - 1), F.lit(0.0), lambda s, i: s + of(r[i - 1], r[i])))
    return out.select("g", (legs(lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]) / 2).alias("area"), legs(lambda p, q: F.hypot(q["x"] - p["x"], q["y"] - p["y"])).alias("outline"))


@query(f"WITH {_ELL} SELECT DISTINCT a.k AS point, r.k FROM a JOIN r ON a.x BETWEEN x0 AND x1 AND a.y BETWEEN y0 AND y1")
def q_covering_shapes(spark, d):
    """Points and the L-shaped areas that cover them, borders included."""
    at = _at(spark, d).withColumnRenamed("k", "point")
    return geometry.covering(at, "point", "x", "y", _ells(spark, d), "k", 40.0)


@query(f"WITH {_AT} SELECT k % 5 AS g, count(*) AS n, string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR) || ' ' || CAST(CAST(y AS BIGINT) AS VARCHAR), ',' ORDER BY k) AS starts FROM a GROUP BY g")
def q_collected_lines(spark, d):
    """Each group's lines put together as one multi-line, in the order of their keys."""
    point = lambda dx: F.struct((F.col("x") + dx).cast("long").alias("x"), F.col("y").cast("long").alias("y"))
    lines = _at(spark, d).select((F.col("k") % 5).alias("g"), "k", F.array(point(0), point(9)).alias("line"))
    out = geometry.collected(lines, ["g"], "line", ["k"])
    return out.select("g", F.size("lines").cast("long").alias("n"), F.array_join(F.transform("lines", lambda ln: F.concat_ws(" ", ln[0]["x"].cast("string"), ln[0]["y"].cast("string"))), ",").alias("starts"))


@query("WITH p AS (SELECT vec_id AS k, CAST(round(200 - atan2(CAST(embedding[2] AS DOUBLE), CAST(embedding[1] AS DOUBLE)) * 400 / (2 * pi()), 2) AS DECIMAL(5, 2)) AS g FROM embeddings) SELECT k, CAST(round(coalesce(CASE WHEN k % 9 > 0 THEN g END, 200) * 0.9 + 450, 0) AS INTEGER) % 180 - 90 AS angle FROM p")
def q_label_angle(spark, d):
    x, y = F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")
    return t(spark, d, "embeddings").select(F.col("vec_id").alias("k"), geo.label_angle(F.when(F.col("vec_id") % 9 > 0, geo.text_direction(x, y))).alias("angle"))


@query(f"WITH {_AT}, d AS (SELECT k, sqrt((x - 5) * (x - 5) + (y - 7) * (y - 7)) AS distance FROM a) SELECT k, round(distance, 6) AS distance FROM d WHERE distance < 120 ORDER BY d.distance, k LIMIT 10")
def q_nearest_within(spark, d):
    """The ten nearest places that are nearer than 120."""
    return spatial.nearest(_at(spark, d), "x", "y", 5.0, 7.0, "k", 10, within=120.0).select("k", F.round("distance", 6).alias("distance"))
