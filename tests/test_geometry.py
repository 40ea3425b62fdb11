"""Regions against a brute-force clipper that cuts by many thin slabs, and against known shapes."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldbook.operators import geometry as g


def star(cx, cy, r, n, seed, hole=True):
    rng = random.Random(seed)
    ring = lambda scale: np.array([(cx + scale * r * f * math.cos(2 * math.pi * k / n), cy + scale * r * f * math.sin(2 * math.pi * k / n)) for k, f in enumerate(0.6 + 0.4 * rng.random() for _ in range(n))])
    close = lambda p: np.vstack([p, p[:1]])
    return [close(ring(1)), *([close(ring(0.4)[::-1])] if hole else [])]


def spans(rings, x):
    """Where a vertical line is inside, as (low, high) pairs."""
    ys = sorted(a[1] + (x - a[0]) * (b[1] - a[1]) / (b[0] - a[0]) for r in rings for a, b in zip(r[:-1], r[1:], strict=True) if (a[0] > x) != (b[0] > x))
    return list(zip(ys[::2], ys[1::2], strict=True))


def slab_area(a, b, n=6000):
    """Common area by the middles of thin slabs."""
    xs = np.vstack([*a, *b])[:, 0]
    width = (xs.max() - xs.min()) / n
    return width * sum(max(0.0, min(p[1], q[1]) - max(p[0], q[0])) for k in range(n) for p in spans(a, xs.min() + (k + 0.5) * width) for q in spans(b, xs.min() + (k + 0.5) * width))


def area(rings):
    return abs(sum(g.signed_area(r) for r in g.oriented(rings)))


def frame(spark, shapes):
    return spark.createDataFrame([(k, [[(float(x), float(y)) for x, y in r] for r in s] if s is not None else None) for k, s in shapes], f"k long, rings {g.RINGS}")


@pytest.mark.parametrize("seed", range(4))
def test_parts_are_small_and_add_up(seed):
    shape = star(3, 4, 2, 700, seed)
    made = g.parts(g.oriented(shape), 64)
    assert len(made) > 10 and all(sum(map(len, p)) <= 64 for p in made)
    assert sum(area(p) for p in made) == pytest.approx(area(shape), rel=1e-9)
    for p in made:
        for r in p:
            assert (r[0] == r[-1]).all()
    rng = np.random.default_rng(seed)
    at = rng.uniform(0, 7, (2000, 2))
    whole = g.inside(at, np.vstack([g.ring_edges(r) for r in shape]))
    assert (sum(g.inside(at, np.vstack([g.ring_edges(r) for r in p])).astype(int) for p in made) == whole).all()


def test_points_on_the_cut_and_comb_shapes():
    comb = [np.array([(0, 0), (10, 0), (10, 4), (9, 4), (9, 1), (7, 1), (7, 4), (5, 4), (5, 1), (3, 1), (3, 5), (1, 5), (1, 1), (0, 1), (0, 0)], float)]
    for axis, at in ((1, 1.0), (1, 4.0), (0, 5.0), (1, 2.5), (0, 9.0)):
        low, high = g.half(comb, axis, at, True), g.half(comb, axis, at, False)
        assert area(low) + area(high) == pytest.approx(area(comb))
        assert all(r[:, axis].max() <= at for r in low) and all(r[:, axis].min() >= at for r in high)
    assert len(g.half(comb, 1, 2.5, False)) == 3


def pair_measure(a, b, lines=False):
    flat = lambda s: np.vstack([g.ring_edges(r) for r in (s if lines and s is a else g.oriented(s))])
    x, y = flat(a)[None], flat(b)[None]
    value, touch = g.measured(x, np.ones(x.shape[:2], bool), y, np.ones(y.shape[:2], bool), lines)
    return float(value[0]), bool(touch[0])


def test_common_area_of_non_convex_shapes_with_holes():
    for seed in range(12):
        rng = random.Random(seed)
        a, b = star(0, 0, 1, 23, seed), star(rng.uniform(-1.5, 1.5), rng.uniform(-1, 1), rng.uniform(0.4, 1.2), 17, seed + 50)
        assert pair_measure(a, b)[0] == pytest.approx(slab_area(a, b), abs=2e-3)
        assert pair_measure(a, b)[0] == pytest.approx(pair_measure(b, a)[0], abs=1e-9)
        assert pair_measure(a, a)[0] == pytest.approx(area(a))


def square(x, y, s=1.0):
    return [np.array([(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)], float)]


def test_touching_nested_and_disjoint():
    ring = [*square(0, 0, 4), *square(1, 1, 2)]
    assert pair_measure(square(0, 0), square(1, 0)) == (0, True)  # an edge
    assert pair_measure(square(0, 0), square(1, 1)) == (0, True)  # a corner
    assert pair_measure(square(0, 0), square(1.5, 0)) == (0, False)
    assert pair_measure(square(0, 0, 4), square(1, 1)) == (1, True)  # nested
    assert pair_measure(ring, square(1.5, 1.5)) == (0, False)  # in the hole
    assert pair_measure(ring, square(1, 1, 2)) == (0, True)  # the hole itself
    assert pair_measure(square(0, 0, 2), square(0, 0, 1))[0] == 1  # shared borders
    assert pair_measure(square(0, 0), square(0.5, 0))[0] == pytest.approx(0.5)
    assert pair_measure(square(10.25, 3.5), square(10.25, 3.5))[0] == pytest.approx(1)


def test_line_inside_a_region():
    ring = [*square(0, 0, 4), *square(1, 1, 2)]
    assert pair_measure([np.array([(-1, 2), (9, 2)], float)], ring, True)[0] == pytest.approx(2)
    assert pair_measure([np.array([(0, -1), (0, 9)], float)], ring, True)[0] == pytest.approx(4)  # along the border
    assert pair_measure([np.array([(1.2, 1.2), (2, 2)], float)], ring, True) == (0, False)


def test_joins_over_parts_are_those_of_whole_shapes(spark):
    shapes = [(k, star(random.Random(k).uniform(0, 6), random.Random(k + 100).uniform(0, 6), 1, 90, k)) for k in range(30)]
    df = frame(spark, shapes + [(99, None)])
    small = g.split(df, "k", "rings", 40)
    assert small.where(F.size(F.flatten("rings")) > 40).count() == 0
    got = {(r.a_key, r.b_key): r.measure for r in g.overlaps(small, "k", small.withColumnRenamed("k", "j"), "j", 0.7).collect()}
    for i, a in shapes:
        for j, b in shapes:
            value, touch = pair_measure(a, b)
            assert touch == ((i, j) in got), (i, j)
            if touch:
                assert got[i, j] == pytest.approx(value, abs=1e-8)
    assert {tuple(r) for r in g.at_distance_zero(small, "k", small.withColumnRenamed("k", "j"), "j", 1.3).collect()} == set(got)
    areas = {r.k: r.a for r in small.groupBy("k").agg(F.sum(g.area_of()).alias("a")).collect()}
    assert areas == {k: pytest.approx(area(s)) for k, s in shapes}
    rng = np.random.default_rng(1)
    at = rng.uniform(-1, 7, (500, 2))
    points = spark.createDataFrame([(n, float(x), float(y)) for n, (x, y) in enumerate(at)], "n long, x double, y double")
    covered = {tuple(r) for r in g.covering(points, "n", "x", "y", small, "k", 0.7).collect()}
    assert covered == {(int(n), k) for k, s in shapes for n in np.flatnonzero(g.inside(at, np.vstack([g.ring_edges(r) for r in s])))}
    again = g.refreshed(small, frame(spark, [(3, square(0, 0)), (4, None)]), "k", "rings", 40)
    left = {r.k: r.a for r in again.groupBy("k").agg(F.sum(g.area_of()).alias("a")).collect()}
    assert left[3] == 1 and 4 not in left and left[5] == areas[5]


def test_union_of_a_grid_is_its_outline(spark):
    tiles = [(x, y) for x in range(6) for y in range(5) if (x, y) not in ((2, 2), (5, 4))] + [(9, 9), (10, 10)]
    df = frame(spark, [(k % 1, square(x, y)) for k, (x, y) in enumerate(tiles)]).withColumn("g", F.lit("a"))
    out = g.union(df, ["g"], "rings")
    assert "partial_sum" in out._jdf.queryExecution().toString()
    rings = [np.array([(p.x, p.y) for p in r]) for r in out.first().rings]
    assert sum(g.signed_area(r) for r in rings) == len(tiles)
    assert sorted(len(r) - 1 for r in rings) == [4, 4, 4, 6]  # a hole, two tiles that meet in a corner, the outline less a corner
    mixed = frame(spark, [(1, square(0, 0)), (1, [square(1, 0)[0][::-1]])])  # either winding
    assert [len(r) for r in g.union(mixed, ["k"], "rings").first().rings] == [5]


def test_street_codes_leave_urban_ones_to_addresses(spark):
    line = spark.createDataFrame([(1, [0.0, 0.5, 30.0, 0.5]), (2, [0.0, 5.5, 3.0, 5.5])], "s long, edges array<double>")
    areas = g.split(frame(spark, [(1500, square(0, 0, 10)), (2000, square(10, 0, 10)), (3000, square(20, 0, 10)), (4000, square(29, 0, 10))]).withColumnRenamed("k", "c"), "c", "rings")
    known = spark.createDataFrame([(1, 1500), (2, 1500), (1, 2000)], "s long, c long")
    got = sorted((r.s, r.c, r.measure) for r in g.street_codes(line, "s", areas, "c", known, 7.0).collect())
    assert got == [(1, 1500, None), (1, 2000, 10.0), (1, 3000, 10.0), (2, 1500, None)]


def test_collected_lines_keep_their_order(spark):
    df = spark.createDataFrame([("a", 2, [(1.0, 1.0)]), ("a", 1, [(0.0, 0.0)])], "g string, n int, line array<struct<x:double,y:double>>")
    assert [tuple(p[0]) for p in g.collected(df, ["g"], "line", ["n"]).first().lines] == [(0.0, 0.0), (1.0, 1.0)]


def test_a_crowded_cell_is_dealt_over_tasks(spark):
    from fieldbook.operators.balanced import cell_join

    a = spark.range(40).select("id", (F.col("id") % 4).alias("c"))
    b = spark.range(1000).select(F.col("id").alias("other"), F.when(F.col("id") < 900, 1).otherwise(F.col("id") % 4).cast("long").alias("c"))
    want = sorted((r.id, r.other) for r in a.join(b, "c").collect())
    for most in (10**6, 100, 7):
        assert sorted((r.id, r.other) for r in cell_join(a, b, ["c"], most).collect()) == want
    spread = cell_join(a, b, ["c"], 100).queryExecution if hasattr(a, "queryExecution") else cell_join(a, b, ["c"], 100)._jdf.queryExecution()
    assert "share_" in spread.toString()


def test_placements_are_measured_once_and_give_the_same_pairs(spark, monkeypatch):
    from fieldbook.operators import geometry

    ring = lambda w: F.array(F.array(*[F.struct((F.col("x") + dx).cast("double").alias("x"), (F.col("y") + dy).cast("double").alias("y")) for dx, dy in ((0, 0), (w, 0), (w, 7), (0, 7), (0, 0))]))
    at = spark.range(150).select(F.col("id").alias("k"), (F.col("id") * 7 % 40).alias("x"), (F.col("id") * 11 % 30).alias("y"))
    a = geometry.split(at.withColumn("rings", F.when(F.col("k") % 2 == 0, ring(5)).otherwise(ring(9))), "k", "rings")
    b = a.withColumnRenamed("k", "j")
    wanted = F.col("a_key") < F.col("b_key")
    result = lambda: {(r.a_key, r.b_key): round(r.measure, 6) for r in geometry.overlaps(a, "k", b, "j", 10.0, wanted=wanted).collect()}
    monkeypatch.setattr(geometry, "ALIKE", 1e9)
    direct = result()
    monkeypatch.setattr(geometry, "ALIKE", 0)
    assert result() == direct and len(direct) > 500 and all(p < q for p, q in direct)
    monkeypatch.setattr(geometry, "SENT", 0)
    assert result() == direct
