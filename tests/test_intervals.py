"""Interval priority, extension, boxes and algebra against plain versions that look at every unit."""

import datetime as dt
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldbook.operators import intervals

END = 40


def rows_of(seed, n, groups=4, nulls=True):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        lo, hi = rng.randrange(END), rng.randrange(END + 6)
        out.append((rng.randrange(groups), k, None if nulls and rng.random() < 0.05 else lo, None if nulls and rng.random() < 0.05 else hi, rng.choice(["a", "b", None, "c"])))
    return out


def plain(rows):
    """{group: runs} by painting every unit from -1 to END + 6, the first and last of which stand for what lies beyond."""
    out = {}
    for g in {r[0] for r in rows}:
        line = [()] * (END + 8)
        for _, _, lo, hi, ref in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            for x in range(0 if lo is None else lo + 1, len(line) if hi is None else hi + 1):
                line[x] = (ref,)
        runs = []
        for x, ref in enumerate(line):
            if ref == ():
                continue
            if runs and runs[-1][1] == x and runs[-1][2] == ref[0]:
                runs[-1][1] = x + 1
            else:
                runs.append([x, x + 1, ref[0]])
        out[g] = [(None if a == 0 else a - 1, None if b == len(line) else b - 1, r) for a, b, r in runs]
    return out


def extended(runs):
    whole = []
    for a, b, r in runs:
        if whole and whole[-1][2] == r:
            whole[-1][1] = b
        else:
            whole.append([a, b, r])
    return [(None if k == 0 else whole[k - 1][1], None if k == len(whole) - 1 else w[1], w[2]) for k, w in enumerate(whole)]


def resolved(spark, rows, **kw):
    df = spark.createDataFrame(rows, "g int, k int, lo int, hi int, ref string")
    out = {}
    for r in intervals.resolve(df, ["g"], ["k"], "lo", "hi", "ref", **kw).collect():
        out.setdefault(r.g, []).append((r.lo, r.hi, r.ref))
    return {g: sorted(v, key=lambda x: -1 if x[0] is None else x[0]) for g, v in out.items()}


@pytest.mark.parametrize("seed", range(3))
def test_priority_and_extension_are_those_of_painted_units(spark, seed):
    rows = rows_of(seed, 60, nulls=seed > 0)
    want = plain(rows)
    assert resolved(spark, rows) == want
    assert resolved(spark, rows, extend=True) == {g: extended(v) for g, v in want.items()}


def test_large_groups_are_cut_and_joined_again(spark):
    rows = rows_of(7, 300, 2) + [(5, 0, 3, 9, "x")]
    assert resolved(spark, rows, large=100) == plain(rows)
    assert resolved(spark, rows, large=100, extend=True) == {g: extended(v) for g, v in plain(rows).items()}


def test_a_group_of_many_long_intervals_takes_seconds(spark):
    n = 100_000
    df = spark.range(n).select(F.lit(1).alias("g"), "id", (F.col("id") % 1000).alias("lo"), (F.col("id") + 2000).alias("hi"))
    began = time.time()
    got = intervals.resolve(df, ["g"], ["id"], "lo", "hi", "id")
    assert got.count() > 0 and time.time() - began < 30
    last = got.orderBy(F.desc("hi")).first()
    assert (last.hi, last.id) == (n + 1999, n - 1)


def test_highest_of_long_and_short_intervals():
    rng = np.random.default_rng(2)
    first = rng.integers(0, 200, 500)
    end = first + rng.integers(0, 200, 500)
    rank = rng.permutation(500)
    want = np.full(400, -1)
    for a, b, r in zip(first, end, rank, strict=True):
        want[a:b] = np.maximum(want[a:b], r)
    assert (intervals.highest(first, end, rank, 400) == want).all()


def test_timestamps_and_names_that_began_last(spark):
    day = lambda n: dt.datetime(2020, 1, n)
    df = spark.createDataFrame([(1, day(1), day(9), "old"), (1, day(3), day(5), "new"), (1, day(11), None, "last")], "s int, lo timestamp, hi timestamp, ref string")
    got = sorted(((r.lo, r.hi, r.ref) for r in intervals.names_extended(df, ["s"], "lo", "hi", "ref").collect()), key=lambda r: r[0] or day(1))
    assert got == [(None, day(3), "old"), (day(3), day(5), "new"), (day(5), day(9), "old"), (day(9), None, "last")]
    assert intervals.resolve(df.limit(0), ["s"], ["lo"], "lo", "hi", "ref", extend=True).count() == 0


def test_boxes_are_those_of_painted_cells(spark):
    rng = random.Random(5)
    rows = []
    for k in range(50):
        x, y = rng.randrange(12), rng.randrange(8)
        rows.append((rng.randrange(3), k, x, x + rng.randint(0, 6), y, y + rng.randint(0, 5), rng.choice("abc")))
    df = spark.createDataFrame(rows, "g int, k int, x0 int, x1 int, y0 int, y1 int, ref string")
    for extend in (False, True):
        want = {}
        for g, _, x0, x1, y0, y1, ref in rows:
            want.update({(g, x, y): ref for x in range(x0, x1) for y in range(y0, y1)})
        if extend:
            for g, y in {(g, y) for g, _, y in want}:
                own = sorted(x for a, x, b in want if (a, b) == (g, y))
                for x in range(-2, 30):
                    want.setdefault((g, x, y), want[g, next((z for z in own if z >= x), own[-1]), y])
        got = {}
        out = intervals.boxes(df, ["g"], ["k"], ("x0", "x1"), ("y0", "y1"), "ref", extend=extend).collect()
        for r in out:
            for x in range(-2 if r.x0 is None else r.x0, 30 if r.x1 is None else r.x1):
                for y in range(r.y0, r.y1):
                    assert (r.g, x, y) not in got
                    got[r.g, x, y] = r.ref
        assert got == want
        # nothing that could be one box is left as two
        assert not any(a.g == b.g and a.ref == b.ref and (a.x0, a.x1) == (b.x0, b.x1) and a.y1 == b.y0 for a in out for b in out)


def test_a_street_with_a_layer_over_all_numbers(spark):
    """The case of an area of some house numbers inside an older one of all numbers: it keeps its time, and the layer around it is extended."""
    rows = [(1, 2014, 2017, 0, 999, 9000), (1, 2015, 2016, 10, 20, 8000)]
    df = spark.createDataFrame(rows, "s int, x0 int, x1 int, y0 int, y1 int, ref int")
    got = {tuple(r) for r in intervals.streets_extended(df, ["s"], ("x0", "x1"), ("y0", "y1"), "ref", (0, 999)).collect()}
    assert got == {(1, None, None, 0, 10, 9000), (1, None, None, 20, 999, 9000), (1, None, 2015, 10, 20, 9000), (1, 2015, 2016, 10, 20, 8000), (1, 2016, None, 10, 20, 9000)}


def test_algebra_of_open_and_closed_intervals(spark):
    """Against sets of half units: an interval of whole bounds holds a bound or not, and all between."""
    rng = random.Random(1)
    some = lambda: (rng.choice([None, *range(5)]), rng.choice([None, *range(3, 8)]), rng.random() < 0.5, rng.random() < 0.5)
    pairs = [(*some(), *some()) for _ in range(200)]
    df = spark.createDataFrame([(k, a, b, c, d) for k, (a, b, _, _, c, d, _, _) in enumerate(pairs)], "k int, a int, b int, c int, d int")
    points = [x / 2 for x in range(-4, 22)]
    held = lambda lo, hi, i, j: {x for x in points if (lo is None or x > lo or (i and x == lo)) and (hi is None or x < hi or (j and x == hi))}
    for flags in ((True, True, True, False), (False, False, True, True), (True, False, False, True)):
        x, y = intervals.interval(F.col("a"), F.col("b"), flags[:2]), intervals.interval(F.col("c"), F.col("d"), flags[2:])
        rows = df.select("k", intervals.intersection(x, y).alias("both"), intervals.left_of(x, y).alias("left"), intervals.right_of(x, y).alias("right"), intervals.merged(x, y).alias("one")).collect()
        back = lambda z: set() if z is None else held(z.lo.value, z.hi.value, z.lo.after == 0, z.hi.after == 1)
        for r in rows:
            a, b, _, _, c, d, _, _ = pairs[r.k]
            p, q = held(a, b, *flags[:2]), held(c, d, *flags[2:])
            if not p or not q:
                continue
            assert back(r.both) == p & q
            assert back(r.left) == {z for z in p if z < min(q)}
            assert back(r.right) == {z for z in p if z > max(q)}
            if r.one is not None:
                assert back(r.one) == p | q and not p & q
