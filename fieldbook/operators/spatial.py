"""Spatial joins over points: equal grid cells first, exact geometry second."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldbook.functions import geo
from fieldbook.operators.balanced import cell_join
from fieldbook.operators.stored import removed, stored


def within_circle(df: DataFrame, x: str, y: str, cx: float, cy: float, r: float) -> DataFrame:
    """The box is a range filter that reaches the scan; the circle is exact, its edge included."""
    box = F.col(x).between(cx - r, cx + r) & F.col(y).between(cy - r, cy + r)
    return df.filter(box & (geo.distance(F.col(x), F.col(y), F.lit(cx), F.lit(cy)) <= r))


def within_polygon(df: DataFrame, x: str, y: str, ring: list[tuple[float, float]], boundary: bool = True) -> DataFrame:
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    box = F.col(x).between(min(xs), max(xs)) & F.col(y).between(min(ys), max(ys))
    return df.filter(box & geo.in_ring(F.col(x), F.col(y), ring, boundary))


def nearest(df: DataFrame, x: str, y: str, cx: float, cy: float, key: str, k: int = 1, within: float | None = None) -> DataFrame:
    """The k nearest rows, then by key; with ``within`` only those nearer than that, whose box goes to the scan."""
    d = geo.distance(F.col(x), F.col(y), F.lit(cx), F.lit(cy))
    if within is not None:
        df = df.filter(F.col(x).between(cx - within, cx + within) & F.col(y).between(cy - within, cy + within) & (d < within))
    return df.withColumn("distance", d).orderBy("distance", key).limit(k)


def check_ring(ring: list[tuple[float, float]], bounds: tuple[float, float, float, float]) -> None:
    if len(ring) < 4 or ring[0] != ring[-1]:
        raise ValueError("a ring has four points or more and ends where it begins")
    if any(not (bounds[0] <= px <= bounds[2] and bounds[1] <= py <= bounds[3]) for px, py in ring):
        raise ValueError("a point is outside the bounds of the coordinate system")


def _neighbour_cells(df: DataFrame, x: str, y: str, size: float) -> DataFrame:
    """One row for the own and each of the eight cells around."""
    around = F.array(*[F.struct((F.floor(F.col(x) / size) + i).alias("_cx"), (F.floor(F.col(y) / size) + j).alias("_cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    return df.withColumn("_c", F.explode(around)).select("*", "_c.*").drop("_c")


def distance_join(a: DataFrame, b: DataFrame, r: float, ax: str = "ax", ay: str = "ay", bx: str = "bx", by: str = "by") -> DataFrame:
    """Pairs within r: a cell is r wide, so partners lie in the own cell or one next to it."""
    here = b.withColumn("_cx", F.floor(F.col(bx) / r)).withColumn("_cy", F.floor(F.col(by) / r))
    d = geo.distance(F.col(ax), F.col(ay), F.col(bx), F.col(by))
    return cell_join(_neighbour_cells(a, ax, ay, r), here, ["_cx", "_cy"]).withColumn("distance", d).filter(F.col("distance") <= r).drop("_cx", "_cy")


def nearest_join(a: DataFrame, b: DataFrame, a_key: str, b_key: str, cell: float, ax: str = "ax", ay: str = "ay", bx: str = "bx", by: str = "by") -> DataFrame:
    """The nearest row of b for each row of a, by rings of cells: a hit closer than the ring's width is final; the rest, written once, looks in cells four times as wide.

    The widest ring covers b's whole extent, which its two corners bound, so the loop ends.
    """
    span = b.agg(F.min(bx), F.max(bx), F.min(by), F.max(by)).first()
    mine = a.agg(F.min(ax), F.max(ax), F.min(ay), F.max(ay)).first()
    if span[0] is None or mine[0] is None:
        return a.join(b, F.lit(False)).withColumn("distance", F.lit(None).cast("double"))
    reach = max(span[1], mine[1]) - min(span[0], mine[0]) + max(span[3], mine[3]) - min(span[2], mine[2])
    out, left, r, spent = None, a, cell, None
    w = Window.partitionBy(a_key).orderBy("distance", b_key)
    while True:
        best = stored(distance_join(left, b, r, ax, ay, bx, by).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r"), "nearest")
        out = best if out is None else out.unionByName(best)
        if r > reach:
            return out
        left, r = stored(left.join(best.select(a_key), a_key, "left_anti"), "unmet"), r * 4
        if spent is not None:
            removed(spent)
        spent = left
        if left.isEmpty():
            return out


def polygon_join(points: DataFrame, polygons: DataFrame, size: float, x: str, y: str, key: str, first_only: str | None = None) -> DataFrame:
    """(point, polygon) pairs of covering polygons; polygons(key, ring: array<struct<x, y>>, closed). With ``first_only`` (the points' key) the smallest polygon key of each point.

    Polygons are listed under the grid cells of their box; the even-odd test runs on the pairs of equal cells.
    """
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    cells = (
        polygons.withColumn("_cx", F.explode(F.sequence(F.floor(F.array_min(xs) / size), F.floor(F.array_max(xs) / size))))
        .withColumn("_cy", F.explode(F.sequence(F.floor(F.array_min(ys) / size), F.floor(F.array_max(ys) / size))))
    )
    at = points.withColumn("_cx", F.floor(F.col(x) / size)).withColumn("_cy", F.floor(F.col(y) / size))
    edges = F.arrays_zip(F.slice("ring", F.lit(1), F.size("ring") - 1).alias("a"), F.slice("ring", F.lit(2), F.size("ring") - 1).alias("b"))

    def crossed(e):
        ax, ay, bx, by = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
        return ((ay > F.col(y)) != (by > F.col(y))) & (F.col(x) < (bx - ax) * (F.col(y) - ay) / F.nullif(by - ay, F.lit(0.0)) + ax)

    def on_edge(e):
        ax, ay, bx, by = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
        straight = (F.col(x) - ax) * (by - ay) == (F.col(y) - ay) * (bx - ax)
        return straight & F.col(x).between(F.least(ax, bx), F.greatest(ax, bx)) & F.col(y).between(F.least(ay, by), F.greatest(ay, by))

    covers = (F.size(F.filter(edges, lambda e: F.coalesce(crossed(e), F.lit(False)))) % 2 == 1) | F.exists(edges, on_edge)
    hits = cell_join(cells, at, ["_cx", "_cy"]).filter(covers).select(*points.columns, *polygons.columns)
    if first_only is None:
        return hits
    return hits.withColumn("_r", F.row_number().over(Window.partitionBy(first_only).orderBy(key))).filter("_r = 1").drop("_r")


def covering_or(points: DataFrame, areas: DataFrame, size: float, x: str, y: str, point_key: str, value: str, default) -> DataFrame:
    """Every point with the lowest ``value`` of the areas that cover it, or the default."""
    met = polygon_join(points.select(point_key, x, y), areas, size, x, y, value).groupBy(point_key).agg(F.min(value).alias(value))
    return points.join(met, point_key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def covered_pairs(points: DataFrame, areas: DataFrame, size: float, x: str, y: str, group: str, key: str) -> DataFrame:
    """Distinct (group of points, area) pairs in which some point is covered."""
    return polygon_join(points, areas, size, x, y, key).select(group, key).distinct()


def box_overlaps(a: DataFrame, b: DataFrame, size: float, least: float) -> DataFrame:
    """(a_key, b_key, area) of boxes a(a_key, x0, x1, y0, y1) and b that overlap by more than ``least``. Boxes are listed under the grid cells they cross; the overlap's lowest cell alone lists a pair, so none comes twice."""
    def celled(df: DataFrame, p: str) -> DataFrame:
        named = df.select(f"{p}_key", *[F.col(c).alias(f"{p}{c}") for c in ("x0", "x1", "y0", "y1")])
        across = named.withColumn("cx", F.explode(F.sequence(F.floor(F.col(f"{p}x0") / size), F.floor(F.col(f"{p}x1") / size))))
        return across.withColumn("cy", F.explode(F.sequence(F.floor(F.col(f"{p}y0") / size), F.floor(F.col(f"{p}y1") / size))))

    left, low = F.greatest("ax0", "bx0"), F.greatest("ay0", "by0")
    area = (F.least("ax1", "bx1") - left) * (F.least("ay1", "by1") - low)
    real = (F.col("ax0") < F.col("bx1")) & (F.col("bx0") < F.col("ax1")) & (F.col("ay0") < F.col("by1")) & (F.col("by0") < F.col("ay1"))
    once = (F.col("cx") == F.floor(left / size)) & (F.col("cy") == F.floor(low / size))
    return celled(a, "a").join(celled(b, "b"), ["cx", "cy"]).filter(real & once).select("a_key", "b_key", area.alias("area")).filter(F.col("area") > least)


def hull_boxes(points: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """A group's points put together: their number, box and centre."""
    return points.groupBy(*group).agg(F.count("*").alias("n"), F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"), F.avg(x).alias("cx"), F.avg(y).alias("cy"))


def quartered(points: DataFrame, x: str, y: str, size: float, most: int = 64, deepest: int = 12) -> DataFrame:
    """level, cx, cy: each point's cell once squares are quartered until they hold at most so many points (or are ``deepest`` times halved). Only counts of cells are looked at between levels."""
    out, left = None, points.withColumn("level", F.lit(0))
    for level in range(deepest + 1):
        s = size / 2**level
        here = left.withColumn("level", F.lit(level)).withColumn("cx", F.floor(F.col(x) / s)).withColumn("cy", F.floor(F.col(y) / s))
        if level == deepest:
            return here if out is None else out.unionByName(here)
        crowded = here.groupBy("cx", "cy").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("cx", "cy")
        done = here.join(crowded, ["cx", "cy"], "left_anti").select(here.columns)
        out = done if out is None else out.unionByName(done)
        left = stored(here.join(crowded, ["cx", "cy"], "left_semi").select(points.columns), "crowded")
        if left.isEmpty():
            return out


def moved(df: DataFrame, x: str, y: str, old_x: str, old_y: str, least: float = 0.1) -> DataFrame:
    """Rows whose place is new or farther than ``least`` from the one before, compared in millimetres."""
    far = F.hypot(F.round(x, 3) - F.round(old_x, 3), F.round(y, 3) - F.round(old_y, 3)) > least
    return df.filter(F.coalesce(far, F.col(x).isNotNull() | F.col(old_x).isNotNull()))


def near_place(df: DataFrame, x: str, y: str, px: float, py: float, r: float) -> DataFrame:
    """Rows within r of a place with their distance; the box test goes to the scan."""
    return within_circle(df, x, y, px, py, r).withColumn("distance", geo.distance(F.col(x), F.col(y), F.lit(px), F.lit(py)))


def line(ax, ay, bx, by):
    """WKT of the line between two points."""
    return F.concat(F.lit("LINESTRING("), ax.cast("string"), F.lit(" "), ay.cast("string"), F.lit(","), bx.cast("string"), F.lit(" "), by.cast("string"), F.lit(")"))


def registered_elsewhere(df: DataFrame, registered: str, found: str, nulls: bool = True) -> DataFrame:
    """Rows whose registered area is not the one found on the map; with ``nulls`` a value on one side only is a difference too."""
    return df.filter(~F.col(registered).eqNullSafe(F.col(found)) if nulls else F.col(registered) != F.col(found))


def geometry_differs(a: str, b: str, digits: int = 3):
    """Whether two arrays of points differ once they are rounded and begin at their lowest point: the same ring begun elsewhere is no change."""
    def normal(c):
        pts = F.transform(F.col(c), lambda p: F.struct(F.round(p["x"], digits).alias("x"), F.round(p["y"], digits).alias("y")))
        bare = F.slice(pts, F.lit(1), F.greatest(F.size(pts) - 1, F.lit(0)))
        at = F.array_position(bare, F.array_min(bare)).cast("int")
        return F.concat(F.slice(bare, at, F.size(bare) - at + 1), F.slice(bare, F.lit(1), at - 1))

    return ~F.col(a).eqNullSafe(F.col(b)) & ~normal(a).eqNullSafe(normal(b))
