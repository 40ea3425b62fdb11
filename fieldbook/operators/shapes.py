"""Centres of shapes and their text form."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _points(ring) -> np.ndarray:
    return np.array([[float(p[0]), float(p[1])] for p in ring]).reshape(-1, 2)


def _area(rings: list[np.ndarray]) -> float:
    """Size of the summed signed areas: holes are wound against their shell."""
    return abs(sum(float(np.sum(r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1])) / 2 for r in rings))


def _clearance(at: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Distance of each point to the nearest edge, negative outside (even-odd)."""
    x, y = at[:, :1], at[:, 1:]
    ax, ay, bx, by = edges.T
    length = np.maximum((bx - ax) ** 2 + (by - ay) ** 2, 1e-300)
    t = np.clip(((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / length, 0, 1)
    near = np.sqrt(((x - ax - t * (bx - ax)) ** 2 + (y - ay - t * (by - ay)) ** 2).min(axis=1))
    spans = (ay > y) != (by > y)
    crossed = spans & (x < (bx - ax) * (y - ay) / np.where(by == ay, 1, by - ay) + ax)
    return np.where(crossed.sum(axis=1) % 2 == 1, near, -near)


def _centre(rings: list[np.ndarray], precision: float) -> tuple[float, float]:
    """The inner point farthest from the edges, to ``precision``: squares that can't hold a better one are left out, the rest quartered."""
    shell, edges = rings[0], np.concatenate([np.hstack([r[:-1], r[1:]]) for r in rings])
    low, size = shell.min(axis=0), np.ptp(shell, axis=0)
    if size.min() == 0:
        return tuple(map(float, shell[0]))
    cross = shell[:-1, 0] * shell[1:, 1] - shell[1:, 0] * shell[:-1, 1]
    best = ((shell[:-1] + shell[1:]) * cross[:, None]).sum(axis=0) / (3 * cross.sum()) if cross.sum() else low + size / 2
    far = _clearance(best[None], edges)[0]
    half = size.min() / 2
    cells = np.stack(np.meshgrid(np.arange(low[0], low[0] + size[0], 2 * half), np.arange(low[1], low[1] + size[1], 2 * half)), -1).reshape(-1, 2) + half
    while len(cells):
        d = _clearance(cells, edges)
        if d.max() > far:
            best, far = cells[d.argmax()], d.max()
        cells, half = cells[d + half * math.sqrt(2) > far + precision], half / 2
        cells = (cells[:, None] + half * np.array([[-1, -1], [-1, 1], [1, -1], [1, 1]])).reshape(-1, 2)
    return float(best[0]), float(best[1])


def visual_centre(polygons: Column, precision: float = 1.0) -> Column:
    """struct(x, y): the visual centre of the largest of some polygons (array of polygons, of rings, of points, of coordinates); nulls without any.

    One polygon is one row, so a task holds one batch of them; built-ins have no search of this kind.
    """

    @F.arrow_udf("x double, y double")
    def centre(shapes: pa.Array) -> pa.Array:
        out = []
        for shape in shapes.to_pylist():
            parts = [[_points(r) for r in p] for p in shape or [] if p and len(p[0]) > 3]
            out.append(_centre(max(parts, key=_area), precision) if parts else (None, None))
        return pa.StructArray.from_arrays([pa.array([c[i] for c in out], pa.float64()) for i in (0, 1)], ["x", "y"])

    return centre(polygons)


def nearest_to_centroid(line: Column) -> Column:
    """struct(x, y): the point of a line (array of struct(x, y)) nearest to its centroid: the centre of shapes that have no inside."""
    legs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(line) - 1, F.lit(1))), lambda i: F.struct(line[i - 1].alias("a"), F.coalesce(F.get(line, i), line[i - 1]).alias("b")))
    length = lambda e: F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"])
    total = lambda es, of: F.aggregate(es, F.lit(0.0), lambda s, e: s + of(e))

    def mean(es: Column, axis: str) -> Column:
        weighted = total(es, lambda e: length(e) * (e["a"][axis] + e["b"][axis]) / 2) / F.nullif(total(es, length), F.lit(0.0))
        return F.coalesce(weighted, es[0]["a"][axis])

    def foot(e: Column, cx: Column, cy: Column) -> Column:
        dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        t = F.coalesce(((cx - e["a"]["x"]) * dx + (cy - e["a"]["y"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))
        t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
        x, y = e["a"]["x"] + t * dx, e["a"]["y"] + t * dy
        return F.struct(F.hypot(x - cx, y - cy).alias("d"), x.alias("x"), y.alias("y"))

    best = F.array_min(F.transform(legs, lambda e: foot(e, mean(legs, "x"), mean(legs, "y"))))
    return F.when(F.size(line) > 0, F.struct(best["x"].alias("x"), best["y"].alias("y")))


#: How deep the coordinates of a kind of geometry are nested.
DEPTH = {"Point": 0, "LineString": 1, "MultiPoint": 1, "Polygon": 2, "MultiLineString": 2, "MultiPolygon": 3}


def ewkt(kind: str, coordinates: Column, srid: int = 25832, z: bool = False, multi: bool = False) -> Column:
    """Text of a GeoJSON geometry with its coordinate system, made a multi-geometry if asked; null stays null."""
    name = f"Multi{kind}" if multi and f"Multi{kind}" in DEPTH else kind
    whole = F.array(coordinates) if name != kind else coordinates
    text = lambda place: F.array_join(F.transform(place, lambda v: v.cast("string")), " ")
    for _ in range(DEPTH[name]):
        text = lambda many, inner=text: F.concat(F.lit("("), F.array_join(_each(many, inner), ", "), F.lit(")"))
    return F.when(coordinates.isNotNull(), F.concat(F.lit(f"SRID={srid}; {name}{'Z' if z else ''}"), text(whole)))


def _each(many: Column, shown: Callable[[Column], Column]) -> Column:
    return F.transform(many, lambda one: shown(one))
