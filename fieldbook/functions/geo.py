"""Plane geometry and reprojection as expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.hypot(ax - bx, ay - by)


def grid_code(x: Column, y: Column, size: int, unit: str) -> Column:
    return F.concat(F.lit(f"{unit}_"), F.floor(y / size).cast("string"), F.lit("_"), F.floor(x / size).cast("string"))


def in_ring(x: Column, y: Column, ring: list[tuple[float, float]], boundary: bool = True) -> Column:
    """Even-odd test of a point in a closed ring given as constants; points on an edge count as inside if ``boundary`` is set."""
    crossings, edge = F.lit(0), F.lit(False)
    for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
        if ay != by:
            at = (bx - ax) * (y - ay) / (by - ay) + ax
            crossings = crossings + F.when(((F.lit(ay) > y) != (F.lit(by) > y)) & (x < at), 1).otherwise(0)
        cross = (x - ax) * (by - ay) - (y - ay) * (bx - ax)
        edge = edge | ((cross == 0) & x.between(min(ax, bx), max(ax, bx)) & y.between(min(ay, by), max(ay, by)))
    inside = crossings % 2 == 1
    return (inside | edge) if boundary else (inside & ~edge)


# The GRS80 ellipsoid and UTM zone 32.
_A, _F, _K0, _E0, _LON0 = 6378137.0, 1 / 298.257222101, 0.9996, 500000.0, 9.0


def _series() -> tuple[float, list[float], list[float], list[float]]:
    """Krüger's series to the fourth order: rectifying radius, forward (alpha), inverse (beta) and latitude (delta) terms."""
    n = _F / (2 - _F)
    radius = _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    delta = [2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630]
    return radius, alpha, beta, delta


def to_utm32(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Easting and northing, to the millimetre, of degrees."""
    radius, alpha, _, _ = _series()
    n = _F / (2 - _F)
    c = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - _LON0)
    t = F.sinh(F.atanh(F.sin(phi)) - c * F.atanh(c * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    e, nn = eta, xi
    for j, a in enumerate(alpha, 1):
        e = e + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        nn = nn + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.round(_E0 + _K0 * radius * e, 3), F.round(_K0 * radius * nn, 3)


def from_utm32(east: Column, north: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees, to 8 decimals."""
    radius, _, beta, delta = _series()
    xi, eta = north / (_K0 * radius), (east - _E0) / (_K0 * radius)
    x, e = xi, eta
    for j, b in enumerate(beta, 1):
        x = x - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        e = e - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(x) / F.cosh(e))
    lat = chi
    for j, d in enumerate(delta, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return F.round(F.degrees(F.atan2(F.sinh(e), F.cos(x))) + _LON0, 8), F.round(F.degrees(lat), 8)


def text_direction(dx: Column, dy: Column) -> Column:
    """Direction of a text along (dx, dy) in gon, 200 to the right, as numeric(5,2)."""
    return F.round(200 - F.atan2(dy, dx) * 400 / (2 * math.pi), 2).cast("decimal(5,2)")


def label_angle(direction: Column) -> Column:
    """Degrees of a text direction in gon for a label, from -90 to 89, so that no text stands on its head; without a direction as one to the right."""
    gon = F.coalesce(direction.cast("decimal(5,2)"), F.lit(200).cast("decimal(5,2)"))
    return F.round(gon * F.lit(0.9).cast("decimal(2,1)") + 450, 0).cast("int") % 180 - 90
