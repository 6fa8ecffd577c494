"""Column functions on coordinates (GEO-01 to GEO-06, FLT-05 to FLT-07)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

KM_PER_DEGREE = 111.19492664455873


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """GEO-01: great-circle kilometres on a sphere of 12,742 km diameter."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return F.lit(12742.0) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def bearing(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """GEO-02: initial great-circle bearing in degrees from north, 0 to 360."""
    d = F.radians(lng2 - lng1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def difference(a: Column, b: Column) -> Column:
    """GEO-03: the smaller angle between two bearings."""
    return F.abs(F.pmod(a - b + 540, F.lit(360.0)) - 180)


def compass(angle: Column, points: int = 8) -> Column:
    """GEO-03: the index of the compass point, clockwise from north."""
    return F.pmod(F.floor(angle / (360 / points) + 0.5), F.lit(points)).cast("int")


def offset(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> tuple[Column, Column]:
    """GEO-04: kilometres east and north on the plane at the middle latitude."""
    return (lng2 - lng1) * KM_PER_DEGREE * F.cos(F.radians((lat1 + lat2) / 2)), (lat2 - lat1) * KM_PER_DEGREE


def heading(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """GEO-02: the direction on the plane at the middle latitude, in degrees from north, 0 to 360."""
    east, north = offset(lat1, lng1, lat2, lng2)
    return F.pmod(F.degrees(F.atan2(east, north)) + 360, F.lit(360.0))


def destination(lat: Column, lng: Column, km: Column, angle: Column) -> tuple[Column, Column]:
    """GEO-05: the point at a distance and bearing."""
    d, a, p = km / 6371.0, F.radians(angle), F.radians(lat)
    to = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(a))
    east = F.atan2(F.sin(a) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(to))
    return F.degrees(to), F.pmod(lng + F.degrees(east) + 540, F.lit(360.0)) - 180


def segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, Column]:
    """GEO-06: the place along a segment, 0 to 1, and the distance from it."""
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    t = F.when(size == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / size)))
    return t, F.sqrt(F.pow(px - ax - t * dx, 2) + F.pow(py - ay - t * dy, 2))


def unit(*seeds: Column) -> Column:
    """A number from 0 to 1 drawn from the md5 of its seeds: the same in every engine and run."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *seeds)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def grid(size: float) -> tuple[int, float]:
    """Cells around the globe and their size: the nearest to `size` that divides 360 degrees."""
    n = max(1, round(360 / size))
    return n, 360 / n


def direction(lat: Column, lng: Column) -> tuple[Column, Column, Column]:
    """The unit vector of a point; the product of two is the cosine of the angle between them."""
    p, q = F.radians(lat), F.radians(lng)
    return F.cos(p) * F.cos(q), F.cos(p) * F.sin(q), F.sin(p)


def cells(lat: Column, lng: Column, km: Column, size: float, keep=None) -> Column:
    """All grid cells (of about `size` degrees) that a circle can touch, as an array of (cell_y, cell_x).

    The longitude reach is that of the circle's edge nearest to a pole. Cells go around the globe: those across 180
    degrees are neighbours. `keep` of a cell's middle (lat, lng), its size and whether the circle stays away from the poles and from 180
    degrees leaves out cells that are of no use.
    """
    n, size = grid(size)
    dy = km / KM_PER_DEGREE
    edge = F.abs(lat) + dy
    dx = F.when(edge >= 89, 180.0).otherwise(F.least(F.lit(180.0), dy / F.cos(F.radians(edge))))
    ys = F.sequence(F.floor(F.greatest(F.lit(-90.0), lat - dy) / size).cast("int"), F.floor(F.least(F.lit(90.0), lat + dy) / size).cast("int"))
    xs = F.sequence(F.floor((lng - dx) / size).cast("int"), F.floor((lng + dx) / size).cast("int"))
    if keep is None:
        xs = F.array_distinct(F.transform(xs, lambda x: F.pmod(x, F.lit(n))))
        return F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: F.struct(y.alias("cell_y"), x.alias("cell_x")))))
    flat = (edge < 80) & (lng - dx > -180) & (lng + dx < 180)
    use = lambda y: F.filter(xs, lambda x: F.coalesce(keep((y + 0.5) * size, (x + 0.5) * size, size, flat), F.lit(True)))
    return F.flatten(F.transform(ys, lambda y: F.transform(F.array_distinct(F.transform(use(y), lambda x: F.pmod(x, F.lit(n)))), lambda x: F.struct(y.alias("cell_y"), x.alias("cell_x")))))


def half_cell(size: float) -> float:
    """More kilometres than any point of a cell is away from its middle."""
    return 1.02 * size / 2 * math.sqrt(2) * KM_PER_DEGREE


def cell_of(lat: Column, lng: Column, size: float) -> tuple[Column, Column]:
    n, size = grid(size)
    return F.floor(lat / size).cast("int"), F.pmod(F.floor(lng / size).cast("int"), F.lit(n))


assert math.isclose(KM_PER_DEGREE, math.pi * 6371 / 180)
