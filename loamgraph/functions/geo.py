"""Geographic and planar geometry as Column expressions; all of it stays in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The earth's circumference in metres and the speed of light in metres a second.
CIRCUMFERENCE = 40075016.68557849
LIGHT = 299792458.0
RADIUS = CIRCUMFERENCE / (2 * math.pi)


def lit(x: float) -> Column:
    return F.lit(float(x))


def sphere_point(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """The unit vector of a place given in degrees."""
    a, b = F.radians(lat), F.radians(lon)
    return F.cos(b) * F.cos(a), F.sin(b) * F.cos(a), F.sin(a)


def lat_long(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    return F.degrees(F.asin(z)), F.degrees(F.atan2(y, x))


def spherical_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """The angle between two places in radians; 0 for equal coordinates."""
    a, b = sphere_point(lat1, lon1), sphere_point(lat2, lon2)
    dot = a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    return F.when((lat1 == lat2) & (lon1 == lon2), lit(0)).otherwise(F.acos(F.greatest(lit(-1), F.least(lit(1), dot))))


def gcl_ms(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """The least round trip in milliseconds along the great circle at two thirds of the speed of light."""
    return lit(2000) * spherical_distance(lat1, lon1, lat2, lon2) * lit(RADIUS) / lit(2 * LIGHT / 3)


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return lon / lit(360), F.ln(F.tan(lit(math.pi / 4) + lat * lit(math.pi / 360))) / lit(2 * math.pi)


def inverse_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    """(longitude, latitude) in degrees."""
    return x * lit(360), F.atan(F.exp(y * lit(2 * math.pi))) * lit(360 / math.pi) - lit(90)


def to_support(x: Column, low: Column, high: Column, side: Column, factor: float = 1.0, scale: float = 1.0) -> Column:
    """A coordinate centred on its bounding box and divided by the larger side (0 counts as 1)."""
    divisor = F.when(side == 0, lit(1)).otherwise(side)
    return lit(scale) * (lit(factor) * (x - (low + high) / lit(2)) / divisor + lit(0.5))


def segment_distance(ux: Column, uy: Column, vx: Column, vy: Column, rx: Column, ry: Column) -> Column:
    """The distance of r to the segment from u to v."""
    ax, ay, bx, by, cx, cy = rx - ux, ry - uy, rx - vx, ry - vy, ux - vx, uy - vy
    aa, bb, cc = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
    ac, bc = ax * cx + ay * cy, bx * cx + by * cy
    beside = (ac <= 0) & (bc >= 0)
    return (
        F.when(beside & (cc == 0), F.sqrt(aa))
        .when(beside, F.sqrt(F.greatest(lit(0), bb - bc * bc / cc)))
        .otherwise(F.sqrt(F.least(aa, bb)))
    )


def _cross(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * by - ay * bx


def in_triangle(ax, ay, bx, by, cx, cy, px, py) -> Column:
    """Whether p lies in the triangle, its border included."""
    s = [_cross(bx - ax, by - ay, px - ax, py - ay), _cross(cx - bx, cy - by, px - bx, py - by), _cross(ax - cx, ay - cy, px - cx, py - cy)]
    return ((s[0] >= 0) & (s[1] >= 0) & (s[2] >= 0)) | ((s[0] <= 0) & (s[1] <= 0) & (s[2] <= 0))


def project_to_segment(px, py, lx, ly, rx, ry) -> tuple[Column, Column]:
    """The nearest point of a segment to p; of equally near ends, the left one."""
    dx, dy = rx - lx, ry - ly
    t = ((px - lx) * dx + (py - ly) * dy) / (dx * dx + dy * dy)
    nearer = (px - lx) * (px - lx) + (py - ly) * (py - ly) <= (px - rx) * (px - rx) + (py - ry) * (py - ry)
    inside = (t >= 0) & (t <= 1)
    pick = lambda a, d, b: F.when(inside, a + t * d).when(nearer, a).otherwise(b)
    return pick(lx, dx, rx), pick(ly, dy, ry)


def crossing(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Where on a-b the open segments a-b and c-d cross, as a share; null if they share an end, are parallel or miss."""
    m1x, m1y, m2x, m2y, ex, ey = bx - ax, by - ay, dx - cx, dy - cy, cx - ax, cy - ay
    det = m1y * m2x - m1x * m2y
    one, two = (ey * m2x - ex * m2y) / det, (ey * m1x - ex * m1y) / det
    same = lambda px, py, qx, qy: (px == qx) & (py == qy)
    shared = same(ax, ay, cx, cy) | same(ax, ay, dx, dy) | same(bx, by, cx, cy) | same(bx, by, dx, dy)
    return F.when(~shared & (det != 0), F.when((one > 0) & (one < 1) & (two > 0) & (two < 1), one))


def right_of_turn(ux, uy, vx, vy, wx, wy) -> Column:
    """Whether w is more clockwise than v, seen from the end of u; ties favour v."""
    nu, nv, nw = F.sqrt(ux * ux + uy * uy), F.sqrt(vx * vx + vy * vy), F.sqrt(wx * wx + wy * wy)
    bx, by = -ux / nu, -uy / nu
    v1, v2 = (vx * bx + vy * by) / nv, (vy * bx - vx * by) / nv
    w1, w2 = (wx * bx + wy * by) / nw, (wy * bx - wx * by) / nw
    turn = ((w2 >= 0) & ((v2 < 0) | (w1 > v1))) | ((w2 < 0) & (v2 < 0) & (w1 < v1))
    return F.when((ux == -wx) & (uy == -wy), F.lit(False)).otherwise(turn)


def border_decay(z: Column, distance: Column, floor: float = -0.05) -> Column:
    """Heights fall to `floor` with the squared distance from the network."""
    return (z - lit(floor)) * F.exp(lit(-1000) * distance * distance) + lit(floor)


def bounded_height(parameter: Column, extent: float) -> Column:
    return lit(extent) / (lit(1) + F.exp(-parameter))


def bounded_height_slope(parameter: Column, extent: float) -> Column:
    e = F.exp(-parameter)
    return lit(extent) * e / ((lit(1) + e) * (lit(1) + e))


def arc_height(start: Column, centre: Column, end: Column, share: Column) -> Column:
    """The parabola through (0, start), (1/2, centre), (1, end)."""
    half = share - lit(0.5)
    return lit(2) * (start + end - lit(2) * centre) * half * half + (end - start) * half + centre


def bilinear(z00: Column, z01: Column, z10: Column, z11: Column, a: Column, b: Column) -> Column:
    low = z00 + b * (z01 - z00)
    return low + a * (z10 + b * (z11 - z10) - low)


def ramp_index(curvature: Column, steps: int = 256) -> Column:
    """A place on a diverging colour ramp for a curvature of -1..1."""
    share = F.greatest(lit(0), F.least(lit(1), (curvature + lit(1)) / lit(2)))
    return F.floor(lit(steps) * share + lit(0.5)).cast("int")


def goodness(uv: Column, uw: Column, vw: Column) -> Column:
    """The longest side of a triangle over the two others' sum; above 1 the triangle inequality fails."""
    top = F.greatest(uv, uw, vw)
    return top.cast("double") / (uv + uw + vw - top).cast("double")


def longest_side(uv: Column, uw: Column, vw: Column) -> Column:
    """'uv' or 'uw' if strictly longest, else 'vw'."""
    return F.when(uv > uw, F.when(uv > vw, "uv").otherwise("vw")).otherwise(F.when(uw > vw, "uw").otherwise("vw"))
