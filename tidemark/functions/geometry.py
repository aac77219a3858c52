"""Planar geometry on columns: positions in centimetres, distances in metres, angles in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CM = 100.0


def clip(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def distance_m(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)) / CM


def progress(t: Column, start: Column, finish: Column) -> Column:
    """Share of a circle's move that is over at t, 0 to 1; an instant move is over at its start."""
    return F.when(finish > start, clip((t - start) / F.nullif(finish - start, F.lit(0.0)), 0.0, 1.0)).otherwise(
        (t >= start).cast("double")
    )


def moving(now: Column, then: Column, share: Column) -> Column:
    return now + (then - now) * share


def storm_margin(x: Column, y: Column, t: Column, phase: dict[str, Column]) -> Column:
    """Metres from the moving edge, positive inside; ``phase`` has cur_x, cur_y, cur_r, next_x, next_y, next_r, start, finish."""
    f = progress(t, phase["start"], phase["finish"])
    cx, cy, r = (moving(phase[f"cur_{k}"], phase[f"next_{k}"], f) for k in "xyr")
    return r / CM - distance_m(x, y, cx, cy)


def bearing(dx: Column, dy: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(360.0))


def turn(a: Column, b: Column) -> Column:
    """From bearing a to b, 0 to 360."""
    return F.pmod(b - a, F.lit(360.0))


def rotated(dx: Column, dy: Column, by: Column) -> tuple[Column, Column]:
    """A vector in a frame whose first axis has the bearing ``by``."""
    c, s = F.cos(F.radians(by)), F.sin(F.radians(by))
    return dx * c + dy * s, dy * c - dx * s


def off_line_m(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from the line through a and b."""
    length = F.nullif(F.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay)), F.lit(0.0))
    return F.abs((bx - ax) * (ay - py) - (ax - px) * (by - ay)) / length / CM


def off_segment_m(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    square = F.nullif((bx - ax) * (bx - ax) + (by - ay) * (by - ay), F.lit(0.0))
    k = clip(F.coalesce(((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / square, F.lit(0.0)), 0.0, 1.0)
    return distance_m(px, py, ax + (bx - ax) * k, ay + (by - ay) * k)


def cosine(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return (ax * bx + ay * by) / F.nullif(F.sqrt(ax * ax + ay * ay) * F.sqrt(bx * bx + by * by), F.lit(0.0))


def relation(cos: Column) -> Column:
    return F.when(cos >= 0.5, "toward").when(cos <= -0.5, "away").when(cos.isNotNull(), "sideways")


def way_in(x: Column, y: Column, cx: Column, cy: Column, r: Column) -> tuple[Column, Column]:
    """The point of a circle's edge nearest to a point outside; a point inside stays."""
    d = F.sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy))
    k = F.when(d > r, r / F.nullif(d, F.lit(0.0))).otherwise(F.lit(1.0))
    return cx + (x - cx) * k, cy + (y - cy) * k


def overlap_share(d: Column, big: Column, small: Column) -> Column:
    """Lens area of two circles over the smaller one's area, three decimals: 1 inside, 0 apart."""
    arc = lambda a, b: F.acos(clip((d * d + a * a - b * b) / F.nullif(2 * d * a, F.lit(0.0)), -1.0, 1.0))
    kite = F.sqrt(F.greatest((-d + big + small) * (d + big - small) * (d - big + small) * (d + big + small), F.lit(0.0)))
    lens = small * small * arc(small, big) + big * big * arc(big, small) - kite / 2
    least = F.least(big, small)
    return F.round(
        F.when(d >= big + small, 0.0)
        .when(d <= F.abs(big - small), 1.0)
        .otherwise(lens / F.nullif(F.lit(3.141592653589793) * least * least, F.lit(0.0))),
        3,
    )
