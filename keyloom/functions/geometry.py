"""Corners of quadrilaterals and the perspective that maps an upright rectangle onto one, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clipped(points: Column, width: Column, height: Column) -> Column:
    """Points (x, y) moved into an image of this size."""
    into = lambda v, most: F.least(F.greatest(v.cast("double"), F.lit(0.0)), most.cast("double") - 1)
    return F.transform(points, lambda p: F.struct(into(p["x"], width).alias("x"), into(p["y"], height).alias("y")))


def _first_of(points: Column, key) -> Column:
    """The point of least key; of several the one that stands first."""
    keyed = F.transform(points, lambda p, i: F.struct(key(p).alias("key"), i.alias("at"), p.alias("p")))
    return F.array_min(keyed)["p"]


def ordered_corners(points: Column) -> Column:
    """array(top left, top right, bottom right, bottom left) of four points (x, y).

    The first has the least x + y and the third the largest, the second the least y - x and the fourth the largest; ties go to the
    point that stands first, so one point can be two corners. Null for another number of points.
    """
    xy = lambda sign: lambda p: sign * (p["x"] + p["y"])
    diff = lambda sign: lambda p: sign * (p["y"] - p["x"])
    corners = F.array(*(_first_of(points, key) for key in (xy(1.0), diff(1.0), xy(-1.0), diff(-1.0))))
    return F.when(F.size(points) == 4, corners)


def crop_size(corners: Column) -> Column:
    """(width, height) in whole pixels of the rectangle that ordered corners are straightened to: the longer of opposite sides."""
    side = lambda i, j: F.sqrt(F.pow(corners[i]["x"] - corners[j]["x"], 2) + F.pow(corners[i]["y"] - corners[j]["y"], 2)).cast("int")
    return F.struct(F.greatest(side(2, 3), side(1, 0)).alias("width"), F.greatest(side(1, 2), side(0, 3)).alias("height"))


def perspective(corners: Column, width: Column, height: Column) -> Column:
    """Coefficients a to h of the map from pixel (u, v) of the straightened rectangle to the image.

    x = (a u + b v + c) / (g u + h v + 1) and y = (d u + e v + f) / (g u + h v + 1) take the pixels (0, 0),
    (width - 1, 0), (width - 1, height - 1) and (0, height - 1) to the four corners in their order. The system of eight linear
    equations has this solution in closed form. Null where three corners lie on a line or a side has less than two pixels.
    """
    x, y = ([corners[i][c].cast("double") for i in range(4)] for c in ("x", "y"))
    dx1, dx2, sx = x[1] - x[2], x[3] - x[2], x[0] - x[1] + x[2] - x[3]
    dy1, dy2, sy = y[1] - y[2], y[3] - y[2], y[0] - y[1] + y[2] - y[3]
    den = dx1 * dy2 - dx2 * dy1
    w, t = (width - 1).cast("double"), (height - 1).cast("double")
    ok = (den != 0) & (w > 0) & (t > 0)
    safe = lambda v: F.when(ok, v)
    g, h = safe(sx * dy2 - dx2 * sy) / safe(den), safe(dx1 * sy - sx * dy1) / safe(den)
    unit = {
        "a": (x[1] - x[0] + g * x[1]) / safe(w), "b": (x[3] - x[0] + h * x[3]) / safe(t), "c": x[0],
        "d": (y[1] - y[0] + g * y[1]) / safe(w), "e": (y[3] - y[0] + h * y[3]) / safe(t), "f": y[0],
        "g": g / safe(w), "h": h / safe(t),
    }
    return F.when(ok, F.struct(*(v.alias(k) for k, v in unit.items())))
