"""Plane geometry on structs of coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.pow(a["x"] - b["x"], 2) + F.pow(a["y"] - b["y"], 2))


def box_width(a: Column, b: Column) -> Column:
    return F.abs(a["x"] - b["x"])


def box_height(a: Column, b: Column) -> Column:
    return F.abs(a["y"] - b["y"])


def box_area(a: Column, b: Column) -> Column:
    return box_width(a, b) * box_height(a, b)


def circle_area(radius: Column) -> Column:
    return F.pi() * F.pow(radius, 2)


def path_length(points: Column) -> Column:
    """Length of an open path; fewer than two points have none."""
    steps = F.zip_with(F.slice(points, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))), distance)
    return F.aggregate(steps, F.lit(0.0), lambda a, x: a + x)


def segment(a: Column, b: Column) -> Column:
    return F.struct(a.alias("a"), b.alias("b"))


def segment_length(s: Column) -> Column:
    return distance(s["a"], s["b"])


def circle(centre: Column, radius: Column) -> Column:
    return F.struct(centre.alias("centre"), radius.cast("double").alias("radius"))


def circle_radius(c: Column) -> Column:
    return c["radius"]


def count_points(points: Column) -> Column:
    """How many points a path or polygon has."""
    return F.size(points)


def polygon_length(points: Column) -> Column:
    """Length of a closed path."""
    return path_length(F.concat(points, F.slice(points, 1, 1)))
