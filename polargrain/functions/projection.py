"""Spherical projection and point transforms as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polargrain.plans.config import ProjectionParams


def range_3d(x: Column, y: Column, z: Column) -> Column:
    return F.greatest(F.sqrt(x * x + y * y + z * z), F.lit(1e-6))


def pixel_row(z: Column, rng: Column, p: ProjectionParams) -> Column:
    top, bottom = math.radians(p.fov_top_deg), math.radians(p.fov_bottom_deg)
    row = F.floor((F.lit(1.0) - (F.asin(z / rng) - bottom) / (top - bottom)) * (p.h - 1))
    return F.least(F.greatest(row, F.lit(0)), F.lit(p.h - 1)).cast("int")


def pixel_col(x: Column, y: Column, p: ProjectionParams) -> Column:
    col = F.floor((F.atan2(y, x) / math.pi + 1.0) * 0.5 * p.w)
    return F.least(F.greatest(col, F.lit(0)), F.lit(p.w - 1)).cast("int")


def project(points: DataFrame, p: ProjectionParams) -> DataFrame:
    """Adds rng, row and col to points with x, y, z."""
    x, y, z = (F.col(c).cast("double") for c in "xyz")
    return points.withColumn("rng", range_3d(x, y, z)).withColumn("row", pixel_row(z, F.col("rng"), p)).withColumn("col", pixel_col(x, y, p))


def channels(p: ProjectionParams) -> list[Column]:
    """Five image channels: range and coordinates over the largest range, and remission."""
    scaled = [(F.col(c) / p.max_range).alias(f"ch{k}") for k, c in enumerate(("rng", "x", "y", "z"))]
    return [*scaled, F.col("remission").alias("ch4")]


def recovered_range(ch0: Column, p: ProjectionParams) -> Column:
    return ch0 * p.max_range


def softmax(logits: Column) -> Column:
    """Softmax of an array, shifted by its largest value."""
    top = F.array_max(logits)
    powers = F.transform(logits, lambda v: F.exp(v - top))
    total = F.aggregate(powers, F.lit(0.0), lambda a, v: a + v)
    return F.transform(powers, lambda v: v / total)


def argmax(values: Column) -> Column:
    """Zero-based position of the first largest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def to_world(pose: str = "pose") -> list[Column]:
    """World coordinates of x, y, z under a row-major 4 x 4 pose array."""
    m = F.col(pose)
    return [(F.col("x") * m[4 * k] + F.col("y") * m[4 * k + 1] + F.col("z") * m[4 * k + 2] + m[4 * k + 3]).alias(n) for k, n in enumerate(("wx", "wy", "wz"))]


def to_ego(pose: str = "pose") -> list[Column]:
    """Coordinates of wx, wy, wz in the frame of a pose: the transposed rotation of the offset."""
    m = F.col(pose)
    d = [F.col(n) - m[4 * k + 3] for k, n in enumerate(("wx", "wy", "wz"))]
    return [(d[0] * m[k] + d[1] * m[4 + k] + d[2] * m[8 + k]).alias(n) for k, n in enumerate(("ex", "ey", "ez"))]


def yaw_centidegrees(r00: Column, r20: Column) -> Column:
    """Heading of the forward axis on the ground plane, rounded half to even."""
    return F.rint(F.degrees(F.atan2(r00, -r20)) * 100).cast("long")


def cloud_rounded(value: Column) -> Column:
    return F.bround(value, 2)


def swapped_axes() -> list[Column]:
    """Display axes: x, height, depth."""
    return [F.col("x").alias("dx"), F.col("z").alias("dy"), F.col("y").alias("dz")]
