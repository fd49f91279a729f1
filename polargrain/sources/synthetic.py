"""Repeatable synthetic scans from hashes of the point number."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(seed: int, *keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def scans(spark: SparkSession, frames: int, points: int, seed: int = 0, ego_step: float = 0.8) -> DataFrame:
    """seq_id, frame, pid, x, y, z, remission and cls of a rippled ground seen from a moving sensor."""
    base = spark.range(frames * points).select((F.col("id") / points).cast("int").alias("frame"), F.pmod("id", F.lit(points)).cast("int").alias("pid"))
    r = F.sqrt(0.25 + uniform(seed, "frame", "pid") * (95.0**2 - 0.25))
    az = uniform(seed + 1, "frame", "pid") * (2 * math.pi)
    el = -0.4 + uniform(seed + 2, "frame", "pid") * 0.52
    cls = F.floor(uniform(seed + 3, "frame", "pid") * 4).cast("int")
    polar = base.select("frame", "pid", r.alias("r"), az.alias("az"), el.alias("el"), cls.alias("cls"))
    z = 0.25 + 0.15 * F.sin(0.3 * F.col("r")) + F.col("el") * F.col("r")
    return polar.select(F.lit("synthetic").alias("seq_id"), "frame", "pid", (F.col("r") * F.cos("az") + ego_step * F.col("frame")).alias("x"), (F.col("r") * F.sin("az")).alias("y"), z.alias("z"), uniform(seed + 4, "frame", "pid").alias("remission"), "cls")
