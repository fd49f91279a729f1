"""Traversability scores and tiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from polargrain.plans.config import TravParams


def clip(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def class_score(cls: Column, t: TravParams) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(float(s)) for s in t.class_scores]), cls.cast("int")), F.lit(0.0))


def _weighted(scores: list[Column], t: TravParams) -> Column:
    total = sum(t.weights)
    return sum((w * s for w, s in zip(t.weights, scores, strict=True)), F.lit(0.0)) / total


def grid_traversability(height: Column, cls: Column, occupancy: Column, t: TravParams) -> Column:
    """Score of a cell from its height above the ground; zero when switched off."""
    if not t.enabled:
        return F.lit(0.0)
    up = F.greatest(height, F.lit(0.0))
    steep = F.greatest(height - 0.15, F.lit(0.0))
    return _weighted([clip(1.0 - up / (t.z_diff_thresh * 2.5)), clip(1.0 - steep / t.slope_thresh), class_score(cls, t), clip(occupancy)], t)


def cell_traversability(z_max: Column, z_mean: Column, slope: Column, cls: Column, occupancy: Column, t: TravParams) -> Column:
    """Stand-alone score from the spread inside a cell and the slope to its neighbours."""
    spread = F.greatest(z_max - z_mean, F.lit(0.0))
    return _weighted([clip(1.0 - spread / (t.z_diff_thresh * 3)), clip(1.0 - slope / t.slope_thresh), class_score(cls, t), clip(occupancy)], t)


def tier(trav: Column) -> Column:
    return F.when(trav >= 0.7, 0).when(trav >= 0.4, 1).otherwise(2).cast("int")
