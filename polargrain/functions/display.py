"""Values that clients show: bands, colours, labels, schedules."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

BANDS = ((0, 5), (5, 10), (10, 20), (20, 40), (40, 80))
BAND_NAMES = tuple(f"{a}-{b}m" for a, b in BANDS)


def distance_band(rng: Column) -> Column:
    """Name of the half-open distance band, null beyond the last."""
    out = F.lit(None).cast("string")
    for (a, b), name in zip(BANDS, BAND_NAMES, strict=True):
        out = F.when((rng >= a) & (rng < b), name).otherwise(out)
    return out


def display_intensity(rng: Column) -> Column:
    return F.when(rng < 5, 1.0).when(rng < 10, 0.9).when(rng < 25, 0.78).when(rng < 50, 0.62).otherwise(0.48)


def display_shade(rng: Column, occupancy: Column) -> Column:
    return display_intensity(rng) * (0.35 + 0.65 * F.least(F.lit(1.0), 0.4 + occupancy))


def height_ramp(z: Column) -> Column:
    """Position on a three-stop ramp with stops at 0, 2 and 27 metres, from 0 to 2."""
    low = F.least(F.greatest(z / 2.0, F.lit(0.0)), F.lit(1.0))
    high = F.least(F.greatest((z - 2.0) / 25.0, F.lit(0.0)), F.lit(1.0))
    return F.when(z < 2, low).otherwise(1.0 + high)


def learning_rate(step: Column, base: float, warmup: int, total: int) -> Column:
    """Linear warm-up, then half a cosine."""
    progress = (step - warmup) / float(max(1, total - warmup))
    return base * F.when(step < warmup, step / float(max(1, warmup))).otherwise(0.5 * (1 + F.cos(math.pi * progress)))


def fps(mean_ms: Column) -> Column:
    return 1000.0 / F.greatest(mean_ms, F.lit(1e-3))


def size_label(kb: Column) -> Column:
    return F.when(kb >= 1024, F.format_string("%.1f MB", kb / 1024)).otherwise(F.format_string("%.0f KB", kb))


def log_bar_width(kb: Column) -> Column:
    logs = F.log10(kb)
    return F.when(kb > 0, F.least(F.lit(100.0), 18 + logs / (logs + 1) * 55)).otherwise(F.lit(0.0))


def clock_label(seconds: Column) -> Column:
    whole = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d", F.floor(whole / 60).cast("long"), whole % 60)


def seek_index(fraction: Column, n: Column) -> Column:
    return F.least(F.greatest(F.round(fraction * (n - 1)), F.lit(0)), n - 1).cast("long")
