"""Per-frame aggregation of points onto the log-polar grid."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polargrain.functions import geometry as geo
from polargrain.functions import traversability as trav
from polargrain.functions.labels import COLORS_4
from polargrain.plans.config import GridParams, GroundParams, MemoryParams, TravParams


def with_cells(points: DataFrame, grid: GridParams) -> DataFrame:
    """Kept points with ring, sector and cell; takes r and theta, or x and y."""
    if "r" not in points.columns:
        points = points.withColumn("r", geo.planar_range(F.col("x"), F.col("y"))).withColumn("theta", geo.bearing(F.col("x"), F.col("y")))
    kept = points.filter(geo.in_grid(F.col("r"), F.col("z"), grid))
    sector = F.col("sector") if "sector" in points.columns else geo.sector_index(F.col("theta"), grid)
    located = kept.withColumn("ring", geo.ring_index(F.col("r"), grid)).withColumn("sector", sector.cast("int"))
    return located.withColumn("cell", geo.cell_id(F.col("ring"), F.col("sector"), grid))


def majority(counts: list[Column]) -> Column:
    """Class of the largest count; the lowest class wins ties."""
    top = F.greatest(*counts)
    out = F.lit(len(counts) - 1)
    for k in range(len(counts) - 2, -1, -1):
        out = F.when(counts[k] == top, k).otherwise(out)
    return out.cast("int")


def reduce_cells(located: DataFrame, keys: list[str], grid: GridParams) -> DataFrame:
    """Count, height range and mean, class counts and majority of every cell: one hash aggregate."""
    tallies = [F.count_if(F.col("cls") == k).alias(f"c{k}") for k in range(grid.n_classes)]
    cells = located.groupBy(*keys, "ring", "sector", "cell").agg(F.count(F.lit(1)).alias("n_pts"), F.min("z").alias("z_min"), F.max("z").alias("z_max"), F.avg("z").alias("z_mean"), *tallies)
    counts = [F.col(f"c{k}") for k in range(grid.n_classes)]
    return cells.withColumn("cls_counts", F.array(*counts)).withColumn("cls", majority(counts)).withColumn("occ", F.lit(grid.occupancy_gain)).drop(*[f"c{k}" for k in range(grid.n_classes)])


def cells(points: DataFrame, grid: GridParams, keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    return reduce_cells(with_cells(points, grid), list(keys), grid)


def rendered(cell_rows: DataFrame, grid: GridParams) -> DataFrame:
    return cell_rows.filter(F.col("occ") > grid.occ_threshold)


def ground_reference(points: DataFrame, ground: GroundParams, keys: tuple[str, ...] = ("frame",), within: tuple[str, ...] = ()) -> DataFrame:
    """Ground height of every frame: a percentile of near points, carried over thin frames.

    Frames come from all points, also those outside the grid. The running window has one row
    a frame and is partitioned by ``within`` (the sequence), if given.
    """
    near = (F.col("r") > ground.near[0]) & (F.col("r") < ground.near[1]) & (F.col("z") > ground.z[0]) & (F.col("z") < ground.z[1])
    z = F.when(near, F.col("z"))
    each = points.groupBy(*within, *keys).agg(F.count(z).alias("n_near"), F.percentile(z, F.lit(ground.percentile)).alias("p"))
    own = F.when(F.col("n_near") >= ground.min_points, F.col("p"))
    order = Window.partitionBy(*[F.col(c) for c in within] or [F.lit(0)]).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    return each.select(*within, *keys, "n_near", F.coalesce(F.last(own, True).over(order), F.lit(0.0)).alias("ground_z"))


def with_traversability(cell_rows: DataFrame, ground: DataFrame, grid: GridParams, t: TravParams, keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """Adds ground_z, height, trav and tier; ``ground`` has one row a frame."""
    joined = cell_rows.join(ground.select(*keys, "ground_z"), list(keys))
    height = F.col("z_max") - F.col("ground_z")
    scored = joined.withColumn("height", height).withColumn("trav", trav.grid_traversability(F.col("height"), F.col("cls"), F.col("occ"), t))
    return scored.withColumn("tier", trav.tier(F.col("trav")))


def rebased(cell_rows: DataFrame) -> DataFrame:
    """Client rows: heights above the ground."""
    return cell_rows.withColumn("z_mean", F.col("z_mean") - F.col("ground_z")).withColumn("z_max", F.col("z_max") - F.col("ground_z"))


def neighbor_slope(cell_rows: DataFrame, grid: GridParams, keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """Adds the steepest step of z_mean to the eight neighbours over the cell's size.

    Cells send their height to their neighbours' keys, which meets the cell's own row in one
    aggregation: a single shuffle of nine small rows a cell, and no join. Sectors do not wrap.
    """
    k, n = F.col("ring"), grid.n_theta
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    active = cell_rows.select(*keys, "ring", "sector", "z_mean", (F.col("occ") > 0.05).alias("on"))
    sent = active.withColumn("o", F.explode(offsets)).select(*keys, (k + F.col("o.i")).alias("ring"), (F.col("sector") + F.col("o.j")).alias("sector"), "z_mean", "on", ((F.col("o.i") == 0) & (F.col("o.j") == 0)).alias("own"))
    inside = sent.filter(k.between(0, grid.n_rings - 1) & F.col("sector").between(0, n - 1))
    heights = F.when(~F.col("own") & F.col("on"), F.col("z_mean"))
    met = inside.groupBy(*keys, "ring", "sector").agg(F.max(F.when(F.col("own"), F.col("z_mean"))).alias("z_mean"), F.min(heights).alias("low"), F.max(heights).alias("high"))
    step = F.coalesce(F.greatest(F.abs(F.col("z_mean") - F.col("low")), F.abs(F.col("z_mean") - F.col("high"))), F.lit(0.0))
    width = F.get(F.array(*[F.lit(float(w)) for w in grid.widths]), k)
    size = F.greatest(width, width * (2 * math.pi / n), F.lit(0.05))
    return met.filter(F.col("z_mean").isNotNull()).select(*keys, "ring", "sector", "z_mean", step.alias("max_step"), (step / size).alias("slope"))


def memory_report(cell_rows: DataFrame, grid: GridParams, memory: MemoryParams, keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """Sizes of the grid, of what is rendered, and of an equal uniform grid, for every frame."""
    uniform = (memory.uniform_cell_guess / memory.uniform_cell_size) ** 2
    per, n = grid.bytes_per_cell, grid.n_cells
    capacity = round(uniform / n, 1)
    counted = cell_rows.groupBy(*keys).agg(F.count_if(F.col("occ") > grid.occ_threshold).alias("rendered_cells"))
    r = F.col("rendered_cells")
    fixed = {"n_rings": grid.n_rings, "n_theta": grid.n_theta, "n_cells": n, "grid_bytes": n * per, "uniform_cells": int(uniform), "uniform_mb": round(uniform * per / 1e6, 1), "capacity_compression": capacity, "ring_width_near_m": grid.widths[0], "ring_width_far_m": grid.widths[-1], "grid_kb": round(n * per / 1024.0, 1)}
    ratio = F.when(r > 0, F.round(F.lit(uniform) / r, 1)).otherwise(F.lit(capacity))
    return counted.select(*keys, "rendered_cells", *[F.lit(v).alias(k) for k, v in fixed.items()], (r * per).alias("rendered_bytes"), F.round(r * per / 1024.0, 1).alias("rendered_kb"), ratio.alias("compression_ratio"))


def profile(cell_rows: DataFrame, by: str) -> DataFrame:
    """Cells, points and mean height of every ring or sector, over all frames."""
    return cell_rows.groupBy(by).agg(F.count(F.lit(1)).alias("n_cells"), F.sum("n_pts").alias("n_pts"), F.max("z_max").alias("z_top"), F.avg("z_mean").alias("z_avg"))


def grid_meta(spark: SparkSession, grid: GridParams) -> DataFrame:
    """One row that describes the grid and the class colours to clients."""
    row = (grid.r_min, grid.r_max, grid.r_transition, grid.alpha, grid.dr_0, grid.n_rings, grid.phase1_rings, grid.n_theta, grid.n_classes, {str(k): c for k, c in enumerate(COLORS_4)})
    return spark.createDataFrame([row], "r_min double, r_max double, r_transition double, alpha double, dr_0 double, n_rings int, phase1_rings int, n_theta int, n_classes int, class_colors map<string,string>")


def finite(points: DataFrame) -> DataFrame:
    """Points without null, NaN or infinite coordinates."""
    good = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf")) for c in "xyz"]
    return points.filter(good[0] & good[1] & good[2])


def display_changes(before: DataFrame, after: DataFrame, keys: tuple[str, ...] = ("cell",), shown: tuple[str, ...] = ("z_mean", "z_max", "occ", "trav", "cls")) -> DataFrame:
    """Cells of ``after`` that are new or show anything else than in ``before``."""
    old = before.select(*keys, F.struct(*shown).alias("old"))
    joined = after.join(old, list(keys), "left")
    return joined.filter(~F.struct(*shown).eqNullSafe(F.col("old"))).drop("old")
