"""Grid geometry as column expressions that stay inside code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polargrain.plans.config import GridParams


def planar_range(x: Column, y: Column) -> Column:
    return F.hypot(x, y)


def bearing(x: Column, y: Column) -> Column:
    return F.atan2(y, x)


def edge_array(grid: GridParams) -> Column:
    return F.array(*[F.lit(float(e)) for e in grid.edges])


def ring_index(r: Column, grid: GridParams) -> Column:
    """Ring of a planar range: the closed form, corrected by one step against the exact edges."""
    last = grid.edges[-1] - 1e-9
    c = F.least(F.greatest(r.cast("double"), F.lit(grid.r_min)), F.lit(last))
    uniform = F.floor((c - grid.r_min) / grid.dr_0)
    if grid.phase2_rings:
        start = grid.r_min + grid.phase1_rings * grid.dr_0
        grown = grid.phase1_rings + F.floor(F.log(F.lit(1.0) + F.greatest(c - start, F.lit(0.0)) * (grid.alpha - 1) / grid.dr_0) / math.log(grid.alpha))
        guess = F.when(c < start, uniform).otherwise(grown)
    else:
        guess = uniform
    guess = F.least(F.greatest(guess, F.lit(0)), F.lit(grid.n_rings - 1)).cast("int")
    edges = edge_array(grid)
    moved = guess - F.when(F.get(edges, guess) > c, 1).otherwise(0) + F.when(F.get(edges, guess + 1) <= c, 1).otherwise(0)
    return F.least(F.greatest(moved, F.lit(0)), F.lit(grid.n_rings - 1)).cast("int")


def sector_index(theta: Column, grid: GridParams) -> Column:
    step = 2 * math.pi / grid.n_theta
    return F.pmod(F.floor((theta + math.pi) / step), F.lit(grid.n_theta)).cast("int")


def cell_id(ring: Column, sector: Column, grid: GridParams) -> Column:
    return ring.cast("long") * grid.n_theta + sector


def ring_of(cell: Column, grid: GridParams) -> Column:
    return F.floor(cell / grid.n_theta).cast("int")


def sector_of(cell: Column, grid: GridParams) -> Column:
    return F.pmod(cell, F.lit(grid.n_theta)).cast("int")


def in_grid(r: Column, z: Column, grid: GridParams) -> Column:
    return r.between(grid.r_min, grid.r_max) & z.between(grid.z_min, grid.z_max)


def ring_edges(spark: SparkSession, grid: GridParams) -> DataFrame:
    """(ring, r_in, r_out, width): one row a ring, a fixed-size dimension."""
    rows = [(k, float(a), float(b), float(w)) for k, (a, b, w) in enumerate(zip(grid.edges, grid.edges[1:], grid.widths, strict=False))]
    return spark.createDataFrame(rows, "ring int, r_in double, r_out double, width double")


def xy_cells(points: DataFrame, grid: GridParams) -> DataFrame:
    """Adds r, ring, sector, cell and whether (x, y) lies inside the grid."""
    r, theta = planar_range(F.col("x"), F.col("y")), bearing(F.col("x"), F.col("y"))
    located = points.withColumn("r", r).withColumn("ring", ring_index(F.col("r"), grid)).withColumn("sector", sector_index(theta, grid))
    return located.withColumn("cell", cell_id(F.col("ring"), F.col("sector"), grid)).withColumn("valid", F.col("r").between(grid.r_min, grid.r_max))


def cell_extent(cells: DataFrame, grid: GridParams) -> DataFrame:
    """Centre radius, bearing, footprint and display height of cells with ``height``."""
    edges, k = edge_array(grid), F.col("ring")
    dr = F.get(edges, k + 1) - F.get(edges, k)
    mid = (F.get(edges, k) + F.get(edges, k + 1)) / 2
    return cells.withColumn("r_mid", mid).withColumn("bearing", (F.col("sector") + 0.5) * (2 * math.pi / grid.n_theta) - math.pi).withColumn("scale", F.greatest(F.lit(0.05), F.least(dr, F.col("r_mid") * (2 * math.pi / grid.n_theta)))).withColumn("shown_height", F.least(F.greatest(F.col("height"), F.lit(0.35)), F.lit(12.0)))


def hover_info(cells: DataFrame, grid: GridParams) -> DataFrame:
    """Mean radius, heading in degrees and a width label of every cell."""
    edges, k = edge_array(grid), F.col("ring")
    width = F.get(edges, k + 1) - F.get(edges, k)
    degrees = F.pmod(F.col("sector") / F.lit(float(grid.n_theta)) * 360.0 + 180.0, F.lit(360.0))
    label = F.when(width < 1, F.format_string("%.1f cm", width * 100)).otherwise(F.format_string("%.2f m", width))
    return cells.withColumn("r", (F.get(edges, k) + F.get(edges, k + 1)) / 2).withColumn("degrees", degrees).withColumn("width_label", label)
