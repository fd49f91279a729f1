"""Queries on the grid, its deltas and its clouds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polargrain.functions import display, geometry, traversability
from polargrain.operators import cloud, delta, grid
from polargrain.plans import sql
from polargrain.plans.config import GridParams, GroundParams, MemoryParams, StreamParams, TravParams
from polargrain.sources import testviews as views

GRID, TRAV, GROUND, MEMORY, STREAM = GridParams(), TravParams(), GroundParams(), MemoryParams(), StreamParams()
R = 6


def r6(name: str, value=None):
    return F.round(F.col(name) if value is None else value, R).alias(name)


def d6(name: str, value=None):
    """Six places by way of decimals, which round ties alike everywhere."""
    return F.round((F.col(name) if value is None else value).cast("decimal(28,9)"), R).cast("double").alias(name)


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return grid.cells(views.points(spark, d), GRID)


def _ground(spark: SparkSession, d: str) -> DataFrame:
    return grid.ground_reference(views.points(spark, d), GROUND)


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return grid.with_traversability(_cells(spark, d), _ground(spark, d), GRID, TRAV)


def grid_cells(spark: SparkSession, d: str) -> DataFrame:
    counts = [F.get("cls_counts", F.lit(k)).alias(f"c{k}") for k in range(4)]
    return _cells(spark, d).select("frame", "ring", "sector", "cell", "n_pts", r6("z_min"), r6("z_max"), r6("z_mean"), *counts, "cls", "occ")


def grid_majority_class(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d).groupBy("frame", "cls").agg(F.count(F.lit(1)).alias("n_cells"), F.sum("n_pts").alias("n_pts"))


def grid_ground_reference(spark: SparkSession, d: str) -> DataFrame:
    return _ground(spark, d).select("frame", "n_near", r6("ground_z"))


def grid_traversability(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("frame", "cell", r6("height"), r6("trav"), "tier")


def grid_tier_counts(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).groupBy("frame", "tier").agg(F.count(F.lit(1)).alias("n_cells"))


def grid_client_rows(spark: SparkSession, d: str) -> DataFrame:
    return grid.rebased(_scored(spark, d)).select("frame", "ring", "sector", r6("z_mean"), r6("z_max"), "occ", r6("trav"), "cls")


def grid_neighbor_slope(spark: SparkSession, d: str) -> DataFrame:
    coarse = _cells(spark, d).withColumn("sector", F.floor(F.col("sector") / 20).cast("int")).withColumn("ring", F.floor(F.col("ring") / 40).cast("int"))
    # sums of decimals do not depend on the order of rows
    height = F.sum(F.col("z_mean").cast("decimal(18,9)")).cast("double") / F.count(F.lit(1))
    merged = coarse.groupBy("frame", "ring", "sector").agg(height.alias("z_mean"), F.lit(1.0).alias("occ"))
    return grid.neighbor_slope(merged, GRID).select("frame", "ring", "sector", d6("max_step"), d6("slope"))


def grid_cell_traversability(spark: SparkSession, d: str) -> DataFrame:
    rows = _cells(spark, d)
    slope = grid.neighbor_slope(rows, GRID).select("frame", "ring", "sector", "slope")
    scored = rows.join(slope, ["frame", "ring", "sector"])
    return scored.select("frame", "cell", r6("trav", traversability.cell_traversability(F.col("z_max"), F.col("z_mean"), F.col("slope"), F.col("cls"), F.col("occ"), TRAV)))


def grid_memory_report(spark: SparkSession, d: str) -> DataFrame:
    return grid.memory_report(_cells(spark, d), GRID, MEMORY).select("frame", "rendered_cells", "n_cells", "grid_bytes", "uniform_cells", "uniform_mb", "capacity_compression", "rendered_bytes", "rendered_kb", "compression_ratio")


def ring_occupancy_profile(spark: SparkSession, d: str) -> DataFrame:
    return grid.profile(_cells(spark, d), "ring").select("ring", "n_cells", "n_pts", r6("z_top"), r6("z_avg"))


def sector_profile(spark: SparkSession, d: str) -> DataFrame:
    return grid.profile(_cells(spark, d), "sector").select("sector", "n_cells", "n_pts", r6("z_top"), r6("z_avg"))


def ring_geometry(spark: SparkSession, d: str) -> DataFrame:
    return geometry.ring_edges(spark, GRID).select("ring", r6("r_in"), r6("r_out"), r6("width"))


def xy_cell_lookup(spark: SparkSession, d: str) -> DataFrame:
    return geometry.xy_cells(views.xyz(spark, d), GRID).select("frame", "pid", r6("r"), "ring", F.col("sector").alias("sector"), "cell", "valid")


def cell_hover(spark: SparkSession, d: str) -> DataFrame:
    rows = _cells(spark, d).select("ring", "sector").distinct()
    return geometry.hover_info(rows, GRID).select("ring", "sector", r6("r"), r6("degrees"))


def cell_display(spark: SparkSession, d: str) -> DataFrame:
    rows = geometry.cell_extent(_scored(spark, d).select("frame", "ring", "sector", "height", "occ"), GRID)
    return rows.select("frame", "ring", "sector", r6("r_mid"), r6("bearing"), r6("scale"), r6("shown_height"), r6("shade", display.display_shade(F.col("r_mid"), F.col("occ"))), r6("ramp", display.height_ramp(F.col("height"))))


def _frames(spark: SparkSession) -> DataFrame:
    return spark.range(1, 25).select(F.lit("00").alias("seq_id"), F.col("id").cast("int").alias("frame"), (~F.col("id").isin(*views.DROPPED)).alias("delivered"))


def _sequence_cells(spark: SparkSession, d: str) -> DataFrame:
    p = views.sequence_points(spark, d).withColumn("cell", geometry.cell_id(F.col("ring"), F.col("sector"), GRID))
    return grid.reduce_cells(p, ["seq_id", "frame"], GRID).select("seq_id", "frame", "cell", "z_max", "cls")


def _schedule(spark: SparkSession) -> DataFrame:
    return delta.delivery_schedule(_frames(spark), STREAM)


def _events(spark: SparkSession, d: str) -> DataFrame:
    return delta.events(_sequence_cells(spark, d), _schedule(spark), STREAM)


def delivery_schedule(spark: SparkSession, d: str) -> DataFrame:
    return _schedule(spark).select("seq_id", "frame", "kind", "delivered", "drops", "ordinal")


def grid_delta_events(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).filter("op <> 'snapshot'").select("seq_id", "cell", "frame", "op", r6("z_max"), "cls")


def grid_snapshot_rows(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).filter("op = 'snapshot'").select("seq_id", "cell", "frame", r6("z_max"), "cls")


def grid_event_counts(spark: SparkSession, d: str) -> DataFrame:
    return delta.event_counts(_events(spark, d))


def delta_size_stats(spark: SparkSession, d: str) -> DataFrame:
    sizes = _events(spark, d).filter("op <> 'snapshot'").groupBy("seq_id", "frame").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("seq_id").agg(r6("mean_rows", F.avg("n")), F.max("n").alias("max_rows"))


def client_materialize(spark: SparkSession, d: str) -> DataFrame:
    return delta.materialize(_events(spark, d), _schedule(spark)).select("seq_id", "cell", r6("z_max"), "cls", "sent_frame")


def _epoch_rows(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(F.col("event_type").alias("seq_id"), F.pmod("user_id", F.lit(7)).alias("epoch"), F.pmod("event_id", F.lit(97)).cast("int").alias("frame"), F.col("event_id").alias("arrival"))


def epoch_guard(spark: SparkSession, d: str) -> DataFrame:
    return delta.current_epoch_only(_epoch_rows(spark, d)).select("seq_id", "epoch", "frame", "arrival")


def stale_frames(spark: SparkSession, d: str) -> DataFrame:
    return delta.fresh_only(_epoch_rows(spark, d)).select("seq_id", "frame", "arrival")


def frame_gaps(spark: SparkSession, d: str) -> DataFrame:
    frames = _epoch_rows(spark, d).select("seq_id", "epoch", "frame").distinct()
    return delta.frame_gaps(frames, "seq_id", "epoch").select("seq_id", "epoch", "frame", "missing")


def _world_points(spark: SparkSession, d: str) -> DataFrame:
    p = views.xyz(spark, d).groupBy("frame", "pid").agg(F.min(F.struct("k1", "k2", "x", "y", "z", "cls")).alias("v")).select("frame", "pid", "v.x", "v.y", "v.z", "v.cls")
    return views.with_sequence(p)


def _world(spark: SparkSession, d: str) -> DataFrame:
    return cloud.world_points(_world_points(spark, d).withColumn("seq_id", F.lit("00")), views.poses(spark))


def world_transform(spark: SparkSession, d: str) -> DataFrame:
    return _world(spark, d).select("frame", "pid", r6("wx", F.round("wx", 4)), r6("wy", F.round("wy", 4)), r6("wz", F.round("wz", 4)))


def cloud_accumulate(spark: SparkSession, d: str) -> DataFrame:
    got = cloud.accumulate(_world(spark, d), views.poses(spark), STREAM)
    return got.groupBy("at", "frame").agg(F.count(F.lit(1)).alias("n"), F.min("pid").alias("first_pid"), F.max("pid").alias("last_pid"), F.round(F.sum("ez"), 3).alias("sum_z"))


def _two_clouds(spark: SparkSession, d: str) -> DataFrame:
    poses = views.sequence_poses(spark)
    return cloud.accumulate(cloud.world_points(_world_points(spark, d), poses), poses, StreamParams(cloud_frames=3, cloud_max=2000))


def cloud_two_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Thinned and cut clouds of two sequences with poses of their own; coordinates are checked by sums of all axes."""
    sums = [F.round(F.sum(F.round(c, 6).cast("decimal(18,6)")).cast("double"), 2).alias(f"sum_{c}") for c in ("ex", "ey", "ez")]
    return _two_clouds(spark, d).groupBy("seq_id", "at", "frame").agg(F.count(F.lit(1)).alias("n"), F.min("pid").alias("first_pid"), F.max("pid").alias("last_pid"), *sums)


def cloud_stride_sample(spark: SparkSession, d: str) -> DataFrame:
    p = views.points(spark, d).select("frame", "pid").distinct()
    return cloud.stride_sample(p, 100).select("frame", "pid", "stride")


def yaw_centidegrees(spark: SparkSession, d: str) -> DataFrame:
    frames = views.points(spark, d).select("frame").distinct()
    return cloud.headings(frames, views.poses(spark)).select("frame", "yaw_cd")


QUERIES = {f.__name__: f for f in (grid_cells, grid_majority_class, grid_ground_reference, grid_traversability, grid_tier_counts, grid_client_rows, grid_neighbor_slope, grid_cell_traversability, grid_memory_report, ring_occupancy_profile, sector_profile, ring_geometry, xy_cell_lookup, cell_hover, cell_display, delivery_schedule, grid_delta_events, grid_snapshot_rows, grid_event_counts, delta_size_stats, client_materialize, epoch_guard, stale_frames, frame_gaps, world_transform, cloud_accumulate, cloud_two_sequences, cloud_stride_sample, yaw_centidegrees)}

_POSES = """po AS (SELECT k AS pose_id, cos(0.1::DOUBLE * k) AS c, sin(0.1::DOUBLE * k) AS s, 1.5::DOUBLE * k AS tx, 0.25::DOUBLE * k AS ty, 0.125::DOUBLE * k AS a20 FROM range(5) t(k))"""
_WORLD = f"""{sql.XYZ}, u AS (SELECT frame, pid, min(struct_pack(k1, k2, x, y, z, cls)) AS v FROM xyz GROUP BY ALL), {_POSES},
w AS (SELECT frame, pid, v.cls AS cls, v.x * c - v.y * s + tx AS wx, v.x * s + v.y * c + ty AS wy, v.x * a20 + v.z AS wz FROM u JOIN po ON po.pose_id = u.frame % 5)"""
_WORLD_SEQ = f"""{sql.XYZ}, u AS (SELECT frame, pid, min(struct_pack(k1, k2, x, y, z, cls)) AS v FROM xyz GROUP BY ALL),
po AS (SELECT '00' AS seq_id, 5 AS n_poses, k AS pose_id, cos(0.1::DOUBLE * k) AS c, sin(0.1::DOUBLE * k) AS s, 1.5::DOUBLE * k AS tx, 0.25::DOUBLE * k AS ty, 0.125::DOUBLE * k AS a20 FROM range(5) t(k)
  UNION ALL SELECT '01', 3, k, cos(-0.2::DOUBLE * k), sin(-0.2::DOUBLE * k), 1.5::DOUBLE * k, 0.25::DOUBLE * k, 0.125::DOUBLE * k FROM range(3) t(k)),
w AS (SELECT po.seq_id, frame, pid, v.cls AS cls, v.x * c - v.y * s + tx AS wx, v.x * s + v.y * c + ty AS wy, v.x * a20 + v.z AS wz FROM u JOIN po ON po.seq_id = '0' || (u.pid % 2)::VARCHAR AND po.pose_id = u.frame % po.n_poses)"""


def _clouds(keys: str, frames: int, most: int) -> str:
    """SQL of the clouds of ``frames`` frames with ``most`` points at most; ``keys`` are frame, or seq_id and frame."""
    seq = "seq_id, " if "seq_id" in keys else ""
    same = "b.seq_id = a.seq_id AND" if seq else ""
    return f"""n AS (SELECT {keys}, count(*) AS n FROM w GROUP BY {keys}), st AS (SELECT {seq.replace('seq_id', 'a.seq_id')} a.frame AS tick, greatest(1, ceil(sum(b.n) / {most}.0))::BIGINT AS stride FROM n a JOIN n b ON {same} b.frame BETWEEN a.frame - {frames - 1} AND a.frame GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY pid) - 1 AS k FROM w),
h AS (SELECT * FROM (SELECT st.tick, a.*, row_number() OVER (PARTITION BY {seq.replace('seq_id', 'a.seq_id')} tick ORDER BY frame, k) AS place FROM k a JOIN st ON {'st.seq_id = a.seq_id AND' if seq else ''} a.frame BETWEEN tick - {frames - 1} AND tick WHERE a.k % stride = 0) WHERE place <= {most})"""


_EPOCH = "ep AS (SELECT event_type AS seq_id, user_id % 7 AS epoch, (event_id % 97)::INT AS frame, event_id AS arrival FROM events)"
_SLOPE = """sl AS (SELECT a.frame, a.ring, a.sector, coalesce(max(abs(a.z_mean - b.z_mean)), 0.0) AS max_step FROM {t} a LEFT JOIN {t} b
  ON b.frame = a.frame AND b.ring BETWEEN a.ring - 1 AND a.ring + 1 AND b.sector BETWEEN a.sector - 1 AND a.sector + 1 AND NOT (b.ring = a.ring AND b.sector = a.sector) GROUP BY ALL)"""
_SPREAD = sql.clip("1 - greatest(z_max - z_mean, 0) / 1.5::DOUBLE")
_STEEP = sql.clip("1 - max_step / greatest(width, width * 2 * pi() / 720, 0.05) / 0.4::DOUBLE")
ORACLE_SQL = {
    "grid_cells": f"WITH {sql.CELLS} SELECT frame, ring, sector, cell, n_pts, round(z_min, 6) AS z_min, round(z_max, 6) AS z_max, round(z_mean, 6) AS z_mean, c0, c1, c2, c3, cls, occ FROM cells",
    "grid_majority_class": f"WITH {sql.CELLS} SELECT frame, cls, count(*) AS n_cells, sum(n_pts)::BIGINT AS n_pts FROM cells GROUP BY frame, cls",
    "grid_ground_reference": f"WITH {sql.POINTS}, {sql.GROUND} SELECT frame, n_near, round(ground_z, 6) AS ground_z FROM g",
    "grid_traversability": f"WITH {sql.CELLS}, {sql.GROUND}, {sql.TRAV} SELECT frame, cell, round(height, 6) AS height, round(trav, 6) AS trav, tier FROM tt",
    "grid_tier_counts": f"WITH {sql.CELLS}, {sql.GROUND}, {sql.TRAV} SELECT frame, tier, count(*) AS n_cells FROM tt GROUP BY frame, tier",
    "grid_client_rows": f"WITH {sql.CELLS}, {sql.GROUND}, {sql.TRAV} SELECT frame, ring, sector, round(z_mean - ground_z, 6) AS z_mean, round(z_max - ground_z, 6) AS z_max, occ, round(trav, 6) AS trav, cls FROM tt",
    "grid_neighbor_slope": f"WITH {sql.CELLS}, m AS (SELECT frame, ring // 40 AS ring, sector // 20 AS sector, sum(z_mean::DECIMAL(18,9))::DOUBLE / count(*) AS z_mean FROM cells GROUP BY ALL), {_SLOPE.format(t='m')} SELECT frame, sl.ring, sector, {sql.d6('max_step')} AS max_step, {sql.d6('max_step / greatest(width, width * 2 * pi() / 720, 0.05)')} AS slope FROM sl JOIN e ON e.ring = sl.ring",
    "grid_cell_traversability": f"WITH {sql.CELLS}, {_SLOPE.format(t='cells')} SELECT frame, cell, round((0.25::DOUBLE * {_SPREAD} + 0.25::DOUBLE * {_STEEP} + 0.35::DOUBLE * {sql.SCORE} + 0.15::DOUBLE * {sql.clip('occ')}) / 1.0::DOUBLE, 6) AS trav FROM cells JOIN sl USING (frame, ring, sector) JOIN e USING (ring)",
    "grid_memory_report": f"WITH {sql.CELLS} SELECT frame, count(*) AS rendered_cells, 469440::INT AS n_cells, 19247040::INT AS grid_bytes, 16000000::INT AS uniform_cells, 656.0::DOUBLE AS uniform_mb, 34.1::DOUBLE AS capacity_compression, count(*) * 41 AS rendered_bytes, round(count(*) * 41 / 1024.0::DOUBLE, 1) AS rendered_kb, round(16000000.0::DOUBLE / count(*), 1) AS compression_ratio FROM cells GROUP BY frame",
    "ring_occupancy_profile": f"WITH {sql.CELLS} SELECT ring, count(*) AS n_cells, sum(n_pts)::BIGINT AS n_pts, round(max(z_max), 6) AS z_top, round(avg(z_mean), 6) AS z_avg FROM cells GROUP BY ring",
    "sector_profile": f"WITH {sql.CELLS} SELECT sector, count(*) AS n_cells, sum(n_pts)::BIGINT AS n_pts, round(max(z_max), 6) AS z_top, round(avg(z_mean), 6) AS z_avg FROM cells GROUP BY sector",
    "ring_geometry": f"WITH {sql.EDGES} SELECT ring, round(r_in, 6) AS r_in, round(r_out, 6) AS r_out, round(width, 6) AS width FROM e",
    "xy_cell_lookup": f"WITH {sql.XYZ}, {sql.EDGES} SELECT frame, pid, round(r, 6) AS r, e.ring, sector, e.ring::BIGINT * 720 + sector AS cell, r BETWEEN 0.5 AND 100 AS valid FROM xyz ASOF JOIN e ON xyz.r >= e.r_in",
    "cell_hover": f"WITH {sql.CELLS} SELECT DISTINCT ring, sector, round((r_in + r_out) / 2, 6) AS r, round((sector / 720.0::DOUBLE * 360 + 180) % 360, 6) AS degrees FROM cells JOIN e USING (ring)",
    "cell_display": f"WITH {sql.CELLS}, {sql.GROUND}, {sql.TRAV}, m AS (SELECT *, (r_in + r_out) / 2 AS r_mid FROM tt JOIN e USING (ring)) SELECT frame, ring, sector, round(r_mid, 6) AS r_mid, round((sector + 0.5::DOUBLE) * (2 * pi() / 720) - pi(), 6) AS bearing, round(greatest(0.05, least(r_out - r_in, r_mid * (2 * pi() / 720))), 6) AS scale, round(least(greatest(height, 0.35), 12.0), 6) AS shown_height, round(CASE WHEN r_mid < 5 THEN 1.0 WHEN r_mid < 10 THEN 0.9 WHEN r_mid < 25 THEN 0.78 WHEN r_mid < 50 THEN 0.62 ELSE 0.48 END::DOUBLE * (0.35::DOUBLE + 0.65::DOUBLE * least(1.0, 0.4 + occ)), 6) AS shade, round(CASE WHEN height < 2 THEN {sql.clip('height / 2')} ELSE 1 + {sql.clip('(height - 2) / 25')} END, 6) AS ramp FROM m",
    "delivery_schedule": f"WITH {sql.SCHEDULE} SELECT seq_id, frame, kind, delivered, drops, ordinal FROM sched",
    "grid_delta_events": f"WITH {sql.EVENTS} SELECT seq_id, cell, frame, op, round(z_max, 6) AS z_max, cls FROM ev WHERE op <> 'snapshot'",
    "grid_snapshot_rows": f"WITH {sql.EVENTS} SELECT seq_id, cell, frame, round(z_max, 6) AS z_max, cls FROM ev WHERE op = 'snapshot'",
    "grid_event_counts": f"WITH {sql.EVENTS} SELECT seq_id, frame, op, count(*) AS n FROM ev GROUP BY ALL",
    "delta_size_stats": f"WITH {sql.EVENTS}, z AS (SELECT seq_id, frame, count(*) AS n FROM ev WHERE op <> 'snapshot' GROUP BY ALL) SELECT seq_id, round(avg(n), 6) AS mean_rows, max(n) AS max_rows FROM z GROUP BY seq_id",
    "client_materialize": f"WITH {sql.EVENTS}, b AS (SELECT max(frame) AS base FROM sched WHERE delivered AND kind = 'snapshot'), l AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY frame DESC) AS rn FROM ev, b WHERE frame >= base) SELECT seq_id, cell, round(z_max, 6) AS z_max, cls, frame AS sent_frame FROM l WHERE rn = 1 AND op <> 'freed'",
    "epoch_guard": f"WITH {_EPOCH} SELECT seq_id, epoch, frame, arrival FROM (SELECT *, max(epoch) OVER (PARTITION BY seq_id) AS top FROM ep) WHERE epoch = top",
    "stale_frames": f"WITH {_EPOCH} SELECT seq_id, frame, arrival FROM (SELECT *, max(frame) OVER (PARTITION BY seq_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM ep) WHERE top IS NULL OR frame > top",
    "frame_gaps": f"WITH {_EPOCH}, f AS (SELECT DISTINCT seq_id, epoch, frame FROM ep) SELECT seq_id, epoch, frame, coalesce(frame - lag(frame) OVER (PARTITION BY seq_id, epoch ORDER BY frame) - 1, 0)::INT AS missing FROM f",
    "world_transform": f"WITH {_WORLD} SELECT frame, pid, round(wx, 4) AS wx, round(wy, 4) AS wy, round(wz, 4) AS wz FROM w",
    "cloud_accumulate": f"""WITH {_WORLD}, {_clouds("frame", 30, 60000)}
SELECT tick AS at, frame, count(*) AS n, min(pid) AS first_pid, max(pid) AS last_pid, round(sum(ez), 3) AS sum_z FROM (SELECT h.*, wz - a20 * 0 AS ez FROM h JOIN po ON po.pose_id = h.tick % 5) GROUP BY tick, frame""",
    "cloud_two_sequences": f"""WITH {_WORLD_SEQ}, {_clouds("seq_id, frame", 3, 2000)},
z AS (SELECT h.*, (wx - tx) * c + (wy - ty) * s + wz * a20 AS ex, -(wx - tx) * s + (wy - ty) * c AS ey, wz AS ez FROM h JOIN po ON po.seq_id = h.seq_id AND po.pose_id = h.tick % po.n_poses)
SELECT seq_id, tick AS at, frame, count(*) AS n, min(pid) AS first_pid, max(pid) AS last_pid, {', '.join(f'round(sum(round({c}, 6)::DECIMAL(18,6))::DOUBLE, 2) AS sum_{c}' for c in ('ex', 'ey', 'ez'))} FROM z GROUP BY seq_id, tick, frame""",
    "cloud_stride_sample": f"WITH {sql.POINTS}, d AS (SELECT DISTINCT frame, pid FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY pid) - 1 AS k, greatest(1, ceil(count(*) OVER (PARTITION BY frame) / 100.0))::BIGINT AS stride FROM d) SELECT frame, pid, stride FROM k WHERE k % stride = 0",
    "yaw_centidegrees": f"WITH {sql.POINTS}, {_POSES}, f AS (SELECT DISTINCT frame FROM p) SELECT frame, round_even(degrees(atan2(c, -a20)) * 100, 0)::BIGINT AS yaw_cd FROM f JOIN po ON po.pose_id = frame % 5",
}
