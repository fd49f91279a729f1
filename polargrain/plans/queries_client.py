"""Queries on augmentation, client state, display values and job statistics."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polargrain.functions import display, geometry
from polargrain.functions import projection as proj
from polargrain.operators import delta, grid, images, metrics
from polargrain.plans import queries_eval, queries_grid, queries_image, sql
from polargrain.plans.config import ProjectionParams
from polargrain.plans.queries_grid import GRID, d6, r6
from polargrain.sources import testviews as views

P = ProjectionParams()


def cell_of_id(spark: SparkSession, d: str) -> DataFrame:
    ids = queries_grid._cells(spark, d).select("cell").distinct()
    return ids.select("cell", geometry.ring_of(F.col("cell"), GRID).alias("ring"), geometry.sector_of(F.col("cell"), GRID).alias("sector"))


def _pixels(spark: SparkSession, d: str) -> DataFrame:
    return images.range_image(views.xyz(spark, d), P, order=queries_image.ORDER)


def range_recovery(spark: SparkSession, d: str) -> DataFrame:
    return _pixels(spark, d).select("frame", "row", "col", r6("rng", proj.recovered_range(F.col("ch0"), P)))


def augment_jitter(spark: SparkSession, d: str) -> DataFrame:
    return images.jittered(_pixels(spark, d), seed=10, probability=0.6).select("frame", "row", "col", r6("ch4"))


def augment_cutout(spark: SparkSession, d: str) -> DataFrame:
    cut = images.cut_out(_pixels(spark, d), P, seed=20, probability=0.8)
    return cut.select("frame", "row", "col", r6("ch0"), r6("ch4"))


def augment_batch(spark: SparkSession, d: str) -> DataFrame:
    """Flip, jitter and cutout with their production shares."""
    return images.augmented(_pixels(spark, d), P, seed=3).select("frame", "row", "col", r6("ch1"), r6("ch4"))


def display_labels(spark: SparkSession, d: str) -> DataFrame:
    kb = F.col("p_size") * (F.col("p_partkey") + 1) / 8.0
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", kb.alias("kb"))
    return p.select("p_partkey", display.size_label(F.col("kb")).alias("size"), r6("width", display.log_bar_width(F.col("kb"))), display.clock_label(F.col("kb")).alias("clock"))


def swapped_axes(spark: SparkSession, d: str) -> DataFrame:
    return views.xyz(spark, d).select("frame", "pid", F.col("k1").alias("part"), F.col("k2").alias("supp"), *proj.swapped_axes()).select("frame", "pid", "part", "supp", r6("dx"), r6("dy"), r6("dz"))


def seek_index(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", (F.pmod("p_partkey", F.lit(131)) / 128.0).alias("fraction"), (F.col("p_size") * 100 + 1).alias("n"))
    return p.select("p_partkey", display.seek_index(F.col("fraction"), F.col("n")).alias("frame"))


def frozen_frames(spark: SparkSession, d: str) -> DataFrame:
    return delta.frozen(queries_grid._epoch_rows(spark, d), 40).groupBy("seq_id", "epoch").agg(F.count(F.lit(1)).alias("n"), F.max("frame").alias("last_frame"))


def finite_points(spark: SparkSession, d: str) -> DataFrame:
    k = F.pmod("pid", F.lit(7))
    odd = F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k == 2, F.lit(None).cast("double")).otherwise(F.col("x"))
    kept = grid.finite(views.xyz(spark, d).withColumn("x", odd))
    return kept.groupBy("frame").agg(F.count(F.lit(1)).alias("n"), F.sum("pid").alias("pids"))


def display_changes(spark: SparkSession, d: str) -> DataFrame:
    """Cells of every frame that are new or show anything else than in the frame before."""
    rows = queries_grid._sequence_cells(spark, d).withColumns({"z_mean": F.col("z_max"), "occ": F.lit(1.0), "trav": F.lit(0.5)})
    before = rows.withColumn("frame", F.col("frame") + 1)
    return grid.display_changes(before, rows, ("seq_id", "frame", "cell")).select("seq_id", "frame", "cell", r6("z_max"), "cls")


def _client(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Slots (cells of the frame before) and the cells of every frame."""
    cells = queries_grid._sequence_cells(spark, d).select("frame", "cell")
    return cells.withColumn("frame", F.col("frame") + 1), cells


def client_purge(spark: SparkSession, d: str) -> DataFrame:
    slots, cells = _client(spark, d)
    return delta.stale_cells(slots, cells, ["frame", "cell"]).select("frame", "cell")


def client_heal(spark: SparkSession, d: str) -> DataFrame:
    """At most 5000 missing cells, the cap of one pass."""
    slots, cells = _client(spark, d)
    return delta.missing_cells(cells, slots, ["frame", "cell"]).select("frame", "cell")


def client_gap_purge(spark: SparkSession, d: str) -> DataFrame:
    return delta.materialize(queries_grid._events(spark, d), queries_grid._schedule(spark), gap_policy="purge").select("seq_id", "cell", r6("z_max"), "cls", "sent_frame")


def purged_slots(spark: SparkSession, d: str) -> DataFrame:
    """Slots that the delta of the same frame did not send, 50,000 at most, the cap of one pass."""
    sent = queries_grid._events(spark, d).filter("op in ('added', 'changed')").select("frame", "cell")
    return delta.purged_slots(_client(spark, d)[0], sent, ["frame", "cell"]).select("frame", "cell")


def slot_compaction(spark: SparkSession, d: str) -> DataFrame:
    cells = queries_grid._sequence_cells(spark, d).withColumn("slot", F.col("cell") * 3 + 7)
    return delta.compacted(cells, "frame", "cell").select("frame", "cell", F.col("slot").cast("long").alias("slot"))


def peak_by_stage(spark: SparkSession, d: str) -> DataFrame:
    return metrics.peak(views.frame_stats(spark, d), "proc_ms", ("stage",))


def step_rates(spark: SparkSession, d: str) -> DataFrame:
    rows = views.frame_stats(spark, d).withColumn("loss", F.pmod("event_id", F.lit(64)) / 64.0)
    return metrics.step_rates(rows, "loss", "proc_ms", ["ts", "event_id"], ("stage",)).select("stage", "bucket", "n", d6("mean_loss"), d6("steps_per_s"))


def bench_averages(spark: SparkSession, d: str) -> DataFrame:
    rows = views.frame_stats(spark, d).withColumn("frame", F.floor(F.col("event_id") / 5))
    return metrics.stage_averages(rows, "stage", "proc_ms", "frame").select("stage", "frames", r6("ms_a_frame"))


def perf_rolling_all(spark: SparkSession, d: str) -> DataFrame:
    """All events as one series."""
    w = metrics.perf_window(views.frame_stats(spark, d), "proc_ms", ["ts", "event_id"])
    return w.select("event_id", d6("mean_ms"), d6("p50_ms"), d6("p95_ms"))


QUERIES = {f.__name__: f for f in (cell_of_id, range_recovery, augment_jitter, augment_cutout, augment_batch, display_labels, swapped_axes, seek_index, frozen_frames, finite_points, display_changes, client_purge, client_heal, client_gap_purge, purged_slots, slot_compaction, peak_by_stage, step_rates, bench_averages, perf_rolling_all)}


def _draw(seed: int, k: int) -> str:
    return f"(('0x' || substr(md5(frame::VARCHAR || '|{seed}|{k}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


_IMAGE = f"{queries_image._NEAREST}, px AS (SELECT frame, row, col, rng / 80 AS ch0, x / 80 AS ch1, remission AS ch4 FROM im)"


def _jitter(seed: int, share: float) -> str:
    return f"CASE WHEN {_draw(seed, 0)} < {share} THEN least(greatest(ch4 * (1 + 0.05::DOUBLE * sqrt(-2 * ln(1 - {_draw(seed, 1)})) * cos({_draw(seed, 2)} * {2 * math.pi!r}::DOUBLE)), 0), 1) ELSE ch4 END"


def _hit(seed: int, share: float) -> str:
    top, left = f"floor({_draw(seed, 1)} * 48)", f"floor({_draw(seed, 2)} * 1792)"
    return f"({_draw(seed, 0)} < {share} AND row BETWEEN {top} AND {top} + 15 AND col BETWEEN {left} AND {left} + 255)"


_FS = queries_eval._FS
_SLOTS = f"{sql.SEQ_CELLS}, sl AS (SELECT frame + 1 AS frame, cell FROM cells)"
ORACLE_SQL = {
    "cell_of_id": f"WITH {sql.CELLS} SELECT DISTINCT cell, (cell // 720)::INT AS ring, (cell % 720)::INT AS sector FROM cells",
    "range_recovery": f"WITH {_IMAGE} SELECT frame, row, col, round(ch0 * 80, 6) AS rng FROM px",
    "augment_jitter": f"WITH {_IMAGE} SELECT frame, row, col, round({_jitter(10, 0.6)}, 6) AS ch4 FROM px",
    "augment_cutout": f"WITH {_IMAGE} SELECT frame, row, col, CASE WHEN {_hit(20, 0.8)} THEN 0 ELSE round(ch0, 6) END AS ch0, CASE WHEN {_hit(20, 0.8)} THEN 0 ELSE round(ch4, 6) END AS ch4 FROM px",
    "augment_batch": f"WITH {_IMAGE}, fl AS (SELECT frame, row, CASE WHEN {_draw(3, 0)} < 0.5 THEN 2047 - col ELSE col END::INT AS col, ch1, ch4 FROM px), ji AS (SELECT frame, row, col, ch1, {_jitter(13, 0.3)} AS ch4 FROM fl) SELECT frame, row, col, CASE WHEN {_hit(23, 0.3)} THEN 0 ELSE round(ch1, 6) END AS ch1, CASE WHEN {_hit(23, 0.3)} THEN 0 ELSE round(ch4, 6) END AS ch4 FROM ji",
    "display_labels": "WITH k AS (SELECT p_partkey, p_size * (p_partkey + 1) / 8.0::DOUBLE AS kb FROM part) SELECT p_partkey, CASE WHEN kb >= 1024 THEN round(kb / 1024, 1)::DECIMAL(18,1)::VARCHAR || ' MB' ELSE round(kb)::BIGINT::VARCHAR || ' KB' END AS size, round(CASE WHEN kb > 0 THEN least(100, 18 + log10(kb) / (log10(kb) + 1) * 55) ELSE 0 END, 6) AS width, printf('%02d:%02d', floor(kb)::BIGINT // 60, floor(kb)::BIGINT % 60) AS clock FROM k",
    "swapped_axes": f"WITH {sql.XYZ} SELECT frame, pid, k1 AS part, k2 AS supp, round(x, 6) AS dx, round(z, 6) AS dy, round(y, 6) AS dz FROM xyz",
    "seek_index": "SELECT p_partkey, least(greatest(round(p_partkey % 131 / 128.0::DOUBLE * (p_size * 100)), 0), p_size * 100)::BIGINT AS frame FROM part",
    "frozen_frames": f"WITH {queries_grid._EPOCH} SELECT seq_id, epoch, count(*) AS n, max(frame) AS last_frame FROM ep WHERE frame <= 40 GROUP BY seq_id, epoch",
    "finite_points": f"WITH {sql.POINTS} SELECT frame, count(*) AS n, sum(pid)::BIGINT AS pids FROM p WHERE pid % 7 > 2 GROUP BY frame",
    "display_changes": f"WITH {sql.SEQ_CELLS} SELECT a.seq_id, a.frame, a.cell, round(a.z_max, 6) AS z_max, a.cls FROM cells a LEFT JOIN cells b ON b.frame = a.frame - 1 AND b.cell = a.cell WHERE b.cell IS NULL OR a.z_max <> b.z_max OR a.cls <> b.cls",
    "client_purge": f"WITH {_SLOTS} SELECT frame::INT AS frame, cell FROM sl ANTI JOIN cells USING (frame, cell)",
    "client_heal": f"WITH {_SLOTS} SELECT frame, cell FROM cells ANTI JOIN sl USING (frame, cell) ORDER BY frame, cell LIMIT 5000",
    "client_gap_purge": f"WITH {sql.EVENTS}, g AS (SELECT frame, kind, frame - lag(frame) OVER (ORDER BY frame) AS step FROM sched WHERE delivered), b AS (SELECT greatest(coalesce(max(frame) FILTER (kind = 'snapshot'), 0), coalesce(max(frame) FILTER (kind = 'delta' AND step > 1), 0)) AS base FROM g), l AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY frame DESC) AS rn FROM ev, b WHERE frame >= base) SELECT seq_id, cell, round(z_max, 6) AS z_max, cls, frame AS sent_frame FROM l WHERE rn = 1 AND op <> 'freed'",
    "purged_slots": f"WITH {sql.EVENTS}, sl AS (SELECT frame + 1 AS frame, cell FROM cells) SELECT frame::INT AS frame, cell FROM sl ANTI JOIN (SELECT frame, cell FROM ev WHERE op IN ('added', 'changed')) x USING (frame, cell) ORDER BY 1, 2 LIMIT 50000",
    "slot_compaction": f"WITH {sql.SEQ_CELLS} SELECT frame, cell, row_number() OVER (PARTITION BY frame ORDER BY cell) - 1 AS slot FROM cells",
    "peak_by_stage": f"WITH {_FS} SELECT stage, max(proc_ms) AS peak FROM fs GROUP BY stage",
    "step_rates": f"WITH {_FS}, n AS (SELECT *, (row_number() OVER (PARTITION BY stage ORDER BY ts, event_id) - 1) // 50 AS bucket FROM fs) SELECT stage, bucket, count(*) AS n, {sql.d6("avg(event_id % 64 / 64.0::DOUBLE)")} AS mean_loss, {sql.d6("count(*) * 1000.0::DOUBLE / sum(proc_ms)")} AS steps_per_s FROM n GROUP BY ALL",
    "bench_averages": f"WITH {_FS} SELECT CASE WHEN grouping(stage) = 1 THEN 'total' ELSE stage END AS stage, count(DISTINCT event_id // 5) AS frames, round(sum(proc_ms) / count(DISTINCT event_id // 5), 6) AS ms_a_frame FROM fs GROUP BY ROLLUP (stage)",
    "perf_rolling_all": f"WITH {_FS} SELECT event_id, {sql.d6('avg(proc_ms) OVER w')} AS mean_ms, {sql.d6('quantile_cont(proc_ms, 0.5) OVER w')} AS p50_ms, {sql.d6('quantile_cont(proc_ms, 0.95) OVER w')} AS p95_ms FROM fs WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)",
}
