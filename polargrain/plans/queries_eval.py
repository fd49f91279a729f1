"""Queries on evaluation, performance, training curves, catalogs and the live path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polargrain.functions import display
from polargrain.operators import metrics
from polargrain.plans import queries_grid, sql
from polargrain.plans.config import GridParams, StreamParams
from polargrain.plans.queries_grid import d6, r6
from polargrain.plans.queries_image import _SOFT
from polargrain.sources import kitti, wire
from polargrain.sources import testviews as views
from polargrain.streaming import live

GRID, STREAM = GridParams(), StreamParams()


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return metrics.banded_confusion(views.predictions(spark, d))


def confusion_5(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion(views.predictions(spark, d))


def confusion_4(spark: SparkSession, d: str) -> DataFrame:
    return _counts(spark, d).filter("scheme = 4 and band = 'all'").select("t", "p", "n")


def confusion_by_band(spark: SparkSession, d: str) -> DataFrame:
    return _counts(spark, d)


def confusion_pivot(spark: SparkSession, d: str) -> DataFrame:
    wide = metrics.confusion_matrix(metrics.confusion(views.predictions(spark, d)), 5)
    return wide.select("t", *[F.col(str(k)).alias(f"p{k}") for k in range(5)])


def confusion_row_normalized(spark: SparkSession, d: str) -> DataFrame:
    return metrics.row_normalized(metrics.confusion(views.predictions(spark, d))).select("t", "p", "n", r6("share"))


def iou_per_class(spark: SparkSession, d: str) -> DataFrame:
    return metrics.iou(metrics.confusion(views.predictions(spark, d)), 5).select("cls", r6("iou"))


def miou(spark: SparkSession, d: str) -> DataFrame:
    return metrics.miou(metrics.iou(metrics.confusion(views.predictions(spark, d)), 5)).select(r6("miou"))


def miou_by_band(spark: SparkSession, d: str) -> DataFrame:
    five = _counts(spark, d).filter("scheme = 5").drop("scheme")
    return metrics.miou(metrics.iou(five, 5, ("band",)), ("band",)).select("band", r6("miou"))


def latency_stats(spark: SparkSession, d: str) -> DataFrame:
    s = metrics.latency_stats(views.frame_stats(spark, d), "proc_ms", ("stage",))
    return s.select("stage", "n", *[r6(c) for c in ("mean", "std", "min", "max", "median", "p90")])


def perf_rolling_100(spark: SparkSession, d: str) -> DataFrame:
    w = metrics.perf_window(views.frame_stats(spark, d), "proc_ms", ["ts", "event_id"], ("stage",))
    return w.select("stage", "event_id", d6("mean_ms"), d6("fps"), d6("p50_ms"), d6("p95_ms"))


def perf_by_stage(spark: SparkSession, d: str) -> DataFrame:
    s = metrics.sums_of_stage(views.frame_stats(spark, d), "stage", "proc_ms")
    return s.select("stage", "n", r6("mean_ms"), r6("p50_ms"), r6("p95_ms"))


def perf_buckets_30(spark: SparkSession, d: str) -> DataFrame:
    b = metrics.perf_buckets(views.frame_stats(spark, d), "proc_ms", ["ts", "event_id"], ("stage",))
    return b.select("stage", "bucket", "n", r6("mean_ms"))


def perf_log_lines(spark: SparkSession, d: str) -> DataFrame:
    b = metrics.perf_lines(views.frame_stats(spark, d), "proc_ms", ["ts", "event_id"], ("stage",), 30, 150.0)
    return b.select("stage", F.col("stretch").cast("long").alias("stretch"), "line", "n", r6("mean_ms"), "slow")


def _history(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(F.col("event_type").alias("run"), (F.floor(F.col("event_id") / 7)).cast("long").alias("step"), F.col("event_id").alias("line_no"), (F.pmod(F.col("event_id") * 37, F.lit(1009)) / 1009.0).alias("miou_4class"))


def history_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return metrics.history_latest(_history(spark, d), by=("run",)).select("run", "step", "line_no", r6("miou_4class"))


def history_peak(spark: SparkSession, d: str) -> DataFrame:
    return metrics.history_peak(_history(spark, d), "miou_4class").select(r6("peak"))


def early_stop_islands(spark: SparkSession, d: str) -> DataFrame:
    h = metrics.history_latest(_history(spark, d), by=("run",))
    e = metrics.early_stop(h, "miou_4class", 15, ("run",))
    return e.select("run", "step", "better", F.col("waited").cast("long").alias("waited"), r6("best"), "stopped")


def lr_schedule(spark: SparkSession, d: str) -> DataFrame:
    steps = spark.range(0, 2001, 10).select(F.col("id").alias("step"))
    return steps.select("step", F.round(display.learning_rate(F.col("step"), 5.0e-4, 500, 2000), 9).alias("lr"))


def _loss_pixels(spark: SparkSession, d: str) -> DataFrame:
    from polargrain.functions.projection import softmax

    return views.logits(spark, d).select("vec_id", softmax(F.col("logits")).alias("probs"), F.when(F.pmod("vec_id", F.lit(11)) == 0, 255).otherwise(F.pmod("vec_id", F.lit(5))).cast("int").alias("t"))


def lovasz_loss(spark: SparkSession, d: str) -> DataFrame:
    """Every class of all pixels that count."""
    return metrics.lovasz_softmax(_loss_pixels(spark, d).filter("t <> 255"), "probs", "t", 5).select("cls", r6("loss"))


def segmentation_loss(spark: SparkSession, d: str) -> DataFrame:
    weights = F.array(*[F.lit(v) for v in (0.5, 1.0, 1.5, 2.0, 2.5)])
    return metrics.segmentation_loss(_loss_pixels(spark, d), "probs", "t", weights, 5).select(r6("cross_entropy"), r6("lovasz"), r6("loss"))


def sequence_catalog(spark: SparkSession, d: str) -> DataFrame:
    k, seq = F.col("o_orderkey"), F.format_string("%02d", F.pmod("o_custkey", F.lit(11)))
    name = F.when(F.pmod(k, F.lit(100)) == 0, F.lit("poses.txt")).when(F.pmod(k, F.lit(3)) == 1, F.format_string("labels/%06d.label", k)).otherwise(F.format_string("velodyne/%06d.bin", k))
    listed = spark.read.parquet(f"{d}/orders.parquet").select(F.concat(F.lit("/data/sequences/"), seq, F.lit("/"), name).alias("path"))
    return kitti.catalog_of(listed)


def _shared(spark: SparkSession, name: str) -> str:
    """A new folder in the cluster's shared one; for sinks and checkpoints of the streaming queries."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="polargrain-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stream_grid_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells by the streaming aggregate; a last, empty frame lets the watermark close the others."""
    src = _shared(spark, "stream-points")
    p = views.points(spark, d).select(F.lit("00").alias("seq_id"), "frame", "pid", "r", "theta", "z", "cls")
    p.repartition("frame").write.parquet(f"{src}/in")
    end = spark.range(1).select(F.lit("00").alias("seq_id"), F.lit(10_000).alias("frame"), F.lit(0).cast("long").alias("pid"), F.lit(1.0).alias("r"), F.lit(0.0).alias("theta"), F.lit(0.0).alias("z"), F.lit(0).alias("cls"))
    end.write.mode("append").parquet(f"{src}/in")
    points = live.stream_points(spark, f"{src}/in", p.schema, 1000)
    out = live.run_available(live.stream_cells(points, GRID, STREAM), f"{src}/out", f"{src}/check")
    return out.select("frame", "ring", "sector", "n_pts", r6("z_min"), r6("z_max"), r6("z_mean"), "cls")


def _write_batches(rows: DataFrame, path: str, turn: str) -> None:
    """Write rows as one file for every value of ``turn``, in its order, for a stream of one file a micro-batch."""
    for (k,) in rows.select(turn).distinct().orderBy(turn).collect():
        rows.filter(F.col(turn) == k).drop(turn).coalesce(1).write.mode("append").parquet(path)


def stream_delta(spark: SparkSession, d: str) -> DataFrame:
    """Events by the stateful operator over more than 24 micro-batches, one or two a frame.

    Frame 5 is split over two batches, frame 3 comes once more when it is late, frame 20 has no
    cells, and an older epoch comes first and once more at the end.
    """
    live.use_map_state(spark)
    src = _shared(spark, "stream-cells")
    frames = queries_grid._frames(spark).withColumn("epoch", F.lit(1).cast("long"))
    cells = queries_grid._sequence_cells(spark, d).filter("frame <> 20").withColumn("epoch", F.lit(1).cast("long"))
    marked = live.with_markers(cells, frames)
    split = (F.col("frame") == 5) & (F.pmod(F.coalesce("cell", F.lit(0)), F.lit(2)) == 1)
    ordered = marked.withColumn("turn", F.col("frame") * 10 + F.when(split, 5).otherwise(0))
    late = marked.filter("frame = 3").withColumn("turn", F.lit(145))
    old = marked.filter("frame <= 2").withColumn("epoch", F.lit(0).cast("long"))
    both = ordered.unionByName(late).unionByName(old.withColumn("turn", F.lit(0))).unionByName(old.withColumn("turn", F.lit(999)))
    held = f"{src}/rows"
    both.select([c.split()[0] for c in live.MARKED.split(", ")] + ["turn"]).write.parquet(held)
    _write_batches(spark.read.parquet(held), f"{src}/in", "turn")
    stream = live.stream_points(spark, f"{src}/in", live.MARKED)
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")  # state is split by sequence, and there is one
    try:
        out = live.run_available(live.stream_deltas(stream, STREAM), f"{src}/out", f"{src}/check")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    return out.filter("epoch = 1").select("seq_id", "cell", "frame", "op", r6("z_max"), "cls")


def wire_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Client rows packed into messages and read back."""
    rows = queries_grid.grid_client_rows(spark, d).select(F.lit("00").alias("seq_id"), F.lit(0).cast("long").alias("epoch"), "frame", F.lit("sent").alias("op"), *wire.ROW, "cls")
    frames = rows.select("seq_id", "epoch", "frame").distinct().withColumn("kind", F.lit("snapshot")).withColumn("yaw_cd", F.lit(0))
    back = wire.unpack(wire.pack(frames, rows))
    return back.select("frame", "ring", "sector", *[F.round(F.col(c).cast("double"), 4).alias(c) for c in ("z_mean", "z_max", "trav")], "cls")


def stats_messages(spark: SparkSession, d: str) -> DataFrame:
    s = metrics.perf_buckets(views.frame_stats(spark, d), "proc_ms", ["ts", "event_id"]).select("bucket", "n")
    return wire.json_rows(s, "stats")


QUERIES = {f.__name__: f for f in (confusion_5, confusion_4, confusion_by_band, confusion_pivot, confusion_row_normalized, iou_per_class, miou, miou_by_band, latency_stats, perf_rolling_100, perf_by_stage, perf_buckets_30, perf_log_lines, history_dedupe, history_peak, early_stop_islands, lr_schedule, lovasz_loss, segmentation_loss, sequence_catalog, stream_grid_cells, stream_delta, wire_roundtrip, stats_messages)}

_C5 = f"{sql.PAIRS}, c5 AS (SELECT t, p, count(*) AS n FROM pr WHERE t <> 255 GROUP BY ALL)"
_BANDED = f"""{sql.PAIRS}, b AS (SELECT *, {sql.BAND} AS band FROM pr WHERE t <> 255), s AS (SELECT 5 AS scheme, t, p, band FROM b UNION ALL SELECT 4, least(t, 3)::INT, least(p, 3)::INT, band FROM b),
bc AS (SELECT scheme::INT AS scheme, CASE WHEN grouping(band) = 1 THEN 'all' ELSE band END AS band, t, p, count(*) AS n, grouping(band) AS g FROM s GROUP BY GROUPING SETS ((scheme, band, t, p), (scheme, t, p)) HAVING grouping(band) = 1 OR band IS NOT NULL)"""
_IOU = "(SELECT {by} k::INT AS cls, (SELECT sum(n) FROM {c} x WHERE {w} t = k AND p = k) AS i, (SELECT sum(n) FROM {c} x WHERE {w} (t = k OR p = k)) AS u FROM {f} range(5) q(k))"
_FS = "fs AS (SELECT event_id, ts, event_type AS stage, value AS proc_ms FROM events)"
_HIST = "h AS (SELECT event_type AS run, event_id // 7 AS step, event_id AS line_no, ((event_id * 37) % 1009) / 1009.0::DOUBLE AS m FROM events)"
_LOVASZ = f"""{_SOFT}, v0 AS (SELECT p, CASE WHEN vec_id % 11 = 0 THEN 255 ELSE vec_id % 5 END::INT AS t FROM sm), y AS (SELECT k::INT AS cls, (t = k)::INT::DOUBLE AS y, abs((t = k)::INT - p[k + 1]) AS err FROM v0, range(5) q(k) WHERE t <> 255),
j AS (SELECT cls, y, err, row_number() OVER w AS k, 1 - (sum(y) OVER (PARTITION BY cls) - sum(y) OVER w) / (sum(y) OVER (PARTITION BY cls) + row_number() OVER w - sum(y) OVER w) AS jac FROM y WINDOW w AS (PARTITION BY cls ORDER BY err DESC, y DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
st AS (SELECT cls, y, err * (jac - coalesce(lag(jac) OVER (PARTITION BY cls ORDER BY k), 0)) AS part FROM j), lv AS (SELECT cls, sum(part) AS loss FROM st GROUP BY cls HAVING sum(y) > 0)"""
ORACLE_SQL = {
    "confusion_5": f"WITH {_C5} SELECT t, p, n FROM c5",
    "confusion_4": f"WITH {_BANDED} SELECT t, p, n FROM bc WHERE scheme = 4 AND g = 1",
    "confusion_by_band": f"WITH {_BANDED} SELECT scheme, band, t, p, n FROM bc",
    "confusion_pivot": f"WITH {_C5} SELECT t, {', '.join(f'coalesce(sum(n) FILTER (p = {k}), 0)::BIGINT AS p{k}' for k in range(5))} FROM c5 GROUP BY t",
    "confusion_row_normalized": f"WITH {_C5} SELECT t, p, n, round(n / greatest(sum(n) OVER (PARTITION BY t), 1), 6) AS share FROM c5",
    "iou_per_class": f"WITH {_C5} SELECT cls, round(i / nullif(u, 0), 6) AS iou FROM (SELECT cls, coalesce(i, 0) AS i, u FROM {_IOU.format(by='', c='c5', w='', f='')})",
    "miou": f"WITH {_C5} SELECT round(coalesce(avg(iou), 0.0), 6) AS miou FROM (SELECT coalesce(i, 0) / nullif(u, 0) AS iou FROM {_IOU.format(by='', c='c5', w='', f='')})",
    "miou_by_band": f"WITH {_BANDED}, b5 AS (SELECT * FROM bc WHERE scheme = 5), bs AS (SELECT DISTINCT band FROM b5) SELECT band, round(coalesce(avg(iou), 0.0), 6) AS miou FROM (SELECT band, coalesce(i, 0) / nullif(u, 0) AS iou FROM {_IOU.format(by='bs.band,', c='b5', w='x.band = bs.band AND', f='bs,')}) GROUP BY band",
    "latency_stats": f"WITH {_FS} SELECT stage, count(*) AS n, round(avg(proc_ms), 6) AS mean, round(stddev_pop(proc_ms), 6) AS std, round(min(proc_ms), 6) AS min, round(max(proc_ms), 6) AS max, round(quantile_cont(proc_ms, 0.5), 6) AS median, round(quantile_cont(proc_ms, 0.9), 6) AS p90 FROM fs GROUP BY stage",
    "perf_rolling_100": f"WITH {_FS}, v AS (SELECT stage, event_id, avg(proc_ms) OVER w AS m, quantile_cont(proc_ms, 0.5) OVER w AS p50, quantile_cont(proc_ms, 0.95) OVER w AS p95 FROM fs WINDOW w AS (PARTITION BY stage ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)) SELECT stage, event_id, {sql.d6('m')} AS mean_ms, {sql.d6('1000 / greatest(m, 1e-3)')} AS fps, {sql.d6('p50')} AS p50_ms, {sql.d6('p95')} AS p95_ms FROM v",
    "perf_by_stage": f"WITH {_FS} SELECT stage, count(*) AS n, round(avg(proc_ms), 6) AS mean_ms, round(quantile_cont(proc_ms, 0.5), 6) AS p50_ms, round(quantile_cont(proc_ms, 0.95), 6) AS p95_ms FROM fs GROUP BY stage",
    "perf_buckets_30": f"WITH {_FS}, n AS (SELECT *, (row_number() OVER (PARTITION BY stage ORDER BY ts, event_id) - 1) // 30 AS bucket FROM fs) SELECT stage, bucket, count(*) AS n, round(avg(proc_ms), 6) AS mean_ms FROM n GROUP BY ALL",
    "perf_log_lines": f"WITH {_FS}, a AS (SELECT *, proc_ms > 150 AS slow, coalesce(sum((proc_ms > 150)::INT) OVER (PARTITION BY stage ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS stretch FROM fs), b AS (SELECT *, (row_number() OVER (PARTITION BY stage, stretch ORDER BY ts, event_id) - 1) // 30 AS line FROM a) SELECT stage, stretch, line, count(*) AS n, round(avg(proc_ms), 6) AS mean_ms, bool_or(slow) AS slow FROM b GROUP BY stage, stretch, line HAVING count(*) = 30 OR bool_or(slow)",
    "history_dedupe": f"WITH {_HIST} SELECT run, step, max(line_no) AS line_no, round(arg_max(m, line_no), 6) AS miou_4class FROM h GROUP BY run, step",
    "history_peak": f"WITH {_HIST} SELECT round(max(m), 6) AS peak FROM h",
    "early_stop_islands": f"""WITH {_HIST}, l AS (SELECT run, step, arg_max(m, line_no) AS m FROM h GROUP BY run, step),
b AS (SELECT *, coalesce(m > max(m) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS better, max(m) OVER (PARTITION BY run ORDER BY step) AS best FROM l),
r AS (SELECT *, sum(better::INT) OVER (PARTITION BY run ORDER BY step) AS island FROM b), w AS (SELECT *, row_number() OVER (PARTITION BY run, island ORDER BY step) - 1 AS waited FROM r)
SELECT run, step, better, waited, round(best, 6) AS best, max(waited) OVER (PARTITION BY run ORDER BY step) >= 15 AS stopped FROM w""",
    "lr_schedule": "SELECT step, round(0.0005::DOUBLE * CASE WHEN step < 500 THEN step / 500.0::DOUBLE ELSE 0.5 * (1 + cos(pi() * (step - 500) / 1500.0::DOUBLE)) END, 9) AS lr FROM range(0, 2001, 10) t(step)",
    "lovasz_loss": f"WITH {_LOVASZ} SELECT cls, round(loss, 6) AS loss FROM lv",
    "segmentation_loss": f"WITH {_LOVASZ}, ce AS (SELECT sum(-(0.5::DOUBLE + 0.5 * t) * ln(greatest(p[t + 1], 1e-12))) / sum(0.5::DOUBLE + 0.5 * t) AS x FROM v0 WHERE t <> 255), m AS (SELECT avg(loss) AS x FROM lv) SELECT round(ce.x, 6) AS cross_entropy, round(m.x, 6) AS lovasz, round(ce.x + 0.5 * m.x, 6) AS loss FROM ce, m",
    "stats_messages": f"WITH {_FS}, n AS (SELECT (row_number() OVER (ORDER BY ts, event_id) - 1) // 30 AS bucket FROM fs) SELECT '{{\"type\":\"stats\",\"bucket\":' || bucket || ',\"n\":' || count(*) || '}}' AS message FROM n GROUP BY bucket",
    "sequence_catalog": """WITH f AS (SELECT lpad((o_custkey % 11)::VARCHAR, 2, '0') AS seq_id, CASE WHEN o_orderkey % 100 = 0 THEN 'p' WHEN o_orderkey % 3 = 1 THEN 'l' ELSE 'v' END AS k FROM orders)
SELECT seq_id, count(*) FILTER (k = 'v') AS n_frames, bool_or(k = 'p') AS has_poses, bool_or(k = 'l') AS has_labels FROM f GROUP BY seq_id HAVING count(*) FILTER (k = 'v') > 0""",
    "stream_grid_cells": f"WITH {sql.CELLS} SELECT frame, ring, sector, n_pts, round(z_min, 6) AS z_min, round(z_max, 6) AS z_max, round(z_mean, 6) AS z_mean, cls FROM cells",
    "stream_delta": f"WITH {sql.EVENTS.replace('FROM s GROUP BY ALL', 'FROM s WHERE frame <> 20 GROUP BY ALL')} SELECT seq_id, cell, frame, op, round(z_max, 6) AS z_max, cls FROM ev",
    "wire_roundtrip": f"WITH {sql.CELLS}, {sql.GROUND}, {sql.TRAV} SELECT frame, ring, sector, round((round(z_mean - ground_z, 6))::FLOAT::DOUBLE, 4) AS z_mean, round((round(z_max - ground_z, 6))::FLOAT::DOUBLE, 4) AS z_max, round((round(trav, 6))::FLOAT::DOUBLE, 4) AS trav, cls FROM tt",
}
