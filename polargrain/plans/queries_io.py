"""Queries that write the test relations as files or messages and read them back."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polargrain.functions import labels
from polargrain.functions import projection as proj
from polargrain.operators import cloud, etl, images, metrics, ordered, segment
from polargrain.plans import queries_eval, queries_grid, queries_image, sql
from polargrain.plans.config import ProjectionParams, StreamParams, load_config
from polargrain.plans.engine import Engine
from polargrain.plans.queries_eval import _shared
from polargrain.plans.queries_grid import GRID, r6
from polargrain.sources import kitti, sinks, synthetic, wire
from polargrain.sources import testviews as views
from polargrain.streaming import live

P = ProjectionParams()


def f4(name: str):
    """Four places of a value that was a 32-bit float."""
    return F.round(F.col(name).cast("double"), 4).alias(name)


def _raw_points(spark: SparkSession, d: str) -> DataFrame:
    """Points of two sequences with numbers from 0 in every frame, a remission and a label word with instance bits."""
    p = queries_grid._world_points(spark, d)
    numbered = ordered.numbered(p, ("seq_id", "frame"), ["pid"], "rn")
    word = F.pmod("pid", F.lit(260)) + F.pmod("pid", F.lit(3)) * 65536
    return numbered.select("seq_id", "frame", (F.col("rn") - 1).cast("int").alias("pid"), "x", "y", "z", (F.pmod("pid", F.lit(100)) / 100.0).alias("remission"), word.alias("raw_label"))


def _written(spark: SparkSession, d: str, labelled: bool) -> str:
    root = _shared(spark, "scans")
    rows = _raw_points(spark, d)
    kitti.write_scans(rows if labelled else rows.drop("raw_label"), root).write.format("noop").mode("overwrite").save()
    return root


def scan_files(spark: SparkSession, d: str) -> DataFrame:
    """All scans; a frame is its file's place in the listing."""
    return kitti.read_scans(spark, _written(spark, d, False)).select("seq_id", "frame", "pid", *[f4(c) for c in ("x", "y", "z", "remission")])


def frame_read(spark: SparkSession, d: str) -> DataFrame:
    """One frame, and one past the end, which has no rows."""
    root = _written(spark, d, False)
    both = kitti.read_frame(spark, root, "00", 2).unionByName(kitti.read_frame(spark, root, "00", 99))
    return both.select("seq_id", "frame", "pid", *[f4(c) for c in ("x", "y", "z", "remission")])


def label_files(spark: SparkSession, d: str) -> DataFrame:
    read = kitti.read_labels(spark, _written(spark, d, True))
    return read.select("seq_id", "frame", "pid", "raw_label", labels.semantic(F.col("raw_label")).cast("int").alias("semantic"))


def labelled_scans(spark: SparkSession, d: str) -> DataFrame:
    """Scans with labels by position: frame 3 has no label file, and that of frame 5 has another length."""
    root, rows = _shared(spark, "scans"), _raw_points(spark, d)
    run = lambda df: kitti.write_scans(df, root).write.format("noop").mode("overwrite").save()
    run(rows.filter("frame <> 3 and (frame <> 5 or pid % 2 = 0)"))
    run(rows.filter("frame in (3, 5)").drop("raw_label"))
    read = kitti.read_labelled_scans(spark, root)
    return read.select("seq_id", "frame", "pid", f4("x"), labels.remap(labels.semantic(F.col("raw_label"))).cast("int").alias("cls5"))


def looped_frames(spark: SparkSession, d: str) -> DataFrame:
    p = views.points(spark, d).select("frame", "pid")
    return kitti.looped(p, 7, 3).groupBy("frame").agg(F.count(F.lit(1)).alias("n"), F.sum("pid").alias("pids"))


def poses_read(spark: SparkSession, d: str) -> DataFrame:
    """A pose a nation, times a calibration."""
    root = _shared(spark, "poses")
    rows = spark.read.parquet(f"{d}/nation.parquet").orderBy("n_nationkey").collect()  # 25 rows
    lines = [" ".join(str(v) for v in (1, 0, 0, r.n_nationkey, 0, 1, 0, r.n_regionkey, 0, 0, 1, 0.5)) for r in rows]
    kitti.put(f"{root}/00/poses.txt", ("\n".join(lines) + "\n\n").encode())
    kitti.put(f"{root}/00/calib.txt", b"P0: 1 0 0 0\nTr: 0 -1 0 0.25 0 0 -1 0.5 1 0 0 -0.75\nTr: 9\n")
    return kitti.read_poses(spark, f"{root}/00").select("pose_id", *[r6(f"p{k}", F.get("pose", F.lit(k))) for k in range(16)])


def history_read(spark: SparkSession, d: str) -> DataFrame:
    """Records appended in two turns, with blank and malformed lines between."""
    root, n = _shared(spark, "history"), F.col("event_id")
    e = spark.read.parquet(f"{d}/events.parquet").select(n.alias("step"), F.floor(n / 100).alias("epoch"), "value", F.pmod(n, F.lit(2)).alias("half"))
    rows = e.select("step", "epoch", (F.col("value") / 4).alias("val_loss"), F.lit(0.5).alias("miou_5class"), F.lit(0.75).alias("miou_4class"), "half")
    for half in (0, 1):
        sinks.append_history(rows.filter(F.col("half") == half).drop("half"), f"{root}/history")
    spark.createDataFrame([("",), ("{broken",), ("[1, 2]",), ('{"epoch": 3}',)], "value string").coalesce(1).write.mode("append").text(f"{root}/history")
    return kitti.read_history(spark, f"{root}/history").select("step", "epoch", r6("val_loss"), "miou_5class", "miou_4class")


def _evaluation(spark: SparkSession, d: str) -> DataFrame:
    return Engine(spark).evaluate(views.predictions(spark, d))


def newest_eval(spark: SparkSession, d: str) -> DataFrame:
    """Confusion entries of the newest of two evaluation files."""
    root = _shared(spark, "eval")
    text = _evaluation(spark, d).toJSON().first()  # one row
    kitti.put(f"{root}/eval_20260102_000000.json", text.encode())
    kitti.put(f"{root}/eval_20260101_000000.json", json.dumps({"confusion": []}).encode())
    read = kitti.read_newest_eval(spark, root)
    return read.select(F.explode("confusion").alias("e")).select(*[F.col(f"e.{c}").cast(k).alias(c) for c, k in (("scheme", "int"), ("band", "string"), ("t", "int"), ("p", "int"), ("n", "long"))])


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    return metrics.ranked(metrics.iou(metrics.confusion(views.predictions(spark, d)), 5))


def iou_ranked(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d).select("place", "cls", r6("iou"))


def eval_markdown(spark: SparkSession, d: str) -> DataFrame:
    text = sinks.markdown_table(_ranked(spark, d), ["place", "cls", "iou"], ["place"])
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "line_no long, line string")


def readme_injected(spark: SparkSession, d: str) -> DataFrame:
    mark = "<!-- eval:start -->x<!-- eval:end -->"
    text = F.concat("r_name", F.when(F.pmod("r_regionkey", F.lit(2)) == 1, F.lit(mark)).otherwise(F.lit(" \n")))
    return spark.read.parquet(f"{d}/region.parquet").select("r_regionkey", sinks.with_block(text, "| a |").alias("text"))


CLASSES_YAML = "classes:\n  1: {name: rough, color: '#123456'}\n  3: {color: '#abcdef'}\n"


def class_table(spark: SparkSession, d: str) -> DataFrame:
    return labels.class_table(spark, labels.class_config(CLASSES_YAML))


def config_resolved(spark: SparkSession, d: str) -> DataFrame:
    """Settings of two files, the later winning, and of the environment, which wins over both."""
    import tempfile

    with tempfile.TemporaryDirectory() as folder:  # read here and now, by the driver alone
        for name, text in (("a", "grid: {r_max: 50, dr_0: 0.1}\nstream: {stats_interval: 4, native_hz: 20}\n"), ("b", "grid: {dr_0: 0.2}\nunknown: 3\n")):
            with open(f"{folder}/{name}.yaml", "w") as f:
                f.write(text)
        c = load_config(f"{folder}/a.yaml", f"{folder}/b.yaml", env={"POLARGRAIN_STREAM_NATIVE_HZ": "5", "POLARGRAIN_TRAVERSABILITY_ENABLED": "off"})
    rows = [("grid", k, float(getattr(c.grid, k))) for k in ("r_min", "r_max", "dr_0", "r_transition", "alpha", "n_theta")]
    rows += [("stream", k, float(getattr(c.stream, k))) for k in ("native_hz", "snapshot_interval", "stats_interval", "cloud_frames", "cloud_max")]
    return spark.createDataFrame([*rows, ("traversability", "enabled", float(c.traversability.enabled))], "section string, name string, value double")


def synthetic_scans(spark: SparkSession, d: str) -> DataFrame:
    s = synthetic.scans(spark, 6, 2000, 3)
    again = synthetic.scans(spark, 6, 2000, 3).select("frame", "pid", F.col("x").alias("x2"))
    r = F.hypot(F.col("x") - 0.8 * F.col("frame"), F.col("y"))
    checked = s.join(again, ["frame", "pid"]).groupBy("frame")
    return checked.agg(F.count(F.lit(1)).alias("n"), F.bool_and(r.between(0.5 - 1e-9, 95 + 1e-9) & F.col("remission").between(0, 1)).alias("inside"), F.bool_and(F.col("x") == F.col("x2")).alias("repeats"), F.count_distinct("cls").alias("classes"))


def _frame_pixels(spark: SparkSession, d: str) -> DataFrame:
    """Range image with labels of every frame, sequence 00."""
    projected = proj.project(views.xyz(spark, d), P)
    held = images.nearest(projected, ("frame",), ("pid", "rng", "x", "y", "z", "remission", "cls"), queries_image.ORDER)
    return held.select(F.lit("00").alias("seq_id"), "frame", "row", "col", *proj.channels(P), F.col("cls").cast("short").alias("label"))


KEYS = ("seq_id", "frame")


def tar_shards(spark: SparkSession, d: str) -> DataFrame:
    """Dense images in tar shards of two frames, read back as labelled pixels."""
    pixels = _frame_pixels(spark, d)
    assignment = etl.shard_assignment(pixels.select(*KEYS).distinct(), size=2)
    written = etl.write_tar_shards(images.dense_images(pixels, P, KEYS), assignment, _shared(spark, "shards"))
    folder = written.select("path").first()[0].rpartition("/")[0]
    read = kitti.read_tar_shards(spark, folder)
    sparse = images.sparse_pixels(read.select("shard", "key", "image", "labels"), P, ("shard", "key"))
    return sparse.select("shard", "key", "row", "col", F.col("label").cast("int").alias("label"), F.round(F.col("ch4").cast("double"), 2).alias("ch4"))


def shard_overwrite(spark: SparkSession, d: str) -> DataFrame:
    """A second writing of shards is refused unless forced."""
    path, rows = _shared(spark, "dense"), spark.read.parquet(f"{d}/nation.parquet").select(F.lit("00").alias("seq_id"), F.col("n_nationkey").alias("frame"))
    assignment = etl.shard_assignment(rows, size=10)
    etl.write_shards(rows, assignment, path, "train")
    refused = False
    try:
        etl.write_shards(rows, assignment, path, "train")
    except Exception as e:  # noqa: BLE001  the type differs between Spark versions
        refused = "PATH_ALREADY_EXISTS" in str(e) or "already exists" in str(e)
    etl.write_shards(rows.filter("frame < 20"), assignment, path, "train", "overwrite")
    return spark.read.parquet(path).groupBy("split", F.col("shard").cast("long").alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.lit(refused).alias("refused"))


def _kept(spark: SparkSession, d: str) -> DataFrame:
    five = views.xyz(spark, d).withColumn("cls5", labels.remap(labels.semantic(F.pmod("k1", F.lit(260)))))
    return etl.training_points(five, P)


def etl_mask(spark: SparkSession, d: str) -> DataFrame:
    return _kept(spark, d).groupBy("frame", F.col("cls5").cast("int").alias("cls5")).agg(F.count(F.lit(1)).alias("n"), r6("farthest", F.max("rng")))


def _split(spark: SparkSession, d: str) -> DataFrame:
    return _kept(spark, d).withColumn("seq_id", F.lit("00")).withColumn("split", F.when(F.col("frame") <= 5, "train").otherwise("val"))


def split_metadata(spark: SparkSession, d: str) -> DataFrame:
    return etl.split_metadata(_split(spark, d))


def shard_metadata(spark: SparkSession, d: str) -> DataFrame:
    m = etl.shard_metadata(_split(spark, d))
    each = m.select("n_train", "n_val", "image_dtype", "label_dtype", F.posexplode(F.arrays_zip("class_counts", "class_weights")).alias("cls", "v"))
    return each.select("n_train", "n_val", "image_dtype", "label_dtype", "cls", F.col("v.class_counts").alias("n"), r6("weight", F.col("v.class_weights")))


def _samples(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.pmod("o_custkey", F.lit(5)).cast("string").alias("seq_id"), F.col("o_orderkey").alias("frame"))
    return etl.shard_assignment(o.distinct())


def sample_stream(spark: SparkSession, d: str) -> DataFrame:
    """A shuffled stream is a permutation; its bounded buffer keeps a shard's samples near one another."""
    s = etl.shuffled_samples(_samples(spark, d), 7, shard="shard", buffer=500)
    spread = s.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), (F.max("place") - F.min("place")).alias("spread"), F.sum("place").alias("places"))
    out = spread.agg(F.sum("n").alias("n"), F.bool_and(F.col("spread") < 1200).alias("near"), F.sum("places").alias("places"))
    order = etl.shuffled_samples(_samples(spark, d), 7).agg(F.count_distinct("place").alias("distinct_places"), F.max("place").alias("last_place"), F.bool_or(F.col("place") != F.col("shard") * 200 + F.col("sample") + 1).alias("moved"))
    return out.crossJoin(F.broadcast(order))  # one row each


def batches(spark: SparkSession, d: str) -> DataFrame:
    """Samples in batches of 64, the first 20 of them."""
    placed = ordered.numbered(_samples(spark, d), (), ["frame"], "place")
    held = etl.first_batches(etl.collated(placed, 64), 20)
    return held.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.max("item").alias("last_item"))


def _delta_rows(spark: SparkSession, d: str) -> DataFrame:
    told = queries_grid._events(spark, d).filter("op <> 'snapshot'")
    z, live_ = F.col("z_max"), F.col("op") != "freed"
    shown = lambda v: F.when(live_, v)
    return told.select("seq_id", F.lit(4).cast("long").alias("epoch"), "frame", "op", F.floor(F.col("cell") / 720).cast("int").alias("ring"), F.pmod("cell", F.lit(720)).cast("int").alias("sector"), z.alias("z_mean"), z.alias("z_max"), shown(F.lit(1.0)).alias("occ"), shown(F.lit(0.5)).alias("trav"), "cls")


def delta_messages(spark: SparkSession, d: str) -> DataFrame:
    """Binary deltas of all delivered frames, read back; freed cells come in the last chunk."""
    rows = _delta_rows(spark, d)
    frames = rows.select("seq_id", "epoch", "frame").distinct().withColumn("kind", F.lit("delta")).withColumn("yaw_cd", F.lit(-4500))
    back = wire.unpack(wire.pack(frames, rows))
    return back.select("seq_id", "epoch", "frame", "kind", "op", "ring", "sector", f4("z_max"), f4("trav"), "cls")


def json_snapshots(spark: SparkSession, d: str) -> DataFrame:
    rows = queries_grid._events(spark, d).filter("op = 'snapshot'").select("seq_id", "frame", F.floor(F.col("cell") / 720).alias("ring"), F.pmod("cell", F.lit(720)).alias("sector"), F.round("z_max", 2).alias("z_mean"), F.round("z_max", 2).alias("z_max"), F.lit(1.0).alias("occ"), F.lit(0.5).alias("trav"), "cls")
    return wire.json_snapshots(rows).select("seq_id", "frame", "message")


def json_deltas(spark: SparkSession, d: str) -> DataFrame:
    rows = _delta_rows(spark, d).withColumns({c: F.round(c, 2) for c in ("z_mean", "z_max")})
    return wire.json_deltas(rows).select("seq_id", "frame", "message")


def grid_meta(spark: SparkSession, d: str) -> DataFrame:
    from polargrain.operators import grid

    text = wire.json_rows(grid.grid_meta(spark, GRID), "grid_meta")
    read = text.select(F.from_json("message", "type string, r_min double, r_max double, r_transition double, alpha double, dr_0 double, n_rings int, phase1_rings int, n_theta int, n_classes int, class_colors map<string,string>").alias("m"))
    return read.select("m.type", "m.r_min", "m.r_max", "m.r_transition", "m.alpha", "m.dr_0", "m.n_rings", "m.phase1_rings", "m.n_theta", "m.n_classes", F.explode("m.class_colors").alias("cls", "color"))


def stats_cadence(spark: SparkSession, d: str) -> DataFrame:
    """One statistics message every second frame."""
    numbered = ordered.numbered(views.frame_stats(spark, d), (), ["ts", "event_id"], "frame")
    return Engine(spark).stats(numbered.select("frame", "stage"))


def _shown(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    got = queries_grid._two_clouds(spark, d)
    ground = got.select("seq_id", F.col("at").alias("frame")).distinct().withColumn("ground_z", F.col("frame") * 0.125)
    return cloud.shown_cloud(got, ground).withColumn("epoch", F.lit(2).cast("long")).drop("frame").withColumnRenamed("at", "frame"), ground


def _cloud_bodies(spark: SparkSession, d: str) -> DataFrame:
    shown, ground = _shown(spark, d)
    yaw = cloud.headings(ground.select("seq_id", "frame"), views.sequence_poses(spark))
    return wire.pack_clouds(shown, yaw)


def cloud_messages(spark: SparkSession, d: str) -> DataFrame:
    back = wire.unpack_clouds(_cloud_bodies(spark, d))
    return back.groupBy("seq_id", "epoch", "frame", "yaw_cd", "cls").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.sum(F.round(c, 3).cast("decimal(18,3)")).cast("double"), 1).alias(f"sum_{c}") for c in "xyz"])


def cloud_reassembly(spark: SparkSession, d: str) -> DataFrame:
    """Frames of which every chunk has come; one chunk of every fourth frame is lost."""
    p = views.points(spark, d).select(F.lit("00").alias("seq_id"), "frame", F.floor(F.col("pid") / 500).cast("int").alias("seq")).distinct()
    total = p.groupBy("seq_id", "frame").agg(F.count(F.lit(1)).cast("int").alias("total"))
    sent = p.join(total, ["seq_id", "frame"]).withColumn("epoch", F.lit(0).cast("long")).filter("not (frame % 4 = 0 and seq % 2 = 1)")
    return wire.complete_frames(sent).select("seq_id", "frame", "total")


def queue_delivery(spark: SparkSession, d: str) -> DataFrame:
    """Frames of one to three messages through a queue of five that is drained after every fourth."""
    frames = spark.read.parquet(f"{d}/nation.parquet").select((F.col("n_nationkey") + 1).alias("frame"))
    messages = frames.withColumn("seq", F.explode(F.sequence(F.lit(0), F.pmod("frame", F.lit(3))))).withColumn("body", F.encode(F.col("seq").cast("string"), "UTF-8"))
    queue, out = sinks.FrameQueue(5), []
    for first in range(1, 26, 4):
        out += sinks.emit_frames(messages.filter(F.col("frame").between(first, first + 3)), queue)
        queue.drain()
    return spark.createDataFrame(out, "frame int, delivered boolean")


def fan_out(spark: SparkSession, d: str) -> DataFrame:
    """Clients get every message until they fail."""
    hub, got = sinks.FanOut(), {"a": [], "b": [], "c": []}

    def failing(message: str) -> None:
        if len(got["b"]) == 3:
            raise ConnectionError
        got["b"].append(message)

    hub.add("a", got["a"].append)
    hub.add("b", failing)
    hub.add("c", got["c"].append)
    hub.send(r.n_name for r in spark.read.parquet(f"{d}/nation.parquet").orderBy("n_nationkey").collect())  # 25 rows
    return spark.createDataFrame([(k, len(v), v[-1]) for k, v in got.items()], "client string, n long, last string")


def player_controls(spark: SparkSession, d: str) -> DataFrame:
    """What a player starts and previews under a fixed series of controls."""
    log: list[tuple] = []

    class Query:
        def stop(self) -> None:
            log.append(("stop", "", -1, -1, 0.0, False))

    player = live.Player(lambda *a: log.append(("start", *a)) or Query(), 10, "00", lambda *a: log.append(("preview", *a, 0.0, False)), lambda: 6)
    player.seek(40)
    player.play()
    player.set_speed(2.0)
    player.set_cloud(True)
    player.switch("01", 5)
    player.pause()
    return spark.createDataFrame([(k, *row) for k, row in enumerate(log)], "turn long, what string, seq_id string, epoch int, frame int, speed double, cloud boolean")


def paced_intervals(spark: SparkSession, d: str) -> DataFrame:
    s = StreamParams()
    return spark.createDataFrame([(v, live.paced_interval(s, v)) for v in (0.1, 0.5, 1.0, 2.0, 10.0)], "speed double, trigger string")


def _frames_in(spark: SparkSession, d: str, path: str, which: str) -> None:
    p = views.points(spark, d).select(F.lit("00").alias("seq_id"), "frame", "pid", "r", "theta", "z", "cls").filter(which)
    p.repartition("frame").write.mode("append").parquet(path)


STREAMED = "seq_id string, frame int, pid long, r double, theta double, z double, cls int"


def stream_seek(spark: SparkSession, d: str) -> DataFrame:
    """A jump to frame 3: a fresh query, a new epoch."""
    src = _shared(spark, "stream-seek")
    _frames_in(spark, d, f"{src}/in", "true")
    out = live.run_available(live.seek_points(live.stream_points(spark, f"{src}/in", STREAMED, 100), 3, 1), f"{src}/out", f"{src}/check-1")
    return out.groupBy("epoch", "frame").agg(F.count(F.lit(1)).alias("n"))


def stream_restart(spark: SparkSession, d: str) -> DataFrame:
    """A query that ends and goes on from its checkpoint takes every row once."""
    src = _shared(spark, "stream-restart")
    for which in ("frame <= 3", "frame > 3"):
        _frames_in(spark, d, f"{src}/in", which)
        out = live.run_available(live.stream_points(spark, f"{src}/in", STREAMED, 2), f"{src}/out", f"{src}/check")
    return out.groupBy("frame").agg(F.count(F.lit(1)).alias("n"), F.sum("pid").alias("pids"))


def segment_rules(spark: SparkSession, d: str) -> DataFrame:
    """The rule segmenter on all points, and on none."""
    p = views.xyz(spark, d)
    ruled = segment.RuleSegmenter()
    both = ruled.segment(p).unionByName(ruled.segment(p.limit(0)))
    return both.groupBy("frame", F.col("cls5").cast("int").alias("cls5")).agg(F.count(F.lit(1)).alias("n"))


def _by_height():
    """A model whose class is the one of five heights that is nearest to a pixel's."""
    heights = (np.arange(5) * 0.74 - 2).reshape(1, 5, 1, 1)
    return lambda stack: -np.abs(stack[:, 3:4].astype(np.float64) * 80 - heights)


def pixel_eval(spark: SparkSession, d: str) -> DataFrame:
    """A model over dense images, its arg-max paired with the labels pixel by pixel."""
    pixels = _frame_pixels(spark, d)
    predicted = segment.predict_images(images.dense_images(pixels, P, KEYS), _by_height, P)
    labels_of = predicted.select(*KEYS, "image", F.col("predicted").alias("labels"))
    pred = images.sparse_pixels(labels_of, P, KEYS)
    return metrics.confusion(metrics.paired(pred, pixels, (*KEYS, "row", "col"))).select(F.col("t").cast("int").alias("t"), F.col("p").cast("int").alias("p"), "n")


QUERIES = {f.__name__: f for f in (scan_files, frame_read, label_files, labelled_scans, looped_frames, poses_read, history_read, newest_eval, iou_ranked, eval_markdown, readme_injected, class_table, config_resolved, synthetic_scans, tar_shards, shard_overwrite, etl_mask, split_metadata, shard_metadata, sample_stream, batches, delta_messages, json_snapshots, json_deltas, grid_meta, stats_cadence, cloud_messages, cloud_reassembly, queue_delivery, fan_out, player_controls, paced_intervals, stream_seek, stream_restart, segment_rules, pixel_eval)}

_RAW = f"""{sql.XYZ}, u AS (SELECT frame, pid, min(struct_pack(k1, k2, x, y, z, cls)) AS v FROM xyz GROUP BY ALL),
rp AS (SELECT '0' || (pid % 2)::VARCHAR AS seq_id, frame, (row_number() OVER (PARTITION BY pid % 2, frame ORDER BY pid) - 1)::INT AS pid, v.x AS x, v.y AS y, v.z AS z, pid % 100 / 100.0::DOUBLE AS remission, pid % 260 + pid % 3 * 65536 AS raw_label FROM u),
sc AS (SELECT *, (dense_rank() OVER (PARTITION BY seq_id ORDER BY frame) - 1)::INT AS place FROM rp)"""
_F4 = ", ".join(f"round({c}::FLOAT::DOUBLE, 4) AS {c}" for c in ("x", "y", "z", "remission"))
_MAP = queries_image._MAP
_SEM = f"coalesce({_MAP}[((raw_label & 65535) & 255)::INT], 255)::INT"
_RANKED = f"""{sql.PAIRS}, c5 AS (SELECT t, p, count(*) AS n FROM pr WHERE t <> 255 GROUP BY ALL), io AS (SELECT k::INT AS cls, coalesce((SELECT sum(n) FROM c5 WHERE t = k AND p = k), 0) / nullif((SELECT sum(n) FROM c5 WHERE t = k OR p = k), 0) AS iou FROM range(5) q(k)),
rk AS (SELECT row_number() OVER (ORDER BY iou DESC NULLS LAST, cls)::INT AS place, cls, iou FROM io)"""
_KEPT = f"{sql.XYZ}, kp AS (SELECT *, sqrt(x * x + y * y + z * z) AS rng, coalesce({_MAP}[(k1 % 260 & 255)::INT], 255)::INT AS cls5 FROM xyz), kept AS (SELECT *, CASE WHEN frame <= 5 THEN 'train' ELSE 'val' END AS split FROM kp WHERE rng <= 80 AND cls5 <> 255)"
_ASSIGN = "f0 AS (SELECT DISTINCT (o_custkey % 5)::VARCHAR AS seq_id, o_orderkey AS frame FROM orders)"
_DELTAS = f"{sql.EVENTS}, dl AS (SELECT seq_id, frame, op, (cell // 720)::INT AS ring, (cell % 720)::INT AS sector, z_max, cls FROM ev WHERE op <> 'snapshot')"
ORACLE_SQL = {
    "scan_files": f"WITH {_RAW} SELECT seq_id, place AS frame, pid, {_F4} FROM sc",
    "frame_read": f"WITH {_RAW} SELECT seq_id, place AS frame, pid, {_F4} FROM sc WHERE seq_id = '00' AND place = 2",
    "label_files": f"WITH {_RAW} SELECT seq_id, place AS frame, pid, raw_label, ((raw_label & 65535) & 255)::INT AS semantic FROM sc",
    "labelled_scans": f"WITH {_RAW} SELECT seq_id, place AS frame, pid, round(x::FLOAT::DOUBLE, 4) AS x, {_SEM} AS cls5 FROM sc WHERE frame NOT IN (3, 5)",
    "looped_frames": f"WITH {sql.POINTS} SELECT (frame + 7 * k)::INT AS frame, count(*) AS n, sum(pid)::BIGINT AS pids FROM p, range(3) t(k) GROUP BY ALL",
    "poses_read": "SELECT n_nationkey::INT AS pose_id, 0.0::DOUBLE AS p0, -1.0::DOUBLE AS p1, 0.0::DOUBLE AS p2, 0.25 + n_nationkey::DOUBLE AS p3, 0.0::DOUBLE AS p4, 0.0::DOUBLE AS p5, -1.0::DOUBLE AS p6, 0.5 + n_regionkey::DOUBLE AS p7, 1.0::DOUBLE AS p8, 0.0::DOUBLE AS p9, 0.0::DOUBLE AS p10, -0.25::DOUBLE AS p11, 0.0::DOUBLE AS p12, 0.0::DOUBLE AS p13, 0.0::DOUBLE AS p14, 1.0::DOUBLE AS p15 FROM nation",
    "history_read": "SELECT event_id AS step, event_id // 100 AS epoch, round(value / 4, 6) AS val_loss, 0.5::DOUBLE AS miou_5class, 0.75::DOUBLE AS miou_4class FROM events",
    "newest_eval": f"WITH {queries_eval._BANDED} SELECT scheme, band, t, p, n FROM bc",
    "iou_ranked": f"WITH {_RANKED} SELECT place, cls, round(iou, 6) AS iou FROM rk",
    "eval_markdown": f"WITH {_RANKED} SELECT 0::BIGINT AS line_no, '| place | cls | iou |' AS line UNION ALL SELECT 1, '|---|---|---|' UNION ALL SELECT 1 + place, '| ' || place || ' | ' || cls || ' | ' || coalesce(printf('%.4f', iou), '-') || ' |' FROM rk",
    "readme_injected": "SELECT r_regionkey, CASE WHEN r_regionkey % 2 = 1 THEN r_name || '<!-- eval:start -->x<!-- eval:end -->' ELSE r_name || chr(10) || chr(10) || '<!-- eval:start -->' || chr(10) || '| a |' || chr(10) || '<!-- eval:end -->' || chr(10) END AS text FROM region",
    "class_table": "SELECT cls::INT AS cls, name, color FROM (VALUES (0, 'drivable', '#22c55e'), (1, 'rough', '#123456'), (2, 'static_obstacle', '#ef4444'), (3, 'dynamic_object', '#abcdef')) t(cls, name, color)",
    "config_resolved": "SELECT section, name, value::DOUBLE AS value FROM (VALUES ('grid', 'r_min', 0.5), ('grid', 'r_max', 50), ('grid', 'dr_0', 0.2), ('grid', 'r_transition', 50), ('grid', 'alpha', 1.004994), ('grid', 'n_theta', 720), ('stream', 'native_hz', 5), ('stream', 'snapshot_interval', 5), ('stream', 'stats_interval', 4), ('stream', 'cloud_frames', 30), ('stream', 'cloud_max', 60000), ('traversability', 'enabled', 0)) t(section, name, value)",
    "synthetic_scans": "SELECT frame::INT AS frame, 2000::BIGINT AS n, true AS inside, true AS repeats, 4::BIGINT AS classes FROM range(6) t(frame)",
    "tar_shards": f"WITH {queries_image._NEAREST}, fr AS (SELECT frame, row_number() OVER (ORDER BY frame) - 1 AS k FROM (SELECT DISTINCT frame FROM im)) SELECT printf('shard-%06d.tar', k // 2) AS shard, k AS key, row, col, cls AS label, round(remission, 2) AS ch4 FROM im JOIN fr USING (frame)",
    "shard_overwrite": "SELECT 'train' AS split, n_nationkey::BIGINT // 10 AS shard, count(*) AS n, true AS refused FROM nation WHERE n_nationkey < 20 GROUP BY ALL",
    "etl_mask": f"WITH {_KEPT} SELECT frame, cls5, count(*) AS n, round(max(rng), 6) AS farthest FROM kept GROUP BY ALL",
    "split_metadata": f"WITH {_KEPT} SELECT split, count(DISTINCT frame) AS n_frames, {', '.join(f'count(*) FILTER (cls5 = {k}) AS c{k}' for k in range(5))} FROM kept GROUP BY split",
    "shard_metadata": f"WITH {_KEPT}, n AS (SELECT k::INT AS cls, count(cls5) AS n FROM range(5) t(k) LEFT JOIN kept ON cls5 = k GROUP BY k), w AS (SELECT cls, n, 1 / sqrt(least(greatest(n / sum(n) OVER (), 1e-6), 1.0)) AS raw FROM n) SELECT (SELECT count(DISTINCT frame) FROM kept WHERE split = 'train') AS n_train, (SELECT count(DISTINCT frame) FROM kept WHERE split = 'val') AS n_val, 'float16' AS image_dtype, 'uint8' AS label_dtype, cls, n, round(least(greatest(raw / median(raw) OVER (), 0.1), 5.0), 6) AS weight FROM w",
    "sample_stream": f"WITH {_ASSIGN} SELECT count(*) AS n, true AS near, (count(*) * (count(*) + 1) // 2)::BIGINT AS places, count(*) AS distinct_places, count(*) AS last_place, true AS moved FROM f0",
    "batches": f"WITH {_ASSIGN}, k AS (SELECT frame, row_number() OVER (ORDER BY frame) - 1 AS k FROM f0) SELECT k // 64 AS batch, count(*) AS n, min(frame) AS first_frame, max(frame) AS last_frame, max(k % 64)::INT AS last_item FROM k WHERE k < 1280 GROUP BY ALL",
    "delta_messages": f"WITH {_DELTAS} SELECT seq_id, 4::BIGINT AS epoch, frame, 'delta' AS kind, CASE WHEN op = 'freed' THEN op ELSE 'sent' END AS op, ring, sector, round(z_max::FLOAT::DOUBLE, 4) AS z_max, CASE WHEN op <> 'freed' THEN 0.5::DOUBLE END AS trav, cls FROM dl",
    "json_snapshots": f"""WITH {sql.EVENTS}, sn AS (SELECT seq_id, frame, cell // 720 AS ring, cell % 720 AS sector, round(z_max, 2) AS z, cls FROM ev WHERE op = 'snapshot')
SELECT seq_id, frame, '{{"type":"snapshot","frame":' || frame || ',"cells":[' || string_agg('[' || ring::DOUBLE || ',' || sector::DOUBLE || ',' || z || ',' || z || ',1.0,0.5,' || cls::DOUBLE || ']', ',' ORDER BY ring, sector) || ']}}' AS message FROM sn GROUP BY seq_id, frame""",
    "json_deltas": f"""WITH {_DELTAS}, x AS (SELECT *, round(z_max, 2) AS z FROM dl) SELECT seq_id, frame, '{{"type":"delta","frame":' || frame || ',"updated":[' || coalesce(string_agg('[' || ring::DOUBLE || ',' || sector::DOUBLE || ',' || z || ',' || z || ',1.0,0.5]', ',' ORDER BY ring, sector) FILTER (op <> 'freed'), '') || '],"freed":[' || coalesce(string_agg('[' || ring::DOUBLE || ',' || sector::DOUBLE || ']', ',' ORDER BY ring, sector) FILTER (op = 'freed'), '') || ']}}' AS message FROM x GROUP BY seq_id, frame""",
    "grid_meta": "SELECT 'grid_meta' AS type, 0.5::DOUBLE AS r_min, 100.0::DOUBLE AS r_max, 10.0::DOUBLE AS r_transition, 1.004994::DOUBLE AS alpha, 0.05::DOUBLE AS dr_0, 652::INT AS n_rings, 190::INT AS phase1_rings, 720::INT AS n_theta, 4::INT AS n_classes, cls, color FROM (VALUES ('0', '#22c55e'), ('1', '#a16207'), ('2', '#ef4444'), ('3', '#3b82f6')) t(cls, color)",
    "stats_cadence": """WITH n AS (SELECT row_number() OVER (ORDER BY ts, event_id) AS frame, event_type AS stage FROM events) SELECT '{"type":"stats","frame":' || frame || ',"stage":"' || stage || '"}' AS message FROM n WHERE frame % 2 = 0""",
    "cloud_messages": f"""WITH {queries_grid._WORLD_SEQ}, {queries_grid._clouds("seq_id, frame", 3, 2000)},
z AS (SELECT h.seq_id, h.tick AS frame, h.cls, round_even(degrees(atan2(c, -a20)) * 100, 0)::INT AS yaw_cd, round_even((wx - tx) * c + (wy - ty) * s + wz * a20, 2) AS x, round_even(-(wx - tx) * s + (wy - ty) * c, 2) AS y, round_even(wz, 2) - 0.125::DOUBLE * h.tick AS z FROM h JOIN po ON po.seq_id = h.seq_id AND po.pose_id = h.tick % po.n_poses)
SELECT seq_id, 2::BIGINT AS epoch, frame, yaw_cd, cls, count(*) AS n, {', '.join(f'round(sum(round({c}::FLOAT::DOUBLE, 3)::DECIMAL(18,3))::DOUBLE, 1) AS sum_{c}' for c in 'xyz')} FROM z GROUP BY ALL""",
    "cloud_reassembly": f"WITH {sql.POINTS}, s AS (SELECT DISTINCT frame, (pid // 500)::INT AS seq FROM p), t AS (SELECT *, count(*) OVER (PARTITION BY frame) AS total FROM s) SELECT '00' AS seq_id, frame, total::INT AS total FROM t WHERE NOT (frame % 4 = 0 AND seq % 2 = 1) GROUP BY frame, total HAVING count(*) = total",
    "queue_delivery": """WITH RECURSIVE q AS (SELECT 0 AS frame, true AS delivered, 0 AS held UNION ALL
SELECT frame + 1, x.ok, CASE WHEN (frame + 1) % 4 = 0 THEN 0 WHEN x.ok THEN held + x.m ELSE 0 END FROM q, LATERAL (SELECT (q.frame + 1) % 3 + 1 AS m, q.held + (q.frame + 1) % 3 + 1 <= 5 AS ok) x WHERE frame < (SELECT count(*) FROM nation))
SELECT frame::INT AS frame, delivered FROM q WHERE frame > 0""",
    "fan_out": "SELECT client, n, last FROM (SELECT 'a' AS client, count(*) AS n, arg_max(n_name, n_nationkey) AS last FROM nation UNION ALL SELECT 'c', count(*), arg_max(n_name, n_nationkey) FROM nation UNION ALL SELECT 'b', 3, arg_max(n_name, n_nationkey) FROM nation WHERE n_nationkey < 3)",
    "player_controls": "SELECT turn::BIGINT AS turn, what, seq_id, epoch::INT AS epoch, frame::INT AS frame, speed::DOUBLE AS speed, cloud FROM (VALUES (0, 'preview', '00', 1, 9, 0, false), (1, 'start', '00', 1, 9, 1, false), (2, 'stop', '', -1, -1, 0, false), (3, 'start', '00', 1, 6, 2, false), (4, 'stop', '', -1, -1, 0, false), (5, 'start', '00', 1, 6, 2, true), (6, 'stop', '', -1, -1, 0, false), (7, 'start', '01', 2, 0, 2, true), (8, 'stop', '', -1, -1, 0, false)) t(turn, what, seq_id, epoch, frame, speed, cloud)",
    "paced_intervals": "SELECT speed::DOUBLE AS speed, (100 / speed)::INT || ' milliseconds' AS trigger FROM (VALUES (0.1), (0.5), (1.0), (2.0), (10.0)) t(speed)",
    "stream_seek": f"WITH {sql.POINTS} SELECT 1::BIGINT AS epoch, frame, count(*) AS n FROM p WHERE frame >= 3 GROUP BY frame",
    "stream_restart": f"WITH {sql.POINTS} SELECT frame, count(*) AS n, sum(pid)::BIGINT AS pids FROM p GROUP BY frame",
    "segment_rules": f"WITH {sql.XYZ} SELECT frame, CASE WHEN z < 0.2 THEN (remission > 0.6)::INT WHEN z > 2.5 THEN 2 WHEN remission > 0.6 THEN 3 ELSE 2 END::INT AS cls5, count(*) AS n FROM xyz GROUP BY ALL",
    "pixel_eval": f"WITH {queries_image._NEAREST}, e5 AS (SELECT im.*, (SELECT arg_min(k, abs(im.z - (k * 0.74 - 2))) FROM range(5) t(k)) AS best FROM im) SELECT cls AS t, best::INT AS p, count(*) AS n FROM e5 GROUP BY ALL",
}
