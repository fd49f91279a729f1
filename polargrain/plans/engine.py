"""One object for the engine's operations under one configuration."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polargrain.functions import geometry, labels
from polargrain.operators import cloud, delta, etl, grid, metrics
from polargrain.operators.segment import RuleSegmenter, Segmenter
from polargrain.plans.config import EngineConfig
from polargrain.sources import kitti, sinks, wire


class Engine:
    """Scans to cells, events, messages, shards and scores.

    Relations are DataFrames; nothing runs before a result is asked for. ``points`` have
    seq_id, frame, pid, x, y, z and, for cells, ``cls`` (four classes).
    """

    KEYS = ("seq_id", "frame")

    def __init__(self, spark: SparkSession, config: EngineConfig | None = None, segmenter: Segmenter | None = None):
        self.spark, self.config, self.segmenter = spark, config or EngineConfig(), segmenter or RuleSegmenter()

    # sources
    def sequences(self, root: str) -> DataFrame:
        return kitti.sequence_catalog(self.spark, root)

    def scans(self, root: str, seq_ids: list[str] | None = None, frames: tuple[int, int] | None = None) -> DataFrame:
        return kitti.read_scans(self.spark, root, seq_ids, frames)

    def history(self, path: str) -> DataFrame:
        """Validation records, the last of each step."""
        rows = kitti.read_history(self.spark, path).withColumn("line_no", F.monotonically_increasing_id())
        return metrics.history_latest(rows).drop("line_no").orderBy("step")

    def evaluation(self, folder: str) -> DataFrame | None:
        return kitti.read_newest_eval(self.spark, folder)

    # grid
    def classified(self, points: DataFrame) -> DataFrame:
        """Points with cls from the segmenter, binned to four classes."""
        return self.segmenter.segment(points).withColumn("cls", labels.bin_5_to_4(F.col("cls5")).cast("int"))

    def locate(self, points: DataFrame) -> DataFrame:
        """ring, sector, cell and validity of (x, y)."""
        return geometry.xy_cells(points, self.config.grid)

    def ground(self, points: DataFrame) -> DataFrame:
        polar = points.withColumn("r", geometry.planar_range(F.col("x"), F.col("y")))
        return grid.ground_reference(polar, self.config.ground, ("frame",), ("seq_id",))

    def cells(self, points: DataFrame) -> DataFrame:
        """Cells with heights above the ground, traversability and tier."""
        rows = grid.cells(points, self.config.grid, self.KEYS)
        return grid.with_traversability(rows, self.ground(points), self.config.grid, self.config.traversability, self.KEYS)

    def memory_report(self, cells: DataFrame) -> DataFrame:
        return grid.memory_report(cells, self.config.grid, self.config.memory, self.KEYS)

    def snapshot(self, cells: DataFrame, seq_id: str, frame: int) -> DataFrame:
        """Client rows of one frame, without any effect on what was sent."""
        one = cells.filter((F.col("seq_id") == seq_id) & (F.col("frame") == frame))
        return grid.rebased(grid.rendered(one, self.config.grid))

    # deltas
    def schedule(self, frames: DataFrame) -> DataFrame:
        """(seq_id, frame, delivered); source frames without kept points take no number."""
        return delta.delivery_schedule(frames, self.config.stream)

    def events(self, cells: DataFrame, schedule: DataFrame) -> DataFrame:
        return delta.events(grid.rendered(cells, self.config.grid), schedule, self.config.stream)

    def numbered(self, cells: DataFrame) -> DataFrame:
        """Cells with grid frame numbers from 1 over the frames that have any; the old number stays in source_frame."""
        frames = cells.select(*self.KEYS).distinct()
        number = F.row_number().over(Window.partitionBy("seq_id").orderBy("frame")).cast("int")
        renamed = frames.withColumn("grid_frame", number)
        return cells.join(renamed, list(self.KEYS)).withColumnRenamed("frame", "source_frame").withColumnRenamed("grid_frame", "frame")

    def messages(self, cells: DataFrame, schedule: DataFrame, epoch: int = 0, compress: bool = True, poses: DataFrame | None = None) -> DataFrame:
        """Binary messages of every delivered frame, with its heading where there are poses."""
        told = self.events(cells, schedule)
        rows = grid.rebased(cells).select(*self.KEYS, "cell", "ring", "sector", "z_mean", F.col("z_max").alias("shown"), "occ", "trav")
        n = self.config.grid.n_theta
        sent = told.filter("op <> 'freed'").drop("z_max").join(rows, [*self.KEYS, "cell"]).withColumnRenamed("shown", "z_max")
        gone = told.filter("op = 'freed'").select(*self.KEYS, "cell", "op", "cls", geometry.ring_of(F.col("cell"), self.config.grid).alias("ring"), F.pmod("cell", F.lit(n)).cast("int").alias("sector"), *[F.lit(None).cast("double").alias(c) for c in ("z_mean", "z_max", "occ", "trav")])
        both = sent.select(gone.columns).unionByName(gone).withColumn("epoch", F.lit(epoch).cast("long"))
        sent_frames = schedule.filter("delivered").select("seq_id", "frame", "kind")
        yaw = sent_frames.withColumn("yaw_cd", F.lit(0)) if poses is None else cloud.headings(sent_frames, poses)
        frames = yaw.select("seq_id", F.lit(epoch).cast("long").alias("epoch"), "frame", "kind", F.col("yaw_cd").cast("int").alias("yaw_cd"))
        return wire.pack(frames, both, compress)

    def client_cells(self, told: DataFrame, schedule: DataFrame) -> DataFrame:
        return delta.materialize(told, schedule)

    def accumulated_cloud(self, points: DataFrame, poses: DataFrame) -> DataFrame:
        """Clouds of the last frames of every sequence; ``poses`` may be keyed by sequence."""
        return cloud.accumulate(cloud.world_points(points, poses), poses, self.config.stream)

    def cloud_messages(self, points: DataFrame, poses: DataFrame, ground: DataFrame, epoch: int = 0, compress: bool = True) -> DataFrame:
        """Binary cloud messages of every frame, in client coordinates and with its heading."""
        shown = cloud.shown_cloud(self.accumulated_cloud(points, poses), ground).drop("frame").withColumnRenamed("at", "frame")
        yaw = cloud.headings(shown.select(*self.KEYS).distinct(), poses)
        return wire.pack_clouds(shown.withColumn("epoch", F.lit(epoch).cast("long")), yaw, compress)

    def stats(self, frame_stats: DataFrame) -> DataFrame:
        """Statistics messages, one every ``stats_interval`` frames."""
        due = frame_stats.filter(F.pmod("frame", F.lit(max(1, self.config.stream.stats_interval))) == 0)
        return wire.json_rows(due, "stats")

    # offline jobs
    def write_training_shards(self, root: str, out: str, split: str, seq_ids: list[str] | None = None, mode: str = "errorifexists", size: int = etl.SHARD_SIZE) -> DataFrame:
        """Dense images and labels as shards; the metadata row."""
        from polargrain.operators import images

        read = kitti.read_labelled_scans(self.spark, root, seq_ids).withColumn("cls5", labels.remap(labels.semantic(F.col("raw_label"))))
        kept = etl.training_points(read, self.config.projection)
        pixels = etl.training_pixels(kept, self.config.projection)
        assignment = etl.shard_assignment(kept.select(*self.KEYS).distinct(), size=size)
        etl.write_shards(images.dense_images(pixels, self.config.projection, self.KEYS), assignment, out, split, mode)
        meta = etl.shard_metadata(kept.withColumn("split", F.lit(split)))
        sinks.write_json(meta, f"{out.rstrip('/')}_meta_{split}", "overwrite" if mode == "overwrite" else mode)
        return meta

    def evaluate(self, pairs: DataFrame) -> DataFrame:
        """(t, p, rng) to one nested row of scores by scheme and band."""
        counts = metrics.banded_confusion(pairs)
        five = metrics.iou(counts.filter("scheme = 5").drop("scheme"), 5, ("band",)).withColumn("scheme", F.lit(5))
        four = metrics.iou(counts.filter("scheme = 4").drop("scheme"), 4, ("band",)).withColumn("scheme", F.lit(4))
        ious = five.unionByName(four)
        return sinks.eval_result(ious, metrics.miou(ious, ("scheme", "band")), counts)


def onnx_model(path: str) -> Callable[[], Callable]:
    """A loader for the model segmenter: an ONNX file from (n, 5, h, w) to (n, classes, h, w)."""

    def load():
        import onnxruntime

        if not os.path.exists(path):
            raise FileNotFoundError(path)
        session = onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])
        name = session.get_inputs()[0].name
        return lambda batch: session.run(None, {name: batch})[0]

    return load
