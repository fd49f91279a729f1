"""Accumulated clouds over poses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polargrain.functions import projection as proj
from polargrain.plans.config import StreamParams

KEYS = ("seq_id", "frame")


def with_pose(points: DataFrame, poses: DataFrame, frame: str = "frame") -> DataFrame:
    """Joins each frame's pose, the pose list of its sequence repeating.

    ``poses`` has (pose_id, pose), for all sequences alike, or (seq_id, pose_id, pose). It holds
    one row a pose; Spark broadcasts it if its size allows.
    """
    own = ["seq_id"] if "seq_id" in poses.columns else []
    sizes = poses.groupBy(*own).agg(F.count(F.lit(1)).alias("n_poses"))
    counted = points.join(sizes, own) if own else points.crossJoin(F.broadcast(sizes))  # the latter is one row
    placed = counted.withColumn("pose_id", F.pmod(F.col(frame), F.col("n_poses")).cast("int"))
    return placed.join(poses, [*own, "pose_id"]).drop("n_poses")


def world_points(points: DataFrame, poses: DataFrame) -> DataFrame:
    posed = with_pose(points, poses)
    return posed.select(*points.columns, *proj.to_world())


def accumulate(world: DataFrame, poses: DataFrame, s: StreamParams) -> DataFrame:
    """For each frame the points of its sequence's last ``cloud_frames`` frames, thinned, in the frame's own axes.

    The stride of a frame's cloud keeps it at ``cloud_max`` points or less; every frame is
    thinned on its own order, and the oldest points stay on truncation. Strides are found on
    one row a frame, so a point is copied only to the clouds that keep it.
    """
    seq, frame = KEYS
    sizes = world.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    looks = sizes.withColumn("at", F.explode(F.sequence(F.col(frame), F.col(frame) + (s.cloud_frames - 1)))).join(sizes.select(seq, F.col(frame).alias("at")), [seq, "at"], "left_semi")
    totals = looks.groupBy(seq, "at").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / s.cloud_max)).cast("long").alias("stride"))
    clouds = looks.join(totals, [seq, "at"]).groupBy(*KEYS).agg(F.collect_list(F.struct("at", "stride")).alias("clouds"))
    numbered = world.withColumn("k", F.row_number().over(Window.partitionBy(*KEYS).orderBy("pid")) - 1)
    kept = F.filter("clouds", lambda c: F.pmod(F.col("k"), c["stride"]) == 0)
    copies = numbered.join(clouds, list(KEYS)).withColumn("at", F.explode(F.transform(kept, lambda c: c["at"]))).drop("clouds")
    cap = Window.partitionBy(seq, "at").orderBy(frame, "k")
    held = copies.withColumn("place", F.row_number().over(cap)).filter(F.col("place") <= s.cloud_max)
    return with_pose(held, poses, "at").select(seq, "at", frame, "pid", "cls", *proj.to_ego())


def stride_sample(points: DataFrame, most: int, keys: tuple[str, ...] = ("frame",), order: str = "pid") -> DataFrame:
    """Every stride-th point of each frame, at most ``most``."""
    whole = Window.partitionBy(*keys)
    numbered = points.withColumn("k", F.row_number().over(whole.orderBy(order)) - 1).withColumn("total", F.count(F.lit(1)).over(whole))
    stride = F.greatest(F.lit(1), F.ceil(F.col("total") / most)).cast("long")
    return numbered.withColumn("stride", stride).filter(F.pmod("k", F.col("stride")) == 0).drop("k", "total")


def shown_cloud(cloud: DataFrame, ground: DataFrame) -> DataFrame:
    """Client coordinates: rounded to centimetres, then heights above the ground."""
    joined = cloud.join(ground.select("seq_id", F.col("frame").alias("at"), "ground_z"), ["seq_id", "at"])
    return joined.select("seq_id", "at", "frame", "pid", "cls", proj.cloud_rounded(F.col("ex")).alias("x"), proj.cloud_rounded(F.col("ey")).alias("y"), (proj.cloud_rounded(F.col("ez")) - F.col("ground_z")).alias("z"))


def headings(frames: DataFrame, poses: DataFrame) -> DataFrame:
    posed = with_pose(frames, poses)
    return posed.select(*frames.columns, proj.yaw_centidegrees(F.get("pose", F.lit(0)), F.get("pose", F.lit(8))).alias("yaw_cd"))
