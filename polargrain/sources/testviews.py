"""Views that map the relational test tables to the engine's relations.

Everything derives from integers and stays away from ring, sector and threshold borders, and
ranges over the largest range have six places at most, so that any SQL engine computes and
rounds the same relations.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DROPPED = (7, 14, 15)


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, pid, r, sector, theta, z, cls: polar points."""
    t = _lineitem(spark, sf_dir)
    sector = F.pmod(F.col("l_suppkey") * 7 + F.col("l_orderkey"), F.lit(36)).cast("int") * 20
    return t.select(
        F.col("l_linenumber").alias("frame"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pid"), F.col("l_partkey").alias("k1"), F.col("l_suppkey").alias("k2"),
        (F.lit(0.526) + F.lit(2.4) * F.pmod("l_partkey", F.lit(40))).alias("r"), sector.alias("sector"),
        ((sector + 0.5) * math.pi / 360 - math.pi).alias("theta"), (F.col("l_quantity") / 10 - 2).alias("z"),
        F.pmod(F.col("l_suppkey") + F.col("l_orderkey"), F.lit(4)).cast("int").alias("cls"),
    )


def xyz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """points with Cartesian coordinates at sector centres and a remission."""
    p = points(spark, sf_dir)
    return p.withColumn("x", F.col("r") * F.cos("theta")).withColumn("y", F.col("r") * F.sin("theta")).withColumn("remission", F.pmod("pid", F.lit(100)) / 100.0)


def sequence_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 frames of cells (ring, sector) with heights on a lattice of two centimetres."""
    t = _lineitem(spark, sf_dir)
    return t.select(
        F.lit("00").alias("seq_id"), (F.pmod(F.col("l_orderkey") * 31 + F.col("l_linenumber"), F.lit(24)) + 1).cast("int").alias("frame"),
        F.pmod("l_partkey", F.lit(40)).cast("int").alias("ring"), F.pmod(F.col("l_suppkey") * 7 + F.col("l_orderkey"), F.lit(12)).cast("int").alias("sector"),
        (F.lit(0.02) * F.pmod("l_quantity", F.lit(5))).alias("z"), F.pmod(F.col("l_suppkey") + F.col("l_orderkey"), F.lit(4)).cast("int").alias("cls"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """target and predicted five-class ids with ranges; frame 7 is to be ignored."""
    t = _lineitem(spark, sf_dir)
    truth = F.pmod("l_suppkey", F.lit(5)).cast("int")
    return t.select(
        F.when(F.col("l_linenumber") == 7, 255).otherwise(truth).alias("t"), F.when(F.col("l_quantity") > 10, truth).otherwise(F.pmod("l_partkey", F.lit(5)).cast("int")).alias("p"),
        (F.lit(0.526) + F.lit(2.4) * F.pmod("l_partkey", F.lit(40))).alias("rng"),
    )


def frame_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame in the order of time, stage and processing time in ms."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", "ts", F.col("event_type").alias("stage"), F.col("value").alias("proc_ms"))


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id and five logits."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select("vec_id", F.transform(F.slice("embedding", 1, 5), lambda v: v.cast("double")).alias("logits"))


def raw_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lineitem(spark, sf_dir).select(F.pmod("l_partkey", F.lit(260)).alias("raw_label"), F.col("l_linenumber").alias("frame"))


def with_sequence(points: DataFrame) -> DataFrame:
    """Points dealt to two sequences by pid."""
    return points.withColumn("seq_id", F.format_string("%02d", F.pmod("pid", F.lit(2))))


def poses(spark: SparkSession, n: int = 5, turn: float = 0.1) -> DataFrame:
    """A few poses that turn about the vertical and move forward: pose_id, row-major 4 x 4."""
    rows = []
    for k in range(n):
        a = turn * k
        rows.append((k, [math.cos(a), -math.sin(a), 0.0, 1.5 * k, math.sin(a), math.cos(a), 0.0, 0.25 * k, 0.125 * k, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]))
    return spark.createDataFrame(rows, "pose_id int, pose array<double>")


def sequence_poses(spark: SparkSession) -> DataFrame:
    """Five poses of sequence 00 and three of sequence 01, which turn the other way."""
    return poses(spark, 5).withColumn("seq_id", F.lit("00")).unionByName(poses(spark, 3, -0.2).withColumn("seq_id", F.lit("01")))
