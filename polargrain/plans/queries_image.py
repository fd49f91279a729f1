"""Queries on range images, labels and shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polargrain.functions import labels
from polargrain.functions import projection as proj
from polargrain.operators import etl, images
from polargrain.plans import sql
from polargrain.plans.config import ProjectionParams
from polargrain.plans.queries_grid import r6
from polargrain.sources import testviews as views

P = ProjectionParams()
ORDER = ("rng", "pid", "k1", "k2", "z")


def _projected(spark: SparkSession, d: str) -> DataFrame:
    return proj.project(views.xyz(spark, d), P)


def project_pixels(spark: SparkSession, d: str) -> DataFrame:
    return _projected(spark, d).select("frame", "pid", F.col("k1").alias("part"), F.col("k2").alias("supp"), r6("rng"), "row", "col")


def range_image_nearest(spark: SparkSession, d: str) -> DataFrame:
    image = images.range_image(views.xyz(spark, d), P, order=ORDER)
    return image.select("frame", "row", "col", "pid", *[r6(f"ch{k}") for k in range(5)])


def label_image_nearest(spark: SparkSession, d: str) -> DataFrame:
    return images.label_image(views.xyz(spark, d), P, label="cls", order=ORDER).select("frame", "row", "col", "label")


def augment_flip(spark: SparkSession, d: str) -> DataFrame:
    pixels = images.label_image(views.xyz(spark, d), P, label="cls", order=ORDER)
    return images.flipped(pixels, P, probability=1.0).select("frame", "row", "col", "label")


def label_remap(spark: SparkSession, d: str) -> DataFrame:
    rows = views.raw_labels(spark, d).withColumn("cls5", labels.remap(labels.semantic(F.col("raw_label"))).cast("int"))
    return rows.groupBy("raw_label", "cls5").agg(F.count(F.lit(1)).alias("n"))


def bin_5_to_4(spark: SparkSession, d: str) -> DataFrame:
    rows = views.raw_labels(spark, d).withColumn("cls4", labels.bin_5_to_4(labels.remap(labels.semantic(F.col("raw_label")))).cast("int"))
    return rows.groupBy("frame", "cls4").agg(F.count(F.lit(1)).alias("n"))


def _five(spark: SparkSession, d: str) -> DataFrame:
    return views.raw_labels(spark, d).withColumn("cls5", labels.remap(labels.semantic(F.col("raw_label"))))


def class_histogram(spark: SparkSession, d: str) -> DataFrame:
    return labels.class_counts(_five(spark, d))


def class_weights(spark: SparkSession, d: str) -> DataFrame:
    return labels.class_weights(labels.class_counts(_five(spark, d))).select("cls", "n", r6("weight"))


def shard_assignment(spark: SparkSession, d: str) -> DataFrame:
    frames = spark.read.parquet(f"{d}/orders.parquet").select(F.pmod("o_custkey", F.lit(5)).cast("string").alias("seq_id"), F.col("o_orderkey").alias("frame")).distinct()
    return etl.shard_assignment(frames).select("seq_id", "frame", "shard", F.col("sample").cast("long").alias("sample"))


def softmax_argmax(spark: SparkSession, d: str) -> DataFrame:
    rows = views.logits(spark, d).withColumn("probs", proj.softmax(F.col("logits")))
    return rows.select("vec_id", *[r6(f"p{k}", F.get("probs", F.lit(k))) for k in range(5)], proj.argmax(F.col("logits")).alias("cls5"))


def vote_3x3(spark: SparkSession, d: str) -> DataFrame:
    # dense images of 20 x 25 pixels, 500 embeddings each
    p = ProjectionParams(h=20, w=25)
    v, inside = views.logits(spark, d), F.pmod("vec_id", F.lit(500))
    frame, row, col = F.floor(F.col("vec_id") / 500).cast("int"), F.floor(inside / 25).cast("int"), F.pmod(inside, F.lit(25)).cast("int")
    pixels = v.select(frame.alias("frame"), row.alias("row"), col.alias("col"), proj.softmax(F.col("logits")).alias("probs"))
    points = v.select(frame.alias("frame"), row.alias("row"), col.alias("col"), F.col("vec_id").alias("pid"))
    voted = images.vote_3x3(points, pixels, p)
    return voted.select("pid", *[r6(f"p{k}", F.get("probs", F.lit(k))) for k in range(5)], "cls5")


QUERIES = {f.__name__: f for f in (project_pixels, range_image_nearest, label_image_nearest, augment_flip, label_remap, bin_5_to_4, class_histogram, class_weights, shard_assignment, softmax_argmax, vote_3x3)}

_NEAREST = f"{sql.PROJECTED}, best AS (SELECT *, row_number() OVER (PARTITION BY frame, row, col ORDER BY rng, pid, k1, k2, z) AS rn FROM pj), im AS (SELECT * FROM best WHERE rn = 1)"
_MAP = "MAP {" + ", ".join(f"{k}: {v}" for k, v in labels.RAW_TO_FIVE.items()) + "}"
_FIVE = f"l0 AS (SELECT l_partkey % 260 AS raw_label, l_linenumber AS frame FROM lineitem), l AS (SELECT *, coalesce({_MAP}[((raw_label & 65535) & 255)::INT], 255)::INT AS cls5 FROM l0)"
_COUNTS = f"{_FIVE}, n AS (SELECT k::INT AS cls, count(cls5) AS n FROM range(5) t(k) LEFT JOIN l ON cls5 = k GROUP BY k)"
_SOFT = "x AS (SELECT vec_id, list_transform(embedding[1:5], lambda v: v::DOUBLE) AS v FROM embeddings), ex AS (SELECT vec_id, v, list_transform(v, lambda q: exp(q - list_max(v))) AS e FROM x), sm AS (SELECT vec_id, v, list_transform(e, lambda q: q / list_sum(e)) AS p FROM ex)"
ORACLE_SQL = {
    "project_pixels": f"WITH {sql.PROJECTED} SELECT frame, pid, k1 AS part, k2 AS supp, round(rng, 6) AS rng, row, col FROM pj",
    "range_image_nearest": f"WITH {_NEAREST} SELECT frame, row, col, pid, round(rng / 80, 6) AS ch0, round(x / 80, 6) AS ch1, round(y / 80, 6) AS ch2, round(z / 80, 6) AS ch3, round(remission, 6) AS ch4 FROM im",
    "label_image_nearest": f"WITH {_NEAREST} SELECT frame, row, col, cls AS label FROM im",
    "augment_flip": f"WITH {_NEAREST} SELECT frame, row, (2047 - col)::INT AS col, cls AS label FROM im",
    "label_remap": f"WITH {_FIVE} SELECT raw_label, cls5, count(*) AS n FROM l GROUP BY ALL",
    "bin_5_to_4": f"WITH {_FIVE} SELECT frame, CASE WHEN cls5 = 255 THEN 255 ELSE least(cls5, 3) END::INT AS cls4, count(*) AS n FROM l GROUP BY ALL",
    "class_histogram": f"WITH {_COUNTS} SELECT cls, n FROM n",
    "class_weights": f"WITH {_COUNTS}, w AS (SELECT cls, n, 1 / sqrt(least(greatest(n / sum(n) OVER (), 1e-6), 1.0)) AS raw FROM n) SELECT cls, n, round(least(greatest(raw / median(raw) OVER (), 0.1), 5.0), 6) AS weight FROM w",
    "shard_assignment": "WITH f AS (SELECT DISTINCT (o_custkey % 5)::VARCHAR AS seq_id, o_orderkey AS frame FROM orders) SELECT seq_id, frame, (row_number() OVER (ORDER BY seq_id, frame) - 1) // 200 AS shard, row_number() OVER (PARTITION BY seq_id ORDER BY frame) - 1 AS sample FROM f",
    "softmax_argmax": f"WITH {_SOFT} SELECT vec_id, {', '.join(f'round(p[{k + 1}], 6) AS p{k}' for k in range(5))}, (list_position(v, list_max(v)) - 1)::INT AS cls5 FROM sm",
    "vote_3x3": f"""WITH {_SOFT}, px AS (SELECT vec_id, vec_id // 500 AS f, vec_id % 500 // 25 AS r, vec_id % 25 AS c, p FROM sm),
o AS (SELECT i, j FROM range(-1, 2) a(i), range(-1, 2) b(j)), g AS (SELECT px.vec_id AS pid, f, least(greatest(r + i, 0), 19) AS r, least(greatest(c + j, 0), 24) AS c FROM px, o),
m AS (SELECT pid, {', '.join(f'sum(coalesce(p[{k + 1}], 0)) / 9 AS p{k}' for k in range(5))} FROM g LEFT JOIN px USING (f, r, c) GROUP BY pid)
SELECT pid, {', '.join(f'round(p{k}, 6) AS p{k}' for k in range(5))}, (list_position([p0, p1, p2, p3, p4], greatest(p0, p1, p2, p3, p4)) - 1)::INT AS cls5 FROM m""",
}
