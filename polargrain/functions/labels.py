"""Class ids: raw labels, five classes, four classes, and class weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polargrain.plans.config import UNKNOWN

# Raw label id -> five-class id; ids that are not listed map to 255.
RAW_TO_FIVE = {
    0: 255, 1: 255, 10: 3, 11: 4, 13: 3, 15: 3, 16: 3, 18: 3, 19: 3, 20: 3, 30: 4, 31: 4, 32: 4, 40: 0, 44: 0,
    48: 1, 49: 1, 50: 2, 51: 2, 52: 2, 60: 0, 70: 1, 71: 1, 72: 1, 80: 2, 81: 2, 99: 2, 254: 3, 255: 4,
}
# Five-class id -> four-class id.
FIVE_TO_FOUR = {0: 0, 1: 1, 2: 2, 3: 3, 4: 3}
# Class names and display colours.
NAMES_5 = ("drivable", "terrain_nondrivable", "static_obstacle", "dynamic_vehicle", "dynamic_pedestrian")
NAMES_4 = ("drivable", "terrain_nondrivable", "static_obstacle", "dynamic_object")
COLORS_4 = ("#22c55e", "#a16207", "#ef4444", "#3b82f6")


def _lookup(value: Column, mapping: dict[int, int]) -> Column:
    pairs = F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])
    return F.coalesce(F.try_element_at(pairs, value.cast("int")), F.lit(UNKNOWN)).cast("short")


def semantic(raw: Column) -> Column:
    """The low sixteen bits of a label word, kept in one byte."""
    return raw.bitwiseAND(F.lit(0xFFFF)).bitwiseAND(F.lit(0xFF)).cast("short")


def remap(semantic_id: Column, mapping: dict[int, int] | None = None) -> Column:
    return _lookup(semantic_id, RAW_TO_FIVE if mapping is None else mapping)


def bin_5_to_4(cls5: Column, mapping: dict[int, int] | None = None) -> Column:
    return _lookup(cls5, FIVE_TO_FOUR if mapping is None else mapping)


def class_counts(points: DataFrame, column: str = "cls5", n_classes: int = 5) -> DataFrame:
    """One row for each class, zero counts included."""
    seen = points.groupBy(F.col(column).cast("int").alias("cls")).agg(F.count(F.lit(1)).alias("n"))
    every = points.sparkSession.range(n_classes).select(F.col("id").cast("int").alias("cls"))
    return every.join(F.broadcast(seen.filter(F.col("cls").between(0, n_classes - 1))), "cls", "left").select("cls", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def class_weights(counts: DataFrame) -> DataFrame:
    """Weights from counts: one over the root of the frequency, over their median, clipped."""
    total = counts.agg(F.sum("n").alias("total"))
    freq = F.least(F.greatest(F.col("n") / F.col("total"), F.lit(1e-6)), F.lit(1.0))
    raw = counts.crossJoin(F.broadcast(total)).withColumn("raw", F.when(F.col("total") > 0, 1.0 / F.sqrt(freq)).otherwise(F.lit(1.0)))
    median = raw.agg(F.percentile("raw", F.lit(0.5)).alias("median"))  # one row a class
    weighted = raw.crossJoin(F.broadcast(median)).withColumn("weight", F.least(F.greatest(F.col("raw") / F.col("median"), F.lit(0.1)), F.lit(5.0)))
    return weighted.select("cls", "n", F.when(F.col("total") > 0, F.col("weight")).otherwise(F.lit(1.0)).alias("weight"))


def class_table(spark: SparkSession, config: dict | None = None) -> DataFrame:
    """The four classes with names and display colours; ``config`` may replace either by class id."""
    own = {int(k): v for k, v in ((config or {}).get("classes") or {}).items()}
    rows = [(k, own.get(k, {}).get("name", name), own.get(k, {}).get("color", color)) for k, (name, color) in enumerate(zip(NAMES_4, COLORS_4, strict=True))]
    return spark.createDataFrame(rows, "cls int, name string, color string")


def class_config(text: str) -> dict:
    """A YAML class configuration: ``classes`` (id to name and color), ``raw_to_five`` and ``five_to_four``."""
    import yaml

    raw = yaml.safe_load(text) or {}
    out = {"classes": {int(k): dict(v) for k, v in (raw.get("classes") or {}).items()}}
    for name, fixed in (("raw_to_five", RAW_TO_FIVE), ("five_to_four", FIVE_TO_FOUR)):
        out[name] = {int(k): int(v) for k, v in (raw.get(name) or fixed).items()}
    return out
