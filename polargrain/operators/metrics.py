"""Evaluation and performance metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polargrain.functions import display
from polargrain.functions.labels import bin_5_to_4
from polargrain.operators import ordered
from polargrain.plans.config import UNKNOWN


def confusion(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(t, p, n) over rows whose target counts."""
    return pairs.filter(F.col("t") != UNKNOWN).groupBy(*by, "t", "p").agg(F.count(F.lit(1)).alias("n"))


def banded_confusion(pairs: DataFrame) -> DataFrame:
    """Five- and four-class confusions, overall (band 'all') and by distance band: one shuffle.

    Overall includes ranges beyond the last band. The four-class counts roll up the five-class
    ones, so points are scanned and shuffled once.
    """
    valid = pairs.filter(F.col("t") != UNKNOWN).withColumn("band", display.distance_band(F.col("rng")))
    five = valid.groupBy(F.coalesce("band", F.lit("beyond")).alias("band"), "t", "p").agg(F.count(F.lit(1)).alias("n"))
    both = five.withColumn("s", F.explode(F.array(F.lit(5), F.lit(4)))).withColumn("b", F.explode(F.array(F.lit("all"), F.col("band")))).filter("b <> 'beyond'")
    t, p = (F.when(F.col("s") == 4, bin_5_to_4(F.col(c)).cast("int")).otherwise(F.col(c)) for c in ("t", "p"))
    return both.groupBy(F.col("s").alias("scheme"), F.col("b").alias("band"), t.alias("t"), p.alias("p")).agg(F.sum("n").alias("n"))


def iou(counts: DataFrame, classes: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Intersection over union of every class; null where a class has no target and no prediction."""
    both = counts.select(*by, F.explode(F.array(F.struct(F.col("t").alias("cls"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("i"), F.col("n").alias("u")), F.struct(F.col("p").alias("cls"), F.lit(0).cast("long").alias("i"), F.when(F.col("t") == F.col("p"), 0).otherwise(F.col("n")).alias("u")))).alias("e"))
    sums = both.groupBy(*by, "e.cls").agg(F.sum("e.i").alias("inter"), F.sum("e.u").alias("uni"))
    spark = counts.sparkSession
    every = spark.range(classes).select(F.col("id").cast("int").alias("cls"))
    if by:
        every = counts.select(*by).distinct().crossJoin(F.broadcast(every))
    full = every.join(sums.withColumn("cls", F.col("cls").cast("int")), [*by, "cls"], "left")
    return full.select(*by, "cls", F.when(F.col("uni") > 0, F.col("inter") / F.col("uni")).alias("iou"))


def miou(ious: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean over classes that occur; zero if none does."""
    return ious.groupBy(*by).agg(F.coalesce(F.avg("iou"), F.lit(0.0)).alias("miou"))


def row_normalized(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    total = F.sum("n").over(Window.partitionBy(*by, "t"))
    return counts.withColumn("share", F.col("n") / F.greatest(total, F.lit(1)))


def confusion_matrix(counts: DataFrame, classes: int) -> DataFrame:
    """One row a target class, one column a predicted class."""
    return counts.groupBy("t").pivot("p", list(range(classes))).agg(F.sum("n")).na.fill(0)


def latency_stats(rows: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean, population deviation, extremes, median and 90th percentile; zeros if empty."""
    v = F.col(value)
    parts = {"mean": F.avg(v), "std": F.stddev_pop(v), "min": F.min(v), "max": F.max(v), "median": F.percentile(v, F.lit(0.5)), "p90": F.percentile(v, F.lit(0.9))}
    return rows.groupBy(*by).agg(F.count(v).alias("n"), *[F.coalesce(c, F.lit(0.0)).alias(k) for k, c in parts.items()])


def perf_window(rows: DataFrame, value: str, order: list[str], by: tuple[str, ...] = (), length: int = 100, block: int = 2000) -> DataFrame:
    """Mean, rate, median and 95th percentile over the last ``length`` rows of each series.

    A series is dealt in blocks of ``block`` rows; a block also gets the ``length - 1`` rows
    before it. Percentiles read one sorted array a row, interpolating between neighbours.
    """
    numbered = ordered.numbered(rows, by, order, "__rn")
    home = F.floor((F.col("__rn") - 1) / block).cast("long")
    ahead = (F.pmod(F.col("__rn") - 1, F.lit(block)) >= block - length + 1) & F.lit(length > 1)
    dealt = numbered.withColumn("__home", home).withColumn("__block", F.explode(F.when(ahead, F.array("__home", F.col("__home") + 1)).otherwise(F.array("__home"))))
    w = Window.partitionBy(*by, "__block").orderBy("__rn").rowsBetween(1 - length, 0)
    held = dealt.withColumn("mean_ms", F.avg(value).over(w)).withColumn("__held", F.sort_array(F.collect_list(value).over(w)))
    place = lambda q: q * (F.size("__held") - 1)
    low = lambda q: F.get("__held", F.floor(place(q)).cast("int"))
    high = lambda q: F.get("__held", F.ceil(place(q)).cast("int"))
    share = lambda q: place(q) - F.floor(place(q))
    own = held.filter(F.col("__block") == F.col("__home"))
    added = {name: (1 - share(q)) * low(q) + share(q) * high(q) for name, q in (("p50_ms", F.lit(0.5)), ("p95_ms", F.lit(0.95)))}
    return own.withColumns({"fps": display.fps(F.col("mean_ms")), **added}).drop("__rn", "__home", "__block", "__held")


def perf_buckets(rows: DataFrame, value: str, order: list[str], by: tuple[str, ...] = (), every: int = 30) -> DataFrame:
    """Averages of consecutive runs of ``every`` rows."""
    numbered = ordered.numbered(rows, by, order, "__rn")
    return numbered.withColumn("bucket", F.floor((F.col("__rn") - 1) / every).cast("long")).groupBy(*by, "bucket").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_ms"))


def step_rates(rows: DataFrame, loss: str, ms: str, order: list[str], by: tuple[str, ...] = (), every: int = 50) -> DataFrame:
    """Mean loss and steps a second of consecutive runs of ``every`` training steps."""
    numbered = ordered.numbered(rows, by, order, "__rn")
    each = numbered.withColumn("bucket", F.floor((F.col("__rn") - 1) / every).cast("long")).groupBy(*by, "bucket")
    return each.agg(F.count(F.lit(1)).alias("n"), F.avg(loss).alias("mean_loss"), (F.count(F.lit(1)) * 1000.0 / F.sum(ms)).alias("steps_per_s"))


def stage_averages(rows: DataFrame, stage: str, value: str, frame: str) -> DataFrame:
    """Milliseconds a frame of every stage, and of all stages together (``total``)."""
    whole = rows.rollup(stage).agg(F.sum(value).alias("sum"), F.count_distinct(frame).alias("frames"), F.grouping(stage).alias("g"))
    return whole.select(F.when(F.col("g") == 1, "total").otherwise(F.col(stage)).alias("stage"), "frames", (F.col("sum") / F.col("frames")).alias("ms_a_frame"))


def paired(pred: DataFrame, truth: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(t, p) of every pixel that has both a target and a prediction."""
    return truth.select(*keys, F.col("label").alias("t")).join(pred.select(*keys, F.col("label").alias("p")), list(keys))


def ranked(ious: DataFrame) -> DataFrame:
    """Class scores with their place by falling value; classes without one come last."""
    order = Window.orderBy(F.desc_nulls_last("iou"), "cls")  # one row a class
    return ious.withColumn("place", F.row_number().over(order))


def perf_lines(rows: DataFrame, value: str, order: list[str], by: tuple[str, ...] = (), every: int = 30, slow_ms: float = 400.0) -> DataFrame:
    """Averages since the last line, a line after ``every`` frames or at a slow frame.

    A slow frame ends its line, so lines are runs of ``every`` frames within the stretches
    between slow frames; stretches without an end yet are left out.
    """
    whole = Window.partitionBy(*[F.col(c) for c in by] or [F.lit(0)]).orderBy(*order)
    slow = F.col(value) > slow_ms
    stretch = rows.withColumn("slow", slow).withColumn("stretch", F.coalesce(F.sum(slow.cast("int")).over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy(*by, "stretch").orderBy(*order)
    line = stretch.withColumn("line", F.floor((F.row_number().over(inside) - 1) / every).cast("long"))
    grouped = line.groupBy(*by, "stretch", "line").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_ms"), F.bool_or("slow").alias("slow"))
    return grouped.filter((F.col("n") == every) | F.col("slow"))


def peak(rows: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    return rows.groupBy(*by).agg(F.max(value).alias("peak"))


def history_latest(history: DataFrame, line: str = "line_no", by: tuple[str, ...] = ()) -> DataFrame:
    """The last record of each step, or of each step of every run."""
    others = [c for c in history.columns if c not in (*by, "step")]
    last = history.groupBy(*by, "step").agg(F.max_by(F.struct(*others), line).alias("last"))
    return last.select(*by, "step", "last.*").select(*history.columns)


def history_peak(history: DataFrame, value: str) -> DataFrame:
    return history.agg(F.max(value).alias("peak"))


def early_stop(history: DataFrame, value: str, patience: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Running best, validations since it improved, and whether training has stopped; a row a step and run."""
    order = Window.partitionBy(*[F.col(c) for c in by] or [F.lit(0)]).orderBy("step")
    before = F.max(value).over(order.rowsBetween(Window.unboundedPreceding, -1))
    better = history.withColumn("better", before.isNull() | (F.col(value) > before))
    island = better.withColumn("__island", F.sum(F.col("better").cast("int")).over(order))
    inside = Window.partitionBy(*by, "__island").orderBy("step")
    waited = island.withColumn("waited", F.row_number().over(inside) - 1).withColumn("best", F.max(value).over(order))
    return waited.withColumn("stopped", F.max(F.col("waited")).over(order) >= patience).drop("__island")


def sums_of_stage(rows: DataFrame, stage: str, value: str) -> DataFrame:
    return rows.groupBy(stage).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_ms"), F.percentile(value, F.lit(0.5)).alias("p50_ms"), F.percentile(value, F.lit(0.95)).alias("p95_ms"))


def lovasz_softmax(pixels: DataFrame, probs: str, truth: str, classes: int, slices: int = 32) -> DataFrame:
    """Published Lovasz-Softmax (cls, loss) of every class that occurs: errors by falling size against the Jaccard steps.

    Equal errors share a step, so they are counted together; their order cannot change the sum.
    """
    each = pixels.select(F.col(truth).alias("t"), F.posexplode(F.slice(probs, 1, classes)).alias("cls", "p"))
    y = (F.col("t") == F.col("cls")).cast("long")
    errors = each.select("cls", y.alias("y"), (-F.abs(y - F.col("p"))).alias("e"))
    grouped = errors.groupBy("cls", "e").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("hit"))
    summed = ordered.running(grouped, ("cls",), ["e"], "e", {"__n": F.col("n"), "__hit": F.col("hit")}, slices)
    totals = errors.groupBy("cls").agg(F.sum("y").alias("total")).filter("total > 0")  # one row a class
    joined = summed.join(totals, "cls")
    jaccard = lambda n, hit: 1 - (F.col("total") - hit) / (F.col("total") + n - hit)
    step = jaccard(F.col("__n"), F.col("__hit")) - jaccard(F.col("__n") - F.col("n"), F.col("__hit") - F.col("hit"))
    return joined.groupBy("cls").agg(F.sum(-F.col("e") * step).alias("loss"))


def segmentation_loss(pixels: DataFrame, probs: str, truth: str, weights: Column, classes: int) -> DataFrame:
    """One row: class-weighted cross-entropy, mean Lovasz over the classes that occur, and the first plus half the second.

    Pixels to ignore do not count; where the Lovasz part is not a number the cross-entropy stands alone.
    """
    valid = pixels.filter(F.col(truth) != UNKNOWN)
    w = F.get(weights, F.col(truth).cast("int"))
    entropy = valid.agg((F.sum(-w * F.log(F.greatest(F.get(probs, F.col(truth).cast("int")), F.lit(1e-12)))) / F.sum(w)).alias("cross_entropy"))
    lovasz = lovasz_softmax(valid, probs, truth, classes).agg(F.avg("loss").alias("lovasz"))
    both = entropy.crossJoin(F.broadcast(lovasz))  # one row each
    extra = F.when(F.col("lovasz").isNull() | F.isnan("lovasz"), 0.0).otherwise(F.col("lovasz"))
    return both.withColumn("loss", F.col("cross_entropy") + 0.5 * extra)
