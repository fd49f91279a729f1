"""Range images: nearest point of every pixel, labels, augmentation, neighbourhood vote."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polargrain.functions import projection as proj
from polargrain.plans.config import UNKNOWN, ProjectionParams


def nearest(projected: DataFrame, keys: tuple[str, ...], columns: tuple[str, ...], order: tuple[str, ...] = ("rng", "pid")) -> DataFrame:
    """The nearest point's columns for every pixel; ties go to the lowest pid."""
    best = F.min_by(F.struct(*columns), F.struct(*order)).alias("best")
    return projected.groupBy(*keys, "row", "col").agg(best).select(*keys, "row", "col", "best.*")


def range_image(points: DataFrame, p: ProjectionParams, keys: tuple[str, ...] = ("frame",), order: tuple[str, ...] = ("rng", "pid")) -> DataFrame:
    """Sparse five-channel image: one row for each pixel that a point hits."""
    held = nearest(proj.project(points, p), keys, tuple(dict.fromkeys(("pid", "rng", "x", "y", "z", "remission"))), order)
    return held.select(*keys, "row", "col", "pid", *proj.channels(p))


def label_image(points: DataFrame, p: ProjectionParams, keys: tuple[str, ...] = ("frame",), label: str = "cls5", order: tuple[str, ...] = ("rng", "pid")) -> DataFrame:
    """Sparse labels; a pixel without a row is 255."""
    return nearest(proj.project(points, p), keys, (label,), order).withColumnRenamed(label, "label")


def draws(pixels: DataFrame, keys: tuple[str, ...], seed: int, n: int) -> DataFrame:
    """One row a frame with ``n`` repeatable draws u0, u1, ... in [0, 1), from digests of the keys and the seed."""
    frames = pixels.select(*keys).distinct()
    text = lambda k: F.concat_ws("|", *[F.col(c).cast("string") for c in keys], F.lit(str(seed)), F.lit(str(k)))
    return frames.select(*keys, *[(F.conv(F.substring(F.md5(text(k)), 1, 8), 16, 10).cast("double") / float(1 << 32)).alias(f"u{k}") for k in range(n)])


def _drawn(pixels: DataFrame, keys: tuple[str, ...], seed: int, n: int) -> DataFrame:
    # one row a frame, broadcast if its size allows
    return pixels.join(draws(pixels, keys, seed, n), list(keys))


def flipped(pixels: DataFrame, p: ProjectionParams, keys: tuple[str, ...] = ("frame",), probability: float = 0.5, seed: int = 0) -> DataFrame:
    """Mirrored columns for a repeatable share of frames; coordinates are not negated."""
    drawn = _drawn(pixels, keys, seed, 1)
    return drawn.withColumn("col", F.when(F.col("u0") < probability, p.w - 1 - F.col("col")).otherwise(F.col("col")).cast("int")).select(*pixels.columns)


def jittered(pixels: DataFrame, keys: tuple[str, ...] = ("frame",), probability: float = 0.3, std: float = 0.05, seed: int = 10) -> DataFrame:
    """Remission scaled by one normal factor a frame and clamped to [0, 1], for a share of frames."""
    drawn = _drawn(pixels, keys, seed, 3)
    normal = F.sqrt(-2.0 * F.log(1.0 - F.col("u1"))) * F.cos(F.col("u2") * (2 * np.pi))
    scaled = F.least(F.greatest(F.col("ch4") * (1.0 + std * normal), F.lit(0.0)), F.lit(1.0))
    return drawn.withColumn("ch4", F.when(F.col("u0") < probability, scaled).otherwise(F.col("ch4"))).select(*pixels.columns)


def cut_out(pixels: DataFrame, p: ProjectionParams, keys: tuple[str, ...] = ("frame",), probability: float = 0.3, height: int = 16, width: int = 256, seed: int = 20) -> DataFrame:
    """All channels zero in one window of a share of frames; labels stay."""
    drawn = _drawn(pixels, keys, seed, 3)
    top = F.floor(F.col("u1") * max(p.h - height, 1))
    left = F.floor(F.col("u2") * max(p.w - width, 1))
    hit = (F.col("u0") < probability) & F.col("row").between(top, top + height - 1) & F.col("col").between(left, left + width - 1)
    return drawn.withColumns({f"ch{k}": F.when(hit, F.lit(0.0)).otherwise(F.col(f"ch{k}")) for k in range(5)}).select(*pixels.columns)


def augmented(pixels: DataFrame, p: ProjectionParams, keys: tuple[str, ...] = ("frame",), seed: int = 0) -> DataFrame:
    return cut_out(jittered(flipped(pixels, p, keys, seed=seed), keys, seed=seed + 10), p, keys, seed=seed + 20)


def vote_3x3(points: DataFrame, pixels: DataFrame, p: ProjectionParams, keys: tuple[str, ...] = ("frame",), n_classes: int = 5) -> DataFrame:
    """Mean probabilities of the nine pixels around each point; borders are clamped, so border pixels repeat.

    ``pixels`` holds ``probs`` of hit pixels; the others count as zeros in the nine. Each
    pixel is sent to the pixel keys it votes for (with its weight there) and summed, so points
    join one row each.
    """
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    targets = pixels.select(*keys, "row", "col", "probs").withColumn("o", F.explode(offsets)).select(*keys, (F.col("row") + F.col("o.i")).alias("r"), (F.col("col") + F.col("o.j")).alias("c"), F.col("row").alias("r0"), F.col("col").alias("c0"), "probs")
    inside = targets.filter(F.col("r").between(0, p.h - 1) & F.col("c").between(0, p.w - 1))

    def times(at: str, source: str, last: int):
        # how many of the three clamped steps from ``at`` land on ``source``
        steps = [F.when(F.least(F.greatest(F.col(at) + d, F.lit(0)), F.lit(last)) == F.col(source), 1).otherwise(0) for d in (-1, 0, 1)]
        return steps[0] + steps[1] + steps[2]

    weight = times("r", "r0", p.h - 1) * times("c", "c0", p.w - 1)
    sums = [F.sum(F.get("probs", F.lit(k)) * F.col("w")).alias(f"s{k}") for k in range(n_classes)]
    summed = inside.withColumn("w", weight).groupBy(*keys, F.col("r").alias("row"), F.col("c").alias("col")).agg(*sums)
    voted = summed.select(*keys, "row", "col", F.array(*[F.col(f"s{k}") / 9.0 for k in range(n_classes)]).alias("probs"))
    return points.join(voted, [*keys, "row", "col"], "left").withColumn("cls5", F.coalesce(proj.argmax(F.col("probs")), F.lit(UNKNOWN)))


def vote_in_image(probs: np.ndarray, rows: np.ndarray, cols: np.ndarray, diagonal: bool = False) -> np.ndarray:
    """The same vote on one dense (classes, h, w) array, for use inside a model function.

    ``diagonal`` gathers the three diagonal pixels only.
    """
    _, h, w = probs.shape
    steps = [(d, d) for d in (-1, 0, 1)] if diagonal else [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    parts = [probs[:, np.clip(rows + i, 0, h - 1), np.clip(cols + j, 0, w - 1)] for i, j in steps]
    return (sum(parts) / len(parts)).T


def dense_images(pixels: DataFrame, p: ProjectionParams, keys: tuple[str, ...] = ("frame",), half: bool = True) -> DataFrame:
    """One row a frame: the image as bytes (float16 or float32, channel first) and labels as bytes.

    A frame has at most h * w pixels, so the group that meets in a task is bounded.
    """
    kind = np.float16 if half else np.float32
    names = [*keys, "image", "labels"]
    has_label = "label" in pixels.columns
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pixels.select(*keys).schema) + ", image binary, labels binary"

    def fill(table: pa.Table) -> pa.Table:
        image, labels = np.zeros((5, p.h, p.w), np.float32), np.full((p.h, p.w), UNKNOWN, np.uint8)
        r, c = (table.column(n).to_numpy() for n in ("row", "col"))
        for k in range(5):
            image[k, r, c] = table.column(f"ch{k}").to_numpy()
        if has_label:
            labels[r, c] = table.column("label").to_numpy()
        first = table.select(list(keys)).slice(0, 1)
        return pa.Table.from_arrays([*first.columns, pa.array([image.astype(kind).tobytes()], pa.binary()), pa.array([labels.tobytes()], pa.binary())], names)

    return pixels.groupBy(*keys).applyInArrow(fill, out)


def sparse_pixels(images: DataFrame, p: ProjectionParams, keys: tuple[str, ...] = ("frame",), half: bool = True) -> DataFrame:
    """Inverse of :func:`dense_images`: rows for pixels with a range or a label."""
    kind = np.float16 if half else np.float32
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in images.select(*keys).schema)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                image = np.frombuffer(batch.column("image")[k].as_py(), kind).reshape(5, p.h, p.w).astype(np.float32)
                labels = np.frombuffer(batch.column("labels")[k].as_py(), np.uint8).reshape(p.h, p.w)
                r, c = np.nonzero((image[0] > 0) | (labels != UNKNOWN))
                own = [pa.array([batch.column(n)[k].as_py()] * len(r), batch.schema.field(n).type) for n in keys]
                yield pa.RecordBatch.from_arrays([*own, pa.array(r.astype(np.int32)), pa.array(c.astype(np.int32)), *[pa.array(image[i, r, c]) for i in range(5)], pa.array(labels[r, c].astype(np.int16))], [*keys, "row", "col", *[f"ch{i}" for i in range(5)], "label"])

    return images.mapInArrow(spread, f"{fields}, row int, col int, ch0 float, ch1 float, ch2 float, ch3 float, ch4 float, label short")
