"""Pluggable segmenters: rules as expressions, or a model over dense images."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polargrain.operators import images
from polargrain.plans.config import ProjectionParams


class Segmenter(Protocol):
    def segment(self, points: DataFrame) -> DataFrame:
        """Adds cls5 to points."""


class RuleSegmenter:
    """Classes by height above the ground and remission, without a model."""

    def __init__(self, low: float = 0.2, high: float = 2.5, bright: float = 0.6):
        self.low, self.high, self.bright = low, high, bright

    def segment(self, points: DataFrame) -> DataFrame:
        h = F.col("z") - (F.col("ground_z") if "ground_z" in points.columns else F.lit(0.0))
        ground = F.when(F.col("remission") > self.bright, 1).otherwise(0)
        cls = F.when(h < self.low, ground).when(h > self.high, 2).when(F.col("remission") > self.bright, 3).otherwise(2)
        return points.withColumn("cls5", cls.cast("short"))


class BatchModelSegmenter:
    """A model over dense images in Arrow batches, with the neighbourhood vote next to it.

    ``load`` returns a function from (batch, 5, h, w) float32 to (batch, classes, h, w) logits
    and runs once a worker. Points of a frame (a bounded scan) meet in one group.
    """

    def __init__(self, load: Callable[[], Callable[[np.ndarray], np.ndarray]], p: ProjectionParams, keys: tuple[str, ...] = ("frame",), diagonal: bool = False):
        self.load, self.p, self.keys, self.diagonal = load, p, keys, diagonal

    def segment(self, points: DataFrame) -> DataFrame:
        from pyspark.sql.types import ShortType, StructType

        from polargrain.functions import projection as proj

        p, load, diagonal = self.p, self.load, self.diagonal
        projected = proj.project(points, p)
        fields = [*projected.schema.fields]
        schema = StructType(fields).add("cls5", ShortType())
        held: dict[str, Callable] = {}

        def run(table: pa.Table) -> pa.Table:
            if "model" not in held:
                held["model"] = load()
            rows, cols, rng = (table.column(c).to_numpy() for c in ("row", "col", "rng"))
            image = np.zeros((5, p.h, p.w), np.float32)
            order = np.lexsort((-table.column("pid").to_numpy(), -rng))  # nearest, then lowest pid, written last
            r, c = rows[order], cols[order]
            for k, name in enumerate(("rng", "x", "y", "z")):
                image[k, r, c] = table.column(name).to_numpy()[order] / p.max_range
            image[4, r, c] = table.column("remission").to_numpy()[order]
            logits = held["model"](image[None])[0].astype(np.float64)
            e = np.exp(logits - logits.max(0))
            votes = images.vote_in_image(e / e.sum(0), rows, cols, diagonal)
            return table.append_column("cls5", pa.array(votes.argmax(1).astype(np.int16)))

        return projected.groupBy(*self.keys).applyInArrow(run, schema)


def predict_images(dense: DataFrame, load: Callable[[], Callable[[np.ndarray], np.ndarray]], p: ProjectionParams, half: bool = True, batch: int = 8) -> DataFrame:
    """Arg-max labels (bytes) of stored dense images, in batches of ``batch`` images."""
    kind = np.float16 if half else np.float32
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dense.schema) + ", predicted binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                stack = np.stack([np.frombuffer(b, kind).reshape(5, p.h, p.w) for b in part.column("image").to_pylist()]).astype(np.float32)
                out = model(stack).argmax(1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([o.tobytes() for o in out], pa.binary())], [*part.schema.names, "predicted"])

    return dense.mapInArrow(run, fields)
