"""Training shards from labelled scans."""

from __future__ import annotations

import io
import tarfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polargrain.functions import labels
from polargrain.functions import projection as proj
from polargrain.operators import images, ordered
from polargrain.plans.config import UNKNOWN, ProjectionParams

SHARD_SIZE = 200


def labelled_points(points: DataFrame, raw: DataFrame, keys: tuple[str, ...] = ("seq_id", "frame")) -> DataFrame:
    """Points with five-class ids, for frames whose points and labels agree in number.

    For relations; ``kitti.read_labelled_scans`` pairs files without a shuffle of points.
    """
    sizes = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("a")).join(raw.groupBy(*keys).agg(F.count(F.lit(1)).alias("b")), list(keys)).filter("a = b").select(*keys)
    joined = points.join(raw, [*keys, "pid"]).join(sizes, list(keys), "left_semi")
    return joined.withColumn("cls5", labels.remap(labels.semantic(F.col("raw_label"))))


def training_points(labelled: DataFrame, p: ProjectionParams) -> DataFrame:
    """Points in range with a class, projected; filters come before the shuffle of the images."""
    return proj.project(labelled, p).filter((F.col("rng") <= p.max_range) & (F.col("cls5") != UNKNOWN))


def training_pixels(kept: DataFrame, p: ProjectionParams, keys: tuple[str, ...] = ("seq_id", "frame")) -> DataFrame:
    held = images.nearest(kept, keys, ("pid", "rng", "x", "y", "z", "remission", "cls5"))
    return held.select(*keys, "row", "col", "pid", *proj.channels(p), F.col("cls5").alias("label"))


def shard_assignment(frames: DataFrame, keys: tuple[str, ...] = ("seq_id", "frame"), size: int = SHARD_SIZE) -> DataFrame:
    """Shard of every frame and its sample number, which restarts with each sequence.

    Shard numbers go on across sequences; a shard may hold the end of one and the start of
    the next. One row a frame is numbered inside its sequence; sequences are summed up first.
    """
    seq, frame = keys
    sizes = frames.groupBy(seq).agg(F.count(F.lit(1)).alias("n"))  # one row a sequence
    before = F.sum("n").over(Window.orderBy(seq).rowsBetween(Window.unboundedPreceding, -1))
    own = ordered.numbered(frames.select(*keys), (seq,), [frame], "rn").join(sizes.select(seq, F.coalesce(before, F.lit(0)).alias("before")), seq)
    return own.select(*keys, F.floor((F.col("before") + F.col("rn") - 1) / size).cast("long").alias("shard"), (F.col("rn") - 1).alias("sample"))


def write_shards(dense: DataFrame, assignment: DataFrame, path: str, split: str, mode: str = "errorifexists", keys: tuple[str, ...] = ("seq_id", "frame")) -> None:
    """Parquet partitioned by split and shard; ``mode='overwrite'`` forces."""
    out = dense.join(assignment, list(keys)).withColumn("split", F.lit(split))
    out.repartition("shard").write.mode(mode).partitionBy("split", "shard").parquet(path)


def write_tar_shards(dense: DataFrame, assignment: DataFrame, folder: str, keys: tuple[str, ...] = ("seq_id", "frame")) -> DataFrame:
    """(shard, path, samples) of tar files with ``NNNNNN.ri`` and ``NNNNNN.li`` members.

    A shard's samples are sorted into one partition and streamed to ``folder``, which all
    executors must see; a file appears under its name only when it is complete.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pa_fs.FileSystem.from_uri(folder) if "://" in folder else (pa_fs.LocalFileSystem(), folder.removeprefix("file:"))
        fs.create_dir(base, recursive=True)
        tar = out = number = None
        n, done = 0, []

        def finish() -> None:
            tar.close()
            out.close()
            name = f"shard-{number:06d}.tar"
            fs.move(f"{base}/{token}", f"{base}/{name}")
            done.append((number, f"{folder.rstrip('/')}/{name}", n))

        for batch in batches:
            for shard, sample, image, label in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if shard != number:
                    if tar is not None:
                        finish()
                    number, n, token = shard, 0, uuid.uuid4().hex
                    out = fs.open_output_stream(f"{base}/{token}", compression=None)
                    tar = tarfile.open(fileobj=out, mode="w|")
                for suffix, data in (("ri", image), ("li", label)):
                    info = tarfile.TarInfo(f"{sample:06d}.{suffix}")
                    info.size = len(data)
                    tar.addfile(info, io.BytesIO(data))
                n += 1
        if tar is not None:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64()))], ["shard", "path", "samples"])

    joined = dense.join(assignment, list(keys)).select("shard", F.col("sample").cast("long"), "image", "labels", *keys)
    ordered = joined.repartition("shard").sortWithinPartitions("shard", *keys).select("shard", "sample", "image", "labels")
    return ordered.mapInArrow(write, "shard long, path string, samples long")


def shard_metadata(kept: DataFrame, split: str = "split", keys: tuple[str, ...] = ("seq_id", "frame")) -> DataFrame:
    """One row: frames by split, class counts over all splits and their weights."""
    frames = kept.groupBy().agg(*[F.count_distinct(F.when(F.col(split) == s, F.struct(*keys))).alias(f"n_{s}") for s in ("train", "val")], F.array_sort(F.collect_set("seq_id")).alias("sequences"))
    weights = labels.class_weights(labels.class_counts(kept))
    lists = weights.agg(F.transform(F.array_sort(F.collect_list(F.struct("cls", "n", "weight"))), lambda r: r["n"]).alias("class_counts"), F.transform(F.array_sort(F.collect_list(F.struct("cls", "n", "weight"))), lambda r: r["weight"]).alias("class_weights"))
    return frames.crossJoin(F.broadcast(lists)).withColumn("image_dtype", F.lit("float16")).withColumn("label_dtype", F.lit("uint8"))


def split_metadata(kept: DataFrame, split: str = "split", keys: tuple[str, ...] = ("seq_id", "frame"), classes: int = 5) -> DataFrame:
    """Frames and class counts of every split, in one pass over the points of all splits."""
    counts = [F.count_if(F.col("cls5") == k).alias(f"c{k}") for k in range(classes)]
    frames = kept.groupBy(split, *keys).agg(*counts)
    return frames.groupBy(split).agg(F.count(F.lit(1)).alias("n_frames"), *[F.sum(f"c{k}").alias(f"c{k}") for k in range(classes)])


def shuffled_samples(samples: DataFrame, seed: int, keys: tuple[str, ...] = ("seq_id", "frame"), shard: str | None = None, buffer: int = 1000) -> DataFrame:
    """A repeatable random order of samples, with ``place`` in it.

    With ``shard``, shards come in a random order and samples of one shard stay within
    ``buffer`` places of where reading would put them, as through a bounded shuffle buffer;
    without, the order is that of a hash over everything.
    """
    draw = F.xxhash64(*keys, F.lit(seed))
    if shard is None:
        return ordered.numbered(samples.withColumn("__draw", draw), (), ["__draw", *keys], "place").drop("__draw")
    by_shard = samples.withColumn("__turn", F.xxhash64(shard, F.lit(seed)))
    read = ordered.numbered(by_shard, (), ["__turn", shard, *keys], "__rn")
    block = read.withColumn("__block", F.floor((F.col("__rn") - 1) / buffer).cast("long"))
    inside = F.row_number().over(Window.partitionBy("__block").orderBy(draw, *keys))
    return block.withColumn("place", F.col("__block") * buffer + inside).drop("__turn", "__rn", "__block")


def collated(samples: DataFrame, batch: int, place: str = "place") -> DataFrame:
    """Batch number of every sample, and its place in it."""
    at = F.col(place) - 1
    return samples.withColumn("batch", F.floor(at / batch).cast("long")).withColumn("item", F.pmod(at, F.lit(batch)).cast("int"))


def first_batches(batched: DataFrame, most: int) -> DataFrame:
    """The samples of the first ``most`` batches."""
    return batched.filter(F.col("batch") < most)
