"""Readers of scan sequences, labels, poses, shards and histories.

A sequence folder holds ``velodyne/*.bin`` (x, y, z, remission as little-endian float32),
``labels/*.label`` (one uint32 a point), ``poses.txt`` and ``calib.txt``. Spark lists the files
(paths only); the chosen ones are opened and unpacked in Arrow batches on the executors.
"""

from __future__ import annotations

import io
import tarfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

POINTS = "seq_id string, frame int, pid int, x float, y float, z float, remission float"
BLOCK = 65_536


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def open_path(uri: str):
    """(file system, path in it) of a file that Spark has listed; local paths have one slash after the scheme."""
    from pyarrow import fs

    if "://" not in uri or uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def list_files(spark: SparkSession, root: str, folder: str, suffix: str) -> DataFrame:
    """(path, seq_id, stem) of all sequences; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true").load(root).select("path")
    return found.filter(F.col("path").contains(f"/{folder}/")).select("path", F.regexp_extract("path", f"([^/]+)/{folder}/[^/]+$", 1).alias("seq_id"), F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("stem"))


def list_scans(spark: SparkSession, root: str, seq_ids: list[str] | None = None, frames: tuple[int, int] | None = None) -> DataFrame:
    """(path, seq_id, stem, frame): a frame is the place of its file in the sorted listing, not its name."""
    files = list_files(spark, root, "velodyne", ".bin")
    if seq_ids is not None:
        files = files.filter(F.col("seq_id").isin(seq_ids))
    listed = files.withColumn("frame", (F.row_number().over(Window.partitionBy("seq_id").orderBy("path")) - 1).cast("int"))
    return listed if frames is None else listed.filter((F.col("frame") >= frames[0]) & (F.col("frame") < frames[1]))


def _dealt(files: DataFrame) -> DataFrame:
    """Small lists of paths, dealt over the cluster so that every task opens its share of files."""
    return files.repartition(max(files.sparkSession.sparkContext.defaultParallelism, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "path")


def _batches(seq: str, frame: int, columns: list[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    n = len(columns[0])
    for a in range(0, n, BLOCK):
        m = min(BLOCK, n - a)
        own = [pa.array([seq] * m), pa.array(np.full(m, frame, np.int32)), pa.array(np.arange(a, a + m, dtype=np.int32))]
        yield pa.RecordBatch.from_arrays([*own, *[pa.array(np.ascontiguousarray(c[a : a + m])) for c in columns]], names)


def _content(uri: str) -> bytes:
    fs, where = open_path(uri)
    with fs.open_input_file(where) as f:
        return f.read()


def read_scans(spark: SparkSession, root: str, seq_ids: list[str] | None = None, frames: tuple[int, int] | None = None) -> DataFrame:
    """Points of all scans below ``root``, or of some sequences and frames [from, to); only their files are opened."""
    files = list_scans(spark, root, seq_ids, frames)
    names = [c.split()[0] for c in POINTS.split(", ")]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, seq, frame in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                scan = np.frombuffer(_content(path), "<f4").reshape(-1, 4)
                yield from _batches(seq, frame, [scan[:, k] for k in range(4)], names)

    return _dealt(files.select("path", "seq_id", "frame")).mapInArrow(unpack, POINTS)


def read_frame(spark: SparkSession, root: str, seq_id: str, frame: int) -> DataFrame:
    """One scan; no rows past the end."""
    return read_scans(spark, root, [seq_id], (frame, frame + 1))


def looped(points: DataFrame, n_frames: int, loops: int) -> DataFrame:
    """A sequence played ``loops`` times, frame numbers going on."""
    turn = F.explode(F.sequence(F.lit(0), F.lit(loops - 1)))
    return points.withColumn("loop", turn).withColumn("frame", (F.col("frame") + F.col("loop") * n_frames).cast("int")).drop("loop")


def _pairs(spark: SparkSession, root: str, seq_ids: list[str] | None) -> DataFrame:
    """(path, label_path, seq_id, frame) of scans that have a label file of the same stem."""
    labels = list_files(spark, root, "labels", ".label").withColumnRenamed("path", "label_path")
    return list_scans(spark, root, seq_ids).join(labels, ["seq_id", "stem"])


def read_labels(spark: SparkSession, root: str) -> DataFrame:
    """(seq_id, frame, pid, raw_label) of all label files, matched to scans by file stem."""
    schema = "seq_id string, frame int, pid int, raw_label long"

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, seq, frame in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                yield from _batches(seq, frame, [np.frombuffer(_content(path), "<u4").astype(np.int64)], ["seq_id", "frame", "pid", "raw_label"])

    files = _pairs(spark, root, None).select(F.col("label_path").alias("path"), "seq_id", "frame")
    return _dealt(files).mapInArrow(unpack, schema)


def read_labelled_scans(spark: SparkSession, root: str, seq_ids: list[str] | None = None) -> DataFrame:
    """Points with their raw labels, paired by position where a scan and its labels agree in number.

    Both files of a frame are opened in one task, so points are neither shuffled nor joined.
    """
    names = [c.split()[0] for c in POINTS.split(", ")]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, label_path, seq, frame in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                scan, words = np.frombuffer(_content(path), "<f4").reshape(-1, 4), np.frombuffer(_content(label_path), "<u4")
                if len(scan) == len(words):
                    yield from _batches(seq, frame, [*[scan[:, k] for k in range(4)], words.astype(np.int64)], [*names, "raw_label"])

    return _dealt(_pairs(spark, root, seq_ids).select("path", "label_path", "seq_id", "frame")).mapInArrow(unpack, f"{POINTS}, raw_label long")


def write_scans(points: DataFrame, root: str) -> DataFrame:
    """Write points (seq_id, frame, pid, x, y, z, remission, and raw_label if any) as scan and label files.

    A frame's points meet in one group, bounded by a scan. Per frame: seq_id, frame, n. Files are
    named by frame and appear under their names only when complete.
    """
    labelled = "raw_label" in points.columns

    def write(table: pa.Table) -> pa.Table:
        table = table.sort_by("pid")
        seq, frame = table.column("seq_id")[0].as_py(), table.column("frame")[0].as_py()
        scan = np.stack([table.column(c).to_numpy() for c in ("x", "y", "z", "remission")], 1).astype("<f4")
        put(f"{root}/{seq}/velodyne/{frame:06d}.bin", scan.tobytes())
        if labelled:
            put(f"{root}/{seq}/labels/{frame:06d}.label", table.column("raw_label").to_numpy().astype("<u4").tobytes())
        return pa.table({"seq_id": [seq], "frame": pa.array([frame], pa.int32()), "n": pa.array([len(scan)], pa.int64())})

    columns = ("seq_id", "frame", "pid", "x", "y", "z", "remission", *(["raw_label"] if labelled else []))
    return points.select(*columns).groupBy("seq_id", "frame").applyInArrow(write, "seq_id string, frame int, n long")


def put(uri: str, data: bytes) -> None:
    """Write a small file under a name of its own, then move it to ``uri``."""
    fs, where = open_path(uri)
    fs.create_dir(where.rpartition("/")[0], recursive=True)
    token = f"{where.rpartition('/')[0]}/.{uuid.uuid4().hex}"
    with fs.open_output_stream(token, compression=None) as out:
        out.write(data)
    fs.move(token, where)


def sequence_catalog(spark: SparkSession, root: str) -> DataFrame:
    """seq_id, n_frames, has_poses, has_labels of every folder with scans; contents are not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    return catalog_of(listed)


def catalog_of(listed: DataFrame) -> DataFrame:
    """The catalog of a listing of paths."""
    parts = F.regexp_extract("path", r"([^/]+)/(?:(velodyne|labels)/[^/]+|(poses\.txt))$", 1)
    kind = F.when(F.col("path").rlike(r"/velodyne/[^/]+\.bin$"), "scan").when(F.col("path").rlike(r"/labels/[^/]+\.label$"), "label").when(F.col("path").rlike(r"/poses\.txt$"), "pose")
    rows = listed.select(parts.alias("seq_id"), kind.alias("kind")).filter("kind is not null")
    return rows.groupBy("seq_id").agg(F.count_if(F.col("kind") == "scan").alias("n_frames"), F.bool_or(F.col("kind") == "pose").alias("has_poses"), F.bool_or(F.col("kind") == "label").alias("has_labels")).filter("n_frames > 0")


def read_poses(spark: SparkSession, seq_dir: str) -> DataFrame | None:
    """(pose_id, pose) with the row-major product of pose and calibration; None without poses."""
    if not exists(spark, f"{seq_dir}/poses.txt"):
        return None
    lines = spark.read.text(f"{seq_dir}/poses.txt", wholetext=True).select(F.posexplode(F.filter(F.split(F.col("value"), "\n"), lambda v: F.trim(v) != "")).alias("pose_id", "line"))
    rows = lines.select("pose_id", F.transform(F.split(F.trim("line"), r"\s+"), lambda v: v.cast("double")).alias("p"))
    if not rows.filter(F.size("p") < 12).isEmpty():
        return None
    tr = [1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0, 0]
    if exists(spark, f"{seq_dir}/calib.txt"):
        text = spark.read.text(f"{seq_dir}/calib.txt", wholetext=True).first()
        for line in (text[0] if text else "").splitlines():
            if line.strip().startswith("Tr"):
                tr = [float(v) for v in line.split(":", 1)[1].split()[:12]]
                break
    t = [*tr, 0.0, 0.0, 0.0, 1.0]
    product = [sum((F.get("p", F.lit(4 * i + k)) * t[4 * k + j] for k in range(4)), F.lit(0.0)).cast("float").cast("double") for i in range(3) for j in range(4)]
    return rows.select(F.col("pose_id").cast("int").alias("pose_id"), F.array(*product, *[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)]).alias("pose"))


def read_tar_shards(spark: SparkSession, path: str) -> DataFrame:
    """(shard, key, image, labels) of complete pairs of .ri and .li members with integer stems."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                held: dict[int, dict[str, bytes]] = {}
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for member in tar:
                        stem, _, suffix = member.name.rpartition("/")[2].rpartition(".")
                        if member.isfile() and suffix in ("ri", "li") and stem.isdigit():
                            held.setdefault(int(stem), {})[suffix] = tar.extractfile(member).read()
                        pair = held.get(int(stem)) if stem.isdigit() else None
                        if pair and len(pair) == 2:
                            held.pop(int(stem))
                            yield pa.RecordBatch.from_arrays([pa.array([name.rpartition("/")[2]]), pa.array([int(stem)], pa.int64()), pa.array([pair["ri"]]), pa.array([pair["li"]])], ["shard", "key", "image", "labels"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar").load(path)
    return files.select("path", "content").mapInArrow(unpack, "shard string, key long, image binary, labels binary")


HISTORY = "step long, epoch long, val_loss double, miou_5class double, miou_4class double, class_ious_5 array<double>, class_ious_4 array<double>, _bad string"


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON-lines history; blank and malformed lines are skipped, a missing file is empty."""
    good = ", ".join(HISTORY.split(", ")[:-1])
    if not exists(spark, path):
        return spark.createDataFrame([], good)
    lines = spark.read.schema(HISTORY).option("columnNameOfCorruptRecord", "_bad").json(path)
    return lines.filter("_bad is null and step is not null").drop("_bad")


def read_newest_eval(spark: SparkSession, folder: str) -> DataFrame | None:
    """The evaluation whose file name comes last."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "eval_*.json").load(folder).agg(F.max("path")).first()[0] if exists(spark, folder) else None
    return spark.read.option("multiLine", "true").json(found) if found else None
