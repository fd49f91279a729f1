"""The live path on Structured Streaming: per-frame cells, stateful deltas, client state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import StructType

from polargrain.operators import grid as grid_ops
from polargrain.plans.config import GridParams, StreamParams

EVENTS = "seq_id string, epoch long, frame int, kind string, op string, cell long, z_max double, cls int"


def stream_points(spark: SparkSession, path: str, schema: str | StructType, files_a_trigger: int = 1) -> DataFrame:
    """Scans as a stream of files, ``files_a_trigger`` at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def seek_points(points: DataFrame, frame: int, epoch: int) -> DataFrame:
    """A stream from ``frame`` on, marked with the epoch of the jump; it needs a checkpoint of its own."""
    return points.filter(F.col("frame") >= frame).withColumn("epoch", F.lit(epoch).cast("long"))


def event_time(frame, s: StreamParams):
    return F.timestamp_micros((frame.cast("double") / s.native_hz * 1_000_000).cast("long"))


def stream_cells(points: DataFrame, grid: GridParams, s: StreamParams, lateness: str = "1 second") -> DataFrame:
    """Cells of each frame as a windowed aggregate; a frame's window closes at the watermark."""
    located = grid_ops.with_cells(points, grid).withColumn("ts", event_time(F.col("frame"), s)).withWatermark("ts", lateness)
    return grid_ops.reduce_cells(located, ["seq_id", "ts", "frame"], grid)


#: Input of the stateful deltas: a row a cell, and for every frame one marker row without a cell
#: that carries how many cells the frame has. A frame without cells is its marker alone.
MARKED = "seq_id string, epoch long, frame int, delivered boolean, n_cells int, cell long, z_max double, cls int"


def with_markers(cells: DataFrame, frames: DataFrame) -> DataFrame:
    """``MARKED`` rows of cells (seq_id, epoch, frame, cell, z_max, cls) and frames (seq_id, epoch, frame, delivered)."""
    keys = ["seq_id", "epoch", "frame"]
    sizes = cells.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("n"))
    marks = frames.join(sizes, keys, "left").select(*keys, "delivered", F.coalesce("n", F.lit(0)).alias("n_cells"), F.lit(None).cast("long").alias("cell"), F.lit(None).cast("double").alias("z_max"), F.lit(None).cast("int").alias("cls"))
    rows = cells.join(frames, keys).select(*keys, "delivered", F.lit(None).cast("int").alias("n_cells"), "cell", "z_max", "cls")
    return marks.unionByName(rows)


class DeltaFold:
    """Sent state of one (sequence, epoch): what a client knows, and when it last got everything."""

    def __init__(self, s: StreamParams, saved: tuple | None = None):
        self.s = s
        self.count, self.last, self.drops, cells, heights, classes = saved or (0, 0, 0, [], [], [])
        self.sent = dict(zip(cells, zip(heights, classes, strict=True), strict=True))

    def saved(self) -> tuple:
        cells = list(self.sent)
        return self.count, self.last, self.drops, cells, [self.sent[c][0] for c in cells], [self.sent[c][1] for c in cells]

    def frame(self, cells: dict[int, tuple[float, int]], delivered: bool) -> tuple[str, list[tuple[str, int, float | None, int | None]]]:
        """Kind and events of the next frame; state moves only if it is delivered."""
        self.count += 1
        snapshot = self.count - self.last >= self.s.snapshot_interval or self.drops >= self.s.catchup_drops
        if not delivered:
            self.drops += 1
            return ("snapshot" if snapshot else "delta"), []
        self.drops = 0
        if snapshot:
            self.last, self.sent = self.count, dict(cells)
            return "snapshot", [("snapshot", c, z, k) for c, (z, k) in sorted(cells.items())]
        out = []
        for c, (z, k) in sorted(cells.items()):
            old = self.sent.get(c)
            if old is None or abs(z - old[0]) >= self.s.height_step or k != old[1]:
                out.append(("added" if old is None else "changed", c, z, k))
                self.sent[c] = (z, k)
        for c in sorted(self.sent.keys() - cells.keys()):
            out.append(("freed", c, None, None))
            del self.sent[c]
        return "delta", out


class DeltaProcessor(StatefulProcessor):
    """What the clients of one sequence know: a map from cell to the height and class sent last.

    Frames are taken in order and only when all their rows have come, in however many
    micro-batches; rows of a frame that is not beyond the last one taken, or of an older epoch,
    are late and dropped. A newer epoch (a seek or a switch) clears everything. Only cells that
    change are written to the map.
    """

    def __init__(self, s: StreamParams):
        self.s = s

    def init(self, handle) -> None:
        self.place = handle.getValueState("place", "epoch long, frame int, count int, last int, drops int")
        self.sent = handle.getMapState("sent", "cell long", "z double, kind int")
        self.rows = handle.getMapState("rows", "frame int, cell long", "z double, kind int")
        self.marks = handle.getMapState("marks", "frame int", "n int, delivered boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        place = self.place.get() if self.place.exists() else None
        epoch, last = (place[0], place[1]) if place else (-1, -1)
        before = {k[0]: (v[0], v[1]) for k, v in self.sent.iterator()} if self.sent.exists() else {}
        fold = DeltaFold(self.s)
        fold.count, fold.last, fold.drops = place[2:5] if place else (0, 0, 0)
        fold.sent = dict(before)
        out: list[tuple] = []
        for now, part in batch.groupby("epoch", sort=True):
            if now < epoch:
                continue
            if now > epoch:
                for state in (self.sent, self.rows, self.marks):
                    state.clear()
                epoch, last, before, fold = int(now), -1, {}, DeltaFold(self.s)
            part = part[part["frame"] > last]
            marks = {k[0]: (v[0], v[1]) for k, v in self.marks.iterator()} if self.marks.exists() else {}
            pending: dict[int, dict[int, tuple[float, int]]] = {}
            if self.rows.exists():
                for k, v in self.rows.iterator():
                    pending.setdefault(k[0], {})[k[1]] = (v[0], v[1])
            kept = {(f, c) for f, cells in pending.items() for c in cells}
            known = set(marks)
            for f, n, ok, c, z, k in zip(*(part[c].tolist() for c in ("frame", "n_cells", "delivered", "cell", "z_max", "cls")), strict=True):
                if pd.isna(c):
                    marks[int(f)] = (int(n), bool(ok))
                else:
                    pending.setdefault(int(f), {})[int(c)] = (float(z), int(k))
            for f in sorted(marks.keys() | pending.keys()):
                if f not in marks or len(pending.get(f, {})) < marks[f][0]:
                    break  # wait for the rest of this frame
                kind, told = fold.frame(pending.pop(f, {}), marks.pop(f)[1])
                out += [(epoch, f, kind, *e) for e in told]
                last = f
            left = {(f, c) for f, cells in pending.items() for c in cells}
            for f, c in kept - left:
                self.rows.removeKey((f, c))
            for f, c in left - kept:
                self.rows.updateValue((f, c), pending[f][c])
            for f in known - set(marks):
                self.marks.removeKey((f,))
            for f in set(marks) - known:
                self.marks.updateValue((f,), marks[f])
        for c in before.keys() - fold.sent.keys():
            self.sent.removeKey((c,))
        for c, v in fold.sent.items():
            if before.get(c) != v:
                self.sent.updateValue((c,), v)
        self.place.update((epoch, last, fold.count, fold.last, fold.drops))
        frame = pd.DataFrame([(key[0], *row) for row in out], columns=["seq_id", "epoch", "frame", "kind", "op", "cell", "z_max", "cls"])
        yield frame.astype({"epoch": "int64", "frame": "int32", "cell": "int64", "cls": "Int32", "z_max": "Float64"})

    def close(self) -> None:
        pass


def stream_deltas(marked: DataFrame, s: StreamParams) -> DataFrame:
    """Events of a stream of ``MARKED`` rows; state is one map a sequence, of the current epoch only.

    Needs the RocksDB state store (see :func:`use_map_state`).
    """
    grouped = marked.select(*[F.col(c.split()[0]) for c in MARKED.split(", ")]).groupBy("seq_id")
    return grouped.transformWithStateInPandas(DeltaProcessor(s), EVENTS, "Append", "None")


def use_map_state(spark: SparkSession) -> None:
    """Choose the state store that holds maps key by key."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process all that is there and return what was written; restarts go on from the checkpoint."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def deliver(stream: DataFrame, send: Callable[[DataFrame, int], None], checkpoint: str, interval: str = "100 milliseconds"):
    """Start a paced query that hands every batch to ``send``, which should be idempotent by batch id."""
    return stream.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


class Player:
    """Play, pause, seek, speed, cloud and sequence of a live view; starts paused.

    ``start(seq_id, epoch, frame, speed, cloud)`` returns a running query. A jump is a new epoch
    with a fresh query; while paused it renders one preview frame, if ``preview`` is given. A
    change of speed or cloud goes on from the frame that ``position`` reports, in the same epoch.
    """

    def __init__(self, start: Callable[[str, int, int, float, bool], object], n_frames: int, seq_id: str, preview: Callable[[str, int, int], object] | None = None, position: Callable[[], int] | None = None):
        self.start, self.n_frames, self.seq_id, self.preview, self.position = start, n_frames, seq_id, preview, position
        self.epoch, self.query, self.at, self.speed, self.cloud = 0, None, 0, 1.0, False

    def play(self) -> None:
        if self.query is None:
            self.query = self.start(self.seq_id, self.epoch, self.at, self.speed, self.cloud)

    def pause(self) -> None:
        if self.query is not None:
            if self.position is not None:
                self.at = self.position()
            self.query.stop()
            self.query = None

    def _again(self) -> None:
        if self.query is not None:
            self.pause()
            self.play()

    def set_speed(self, speed: float) -> float:
        """Times the native rate, from 0.1 to 10."""
        self.speed = min(10.0, max(0.1, speed))
        self._again()
        return self.speed

    def set_cloud(self, on: bool) -> None:
        self.cloud = on
        self._again()

    def seek(self, frame: int) -> int:
        playing = self.query is not None
        self.pause()
        self.at = min(max(0, frame), self.n_frames - 1)
        self.epoch += 1
        if playing:
            self.play()
        elif self.preview is not None:
            self.preview(self.seq_id, self.epoch, self.at)
        return self.epoch

    def switch(self, seq_id: str, n_frames: int) -> int:
        self.seq_id, self.n_frames = seq_id, n_frames
        return self.seek(0)


def paced_interval(s: StreamParams, speed: float = 1.0) -> str:
    """Trigger interval of one frame a micro-batch at ``speed`` times the native rate."""
    return f"{max(1, round(1000.0 / (s.native_hz * speed)))} milliseconds"
