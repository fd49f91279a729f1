"""Binary and JSON messages of grid frames and clouds."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the protocol.
HEADER = struct.Struct("<IHHQQiiiii")  # magic, code, version, frame, epoch, n_a, n_b, seq, total, yaw
MAGIC = 0x50433244
VERSION = 3
SNAPSHOT, DELTA, CLOUD = 1, 2, 3
CELLS_A_CHUNK = 8000
POINTS_A_CHUNK = 30_000
LEAST_COMPRESSED = 512
ROW = ("ring", "sector", "z_mean", "z_max", "occ", "trav")


def header(code: int, frame: int, epoch: int, n_a: int, n_b: int, seq: int, total: int, yaw_cd: int = 0) -> bytes:
    return HEADER.pack(MAGIC, code, VERSION, frame, epoch, n_a, n_b, seq, total, yaw_cd)


def read_header(data: bytes) -> dict[str, int]:
    names = ("magic", "code", "version", "frame", "epoch", "n_a", "n_b", "seq", "total", "yaw_cd")
    out = dict(zip(names, HEADER.unpack_from(data), strict=True))
    if out["magic"] != MAGIC or out["version"] != VERSION:
        raise ValueError("not a frame of this protocol")
    return out


def deflated(body: bytes) -> bytes:
    """Raw deflate with a marker and the plain size, if that is shorter."""
    if len(body) < LEAST_COMPRESSED:
        return body
    squeeze = zlib.compressobj(1, zlib.DEFLATED, -15)
    small = squeeze.compress(body) + squeeze.flush()
    return body if len(small) >= len(body) else b"Z" + struct.pack("<I", len(body)) + small


def inflated(data: bytes) -> bytes:
    return zlib.decompress(data[5:], -15) if len(data) > 5 and data[:1] == b"Z" else data


def cell_chunks(code: int, frame: int, epoch: int, rows: np.ndarray, cls: np.ndarray, freed: np.ndarray, yaw_cd: int = 0, chunk: int = CELLS_A_CHUNK) -> Iterator[bytes]:
    """Chunks of cell rows, all floats first, then classes and padding; freed cells end the last chunk."""
    total = max(1, -(-len(rows) // chunk))
    for k in range(total):
        part, own = rows[k * chunk : (k + 1) * chunk], cls[k * chunk : (k + 1) * chunk]
        tail = freed if k == total - 1 else freed[:0]
        yield header(code, frame, epoch, len(part), len(tail), k, total, yaw_cd) + part.astype("<f4").tobytes() + own.astype(np.uint8).tobytes() + bytes(3 * len(part)) + tail.astype("<f4").tobytes()


def cloud_chunks(frame: int, epoch: int, xyz: np.ndarray, cls: np.ndarray, yaw_cd: int = 0, chunk: int = POINTS_A_CHUNK) -> Iterator[bytes]:
    total = max(1, -(-len(xyz) // chunk))
    for k in range(total):
        part, own = xyz[k * chunk : (k + 1) * chunk], cls[k * chunk : (k + 1) * chunk]
        yield header(CLOUD, frame, epoch, len(part), 0, k, total, yaw_cd) + part.astype("<f4").tobytes() + own.astype(np.uint8).tobytes()


def read_chunk(data: bytes) -> tuple[dict[str, int], np.ndarray, np.ndarray, np.ndarray]:
    """Header, rows (cells or points), classes and freed cells of one message."""
    data = inflated(data)
    head = read_header(data)
    n, at, wide = head["n_a"], HEADER.size, 3 if head["code"] == CLOUD else 6
    rows = np.frombuffer(data, "<f4", n * wide, at).reshape(n, wide)
    at += 4 * n * wide
    cls = np.frombuffer(data, np.uint8, n, at)
    at += n + (0 if head["code"] == CLOUD else 3 * n)
    return head, rows, cls, np.frombuffer(data, "<f4", 2 * head["n_b"], at).reshape(-1, 2)


MESSAGES = "seq_id string, epoch long, frame int, seq int, total int, body binary"


def pack(frames: DataFrame, rows: DataFrame, compress: bool = True) -> DataFrame:
    """Messages of all frames: (seq_id, epoch, frame, kind, yaw_cd) with (frame, op, ring, ...) rows.

    ``rows`` has ``op`` ('freed' or anything else), the columns of ``ROW`` and ``cls``. A frame
    without rows still gives one message. A frame's cells meet in one group, bounded by the
    grid's size.
    """
    keys = ["seq_id", "epoch", "frame"]
    joined = frames.select(*keys, "kind", "yaw_cd").join(rows.select(*keys, "op", *ROW, "cls"), keys, "left")

    def run(table: pa.Table) -> pa.Table:
        first = table.slice(0, 1).to_pylist()[0]
        op = np.array(table.column("op").to_pylist(), object)
        values = np.stack([table.column(c).to_numpy().astype(np.float64) for c in ROW], 1)
        order = np.lexsort((values[:, 1], values[:, 0]))
        live = order[(op[order] != "freed") & (op[order] != None)]  # noqa: E711
        gone = order[op[order] == "freed"]
        cls = np.nan_to_num(table.column("cls").to_numpy().astype(np.float64), nan=255)
        code = SNAPSHOT if first["kind"] == "snapshot" else DELTA
        bodies = list(cell_chunks(code, first["frame"], first["epoch"], values[live], cls[live], values[gone][:, :2] if code == DELTA else values[:0, :2], first["yaw_cd"] or 0))
        n = len(bodies)
        same = [pa.array([first[k]] * n, t) for k, t in zip(keys, (pa.string(), pa.int64(), pa.int32()), strict=True)]
        return pa.Table.from_arrays([*same, pa.array(range(n), pa.int32()), pa.array([n] * n, pa.int32()), pa.array([deflated(b) if compress else b for b in bodies], pa.binary())], [c.split()[0] for c in MESSAGES.split(", ")])

    return joined.groupBy(*keys).applyInArrow(run, MESSAGES)


DECODED = "seq_id string, epoch long, frame int, kind string, op string, ring int, sector int, z_mean float, z_max float, occ float, trav float, cls int"


def unpack(messages: DataFrame) -> DataFrame:
    """Cell rows of packed messages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in DECODED.split(", ")]
        for batch in batches:
            for seq_id, body in zip(batch.column("seq_id").to_pylist(), batch.column("body").to_pylist(), strict=True):
                head, rows, cls, freed = read_chunk(body)
                n, m = len(rows), len(freed)
                kind = "snapshot" if head["code"] == SNAPSHOT else "delta"
                both = np.concatenate([rows[:, :2], freed]).astype(np.int32)
                floats = [pa.array([*rows[:, k].tolist(), *[None] * m], pa.float32()) for k in range(2, 6)]
                yield pa.RecordBatch.from_arrays([pa.array([seq_id] * (n + m), pa.string()), pa.array([head["epoch"]] * (n + m), pa.int64()), pa.array([head["frame"]] * (n + m), pa.int32()), pa.array([kind] * (n + m), pa.string()), pa.array(["sent"] * n + ["freed"] * m, pa.string()), pa.array(both[:, 0]), pa.array(both[:, 1]), *floats, pa.array([*cls.tolist(), *[None] * m], pa.int32())], names)

    return messages.select("seq_id", "body").mapInArrow(run, DECODED)


def pack_clouds(points: DataFrame, yaw: DataFrame, compress: bool = True) -> DataFrame:
    """Messages of clouds (seq_id, epoch, frame, pid, cls, x, y, z); a cloud, bounded by the engine's cap, is one group."""
    keys = ["seq_id", "epoch", "frame"]
    joined = points.select(*keys, "pid", "x", "y", "z", "cls").join(yaw.select("seq_id", "frame", F.col("yaw_cd").cast("int").alias("yaw_cd")), ["seq_id", "frame"])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pid")
        first = table.slice(0, 1).to_pylist()[0]
        xyz = np.stack([table.column(c).to_numpy() for c in "xyz"], 1)
        bodies = list(cloud_chunks(first["frame"], first["epoch"], xyz, table.column("cls").to_numpy(), first["yaw_cd"]))
        n = len(bodies)
        same = [pa.array([first[k]] * n, t) for k, t in zip(keys, (pa.string(), pa.int64(), pa.int32()), strict=True)]
        return pa.Table.from_arrays([*same, pa.array(range(n), pa.int32()), pa.array([n] * n, pa.int32()), pa.array([deflated(b) if compress else b for b in bodies], pa.binary())], [c.split()[0] for c in MESSAGES.split(", ")])

    return joined.groupBy(*keys).applyInArrow(run, MESSAGES)


def unpack_clouds(messages: DataFrame) -> DataFrame:
    """Points of cloud messages, with the heading of their frame."""
    schema = "seq_id string, epoch long, frame int, seq int, yaw_cd int, x float, y float, z float, cls int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            for seq_id, body in zip(batch.column("seq_id").to_pylist(), batch.column("body").to_pylist(), strict=True):
                head, rows, cls, _ = read_chunk(body)
                n = len(rows)
                own = [pa.array([seq_id] * n, pa.string()), pa.array([head["epoch"]] * n, pa.int64()), *[pa.array([head[k]] * n, pa.int32()) for k in ("frame", "seq", "yaw_cd")]]
                yield pa.RecordBatch.from_arrays([*own, *[pa.array(rows[:, k].copy()) for k in range(3)], pa.array(cls.astype(np.int32))], names)

    return messages.select("seq_id", "body").mapInArrow(run, schema)


def complete_frames(messages: DataFrame) -> DataFrame:
    """Frames of which every chunk has arrived."""
    return messages.groupBy("seq_id", "epoch", "frame").agg(F.count_distinct("seq").alias("n"), F.max("total").alias("total")).filter("n = total").drop("n")


def json_snapshots(rows: DataFrame, keys: tuple[str, ...] = ("seq_id", "frame")) -> DataFrame:
    """{"type": "snapshot", "frame": ..., "cells": [[ring, sector, z_mean, z_max, occ, trav, cls], ...]}."""
    cell = F.array(*[F.col(c).cast("double") for c in (*ROW, "cls")])
    cells = F.transform(F.array_sort(F.collect_list(F.struct("ring", "sector", cell.alias("v")))), lambda s: s["v"])
    packed = rows.groupBy(*keys).agg(cells.alias("cells"))
    return packed.select(*keys, F.to_json(F.struct(F.lit("snapshot").alias("type"), "frame", "cells")).alias("message"))


def json_deltas(rows: DataFrame, keys: tuple[str, ...] = ("seq_id", "frame")) -> DataFrame:
    """{"type": "delta", "frame": ..., "updated": [...], "freed": [...]}."""
    live, place = F.array(*[F.col(c).cast("double") for c in ROW]), F.array(F.col("ring").cast("double"), F.col("sector").cast("double"))

    def listed(value, gone: bool):
        picked = F.when((F.col("op") == "freed") == F.lit(gone), F.struct("ring", "sector", value.alias("v")))
        return F.transform(F.array_sort(F.collect_list(picked)), lambda s: s["v"])

    packed = rows.groupBy(*keys).agg(listed(live, False).alias("updated"), listed(place, True).alias("freed"))
    return packed.select(*keys, F.to_json(F.struct(F.lit("delta").alias("type"), "frame", "updated", "freed")).alias("message"))


def json_rows(rows: DataFrame, kind: str) -> DataFrame:
    """One message of a given type for every row, such as stats or grid_meta."""
    return rows.select(F.to_json(F.struct(F.lit(kind).alias("type"), *rows.columns)).alias("message"))
