"""Snapshots and deltas of the grid: delivery schedule, events, client state."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polargrain.plans.config import StreamParams


def fold_schedule(frames: list[int], delivered: list[bool], s: StreamParams) -> list[tuple[int, str, bool, int]]:
    """(frame, kind, delivered, drops before) in order; only delivered snapshots restart the cadence."""
    last, drops, out = 0, 0, []
    for frame, ok in zip(frames, delivered, strict=True):
        snapshot = frame - last >= s.snapshot_interval or drops >= s.catchup_drops
        out.append((frame, "snapshot" if snapshot else "delta", ok, drops))
        if ok:
            last, drops = (frame if snapshot else last), 0
        else:
            drops += 1
    return out


def delivery_schedule(frames: DataFrame, s: StreamParams, key: str = "seq_id") -> DataFrame:
    """Kind of every frame of (key, frame, delivered), and the ordinal of delivered ones.

    The fold needs a sequence's frames in order; a row a frame, thousands for a sequence.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        out = pd.DataFrame(fold_schedule(pdf["frame"].tolist(), pdf["delivered"].tolist(), s), columns=["frame", "kind", "delivered", "drops"])
        out.insert(0, key, pdf[key].iloc[0])
        return out

    kinds = frames.groupBy(key).applyInPandas(fold, f"{key} string, frame int, kind string, delivered boolean, drops int")
    order = Window.partitionBy(key).orderBy("frame")
    ordinal = F.sum(F.col("delivered").cast("int")).over(order)
    return kinds.withColumn("ordinal", F.when(F.col("delivered"), ordinal))


def events(cell_rows: DataFrame, schedule: DataFrame, s: StreamParams, key: str = "seq_id") -> DataFrame:
    """Cell events of delivered frames: snapshot, added, changed and freed.

    ``changed`` compares with what was last sent, not with the frame before, so drifts add up.
    Cells are cut into islands: runs of consecutive delivered frames, also cut at snapshots
    (which send everything). An island is folded as one short array, at most one snapshot
    interval long in steady state. One shuffle on the cell serves windows, fold and frees.
    """
    sent = schedule.filter("delivered")
    heads = sent.select(key, "frame", "kind", "ordinal")  # one row a frame, broadcast if its size allows
    rows = cell_rows.select(key, "frame", "cell", "z_max", "cls").join(heads, [key, "frame"])
    order = Window.partitionBy(key, "cell").orderBy("ordinal")
    before, after = F.lag("ordinal").over(order), F.lead("ordinal").over(order)
    gap = before.isNull() | (before != F.col("ordinal") - 1)
    marked = rows.withColumn("gap", gap).withColumn("head", F.col("gap") | (F.col("kind") == "snapshot")).withColumn("leaves", after.isNull() | (after != F.col("ordinal") + 1))
    islands = marked.withColumn("island", F.sum(F.col("head").cast("int")).over(order))
    each = F.array_sort(F.collect_list(F.struct("ordinal", "frame", "kind", "z_max", "cls", "gap")))
    folded = islands.groupBy(key, "cell", "island").agg(each.alias("steps"))
    kind = "array<struct<frame:int,op:string,z_max:double,cls:int>>"

    def step(state, x):
        first = state["z"].isNull()
        moved = (F.abs(x["z_max"] - state["z"]) >= s.height_step) | (x["cls"] != state["c"])
        op = F.when(x["kind"] == "snapshot", "snapshot").when(first, "added").when(moved, "changed")
        event = F.array(F.struct(x["frame"].alias("frame"), op.alias("op"), x["z_max"].cast("double").alias("z_max"), x["cls"].cast("int").alias("cls")))
        out = F.when(op.isNotNull(), F.concat(state["out"], event)).otherwise(state["out"])
        return F.struct(F.when(op.isNotNull(), x["z_max"].cast("double")).otherwise(state["z"]).alias("z"), F.when(op.isNotNull(), x["cls"].cast("int")).otherwise(state["c"]).alias("c"), out.alias("out"))

    init = F.struct(F.lit(None).cast("double").alias("z"), F.lit(None).cast("int").alias("c"), F.array().cast(kind).alias("out"))
    told = folded.withColumn("e", F.explode(F.aggregate("steps", init, step, lambda a: a["out"]))).select(key, "cell", "e.frame", "e.op", "e.z_max", "e.cls")
    following = sent.select(key, F.col("frame").alias("next_frame"), (F.col("ordinal") - 1).alias("ordinal"), F.col("kind").alias("next_kind"))
    gone = marked.filter("leaves").join(following.filter("next_kind = 'delta'"), [key, "ordinal"])
    freed = gone.select(key, "cell", F.col("next_frame").alias("frame"), F.lit("freed").alias("op"), F.lit(None).cast("double").alias("z_max"), F.lit(None).cast("int").alias("cls"))
    return told.unionByName(freed)


def event_counts(told: DataFrame, key: str = "seq_id") -> DataFrame:
    return told.groupBy(key, "frame", "op").agg(F.count(F.lit(1)).alias("n"))


def materialize(told: DataFrame, schedule: DataFrame, key: str = "seq_id", gap_policy: str = "keep") -> DataFrame:
    """The client's cells after the last delivered frame: last event of each cell since the last snapshot.

    ``gap_policy='purge'`` also forgets cells that a delta after a gap of frames did not send.
    """
    sent = schedule.filter("delivered")
    snap = sent.groupBy(key).agg(F.coalesce(F.max(F.when(F.col("kind") == "snapshot", F.col("frame"))), F.lit(0)).alias("base"))
    if gap_policy == "purge":
        order = Window.partitionBy(key).orderBy("frame")
        gaps = sent.withColumn("before", F.lag("frame").over(order)).filter((F.col("kind") == "delta") & (F.col("frame") - F.col("before") > 1))
        snap = snap.join(gaps.groupBy(key).agg(F.max("frame").alias("gap")), key, "left").select(key, F.greatest("base", F.coalesce("gap", F.lit(0))).alias("base"))
    recent = told.join(snap, key).filter(F.col("frame") >= F.col("base"))
    last = recent.groupBy(key, "cell").agg(F.max_by(F.struct("op", "z_max", "cls", "frame"), "frame").alias("e"))
    return last.filter("e.op <> 'freed'").select(key, "cell", "e.z_max", "e.cls", F.col("e.frame").alias("sent_frame"))


def current_epoch_only(rows: DataFrame, key: str = "seq_id") -> DataFrame:
    """Rows of every sequence's latest epoch."""
    latest = rows.groupBy(key).agg(F.max("epoch").alias("epoch"))
    return rows.join(latest, [key, "epoch"], "left_semi")


def fresh_only(frames: DataFrame, key: str = "seq_id", order: str = "arrival") -> DataFrame:
    """Drops frames that arrive after a frame of the same or a higher number."""
    earlier = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return frames.withColumn("top", F.max("frame").over(earlier)).filter(F.col("top").isNull() | (F.col("frame") > F.col("top"))).drop("top")


def frozen(frames: DataFrame, freeze_frame: int) -> DataFrame:
    """What a paused client still takes."""
    return frames.filter(F.col("frame") <= freeze_frame)


def frame_gaps(frames: DataFrame, *keys: str) -> DataFrame:
    """Frames missing before each frame of its sequence (or of other ``keys``)."""
    order = Window.partitionBy(*(keys or ("seq_id",))).orderBy("frame")
    return frames.withColumn("missing", F.coalesce(F.col("frame") - F.lag("frame").over(order) - 1, F.lit(0)))


def purged_slots(slots: DataFrame, delta_rows: DataFrame, keys: list[str], most: int = 50_000) -> DataFrame:
    """Slots that a delta after a gap of frames did not send, at most ``most`` in the order of ``keys``."""
    return slots.join(delta_rows, keys, "left_anti").orderBy(*keys).limit(most)


def stale_cells(slots: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    return slots.join(cells, keys, "left_anti")


def missing_cells(cells: DataFrame, slots: DataFrame, keys: list[str], most: int = 5000) -> DataFrame:
    return cells.join(slots, keys, "left_anti").orderBy(*keys).limit(most)


def compacted(slots: DataFrame, key: str, order: str) -> DataFrame:
    """Dense renumbering of live slots."""
    return slots.withColumn("slot", F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1)
