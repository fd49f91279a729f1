"""Sinks: histories, evaluation results, metadata, and a lossy frame queue."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append_history(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("append").json(path)


def write_json(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A small result as JSON; ``mode`` decides what happens to an older one."""
    rows.coalesce(1).write.mode(mode).json(path)


def eval_result(pairs_iou: DataFrame, pairs_miou: DataFrame, counts: DataFrame) -> DataFrame:
    """One nested row: mean and class scores by scheme and band, and the confusion entries."""
    ious = pairs_iou.groupBy().agg(F.array_sort(F.collect_list(F.struct("scheme", "band", "cls", "iou"))).alias("class_ious"))
    mious = pairs_miou.groupBy().agg(F.array_sort(F.collect_list(F.struct("scheme", "band", "miou"))).alias("mious"))
    cells = counts.groupBy().agg(F.array_sort(F.collect_list(F.struct("scheme", "band", "t", "p", "n"))).alias("confusion"))
    return ious.crossJoin(F.broadcast(mious)).crossJoin(F.broadcast(cells)).withColumn("timestamp", F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss"))


def markdown_table(rows: DataFrame, columns: list[str], order: list[str]) -> str:
    """A small result as a Markdown table."""
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    for r in rows.orderBy(*order).select(*columns).collect():
        lines.append("| " + " | ".join("-" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |")
    return "\n".join(lines)


def injected(text: str, block: str, start: str = "<!-- eval:start -->", end: str = "<!-- eval:end -->") -> str:
    """``text`` with a marked block appended, unless the markers are there already."""
    return text if start in text and end in text else f"{text.rstrip()}\n\n{start}\n{block}\n{end}\n"


def with_block(text: Column, block: str, start: str = "<!-- eval:start -->", end: str = "<!-- eval:end -->") -> Column:
    """The same for a column of texts."""
    there = text.contains(start) & text.contains(end)
    return F.when(there, text).otherwise(F.concat(F.regexp_replace(text, r"\s+$", ""), F.lit(f"\n\n{start}\n{block}\n{end}\n")))


class FrameQueue:
    """A bounded queue that never keeps part of a frame.

    A frame's messages are queued together or not at all. When they do not fit, the frame and
    the queued binary messages are dropped, and text stays. A text message that does not fit
    displaces the oldest item only. ``dropped`` counts refused frames; frames that were queued
    and go unsent are listed in ``lost``, so that a sender can take back their delivery.
    """

    def __init__(self, size: int = 32):
        self.size, self.held = size, deque()
        self.emitted = self.dropped = 0
        self.lost: list[int] = []

    def _forget(self, gone: Iterable[tuple[int | None, bytes | str]]) -> None:
        self.lost += sorted({frame for frame, _ in gone if frame is not None} - set(self.lost))

    def emit_text(self, message: str) -> None:
        while len(self.held) >= self.size:
            frame, _ = oldest = self.held.popleft()
            self._forget([oldest])
            if frame is not None:  # never part of a frame
                self.held = deque(m for m in self.held if m[0] != frame)
        self.held.append((None, message))

    def emit_frame(self, messages: Iterable[bytes], frame: int | None = None) -> bool:
        messages, frame = list(messages), self.emitted + self.dropped if frame is None else frame
        if len(self.held) + len(messages) > self.size:
            gone = [m for m in self.held if m[0] is not None]
            self._forget(gone)
            self.held = deque(m for m in self.held if m[0] is None)
            self.dropped += 1
            return False
        self.held.extend((frame, m) for m in messages)
        self.emitted += 1
        return True

    def drain(self) -> list[bytes | str]:
        out = [m for _, m in self.held]
        self.held.clear()
        return out


class FanOut:
    """Hands every message to all live clients; a client that fails is left out from then on."""

    def __init__(self):
        self.clients: dict[str, Callable[[bytes | str], None]] = {}

    def add(self, name: str, send: Callable[[bytes | str], None]) -> None:
        self.clients[name] = send

    def send(self, messages: Iterable[bytes | str]) -> int:
        """Deliver in order; the number of messages that at least one client took."""
        taken = 0
        for message in messages:
            alive = {}
            for name, send in self.clients.items():
                try:
                    send(message)
                    alive[name] = send
                except Exception:  # noqa: BLE001  a dead client must not stop the others
                    continue
            self.clients = alive
            taken += bool(alive)
        return taken


def emit_frames(messages: DataFrame, queue: FrameQueue) -> list[tuple[int, bool]]:
    """(frame, delivered) of a batch of packed messages, a frame at a time in order; a batch is a few frames."""
    rows = messages.select("frame", "seq", "body").orderBy("frame", "seq").toLocalIterator()
    out, frame, bodies = [], None, []
    for r in [*rows, None]:
        if bodies and (r is None or r["frame"] != frame):
            out.append((frame, queue.emit_frame(bodies, frame)))
            bodies = []
        if r is not None:
            frame = r["frame"]
            bodies.append(bytes(r["body"]))
    return out
