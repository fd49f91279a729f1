import json
import random

import numpy as np
import pytest

from polargrain.operators import delta
from polargrain.plans.config import StreamParams
from polargrain.sources import sinks, wire
from polargrain.streaming import live

S = StreamParams()


def simulate(frames, drops):
    """Cells by frame -> kinds, events and the client's final cells, step by step."""
    prev, sent, last, dropped, kinds, out, client = set(), {}, 0, 0, {}, [], {}
    for f in sorted(frames):
        now = frames[f]
        snap = f - last >= 5 or dropped >= 2
        kinds[f] = "snapshot" if snap else "delta"
        if f in drops:
            dropped += 1
            continue
        dropped = 0
        if snap:
            last, sent, client = f, dict(now), dict(now)
            out += [(c, f, "snapshot", *v) for c, v in now.items()]
        else:
            for c, v in now.items():
                if c not in prev:
                    op = "added"
                elif abs(v[0] - sent[c][0]) >= 0.05 or v[1] != sent[c][1]:
                    op = "changed"
                else:
                    continue
                out.append((c, f, op, *v))
                sent[c] = client[c] = v
            for c in prev - now.keys():
                out.append((c, f, "freed", None, None))
                sent.pop(c)
                client.pop(c)
        prev = set(now)
    return kinds, sorted(out, key=repr), client


def scene(seed, n=30):
    rnd = random.Random(seed)
    frames = {f: {c: (0.02 * rnd.randrange(6), rnd.randrange(2)) for c in range(25) if rnd.random() < 0.7} for f in range(1, n + 1)}
    for f in range(12, 20):  # a slow drift that only adds up over frames
        frames[f][99] = (0.02 * (f - 12), 0)
    drops = set(rnd.sample(range(2, n), 6)) | {n - 3, n - 4}
    return frames, drops


def tables(spark, frames, drops):
    cells = spark.createDataFrame([("a", f, c, z, k) for f, v in frames.items() for c, (z, k) in v.items()], "seq_id string, frame int, cell long, z_max double, cls int")
    sched = delta.delivery_schedule(spark.createDataFrame([("a", f, f not in drops) for f in frames], "seq_id string, frame int, delivered boolean"), S)
    return cells, sched


@pytest.mark.parametrize("seed", [1, 2])
def test_events_equal_simulation(spark, seed):
    frames, drops = scene(seed)
    kinds, want, client = simulate(frames, drops)
    cells, sched = tables(spark, frames, drops)
    assert {r.frame: r.kind for r in sched.collect()} == kinds
    told = delta.events(cells, sched, S)
    assert sorted([(r.cell, r.frame, r.op, r.z_max, r.cls) for r in told.collect()], key=repr) == want
    assert {r.cell: (r.z_max, r.cls) for r in delta.materialize(told, sched).collect()} == client


def test_fold_equals_simulation():
    for seed in range(10):
        frames, drops = scene(seed)
        kinds, want, _ = simulate(frames, drops)
        fold, got = live.DeltaFold(S), []
        for f in sorted(frames):
            fold = live.DeltaFold(S, fold.saved())
            kind, told = fold.frame(frames[f], f not in drops)
            assert kind == kinds[f]
            got += [(c, f, op, z, k) for op, c, z, k in told]
        assert sorted(got, key=repr) == want


def test_wire_bytes():
    rows, cls = np.arange(60, dtype=float).reshape(10, 6), np.arange(10)
    freed = np.array([[1.0, 2.0], [3.0, 4.0]])
    parts = list(wire.cell_chunks(wire.DELTA, 7, 3, rows, cls, freed, yaw_cd=-9000, chunk=4))
    assert [len(p) for p in parts] == [44 + 4 * 28, 44 + 4 * 28, 44 + 2 * 28 + 16]
    heads = [wire.read_chunk(p) for p in parts]
    assert [h["n_b"] for h, *_ in heads] == [0, 0, 2] and heads[0][0]["yaw_cd"] == -9000 and heads[2][0]["total"] == 3
    np.testing.assert_array_equal(np.concatenate([r for _, r, *_ in heads]), rows)
    np.testing.assert_array_equal(heads[2][3], freed)
    assert len(list(wire.cell_chunks(wire.SNAPSHOT, 1, 0, rows[:0], cls[:0], freed[:0]))) == 1
    cloud = list(wire.cloud_chunks(1, 0, np.ones((5, 3)), np.zeros(5), chunk=2))
    assert len(cloud) == 3 and wire.read_chunk(cloud[0])[1].shape == (2, 3)


def test_deflate_round_trip():
    rng = np.random.default_rng(0)
    noise = rng.integers(0, 256, 4096, dtype=np.uint8).tobytes()
    plain = b"ABCDEFGHIJKLMNOP" * 512
    assert wire.deflated(b"hello") == b"hello" and wire.deflated(noise) == noise
    small = wire.deflated(plain)
    assert small[:1] == b"Z" and len(small) < len(plain) and wire.inflated(small) == plain


def test_messages_round_trip_with_empty_frames(spark):
    rows = spark.createDataFrame([("a", 1, 2, "sent", 3, 4, 0.5, 1.0, 1.0, 0.25, 2), ("a", 1, 2, "freed", 9, 8, None, None, None, None, None)], "seq_id string, epoch long, frame int, op string, ring int, sector int, z_mean double, z_max double, occ double, trav double, cls int")
    frames = spark.createDataFrame([("a", 1, 2, "delta", 5), ("a", 1, 3, "snapshot", 0)], "seq_id string, epoch long, frame int, kind string, yaw_cd int")
    messages = wire.pack(frames, rows)
    assert sorted((r.frame, r.seq, r.total) for r in messages.collect()) == [(2, 0, 1), (3, 0, 1)]
    back = sorted(map(tuple, wire.unpack(messages).collect()), key=repr)
    assert back == sorted([("a", 1, 2, "delta", "sent", 3, 4, 0.5, 1.0, 1.0, 0.25, 2), ("a", 1, 2, "delta", "freed", 9, 8, None, None, None, None, None)], key=repr)
    assert wire.complete_frames(messages).count() == 2
    message = json.loads(wire.json_deltas(rows).first().message)
    assert message["updated"] == [[3, 4, 0.5, 1.0, 1.0, 0.25]] and message["freed"] == [[9, 8]]
    snap = json.loads(wire.json_snapshots(rows.filter("op = 'sent'")).first().message)
    assert snap == {"type": "snapshot", "frame": 2, "cells": [[3, 4, 0.5, 1.0, 1.0, 0.25, 2]]}


def test_frame_queue_is_atomic():
    q = sinks.FrameQueue(4)
    q.emit_text("t")
    assert q.emit_frame([b"1", b"2"]) and not q.emit_frame([b"3", b"4"])
    assert q.drain() == ["t"] and (q.emitted, q.dropped) == (1, 1)


def test_text_displaces_the_oldest_item_only():
    q = sinks.FrameQueue(3)
    q.emit_frame([b"1"], 1), q.emit_frame([b"2"], 2), q.emit_frame([b"3"], 3)
    q.emit_text("t")
    assert q.drain() == [b"2", b"3", "t"] and q.lost == [1] and (q.emitted, q.dropped) == (3, 0)
    q.emit_frame([b"4"], 4)
    assert not q.emit_frame([b"5"] * 3, 5) and q.lost == [1, 4] and q.dropped == 1


def test_fan_out_leaves_dead_clients():
    got, hub = [], sinks.FanOut()
    hub.add("a", got.append)
    hub.add("b", lambda m: 1 / 0)
    assert hub.send([b"x", "y"]) == 2 and got == [b"x", "y"] and set(hub.clients) == {"a"}


def test_player_seek_clamps_and_starts_epochs():
    class Query:
        stopped = False

        def stop(self):
            self.stopped = True

    begun = []
    player = live.Player(lambda *a: begun.append(a) or Query(), 10, "08")
    player.play()
    first = player.query
    assert player.seek(99) == 1 and first.stopped and begun[-1][:3] == ("08", 1, 9)
    player.pause()
    assert player.seek(-3) == 2 and player.query is None and player.at == 0


def test_player_starts_paused_and_previews():
    begun, seen = [], []

    class Query:
        def stop(self):
            pass

    player = live.Player(lambda *a: begun.append(a) or Query(), 10, "08", lambda *a: seen.append(a), lambda: 6)
    assert player.query is None and player.seek(4) == 1 and seen == [("08", 1, 4)] and not begun
    player.play()
    assert player.set_speed(99) == 10.0 and begun == [("08", 1, 4, 1.0, False), ("08", 1, 6, 10.0, False)]
    player.set_cloud(True)
    assert begun[-1] == ("08", 1, 6, 10.0, True)
    assert player.switch("09", 3) == 2 and begun[-1] == ("09", 2, 0, 10.0, True) and len(seen) == 1
    assert live.paced_interval(S, 2.0) == "50 milliseconds"


def test_injected_block_is_added_once():
    once = sinks.injected("# t\n", "| a |")
    assert once.count("| a |") == 1 and sinks.injected(once, "| b |") == once
