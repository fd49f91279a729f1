import io
import math
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from polargrain.operators import cloud, etl, grid, images, segment
from polargrain.plans.config import GridParams, ProjectionParams, StreamParams
from polargrain.sources import kitti, sinks, synthetic


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("sequences")
    rng = np.random.default_rng(42)
    for seq, n in (("00", 3), ("08", 5)):
        (base / seq / "velodyne").mkdir(parents=True)
        (base / seq / "labels").mkdir()
        for k in range(n):
            scan = np.concatenate([rng.uniform(-40, 40, (100, 2)), rng.uniform(-2, 3, (100, 1)), rng.random((100, 1))], 1).astype("<f4")
            scan.tofile(base / seq / "velodyne" / f"{k * 2:06d}.bin")
            if not (seq == "08" and k == 1):
                rng.choice([40, 48, 50, 11, 255, 0], 90 if (seq, k) == ("08", 2) else 100).astype("<u4").tofile(base / seq / "labels" / f"{k * 2:06d}.label")
    (base / "08" / "poses.txt").write_text("".join(f"1 0 0 {k} 0 1 0 0 0 0 1 0\n" for k in range(5)))
    (base / "08" / "calib.txt").write_text("P0: 1\nTr: 0 -1 0 1 0 0 -1 0 1 0 0 2\n")
    return base


def test_scans_by_position(spark, root):
    pts = kitti.read_scans(spark, str(root))
    assert {(r.seq_id, r.frame): r.n for r in pts.groupBy("seq_id", "frame").agg(F.count("*").alias("n")).collect()} == {**{("00", k): 100 for k in range(3)}, **{("08", k): 100 for k in range(5)}}
    raw = np.fromfile(root / "08" / "velodyne" / "000004.bin", "<f4").reshape(-1, 4)
    got = kitti.read_frame(spark, str(root), "08", 2).orderBy("pid").toPandas()[["x", "y", "z", "remission"]].to_numpy()
    np.testing.assert_array_equal(got, raw)
    assert kitti.read_frame(spark, str(root), "08", 50).count() == 0


def test_catalog_and_poses(spark, root):
    assert sorted(map(tuple, kitti.sequence_catalog(spark, str(root)).collect())) == [("00", 3, False, True), ("08", 5, True, True)]
    assert kitti.read_poses(spark, str(root / "00")) is None
    got = {r.pose_id: np.array(r.pose).reshape(4, 4) for r in kitti.read_poses(spark, str(root / "08")).collect()}
    tr = np.array([[0, -1, 0, 1], [0, 0, -1, 0], [1, 0, 0, 2], [0, 0, 0, 1.0]])
    pose = np.eye(4)
    pose[0, 3] = 3
    np.testing.assert_allclose(got[3], pose @ tr)


def test_training_etl(spark, root, tmp_path):
    p = ProjectionParams()
    labelled = etl.labelled_points(kitti.read_scans(spark, str(root)), kitti.read_labels(spark, str(root)))
    frames = {(r.seq_id, r.frame) for r in labelled.select("seq_id", "frame").distinct().collect()}
    assert frames == {("00", 0), ("00", 1), ("00", 2), ("08", 0), ("08", 3), ("08", 4)}  # no labels, and unequal lengths
    kept = etl.training_points(labelled, p)
    assert kept.filter("cls5 = 255 or rng > 80").count() == 0
    pixels = etl.training_pixels(kept, p)
    keys = ("seq_id", "frame")
    dense = images.dense_images(pixels, p, keys)
    assignment = etl.shard_assignment(pixels.select(*keys).distinct(), size=4)
    assert sorted((r.seq_id, r.frame, r.shard, r.sample) for r in assignment.collect()) == [("00", 0, 0, 0), ("00", 1, 0, 1), ("00", 2, 0, 2), ("08", 0, 0, 0), ("08", 3, 1, 1), ("08", 4, 1, 2)]
    etl.write_shards(dense, assignment, str(tmp_path / "shards"), "train")
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == 6 and {r.shard for r in back.select("shard").distinct().collect()} == {0, 1}
    with pytest.raises(Exception, match="(?i)exist"):
        etl.write_shards(dense, assignment, str(tmp_path / "shards"), "train")
    tars = etl.write_tar_shards(dense, assignment.filter("seq_id = '00'"), str(tmp_path / "tars")).collect()
    assert [(r.shard, r.samples) for r in tars] == [(0, 3)]
    want = sorted((bytes(r.image), bytes(r.labels)) for r in dense.filter("seq_id = '00'").collect())
    assert sorted((bytes(r.image), bytes(r.labels)) for r in kitti.read_tar_shards(spark, str(tmp_path / "tars")).collect()) == want
    meta = etl.shard_metadata(kept.withColumn("split", F.when(F.col("seq_id") == "08", "val").otherwise("train"))).first()
    assert (meta.n_train, meta.n_val, meta.sequences) == (3, 3, ["00", "08"]) and sum(meta.class_counts) == kept.count()
    a = [r.frame for r in etl.shuffled_samples(assignment, 1).collect()]
    assert a == [r.frame for r in etl.shuffled_samples(assignment, 1).collect()]


def test_tar_shards_pair_members(spark, tmp_path):
    with tarfile.open(tmp_path / "shard-000000.tar", "w") as tar:
        for name, data in (("000000.ri", b"a"), ("000001.li", b"B"), ("000000.li", b"A"), ("note.ri", b"x"), ("000001.ri", b"b"), ("000002.ri", b"c")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    got = sorted((r.key, bytes(r.image), bytes(r.labels)) for r in kitti.read_tar_shards(spark, str(tmp_path)).collect())
    assert got == [(0, b"a", b"A"), (1, b"b", b"B")]


def test_history_and_eval_files(spark, tmp_path):
    log = tmp_path / "history.jsonl"
    log.write_text('{"step": 1, "val_loss": 0.5}\n\nnot json\n{"step": 2, "miou_4class": 0.25}\n{"step": 3,\n')
    assert sorted(r.step for r in kitti.read_history(spark, str(log)).collect()) == [1, 2]
    assert kitti.read_history(spark, str(tmp_path / "none.jsonl")).count() == 0
    (tmp_path / "eval_20260101_000000.json").write_text('{"v": 1}')
    (tmp_path / "eval_20260201_000000.json").write_text('{\n"v": 2}')
    assert kitti.read_newest_eval(spark, str(tmp_path)).first().v == 2
    sinks.append_history(spark.createDataFrame([(1, 0.5)], "step long, val_loss double"), str(tmp_path / "h"))
    sinks.append_history(spark.createDataFrame([(2, 0.4)], "step long, val_loss double"), str(tmp_path / "h"))
    assert kitti.read_history(spark, str(tmp_path / "h")).count() == 2


def test_synthetic_scans_are_repeatable(spark):
    a = synthetic.scans(spark, 2, 500)
    assert a.collect() == synthetic.scans(spark, 2, 500).collect() and a.count() == 1000
    cells = grid.cells(a, GridParams())
    assert 0 < cells.count() <= 1000 and grid.rendered(cells, GridParams()).count() == cells.count()


def test_accumulated_cloud_equals_loop(spark):
    s = StreamParams(cloud_frames=3, cloud_max=40)
    rng = np.random.default_rng(1)
    pts = {f: rng.normal(size=(20 + f, 3)) for f in range(6)}
    poses = []
    for k in range(4):
        a = 0.2 * k
        poses.append(np.array([[math.cos(a), -math.sin(a), 0, k], [math.sin(a), math.cos(a), 0, 0.5], [0, 0, 1, 0.1 * k], [0, 0, 0, 1]]))
    df = spark.createDataFrame([("08", f, i, *map(float, v), 0) for f, m in pts.items() for i, v in enumerate(m)], "seq_id string, frame int, pid int, x double, y double, z double, cls int")
    pose_df = spark.createDataFrame([(k, [float(v) for v in m.ravel()]) for k, m in enumerate(poses)], "pose_id int, pose array<double>")
    got = cloud.accumulate(cloud.world_points(df, pose_df), pose_df, s).toPandas()
    for f in range(6):
        hist = [pts[g] @ poses[g % 4][:3, :3].T + poses[g % 4][:3, 3] for g in range(max(0, f - 2), f + 1)]
        stride = max(1, math.ceil(sum(map(len, hist)) / 40))
        world = np.concatenate([h[::stride] for h in hist])[:40]
        ego = (world - poses[f % 4][:3, 3]) @ poses[f % 4][:3, :3]
        part = got[got["at"] == f].sort_values(["frame", "pid"])[["ex", "ey", "ez"]].to_numpy()
        np.testing.assert_allclose(part, ego, atol=1e-9)


def test_segmenters(spark):
    p = ProjectionParams(h=8, w=32)
    pts = synthetic.scans(spark, 2, 300).drop("cls")
    ruled = segment.RuleSegmenter().segment(pts)
    assert {r.cls5 for r in ruled.select("cls5").distinct().collect()} <= {0, 1, 2, 3}

    def load():
        return lambda x: np.stack([x[:, 0], 1 - x[:, 0], x[:, 4], 0 * x[:, 0], 0 * x[:, 0]], 1)

    got = segment.BatchModelSegmenter(load, p).segment(pts)
    assert got.count() == 600 and got.filter("cls5 not between 0 and 4").count() == 0
    assert segment.BatchModelSegmenter(load, p).segment(pts.limit(0)).count() == 0


def test_a_frame_opens_its_own_file_only(spark, tmp_path):
    for seq, stem, data in (("00", "000000", b"\0" * 32), ("00", "000001", b"odd length"), ("01", "000000", b"odd length")):
        kitti.put(f"file://{tmp_path}/{seq}/velodyne/{stem}.bin", data)
    assert kitti.read_frame(spark, f"file://{tmp_path}", "00", 0).count() == 2
    assert kitti.read_frame(spark, f"file://{tmp_path}", "00", 9).count() == 0
    plan = kitti.read_labelled_scans(spark, f"file://{tmp_path}")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Join") and "content" not in plan


def test_long_series_are_numbered_without_one_task(spark):
    from polargrain.operators import ordered

    rows = spark.range(5000).selectExpr("cast(id % 3 as string) as k", "id * 7919 % 5000 as v", "id")
    got = ordered.numbered(rows, ("k",), ["v", "id"], "rn", 16)
    by = {}
    for r in got.collect():
        by.setdefault(r.k, []).append((r.rn, r.v))
    for pairs in by.values():
        pairs.sort()
        assert [n for n, _ in pairs] == list(range(1, len(pairs) + 1)) and [v for _, v in pairs] == sorted(v for _, v in pairs)
    assert ordered.sliced(rows, ("k",), "v", 16).select("slice").distinct().count() >= 12
    none = ordered.numbered(rows.limit(0), ("k",), ["v", "id"])
    assert none.collect() == []
