import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from polargrain.functions import display, geometry, labels, traversability
from polargrain.functions import projection as proj
from polargrain.operators import grid, images, metrics
from polargrain.plans.config import GridParams, GroundParams, ProjectionParams, load_config

G, P = GridParams(), ProjectionParams()


def test_grid_size():
    assert (G.phase1_rings, G.phase2_rings, G.n_rings, G.n_cells, G.bytes_per_cell) == (190, 462, 652, 469_440, 41)
    assert abs(G.widths[-1] - 0.49882) < 1e-4 and abs(G.edges[-1] - 100) < 1e-9
    assert GridParams(r_max=10.0).phase2_rings == 0 and GridParams(alpha=1.0).phase2_rings == 0


def test_ring_index_equals_binary_search(spark):
    rng = np.random.default_rng(0)
    edges = np.array(G.edges)
    r = np.concatenate([edges, edges - 1e-9, edges + 1e-9, rng.uniform(0, 130, 5000), [0.0, 0.5, 100.0, 1e9]])
    want = np.searchsorted(edges, np.clip(r, G.r_min, edges[-1] - 1e-9), "right") - 1
    got = spark.createDataFrame([(float(x),) for x in r], "r double").select(geometry.ring_index(F.col("r"), G)).toPandas().iloc[:, 0]
    assert (got.to_numpy() == want).all()


def test_sectors_wrap_and_cells_invert(spark):
    df = spark.createDataFrame([(math.pi,), (-math.pi,), (0.0,), (math.pi - 1e-9,), (-1e-9,)], "t double")
    assert [r[0] for r in df.select(geometry.sector_index(F.col("t"), G)).collect()] == [0, 0, 360, 719, 359]
    back = spark.range(0, G.n_cells, 997).select("id", geometry.cell_id(geometry.ring_of(F.col("id"), G), geometry.sector_of(F.col("id"), G), G).alias("c"))
    assert back.filter("id <> c").count() == 0


def test_reduce_golden(spark):
    rows = [(1, c, 0, c, z, k) for c, z, k in zip([0, 0, 0, 1, 1, 2], [1.0, 2.0, 3.0, 10.0, 20.0, 5.0], [3, 3, 1, 0, 2, 2], strict=True)]
    df = spark.createDataFrame(rows, "frame int, ring int, sector int, cell long, z double, cls int")
    got = {r.cell: r for r in grid.reduce_cells(df, ["frame"], G).collect()}
    assert [got[k].n_pts for k in range(3)] == [3, 2, 1]
    assert [got[k].z_min for k in range(3)] == [1, 10, 5] and [got[k].z_max for k in range(3)] == [3, 20, 5]
    assert [got[k].z_mean * got[k].n_pts for k in range(3)] == [6, 30, 5]
    assert [got[k].cls_counts for k in range(3)] == [[0, 1, 0, 2], [1, 0, 1, 0], [0, 0, 1, 0]]
    assert [got[k].cls for k in range(3)] == [3, 0, 2]  # the lowest class wins ties


def test_ignored_classes_count_as_points(spark):
    df = spark.createDataFrame([(1, 1.0, 0.1, 0.0, 255), (1, 1.0, 0.1, 1.0, 2)], "frame int, r double, theta double, z double, cls int")
    row = grid.cells(df, G).first()
    assert (row.n_pts, row.cls, row.cls_counts) == (2, 2, [0, 0, 1, 0])


def test_ground_carries_over_thin_frames(spark):
    rnd = random.Random(3)
    rows = [(1, 5.0, rnd.random()) for _ in range(200)] + [(2, 5.0, 3.0)] * 10 + [(3, 50.0, 1.0)] * 300 + [(4, 2.0, 0.5)] * 128
    got = {r.frame: r for r in grid.ground_reference(spark.createDataFrame(rows, "frame int, r double, z double"), GroundParams()).collect()}
    first = float(np.percentile([z for f, _, z in rows if f == 1], 20))
    assert abs(got[1].ground_z - first) < 1e-12 and got[2].ground_z == got[3].ground_z == got[1].ground_z and got[4].ground_z == 0.5
    thin = grid.ground_reference(spark.createDataFrame([(1, 5.0, 1.0)], "frame int, r double, z double"), GroundParams()).first()
    assert thin.ground_z == 0.0


def test_tiers_golden(spark):
    df = spark.createDataFrame([(v,) for v in (0.8, 0.6, 0.3, 0.0, 1.0)], "t double")
    assert [r[0] for r in df.select(traversability.tier(F.col("t"))).collect()] == [0, 1, 2, 2, 0]


def test_neighbours_do_not_wrap(spark):
    rows = [(1, 5, 0, 0.0, 1.0), (1, 5, 719, 9.0, 1.0), (1, 6, 1, 0.2, 1.0), (1, 4, 0, 5.0, 0.0)]
    got = {(r.ring, r.sector): r.max_step for r in grid.neighbor_slope(spark.createDataFrame(rows, "frame int, ring int, sector int, z_mean double, occ double"), G).collect()}
    assert got[(5, 0)] == pytest.approx(0.2) and got[(5, 719)] == 0.0


def test_nearest_wins(spark):
    pts = spark.createDataFrame([(1, 0, 5.0, 0.0, 1.0, 0.9), (1, 1, 3.0, 0.0, 0.5, 0.5)], "frame int, pid int, x double, y double, z double, remission double")
    image = images.range_image(pts, P).collect()
    best = min(r.ch0 for r in image)
    assert best * 80 == pytest.approx(math.sqrt(9.25))
    one = images.range_image(pts.filter("pid = 0"), P).first()
    assert one.ch0 == pytest.approx(math.sqrt(26) / 80) and one.ch4 == 0.9
    same = spark.createDataFrame([(1, 7, 3.0, 0.0, 0.1, 0.2), (1, 4, 3.0, 0.0, 0.1, 0.8)], pts.schema)
    assert images.range_image(same, P).first().pid == 4


def test_dense_images_round_trip(spark):
    p = ProjectionParams(h=8, w=16)
    pixels = spark.createDataFrame([(1, 2, 3, 0.5, 0.25, 0.0, 0.125, 1.0, 2), (1, 7, 15, 0.5, 0.0, 0.0, 0.0, 0.0, 0), (2, 0, 0, 0.75, 0.0, 0.0, 0.0, 0.5, 4)], "frame int, row int, col int, ch0 float, ch1 float, ch2 float, ch3 float, ch4 float, label int")
    back = images.sparse_pixels(images.dense_images(pixels, p), p)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, pixels.collect()))


def test_vote_sql_equals_array_vote(spark):
    rng = np.random.default_rng(4)
    p = ProjectionParams(h=5, w=6)
    probs = rng.dirichlet(np.ones(5), (5, 6))
    pixels = spark.createDataFrame([(0, i, j, [float(v) for v in probs[i, j]]) for i in range(5) for j in range(6)], "frame int, row int, col int, probs array<double>")
    points = spark.createDataFrame([(0, i, j) for i in range(5) for j in range(6)], "frame int, row int, col int")
    want = images.vote_in_image(probs.transpose(2, 0, 1), np.repeat(np.arange(5), 6), np.tile(np.arange(6), 5))
    got = {(r.row, r.col): r for r in images.vote_3x3(points, pixels, p).collect()}
    for k, (i, j) in enumerate((i, j) for i in range(5) for j in range(6)):
        np.testing.assert_allclose(got[i, j].probs, want[k])
        assert got[i, j].cls5 == want[k].argmax()


def test_augmentation_is_repeatable_and_bounded(spark):
    rows = [(f, r, c, 0.5, 0.1, 0.1, 0.1, 0.9) for f in range(30) for r in (0, 20, 63) for c in (0, 100, 2047)]
    pixels = spark.createDataFrame(rows, "frame int, row int, col int, ch0 double, ch1 double, ch2 double, ch3 double, ch4 double")
    a, b = (sorted(map(tuple, images.augmented(pixels, P, seed=5).collect())) for _ in range(2))
    assert a == b and all(0 <= r[7] <= 1 and 0 <= r[2] < 2048 for r in a) and a != sorted(map(tuple, pixels.collect()))


def test_labels(spark):
    df = spark.createDataFrame([(v,) for v in (40, 48, 50, 11, 255, 256, 65536 + 40, 77)], "raw long")
    got = [tuple(r) for r in df.select(labels.remap(labels.semantic(F.col("raw"))).alias("a"), labels.bin_5_to_4(labels.remap(labels.semantic(F.col("raw"))))).collect()]
    assert got == [(0, 0), (1, 1), (2, 2), (4, 3), (4, 3), (255, 255), (0, 0), (255, 255)]
    weights = labels.class_weights(labels.class_counts(spark.createDataFrame([(0,)] * 90 + [(1,)] * 10, "cls5 int"))).collect()
    assert len(weights) == 5 and all(0.1 <= r.weight <= 5 for r in weights)
    empty = labels.class_weights(labels.class_counts(spark.createDataFrame([], "cls5 int"))).collect()
    assert [r.weight for r in empty] == [1.0] * 5


def test_confusion_and_iou_golden(spark):
    def score(rows, n=5):
        return metrics.miou(metrics.iou(metrics.confusion(spark.createDataFrame(rows, "t int, p int")), n)).first()[0]

    assert score([(k, k) for k in range(5)] * 3) == 1.0
    assert score([(255, 1)]) == 0.0
    counts = metrics.confusion(spark.createDataFrame([(0, 0), (1, 1), (255, 2), (255, 0)], "t int, p int"))
    assert sum(r.n for r in counts.collect()) == 2


def test_latency_golden(spark):
    rows = spark.createDataFrame([(10.0,), (20.0,), (30.0,)], "ms double")
    got = metrics.latency_stats(rows, "ms").first()
    assert (got.mean, got.min, got.max, got.median) == (20, 10, 30, 20) and got.p90 == pytest.approx(28)
    assert tuple(metrics.latency_stats(rows.limit(0), "ms").first()) == (0, 0, 0, 0, 0, 0, 0)


def test_display_functions(spark):
    row = spark.range(1).select(
        display.distance_band(F.lit(5.0)).alias("a"), display.distance_band(F.lit(80.0)).alias("b"), display.size_label(F.lit(2048.0)).alias("c"), display.clock_label(F.lit(125.9)).alias("d"),
        display.seek_index(F.lit(0.5), F.lit(11)).alias("e"), display.height_ramp(F.lit(27.0)).alias("f"), proj.yaw_centidegrees(F.lit(1.0), F.lit(0.0)).alias("g"), display.log_bar_width(F.lit(10.0)).alias("h"),
    ).first()
    assert tuple(row) == ("5-10m", None, "2.0 MB", "02:05", 5, 2.0, 9000, 45.5)


def test_world_and_ego_are_inverse(spark):
    a = 0.3
    pose = [math.cos(a), -math.sin(a), 0.0, 5.0, math.sin(a), math.cos(a), 0.0, -2.0, 0.0, 0.0, 1.0, 0.5, 0.0, 0.0, 0.0, 1.0]
    df = spark.createDataFrame([(1.0, 2.0, 3.0, pose)], "x double, y double, z double, pose array<double>")
    back = df.select("pose", *proj.to_world()).select(*proj.to_ego()).first()
    np.testing.assert_allclose(tuple(back), (1, 2, 3))


def test_config_precedence(tmp_path):
    one, two = tmp_path / "a.yaml", tmp_path / "b.yaml"
    one.write_text("grid:\n  r_max: 50.0\n  n_theta: 360\ntraversability:\n  weights: [1, 1, 1, 1]\n")
    two.write_text("grid:\n  n_theta: 180\n")
    c = load_config(str(one), str(two), env={"POLARGRAIN_GRID_Z_MAX": "7", "POLARGRAIN_TRAVERSABILITY_ENABLED": "false"})
    assert (c.grid.r_max, c.grid.n_theta, c.grid.z_max, c.grid.r_transition) == (50.0, 180, 7.0, 50.0)
    assert c.traversability.weights == (1, 1, 1, 1) and c.traversability.enabled is False and c.grid.phase2_rings == 0


def test_finite_points_and_display_changes(spark):
    rows = [(1.0, 2.0, 3.0), (float("nan"), 0.0, 0.0), (float("inf"), 0.0, 0.0), (None, 0.0, 0.0)]
    assert grid.finite(spark.createDataFrame(rows, "x double, y double, z double")).count() == 1
    a = spark.createDataFrame([(1, 0.0, 1.0, 1.0, 0.5, 2), (2, 0.0, 1.0, 1.0, None, 2)], "cell long, z_mean double, z_max double, occ double, trav double, cls int")
    b = spark.createDataFrame([(1, 0.0, 1.0, 1.0, 0.5, 3), (2, 0.0, 1.0, 1.0, None, 2), (3, 0.0, 1.0, 1.0, 0.5, 2)], a.schema)
    assert sorted(r.cell for r in grid.display_changes(a, b).collect()) == [1, 3]


def test_meta_classes_and_loops(spark):
    from polargrain.sources import kitti

    meta = grid.grid_meta(spark, G).first()
    assert meta.n_rings == 652 and meta.class_colors["0"] == labels.class_table(spark).first().color
    two = kitti.looped(spark.createDataFrame([(0,), (2,)], "frame int"), 3, 2)
    assert sorted(r.frame for r in two.collect()) == [0, 2, 3, 5]
    assert metrics.peak(two, "frame").first().peak == 5
