import json

from pyspark.sql import functions as F

from polargrain.__main__ import main
from polargrain.operators import segment
from polargrain.plans.engine import Engine
from polargrain.sources import synthetic, wire


def test_scans_to_messages_and_back(spark):
    engine = Engine(spark)
    scan = engine.classified(synthetic.scans(spark, 8, 400).drop("cls"))
    cells = engine.numbered(engine.cells(scan))
    frames = cells.select("seq_id", "frame").distinct().withColumn("delivered", F.col("frame") != 3)
    schedule = engine.schedule(frames)
    told = engine.events(cells, schedule)
    messages = engine.messages(cells, schedule)
    back = wire.unpack(messages)
    want = {(r.frame, r.op == "freed"): r.n for r in told.groupBy("frame", F.when(F.col("op") == "freed", "freed").otherwise("sent").alias("op")).agg(F.count("*").alias("n")).collect()}
    got = {(r.frame, r.op == "freed"): r.n for r in back.groupBy("frame", "op").agg(F.count("*").alias("n")).collect()}
    assert got == want and 3 not in {f for f, _ in got}
    final = engine.client_cells(told, schedule)
    last = cells.filter("frame = 8").select("cell")
    assert sorted(r.cell for r in final.collect()) == sorted(r.cell for r in last.collect())
    assert engine.snapshot(cells, "synthetic", 8).count() == last.count()
    assert engine.memory_report(cells).count() == 8


def test_evaluation_row(spark, tmp_path, capsys):
    pairs = spark.createDataFrame([(0, 0, 3.0), (1, 1, 7.0), (3, 4, 30.0), (255, 1, 2.0), (2, 2, 95.0)], "t int, p int, rng double")
    row = Engine(spark).evaluate(pairs).first()
    scores = {(m.scheme, m.band): m.miou for m in row.mious}
    assert scores[4, "all"] == 1.0 and scores[5, "0-5m"] == 1.0 and 0 < scores[5, "all"] < 1
    pairs.write.parquet(str(tmp_path / "pairs"))
    main(["evaluate", str(tmp_path / "pairs")])
    assert "mious" in json.loads(capsys.readouterr().out.strip().splitlines()[-1])


def test_bench_command(spark, capsys):
    main(["bench", "--frames", "2", "--points", "500"])
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["points"] == 1000


def test_rule_classes_follow_height(spark):
    df = spark.createDataFrame([(0.0, 0.1), (0.0, 0.9), (3.0, 0.1), (1.0, 0.9)], "z double, remission double")
    assert [r.cls5 for r in segment.RuleSegmenter().segment(df).collect()] == [0, 1, 2, 3]
