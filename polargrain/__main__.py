"""Command line: catalog, snapshot, shards, evaluate, bench."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from polargrain.plans.config import load_config
from polargrain.plans.engine import Engine
from polargrain.sources import sinks, synthetic


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="polargrain")
    parser.add_argument("--config", action="append", default=[], help="YAML file; later files win")
    jobs = parser.add_subparsers(dest="job", required=True)
    jobs.add_parser("catalog").add_argument("root")
    snap = jobs.add_parser("snapshot")
    snap.add_argument("root")
    snap.add_argument("seq_id")
    snap.add_argument("frame", type=int)
    shards = jobs.add_parser("shards")
    shards.add_argument("root")
    shards.add_argument("out")
    shards.add_argument("--split", default="train")
    shards.add_argument("--seq", action="append")
    shards.add_argument("--size", type=int, default=200)
    shards.add_argument("--force", action="store_true")
    evaluate = jobs.add_parser("evaluate", help="score a Parquet table of (t, p, rng)")
    evaluate.add_argument("pairs")
    evaluate.add_argument("--out")
    bench = jobs.add_parser("bench", help="time the grid on synthetic scans")
    bench.add_argument("--frames", type=int, default=30)
    bench.add_argument("--points", type=int, default=20_000)
    args = parser.parse_args(argv)

    spark = SparkSession.builder.appName("polargrain").getOrCreate()
    engine = Engine(spark, load_config(*args.config))
    if args.job == "catalog":
        engine.sequences(args.root).orderBy("seq_id").show(1000, False)
    elif args.job == "snapshot":
        scan = engine.classified(engine.scans(args.root, [args.seq_id], (args.frame, args.frame + 1)))
        engine.snapshot(engine.cells(scan), args.seq_id, args.frame).orderBy("cell").show(20, False)
    elif args.job == "shards":
        meta = engine.write_training_shards(args.root, args.out, args.split, args.seq, "overwrite" if args.force else "errorifexists", args.size)
        print(meta.toJSON().first())
    elif args.job == "evaluate":
        result = engine.evaluate(spark.read.parquet(args.pairs))
        if args.out:
            sinks.write_json(result, args.out)
        print(result.toJSON().first())
    else:
        points = synthetic.scans(spark, args.frames, args.points)
        began = time.time()
        n = engine.cells(points).agg(F.count(F.lit(1))).first()[0]
        took = time.time() - began
        print(json.dumps({"frames": args.frames, "points": args.frames * args.points, "cells": n, "ms_a_frame": round(1000 * took / args.frames, 2)}))


if __name__ == "__main__":
    main()
