"""Command line: count the images of a folder.

    python -m motecraft.plans.cli --input FOLDER --output FOLDER [--input-list FILE] [--config FILE] [--scale X] [--scores TABLE | --model FOLDER] [--no-recovery]
"""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from motecraft.config import Config, Thresholds
from motecraft.operators import scoring
from motecraft.plans import images as plan
from motecraft.sources import images, sinks


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--input", required=True)
    parser.add_argument("--output", required=True)
    parser.add_argument("--input-list")
    parser.add_argument("--config", help="JSON object of parameters")
    parser.add_argument("--scale", type=float)
    scored = parser.add_mutually_exclusive_group()
    scored.add_argument("--scores", help="Parquet table image_id, id, score")
    scored.add_argument("--model", help="folder of a model of trees")
    parser.add_argument("--no-recovery", action="store_true")
    args = parser.parse_args(argv)
    cfg = Config.from_json(Path(args.config).read_text("utf-8-sig") if args.config else "{}", args.scale)
    spark = SparkSession.builder.getOrCreate()
    files = images.scan(spark, args.input)
    if args.input_list:
        files = images.selected(files, images.listed(spark, args.input_list)).drop("place")
    if files.isEmpty():
        parser.error("no images to count")
    problems = images.conflicts(files).limit(20).collect()
    if problems:
        parser.error("; ".join(f"{p['name']}: {p['problem']}" for p in problems))
    rows = images.decoded(spark, args.input, images.checked(files))
    scorer, thresholds = scoring.given(spark.read.parquet(args.scores)) if args.scores else None, Thresholds()
    if args.model:
        try:
            scorer, thresholds = scoring.ensemble(args.model, cfg.scale)
        except (OSError, KeyError, ValueError) as error:
            parser.error(f"the model can't be used: {error}")
    result = plan.count_images(rows, cfg, scorer, thresholds, recover=bool(scorer) and not args.no_recovery)
    sinks.write_bundle(result, args.output, cfg, model=bool(scorer), images=rows)
    failed = result["errors"].count()
    print(f"{result['summary'].count()} images counted, {failed} failed, {result['summary'].agg(F.sum('count')).first()[0]} points")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
