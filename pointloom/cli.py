"""python -m pointloom.cli profile|mesh|segment ..."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from .model import PRESETS, SegmentConfig
from .operators import mesh
from .plans import pipelines
from .sources import las


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="pointloom")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("profile").add_argument("input")
    build = sub.add_parser("mesh")
    build.add_argument("input")
    build.add_argument("output")
    build.add_argument("--preset", choices=sorted(PRESETS), default="detail")
    cut = sub.add_parser("segment")
    cut.add_argument("input")
    cut.add_argument("output")
    for flag in ("--parts", "--include-misc", "--include-frames"):
        cut.add_argument(flag, action="store_true")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.WARNING, format="[%(asctime)s] %(message)s", datefmt="%H:%M:%S")
    logging.getLogger("pointloom").setLevel(logging.INFO)
    spark = SparkSession.builder.appName("pointloom").getOrCreate()
    points = spark.read.parquet(args.input) if args.input.endswith(".parquet") else las.load(spark, args.input)
    if args.command == "profile":
        scan = not args.input.endswith(".parquet")
        header = las.header_frame(spark, args.input).first().asDict() if scan else None
        print("\n".join([args.input, *pipelines.profile_report(points, header, las.size(args.input) if scan else None)]))
    elif args.command == "mesh":
        mesh.write_obj(*pipelines.reconstruct(points, PRESETS[args.preset]), args.output)
    else:
        pipelines.write_segmentation(pipelines.segment(points), SegmentConfig(), args.output, args.parts, args.include_misc, args.include_frames)


if __name__ == "__main__":
    main()
