"""Command line: python -m kinescribe.plans.cli benchmark | extract | refine ..."""

from __future__ import annotations

import argparse
from dataclasses import fields

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from kinescribe.operators import imaging
from kinescribe.plans import refine as plans
from kinescribe.schemas import Settings
from kinescribe.sources import io, video
from kinescribe.sources.staging import shared_table

_SKIP = {"video_path", "limit", "prompt", "vllm_model", "run_name", "start_seconds", "end_seconds", "tesseract_cmd"}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="kinescribe", description="Captions from burned-in text, on Spark.")
    commands = top.add_subparsers(dest="command", required=True)
    for name, flag, default in (("benchmark", "--limit", 40), ("extract", "--max-crops", None)):
        p = commands.add_parser(name)
        p.add_argument("video")
        p.add_argument(flag, dest="limit", type=int, default=default)
        for f in fields(Settings):
            if f.name not in _SKIP:
                choices = {"crop_mode": ["bright", "monochrome"], "ocr_backend": ["vllm", "tesseract", "both"]}.get(f.name)
                p.add_argument("--" + f.name.replace("_", "-"), type=type(f.default), default=f.default, choices=choices)
        for n, kind in (("run-name", str), ("start-seconds", float), ("end-seconds", float), ("vllm-model", str), ("tesseract-cmd", str)):
            p.add_argument("--" + n, type=kind, default=None)
    p = commands.add_parser("refine")
    p.add_argument("run_dir")
    p.add_argument("--output-suffix", default="refined")
    for n in ("merge-similarity", "merge-gap-seconds", "min-segment-seconds", "hold-seconds"):
        p.add_argument("--" + n, type=float, default=None)
    return top


def main(argv: list[str] | None = None) -> int:
    args = vars(parser().parse_args(argv))
    spark = SparkSession.builder.appName("kinescribe").getOrCreate()
    command = args.pop("command")
    if command == "refine":
        plans.refine(spark, args["run_dir"], args["output_suffix"], args["merge_similarity"], args["merge_gap_seconds"], args["min_segment_seconds"], args["hold_seconds"])
        print(f"Run complete: {args['run_dir']}")
        return 0
    settings = Settings(video_path=args.pop("video"), **args)
    video.register(spark)
    info = video.video_info(settings.video_path)
    frames = spark.read.format("video_frames").options(path=settings.video_path, stride=settings.scan_stride, start=settings.start_seconds or "", end=settings.end_seconds or "").load()
    bounds = spark.createDataFrame([(settings.video_path, settings.start_seconds or 0.0, settings.end_seconds if settings.end_seconds is not None else info["duration_seconds"])], "run_id string, start_seconds double, end_seconds double")
    # frames are decoded once; what follows reads slim columns of this table, and the files of those kept
    samples = shared_table(imaging.sample_crops(frames, settings.bottom_fraction, settings.crop_mode, settings.crop_padding_x, settings.crop_padding_y, images=True), "samples")
    kept = shared_table(plans.candidates(samples.drop("frame", "crop", "bw"), settings, bounds).drop("fingerprint"), "kept")
    run_dir = settings.run_dir(command)
    io.write_one_text(spark.createDataFrame([(io.settings_json(settings, command, kept.count(), info),)], "value string"), f"{run_dir}/run_config.json")
    io.write_candidates(kept, f"{run_dir}/candidates.json")
    crops = kept.join(samples.select("run_id", "frame_index", "frame", "crop", "bw"), ["run_id", "frame_index"]).withColumn("input_ord", F.col("ordinal").cast("long"))
    io.write_images(crops, f"{run_dir}/images")
    plans.run(plans.observe(crops.drop("frame"), settings), settings, command, run_dir)
    print(f"Run complete: {run_dir}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
