"""refine, benchmark and extract as plans over many runs at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinescribe.operators import audit, cleanup, engines, islands, readings, select, timing
from kinescribe.schemas import Settings
from kinescribe.sources import io
from kinescribe.sources.staging import shared_table


@dataclass
class Refined:
    segments: DataFrame
    events: DataFrame
    dropped: DataFrame
    audit: DataFrame


def merge(observations: DataFrame, similarity: float = 0.86, gap: float = 4.0, min_segment: float = 0.65, hold: float = 1.2) -> Refined:
    """Observations (run_id, input_ord, frame_index, timestamp_seconds, selected_text) to timed segments.

    All of it is partitioned by run: rows of a run are shuffled once for the windows, then once as segments.
    The stages are written to the shared folder, as segments, events and the audit all read them; a text is
    so cleaned once in each stage, which the plan alone would not keep to.
    Runs without usable observations have an audit row of zeros and no segments."""
    # an own number of partitions: cleaning costs far more than its bytes, by which small partitions would be merged
    parts = int(observations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    observations = observations.repartition(parts, "run_id", "input_ord")
    status = shared_table(islands.observation_status(observations, keep_norm=True), "observations")
    usable = status.where("status = 'usable'")
    placed = shared_table(islands.islands(usable, gap, similarity, keep_norm=True), "islands")
    raw = islands.segments(placed, hold, F.col("norm")).withColumn("input_ord", F.col("island"))
    raw = shared_table(raw.drop("island"), "segments")
    cleaned, early = cleanup.cleanup(raw)
    cleaned = shared_table(cleaned, "cleaned")
    final, late = timing.timing_safety(cleaned, min_segment)
    events = early.withColumn("stage_ord", F.lit(0)).unionByName(late.withColumn("stage_ord", F.lit(1)))
    settings = {"merge_similarity": similarity, "merge_gap_seconds": gap, "min_segment_seconds": min_segment, "hold_seconds": hold}
    dropped = status.where("status = 'dropped'").drop("cleaned_text", "cleaned_norm", "status").withColumns({"stage": F.lit("observation_cleaning"), "reason": F.lit("cleaned_to_empty")})
    return Refined(final, events, dropped, audit.summary(status, raw, cleaned, final, events, settings))


def refine(spark: SparkSession, run_dir: str, suffix: str = "refined", similarity: float | None = None, gap: float | None = None, min_segment: float | None = None, hold: float | None = None) -> Refined:
    """Rebuilds captions from a run folder's ocr_results.jsonl; each knob as given, else as saved, else the default.
    Writes segments, captions, the audit and a report, with the suffix in their names."""
    saved = io.read_settings(spark, f"{run_dir}/run_config.json")
    given = {"merge_similarity": similarity, "merge_gap_seconds": gap, "min_segment_seconds": min_segment, "hold_seconds": hold}
    knobs = {k: Settings.knob(v, saved, k) for k, v in given.items()}
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{run_dir}/ocr_results.jsonl")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        raise FileNotFoundError(f"{run_dir}/ocr_results.jsonl")
    done = merge(io.read_observations(spark, f"{run_dir}/ocr_results.jsonl", run_dir.rstrip("/").rpartition("/")[2]), *knobs.values())
    end = f"_{suffix}" if suffix else ""
    write_outputs(done, run_dir, end)
    report = done.audit.select(
        "run_id", F.lit(f"{run_dir}/ocr_results.jsonl").alias("source_ocr_results"), F.col("input_observation_count").alias("observation_count"), F.col("final_segment_count").alias("segment_count"),
        *[F.lit(v).alias(k) for k, v in knobs.items()], F.lit(f"segments{end}.json").alias("output_segments"), F.lit(f"subtitles{end}.srt").alias("output_srt"), F.lit(f"merge_audit{end}.json").alias("output_merge_audit"),
    )
    io.write_json_rows(report, f"{run_dir}/refine{end}_report.json")
    return done


def write_outputs(done: Refined, run_dir: str, end: str) -> None:
    """The final segments, which three documents read, are computed once."""
    segments = shared_table(done.segments, "final")
    io.write_json_document(segments, f"{run_dir}/segments{end}.json", ["start_seconds", "end_seconds", "input_ord"])
    io.write_srt(segments, f"{run_dir}/subtitles{end}.srt")
    audit.document(done.audit, done.dropped, done.events).write.mode("overwrite").partitionBy("run_id").text(f"{run_dir}/merge_audit{end}.json")


def candidates(samples: DataFrame, settings: Settings, bounds: DataFrame | None = None) -> DataFrame:
    """Samples of frames to named candidates: change, greedy keep, and representatives if there is a limit."""
    return select.artifact_names(select.candidates(samples, settings.min_signal, settings.min_diff, settings.force_every_seconds, settings.limit, bounds))


def observe(crops: DataFrame, settings: Settings) -> DataFrame:
    """Crops with images to observations, by the engines of the settings."""
    return readings.choose_reading(engines.read_crops(crops, engines.engines_for(settings)))


def run(observations: DataFrame, settings: Settings, mode: str, run_dir: str) -> Refined | None:
    """Writes the observation log and the review sheet; extract goes on to captions, benchmark stops there."""
    io.write_jsonl(observations, f"{run_dir}/ocr_results.jsonl")
    io.write_review(readings.review_rows(observations), f"{run_dir}/benchmark_review.csv")
    if mode == "benchmark":
        return None
    done = merge(observations, settings.merge_similarity, settings.merge_gap_seconds, settings.min_segment_seconds, settings.hold_seconds)
    write_outputs(done, run_dir, "")
    return done
