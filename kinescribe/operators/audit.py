"""The audit of a run: counts, settings and events by reason, one row a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The policy that audits state.
POLICY = "subtitle_first"
POLICY_NOTES = (
    "Text-bearing segments are preserved through timing even if overlap is needed.",
    "Timing cleanup records warnings instead of deleting segments that would become too short.",
    "Hard OCR boilerplate and empty cleaned text are still removed before merging.",
)


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("run_id", "reason").agg(F.count("*").alias("n"))


def summary(status: DataFrame, raw: DataFrame, cleaned: DataFrame, final: DataFrame, events: DataFrame, settings: dict[str, float]) -> DataFrame:
    """One row for each run that has observations; each count is a partial aggregation, joined by run."""
    when = lambda s: F.count_if(F.col("status") == s)
    base = status.groupBy("run_id").agg(F.count("*").alias("input_observation_count"), when("blank").alias("blank_observation_count"), when("usable").alias("usable_observation_count"), when("dropped").alias("dropped_observation_count"))
    for df, name in ((raw, "raw"), (cleaned, "cleaned"), (final, "final")):
        base = base.join(df.groupBy("run_id").agg(F.count("*").alias(f"{name}_segment_count")), "run_id", "left").fillna(0, [f"{name}_segment_count"])
    counts = event_counts(events).groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("event_counts"))
    out = base.join(counts, "run_id", "left").withColumn("event_counts", F.coalesce("event_counts", F.create_map().cast("map<string,bigint>")))
    fixed = F.struct(*[F.lit(float(v)).alias(k) for k, v in settings.items()])
    return out.withColumns({"policy": F.lit(POLICY), "policy_notes": F.array(*map(F.lit, POLICY_NOTES)), "settings": fixed})


def document(audit: DataFrame, dropped: DataFrame, events: DataFrame) -> DataFrame:
    """run_id and `value`: a run's whole audit as one JSON text, with its dropped observations in the order of input and
    its events in the order of stages and segments. A run's lists are one row, as its document is one file."""
    fields = [F.col(c) for c in ("stage", "reason", "frame_index", "timestamp_seconds", "crop_path", "preprocessed_path", "selected_text", "flags", "signal_score", "diff_score") if c in dropped.columns]
    in_order = lambda order, row, name: F.transform(F.array_sort(F.collect_list(F.struct(*order, row.alias("row")))), lambda x: x["row"]).alias(name)
    gone = dropped.groupBy("run_id").agg(in_order([F.col("input_ord"), F.col("frame_index")], F.struct(*fields), "dropped_observations"))
    late = F.col("stage_ord") == 1
    order = [F.col("stage_ord"), F.when(late, F.col("start_seconds")).otherwise(0.0).alias("start"), F.when(late, F.col("end_seconds")).otherwise(0.0).alias("end"), F.col("input_ord"), F.col("event_ord")]
    row = F.struct(*[F.col(c) for c in events.columns if c not in ("run_id", "input_ord", "event_ord", "stage_ord")])
    said = events.groupBy("run_id").agg(in_order(order, row, "events"))
    whole = audit.join(gone, "run_id", "left").join(said, "run_id", "left")
    whole = whole.withColumns({c: F.coalesce(c, F.array().cast(whole.schema[c].dataType)) for c in ("dropped_observations", "events")})
    keys = ["policy", "policy_notes", "settings", *[c for c in audit.columns if c.endswith("_count")], "event_counts", "dropped_observations", "events"]
    return whole.select("run_id", F.to_json(F.struct(*keys)).alias("value"))
