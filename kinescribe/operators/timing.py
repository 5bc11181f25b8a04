"""Timing safety: reading-speed bounds by displayed length, and no overlap where a caption stays long enough."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinescribe.functions.base import let
from kinescribe.functions.layout import GAP, display_length
from kinescribe.operators.cleanup import event

# Displayed characters up to, least and greatest seconds; the last row holds beyond.
RANGES = ((15, 1.0, 1.9), (25, 1.5, 2.7), (39, 2.4, 3.5), (46, 3.5, 4.2), (55, 3.8, 5.0))
BEYOND = (3.8, 5.0)
TRIM_FLOOR, MARGIN = 0.6, 1.10


def duration_range(length: Column, floor: float) -> Column:
    """struct(least, most) seconds for a displayed length; least is at least floor."""
    pair = lambda low, high: F.struct(F.lit(max(floor, low)).alias("least"), F.lit(high).alias("most"))

    def choose(n: Column) -> Column:
        out = F.when(n <= RANGES[0][0], pair(*RANGES[0][1:]))
        for limit, low, high in RANGES[1:]:
            out = out.when(n <= limit, pair(low, high))
        return out.otherwise(pair(*BEYOND))

    return let(length, choose)


def timing_safety(segments: DataFrame, min_segment: float = 0.65, gap: float = GAP, length: Column | None = None, scale: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(segments, events), in the order of start, end and input_ord. An end is raised to the least duration and
    held to the greatest plus a tenth; if it would pass the next segment's start less gap, it is trimmed to
    that where TRIM_FLOOR seconds stay, else the overlap stays. scale stretches all durations, for sparse data."""
    order = Window.partitionBy("run_id").orderBy("start_seconds", "end_seconds", "input_ord")
    length = display_length(F.col("text")) if length is None else length
    s = segments.withColumn("__next", F.greatest(F.lit(0.0), F.lead("start_seconds").over(order))).withColumn("__next", F.when(F.lead("input_ord").over(order).isNotNull(), F.col("__next")))
    s = s.withColumn("__range", duration_range(length, min_segment)).withColumn("__start", F.greatest(F.lit(0.0), F.col("start_seconds")))
    s = s.withColumn("__source", F.greatest(F.col("__start"), F.col("end_seconds")))
    start, source = F.col("__start"), F.col("__source")
    s = s.withColumn("__want", F.least(F.greatest(source, start + F.col("__range.least") * scale), start + F.col("__range.most") * (MARGIN * scale)))
    s = s.withColumn("__latest", F.when(F.col("__next").isNotNull(), F.greatest(start, F.col("__next") - gap)))
    want, latest = F.col("__want"), F.col("__latest")
    over = F.coalesce(want > latest, F.lit(False))
    room = F.coalesce(latest - start >= TRIM_FLOOR * scale, F.lit(False))
    a, b, text = F.col("start_seconds"), F.col("end_seconds"), F.col("text")
    s = s.withColumn("__events", F.array_compact(F.array(
        event(want > source, "timing", "duration_extended", a, b, text, original_end_seconds=source, adjusted_end_seconds=want, minimum_duration_seconds=F.col("__range.least")),
        event(want < source, "timing", "duration_capped", a, b, text, original_end_seconds=source, adjusted_end_seconds=want, maximum_duration_seconds=F.col("__range.most")),
        event(over & room, "timing", "trimmed_to_avoid_overlap", a, b, text, original_end_seconds=want, adjusted_end_seconds=latest, next_start_seconds=F.col("__next"), duration_after_trim_seconds=latest - start),
        event(over & ~room, "timing", "overlap_preserved_to_keep_subtitle", a, b, text, kept_end_seconds=want, next_start_seconds=F.col("__next"), non_overlap_duration_seconds=latest - start, drop_threshold_seconds=F.lit(TRIM_FLOOR)),
    )))
    events = s.select("run_id", "input_ord", F.posexplode("__events").alias("event_ord", "e")).select("run_id", "input_ord", "event_ord", "e.*")
    out = s.withColumns({"start_seconds": start, "end_seconds": F.when(over & room, latest).otherwise(want)})
    return out.select(*segments.columns), events


def remove_overlaps(segments: DataFrame, gap: float = GAP) -> DataFrame:
    """Ends cut to the next segment's start less gap, but not before their own start."""
    order = Window.partitionBy("run_id").orderBy("start_seconds", "end_seconds", "input_ord")
    after = F.lead("start_seconds").over(order) - gap
    cut = F.least(F.col("end_seconds"), F.greatest(F.col("start_seconds"), after))
    return segments.withColumn("end_seconds", F.when(after.isNull(), F.col("end_seconds")).otherwise(cut))
