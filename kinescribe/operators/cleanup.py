"""Segments before timing: cleaning, validity, one split of long ones; each decision is an event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinescribe.functions import text as tx
from kinescribe.functions.base import let
from kinescribe.functions.layout import GAP, LONG, SHORT, long_split, text_lines
from kinescribe.sources.staging import shared_table

#: What an event may say beyond its segment; fields that a reason doesn't use are null, and not written.
DETAILS = (
    "threshold_seconds", "first_duration_seconds", "second_duration_seconds", "original_end_seconds", "adjusted_end_seconds", "minimum_duration_seconds", "maximum_duration_seconds",
    "next_start_seconds", "duration_after_trim_seconds", "kept_end_seconds", "non_overlap_duration_seconds", "drop_threshold_seconds",
)
EVENT = "struct<stage:string,reason:string,start_seconds:double,end_seconds:double,duration_seconds:double,text:string,frame_indices:array<bigint>,observation_count:bigint,cleaned_text:string," + ",".join(f"{d}:double" for d in DETAILS) + ">"


def event(test: Column, stage: str, reason: str, start: Column, end: Column, text: Column, cleaned_text: Column | None = None, **details: Column) -> Column:
    fields = {
        "stage": F.lit(stage), "reason": F.lit(reason), "start_seconds": start, "end_seconds": end, "duration_seconds": end - start, "text": text, "frame_indices": F.col("frame_indices"),
        "observation_count": F.col("observation_count"), "cleaned_text": F.lit(None) if cleaned_text is None else cleaned_text, **{d: details.get(d, F.lit(None)) for d in DETAILS},
    }
    return F.when(test, F.struct(*[v.alias(k) for k, v in fields.items()])).cast(EVENT)


def split_long(text: Column, start: Column, end: Column) -> Column:
    """struct(pieces, short): one piece or two (text, start, end). Texts of over LONG characters are cut once; the
    time is shared by length, with a gap. If a piece would be under SHORT seconds nothing is cut, and short has
    both durations; else it is null."""
    kind = "struct<first:double,second:double>"
    one = lambda short: F.struct(F.array(F.struct(text.alias("text"), start.alias("start"), end.alias("end"))).alias("pieces"), short.cast(kind).alias("short"))
    none = F.lit(None)

    def cut(parts: Column) -> Column:
        share = F.length(parts[0]) / F.greatest(F.lit(1), F.length(parts[0]) + F.length(parts[1]))
        at = F.least(F.greatest(start + F.greatest(F.lit(0.0), end - start) * share, start), F.greatest(start, end - GAP))

        def pieces(t: Column) -> Column:
            second = F.least(end, t + GAP)
            two = F.array(F.struct(parts[0].alias("text"), start.alias("start"), t.alias("end")), F.struct(parts[1].alias("text"), second.alias("start"), end.alias("end")))
            short = F.struct((t - start).alias("first"), (end - second).alias("second"))
            return F.when((t - start < SHORT) | (end - second < SHORT), one(short)).otherwise(F.struct(two.alias("pieces"), none.cast(kind).alias("short")))

        return F.when(parts.isNull(), one(none)).otherwise(let(at, pieces))

    long = lambda joined: F.when(F.length(joined) <= LONG, one(none)).otherwise(let(long_split(joined), cut))
    return let(F.array_join(text_lines(text), " "), long)


def cleanup(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments, events), from segments of cleaned texts. Short segments are noted and kept; those whose text is empty or noise after another
    cleaning go, with an event; suspicious texts seen once are noted and kept; long ones are cut once and each
    piece is cleaned again. input_ord keeps the order; events have (input_ord, event_ord).

    Each judgement reads the text before it several times, so the texts are written between them: filters and
    generators over computed columns would otherwise compute the whole chain again for each use."""
    start, end, text = F.col("start_seconds"), F.col("end_seconds"), F.col("text")
    once = F.col("observation_count") <= 1
    s = shared_table(segments.withColumn("__clean", tx.clean_again(text)), "cleaned")
    s = s.withColumn("__valid", F.col("__clean") != "")
    s = s.withColumn("__odd", F.when(F.col("__valid") & once, tx.suspicious_clean(F.col("__clean"))).otherwise(False))
    s = s.withColumn("__cut", F.when(F.col("__valid"), split_long(F.col("__clean"), start, end)))
    length = end - start
    before = F.array_compact(F.array(
        event(length < SHORT, "cleanup", "short_segment_preserved_before_timing", start, end, text, threshold_seconds=F.lit(SHORT)),
        event(~F.col("__valid"), "cleanup", "dropped_segment_invalid_text", start, end, text, cleaned_text=F.col("__clean")),
        event(F.col("__odd"), "cleanup", "suspicious_single_observation_preserved", start, end, text, cleaned_text=F.col("__clean")),
        event(F.col("__cut.short").isNotNull(), "cleanup", "long_segment_not_split_to_preserve_short_piece", start, end, F.col("__clean"), threshold_seconds=F.lit(SHORT), first_duration_seconds=F.col("__cut.short.first"), second_duration_seconds=F.col("__cut.short.second")),
    ))
    s = shared_table(s.withColumn("__events", before), "judged")
    p = s.where("__valid").select(*segments.columns, "__cut", F.posexplode("__cut.pieces").alias("piece", "__p"))
    p = p.withColumns({"start_seconds": F.col("__p.start"), "end_seconds": F.col("__p.end"), "__before": F.col("__p.text"), "text": F.when(F.size("__cut.pieces") == 1, tx.clean_again(F.col("__p.text"))).otherwise(tx.clean(F.col("__p.text")))})
    p = shared_table(p.drop("__p", "__cut"), "pieces")
    p = p.withColumn("__valid", F.col("text") != "")
    p = p.withColumn("__odd", F.when(F.col("__valid") & once, tx.suspicious_clean(F.col("text"))).otherwise(False))
    after = F.array_compact(F.array(
        event(~F.col("__valid"), "cleanup", "dropped_split_segment_invalid_text", start, end, F.col("__before"), cleaned_text=text),
        event(F.col("__odd"), "cleanup", "suspicious_split_segment_preserved", start, end, F.col("__before"), cleaned_text=text),
    ))
    events = s.select("run_id", "input_ord", F.posexplode("__events").alias("event_ord", "e")).unionByName(p.select("run_id", "input_ord", F.posexplode(after).alias("k", "e"), "piece").select("run_id", "input_ord", (10 + 2 * F.col("piece") + F.col("k")).alias("event_ord"), "e"))
    out = p.where("__valid").select(*segments.columns, "piece")
    return out.withColumn("input_ord", F.col("input_ord") * 2 + F.col("piece")).drop("piece"), events.select("run_id", "input_ord", "event_ord", "e.*")
