"""Choosing frames: strided samples, signal and change, the greedy forced keep, representatives."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUN = "run_id"
ORDER = ("timestamp_seconds", "frame_index")


def stride_sample(frames: DataFrame, stride: int, fps: float, start: float | None = None, end: float | None = None) -> DataFrame:
    """Every stride-th frame from int(start * fps) to int(end * fps), both in; the first one always. Frames of
    a table with one row a frame, so the range is a filter that a columnar scan can push down."""
    if stride < 1:
        raise ValueError("scan_stride must be at least 1")
    first = max(0, int((start or 0.0) * fps))
    keep = (F.col("frame_index") >= first) & ((F.col("frame_index") - first) % stride == 0)
    if end is not None:
        keep = keep & (F.col("frame_index") <= max(first, int(end * fps)))
    return frames.where(keep)


def vector_distance(left: Column, right: Column) -> Column:
    """Mean absolute difference of two vectors; 1 if there is no left one."""
    total = F.aggregate(F.zip_with(left, right, lambda a, b: F.abs(a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return F.when(left.isNull(), 1.0).otherwise(total / F.size(right))


def with_difference(samples: DataFrame, fingerprint: str = "fingerprint") -> DataFrame:
    """diff_score to the sample before in the run, kept or not; the first one's is 1."""
    before = F.lag(fingerprint).over(Window.partitionBy(RUN).orderBy(*ORDER))
    return samples.withColumn("diff_score", vector_distance(before, F.col(fingerprint)))


def greedy_keep(candidates: DataFrame, min_diff: float = 0.030, every: float = 1.8) -> DataFrame:
    """Candidates with a diff_score of min_diff or more, and those `every` seconds or more after the last one
    kept, whichever way that was kept (the first always).

    Rows kept for their change, and rows `every` seconds or more after the row before, are kept whatever went
    before; a run is cut at them into stretches, which are dealt out, and each stretch is walked in order from
    kept row to kept row. Only the last kept time is held, however long a stretch is."""
    order = Window.partitionBy(RUN).orderBy(*ORDER)
    gap = F.col("timestamp_seconds") - F.lag("timestamp_seconds").over(order)
    sure = F.coalesce(F.col("diff_score") >= min_diff, F.lit(False)) | F.coalesce(gap >= every, F.lit(True))
    marked = candidates.withColumn("__sure", sure).withColumn("__stretch", F.sum(F.col("__sure").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    names = candidates.columns

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = -np.inf
        for batch in batches:
            time, first = batch.column("timestamp_seconds").to_numpy(zero_copy_only=False).astype(np.float64), batch.column("__sure").to_numpy(zero_copy_only=False)
            keep = np.zeros(batch.num_rows, bool)
            starts = np.flatnonzero(first)
            # what goes on from the batch before, then each stretch from its first row, which is kept
            for a, b in zip([0, *starts.tolist()], [*starts.tolist(), batch.num_rows]):
                at = a
                if a < b and first[a]:
                    keep[a], last, at = True, time[a], a + 1
                while at < b:
                    at += int(np.searchsorted(time[at:b], last + every))
                    while at > a and time[at - 1] - last >= every and not keep[at - 1]:
                        at -= 1
                    while at < b and time[at] - last < every:
                        at += 1
                    if at < b:
                        keep[at], last, at = True, time[at], at + 1
            yield batch.select(names).filter(pa.array(keep))

    return marked.repartition(RUN, "__stretch").sortWithinPartitions(RUN, "__stretch", *ORDER).mapInArrow(walk, candidates.schema)


def representatives(candidates: DataFrame, limit: int, bounds: DataFrame) -> DataFrame:
    """For each of `limit` evenly spaced times of a run (one: the middle) the candidate nearest to it among
    those that are nearer to it than to any other (the lower time of equals, the earlier candidate of
    equals). Times without candidates give none. bounds: run_id, start_seconds, end_seconds.

    A candidate's nearest time follows from arithmetic, checked against its neighbours, not from a join
    with all times."""
    c = candidates.join(bounds.select(RUN, F.col("start_seconds").alias("__from"), F.col("end_seconds").alias("__to")), RUN)
    t, a, b = F.col("timestamp_seconds"), F.col("__from"), F.col("__to")
    at = lambda i: (a + b) / 2 if limit == 1 else a + (b - a) * i / F.lit(limit - 1)
    if limit == 1:
        near = F.struct(F.abs(t - at(F.lit(0))).alias("off"), F.lit(0).alias("target"))
    else:
        guess = F.when(b == a, F.lit(0)).otherwise(F.floor(F.try_divide((t - a) * (limit - 1), b - a))).cast("int")
        near = F.array_min(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1), F.lit(2)), lambda d: F.transform(F.array(F.greatest(F.lit(0), F.least(F.lit(limit - 1), guess + d))), lambda i: F.struct(F.abs(t - at(i)).alias("off"), i.alias("target")))[0]))
    c = c.withColumn("__near", near)
    first = Window.partitionBy(RUN, "__near.target").orderBy("__near.off", *ORDER)
    c = c.withColumn("__rank", F.row_number().over(first)).where("__rank = 1")
    return c.select(*candidates.columns, F.col("__near.target").alias("target"))


def candidates(samples: DataFrame, min_signal: float = 0.0015, min_diff: float = 0.030, every: float = 1.8, limit: int | None = None, bounds: DataFrame | None = None) -> DataFrame:
    """Samples with enough signal that changed or are due; with a positive limit, representatives of them."""
    kept = greedy_keep(with_difference(samples).where(F.col("signal_score") >= min_signal), min_diff, every)
    return representatives(kept, limit, bounds) if limit and limit > 0 else kept


def artifact_names(kept: DataFrame) -> DataFrame:
    """Ordinals from 1 in a run, and the names of the three image files."""
    ordinal = F.row_number().over(Window.partitionBy(RUN).orderBy(*ORDER))
    stem = F.format_string("%05d_frame_%07d", F.col("ordinal"), F.col("frame_index"))
    return kept.withColumn("ordinal", ordinal).withColumns({
        "frame_path": F.concat(F.lit("frames/"), stem, F.lit(".jpg")),
        "crop_path": F.concat(F.lit("crops/"), stem, F.lit("_crop.jpg")),
        "preprocessed_path": F.concat(F.lit("preprocessed/"), stem, F.lit("_bw.png")),
    })
