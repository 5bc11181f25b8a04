"""Streaming form of the greedy forced keep: state for each run, the time of the last row kept."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def greedy_keep_stream(candidates: DataFrame, min_diff: float = 0.030, every: float = 1.8) -> DataFrame:
    """run_id, frame_index, timestamp_seconds and diff_score of the kept rows of a stream. Rows of a run are taken
    in time order within a batch. The last time kept is the watermark: rows before it that come in a later batch are
    late and go, as a kept row can't be taken back; order the source by time where none may be lost."""

    def run(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else float("-inf")
        rows = pd.concat(list(batches)).sort_values(["timestamp_seconds", "frame_index"])
        kept = []
        for row in rows.itertuples(index=False):
            if row.timestamp_seconds >= last and (row.diff_score >= min_diff or row.timestamp_seconds - last >= every):
                last = row.timestamp_seconds
                kept.append((key[0], row.frame_index, row.timestamp_seconds, row.diff_score))
        state.update((last,))
        yield pd.DataFrame(kept, columns=["run_id", "frame_index", "timestamp_seconds", "diff_score"])

    schema = "run_id string, frame_index long, timestamp_seconds double, diff_score double"
    source = candidates.selectExpr("cast(run_id as string) run_id", "cast(frame_index as long) frame_index", "cast(timestamp_seconds as double) timestamp_seconds", "cast(diff_score as double) diff_score")
    return source.groupBy("run_id").applyInPandasWithState(run, schema, "last double", "append", GroupStateTimeout.NoTimeout)
