"""Video as a Spark data source: one row a sampled frame; frame ranges are partitions. Decoding needs OpenCV."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def video_info(path: str) -> dict:
    """Path, frame count, frames a second (25 where the file has none), size and duration."""
    cv2 = _cv2()
    video = cv2.VideoCapture(path)
    try:
        if not video.isOpened():
            raise ValueError(f"can't open video file {path}")
        count, fps = int(video.get(cv2.CAP_PROP_FRAME_COUNT)), float(video.get(cv2.CAP_PROP_FPS)) or 25.0
        return {"path": path, "frame_count": count, "fps": fps, "width": int(video.get(cv2.CAP_PROP_FRAME_WIDTH)), "height": int(video.get(cv2.CAP_PROP_FRAME_HEIGHT)), "duration_seconds": count / fps if fps > 0 else 0.0}
    finally:
        video.release()


def _cv2():
    try:
        import cv2
    except ImportError as error:
        raise RuntimeError("reading video files needs OpenCV") from error
    return cv2


def sampled_frames(count: int, fps: float, stride: int, start: float | None, end: float | None) -> range:
    """Frame numbers to read; at least the first is tried."""
    if stride < 1:
        raise ValueError("scan_stride must be at least 1")
    first = max(0, int((start or 0.0) * fps))
    last = min(int(end * fps) if end is not None else count - 1, count - 1)
    return range(first, max(first, last) + 1, stride)


class _Range(InputPartition):
    def __init__(self, frames: range) -> None:
        self.frames = frames


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[_Range]:
        o = self.options
        info = video_info(o["path"])
        number = lambda k: float(o[k]) if o.get(k) else None
        frames = sampled_frames(info["frame_count"], info["fps"], int(o.get("stride", 12)), number("start"), number("end"))
        size = int(o.get("framesPerPartition", 500))
        return [_Range(frames[i : i + size]) for i in range(0, len(frames), size)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        cv2 = _cv2()
        path = self.options["path"]
        fps = video_info(path)["fps"]
        video = cv2.VideoCapture(path)
        try:
            at = partition.frames.start
            video.set(cv2.CAP_PROP_POS_FRAMES, at)
            for wanted in partition.frames:
                while at < wanted and video.grab():
                    at += 1
                ok, frame = video.read()
                if at != wanted or not ok:
                    return
                at += 1
                yield (path, wanted, wanted / fps if fps > 0 else 0.0, frame.shape[0], frame.shape[1], frame.tobytes())
        finally:
            video.release()


class VideoFrames(DataSource):
    """spark.read.format("video_frames").option("path", ...).option("stride", 12)[.option("start" / "end", seconds)]"""

    @classmethod
    def name(cls) -> str:
        return "video_frames"

    def schema(self) -> str:
        return "run_id string, frame_index long, timestamp_seconds double, height int, width int, data binary"

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VideoFrames)
