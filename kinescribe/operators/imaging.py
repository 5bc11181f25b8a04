"""Frames to candidate crops: text mask, crop box, signal and fingerprint (numpy in one Arrow pass).

Denoising and thresholding for a reading engine need OpenCV and are used only where it is installed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Greatest saturation and least value of white text by mode; bounds of yellow text (hue in half degrees).
WHITE = {"bright": (85, 175), "monochrome": (95, 160)}
YELLOW = ((14, 55, 110), (45, 255, 255))
FINGERPRINT = (24, 96)


def to_hsv(bgr: np.ndarray) -> np.ndarray:
    """8-bit hue (half degrees), saturation and value."""
    b, g, r = (bgr[..., i].astype(np.float64) for i in range(3))
    value, low = np.maximum(np.maximum(b, g), r), np.minimum(np.minimum(b, g), r)
    span = value - low
    safe = np.where(span == 0, 1, span)
    hue = np.where(value == r, (g - b) / safe, np.where(value == g, 2 + (b - r) / safe, 4 + (r - g) / safe)) * 30
    hue = np.where(span == 0, 0, np.where(hue < 0, hue + 180, hue))
    sat = np.where(value == 0, 0, span * 255 / np.where(value == 0, 1, value))
    return np.stack([np.rint(hue) % 180, np.rint(sat), value], -1)


def text_mask(bgr: np.ndarray, mode: str = "bright") -> np.ndarray:
    hsv = to_hsv(bgr)
    most, least = WHITE[mode]
    white = (hsv[..., 1] <= most) & (hsv[..., 2] >= least)
    yellow = np.all((hsv >= YELLOW[0]) & (hsv <= YELLOW[1]), axis=-1)
    return white | yellow


def _slide(mask: np.ndarray, size: int, axis: int, all_: bool) -> np.ndarray:
    """Whether all or any of the `size` (odd) cells around each one are set; beyond the edge nothing decides."""
    half = size // 2
    width = [(half, half) if a == axis else (0, 0) for a in range(2)]
    view = np.lib.stride_tricks.sliding_window_view(np.pad(mask, width, constant_values=all_), size, axis=axis)
    return view.all(-1) if all_ else view.any(-1)


def dilate(mask: np.ndarray, width: int = 9, height: int = 3) -> np.ndarray:
    return _slide(_slide(mask, width, 1, False), height, 0, False)


def erode(mask: np.ndarray, width: int = 9, height: int = 3) -> np.ndarray:
    return _slide(_slide(mask, width, 1, True), height, 0, True)


def boxes(mask: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Bounding boxes (x0, y0, x1, y1) of the mask's 8-connected parts: runs of each row, joined to the runs
    that they touch in the row above."""
    up: list[int] = []
    box: list[list[int]] = []

    def root(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i

    above: list[tuple[int, int, int]] = []
    for y, row in enumerate(mask):
        edge = np.flatnonzero(np.diff(np.concatenate(([0], row.astype(np.int8), [0]))))
        now = []
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            i = len(up)
            up.append(i)
            box.append([a, y, b, y + 1])
            for c, d, j in above:
                if c <= b and a <= d:
                    x, z = root(i), root(j)
                    if x != z:
                        up[max(x, z)] = min(x, z)
            now.append((a, b, i))
        above = now
    out: dict[int, list[int]] = {}
    for i, (a, y, b, e) in enumerate(box):
        o = out.setdefault(root(i), [a, y, b, e])
        o[:] = [min(o[0], a), min(o[1], y), max(o[2], b), max(o[3], e)]
    return [tuple(x) for x in out.values()]


def crop_box(frame: np.ndarray, bottom: float = 0.34, mode: str = "bright", pad_x: int = 24, pad_y: int = 18, least_mask: float = 0.0008) -> tuple[tuple[int, int, int, int], float]:
    """Box (x0, y0, x1, y1) of the likely caption in the frame's lower part, and the share of text-like cells."""
    height, width = frame.shape[:2]
    top = int(height * (1 - min(max(bottom, 0.10), 0.60)))
    mask = text_mask(frame[top:], mode)
    signal = float(mask.mean()) if mask.size else 0.0
    whole = (0, top, width, height)
    if signal < least_mask:
        return whole, signal
    for step in (dilate, dilate, erode, erode, dilate):
        mask = step(mask)
    found = [b for b in boxes(mask) if (b[2] - b[0]) * (b[3] - b[1]) >= 40 and b[2] - b[0] >= width * 0.015 and b[3] - b[1] >= 4]
    if not found:
        return whole, signal
    tall = height - top
    x0, y0 = max(0, min(b[0] for b in found) - max(0, pad_x)), max(0, min(b[1] for b in found) - max(0, pad_y))
    x1, y1 = min(width, max(b[2] for b in found) + max(0, pad_x)), min(tall, max(b[3] for b in found) + max(0, pad_y))
    need = max(48, int(height * 0.08))
    if y1 - y0 < need:
        y0 = max(0, (y0 + y1) // 2 - need // 2)
        y1 = min(tall, y0 + need)
    return (x0, top + y0, x1, top + y1), signal


def _shares(size: int, parts: int) -> np.ndarray:
    """Which share of each source cell each target cell takes when `size` cells become `parts` by area."""
    edges = np.linspace(0, size, parts + 1)
    at = np.arange(size)
    return np.clip(np.minimum(at + 1, edges[1:, None]) - np.maximum(at, edges[:-1, None]), 0, None) * parts / size


def fingerprint(image: np.ndarray) -> np.ndarray:
    """24 x 96 area means of the grey image, 0 to 1, as a vector."""
    grey = np.rint(image @ np.array([0.114, 0.587, 0.299])) if image.ndim == 3 else image
    small = _shares(grey.shape[0], FINGERPRINT[0]) @ grey @ _shares(grey.shape[1], FINGERPRINT[1]).T
    return (np.rint(small) / 255).astype(np.float32).ravel()


def preprocess(image: np.ndarray) -> np.ndarray:
    """A black and white crop for engines that need one; needs OpenCV."""
    try:
        import cv2
    except ImportError as error:
        raise RuntimeError("preprocessing needs OpenCV") from error
    grey = cv2.cvtColor(image, cv2.COLOR_BGR2GRAY) if image.ndim == 3 else image
    large = cv2.resize(grey, None, fx=2, fy=2, interpolation=cv2.INTER_CUBIC)
    even = cv2.createCLAHE(2.0, (8, 8)).apply(cv2.fastNlMeansDenoising(large, None, 10, 7, 21))
    return cv2.adaptiveThreshold(even, 255, cv2.ADAPTIVE_THRESH_GAUSSIAN_C, cv2.THRESH_BINARY, 31, 7)


SAMPLES = "run_id string, frame_index long, timestamp_seconds double, bbox array<int>, signal_score double, fingerprint array<float>"
IMAGES = "frame binary, crop binary, bw binary"


def sample_crops(frames: DataFrame, bottom: float = 0.34, mode: str = "bright", pad_x: int = 24, pad_y: int = 18, of: str = "preprocessed", images: bool = False) -> DataFrame:
    """From frames (run_id, frame_index, timestamp_seconds, height, width, data: BGR bytes) the crop's box, signal and
    fingerprint. Raw images don't leave this pass, so no later shuffle carries them.

    of: what fingerprints are taken of. `preprocessed`, for which the least difference of candidates is set, needs
    OpenCV; `crop` does not, and its differences are of another scale. images: adds the encoded files of frame, crop
    and preprocessed crop, so that frames are decoded once (needs OpenCV)."""
    if of not in ("preprocessed", "crop"):
        raise ValueError("fingerprints are of preprocessed or crop")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 16):
                part = batch.slice(i, 16)
                box, signal, prints, files = [], [], [], ([], [], [])
                for data, h, w in zip(part.column("data"), part.column("height").to_pylist(), part.column("width").to_pylist()):
                    frame = np.frombuffer(data.as_buffer(), np.uint8).reshape(h, w, 3)
                    (x0, y0, x1, y1), s = crop_box(frame, bottom, mode, pad_x, pad_y)
                    box.append([x0, y0, x1, y1])
                    signal.append(s)
                    crop = frame[y0:y1, x0:x1]
                    bw = preprocess(crop) if of == "preprocessed" or images else None
                    prints.append(fingerprint(bw if of == "preprocessed" else crop))
                    if images:
                        import cv2

                        for held, kind, image in zip(files, (".jpg", ".jpg", ".png"), (frame, crop, bw)):
                            held.append(cv2.imencode(kind, image)[1].tobytes())
                columns = [*[part.column(c) for c in ("run_id", "frame_index", "timestamp_seconds")], pa.array(box, pa.list_(pa.int32())), pa.array(signal), pa.array(prints, pa.list_(pa.float32()))]
                names = ["run_id", "frame_index", "timestamp_seconds", "bbox", "signal_score", "fingerprint"]
                if images:
                    columns, names = [*columns, *[pa.array(f, pa.binary()) for f in files]], [*names, "frame", "crop", "bw"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return frames.select("run_id", "frame_index", "timestamp_seconds", "height", "width", "data").mapInArrow(run, SAMPLES + (", " + IMAGES if images else ""))
