"""Schemas of the tables, and the settings of a run."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields
from datetime import datetime
from pathlib import PurePath

OBSERVATIONS = "frame_index long, timestamp_seconds double, crop_path string, preprocessed_path string, selected_text string, results array<struct<backend:string,text:string,confidence:double,error:string,raw:string>>, flags array<string>, signal_score double, diff_score double"

#: Fixed value: the instruction that goes with each image.
PROMPT = """Read only overlaid subtitle/intertitle text visible in this image.
Return an empty string if there is no subtitle or intertitle.
Do not describe, interpret, summarize, or identify the scene.
Do not transcribe objects, clothing, signs, logos, years, titles, or labels unless they are clearly part of the overlaid subtitle/intertitle.
Do not guess missing words.
Preserve punctuation and line breaks when clear."""


@dataclass(frozen=True)
class Settings:
    """Everything that a run can be told. Names and defaults are part of the saved format and of the results."""

    video_path: str = ""
    output_root: str = "output"
    run_name: str | None = None
    scan_stride: int = 12
    bottom_fraction: float = 0.34
    crop_mode: str = "bright"
    crop_padding_x: int = 24
    crop_padding_y: int = 18
    min_signal: float = 0.0015
    min_diff: float = 0.030
    force_every_seconds: float = 1.8
    start_seconds: float | None = None
    end_seconds: float | None = None
    limit: int | None = None
    ocr_backend: str = "vllm"
    vllm_base_url: str = "http://localhost:8000/v1"
    vllm_model: str | None = None
    vllm_timeout_seconds: float = 120.0
    tesseract_cmd: str | None = None
    merge_similarity: float = 0.86
    merge_gap_seconds: float = 4.0
    min_segment_seconds: float = 0.65
    hold_seconds: float = 1.2
    prompt: str = PROMPT

    def __post_init__(self) -> None:
        if self.scan_stride < 1:
            raise ValueError("scan_stride must be at least 1")
        if self.crop_mode not in ("bright", "monochrome") or self.ocr_backend not in ("vllm", "tesseract", "both"):
            raise ValueError("unknown crop mode or reading backend")

    def run_dir(self, mode: str) -> str:
        name = self.run_name or f"{PurePath(self.video_path).stem}_{mode}_{datetime.now():%Y%m%d_%H%M%S}"
        return f"{self.output_root}/{name}"

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def knob(cls, given, saved: dict, name: str):
        """A setting as given, else as saved if that is a number, else the default."""
        default = next(f.default for f in fields(cls) if f.name == name)
        if given is not None:
            return given
        try:
            return float(saved.get(name, default))
        except (TypeError, ValueError):
            return default
