"""Reading engines: a registry of functions that read crops, each run over partitions with one client.

An engine is `factory(options) -> read(crop: bytes, bw: bytes, suffix: str) -> dict` with text, confidence,
error and raw. Whatever a read raises becomes an error result.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinescribe.functions import text as tx
from kinescribe.schemas import Settings

ENGINES: dict[str, Callable] = {}


def register(name: str, factory: Callable) -> None:
    ENGINES[name] = factory


def data_url(content: Column, path: Column) -> Column:
    """An image as a data URL: PNG by its name, else JPEG."""
    kind = F.when(F.lower(path).endswith(".png"), "image/png").otherwise("image/jpeg")
    return F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.regexp_replace(F.base64(content), "[\r\n]", ""))


def _vision(options: dict) -> Callable:
    import requests

    root, model = options["base_url"].rstrip("/"), options.get("model")

    def read(crop: bytes, bw: bytes | None, suffix: str) -> dict:
        nonlocal model
        if not model:
            answer = requests.get(f"{root}/models", timeout=20)
            answer.raise_for_status()
            model = (answer.json().get("data") or [{}])[0].get("id")
            if not model:
                raise RuntimeError("the server lists no model")
        url = f"data:image/{'png' if suffix == '.png' else 'jpeg'};base64,{base64.b64encode(crop).decode()}"
        content = [{"type": "text", "text": options["prompt"]}, {"type": "image_url", "image_url": {"url": url}}]
        answer = requests.post(f"{root}/chat/completions", json={"model": model, "temperature": 0, "max_tokens": 128, "messages": [{"role": "user", "content": content}]}, timeout=options["timeout"])
        answer.raise_for_status()
        text = answer.json()["choices"][0]["message"]["content"]
        return {"text": text, "raw": text}

    return read


def _literal(options: dict) -> Callable:
    import io

    import pytesseract
    from PIL import Image

    if options.get("command"):
        pytesseract.pytesseract.tesseract_cmd = options["command"]

    def number(x) -> float:
        try:
            return float(x)
        except ValueError:
            return -1.0

    def read(crop: bytes, bw: bytes | None, suffix: str) -> dict:
        data = pytesseract.image_to_data(Image.open(io.BytesIO(bw or crop)), config="--psm 6", output_type=pytesseract.Output.DICT)
        words = [(w, number(c)) for w, c in zip(map(lambda x: str(x).strip(), data["text"]), data["conf"]) if w]
        sure = [c for _, c in words if c >= 0]
        return {"text": " ".join(w for w, _ in words), "confidence": sum(sure) / len(sure) if sure else None, "raw": str(data)}

    return read


register("vllm", _vision)
register("tesseract", _literal)


def engines_for(settings: Settings) -> list[tuple[str, dict]]:
    """Names and options of the engines to run, the vision engine first."""
    known = {
        "vllm": {"base_url": settings.vllm_base_url, "model": settings.vllm_model, "prompt": settings.prompt, "timeout": settings.vllm_timeout_seconds},
        "tesseract": {"command": settings.tesseract_cmd},
    }
    names = ["vllm", "tesseract"] if settings.ocr_backend == "both" else [settings.ocr_backend]
    return [(n, known[n]) for n in names]


def read_crops(crops: DataFrame, engines: list[tuple[str, dict]]) -> DataFrame:
    """Adds `results` (in the order of engines) to crops with `crop`, `bw` (binary, may be null) and crop_path. The
    images are dropped. Texts are cleaned as they come in."""
    chosen = [(name, ENGINES[name], options) for name, options in engines]
    kind = pa.list_(pa.struct([("backend", pa.string()), ("text", pa.string()), ("confidence", pa.float64()), ("error", pa.string()), ("raw", pa.string())]))
    keep = [c for c in crops.columns if c not in ("crop", "bw")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers: dict[str, Callable] = {}
        for batch in batches:
            for i in range(0, batch.num_rows, 8):
                part = batch.slice(i, 8)
                rows = []
                for crop, bw, path in zip(part.column("crop").to_pylist(), part.column("bw").to_pylist(), part.column("crop_path").to_pylist()):
                    row = []
                    for name, factory, options in chosen:
                        got = {"backend": name, "text": "", "confidence": None, "error": None, "raw": None}
                        try:
                            reader = readers.get(name) or readers.setdefault(name, factory(options))
                            got |= reader(crop, bw, "." + (path or "").rpartition(".")[2].lower())
                        except Exception as error:  # any failure is a result
                            got["error"] = str(error)
                        row.append(got)
                    rows.append(row)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(rows, kind)], names=[*keep, "results"])

    schema = ", ".join(f"`{c}` {t}" for c, t in crops.dtypes if c in keep) + ", results array<struct<backend:string,text:string,confidence:double,error:string,raw:string>>"
    read = crops.mapInArrow(run, schema)
    return read.withColumn("results", F.transform("results", lambda r: F.struct(r["backend"].alias("backend"), tx.clean(r["text"]).alias("text"), r["confidence"].alias("confidence"), r["error"].alias("error"), r["raw"].alias("raw"))))
