"""Run folders: observation logs, settings, review sheets, caption files. A run's folder is a partition, run_id=..."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinescribe.functions.layout import layout_text, srt_time
from kinescribe.schemas import OBSERVATIONS, Settings

def read_observations(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """An ocr_results.jsonl file, or files in run_id=... folders, with input_ord. frame_index and timestamp_seconds
    must be there; other columns have defaults; a selected_text of null is the text "None", a missing one is
    empty; blank lines are skipped."""
    fields = T.StructType.fromDDL(OBSERVATIONS)
    lines = spark.read.text(path)
    given = "run_id" in lines.columns
    parsed = lines.where(F.trim("value") != "").select(
        F.from_json("value", fields).alias("o"), F.get_json_object("value", "$.selected_text").isNull().alias("no_text"),
        F.array_contains(F.json_object_keys("value"), "selected_text").alias("has_text"), *(["run_id"] if given else []),
        F.monotonically_increasing_id().alias("input_ord"),
    )
    must = lambda c: F.when(F.col(f"o.{c}").isNull(), F.raise_error(F.lit(f"an observation has no {c}")).cast(fields[c].dataType)).otherwise(F.col(f"o.{c}"))
    text = F.when(~F.col("no_text"), F.col("o.selected_text")).when(F.col("has_text"), "None").otherwise("")
    empty = lambda c: F.coalesce(F.col(f"o.{c}"), F.array().cast(fields[c].dataType))
    return parsed.select(
        (F.col("run_id") if given else F.lit(run_id or path)).alias("run_id"), "input_ord", must("frame_index").alias("frame_index"), must("timestamp_seconds").alias("timestamp_seconds"),
        F.coalesce("o.crop_path", F.lit("")).alias("crop_path"), F.coalesce("o.preprocessed_path", F.lit("")).alias("preprocessed_path"), text.alias("selected_text"),
        empty("results").alias("results"), empty("flags").alias("flags"), F.coalesce("o.signal_score", F.lit(0.0)).alias("signal_score"), F.coalesce("o.diff_score", F.lit(0.0)).alias("diff_score"),
    )


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def read_settings(spark: SparkSession, path: str) -> dict:
    """The saved settings of a run; empty if the file is missing, isn't JSON or is of another shape. Other failures of
    the storage are raised."""
    import json

    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return {}
    row = spark.read.option("wholetext", True).text(path).first()
    try:
        data = json.loads(row[0]) if row else {}
    except ValueError:
        return {}
    return data["config"] if isinstance(data, dict) and isinstance(data.get("config"), dict) else {}


def write_one_text(df: DataFrame, path: str) -> None:
    """A one-column, few-row DataFrame as a text file in a folder."""
    df.coalesce(1).write.mode("overwrite").text(path)


def write_json_document(df: DataFrame, path: str, order: list[str]) -> None:
    """All rows as one JSON array for each run, in order."""
    rows = df.groupBy("run_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.struct(*[c for c in df.columns if c != "run_id"]).alias("row")))), lambda x: x["row"])).alias("value"))
    rows.write.mode("overwrite").partitionBy("run_id").text(path)


def write_json_rows(df: DataFrame, path: str) -> None:
    """Each row as one JSON object, in its run's folder."""
    df.select("run_id", F.to_json(F.struct(*[c for c in df.columns if c != "run_id"])).alias("value")).write.mode("overwrite").partitionBy("run_id").text(path)


CANDIDATES = ("frame_index", "timestamp_seconds", "frame_path", "crop_path", "preprocessed_path", "bbox", "signal_score", "diff_score")


def write_candidates(kept: DataFrame, path: str) -> None:
    """The candidates of each run as one JSON array, in the order of their ordinals."""
    rows = kept.groupBy("run_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", F.struct(*CANDIDATES).alias("row")))), lambda x: x["row"])).alias("value"))
    rows.write.mode("overwrite").partitionBy("run_id").text(path)


def write_images(crops: DataFrame, path: str) -> None:
    """The image files of candidates as a table (run_id, path, content): any storage that Spark writes to can hold it.
    A path is the name that candidates and logs use."""
    kinds = [F.struct(F.col(name).alias("path"), F.col(data).alias("content")) for name, data in (("frame_path", "frame"), ("crop_path", "crop"), ("preprocessed_path", "bw"))]
    crops.select("run_id", F.inline(F.array(*kinds))).write.mode("overwrite").parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("run_id").json(path)


def write_review(df: DataFrame, path: str) -> None:
    """The review sheet as one file with one header, by time: it is for people, and as long as a sample or a film."""
    order = [F.col("timestamp_seconds").cast("double"), F.col("frame_index").cast("long")]
    df.repartition(1).sortWithinPartitions(*order).write.mode("overwrite").option("header", True).option("emptyValue", "").option("nullValue", "").csv(path)


def cues(segments: DataFrame) -> DataFrame:
    """run_id, ordinal and text of each cue, numbered by start, end and input_ord."""
    from pyspark.sql import Window

    order = Window.partitionBy("run_id").orderBy("start_seconds", "end_seconds", "input_ord")
    s = segments.withColumn("ordinal", F.row_number().over(order))
    times = F.concat(srt_time(F.col("start_seconds")), F.lit(" --> "), srt_time(F.col("end_seconds")))
    return s.select("run_id", "ordinal", F.concat_ws("\n", F.col("ordinal").cast("string"), times, layout_text(F.col("text")), F.lit("")).alias("cue"))


def srt_documents(segments: DataFrame) -> DataFrame:
    """One caption file a run, as text."""
    all_ = F.array_sort(F.collect_list(F.struct("ordinal", "cue")))
    return cues(segments).groupBy("run_id").agg(F.array_join(F.transform(all_, lambda c: c["cue"]), "\n").alias("srt"))


def write_srt(segments: DataFrame, path: str) -> None:
    srt_documents(segments).select("run_id", F.col("srt").alias("value")).write.mode("overwrite").partitionBy("run_id").text(path)


def settings_json(settings: Settings, mode: str, candidate_count: int, video: dict | None = None) -> str:
    import json

    return json.dumps({"mode": mode, "config": settings.to_dict(), "video": video or {}, "candidate_count": candidate_count}, ensure_ascii=False, indent=2)
