"""Readings of several engines: choice, flags, review rows, word confidences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinescribe.functions import text as tx
from kinescribe.functions.base import strip
from kinescribe.functions.similarity import similarity

DISAGREE = 0.65


def last_of(results: Column, backend: str) -> Column:
    """The last result of a backend; null if it has none."""
    found = F.filter(results, lambda r: r["backend"] == backend)
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def choose_reading(observations: DataFrame) -> DataFrame:
    """selected_text (the first engine's, else the second's, else empty; cleaned) and flags (errors in order,
    then disagreement or fallback), from `results`."""
    o = observations.withColumn("__a", F.coalesce(tx.clean(last_of(F.col("results"), "vllm")["text"]), F.lit("")))
    o = o.withColumn("__b", F.coalesce(tx.clean(last_of(F.col("results"), "tesseract")["text"]), F.lit("")))
    both = (F.col("__a") != "") & (F.col("__b") != "")
    o = o.withColumn("__na", F.when(both, tx.normalize(F.col("__a")))).withColumn("__nb", F.when(both, tx.normalize(F.col("__b"))))
    o = o.withColumn("__near", similarity(F.coalesce("__na", F.lit("")), F.coalesce("__nb", F.lit(""))))
    errors = F.transform(F.filter("results", lambda r: F.coalesce(r["error"], F.lit("")) != ""), lambda r: F.concat(r["backend"], F.lit("_error")))
    extra = F.array_compact(F.array(F.when(both & (F.col("__near") < DISAGREE), F.lit("ocr_disagreement")), F.when((F.col("__a") == "") & (F.col("__b") != ""), F.lit("used_tesseract_fallback"))))
    o = o.withColumn("selected_text", F.when(F.col("__a") != "", F.col("__a")).otherwise(F.col("__b"))).withColumn("flags", F.concat(F.coalesce(errors, F.array().cast("array<string>")), extra))
    return o.drop("__a", "__b", "__na", "__nb", "__near")


def review_rows(observations: DataFrame) -> DataFrame:
    """The nine columns of the review sheet, all text; missing readings are empty."""
    read = lambda b: F.coalesce(last_of(F.col("results"), b)["text"], F.lit(""))
    return observations.select(
        F.col("frame_index").cast("string").alias("frame_index"), F.format_string("%.3f", F.col("timestamp_seconds")).alias("timestamp_seconds"), "crop_path", "selected_text",
        read("vllm").alias("vllm_text"), read("tesseract").alias("tesseract_text"), F.lit("").alias("expected_text"), F.lit("").alias("failure_notes"), F.array_join("flags", ";").alias("flags"),
    )


def join_words(words: DataFrame, keys: list[str]) -> DataFrame:
    """From one row a word (keys, word_no, word, conf) the text and the mean of the confidences of 0 or more;
    words of lower confidence stay in the text, and without any confidence the mean is null."""
    w = words.withColumn("word", strip(F.coalesce("word", F.lit("")))).where("word != ''")
    conf = F.expr("try_cast(conf as double)")
    return w.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_no", "word"))), lambda x: x["word"]), " ").alias("text"), F.avg(F.when(conf >= 0, conf)).alias("confidence"))
