"""Merging observations: usable ones, islands of near-duplicate texts in time, and their segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinescribe.functions import text as tx
from kinescribe.functions.similarity import near_duplicate

RUN = "run_id"
ORDER = ("timestamp_seconds", "frame_index", "input_ord")


def observation_status(observations: DataFrame, keep_norm: bool = False) -> DataFrame:
    """Adds cleaned_text and status: usable, dropped (had a text that cleaning emptied) or blank. With keep_norm, the
    normalized text that the tests of cleaning make stays as `cleaned_norm`."""
    o = observations.withColumn("__c", tx.clean_with_norm(F.col("selected_text")))
    o = o.withColumns({"cleaned_text": F.col("__c.cleaned")} | ({"cleaned_norm": F.col("__c.norm")} if keep_norm else {})).drop("__c")
    had = F.coalesce(F.col("selected_text"), F.lit("")).rlike(r"(?U)\S")
    return o.withColumn("status", F.when(F.col("cleaned_text") != "", "usable").when(had, "dropped").otherwise("blank"))


def islands(usable: DataFrame, gap: float = 4.0, similarity: float | None = 0.86, text: str = "cleaned_text", keep_norm: bool = False) -> DataFrame:
    """Adds `island`, numbered from 1 in each run: a row goes on the island of the row before it if its text is
    a near duplicate of that row's (equal, where similarity is None) and not more than gap seconds later.

    Texts are cleaned ones, unless similarity is None; `cleaned_norm`, where there is one, is their norm. All windows share one partitioning and order. Pairs too far apart in time never reach the UDF. With
    keep_norm, the normalized text stays as `norm`."""
    order = Window.partitionBy(RUN).orderBy(*ORDER)
    o = usable.withColumn("__gap", F.col("timestamp_seconds") - F.lag("timestamp_seconds").over(order))
    near = F.col("__gap") <= gap
    if similarity is None:
        o = o.withColumn("__same", near & (F.lag(text).over(order) == F.col(text)))
    else:
        o = o.withColumn("__n", tx.normalize_clean(F.col(text), F.col("cleaned_norm") if "cleaned_norm" in usable.columns else None)).drop("cleaned_norm")
        o = o.withColumn("__norm", F.col("__n.norm")).withColumn("__again", F.col("__n.again")).drop("__n")
        o = o.withColumns({"__norm0": F.when(near, F.lag("__norm").over(order)), "__again0": F.when(near, F.lag("__again").over(order))})
        side = lambda x: {"norm": F.coalesce("__norm" + x, F.lit("")), "again": F.coalesce("__again" + x, F.lit(""))}
        o = o.withColumn("__same", near & near_duplicate(side("0"), side(""), similarity))
    o = o.withColumn("island", F.sum(F.when(F.coalesce("__same", F.lit(False)), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    o = o.drop("__gap", "__same", "__again", "__norm0", "__again0")
    return o.withColumnRenamed("__norm", "norm") if keep_norm else o.drop("__norm")


def representative(rows: DataFrame, norm: Column, text: str = "cleaned_text") -> DataFrame:
    """(run_id, island, text): of the norm that most rows have (the first seen of equals), the longest text
    (the first of equals). Two aggregations with partial sums; no list of rows is built."""
    first = F.struct(*[F.col(c).alias(c) for c in ORDER])
    by_norm = rows.withColumn("__n", norm).groupBy(RUN, "island", "__n").agg(
        F.count("*").alias("k"), F.min(first).alias("first"), F.max_by(text, F.struct(F.length(text).alias("size"), *[(-F.col(c)).alias(c) for c in ORDER])).alias("text")
    )
    rank = F.struct("k", *[(-F.col("first")[c]).alias(c) for c in ORDER])
    return by_norm.groupBy(RUN, "island").agg(F.max_by("text", rank).alias("text"))


def segments(rows: DataFrame, hold: float = 1.2, norm: Column | None = None, text: str = "cleaned_text") -> DataFrame:
    """One row an island: start, end (the last time plus hold), text, frame_indices in order, count."""
    norm = tx.normalize(F.col(text)) if norm is None else norm
    frames = F.transform(F.array_sort(F.collect_list(F.struct(*ORDER))), lambda x: x["frame_index"])
    s = rows.groupBy(RUN, "island").agg(F.min("timestamp_seconds").alias("start_seconds"), (F.max("timestamp_seconds") + F.lit(hold)).alias("end_seconds"), frames.alias("frame_indices"), F.count("*").alias("observation_count"))
    best = representative(rows, norm, text).select(F.col(RUN).alias("__run"), F.col("island").alias("__island"), "text")
    joined = s.join(best, s[RUN].eqNullSafe(F.col("__run")) & (s["island"] == F.col("__island")))
    return joined.select(RUN, "island", "start_seconds", "end_seconds", "text", "frame_indices", "observation_count")
