"""The engine's registered queries and the SQL that gives the same rows.

Adapters: E - events (a run for each user, time in epoch seconds, event_type as text, value as signal);
L - lines of documents (a run for each document, a second a line); V - conversations (four seconds a turn);
M - embeddings as fingerprints (a run for each label).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinescribe.functions import layout as lay
from kinescribe.functions import rules
from kinescribe.functions import text as tx
from kinescribe.functions.base import squeeze
from kinescribe.functions.similarity import near_duplicate, similarity
from kinescribe.operators import audit, cleanup, islands, readings, select, timing
from kinescribe.plans import text_sql as sql
from kinescribe.plans.refine import merge
from kinescribe.sources.io import cues, srt_documents

GAP, HOLD, SCALE = 43200.0, 3600.0, 3600.0
MIN_DIFF, EVERY = 300.0, 172800.0


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Dealt out evenly if a scan gives fewer partitions than there are cores, as one small file does; cleaning a
    text costs far more than moving it. Larger scans stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    seconds = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))") / 1e6
    return e.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("frame_index"), seconds.alias("timestamp_seconds"), F.col("event_type").alias("selected_text"), F.col("event_type").alias("cleaned_text"), F.col("value").alias("signal_score"), F.col("event_id").alias("input_ord"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    l = d.select(F.col("doc_id").alias("run_id"), F.posexplode(F.split("text", "\n", -1)).alias("n", "selected_text"))
    return l.select("run_id", F.col("n").cast("long").alias("frame_index"), F.col("n").cast("double").alias("timestamp_seconds"), "selected_text", F.col("n").cast("long").alias("input_ord"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spread(_read(spark, sf_dir, "conversations"))
    return c.select(F.col("conv_id").alias("run_id"), F.col("turn").alias("frame_index"), (F.col("turn") * 4.0).alias("timestamp_seconds"), F.col("text").alias("selected_text"), F.col("turn").alias("input_ord"), "role")


def sentences_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of conversations, the unit of layout queries."""
    t = turns(spark, sf_dir).select("run_id", "frame_index", F.posexplode(lay.sentences(F.replace("selected_text", F.lit("\n"), F.lit(" ")))).alias("n", "text"))
    return t.select("run_id", "frame_index", F.col("n").cast("long").alias("n"), "text")


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = islands.islands(events(spark, sf_dir), GAP, None)
    return islands.segments(i, HOLD, F.col("cleaned_text"))


def _timed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = _segments(spark, sf_dir).withColumn("input_ord", F.col("island"))
    return timing.timing_safety(s, 0.65, lay.GAP, F.length("text") * F.col("observation_count"), SCALE)


def q01(spark, sf_dir):
    return select.stride_sample(events(spark, sf_dir), 7, 25.0).select("run_id", "frame_index", F.round("timestamp_seconds", 3).alias("timestamp_seconds"))


def q02(spark, sf_dir):
    s = events(spark, sf_dir).withColumn("fingerprint", F.array("signal_score"))
    return select.with_difference(s).where(F.col("signal_score") >= 100).select("run_id", "frame_index", F.round("diff_score", 4).alias("diff_score"))


def _kept(spark, sf_dir):
    s = select.with_difference(events(spark, sf_dir).withColumn("fingerprint", F.array("signal_score")))
    return select.greedy_keep(s, MIN_DIFF, EVERY)


def q03(spark, sf_dir):
    return _kept(spark, sf_dir).select("run_id", "frame_index")


def q04(spark, sf_dir):
    e = events(spark, sf_dir)
    bounds = e.groupBy("run_id").agg(F.min("timestamp_seconds").alias("start_seconds"), F.max("timestamp_seconds").alias("end_seconds"))
    return select.representatives(e, 5, bounds).select("run_id", "target", "frame_index")


def q05(spark, sf_dir):
    m = _read(spark, sf_dir, "embeddings").select(F.col("label").alias("run_id"), F.col("vec_id").alias("frame_index"), F.col("vec_id").cast("double").alias("timestamp_seconds"), F.col("embedding").alias("fingerprint"))
    return select.with_difference(m).select("run_id", "frame_index", F.round("diff_score", 6).alias("diff_score"))


def q06(spark, sf_dir):
    return select.artifact_names(events(spark, sf_dir)).select("run_id", "frame_index", "ordinal", "frame_path", "crop_path", "preprocessed_path")


def q07(spark, sf_dir):
    return lines(spark, sf_dir).select("run_id", "frame_index", tx.normalize_raw(F.col("selected_text")).alias("norm"))


def q08(spark, sf_dir):
    return lines(spark, sf_dir).select("run_id", "frame_index", tx.clean(F.col("selected_text")).alias("cleaned"))


def q08_steps(spark, sf_dir):
    t = tx.remove_controls(tx.remove_fences(F.col("selected_text")))
    return turns(spark, sf_dir).select("run_id", "frame_index", t.alias("bare"), squeeze(t).alias("squeezed"))


def q08_status(spark, sf_dir):
    o = islands.observation_status(lines(spark, sf_dir), keep_norm=True)
    # a text that cleaning left as it was has passed the tests of noise
    odd = F.when((F.col("cleaned_text") != "") & (F.col("cleaned_text") == F.col("selected_text")), tx.suspicious_norm(F.col("cleaned_norm"))).otherwise(tx.suspicious(F.col("selected_text")))
    return o.select("run_id", "frame_index", "status", tx.norm_of_clean(F.col("cleaned_text"), F.col("cleaned_norm")).alias("norm"), odd.alias("suspicious"))


def q08_parts(spark, sf_dir):
    """The steps of cleaning on texts that give each of them work: every turn behind a prefix, before a marker of absence, and
    as an answer of few words."""
    t = F.substring("selected_text", 1, 60)
    prefixed = F.concat(F.element_at(F.array(*map(F.lit, rules.ANSWER_PREFIXES)), (F.col("frame_index") % len(rules.ANSWER_PREFIXES) + 1).cast("int")), F.lit(' "'), "selected_text", F.lit('"'))
    marked = F.concat(t, F.lit(". - "), F.element_at(F.array(*map(F.lit, rules.ABSENCE_SUFFIXES)), (F.col("run_id") % len(rules.ABSENCE_SUFFIXES) + 1).cast("int")), F.lit(" at all"))
    leak = F.concat(F.element_at(F.array(*map(F.lit, rules.PROMPT_MARKERS)), (F.col("run_id") % len(rules.PROMPT_MARKERS) + 1).cast("int")), F.lit(" "), t)
    answer = F.concat(F.lit(" "), F.element_at(F.array(*map(F.lit, (*rules.EMPTY_ANSWERS, *rules.EMPTY_PHRASES))), (F.col("run_id") % (len(rules.EMPTY_ANSWERS) + len(rules.EMPTY_PHRASES)) + 1).cast("int")), F.when(F.col("frame_index") % 2 == 0, ".").otherwise(t))
    return turns(spark, sf_dir).select("run_id", "frame_index", tx.strip_prefix(prefixed).alias("prefix"), tx.strip_suffix(marked).alias("suffix"), tx.prompt_leak(leak).alias("leak"), tx.empty_answer(answer).alias("empty"))


def q09(spark, sf_dir):
    n = lines(spark, sf_dir).select(tx.noise_rule(F.col("selected_text")).alias("rule"))
    return n.groupBy(F.coalesce("rule", F.lit("none")).alias("rule")).agg(F.count("*").alias("n"))


def q09_phrases(spark, sf_dir):
    from kinescribe.functions.base import holds, starts

    n = lines(spark, sf_dir).select("run_id", "frame_index", tx.normalize_raw(F.col("selected_text")).alias("n"))
    c = F.col("n")
    return n.select("run_id", "frame_index", c.isin(*rules.NOISE_TEXTS).alias("exact"), starts(c, rules.STATUS_PREFIXES).alias("status"), tx.image_talk(c).alias("image"), starts(c, rules.STOCK_PREFIXES).alias("stock"), tx.scene_talk(c).alias("scene"), starts(c, rules.SINGLE_PREFIXES).alias("single"))


def q10(spark, sf_dir):
    return islands.islands(events(spark, sf_dir), GAP, None).select("run_id", "frame_index", "island")


def q11(spark, sf_dir):
    return _segments(spark, sf_dir).select("run_id", "island", F.round("start_seconds", 3).alias("start_seconds"), F.round("end_seconds", 3).alias("end_seconds"), "text", F.array_join(F.transform("frame_indices", lambda x: x.cast("string")), ",").alias("frames"), "observation_count")


def q12(spark, sf_dir):
    l = lines(spark, sf_dir).withColumn("cleaned_text", F.col("selected_text")).withColumn("island", F.floor(F.col("frame_index") / 4))
    return islands.representative(l, tx.normalize_raw(F.col("selected_text"))).select("run_id", "island", "text")


def q13(spark, sf_dir):
    return _timed(spark, sf_dir)[0].select("run_id", "input_ord", F.round("start_seconds", 3).alias("start_seconds"), F.round("end_seconds", 3).alias("end_seconds"))


def q14(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.select("run_id", "frame_index", lay.srt_time(F.col("signal_score") * 777.125).alias("cue_time"))


def q15(spark, sf_dir):
    s = _segments(spark, sf_dir).withColumn("input_ord", F.col("island"))
    return timing.remove_overlaps(s).select("run_id", "input_ord", F.round("end_seconds", 3).alias("end_seconds"))


def q16(spark, sf_dir):
    return audit.event_counts(_timed(spark, sf_dir)[1])


def q17(spark, sf_dir):
    o = events(spark, sf_dir).withColumn("status", F.when(F.col("signal_score") < 50, "blank").when(F.col("signal_score") < 100, "dropped").otherwise("usable"))
    raw = islands.islands(o.where("status = 'usable'"), GAP, None)
    s = islands.segments(raw, HOLD, F.col("cleaned_text")).withColumn("input_ord", F.col("island"))
    final, ev = timing.timing_safety(s, 0.65, lay.GAP, F.length("text"), SCALE)
    done = audit.summary(o, s, s, final, ev, {"merge_gap_seconds": GAP})
    return done.select("run_id", "input_observation_count", "blank_observation_count", "usable_observation_count", "dropped_observation_count", "raw_segment_count", "final_segment_count", F.array_join(F.transform(F.array_sort(F.map_entries("event_counts")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("events"))


def q18(spark, sf_dir):
    t = F.concat(F.lit("- "), F.replace("selected_text", F.lit(", "), F.lit(" - ")))
    return lines(spark, sf_dir).select("run_id", "frame_index", F.array_join(tx.split_dialogue(squeeze(t)), "|").alias("parts"))


def q19(spark, sf_dir):
    n = lines(spark, sf_dir).select("run_id", "frame_index", tx.ngram_loop(tx.normalize_raw(F.col("selected_text"))).alias("loop"))
    return n.where("loop").select("run_id", "frame_index")


def q20(spark, sf_dir):
    n = lines(spark, sf_dir).select("run_id", "frame_index", F.split(tx.normalize_raw(F.col("selected_text")), " ").alias("w"))
    some = F.array(*map(F.lit, ("the", "of", "and", "in", "de", "la", "der", "die", "que", "el")))
    return n.select("run_id", "frame_index", F.size(F.array_intersect("w", some)).cast("long").alias("hits"))


def q21(spark, sf_dir):
    return sentences_of(spark, sf_dir).select("run_id", "frame_index", "n", F.coalesce(lay.split_index(F.col("text")), F.lit(-1)).cast("long").alias("cut"), F.array_join(lay.two_lines(F.col("text")), "|").alias("lines"))


def q22(spark, sf_dir):
    return turns(spark, sf_dir).select("run_id", "frame_index", F.array_join(lay.wrap(F.replace("selected_text", F.lit("\n"), F.lit(" "))), "|").alias("lines"))


def q22_layout(spark, sf_dir):
    return sentences_of(spark, sf_dir).select("run_id", "frame_index", "n", lay.layout_text(F.col("text")).alias("lines"))


def q22_layout_turns(spark, sf_dir):
    return turns(spark, sf_dir).select("run_id", "frame_index", lay.layout_text(F.regexp_replace("selected_text", ", ", "\n- ")).alias("lines"))


def q23(spark, sf_dir):
    r = timing.duration_range(lay.display_length(F.col("text")), 0.65)
    return sentences_of(spark, sf_dir).select("run_id", "frame_index", "n", F.length("text").cast("long").alias("length"), r["least"].alias("least"), r["most"].alias("most"))


def q24(spark, sf_dir):
    return turns(spark, sf_dir).select("run_id", "frame_index", F.array_join(lay.sentence_split(F.replace("selected_text", F.lit("\n"), F.lit(" "))), "|").alias("halves"))


def q25(spark, sf_dir):
    t = turns(spark, sf_dir).withColumn("cut", cleanup.split_long(F.col("selected_text"), F.col("timestamp_seconds"), F.col("timestamp_seconds") + 4))
    return t.select("run_id", "frame_index", F.posexplode("cut.pieces").alias("piece", "p")).select("run_id", "frame_index", "piece", "p.text", F.round("p.start", 3).alias("start_seconds"), F.round("p.end", 3).alias("end_seconds"))


def _observations(spark, sf_dir):
    t = turns(spark, sf_dir).withColumn("exchange", F.floor(F.col("frame_index") / 2))
    result = lambda b: F.struct(F.lit(b).alias("backend"), F.col("selected_text").alias("text"), F.lit(None).cast("double").alias("confidence"), F.when(F.length("selected_text") > 900, "too long").alias("error"), F.lit(None).cast("string").alias("raw"))
    r = t.withColumn("r", F.when(F.col("role") == "user", result("vllm")).otherwise(result("tesseract")))
    o = r.groupBy("run_id", "exchange").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame_index", "r"))), lambda x: x["r"]).alias("results"))
    return o.select("run_id", F.col("exchange").cast("long").alias("frame_index"), (F.col("exchange") * 4.0).alias("timestamp_seconds"), F.lit("").alias("crop_path"), "results")


def q26(spark, sf_dir):
    chosen = readings.choose_reading(_observations(spark, sf_dir))
    return readings.review_rows(chosen)


def q26_review(spark, sf_dir):
    """The same without the flag that rests on similarity, which SQL lacks."""
    chosen = readings.choose_reading(_observations(spark, sf_dir))
    return readings.review_rows(chosen.withColumn("flags", F.filter("flags", lambda f: f != "ocr_disagreement")))


def q27(spark, sf_dir):
    e = events(spark, sf_dir).select("run_id", F.col("frame_index").alias("word_no"), F.col("selected_text").alias("word"), F.when(F.col("signal_score") < 50, "-1").otherwise(F.col("signal_score").cast("string")).alias("conf"))
    return readings.join_words(e, ["run_id"]).select("run_id", F.round("confidence", 4).alias("confidence"), "text")


def _pairs(spark, sf_dir):
    order = Window.partitionBy("run_id").orderBy("frame_index")
    l = lines(spark, sf_dir).withColumn("norm", tx.normalize_raw(F.col("selected_text")))
    return l.withColumn("before", F.lag("norm").over(order)).where("before is not null")


def q28(spark, sf_dir):
    return _pairs(spark, sf_dir).select("run_id", "frame_index", F.round(similarity(F.col("before"), F.col("norm")), 6).alias("similarity"))


def q29(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    side = lambda c: {"norm": F.col(c), "again": F.col(c)}
    return p.where(near_duplicate(side("before"), side("norm"))).select("run_id", "frame_index")


def q30(spark, sf_dir):
    return cues(merge(lines(spark, sf_dir)).segments)


def q30_srt(spark, sf_dir):
    return srt_documents(merge(turns(spark, sf_dir).drop("role")).segments)


def q30_audit(spark, sf_dir):
    return merge(turns(spark, sf_dir).drop("role")).audit.drop("policy_notes", "settings", "event_counts")


def q31(spark, sf_dir):
    """The audit's events, with all their fields, over islands of equal texts: events as readings, their segments cut long or
    short by their time, cleaned, split and timed."""
    s = islands.segments(islands.islands(events(spark, sf_dir), GAP, None), 1.2, F.col("cleaned_text")).withColumn("input_ord", F.col("island")).drop("island")
    _, e = timing.timing_safety(s, 0.65)
    return e.select("run_id", "input_ord", "stage", "reason", *[F.round(c, 3).alias(c) for c in ("start_seconds", "end_seconds", "duration_seconds", "original_end_seconds", "adjusted_end_seconds", "minimum_duration_seconds", "maximum_duration_seconds")], "text", F.array_join("frame_indices", ",").alias("frames"), "observation_count")


def q32(spark, sf_dir):
    """Cleanup of segments before timing: turns as segments of up to three seconds, from cleaned texts; the segments that stay."""
    s = turns(spark, sf_dir).select("run_id", F.col("frame_index").alias("input_ord"), F.col("timestamp_seconds").alias("start_seconds"), (F.col("timestamp_seconds") + F.col("frame_index") % 7 / 2.0).alias("end_seconds"), tx.clean(F.col("selected_text")).alias("text"), F.array("frame_index").alias("frame_indices"), (F.col("frame_index") % 2 + 1).cast("long").alias("observation_count"))
    return cleanup.cleanup(s)


def q32_segments(spark, sf_dir):
    return q32(spark, sf_dir)[0].select("run_id", "input_ord", F.round("start_seconds", 3).alias("start_seconds"), F.round("end_seconds", 3).alias("end_seconds"), "text", "observation_count")


def q32_events(spark, sf_dir):
    e = q32(spark, sf_dir)[1]
    return e.groupBy("run_id", "reason").agg(F.count("*").alias("n"), F.round(F.sum("first_duration_seconds"), 3).alias("first"), F.round(F.sum("second_duration_seconds"), 3).alias("second"))


def q33(spark, sf_dir):
    return srt_documents(_segments(spark, sf_dir).withColumn("input_ord", F.col("island")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "q01_stride_sample": q01, "q02_signal_and_change": q02, "q03_greedy_keep": q03, "q04_representatives": q04, "q05_fingerprint_distance": q05,
        "q06_artifact_names": q06, "q07_normalize": q07, "q08_clean": q08, "q08_clean_steps": q08_steps, "q08_clean_parts": q08_parts, "q08_status": q08_status, "q09_noise_rules": q09, "q09_noise_phrases": q09_phrases,
        "q10_islands": q10, "q11_segments": q11, "q12_representative_text": q12, "q13_timing": q13, "q14_cue_time": q14, "q15_remove_overlaps": q15,
        "q16_event_counts": q16, "q17_audit": q17, "q18_dialogue": q18, "q19_ngram_loop": q19, "q20_word_hits": q20, "q21_two_lines": q21, "q22_wrap": q22, "q22_layout": q22_layout, "q22_layout_turns": q22_layout_turns,
        "q23_duration_range": q23, "q24_sentence_split": q24, "q25_long_split": q25, "q26_reading_choice": q26, "q26_review_rows": q26_review, "q27_confidence": q27, "q28_similarity": q28,
        "q29_near_duplicates": q29, "q30_refine": q30, "q30_srt": q30_srt, "q30_audit": q30_audit, "q31_audit_events": q31, "q32_cleanup": q32_segments, "q32_cleanup_events": q32_events, "q33_caption_files": q33,
    }


_E = "e AS (SELECT user_id AS run_id, event_id AS frame_index, epoch_us(ts) / 1e6 AS t, event_type AS txt, value AS v FROM events)"
_L = "l AS (SELECT doc_id AS run_id, unnest(range(len(string_split(text, chr(10))))) AS frame_index, unnest(string_split(text, chr(10))) AS txt FROM documents)"
_NORM = "trim(regexp_replace(replace(lower(txt), '|', 'i'), '[^a-z0-9]+', ' ', 'g'))"
_ISLES = _E + """,
 i0 AS (SELECT *, CASE WHEN lag(txt) OVER w = txt AND t - lag(t) OVER w <= 43200 THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY run_id ORDER BY t, frame_index)),
 i AS (SELECT *, sum(fresh) OVER (PARTITION BY run_id ORDER BY t, frame_index)::BIGINT AS island FROM i0)"""
_SEGS = _ISLES + ", s AS (SELECT run_id, island, min(t) AS a, max(t) + 3600 AS b, any_value(txt) AS txt, string_agg(frame_index, ',' ORDER BY t, frame_index) AS frames, count(*) AS n FROM i GROUP BY ALL)"
_TIMED = """, r AS (SELECT *, lead(a) OVER (PARTITION BY run_id ORDER BY a, b, island) AS nxt,
  CASE WHEN {len} <= 15 THEN 1.0 WHEN {len} <= 25 THEN 1.5 WHEN {len} <= 39 THEN 2.4 WHEN {len} <= 46 THEN 3.5 ELSE 3.8 END::DOUBLE AS lo,
  CASE WHEN {len} <= 15 THEN 1.9 WHEN {len} <= 25 THEN 2.7 WHEN {len} <= 39 THEN 3.5 WHEN {len} <= 46 THEN 4.2 ELSE 5.0 END::DOUBLE AS hi FROM s),
 w AS (SELECT *, least(greatest(b, a + lo * 3600), a + hi * (1.10::DOUBLE * 3600)) AS want, CASE WHEN nxt IS NOT NULL THEN greatest(a, nxt - 0.04) END AS latest FROM r),
 o AS (SELECT *, coalesce(want > latest, false) AS over_, coalesce(latest - a >= 0.6::DOUBLE * 3600, false) AS room FROM w)"""
_COUNTS = """, x AS (SELECT run_id, 'duration_extended' AS reason FROM o WHERE want > b UNION ALL SELECT run_id, 'duration_capped' FROM o WHERE want < b
  UNION ALL SELECT run_id, 'trimmed_to_avoid_overlap' FROM o WHERE over_ AND room UNION ALL SELECT run_id, 'overlap_preserved_to_keep_subtitle' FROM o WHERE over_ AND NOT room)"""


_TURNS = "c AS (SELECT conv_id AS run_id, turn AS frame_index, text AS txt, role FROM conversations)"
_FLAT = _TURNS + ", v AS (SELECT run_id, frame_index, replace(txt, chr(10), ' ') AS t FROM c)"
_SENTENCES = _FLAT + f""", s0 AS (SELECT run_id, frame_index, list_filter(list_transform({sql.sentences("t")}, lambda x: {sql.trim("x")}), lambda x: x <> '') AS ss FROM v),
 s AS (SELECT run_id, frame_index, unnest(ss) AS t, unnest(range(len(ss))) AS n FROM s0)"""


def _pick(values, at: str) -> str:
    return f"{sql.listed(values)}[({at} % {len(values)} + 1)::INT]"


def text_oracle_sql() -> dict[str, str]:
    """SQL for the queries of cleaning and layout."""
    prefix = sql.quoted("(?i)^(?:" + "|".join(rules.ANSWER_PREFIXES) + ")")
    rest = sql.trim(sql.trim(sql.trim(sql.trim(f"regexp_replace(a, {prefix}, '')"), '"'), "'"))
    place = f"list_filter(list_transform({sql.listed(rules.ABSENCE_SUFFIXES)}, lambda m: strpos(lower(b), m)), lambda i: i > 1)[1]"
    wrapped_or = "array_to_string(coalesce(fixed, w.lines), chr(10))"
    long = f"""a AS (SELECT run_id, frame_index, txt, frame_index * 4.0::DOUBLE AS a, frame_index * 4.0::DOUBLE + 4 AS z, array_to_string({sql.text_lines("txt")}, ' ') AS j FROM c),
 b AS (SELECT *, {sql.sentence_cut("j")} AS sc, {sql.split_index("j")} AS wc FROM a),
 d AS (SELECT *, CASE WHEN length(j) <= 84 THEN NULL WHEN sc IS NOT NULL THEN {sql.halves("j", "sc")} WHEN wc IS NOT NULL AND NOT list_contains({sql.halves("j", "wc")}, '') THEN {sql.halves("j", "wc")} END AS h FROM b),
 e AS (SELECT *, least(greatest(a + greatest(0, z - a) * (length(h[1]) / greatest(1, length(h[1]) + length(h[2]))), a), greatest(a, z - 0.04::DOUBLE)) AS m FROM d),
 f AS (SELECT *, least(z, m + 0.04::DOUBLE) AS m2 FROM e),
 g AS (SELECT *, h IS NOT NULL AND m - a >= 0.5 AND z - m2 >= 0.5 AS cut FROM f)"""
    turned = f"""{_TURNS}, {sql.cleaned("c", "txt", "one")}, {sql.cleaned("k7", "one", "two", "m")},
 g7 AS (SELECT run_id, frame_index AS ord, frame_index * 4.0::DOUBLE AS a, frame_index * 4.0::DOUBLE + frame_index % 7 / 2.0::DOUBLE AS z, two, {sql.norm("two")} AS nt, frame_index % 2 + 1 AS k FROM m7)"""
    kept = f""", a AS (SELECT *, array_to_string({sql.text_lines("two")}, ' ') AS j FROM g7 WHERE two <> ''){long[long.index(",\n b AS"):]},
 pc AS (SELECT *, unnest(CASE WHEN cut THEN [0, 1] ELSE [0] END) AS piece FROM g),
 pd AS (SELECT run_id, ord, k, piece, CASE WHEN cut THEN h[piece + 1] ELSE two END AS part, CASE WHEN piece = 1 THEN m2 ELSE a END AS pa, CASE WHEN cut AND piece = 0 THEN m ELSE z END AS pz FROM pc),
 {sql.cleaned("pd", "part", "done", "y")}, u AS (SELECT *, {sql.norm("done")} AS nd FROM y7)"""
    return {
        "q08_clean": f"WITH {_L}, {sql.cleaned('l', 'txt', 'cleaned')} SELECT run_id, frame_index, cleaned FROM k7",
        "q08_clean_parts": f"""WITH {_TURNS}, x AS (SELECT run_id, frame_index, {_pick(rules.ANSWER_PREFIXES, "frame_index")} || ' "' || txt || '"' AS a, txt[:60] || '. - ' || {_pick(rules.ABSENCE_SUFFIXES, "run_id")} || ' at all' AS b,
 {_pick(rules.PROMPT_MARKERS, "run_id")} || ' ' || txt[:60] AS d, ' ' || {_pick((*rules.EMPTY_ANSWERS, *rules.EMPTY_PHRASES), "run_id")} || CASE WHEN frame_index % 2 = 0 THEN '.' ELSE txt[:60] END AS e FROM c)
 SELECT run_id, frame_index, CASE WHEN regexp_matches(a, {prefix}) THEN {rest} ELSE a END AS prefix,
 CASE WHEN {sql.holds("lower(b)", *rules.ABSENCE_SUFFIXES)} THEN coalesce({sql.trim(sql.trim(sql.trim(sql.trim(f"b[:{place} - 1]"), "."), "-"))}, b) ELSE b END AS suffix, {sql.leak("lower(d)")} AS leak, {sql.empty("e")} AS empty FROM x""",
        "q08_status": f"""WITH {_L}, {sql.cleaned("l", "txt", "one")}, {sql.cleaned("k7", "one", "two", "m")}
 SELECT run_id, frame_index, CASE WHEN one <> '' THEN 'usable' WHEN regexp_matches(coalesce(txt, ''), {sql.quoted("[^" + sql.S[1:])}) THEN 'dropped' ELSE 'blank' END AS status, {sql.norm("two")} AS norm, {sql.suspicious("txt", "n")} AS suspicious FROM (SELECT *, {sql.norm("txt")} AS n FROM m7)""",
        "q09_noise_rules": f"WITH {_L}, m AS (SELECT {sql.noise('txt', 'n')} AS rule FROM (SELECT txt, {sql.norm('txt')} AS n FROM l)) SELECT coalesce(rule, 'none') AS rule, count(*) AS n FROM m GROUP BY ALL",
        "q21_two_lines": f"""WITH {_SENTENCES}, q AS (SELECT *, {sql.squeeze("t")} AS z FROM s), i AS (SELECT *, {sql.split_index("t")} AS cut, {sql.split_index("z")} AS mid FROM q)
 SELECT run_id, frame_index, n, coalesce(cut, -1) AS cut, CASE WHEN length(z) <= 42 OR mid IS NULL THEN z ELSE array_to_string(list_filter({sql.halves("z", "mid")}, lambda x: x <> ''), '|') END AS lines FROM i""",
        "q22_wrap": f"WITH RECURSIVE {_FLAT}, o AS (SELECT run_id, frame_index, [t] AS ts FROM v), {sql.wrapped('o', 'run_id, frame_index', 'ts')} SELECT run_id, frame_index, array_to_string(lines, '|') AS lines FROM wr2",
        "q22_layout": f"WITH RECURSIVE {_SENTENCES}, {sql.laid('s', 't')}, {sql.wrapped('la4', 'run_id, frame_index, n', 'towrap')} SELECT run_id, frame_index, n, {wrapped_or} AS lines FROM la4 JOIN wr2 w USING (run_id, frame_index, n)",
        "q22_layout_turns": f"WITH RECURSIVE {_TURNS}, y AS (SELECT run_id, frame_index, replace(txt, ', ', chr(10) || '- ') AS t FROM c), {sql.laid('y', 't')}, {sql.wrapped('la4', 'run_id, frame_index', 'towrap')} SELECT run_id, frame_index, {wrapped_or} AS lines FROM la4 JOIN wr2 w USING (run_id, frame_index)",
        "q23_duration_range": f"""WITH {_SENTENCES}, q AS (SELECT *, {sql.squeeze("t")} AS z FROM s), d AS (SELECT *, length(z) + list_sum(list_transform(string_split(z, ' '), lambda w: greatest(0, length(w) - 1) // 42)) AS k FROM q)
 SELECT run_id, frame_index, n, length(t) AS length, CASE WHEN k <= 15 THEN 1.0 WHEN k <= 25 THEN 1.5 WHEN k <= 39 THEN 2.4 WHEN k <= 46 THEN 3.5 ELSE 3.8 END::DOUBLE AS least,
 CASE WHEN k <= 15 THEN 1.9 WHEN k <= 25 THEN 2.7 WHEN k <= 39 THEN 3.5 WHEN k <= 46 THEN 4.2 ELSE 5.0 END::DOUBLE AS most FROM d""",
        "q24_sentence_split": f"WITH {_FLAT}, b AS (SELECT *, {sql.sentence_cut('t')} AS mid FROM v) SELECT run_id, frame_index, CASE WHEN mid IS NOT NULL THEN array_to_string({sql.halves('t', 'mid')}, '|') END AS halves FROM b",
        "q25_long_split": f"""WITH {_TURNS}, {long}, p AS (SELECT *, unnest(CASE WHEN cut THEN [0, 1] ELSE [0] END) AS piece FROM g)
 SELECT run_id, frame_index, piece, CASE WHEN cut THEN h[piece + 1] ELSE txt END AS text, round(CASE WHEN piece = 1 THEN m2 ELSE a END, 3) AS start_seconds, round(CASE WHEN cut AND piece = 0 THEN m ELSE z END, 3) AS end_seconds FROM p""",
        "q32_cleanup": f"WITH {turned}{kept} SELECT run_id, ord * 2 + piece AS input_ord, round(pa, 3) AS start_seconds, round(pz, 3) AS end_seconds, done AS text, k AS observation_count FROM u WHERE done <> ''",
        "q32_cleanup_events": f"""WITH {turned}{kept}, ev AS (
  SELECT run_id, 'short_segment_preserved_before_timing' AS reason, NULL::DOUBLE AS d1, NULL::DOUBLE AS d2 FROM g7 WHERE z - a < 0.5 UNION ALL
  SELECT run_id, 'dropped_segment_invalid_text', NULL, NULL FROM g7 WHERE two = '' UNION ALL
  SELECT run_id, 'suspicious_single_observation_preserved', NULL, NULL FROM g7 WHERE two <> '' AND k = 1 AND {sql.suspicious("two", "nt")} UNION ALL
  SELECT run_id, 'long_segment_not_split_to_preserve_short_piece', m - a, z - m2 FROM g WHERE h IS NOT NULL AND NOT cut UNION ALL
  SELECT run_id, 'dropped_split_segment_invalid_text', NULL, NULL FROM u WHERE done = '' UNION ALL
  SELECT run_id, 'suspicious_split_segment_preserved', NULL, NULL FROM u WHERE done <> '' AND k = 1 AND {sql.suspicious("done", "nd")})
 SELECT run_id, reason, count(*) AS n, round(sum(d1), 3) AS first, round(sum(d2), 3) AS second FROM ev GROUP BY ALL""",
        "q26_review_rows": f"""WITH {_TURNS}, r AS (SELECT run_id, frame_index // 2 AS f, arg_max(txt, frame_index) FILTER (role = 'user') AS va, arg_max(txt, frame_index) FILTER (role <> 'user' OR role IS NULL) AS vb,
  string_agg(CASE WHEN role = 'user' THEN 'vllm_error' ELSE 'tesseract_error' END, ';' ORDER BY frame_index) FILTER (length(txt) > 900) AS errors FROM c GROUP BY ALL),
 {sql.cleaned("r", "va", "ca")}, {sql.cleaned("k7", "vb", "cb", "m")}
 SELECT f::VARCHAR AS frame_index, printf('%.3f', f * 4.0::DOUBLE) AS timestamp_seconds, '' AS crop_path, CASE WHEN ca <> '' THEN ca ELSE cb END AS selected_text, coalesce(va, '') AS vllm_text, coalesce(vb, '') AS tesseract_text,
 '' AS expected_text, '' AS failure_notes, concat_ws(';', errors, CASE WHEN ca = '' AND cb <> '' THEN 'used_tesseract_fallback' END) AS flags FROM m7""",
    }


def _sql_list(phrases) -> str:
    return "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in phrases) + "]"


def _any(test: str, phrases) -> str:
    return f"len(list_filter({_sql_list(phrases)}, lambda p: {test}(n, p))) > 0"


def oracle_sql() -> dict[str, str]:
    timed, timed_plain = _TIMED.replace("{len}", "(length(txt) * n)"), _TIMED.replace("{len}", "length(txt)")
    audited = _E.replace("FROM events", "FROM events WHERE value >= 100") + _SEGS[len(_E):]
    plain_segs = _SEGS.replace("+ 3600 AS b", "+ 1.2::DOUBLE AS b")
    plain_timed = timed_plain.replace("* 3600", "* 1").replace("(1.10::DOUBLE * 1)", "1.10::DOUBLE")
    return text_oracle_sql() | {
        "q01_stride_sample": f"WITH {_E} SELECT run_id, frame_index, round(t, 3) AS timestamp_seconds FROM e WHERE frame_index % 7 = 0",
        "q02_signal_and_change": f"WITH {_E}, d AS (SELECT *, coalesce(abs(lag(v) OVER (PARTITION BY run_id ORDER BY t, frame_index) - v), 1.0) AS d FROM e) SELECT run_id, frame_index, round(d, 4) AS diff_score FROM d WHERE v >= 100",
        "q03_greedy_keep": f"""WITH RECURSIVE {_E}, d AS (SELECT *, row_number() OVER w AS k, coalesce(abs(lag(v) OVER w - v), 1.0) AS d FROM e WINDOW w AS (PARTITION BY run_id ORDER BY t, frame_index)),
 g AS (SELECT run_id, frame_index, k, t AS last, true AS keep FROM d WHERE k = 1 UNION ALL
  SELECT d.run_id, d.frame_index, d.k, CASE WHEN d.d >= 300 OR d.t - g.last >= 172800 THEN d.t ELSE g.last END, d.d >= 300 OR d.t - g.last >= 172800 FROM g JOIN d ON d.run_id = g.run_id AND d.k = g.k + 1)
 SELECT run_id, frame_index FROM g WHERE keep""",
        "q04_representatives": f"""WITH {_E}, b AS (SELECT run_id, min(t) AS a, max(t) AS z FROM e GROUP BY run_id),
 d AS (SELECT e.run_id, frame_index, t, k::INT AS target, abs(t - (a + (z - a) * k / 4)) AS off FROM e JOIN b USING (run_id), range(5) r(k)),
 n AS (SELECT *, row_number() OVER (PARTITION BY run_id, frame_index ORDER BY off, target) AS c FROM d),
 m AS (SELECT *, row_number() OVER (PARTITION BY run_id, target ORDER BY off, t, frame_index) AS c2 FROM n WHERE c = 1)
 SELECT run_id, target, frame_index FROM m WHERE c2 = 1""",
        "q05_fingerprint_distance": """WITH m AS (SELECT label AS run_id, vec_id AS frame_index, embedding AS x, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS y FROM embeddings)
 SELECT run_id, frame_index, round(CASE WHEN y IS NULL THEN 1.0 ELSE list_avg(list_transform(range(1, len(x) + 1), lambda i: abs(x[i]::DOUBLE - y[i]::DOUBLE))) END, 6) AS diff_score FROM m""",
        "q06_artifact_names": f"""WITH {_E}, o AS (SELECT run_id, frame_index, row_number() OVER (PARTITION BY run_id ORDER BY t, frame_index)::INT AS ordinal FROM e), n AS (SELECT *, printf('%05d_frame_%07d', ordinal, frame_index) AS f FROM o)
 SELECT run_id, frame_index, ordinal, 'frames/' || f || '.jpg' AS frame_path, 'crops/' || f || '_crop.jpg' AS crop_path, 'preprocessed/' || f || '_bw.png' AS preprocessed_path FROM n""",
        "q07_normalize": f"WITH {_L} SELECT run_id, frame_index, {_NORM} AS norm FROM l",
        "q08_clean_steps": r"""WITH t AS (SELECT conv_id AS run_id, turn AS frame_index, regexp_replace(replace(replace(regexp_replace(text, '(?im)^```(?:text)?|```$', '', 'g'), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g') AS bare FROM conversations)
 SELECT run_id, frame_index, bare, trim(regexp_replace(bare, '\s+', ' ', 'g')) AS squeezed FROM t""",
        "q09_noise_phrases": f"""WITH {_L}, m AS (SELECT run_id, frame_index, {_NORM} AS n FROM l) SELECT run_id, frame_index, list_contains({_sql_list(rules.NOISE_TEXTS)}, n) AS exact, {_any('starts_with', rules.STATUS_PREFIXES)} AS status,
 ({_any('starts_with', rules.IMAGE_PREFIXES)}) OR ({_any('contains', rules.IMAGE_MARKERS)}) AS image, {_any('starts_with', rules.STOCK_PREFIXES)} AS stock,
 ({_any('starts_with', rules.SCENE_PREFIXES)}) OR (starts_with(n, 'die bombenangriffe') AND contains(n, 'katastrophalen zerst')) OR contains(n, 'soft glow illuminating the scene') AS scene, {_any('starts_with', rules.SINGLE_PREFIXES)} AS single FROM m""",
        "q10_islands": f"WITH {_ISLES} SELECT run_id, frame_index, island FROM i",
        "q11_segments": f"WITH {_SEGS} SELECT run_id, island, round(a, 3) AS start_seconds, round(b, 3) AS end_seconds, txt AS text, frames, n AS observation_count FROM s",
        "q12_representative_text": f"""WITH {_L}, m AS (SELECT run_id, frame_index, frame_index // 4 AS island, txt, {_NORM} AS n FROM l),
 g AS (SELECT run_id, island, n, count(*) AS k, min(frame_index) AS first FROM m GROUP BY ALL), b AS (SELECT run_id, island, n FROM g QUALIFY row_number() OVER (PARTITION BY run_id, island ORDER BY k DESC, first) = 1)
 SELECT run_id, island, txt AS text FROM m JOIN b USING (run_id, island, n) QUALIFY row_number() OVER (PARTITION BY run_id, island ORDER BY length(txt) DESC, frame_index) = 1""",
        "q13_timing": f"WITH {_SEGS}{timed} SELECT run_id, island AS input_ord, round(a, 3) AS start_seconds, round(CASE WHEN over_ AND room THEN latest ELSE want END, 3) AS end_seconds FROM o",
        "q14_cue_time": f"WITH {_E}, m AS (SELECT run_id, frame_index, greatest(0, round_even(v * 777.125::DOUBLE * 1000, 0)::BIGINT) AS ms FROM e) SELECT run_id, frame_index, printf('%02d:%02d:%02d,%03d', ms // 3600000, ms % 3600000 // 60000, ms % 60000 // 1000, ms % 1000) AS cue_time FROM m",
        "q15_remove_overlaps": f"WITH {_SEGS}, n AS (SELECT *, lead(a) OVER (PARTITION BY run_id ORDER BY a, b, island) - 0.04 AS x FROM s) SELECT run_id, island AS input_ord, round(CASE WHEN x IS NULL THEN b ELSE least(b, greatest(a, x)) END, 3) AS end_seconds FROM n",
        "q16_event_counts": f"WITH {_SEGS}{timed}{_COUNTS} SELECT run_id, reason, count(*) AS n FROM x GROUP BY ALL",
        "q17_audit": f"""WITH {audited}{timed_plain}{_COUNTS}, c AS (SELECT run_id, reason, count(*) AS k FROM x GROUP BY ALL), j AS (SELECT run_id, string_agg(reason || '=' || k, ',' ORDER BY reason) AS events FROM c GROUP BY run_id),
 u AS (SELECT user_id AS run_id, count(*) AS a1, count(*) FILTER (value < 50) AS a2, count(*) FILTER (value >= 100) AS a3, count(*) FILTER (value >= 50 AND value < 100) AS a4 FROM events GROUP BY ALL), q AS (SELECT run_id, count(*) AS k FROM s GROUP BY run_id)
 SELECT u.run_id, a1 AS input_observation_count, a2 AS blank_observation_count, a3 AS usable_observation_count, a4 AS dropped_observation_count, coalesce(q.k, 0) AS raw_segment_count, coalesce(q.k, 0) AS final_segment_count, coalesce(events, '') AS events FROM u LEFT JOIN q USING (run_id) LEFT JOIN j USING (run_id)""",
        "q31_audit_events": f"""WITH {plain_segs}{plain_timed}, x AS (SELECT *, 'duration_extended' AS reason FROM o WHERE want > b UNION ALL SELECT *, 'duration_capped' FROM o WHERE want < b
  UNION ALL SELECT *, 'trimmed_to_avoid_overlap' FROM o WHERE over_ AND room UNION ALL SELECT *, 'overlap_preserved_to_keep_subtitle' FROM o WHERE over_ AND NOT room)
 SELECT run_id, island AS input_ord, 'timing' AS stage, reason, round(a, 3) AS start_seconds, round(b, 3) AS end_seconds, round(b - a, 3) AS duration_seconds,
 round(CASE WHEN reason LIKE 'duration%' THEN b WHEN reason LIKE 'trimmed%' THEN want END, 3) AS original_end_seconds, round(CASE WHEN reason LIKE 'duration%' THEN want WHEN reason LIKE 'trimmed%' THEN latest END, 3) AS adjusted_end_seconds,
 CASE WHEN reason = 'duration_extended' THEN lo END AS minimum_duration_seconds, CASE WHEN reason = 'duration_capped' THEN hi END AS maximum_duration_seconds, txt AS text, frames, n AS observation_count FROM x""",
        "q33_caption_files": f"""WITH {_SEGS}, q AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY a, b, island) AS k, greatest(0, round_even(a * 1000, 0)::BIGINT) AS f, greatest(0, round_even(b * 1000, 0)::BIGINT) AS g FROM s),
 c AS (SELECT run_id, k, k || chr(10) || printf('%02d:%02d:%02d,%03d --> %02d:%02d:%02d,%03d', f // 3600000, f % 3600000 // 60000, f % 60000 // 1000, f % 1000, g // 3600000, g % 3600000 // 60000, g % 60000 // 1000, g % 1000) || chr(10) || txt || chr(10) AS cue FROM q)
 SELECT run_id, string_agg(cue, chr(10) ORDER BY k) AS srt FROM c GROUP BY run_id""",
        "q18_dialogue": rf"""WITH {_L}, m AS (SELECT run_id, frame_index, regexp_replace(trim(regexp_replace('- ' || replace(txt, ', ', ' - '), '\s+', ' ', 'g')), '^\s*[-–—]\s*', '- ') AS d FROM l),
 p AS (SELECT *, list_filter(list_transform(string_split_regex(trim(d[3:]), '\s+[-–—]\s*'), lambda x: trim(x)), lambda x: x <> '') AS ps FROM m)
 SELECT run_id, frame_index, CASE WHEN starts_with(d, '- ') AND len(ps) > 1 THEN array_to_string(list_transform(ps, lambda x: '- ' || x), '|') ELSE d END AS parts FROM p""",
        "q19_ngram_loop": f"""WITH {_L}, m AS (SELECT run_id, frame_index, string_split({_NORM}, ' ') AS w FROM l), k AS (SELECT *, unnest([2, 3, 4, 5]) AS size FROM m WHERE len(w) >= 10),
 g AS (SELECT run_id, frame_index, size, len(w) AS n, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS g FROM k), c AS (SELECT run_id, frame_index, size, n, g, count(*) AS c FROM g GROUP BY ALL)
 SELECT DISTINCT run_id, frame_index FROM c WHERE c >= 4 AND c * size >= n * 0.55::DOUBLE""",
        "q27_confidence": "SELECT user_id AS run_id, round(avg(value) FILTER (value >= 50), 4) AS confidence, string_agg(event_type, ' ' ORDER BY event_id) AS text FROM events GROUP BY user_id",
        "q20_word_hits": f"WITH {_L} SELECT run_id, frame_index, len(list_intersect(string_split({_NORM}, ' '), ['the', 'of', 'and', 'in', 'de', 'la', 'der', 'die', 'que', 'el'])) AS hits FROM l",
    }
