"""Caption functions and operators: tables of cases with expected values, and brute-force versions."""

import json
import random
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinescribe.functions import layout as lay
from kinescribe.functions import text as tx
from kinescribe.functions.similarity import block_ratio, near_duplicate, shared_letters, similarity
from kinescribe.operators import cleanup, engines, imaging, islands, readings, select, timing
from kinescribe.plans import cli, refine
from kinescribe.schemas import Settings
from kinescribe.sources import io, video
from kinescribe.streaming.keep import greedy_keep_stream


def one(spark, values, kind, make):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").orderBy("i").select(make(F.col("x"))).collect()]


CLEAN = {
    "-Where? -I know.": "- Where?\n- I know.", "well - known": "well - known", "...": "", "Camelot awaits": "", "Subtitles only for you": "", "'\"none\"'": '"none"', '"none"': "",
    "```text\nHi there\n```\r\n": "Hi there", 'The text reads: "Good day."': "Good day.", "Привет": "Привет", "Here we are. No subtitles or intertitles present in this image": "Here we are",
    "Subtitles English French German Spanish": "", "Subtitle 12 3": "", "a b a b a b a b a b a b": "", "a\x07b\tc": "ab c", "*Hi*": "Hi", None: "", "1" * 25: "", "The piano plays": "", "Tea time": "Tea time",
    "xl xxl xl xl xxxl xl": "", "do not describe the image": "", "  Hi  ": "Hi",
}


def test_clean(spark):
    assert one(spark, list(CLEAN), "string", tx.clean) == list(CLEAN.values())


def test_normalize_and_suspicion(spark):
    assert one(spark, ["Hello|  WORLD—é!", "A-b"], "string", tx.normalize_raw) == ["helloi world", "a b"]
    assert one(spark, ["Close up of it", "100% polyester", "100 polyester", "Hello", "Привет"], "string", tx.suspicious) == [True, True, True, False, True]


def test_ngram_loop_against_counts(spark):
    r = random.Random(1)
    texts = [" ".join(r.choice("abc" if k % 2 else "abcdefghijkl") for _ in range(r.randrange(1, 40))) for k in range(150)] + ["x y z " * 8 + "q r s t"]

    def loop(t):
        w = t.split()
        return len(w) >= 10 and any((c := max(Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)).values())) >= 4 and c * k >= 0.55 * len(w) for k in range(2, 6))

    assert one(spark, texts, "string", lambda c: tx.ngram_loop(F.trim(c))) == [loop(t) for t in texts]


def test_cue_times(spark):
    assert one(spark, [0.0005, 0.0015, 59.9995, -1.0, 360000.25], "double", lay.srt_time) == ["00:00:00,000", "00:00:00,002", "00:01:00,000", "00:00:00,000", "100:00:00,250"]


def test_layout(spark):
    cases = {
        "": "", "Short.": "Short.", "First sentence here. Second one now. Third is here!": "First sentence here.\nSecond one now. Third is here!", "Yes. No.": "Yes.\nNo.",
        "This is a rather long caption that needs to be balanced over two lines, ok": "This is a rather long caption that\nneeds to be balanced over two lines, ok",
        "x" * 50 + " end": "x" * 42 + "\n" + "x" * 8 + "\nend", "  one \n\n two  ": "one\ntwo",
    }
    assert one(spark, list(cases), "string", lay.layout_text) == list(cases.values())
    r = random.Random(2)
    texts = [" ".join("ab" * r.randrange(1, 6) for _ in range(r.randrange(1, 40))) for _ in range(60)]

    def index(t):
        spaces = [i for i, c in enumerate(t) if c == " "]
        return min(spaces, key=lambda i: (max(0, i - 42) + max(0, len(t) - i - 1 - 42), abs(i - len(t) / 2))) if spaces else None

    assert one(spark, texts, "string", lay.split_index) == [index(t) for t in texts]
    assert all(len(x) <= 42 for t in one(spark, texts, "string", lay.layout) for x in t)
    assert one(spark, ["One here. Two is longer here. Three.", "none at all"], "string", lay.sentence_split) == [["One here.", "Two is longer here. Three."], None]


def test_block_ratio_is_the_matchers():
    """Equal to the standard library's ratio and bound, on texts of few and many letters, long and empty ones, and ones with common stretches."""
    draw = random.Random(11)
    for _ in range(4000):
        letters = "".join(map(chr, range(97, 97 + draw.choice([1, 2, 3, 6, 26, 300]))))
        often = [draw.random() ** 3 for _ in letters]
        a, b = ("".join(draw.choices(letters, often, k=draw.choice([0, 1, 2, 7, 8, 9, 16, 63, 64, 120, 199, 200, 260]))) for _ in range(2))
        if a and b and draw.random() < 0.5:
            at, start = draw.randrange(len(a)), draw.randrange(len(b))
            a = a[:at] + b[start : start + 40] + a[at:]
        match = SequenceMatcher(None, a, b)
        assert block_ratio(a, b) == match.ratio() and shared_letters(a, b) == match.quick_ratio(), (a, b)
    words = ["".join(draw.choices("etaoinshrdlu" * 8 + "cmfwypvbgkqjxz", k=draw.randint(1, 9))) for _ in range(300)]
    for _ in range(300):
        a = draw.choices(words, k=draw.randint(30, 400))
        b = [w for w in a if draw.random() < 0.9] if draw.random() < 0.5 else draw.choices(words, k=draw.randint(30, 400))
        a, b = " ".join(a), " ".join(b)
        assert block_ratio(a, b) == SequenceMatcher(None, a, b).ratio(), (a, b)
    assert block_ratio("ab" * 9000, "ba" * 90) == SequenceMatcher(None, "ab" * 9000, "ba" * 90).ratio()


def test_similarity(spark):
    pairs = [("tide", "diet"), ("diet", "tide"), ("", ""), ("a", ""), ("hello there", "hello theme"), ("abc", "abcdef")]
    d = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").orderBy("i")
    assert [r[0] for r in d.select(similarity(F.col("a"), F.col("b"))).collect()] == [SequenceMatcher(None, a, b).ratio() if a or b else 1.0 for a, b in pairs]
    side = lambda c: {"norm": F.col(c), "again": F.col(c)}
    assert [r[0] for r in d.select(near_duplicate(side("a"), side("b"))).collect()] == [False, False, False, False, True, False]
    inside = spark.createDataFrame([("good morning all", "good morning")], "a string, b string")
    assert inside.select(near_duplicate(side("a"), side("b"))).first()[0]


def observations(spark, rows):
    return spark.createDataFrame([(r, i, i, float(t), x) for i, (r, t, x) in enumerate(rows)], "run_id string, input_ord long, frame_index long, timestamp_seconds double, selected_text string")


def test_islands_and_representative(spark):
    o = observations(spark, [("a", 0, "Same text"), ("a", 4.0, "Same text!"), ("a", 8.1, "Same text"), ("b", 0, "Hi there!"), ("b", 1, ""), ("b", 2, "Hi there"), ("b", 2.5, "subtitles on")])
    status = islands.observation_status(o)
    assert Counter(r.status for r in status.collect()) == {"usable": 5, "blank": 1, "dropped": 1}
    placed = islands.islands(status.where("status = 'usable'"))
    segs = {(r.run_id, r.island): r for r in islands.segments(placed).collect()}
    assert [list(segs[k].frame_indices) for k in sorted(segs)] == [[0, 1], [2], [3, 5]]
    assert segs["a", 1].text == "Same text!" and segs["b", 1].text == "Hi there!" and segs["a", 1].end_seconds == 5.2
    tie = islands.segments(placed.limit(0))
    assert tie.count() == 0


@pytest.mark.parametrize("end,following,want,reasons", [
    (1.2, None, 1.2, []), (10.0, None, 1.9 * 1.10, ["duration_capped"]), (1.2, 0.8, 0.76, ["trimmed_to_avoid_overlap"]), (1.2, 0.5, 1.2, ["overlap_preserved_to_keep_subtitle"]), (0.2, None, 1.0, ["duration_extended"]),
])
def test_timing(spark, end, following, want, reasons):
    rows = [("r", 0, 0.0, end, "ten chars!", [1], 1)] + ([("r", 1, following, 50.0, "ten chars!", [2], 1)] if following else [])
    s = spark.createDataFrame(rows, "run_id string, input_ord long, start_seconds double, end_seconds double, text string, frame_indices array<long>, observation_count long")
    out, events = timing.timing_safety(s)
    assert out.where("input_ord = 0").first().end_seconds == pytest.approx(want)
    assert [e.reason for e in events.where("input_ord = 0").orderBy("event_ord").collect()] == reasons
    assert timing.remove_overlaps(s).where("input_ord = 0").first().end_seconds == (min(end, max(0, following - 0.04)) if following else end)


def test_selection(spark):
    ts = [0.0, 0.5, 1.9, 2.0, 4.0]
    c = spark.createDataFrame([("r", i, t, 1.0 if i == 0 else 0.0, 1.0) for i, t in enumerate(ts)], "run_id string, frame_index long, timestamp_seconds double, diff_score double, signal_score double")
    assert [r.frame_index for r in select.greedy_keep(c).orderBy("frame_index").collect()] == [0, 2, 4]
    bounds = spark.createDataFrame([("r", 0.0, 100.0)], "run_id string, start_seconds double, end_seconds double")
    assert [(r.target, r.frame_index) for r in select.representatives(c, 3, bounds).collect()] == [(0, 0)]
    assert [r.frame_index for r in select.representatives(c, 1, bounds).collect()] == [4]
    r = random.Random(3)
    rows = [(f"r{i % 3}", i, r.random() * 60, r.choice([0.0, 0.0, 0.0, 0.5]), 1.0) for i in range(300)]
    want = []
    for run in ("r0", "r1", "r2"):
        last = float("-inf")
        for x in sorted((x for x in rows if x[0] == run), key=lambda x: (x[2], x[1])):
            if x[3] >= 0.03 or x[2] - last >= 1.8:
                last = x[2]
                want.append(x[1])
    assert sorted(x.frame_index for x in select.greedy_keep(spark.createDataFrame(rows, c.schema)).collect()) == sorted(want)
    with pytest.raises(ValueError):
        select.stride_sample(c, 0, 25.0)
    assert select.artifact_names(c).where("frame_index = 1").first().crop_path == "crops/00002_frame_0000001_crop.jpg"


def test_readings(spark):
    kind = "i int, results array<struct<backend:string,text:string,confidence:double,error:string,raw:string>>"
    result = lambda b, t, e=None: (b, t, None, e, None)
    rows = [[result("vllm", ""), result("tesseract", "Hi")], [result("vllm", "Good day"), result("tesseract", "zzzz qqqq")], [result("vllm", "", "down")], []]
    got = readings.choose_reading(spark.createDataFrame(list(enumerate(rows)), kind)).orderBy("i").collect()
    assert [(r.selected_text, r.flags) for r in got] == [("Hi", ["used_tesseract_fallback"]), ("Good day", ["ocr_disagreement"]), ("", ["vllm_error"]), ("", [])]
    words = spark.createDataFrame([(1, 0, "a", "50"), (1, 1, " ", "9"), (1, 2, "b", "-1"), (1, 3, "c", "x"), (2, 0, "d", "-1")], "k int, word_no int, word string, conf string")
    assert {r.k: (r.text, r.confidence) for r in readings.join_words(words, ["k"]).collect()} == {1: ("a b c", 50.0), 2: ("d", None)}


def test_engines(spark):
    engines.register("echo", lambda o: lambda crop, bw, suffix: {"text": crop.decode() + suffix} if crop != b"x" else 1 / 0)
    d = spark.createDataFrame([(1, bytearray(b"Hello"), None, "a.JPG"), (2, bytearray(b"x"), None, "b.png")], "frame_index long, crop binary, bw binary, crop_path string")
    got = {r.frame_index: r.results[0] for r in engines.read_crops(d, [("echo", {})]).collect()}
    assert got[1].text == "Hello.jpg" and got[2].text == "" and got[2].error
    assert [n for n, _ in engines.engines_for(Settings(ocr_backend="both"))] == ["vllm", "tesseract"]
    assert d.select(engines.data_url(F.col("crop"), F.col("crop_path"))).first()[0] == "data:image/jpeg;base64,SGVsbG8="


def test_imaging(spark):
    frame = np.zeros((200, 400, 3), np.uint8)
    assert imaging.crop_box(frame) == ((0, 131, 400, 200), 0.0)
    frame[170:182, 150:250] = 255
    (x0, y0, x1, y1), signal = imaging.crop_box(frame)
    assert x0 <= 126 and x1 >= 274 and y1 - y0 >= 48 and signal == pytest.approx(1200 / (69 * 400))
    assert imaging.boxes(np.array([[1, 0, 0, 1], [0, 1, 0, 1]], bool)) == [(0, 0, 2, 2), (3, 0, 4, 2)]
    assert imaging.text_mask(np.array([[[0, 255, 255], [0, 0, 255], [255, 255, 255]]], np.uint8)).tolist() == [[True, False, True]]
    assert imaging.fingerprint(np.full((48, 192), 51, np.uint8)).tolist() == pytest.approx([0.2] * 2304)
    d = spark.createDataFrame([("r", 1, 0.04, 200, 400, bytearray(frame.tobytes()))], "run_id string, frame_index long, timestamp_seconds double, height int, width int, data binary")
    row = imaging.sample_crops(d, of="crop").first()
    assert row.bbox == [x0, y0, x1, y1] and len(row.fingerprint) == 2304
    assert select.candidates(imaging.sample_crops(d, of="crop")).count() == 1
    assert list(video.sampled_frames(100, 25.0, 12, 1.0, 2.0)) == [25, 37, 49] and list(video.sampled_frames(10, 25.0, 3, 9.0, 1.0)) == [225]


def test_refine_folder(spark, tmp_path):
    long = "This caption is much too long for a single cue because it goes on and on. It has a second sentence too."
    rows = [(0, 0.0, "Hello there"), (12, 0.5, "Hello there!"), (24, 8.0, long), (36, 12.0, long), (48, 20.0, "subtitles on"), (60, 21.0, ""), (72, 22.0, None)]
    text = "\n".join(json.dumps({"frame_index": f, "timestamp_seconds": t, "selected_text": x}) for f, t, x in rows) + "\n\n" + json.dumps({"frame_index": 84, "timestamp_seconds": 30})
    (tmp_path / "ocr_results.jsonl").write_text(text)
    (tmp_path / "run_config.json").write_text(json.dumps({"config": {"hold_seconds": "1.0", "merge_gap_seconds": "odd"}}))
    done = refine.refine(spark, str(tmp_path))
    final = done.segments.orderBy("start_seconds").collect()
    assert [r.text for r in final] == ["Hello there!", "This caption is much too long for a single cue because it goes on and on.", "It has a second sentence too."]
    audit = done.audit.first()
    assert (audit.input_observation_count, audit.blank_observation_count, audit.dropped_observation_count, audit.raw_segment_count, audit.final_segment_count) == (8, 2, 2, 2, 3)
    assert audit.settings.hold_seconds == 1.0 and audit.settings.merge_gap_seconds == 4.0
    assert sum(audit.event_counts.values()) == done.events.count()
    whole = json.loads(next((tmp_path / "merge_audit_refined.json").rglob("part-*")).read_text())
    assert [(x["frame_index"], x["reason"]) for x in whole["dropped_observations"]] == [(48, "cleaned_to_empty"), (72, "cleaned_to_empty")]
    assert len(whole["events"]) == done.events.count() and all(x["frame_indices"] and "duration_seconds" in x for x in whole["events"])
    assert Counter(x["reason"] for x in whole["events"]) == whole["event_counts"] and whole["policy"] == "subtitle_first"
    report = json.loads(next((tmp_path / "refine_refined_report.json").rglob("part-*")).read_text())
    assert (report["observation_count"], report["segment_count"], report["output_srt"], report["hold_seconds"]) == (8, 3, "subtitles_refined.srt", 1.0) and report["source_ocr_results"].endswith("ocr_results.jsonl")
    assert {p.name for p in tmp_path.iterdir()} >= {"segments_refined.json", "subtitles_refined.srt", "merge_audit_refined.json", "refine_refined_report.json"}
    srt = io.srt_documents(done.segments).first().srt
    assert srt.startswith("1\n00:00:00,000 --> 00:00:01,500\nHello there!\n\n2\n") and srt.endswith("\n")
    with pytest.raises(FileNotFoundError):
        refine.refine(spark, str(tmp_path / "none"))
    empty = refine.merge(observations(spark, [("a", 0, "")]))
    assert empty.segments.count() == 0 and empty.audit.first().raw_segment_count == 0


def test_every_reason(spark):
    """A segment for each of the eleven reasons that an audit may state."""
    long = "This caption is much too long for a single cue because it goes on and on and on. Close up of it"
    rows = [
        (1, 0.0, 0.3, "Hello there", 2), (2, 10.0, 11.0, "'none'", 2), (3, 20.0, 21.5, "Close up of a hand", 1), (4, 30.0, 30.9, long, 2), (5, 40.0, 46.0, long, 1),
        (6, 48.0, 59.0, "This caption is much too long for a single cue because it goes on and on and on. \"none\"", 2), (7, 60.0, 80.0, "Short", 2), (8, 90.0, 92.0, "One two three", 2), (9, 90.8, 92.0, "Four five", 2), (10, 91.0, 92.2, "Six seven", 2),
    ]
    s = spark.createDataFrame([("r", i, a, b, t, [i], n) for i, a, b, t, n in rows], "run_id string, input_ord long, start_seconds double, end_seconds double, text string, frame_indices array<long>, observation_count long")
    cleaned, early = cleanup.cleanup(s)
    _, late = timing.timing_safety(cleaned)
    found = {r.reason: r for r in early.unionByName(late).collect()}
    assert set(found) == {
        "short_segment_preserved_before_timing", "dropped_segment_invalid_text", "suspicious_single_observation_preserved", "long_segment_not_split_to_preserve_short_piece", "suspicious_split_segment_preserved",
        "dropped_split_segment_invalid_text", "duration_extended", "duration_capped", "trimmed_to_avoid_overlap", "overlap_preserved_to_keep_subtitle",
    } | {"suspicious_single_observation_preserved"}
    held = found["long_segment_not_split_to_preserve_short_piece"]
    assert held.frame_indices == [4] and held.first_duration_seconds + held.second_duration_seconds == pytest.approx(0.9 - 0.04) and held.cleaned_text is None
    assert found["dropped_split_segment_invalid_text"].cleaned_text == "" and found["short_segment_preserved_before_timing"].duration_seconds == pytest.approx(0.3)


def test_candidates_and_images(spark, tmp_path):
    kept = spark.createDataFrame([("r", 2, 24, 1.0, "f2", "c2", "p2", [0, 1, 2, 3], 0.5, 1.0), ("r", 1, 12, 0.5, "f1", "c1", "p1", [0, 1, 2, 3], 0.4, 1.0)], "run_id string, ordinal int, frame_index long, timestamp_seconds double, frame_path string, crop_path string, preprocessed_path string, bbox array<int>, signal_score double, diff_score double")
    io.write_candidates(kept, str(tmp_path / "candidates.json"))
    got = json.loads(next((tmp_path / "candidates.json").rglob("part-*")).read_text())
    assert [x["frame_index"] for x in got] == [12, 24] and got[0]["bbox"] == [0, 1, 2, 3] and list(got[0]) == list(io.CANDIDATES)
    io.write_images(kept.select("*", *[F.lit(x).cast("binary").alias(x) for x in ("frame", "crop", "bw")]), str(tmp_path / "images"))
    assert {r.path: bytes(r.content) for r in spark.read.parquet(str(tmp_path / "images")).collect()} == {f"{k[0]}{i}": k.encode() for i in (1, 2) for k in ("frame", "crop")} | {f"p{i}": b"bw" for i in (1, 2)}
    assert io.read_settings(spark, str(tmp_path / "none.json")) == {}
    (tmp_path / "odd.json").write_text("[1]")
    (tmp_path / "bad.json").write_text("{")
    assert io.read_settings(spark, str(tmp_path / "odd.json")) == io.read_settings(spark, str(tmp_path / "bad.json")) == {}


def test_fuzzy_islands_by_hand(spark):
    """Islands of similar texts on all lines of the small documents, walked one by one."""
    from kinescribe.plans.queries import lines

    status = islands.observation_status(lines(spark, "/root/testdata/sf0.001")).where("status = 'usable'")
    rows = status.select("run_id", "frame_index", "timestamp_seconds", tx.normalize_clean(F.col("cleaned_text")).alias("n")).collect()
    got = {(r.run_id, r.frame_index): r.island for r in islands.islands(status).collect()}
    by = {}
    for r in sorted(rows, key=lambda r: (r.run_id, r.timestamp_seconds, r.frame_index)):
        by.setdefault(r.run_id, []).append(r)
    joined = 0
    for run, rs in by.items():
        island = 0
        for before, r in zip([None, *rs], rs):
            same = False
            if before is not None and r.timestamp_seconds - before.timestamp_seconds <= 4.0 and before.n.norm and r.n.norm:
                ratio = lambda x, y: SequenceMatcher(None, x, y).ratio() if x and y else float(x == y)
                same = ratio(before.n.again, r.n.again) >= 0.86
                short, other = sorted((before.n, r.n), key=lambda n: len(n.norm))
                same = same or (len(short.norm) >= 6 and short.norm in other.norm and ratio(short.again, other.again) >= 0.64)
            island += not same
            joined += same
            assert got[run, r.frame_index] == island
    assert joined > 5


def test_settings_and_command_line():
    assert Settings().to_dict()["merge_similarity"] == 0.86 and Settings(run_name="x").run_dir("extract") == "output/x"
    assert Settings.knob(None, {"hold_seconds": "2"}, "hold_seconds") == 2.0 and Settings.knob(0.5, {}, "hold_seconds") == 0.5 and Settings.knob(None, {"hold_seconds": "z"}, "hold_seconds") == 1.2
    with pytest.raises(ValueError):
        Settings(scan_stride=0)
    args = cli.parser().parse_args(["benchmark", "v.mp4", "--crop-mode", "monochrome"])
    assert args.limit == 40 and args.crop_mode == "monochrome"
    assert cli.parser().parse_args(["refine", "d"]).output_suffix == "refined"


def test_streaming_keep(spark, tmp_path):
    schema = "run_id string, frame_index long, timestamp_seconds double, diff_score double"
    for k, rows in enumerate(([("r", 0, 0.0, 1.0), ("r", 1, 0.5, 0.0)], [("r", 2, 1.9, 0.0), ("r", 3, 2.0, 0.0), ("r", 4, 4.0, 0.0)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = greedy_keep_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    assert sorted(r.frame_index for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 2, 4]


def test_norms_of_cleaning(spark):
    """The norm that cleaning gives is the norm of what it gives, and the ways around work give what the work gives."""
    rng = random.Random(5)
    odd = ["", " ", "\xa0", " ", "\x1c", "\x85", "- ", "|", "'", '"', "*", "```", "shown in close up background is blurred ", "Close up of ", "100 polyester", "\n- ", "İ", "K", "ПРИ ", "text reads: "]
    texts = [*CLEAN, *("".join(rng.choice([*odd, "word ", "A b. ", "x" * 43 + " ", "subtitle "]) for _ in range(rng.randint(0, 12))) for _ in range(400))]
    o = spark.createDataFrame([(1, i, float(i), i, t) for i, t in enumerate(texts)], "run_id int, frame_index int, timestamp_seconds double, input_ord int, selected_text string")
    s = islands.observation_status(o, keep_norm=True).select("*", tx.normalize_raw(F.col("cleaned_text")).alias("want"), tx.norm_of_clean(F.col("cleaned_text"), F.col("cleaned_norm")).alias("n2"), tx.normalize(F.col("cleaned_text")).alias("w2"), tx.suspicious_clean(F.col("cleaned_text")).alias("odd"), tx.suspicious(F.col("cleaned_text")).alias("whole"), lay.display_length(F.col("selected_text")).alias("k"), F.length(F.array_join(lay.layout(F.col("selected_text")), " ")).alias("laid"))
    for r in s.collect():
        assert r.cleaned_norm == r.want and r.n2 == r.w2 and r.k == r.laid, r
        assert r.odd == r.whole, r


def test_keys_of_phrases():
    """Every phrase has one of its list's keys, so that a text without keys has no phrase."""
    from kinescribe.functions import rules
    from kinescribe.functions.base import keys

    for name in ("ABSENCE_SUFFIXES", "PROMPT_MARKERS", "EMPTY_PHRASES", "IMAGE_MARKERS", "NOTE_ABSENCE_MARKERS", "NOTE_TEST_MARKERS", "BIRTHDAY_MARKERS"):
        values = getattr(rules, name)
        assert all(any(k in v for k in keys(values)) for v in values)


def test_ngram_loop_of_few_heaps(spark):
    """Loops among other words, at the least counts, against counting."""
    rng = random.Random(9)

    def loops(words):
        n = len(words)
        return n >= 10 and any(max(Counter(tuple(words[i : i + k]) for i in range(n - k + 1)).values()) * k >= max(4 * k, n * 0.55) for k in (2, 3, 4, 5))

    texts = []
    for _ in range(300):
        phrase, other = [rng.choice("abcd") for _ in range(rng.randint(1, 5))], rng.randint(0, 30)
        texts.append(phrase * rng.randint(3, 12) + [f"w{rng.randint(0, 60)}" for _ in range(other)])
    got = one(spark, [" ".join(t) for t in texts], "string", tx.ngram_loop)
    want = [loops(t) for t in texts]
    assert got == want and 20 < sum(want) < 280
