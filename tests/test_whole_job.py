"""Queries and operators on fixtures that a cut would show on."""

import re
from difflib import SequenceMatcher

from kinescribe.plans.queries import queries


def test_similarity_of_long_lines(spark, tmp_path):
    long = "the quick brown fox jumps over a lazy dog, while nine zebras watch; " * 6
    documents = {1: ["short", "shirt", long, long, long + "again"], 2: [long[:199], long[1:202], "x" * 399, ""], 3: ["alone"], 4: [long * 30, "jazz " + long * 30, "jazz"], 5: ["", "", "a|b"]}
    spark.createDataFrame([(k, "\n".join(v)) for k, v in documents.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    norm = lambda t: re.sub("[^a-z0-9]+", " ", t.lower().replace("|", "i")).strip()
    want = {}
    for k, v in documents.items():
        for n in range(1, len(v)):
            a, b = norm(v[n - 1]), norm(v[n])
            want[k, n] = round(SequenceMatcher(None, a, b).ratio(), 6)
    got = queries()["q28_similarity"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {(r.run_id, r.frame_index): r.similarity for r in got} == want


def test_stride_over_all_frames(spark, tmp_path):
    """Every seventh frame to the last one, however many there are."""
    spark.sql("select id as event_id, timestamp_ntz'2024-01-01 00:00:00' as ts, id % 3 as user_id, 'x' as event_type, 1.0D as value from range(20000)").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.frame_index for r in queries()["q01_stride_sample"](spark, str(tmp_path)).collect()}
    assert got == set(range(0, 20000, 7))


def test_representative_of_whole_norms(spark, tmp_path):
    """Lines that share their first letters are different readings; ties go to the first seen, then to the longest text."""
    documents = {1: ["there it is", "the one", "The one!", "their own"], 2: ["the a", "the b", "the c", "the d"], 3: ["x", "the b", "the b.", "x  -"]}
    spark.createDataFrame([(k, "\n".join(v)) for k, v in documents.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.run_id: r.text for r in queries()["q12_representative_text"](spark, str(tmp_path)).collect()}
    assert got == {1: "The one!", 2: "the a", 3: "x  -"}
