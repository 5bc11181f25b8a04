"""Lempel-Ziv phrase fingerprints: a document's dictionary phrases, hashed and kept as minima.

A text is parsed into LZ78 phrases over its UTF-8 bytes: each phrase is the shortest string that
is not in the dictionary yet. The set of phrases is hashed; one permutation deals the hashes to
`bins` bins, and each bin keeps its minimum. Two fingerprints' likeness is the share of agreeing
bins among those filled in either, an estimate of the Jaccard similarity of the phrase sets.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinescribe.llm.hashing import segment_hashes

BINS = 128
EMPTY = np.uint32(0xFFFFFFFF)


def parse(data: bytes, seen: set[bytes], start: int = 0) -> tuple[list[int], int]:
    """Adds the phrases of data[start:] to seen; the phrases' ends, and where the unfinished last
    phrase starts. A phrase in progress can go on in a longer text with the same beginning."""
    ends: list[int] = []
    add, done = seen.add, ends.append
    for end in range(start + 1, len(data) + 1):
        if (phrase := data[start:end]) not in seen:
            add(phrase)
            done(end)
            start = end
    return ends, start


def phrase_hashes(data: bytes, first: int, ends: list[int]) -> np.ndarray:
    """Hashes of the phrases that lie between first and the ends, each beginning at the end before."""
    if not ends:
        return np.zeros(0, np.uint64)
    stop = np.array(ends, np.int64)
    start = np.concatenate(([first], stop[:-1]))
    view = np.frombuffer(data, np.uint8)
    return segment_hashes(view, start, stop - start)


def signature(hashes: np.ndarray, bins: int = BINS) -> np.ndarray:
    """For each bin, the least 32-bit value of its hashes; EMPTY where there is none. bins: a power of two."""
    out = np.full(bins, EMPTY, np.uint32)
    if len(hashes):
        ordered = np.sort(hashes)
        shift = np.uint64(64 - (bins.bit_length() - 1))
        bin_of = (ordered >> shift).astype(np.int64)
        head = np.concatenate(([True], bin_of[1:] != bin_of[:-1]))
        low = (ordered[head] >> (shift - np.uint64(32))) & np.uint64(0xFFFFFFFF)
        out[bin_of[head]] = np.minimum(low, np.uint64(0xFFFFFFFE)).astype(np.uint32)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1; two empty fingerprints are alike."""
    filled = (a != EMPTY) | (b != EMPTY)
    n = int(filled.sum())
    return float((filled & (a == b)).sum() / n) if n else 1.0


def to_string(sig: np.ndarray) -> str:
    return base64.b64encode(sig.astype("<u4").tobytes()).decode()


def from_string(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u4")


def fingerprint(text: str | None, bins: int = BINS) -> str:
    """The fingerprint of one text (null: empty)."""
    data = (text or "").encode()
    return to_string(signature(phrase_hashes(data, 0, parse(data, set())[0]), bins))


class _Open:
    """A parsed document that waits for the next one. The parse is kept as it stood where the kept
    part of the text ends, so that the edited text is parsed from there on only."""

    def __init__(self, row: dict, bins: int) -> None:
        self.doc_id, self.text = row["doc_id"], row["text"] or ""
        n = len(self.text)
        self.kept = self.text[: n - n // 2].encode()
        data = self.text.encode()
        seen: set[bytes] = set()
        ends, self.at = parse(self.kept, seen)
        self.hashes = phrase_hashes(data, 0, ends)
        self.seen = set(seen)
        tail = phrase_hashes(data, self.at, parse(data, seen, self.at)[0])
        self.sig = signature(np.concatenate((self.hashes, tail)), bins)

    def finish(self, after: "_Open", bins: int) -> tuple:
        edited = self.kept + after.text[: len(self.text) // 2].encode()
        tail = phrase_hashes(edited, self.at, parse(edited, self.seen, self.at)[0])
        sig = signature(np.concatenate((self.hashes, tail)), bins)
        return (self.doc_id, len(self.text), hashlib.sha256(edited).hexdigest(), to_string(self.sig), to_string(sig), likeness(self.sig, sig), likeness(self.sig, after.sig))


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _chain(bins: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        waiting, bucket, closed = None, None, True
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for row in batch.slice(at, 64).to_pylist():
                    if row["__bucket"] != bucket:
                        waiting, bucket, closed = None, row["__bucket"], False
                    if closed:
                        continue  # more rows with the first id of the next bucket
                    now = _Open(row, bins)
                    if waiting is not None:
                        done.append(waiting.finish(now, bins))
                    waiting, closed = (None, True) if row["__guest"] else (now, False)
                    if len(done) >= 256:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), _ARROW.types)], schema=_ARROW)
                        done = []
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), _ARROW.types)], schema=_ARROW)

    return run


def fingerprint_edits(docs: DataFrame, bins: int = BINS, buckets: int | None = None) -> DataFrame:
    """Fingerprints each document and its edited text, and compares it with both that and the next
    document in descending doc_id (after the last: the first).

    Documents are dealt into `buckets` ranges of doc_id (8 for each shuffle partition unless given),
    and the first document of each range also goes to the range before it, so the text is shuffled
    once and no task reads more than its ranges. A null text is empty; rows without doc_id come last,
    in one range; rows of one doc_id follow each other by text. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = rows.select("doc_id")
    n = buckets or 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted({int(x) for x in ids.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.25 / n)})
    if cuts:
        edges = F.array(*[F.lit(x) for x in cuts])
        steps = len(cuts).bit_length() + 1
        mid = lambda s: ((s["lo"] + s["hi"]) / 2).cast("int")
        found = F.aggregate(
            F.sequence(F.lit(1), F.lit(steps)),
            F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi")),
            lambda s, _: F.when(s["lo"] >= s["hi"], s)
            .when(F.get(edges, mid(s)) <= F.col("doc_id"), F.struct((mid(s) + 1).alias("lo"), s["hi"].alias("hi")))
            .otherwise(F.struct(s["lo"].alias("lo"), mid(s).alias("hi"))),
            lambda s: s["lo"],
        )
    else:
        found = F.lit(0)
    bucket = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(found)
    # one row a bucket: the bucket before it in descending order gets its first document too
    heads = ids.select(bucket.alias("b"), "doc_id").groupBy("b").agg(F.max("doc_id").alias("head"))
    order = Window.orderBy(F.desc("b"))
    heads = heads.withColumn("to", F.coalesce(F.lag("b").over(order), F.min("b").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    heads = F.broadcast(heads.select("head", "to"))
    dealt = (
        rows.join(heads, F.col("doc_id").eqNullSafe(F.col("head")), "left")
        .select("doc_id", "text", F.explode(F.array_compact(F.array(F.struct(bucket.alias("b"), F.lit(0).alias("guest")), F.when(F.col("to").isNotNull(), F.struct(F.col("to").alias("b"), F.lit(1).alias("guest")))))).alias("__at"))
        .select(F.col("__at.b").alias("__bucket"), F.col("__at.guest").alias("__guest"), "doc_id", "text")
        .repartition("__bucket")
        .sortWithinPartitions("__bucket", "__guest", F.desc_nulls_last("doc_id"), "text")
    )
    return dealt.mapInArrow(_chain(bins), SCHEMA)
