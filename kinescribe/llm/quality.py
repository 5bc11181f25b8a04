"""Quality by nearest-neighbour voting in a latent-semantic space.

A document's terms are hashed words, hashed word shapes (letter case, digits, other signs, runs as one)
and levels of a few ratios (repeated words and lines, signs, word length). Weighted by inverse document
frequency (counted over all documents), the labelled documents' term vectors give a truncated singular value
decomposition; its axes project every document to a latent vector. The labelled vectors are broadcast, and in
blocks every document's exact cosine with all of them is computed; the nearest ones vote, weighted by similarity.

A labelled document has no vote on its own text: votes of the scored text itself are left out, whichever row
they came from, so a score never follows from the label that it is to tell.

The model is fitted on at most `labelled` rows (those with the least hash of doc_id); so its size has a
bound that doesn't depend on the corpus. Frequencies and scores read whole texts, in one pass each; only the
1,120 term counts are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinescribe.llm.common import fresh, pieces, text_column
from kinescribe.llm.hashing import IS_SPACE, U, mix, segment_hashes, word_hashes

WORDS, SHAPES, RATIOS, LEVELS = 512, 512, 6, 16
TERMS = WORDS + SHAPES + RATIOS * LEVELS
#: Weights of the three kinds of terms.
WEIGHTS = np.repeat([0.35, 1.0, 0.8], [WORDS, SHAPES, RATIOS * LEVELS]).astype(np.float32)
# Byte classes of shapes: letters of either case, digits; other signs stand for themselves.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = 97
_CLASS[128:] = 97
_CLASS[65:91] = 65
_CLASS[48:58] = 48
_LETTER = (_CLASS == 97) | (_CLASS == 65) | (_CLASS == 48)


def term_counts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Term weights before the inverse document frequency, one row a document (float32)."""
    n = len(at) - 1
    out = np.zeros((n, TERMS), np.float32)
    hashes, start, size = word_hashes(data, lower=True)
    bound = np.searchsorted(start, at)
    doc = np.repeat(np.arange(n), np.diff(bound))
    count = np.maximum(1, np.diff(bound)).astype(np.float32)
    flat = out.reshape(-1)
    np.add.at(flat, doc * TERMS + (hashes % U(WORDS)).astype(np.int64), np.float32(1))
    # shapes: the classes of a word's bytes, with runs of one class as one
    kind = _CLASS[data]
    head = np.ones(len(kind), bool)
    head[1:] = kind[1:] != kind[:-1]
    head[start] = True
    head &= ~IS_SPACE[data]
    rank = np.add.accumulate(head) - head
    if len(start):
        shape_at = rank[start]
        shape_size = np.diff(np.concatenate((shape_at, [int(head.sum())])))
        shapes = segment_hashes(kind[head], shape_at, shape_size)
        np.add.at(flat, doc * TERMS + WORDS + (shapes % U(SHAPES)).astype(np.int64), np.float32(1))
    out[:, : WORDS + SHAPES] = np.log1p(out[:, : WORDS + SHAPES] * (256 / count[:, None]))
    # ratios, each as a level with its neighbours, so that near values stay near
    total = lambda v, b: np.diff(np.concatenate(([0], np.add.accumulate(v, dtype=np.float64)))[b])
    held = np.concatenate(([0], np.add.accumulate(v := ~IS_SPACE[data], dtype=np.int64)))
    length = np.maximum(1, np.diff(held[at]))
    sign = total(v & ~_LETTER[data], at) / length
    upper = total(kind == 65, at) / length
    order = np.lexsort((hashes, doc))
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[order][1:] == hashes[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    repeats = np.bincount(doc[order][again], minlength=n) / count
    near = np.zeros(len(hashes), bool)
    near[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    twins = np.bincount(doc[near], minlength=n) / count
    pair = mix(hashes[1:] * U(3) + hashes[:-1]) if len(hashes) else hashes
    pair_doc = doc[1:] if len(doc) else doc
    order = np.lexsort((pair, pair_doc))
    seen = np.zeros(len(pair), bool)
    seen[1:] = (pair[order][1:] == pair[order][:-1]) & (pair_doc[order][1:] == pair_doc[order][:-1])
    pairs = np.bincount(pair_doc[order][seen], minlength=n) / count
    long = np.minimum(1, length / count / 24)
    for r, value in enumerate((np.sqrt(sign), np.sqrt(upper), repeats, np.sqrt(twins), np.sqrt(pairs), long)):
        level = np.clip(value, 0, 1) * (LEVELS - 1)
        low = np.floor(level).astype(int)
        base = WORDS + SHAPES + r * LEVELS
        out[np.arange(n), base + low] += (4 * (1 - (level - low))).astype(np.float32)
        out[np.arange(n), base + np.minimum(low + 1, LEVELS - 1)] += (4 * (level - low)).astype(np.float32)
    return out


@dataclass
class Model:
    axes: np.ndarray  # terms x dimensions, with the term weights in it
    vectors: np.ndarray  # labelled documents x dimensions, of length 1
    labels: np.ndarray
    keys: np.ndarray  # a hash of each labelled text
    near: int

    def project(self, counts: np.ndarray) -> np.ndarray:
        x = counts @ self.axes
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def score(self, counts: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Votes of the nearest labelled vectors of other texts, from exact products with all of them, 256 rows
        a block. Without any vote a score is 1."""
        out = np.ones(len(counts))
        if not len(self.labels):
            return out
        k = min(self.near, len(self.labels))
        for at in range(0, len(counts), 256):
            close = self.project(counts[at : at + 256]) @ self.vectors.T
            close[keys[at : at + 256, None] == self.keys] = -np.inf
            best = np.argpartition(-close, k - 1, axis=1)[:, :k]
            near = np.take_along_axis(close, best, 1).astype(np.float64)
            weight = np.where(np.isneginf(near), 0, np.maximum(near, 1e-6) ** 8)
            total = weight.sum(1)
            votes = (weight * self.labels[best]).sum(1)
            out[at : at + 256] = np.where(total > 0, votes / np.where(total > 0, total, 1), 1)
        return np.clip(out, 0, 1)


def fit(counts: np.ndarray, labels: np.ndarray, keys: np.ndarray, held: np.ndarray, documents: int, dims: int = 48, near: int = 15) -> Model:
    """Axes by randomized subspace iteration with a fixed seed. held: how many of all documents have each term."""
    if not len(labels):
        return Model(np.zeros((TERMS, dims), np.float32), np.zeros((0, dims), np.float32), labels.astype(float), keys, near)
    weight = WEIGHTS * np.log(1 + documents / (1 + held)).astype(np.float32)
    x = counts * weight
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    basis = np.random.default_rng(7).standard_normal((TERMS, dims), np.float32)
    for _ in range(6):
        basis, _ = np.linalg.qr(x.T @ (x @ basis))
    model = Model((weight[:, None] * basis).astype(np.float32), np.zeros((0, dims), np.float32), labels.astype(float), keys, near)
    model.vectors = model.project(counts).astype(np.float32)
    return model


def held_out(doc_id):
    """Rows whose labels are never learnt from: crc32 of doc_id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("__key"), text_column().alias("__bytes"))


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How many of all documents have each term, and how many there are. Each task sums its own; the sums of
    1,120 terms come to the driver."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.zeros(TERMS, np.int64), 0
        for batch, data, at in pieces(batches, "__bytes"):
            held += (term_counts(data, at) > 0).sum(0)
            n += batch.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, TERMS)), pa.array(np.concatenate(([n], held)))], names=["term", "held"])

    got = docs.select(text_column().alias("__bytes")).mapInArrow(run, "term long, held long").groupBy("term").agg(F.sum("held").alias("held")).toPandas()
    out = np.zeros(TERMS + 1, np.int64)
    out[got["term"].to_numpy(np.int64) + 1] = got["held"]
    return out[1:], int(out[0])


def train(docs: DataFrame, labels: DataFrame, labelled: int = 6000, dims: int = 48, near: int = 15) -> Model:
    """Fits the model on at most `labelled` rows outside the held-out part. Of several labels of a
    document the least counts; null labels don't. With no labelled row, every score is 1."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where(~held_out(F.col("doc_id")) & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    texts = _source(docs).join(F.broadcast(sample), "doc_id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in pieces(batches, "__bytes"):
            counts = term_counts(data, at).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("__key"), batch.column("quality").cast(pa.int32()), pa.array([x.tobytes() for x in counts], pa.binary())], names=["doc_id", "key", "quality", "counts"])

    # one row a doc_id, however many rows have it, so that no more than `labelled` come to the driver
    got = texts.mapInArrow(run, "doc_id long, key long, quality int, counts binary").groupBy("doc_id").agg(F.min(F.struct("counts", "quality", "key")).alias("x"))
    got = got.select("doc_id", "x.quality", "x.key", "x.counts").toPandas().sort_values("doc_id")
    counts = np.frombuffer(b"".join(got["counts"]), np.float16).reshape(-1, TERMS).astype(np.float32)
    held, documents = document_frequencies(docs) if len(got) else (np.zeros(TERMS), 0)
    return fit(counts, got["quality"].to_numpy(), got["key"].to_numpy(np.int64), held, documents, dims, near)


def _broadcast(docs: DataFrame, model: Model):
    """The model's arrays, of a size that the fit's parameters bound."""
    return docs.sparkSession.sparkContext.broadcast((model.axes, model.vectors, model.labels, model.keys, model.near))


def _scores(model: Model, batch: pa.RecordBatch, data: np.ndarray, at: np.ndarray, key: str) -> np.ndarray:
    return model.score(term_counts(data, at), batch.column(key).to_numpy())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every document; null and empty texts have scores as well."""
    shared = _broadcast(docs, model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch, data, at in pieces(batches, "__bytes"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_scores(model, batch, data, at, "__key"), pa.float64())], names=["doc_id", "score"])

    return _source(docs).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, least: float = 0.7, labelled: int = 6000) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: good quality likelier), predicted (1 if score >= least).

    A row each for every row of docs: null and empty texts are scored as texts without terms, repeated rows
    alike, and rows without doc_id are scored but never learnt from. Memory follows the longest text. Other
    columns of docs, whatever their names, are not read."""
    return score(docs, train(docs, labels, labelled)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.7, labelled: int = 6000) -> DataFrame:
    """The documents with a score of at least `least`, with all their columns, decided row by row; scored where
    they are read, so no text is shuffled."""
    shared = _broadcast(docs, train(docs, labels, labelled))
    fields = docs.columns
    data_name, key_name = fresh(docs, "quality_bytes"), fresh(docs, "quality_key")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch, data, at in pieces(batches, data_name):
            yield batch.select(fields).filter(pa.array(_scores(model, batch, data, at, key_name) >= least))

    return docs.withColumns({data_name: text_column(), key_name: F.xxhash64(F.coalesce("text", F.lit("")))}).mapInArrow(run, docs.schema)
