"""Repeated passages: seed and extend over winnowed anchors.

Seeds: of the 31 grams of 20 words in a window of 50 words, the one with the least hash (the leftmost
of equals) is the window's anchor, so equal windows have equal anchors at equal places. Consecutive
windows mostly share an anchor; such a run of windows is an occurrence. Documents are joined on anchors:
an anchor in one document only is dropped.

Extension: occurrences whose whole run of windows (from 30 words before the anchor to 30 after it, as
far as its windows reach) is equal form a class. In a class, all documents but the least repeat the whole
run. Where an anchor has several classes, each class is extended from the anchor both ways, word by word, but
against all other classes at once instead of pair by pair: a step of the extension is a window that holds the
anchor, and it goes on as long as a smaller document has the same anchor and window. The matched windows of a
document, merged, are its maximal repeats of at least 50 words.

Work and rows follow the text and the number of different contexts of an anchor, never the number of pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinescribe.llm.common import only_ids, pieces, shared_table, text_column
from kinescribe.llm.hashing import gram_hashes, range_hashes, word_hashes

WINDOW, GRAM = 50, 20


def least_positions(value: np.ndarray, span: int) -> np.ndarray:
    """For each start, the position of the least of `span` values, the leftmost of equals."""
    at = np.arange(len(value))
    wide = 1
    while 2 * wide <= span:
        a, b = at[: len(at) - wide], at[wide:]
        at = np.where(value[a] <= value[b], a, b)
        wide *= 2
    rest = span - wide
    if rest:
        a, b = at[: len(at) - rest], at[rest:]
        at = np.where(value[a] <= value[b], a, b)
    return at


def occurrences(words: np.ndarray, bound: np.ndarray, window: int, gram: int) -> dict[str, np.ndarray]:
    """Anchor occurrences of consecutive documents whose words lie in [bound[i], bound[i + 1]):
    document, first and last window start (in the document), hash of the anchor and of the run."""
    none = np.zeros(0, np.int64)
    if len(words) < window:
        return dict.fromkeys(("doc", "first", "last", "anchor", "run"), none)
    grams = gram_hashes(words, gram)
    at = least_positions(grams, window - gram + 1)
    doc = np.repeat(np.arange(len(bound) - 1), np.diff(bound))[: len(at)]
    start = np.flatnonzero(np.arange(len(at)) + window <= bound[1:][doc])
    anchor, doc = at[start], doc[start]
    head = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])))[: len(start)])
    tail = np.concatenate((head[1:], [len(start)]))[: len(head)] - 1
    if not len(head):
        return dict.fromkeys(("doc", "first", "last", "anchor", "run"), none)
    first, last, where, doc = start[head], start[tail], anchor[head], doc[head]
    run = range_hashes(words, first, last + window)
    run ^= (where - first).astype(np.uint64) << np.uint64(58)
    return {"doc": doc, "first": first - bound[doc], "last": last - bound[doc], "anchor": grams[where].view(np.int64), "run": run.view(np.int64)}


def _seed(window: int, gram: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in pieces(batches, "__bytes"):
            words, start, _ = word_hashes(data)
            bound = np.searchsorted(start, at)
            found = occurrences(words, bound, window, gram)
            cut = np.searchsorted(found["doc"], np.arange(len(at))).astype(np.int32)
            lists = pa.StructArray.from_arrays(
                [pa.array(found["anchor"]), pa.array(found["run"]), pa.array(found["first"].astype(np.int32)), pa.array(found["last"].astype(np.int32))],
                names=["anchor", "run", "first", "last"],
            )
            whole = [hashlib.sha256(b" ".join(data[a:b].tobytes().split())).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(np.diff(bound), pa.int64()), pa.array(whole), pa.ListArray.from_arrays(pa.array(cut), lists)],
                names=["doc_id", "key", "n_words", "sha256", "seeds"],
            )

    return run


def _extend(window: int):
    """Rows (doc_id, text, runs) to the windows of each run, as a walk from the anchor to both ends meets them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                part = batch.slice(at, 16)
                for doc, data, runs in zip(part.column("doc_id").to_pylist(), part.column("__bytes"), part.column("runs").to_pylist()):
                    words = word_hashes(np.frombuffer(data.as_buffer(), np.uint8))[0]
                    first, last = (np.array([r[x] for r in runs], np.int64) for x in ("first", "last"))
                    size = last - first + 1
                    which = np.repeat(np.arange(len(runs)), size)
                    step = np.arange(len(which)) - np.repeat(np.add.accumulate(size) - size, size)
                    start = first[which] + step
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(range_hashes(words, start, start + window).view(np.int64)), pa.array(np.full(len(start), doc, np.int64)),
                         *[pa.array(np.array([r[x] for r in runs], np.int64)[which]) for x in ("anchor", "run")], pa.array(step.astype(np.int32))],
                        names=["window", "least", "anchor", "run", "step"],
                    )

    return run


def _remove(window: int):
    """Rows (doc_id, text, spans of window starts, both ends in) to what is left of each text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                part = batch.slice(at, 16)
                count, gone, sha, texts = [], [], [], []
                for data, spans in zip(part.column("__bytes").to_pylist(), part.column("spans").to_pylist()):
                    words = data.split()
                    depth = np.zeros(len(words) + 1, np.int64)
                    edge = np.array([(s["from"], min(s["to"] + window, len(words))) for s in spans], np.int64).reshape(-1, 2)
                    edge = edge[edge[:, 0] < edge[:, 1]]
                    np.add.at(depth, edge[:, 0], 1)
                    np.add.at(depth, edge[:, 1], -1)
                    keep = np.add.accumulate(depth[:-1]) == 0
                    left = b" ".join(w for w, k in zip(words, keep.tolist()) if k)
                    count.append(len(words))
                    gone.append(int((~keep).sum()))
                    sha.append(hashlib.sha256(left).hexdigest())
                    texts.append(left.decode())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(count, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha), pa.array(texts)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def _source(docs: DataFrame) -> DataFrame:
    """doc_id, key (a hash of the text) and the text: rows of one doc_id with different texts stay apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), text_column().alias("__bytes"))


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(documents, spans): each row's doc_id, key, word count and digest, and the spans of window starts (doc_id,
    key, from, to, both ends in) whose windows also start in a document with a smaller doc_id.

    Windows are equal if the hashes of their anchor and of all their words are: 128 bits."""
    schema = "doc_id long, key long, n_words long, sha256 string, seeds array<struct<anchor:long,run:long,first:int,last:int>>"
    seeded = shared_table(_source(docs).mapInArrow(_seed(window, gram), schema), "seeded")
    each = seeded.where("doc_id is not null").select("doc_id", "key", F.explode("seeds").alias("s")).select("doc_id", "key", "s.*")

    classes = each.groupBy("anchor", "run").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.min(F.struct("doc_id", "key", "first", "last")).alias("at"))
    anchors = classes.groupBy("anchor").agg(F.count("*").alias("classes"), F.min("least").alias("low"), F.max("most").alias("high"))
    shared = shared_table(classes.join(anchors.where("low < high").select("anchor", "classes"), "anchor").select("anchor", "run", "least", "most", "classes", "at"), "classes")

    several = shared.where("classes > 1").select("anchor", "run", F.col("least").alias("doc_id"), "at.key", "at.first", "at.last")
    runs = several.groupBy("doc_id", "key").agg(F.collect_list(F.struct("anchor", "run", "first", "last")).alias("runs"))
    runs = shared_table(runs, "runs")
    # one row for each text of a doc_id, however often it is repeated
    texts = only_ids(_source(docs), runs.select("doc_id")).join(runs, ["doc_id", "key"]).select("doc_id", "__bytes", "runs")
    windows = shared_table(texts.mapInArrow(_extend(window), "window long, least long, anchor long, run long, step int"), "windows")
    low = windows.groupBy("anchor", "window").agg(F.min("least").alias("low"), F.max("least").alias("high")).where("low < high")
    matched = windows.join(low.select("anchor", "window", "low"), ["anchor", "window"]).where("low < least").groupBy("anchor", "run").agg(F.sort_array(F.collect_set("step")).alias("steps"))

    # runs that other documents of the class repeat whole, and what the class's least document repeats of smaller ones
    info = shared.select("anchor", "run", "least", "most").join(matched, ["anchor", "run"], "left").where((F.col("least") < F.col("most")) | F.col("steps").isNotNull())
    # written, so that both sides of the join come by plain exchanges: then the runtime can split a frequent key
    hit = each.join(shared_table(info, "info"), ["anchor", "run"])
    whole = hit.where("doc_id > least").select("doc_id", "key", F.col("first").alias("from"), F.col("last").alias("to"))
    part = hit.where("doc_id = least and steps is not null").select("doc_id", "key", "first", F.explode("steps").alias("step")).select("doc_id", "key", (F.col("first") + F.col("step")).alias("from"), (F.col("first") + F.col("step")).alias("to"))
    return seeded.select("doc_id", "key", "n_words", "sha256"), whole.union(part)


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, kept_sha256 (and kept_text for those changed, if asked).

    Every word in a window of `window` words that also starts in a document with a smaller doc_id goes;
    windows are judged on the input. A null or empty text has no words. Rows with one doc_id are the same document
    to others and never repeat each other; each is judged by its own text and returned. Rows without doc_id are
    kept whole and lend nothing. Memory follows the longest text; other columns are not read.
    """
    stats, spans = repeated_spans(docs, window, gram)
    # repeats of one row give the same spans
    spans = shared_table(spans.groupBy("doc_id", "key").agg(F.collect_set(F.struct("from", "to")).alias("spans")), "spans")
    changed = only_ids(_source(docs), spans.select("doc_id")).join(spans, ["doc_id", "key"]).select("doc_id", "__bytes", "spans").mapInArrow(_remove(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    same = stats.join(spans.select("doc_id", "key"), ["doc_id", "key"], "left_anti").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha256").alias("kept_sha256"), F.lit(None).cast("string").alias("kept_text"))
    out = same.union(changed)
    return out if with_text else out.drop("kept_text")
