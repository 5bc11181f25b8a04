"""Packing token sequences: Karmarkar-Karp multiway differencing of document tails into windows.

A document's ids are cut every `size` ids; full pieces are sequences of their own. What is left at
its end is cut every `piece` ids, as finer pieces balance better. Texts are tokenized where they are read;
only the pieces' rows are shuffled, into groups of about `group` by a hash of what they are. So the sequences
follow from the documents alone, however the input is split, and all groups are large enough to fill their
windows. A group's tails are dealt to windows by differencing: each piece starts as a partial partition of its own, and the two partial partitions with the widest gaps between their fullest and
emptiest window are merged, fullest onto emptiest, until one is left. It starts from the fewest
windows that could hold the pieces; while any window is over capacity the count rises by one.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinescribe.llm.common import shared_table

SIZE = 2048
SPECIAL = "<|endoftext|>"


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Deals items to `windows` windows with near-equal sums; the windows' items.

    A partial partition lists its windows that hold anything, fullest first; the others are empty."""
    heap = []
    for i, x in enumerate(sizes):
        heap.append((-x if windows > 1 else 0, i, [(x, (i,))]))
    heapq.heapify(heap)
    tick = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        free = windows - len(a)
        # the emptiest windows of a take the fullest of b: first those of a that are empty
        merged = a + b[:free] if free > 0 else list(a)
        for j in range(max(0, free), len(b)):
            k = len(a) - 1 - (j - max(0, free))
            merged[k] = (a[k][0] + b[j][0], (a[k][1], b[j][1]))
        merged.sort(key=lambda w: -w[0])
        gap = merged[0][0] - (merged[-1][0] if len(merged) == windows else 0)
        tick += 1
        heapq.heappush(heap, (-gap, tick, merged))

    def items(node) -> list[int]:
        out, stack = [], [node]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack.extend(reversed(x))
            else:
                out.append(x)
        return out

    return [items(w[1]) for w in heap[0][2]] if heap else []


def pack(sizes: list[int], size: int = SIZE) -> list[list[int]]:
    """Windows of at most `size`; every item (1 to size) lies in one."""
    count = max(1, -(-sum(sizes) // size))
    while True:
        windows = differencing(sizes, count)
        if all(sum(sizes[i] for i in w) <= size for w in windows):
            return windows
        count += 1


def tokenizer(name: str) -> Callable[[list[str]], list[np.ndarray]]:
    """Ids of texts by the public byte-level vocabulary `name`. The ranks of the same vocabulary give
    the same ids several times faster; a text that spells a special token goes through the tokenizer
    file itself."""
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(name.replace(".json", ".tiktoken")), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    whole = Tokenizer.from_file(public_tokenizers.path(name))

    def encode(texts: list[str]) -> list[np.ndarray]:
        return [np.array(whole.encode(t, add_special_tokens=False).ids if SPECIAL in t else fast.encode_ordinary(t), "<u4") for t in texts]

    return encode


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
SCHEMA = PIECES + ", sequence_id long, offset long"


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(x.split()[0], pa.int64()) for x in ddl.split(", ")])


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=_arrow(ddl))


def _cut(name: str, size: int, piece: int):
    """Rows (doc_id, text) to the pieces of each text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(name)
        rows: list[tuple] = []
        for batch in batches:
            for at in range(0, batch.num_rows, 32):
                part = batch.slice(at, 32)
                for doc, ids in zip(part.column("doc_id").to_pylist(), encode(part.column("text").to_pylist())):
                    ids = np.append(ids, np.uint32(1)).astype("<u4")
                    n = len(ids)
                    whole = n - n % size
                    for start in [*range(0, whole, size), *range(whole, n, piece)]:
                        cut = ids[start : min(n, start + (size if start < whole else piece))]
                        rows.append((doc, start, len(cut), zlib.crc32(cut), n))
                if len(rows) >= 4096:
                    yield _batch(rows, PIECES)
                    rows = []
        if rows:
            yield _batch(rows, PIECES)

    return run


def _deal(size: int):
    """Rows (group, piece), in the order of groups, to pieces with their places. A group is held at a time."""

    def places(group: int, rows: list[tuple]) -> list[tuple]:
        full = [r for r in rows if r[2] == size]
        tails = [r for r in rows if r[2] < size]
        windows = [[r] for r in full] + [[tails[i] for i in sorted(w)] for w in (pack([r[2] for r in tails], size) if tails else [])]
        out = []
        for k, window in enumerate(windows):
            at = 0
            for r in window:
                out.append((*r, (group << 32) + k, at))
                at += r[2]
        return out

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in batches:
            for key, *row in zip(*[c.to_pylist() for c in batch.columns]):
                if key != group and held:
                    yield _batch(places(group, held), SCHEMA)
                    held = []
                group = key
                held.append(tuple(row))
        if held:
            yield _batch(places(group, held), SCHEMA)

    return run


def pack_documents(docs: DataFrame, name: str = "byte_bpe_50k.json", size: int = SIZE, piece: int = 512, group: int = 4096) -> DataFrame:
    """One row for each piece of a document: where it lies in the document and in which sequence.

    sequence_id is the group's number * 2**32 plus the sequence's in its group; reruns and other splits of the
    input give the same. A null or empty text is the final id alone. Repeated rows are packed each: equal pieces
    are counted first and then spread over groups, so that repeats of one row can't fill one. Rows without
    doc_id are packed too, with a null doc_id. A very long text is tokenized in one task, its pieces are spread.
    An empty table gives an empty result; other columns are not read.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    pieces = shared_table(source.mapInArrow(_cut(name, size, piece), PIECES), "pieces")
    groups = F.lit(max(1, pieces.count() // group)).cast("long")
    fields = [x.split()[0] for x in PIECES.split(", ")]
    each = pieces.groupBy(*fields).agg(F.count("*").alias("m")).select(*fields, F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("copy"))
    # 64 copies go to a group together
    at = F.pmod(F.xxhash64(*fields[:4]) + F.floor(F.col("copy") / 64).cast("int") * F.lit(7919), groups)
    dealt = each.select(at.alias("group"), *fields).repartition("group").sortWithinPartitions("group", *fields)
    return dealt.mapInArrow(_deal(size), SCHEMA)
