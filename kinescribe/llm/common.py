"""What the corpus operators share: tables in the shared folder, id filters, Arrow helpers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinescribe.sources.staging import shared_table as shared_table

#: Words are runs of anything but space, tab, LF, VT, FF and CR (Java and RE2 syntax).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A name for a working column that df doesn't have, in any letter case."""
    taken = {c.lower() for c in df.columns}
    name = "__" + name
    while name.lower() in taken:
        name += "_"
    return name


#: Bits of the greatest id filter: 2 million words of 64 bits, about 100 MB when broadcast.
MOST_BITS = 1 << 27


def only_ids(df: DataFrame, ids: DataFrame, column: str = "doc_id", most: int = MOST_BITS) -> DataFrame:
    """Rows of df whose id may be among ids (a written table): a one-hash bitmap of 8 to 16 bits an id is
    broadcast. It passes a superset, at most an eighth of the rest, so an exact join must follow. Where that
    many ids would need more than `most` bits nothing is broadcast, and the join alone decides."""
    bits = max(1 << 12, 1 << (8 * ids.count()).bit_length())
    if bits > most:
        return df
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    word = lambda c: F.shiftright(at(c), 6)
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), (at(c) % 64).cast("int"))
    bitmap = ids.groupBy(word(F.col(column)).alias("__word")).agg(F.bit_or(bit(F.col(column))).alias("__bits"))
    joined = df.join(F.broadcast(bitmap), word(F.col(column)) == F.col("__word"))
    return joined.where(F.col("__bits").bitwiseAND(bit(F.col(column))) != 0).drop("__word", "__bits")


def text_column(name: str = "text"):
    """A text as UTF-8 with a final line feed, so that texts lie apart in an Arrow buffer."""
    return F.concat(F.coalesce(F.col(name), F.lit("")), F.lit("\n")).cast("binary")


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary Arrow column in one array, and the offsets of its values."""
    if pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def pieces(batches: Iterable[pa.RecordBatch], column: str, size: int = 1 << 21) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts Arrow batches into runs of rows of about `size` bytes (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, at = flat_bytes(batch.column(column))
        row = 0
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(at, at[row] + size, "right")) - 1)
            end = min(end, batch.num_rows)
            yield batch.slice(row, end - row), data[at[row] : at[end]], at[row : end + 1] - at[row]
            row = end
