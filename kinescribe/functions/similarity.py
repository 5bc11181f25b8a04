"""Similarity of readings. The matching-blocks ratio has no built-in form, so it runs in an Arrow UDF
over the few pairs that cheap bounds leave open.

The ratio takes the longest common block of two texts, the first of equals, and goes on left and right of it.
Where the right text is short, all equal places of both are the bits of one integer, a row for each character of the left
text: a block of k characters is k bits on a diagonal, and the starts of all blocks of 2k are `runs & runs >> k diagonals`.
Where it is long, only rare characters start a block, and their equal places are listed."""

from __future__ import annotations

from bisect import bisect_left
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

SIMILAR, CONTAINED, CONTAINED_CHARS = 0.86, 0.64, 6
#: In right texts of so many characters, one that is more than a hundredth of them (and one more) starts no block.
LONG_TEXT, FREQUENT = 200, 100
#: The most places of two texts held as bits (128 KB), and the most equal places held as a list; beyond, the same ratio comes
#: from the standard library's matcher.
MOST_BITS, MOST_EQUAL = 1 << 20, 1 << 16


def _longest(grid: int, step: int) -> tuple[int, int]:
    """(size, first bit) of the longest diagonal run of bits in a grid with any; the first of equals."""
    size, runs, halves = 1, grid, []
    while twice := runs & runs >> size * step:
        halves.append((size, runs))
        size, runs = 2 * size, twice
    for more, starts in reversed(halves):
        if longer := runs & starts >> size * step:
            size, runs = size + more, longer
    return size, (runs & -runs).bit_length() - 1


def _short_blocks(a: str, b: str) -> int:
    """Characters in matching blocks, where every character may start one."""
    n, m = len(a), len(b)
    # a row ends in a bit that is never set, so that no diagonal goes on in the next row
    width = m // 8 + 1
    row = 8 * width
    places: dict[str, int] = {}
    for j, c in enumerate(b):
        places[c] = places.get(c, 0) | 1 << j
    rows = {c: x.to_bytes(width, "little") for c, x in places.items()}
    none = bytes(width)
    same = int.from_bytes(b"".join([rows.get(c, none) for c in a]), "little")
    firsts = int.from_bytes((b"\1" + bytes(width - 1)) * n, "little")
    total, open_ = 0, [(0, n, 0, m)]
    while open_:
        top, bottom, left, right = open_.pop()
        inside = (firsts & (1 << (bottom - top) * row) - 1) * ((1 << right) - (1 << left))
        if grid := same >> top * row & inside:
            size, at = _longest(grid, row + 1)
            i, j = top + at // row, at % row
            total += size
            if i > top and j > left:
                open_.append((top, i, left, j))
            if i + size < bottom and j + size < right:
                open_.append((i + size, bottom, j + size, right))
    return total


def _long_blocks(a: str, b: str) -> int | None:
    """Characters in matching blocks, where only rare characters of b start one, and frequent ones go on with it (or
    with the corner, where no block starts). The few equal places are a list; None if they aren't few."""
    n, m = len(a), len(b)
    count = {c: b.count(c) for c in set(b)}
    rare = {c: [] for c, k in count.items() if k <= m // FREQUENT + 1}
    if sum(a.count(c) * count[c] for c in rare) > MOST_EQUAL:
        return None
    for j, c in enumerate(b):
        if c in rare:
            rare[c].append(j)
    row = m + 1
    equal = [i * row + j for i, c in enumerate(a) if c in rare for j in rare[c]]
    total, open_ = 0, [(0, n, 0, m, equal)]
    while open_:
        top, bottom, left, right, equal = open_.pop()
        size, end, runs = 0, 0, {}
        for at in equal:
            run = runs[at] = runs.get(at - row - 1, 0) + 1
            if run > size:
                size, end = run, at
        i, j = divmod(end - (size - 1) * (row + 1), row) if size else (top, left)
        while i > top and j > left and a[i - 1] == b[j - 1]:
            i, j, size = i - 1, j - 1, size + 1
        while i + size < bottom and j + size < right and a[i + size] == b[j + size]:
            size += 1
        if size:
            total += size
            if i > top and j > left:
                open_.append((top, i, left, j, [at for at in equal[: bisect_left(equal, i * row)] if at % row < j]))
            i, j = i + size, j + size
            if i < bottom and j < right:
                open_.append((i, bottom, j, right, [at for at in equal[bisect_left(equal, i * row) :] if at % row >= j]))
    return total


def block_ratio(a: str, b: str) -> float:
    """Twice the characters in matching blocks by the sum of lengths; 1 for two empty texts."""
    n, m = len(a), len(b)
    if a == b:
        return 1.0
    total = _long_blocks(a, b) if m >= LONG_TEXT else _short_blocks(a, b) if n * m <= MOST_BITS else None
    return SequenceMatcher(None, a, b).ratio() if total is None else 2.0 * total / (n + m)


def shared_letters(a: str, b: str) -> float:
    """A bound of the ratio: by the characters that both have, in any order."""
    return 2.0 * sum(min(a.count(c), b.count(c)) for c in set(a)) / (len(a) + len(b)) if a or b else 1.0


@F.pandas_udf(DoubleType())
def _ratio(left: pd.Series, right: pd.Series, least: pd.Series) -> pd.Series:
    """Ratios; 0 where the shared letters alone show that one is under least."""
    def one(a: str | None, b: str | None, low: float) -> float | None:
        if a is None or b is None:
            return None
        return block_ratio(a, b) if low <= 0 or shared_letters(a, b) >= low else 0.0

    return pd.Series([one(a, b, x) for a, b, x in zip(left, right, least)], dtype="float64")


def ratio_bound(left: Column, right: Column) -> Column:
    """No ratio is over twice the shorter length by the sum of lengths."""
    return 2 * F.least(F.length(left), F.length(right)) / (F.length(left) + F.length(right))


def _bounded_ratio(left: Column, right: Column, least: float) -> Column:
    """The ratio; 1 for equal texts, and 0 where a bound is under least: by the lengths without calling Python (the UDF
    gets nulls there), by the letters in the UDF."""
    open_ = (left != right) & (left != "") & (right != "") & (ratio_bound(left, right) >= least)
    value = _ratio(F.when(open_, left), F.when(open_, right), F.lit(float(least)))
    return F.when(left == right, 1.0).when(open_, value).otherwise(0.0)


def similarity(left: Column, right: Column) -> Column:
    """Ratio of two normalized texts: both empty 1, one empty 0. Not symmetric."""
    return _bounded_ratio(left, right, 0.0)


def near_duplicate(left: dict[str, Column], right: dict[str, Column], threshold: float = SIMILAR) -> Column:
    """Whether two readings are near duplicates. Each side has `norm` and `again` (the norm, normalized once
    more). Empty norms never are; equal or similar ones are; and a norm of six characters or more inside
    the other, at a lower similarity of shorter to longer, is."""
    a, b = left["norm"], right["norm"]
    least = min(threshold, CONTAINED)
    swap = F.length(a) > F.length(b)
    inside = F.when(swap, a.contains(b)).otherwise(b.contains(a)) & (F.least(F.length(a), F.length(b)) >= CONTAINED_CHARS)
    direct = _bounded_ratio(left["again"], right["again"], threshold)
    other = F.when(swap, right["again"]), F.when(swap, left["again"])
    turned = _bounded_ratio(F.when(inside, F.coalesce(other[0], left["again"])), F.when(inside, F.coalesce(other[1], right["again"])), least)
    return F.coalesce((a != "") & (b != "") & ((direct >= threshold) | (inside & (turned >= CONTAINED))), F.lit(False))
