"""Small building blocks of column expressions."""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Callable, Iterable

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line breaks as text editors see them.
LINE_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.transform(F.array(value), body)[0]


_REMEMBERED: dict[tuple, Column] = {}


def remembered(make: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """make(column), built once a session for each column given by its name only. Such an expression is bound to no
    table, so it serves all; building a large one takes thousands of calls to the JVM."""
    @functools.wraps(make)
    def call(column: Column) -> Column:
        node = column._jc.node() if hasattr(column, "_jc") else None
        if node is None or node.getClass().getSimpleName() != "UnresolvedAttribute" or node.planId().isDefined():
            return make(column)
        key = (SparkContext._active_spark_context.applicationId, make.__module__, make.__qualname__, node.nameParts().mkString("\0"))
        if key not in _REMEMBERED:
            _REMEMBERED[key] = make(column)
        return _REMEMBERED[key]

    return call


#: White space of any Unicode kind.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without white space (any Unicode kind) at both ends."""
    return F.btrim(text, F.lit(SPACES))


def strip_of(text: Column, char: str) -> Column:
    return F.btrim(text, F.lit(char))


def even(text: Column) -> Column:
    """Whether a text has no white space but single spaces and no line break; most have neither, and one look costs less
    than replacing."""
    return ~text.rlike(r"(?U)[\s\x1c-\x1e&&[^ ]]") & ~text.contains("  ")


def squeeze(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.when(even(text), text).otherwise(F.regexp_replace(text, r"(?U)\s+", " ")))


def squeeze_blanks(text: Column) -> Column:
    """Runs of spaces and tabs as one space; most texts have none, and searching costs less than replacing."""
    return F.when(text.contains("  ") | text.contains("\t"), F.regexp_replace(text, "[ \t]+", " ")).otherwise(text)


def _literal(phrase: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", phrase)


def starts(text: Column, phrases: Iterable[str]) -> Column:
    return text.rlike("^(?:" + "|".join(map(_literal, phrases)) + ")")


@functools.cache
def _array_sql(phrases: tuple[str, ...]) -> str:
    return "array(" + ", ".join("'" + p.replace("\\", "\\\\").replace("'", "\\'") + "'" for p in phrases) + ")"


def phrases(values: Iterable[str]) -> Column:
    """A constant array, parsed from one text: a call for each phrase would cost more than the query."""
    return F.expr(_array_sql(tuple(values)))


@functools.cache
def keys(values: tuple[str, ...]) -> tuple[str, ...]:
    """Few words, so that each of the phrases has one: a text with none of them has no phrase."""
    left, out = dict.fromkeys(values), []
    while left:
        words = Counter(w for v in left for w in {w for w in v.split() if len(w) > 3} or {v})
        best = min(words, key=lambda w: (-words[w], -len(w), w))
        out.append(best)
        left = {v: None for v in left if best not in v}
    return tuple(out)


def may_hold(text: Column, values: Iterable[str]) -> Column:
    """Whether a text has one of the phrases' keys."""
    return F.exists(phrases(keys(tuple(values))), lambda p: text.contains(p))


def holds(text: Column, values: Iterable[str]) -> Column:
    """Plain searches, one a phrase: faster than a pattern of alternatives tried at every place. Their few keys come first."""
    found = F.exists(phrases(values), lambda p: text.contains(p))
    return may_hold(text, values) & found if 2 * len(keys(tuple(values))) <= len(tuple(values)) else found


def one_of(text: Column, values: Iterable[str]) -> Column:
    return F.array_contains(phrases(values), text)


def chars(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
