"""Caption layout: cue times, two-line layout, wrapping, and where long captions are cut."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinescribe.functions.base import LINE_BREAKS, even, let, remembered, squeeze, strip

LINE, LINES = 42, 2
LONG, GAP, SHORT = 84, 0.04, 0.5
BOUNDARY = r"""(?U)(?<=[.!?])\s+(?=[A-Z0-9"'-])"""
#: What every boundary has; where it is not found, the text is one sentence.
MAY_END = r"(?U)[.!?]\s"


def srt_time(seconds: Column) -> Column:
    """HH:MM:SS,mmm; milliseconds to the nearest even, not below zero; hours may have more digits."""
    def parts(ms: Column) -> Column:
        return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3600000).cast("long"), F.floor(ms % 3600000 / 60000).cast("long"), F.floor(ms % 60000 / 1000).cast("long"), ms % 1000)

    return let(F.greatest(F.lit(0), F.rint(seconds * 1000).cast("long")), parts)


def text_lines(text: Column) -> Column:
    lines = F.filter(F.transform(F.split(strip(text), LINE_BREAKS), squeeze), lambda x: x != "")
    return F.when((text != "") & ~text.startswith(" ") & ~text.endswith(" ") & even(text), F.array(text)).otherwise(lines)


def _fit(lines: Column, most: int = LINE) -> Column:
    return F.forall(lines, lambda x: F.length(x) <= most)


def sentences(text: Column) -> Column:
    parts = F.when(~text.rlike(MAY_END), F.array(text)).otherwise(F.split(text, BOUNDARY))
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def sentence_pair(text: Column) -> Column:
    """Two lines made of whole sentences: two sentences as they are; of more, the best balanced cut at which
    both lines fit (the earliest of equals); else null."""
    def choose(parts: Column) -> Column:
        pair = lambda i: F.array(F.array_join(F.slice(parts, F.lit(1), i), " "), F.array_join(F.slice(parts, i + 1, F.size(parts)), " "))
        cuts = F.filter(
            F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: let(pair(i), lambda p: F.struct(F.abs(F.length(p[0]) - F.length(p[1])).alias("off"), i.alias("at"), p.alias("pair")))),
            lambda c: _fit(c["pair"]),
        )
        return F.when(F.size(parts) == 2, parts).when((F.size(parts) > 2) & (F.length(text) <= 2 * LINE + 1), F.array_min(cuts)["pair"])

    return let(sentences(text), choose)


def split_index(text: Column) -> Column:
    """The space (from 0) at which two lines overflow least, then the one nearest the middle, then the first; null if
    none. On either side of the middle the overflow grows outwards, so only the nearest space of each side counts."""
    def best(t: Column) -> Column:
        n = F.length(t)
        half = F.floor(n / 2).cast("int")
        over = lambda k: F.greatest(F.lit(0), k - LINE)
        rank = lambda i: F.when(i >= 0, F.struct((over(i) + over(n - i - 1)).alias("over"), F.abs(i - n / 2).alias("off"), i.alias("at")))
        before = let(F.instr(F.reverse(F.substring(t, F.lit(1), half + 1)), " "), lambda k: F.when(k > 0, half + 1 - k))
        after = F.locate(" ", F.substring(t, half + 2, n))
        after = let(after, lambda k: F.when(k > 0, half + k))
        return F.least(let(before, rank), let(after, rank))["at"]

    return let(text, best)


def _halves(text: Column, at: Column) -> Column:
    return F.array(strip(F.substring(text, F.lit(1), at)), strip(F.substring(text, at + 2, F.length(text))))


@remembered
def two_lines(text: Column) -> Column:
    """array of one or two lines."""
    def cut(t: Column) -> Column:
        return let(split_index(t), lambda i: F.when(i.isNull(), F.array(t)).otherwise(F.filter(_halves(t, i), lambda x: x != "")))

    return let(squeeze(text), lambda t: F.when(F.length(t) <= LINE, F.array(t)).otherwise(cut(t)))


def word_chunks(word: Column, most: int = LINE) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.length(word) - 1) / most).cast("int")), lambda i: F.substring(word, i * most + 1, F.lit(most)))


def wrap(line: Column, most: int = LINE) -> Column:
    """Greedy lines of words; a longer word ends the line before it and is cut, its last chunk goes on. A match is the
    longest stretch that ends where a word does, or as much of a longer word as fits."""
    return F.regexp_extract_all(squeeze(line), F.lit(f"[^ ](?:.{{0,{most - 2}}}[^ ])?(?= |$)|[^ ]{{{most}}}"), F.lit(0))


@remembered
def layout(text: Column) -> Column:
    """The caption's lines as array<string>: a fitting pair of sentence lines; lines that fit already; two
    dialogue lines, wrapped; a balanced cut, each half wrapped where it doesn't fit, which may give more than two
    lines. What is longer than two full lines and a space can't fit, so only the last two ways are left."""
    def lay(lines: Column) -> Column:
        wrapped = lambda ls: F.flatten(F.transform(ls, lambda x: wrap(x)))
        talk = (F.size(lines) == LINES) & F.exists(lines, lambda x: x.startswith("-"))

        def short(joined: Column) -> Column:
            cut = let(two_lines(joined), lambda t: F.when(_fit(t), t).otherwise(wrapped(t)))
            return let(sentence_pair(joined), lambda p: F.when(p.isNotNull() & _fit(p), p)
                .when((F.size(lines) <= LINES) & _fit(lines), lines)
                .when(talk, wrapped(lines))
                .otherwise(cut))

        fits = lambda joined: F.when(F.length(joined) <= 2 * LINE + 1, short(joined)).otherwise(wrapped(F.when(talk, lines).otherwise(two_lines(joined))))
        return F.when(F.size(lines) == 0, F.array().cast("array<string>")).otherwise(let(F.array_join(lines, " "), fits))

    return let(text_lines(text), lay)


@remembered
def layout_text(text: Column) -> Column:
    return F.array_join(layout(text), "\n")


@remembered
def display_length(text: Column) -> Column:
    """The length of the laid out lines with a space between them. Lines are cut at spaces, which count as well, so only
    words longer than a line, which are cut inside, make it longer than the text."""
    laid = F.length(F.array_join(layout(text), " "))
    cut = rf"\A[^ ]{{{LINE + 1}}}| [^ ]{{{LINE + 1}}}"
    return let(F.array_join(text_lines(text), " "), lambda t: F.when(t.rlike(cut), laid).otherwise(F.length(t)))


@remembered
def sentence_split(text: Column) -> Column:
    """array of two: the text cut at the sentence boundary nearest its middle (the left of equals); null if none.
    Text stands on both sides of a boundary, so the nearest one always works."""
    def cut(t: Column) -> Column:
        # a boundary's place follows from the lengths of what stands between boundaries and of the space at them
        zipped = F.arrays_zip(F.split(t, BOUNDARY, -1).alias("part"), F.regexp_extract_all(t, F.lit(BOUNDARY), F.lit(0)).alias("mark"))
        start = F.struct(F.lit(0).alias("at"), (F.length(t) / 2).alias("half"), F.lit(None).cast("struct<off:double,at:int>").alias("best"))

        def step(s: Column, x: Column) -> Column:
            def mark(b: Column) -> Column:
                here = F.when(x["mark"].isNotNull(), F.struct(F.abs(b - s["half"]).alias("off"), b.alias("at")))
                return F.struct((b + F.coalesce(F.length(x["mark"]), F.lit(0))).alias("at"), s["half"].alias("half"), F.least(s["best"], here).alias("best"))

            return let(s["at"] + F.length(x["part"]), mark)

        return let(F.aggregate(zipped, start, step, lambda s: s["best"]["at"]), lambda b: F.when(b.isNotNull(), _halves(t, b)))

    return let(text, lambda t: F.when(t.rlike(MAY_END), cut(t)))


@remembered
def long_split(text: Column) -> Column:
    """array of two for consecutive captions: by sentence, else at the best space; null if neither works."""
    def words(t: Column) -> Column:
        return let(split_index(t), lambda i: F.when(i.isNotNull(), let(_halves(t, i), lambda h: F.when((h[0] != "") & (h[1] != ""), h))))

    return let(text, lambda t: F.coalesce(sentence_split(t), words(t)))
