"""Cleaning and classification of text readings, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinescribe.functions import rules
from kinescribe.functions.base import SPACES, _literal, holds, let, may_hold, one_of, phrases, remembered, squeeze, squeeze_blanks, starts, strip, strip_of

DASHES = "[-–—]"


def normalize_raw(text: Column) -> Column:
    """Lower case, bars as i, and every run of anything but a-z and 0-9 as one space."""
    return _norm(F.lower(text))


def _norm(low: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(low, F.lit("|"), F.lit("i")), "[^a-z0-9]+", " "))


CONTROLS = "".join(map(chr, [*range(9), 11, 12, *range(14, 32)]))


def remove_fences(text: Column) -> Column:
    return F.when(text.contains("```"), F.regexp_replace(text, "(?imd)^```(?:text)?|```$", "")).otherwise(text)


def remove_controls(text: Column) -> Column:
    lines = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.translate(lines, CONTROLS, "")


def split_dialogue(line: Column) -> Column:
    """array<string>: a line that starts with a dash, cut at its inner dashes; other lines as they are."""
    def cut(dashed: Column) -> Column:
        parts = F.filter(F.transform(F.split(strip(F.substring(dashed, 3, 1 << 30)), rf"(?U)\s+{DASHES}\s*"), strip), lambda p: p != "")
        return let(parts, lambda p: F.when(dashed.startswith("- ") & (F.size(p) > 1), F.transform(p, lambda x: F.concat(F.lit("- "), x))).otherwise(F.array(dashed)))

    return F.when(line.rlike(rf"(?U)^\s*{DASHES}"), let(F.regexp_replace(line, rf"(?U)^\s*{DASHES}\s*", "- "), cut)).otherwise(F.array(line))


_PREFIX = "(?i)^(?:" + "|".join(map(_literal, rules.ANSWER_PREFIXES)) + ")"


def strip_prefix(text: Column) -> Column:
    """Without the first of the answer prefixes that the text starts with."""
    return F.when(text.rlike(_PREFIX), strip(strip_of(strip_of(strip(F.regexp_replace(text, _PREFIX, "")), '"'), "'"))).otherwise(text)


def strip_suffix(text: Column) -> Column:
    """Cut at the first listed absence marker found after the start."""
    def cut(low: Column) -> Column:
        found = F.get(F.filter(F.transform(phrases(rules.ABSENCE_SUFFIXES), lambda m: F.instr(low, m)), lambda i: i > 1), 0)
        return F.when(holds(low, rules.ABSENCE_SUFFIXES), F.coalesce(strip(strip_of(strip_of(strip(F.substring(text, F.lit(1), found - 1)), "."), "-")), text)).otherwise(text)

    return let(F.lower(text), cut)


def _leak(low: Column) -> Column:
    leaks = let(F.size(F.filter(phrases(rules.PROMPT_MARKERS), lambda m: low.contains(m))), lambda n: (n >= 2) | ((n == 1) & (F.length(low) <= 80)))
    return may_hold(low, rules.PROMPT_MARKERS) & (low.startswith("this is a request to read only the subtitle text") | leaks)


def prompt_leak(text: Column) -> Column:
    return let(F.lower(text), _leak)


def _empty(low: Column) -> Column:
    plain = strip_of(strip(squeeze_blanks(strip(low))), ".")
    return let(plain, lambda n: (F.length(n) < 90) & (one_of(n, rules.EMPTY_ANSWERS) | holds(n, rules.EMPTY_PHRASES)))


def empty_answer(text: Column) -> Column:
    return let(F.lower(text), _empty)


def language_menu(norm: Column) -> Column:
    return norm.startswith("subtitles ") & (F.size(F.array_intersect(F.split(norm, " "), phrases(rules.LANGUAGES))) >= 4)


def image_talk(norm: Column) -> Column:
    return starts(norm, rules.IMAGE_PREFIXES) | holds(norm, rules.IMAGE_MARKERS)


def _heaped(values: Column, least: Column) -> Column:
    """False only if no value comes `least` times. Sorted, so many equal ones cover a place that `least` divides, and half of
    the others stand on one side of it; so a few places are enough to look at."""
    def look(v: Column, c: Column, half: Column) -> Column:
        same = lambda i: (F.get(v, i) == F.get(v, i + half)) | (F.get(v, i) == F.get(v, i - half))
        return F.exists(F.sequence(F.lit(0), F.size(v), c), lambda i: F.coalesce(same(i), F.lit(False)))

    return let(least, lambda c: let(F.sort_array(values), lambda v: let(F.floor(c / 2).cast("int"), lambda half: look(v, c, half))))


@remembered
def ngram_loop(norm: Column) -> Column:
    """Ten words or more, most of which are one phrase of 2 to 5 words, at least four times (counted with overlaps)."""
    def often(values: Column, least: Column) -> Column:
        """Whether a value comes `least` times or more: then, sorted, it stands at two places so far apart."""
        return let(F.sort_array(values), lambda v: let(least, lambda c: (F.size(v) >= c) & F.exists(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(v) - c)), lambda i: F.get(v, i) == F.get(v, i + c - 1))))

    def test(words: Column) -> Column:
        part = F.size(words) * 0.55

        def least(width: int, slack: float = 0.0) -> Column:
            """The least count c of 4 or more with c * width >= part."""
            low = F.floor((part - slack) / width).cast("int")
            return F.greatest(F.lit(4), F.when(low * width >= part - slack, low).otherwise(low + 1))

        grams = lambda width: F.transform(F.sequence(F.lit(1), F.size(words) - width + 1), lambda i: F.array_join(F.slice(words, i, width), " "))
        loops = F.lit(False)
        for width in (2, 3, 4, 5):
            loops = loops | often(grams(width), least(width))
        # a phrase that fills 0.55 of n words has a first word, and a first pair of words, that come 0.55 / 5 * n times at least
        fewest, n = least(5, 1e-9), F.size(words)
        pairs = F.arrays_zip(F.slice(words, F.lit(1), n - 1).alias("a"), F.slice(words, F.lit(2), n - 1).alias("b"))
        return F.when((n >= 10) & _heaped(words, fewest), often(words, fewest) & often(pairs, fewest) & loops).otherwise(False)

    return let(F.split(norm, " "), test)


_SIZES = "(?:" + "|".join(rules.SIZE_TOKENS) + ")"


def stock_text(norm: Column) -> Column:
    return (
        starts(norm, rules.STOCK_PREFIXES)
        | norm.contains("translates to")
        | (norm.contains("who had been") & (F.regexp_count(norm, F.lit("who had been")) >= 4))
        | norm.rlike(f"^(?:{_SIZES} ){{5,}}{_SIZES}$")
        | norm.rlike("^[0-9](?: ?[0-9]){19,}$")
        | ngram_loop(norm)
    )


def scene_talk(norm: Column) -> Column:
    return starts(norm, rules.SCENE_PREFIXES) | (norm.startswith("die bombenangriffe") & norm.contains("katastrophalen zerst")) | norm.contains("soft glow illuminating the scene")


def _rule(text: Column, norm: Column) -> Column:
    def rule(n: Column) -> Column:
        note = n.startswith("please note ")
        russian = n.startswith("the text appears to be in russian")
        tests = (
            ("no_letters", (n == "") & ~text.rlike(r"[\p{L}\p{N}]")),
            ("exact", one_of(n, rules.NOISE_TEXTS)),
            ("subtitle_number", n.rlike("^subtitle [0-9 ]*[0-9][0-9 ]*$")),
            ("request", starts(n, ("please do not ", "please provide the image", "please provide a clearer image", "i need to read "))),
            ("note", note & (holds(n, rules.NOTE_ABSENCE_MARKERS) | holds(n, rules.NOTE_TEST_MARKERS))),
            ("test", starts(n, ("this is a test", "the quick brown fox", "the text is not clearly legible"))),
            ("digits", text.rlike(r"(?U)\d{25,}")),
            ("other_text", n.contains("no other text visible in the image")),
            ("russian", n.startswith("the text appears to be in russian and contains names") | (russian & n.contains("without additional context")) | n.startswith("the text appears to be in a language that uses a non latin script")),
            ("birthday", n.contains("happy birthday") & holds(n, rules.BIRTHDAY_MARKERS)),
            ("demonstration", holds(n, ("for demonstration purposes only", "test image", "placeholder"))),
            ("status", starts(n, rules.STATUS_PREFIXES)),
            ("language_menu", language_menu(n)),
            ("image_talk", image_talk(n)),
            ("stock_text", stock_text(n)),
            ("scene_talk", scene_talk(n)),
        )
        out = F.when(tests[0][1], tests[0][0]).when(n == "", F.lit(None).cast("string"))
        for name, test in tests[1:]:
            out = out.when(test, name)
        return out

    return let(norm, rule)


@remembered
def noise_rule(text: Column) -> Column:
    """The name of the first rule by which a text is noise; null if it is none."""
    return _rule(text, normalize_raw(text))


def is_noise(text: Column) -> Column:
    return noise_rule(text).isNotNull()


def suspicious_norm(norm: Column) -> Column:
    """The same by the norm of a text that cleaning gave."""
    return (norm == "") | starts(norm, rules.SINGLE_PREFIXES) | (norm.contains("shown in close up") & norm.contains("background is blurred")) | one_of(norm, rules.SINGLE_TEXTS)


_SINGLE_FIRST = r"\A[^a-z0-9]*(?:" + "|".join(dict.fromkeys(p.split()[0] for p in (*rules.SINGLE_PREFIXES, *rules.SINGLE_TEXTS))) + ")"


@remembered
def suspicious(text: Column) -> Column:
    """Texts that, seen once only, are likely a model's stock answer."""
    return let(normalize_raw(text), lambda n: suspicious_norm(n) | _rule(text, n).isNotNull())


@remembered
def suspicious_clean(text: Column) -> Column:
    """The same for a text that cleaning gave: it is no noise, and so no stock text and no talk of a scene."""
    def test(low: Column) -> Column:
        # an odd norm is empty, starts as one of the phrases does, or speaks of a close up; a bar is a letter in norms
        may = low.contains("|") | ~low.rlike("[a-z0-9]") | low.rlike(_SINGLE_FIRST) | low.contains("shown")
        return F.when(may, let(_norm(low), suspicious_norm)).otherwise(False)

    return F.when(text.isNotNull(), let(F.lower(text), test))


#: One line without controls and fences, with nothing at its ends that cleaning takes.
_BARE = rf"""\A[^\x00-\x1f`"'*{SPACES}\-–—][^\x00-\x1f`]*+(?<!["'*{SPACES}])\z"""


def _bare(text: Column) -> Column:
    """Without fences, controls, prefix, quotes and what follows a marker of absence; most texts have none of it."""
    lines = F.split(remove_controls(remove_fences(text)), "\n", -1)
    lines = F.filter(F.transform(lines, lambda x: strip(squeeze_blanks(x))), lambda x: x != "")
    whole = strip(strip_of(strip_of(strip(F.array_join(F.flatten(F.transform(lines, split_dialogue)), "\n")), '"'), "'"))
    taken = let(let(whole, strip_prefix), lambda t: strip(strip_of(strip_suffix(t), "*")))
    as_is = text.rlike(_BARE) & ~text.contains("  ") & ~text.rlike(_PREFIX) & ~holds(F.lower(text), rules.ABSENCE_SUFFIXES)
    return F.when((text == "") | as_is, text).otherwise(taken)


@remembered
def clean_with_norm(text: Column) -> Column:
    """struct(cleaned, norm): clean(text), and normalize_raw of it, which its tests need anyway."""
    none = F.struct(F.lit("").alias("cleaned"), F.lit("").alias("norm"))

    def tested(t: Column, low: Column) -> Column:
        whole = lambda n: F.when(_rule(t, n).isNotNull(), none).otherwise(F.struct(t.alias("cleaned"), n.alias("norm")))
        return F.when((t == "") | _leak(low) | _empty(low), none).otherwise(let(_norm(low), whole))

    return let(let(F.coalesce(text, F.lit("")), _bare), lambda t: let(F.lower(t), lambda low: tested(t, low)))


@remembered
def clean(text: Column) -> Column:
    """One pass of cleaning; an empty text where nothing is left or the rest is noise. Null is empty.
    Passes are not idempotent: each takes one prefix and one layer of quotes."""
    return clean_with_norm(text)["cleaned"]


@remembered
def clean_again(cleaned: Column) -> Column:
    """clean of a text that cleaning gave. It changes only texts with another layer to take: quotes or asterisks at an end,
    a prefix, a marker of absence, fences, or lines with dashes. The others have passed every test as they are."""
    return F.when(_layered(cleaned), clean(cleaned)).otherwise(cleaned)


def _layered(cleaned: Column) -> Column:
    ends = cleaned.rlike("^[\"'*]|^" + DASHES) | cleaned.rlike("[\"'*]$")
    inside = cleaned.contains("```") | (cleaned.contains("\n") & cleaned.rlike("\n" + DASHES))
    return ends | inside | cleaned.rlike(_PREFIX) | holds(F.lower(cleaned), rules.ABSENCE_SUFFIXES)


def normalize(text: Column) -> Column:
    return normalize_raw(clean(text))


def norm_of_clean(cleaned: Column, norm: Column | None = None) -> Column:
    """normalize(text) of a text that cleaning gave; norm is its normalize_raw, if there is one already."""
    return normalize_raw(clean_again(cleaned)) if norm is None else F.when(_layered(cleaned), normalize_raw(clean(cleaned))).otherwise(norm)


def normalize_clean(cleaned: Column, norm: Column | None = None) -> Column:
    """struct(norm, again) of a text that cleaning gave: normalize(text), and normalize of that once more. A norm keeps
    the words that the noise rules look at, so only the tests that look at signs are made again."""
    def again(n: Column) -> Column:
        more = n.rlike(_PREFIX) | holds(n, rules.ABSENCE_SUFFIXES)
        return F.when(n == "", "").when(more, normalize(n)).when(prompt_leak(n) | empty_answer(n), "").otherwise(n)

    return let(norm_of_clean(cleaned, norm), lambda n: F.struct(n.alias("norm"), again(n).alias("again")))


__all__ = ["clean", "clean_again", "clean_with_norm", "is_noise", "noise_rule", "norm_of_clean", "normalize", "normalize_clean", "normalize_raw", "split_dialogue", "squeeze", "suspicious", "suspicious_clean", "suspicious_norm"]
