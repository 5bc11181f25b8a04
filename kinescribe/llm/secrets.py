"""Secret scans (DataFrame functions only): patterns, and sliding-window entropy per character class.

Positions come from splitting a text at a pattern: the lengths of the parts between matches and of the
matches add up to each match's start. Candidate strings are long runs of token characters with both
letters and digits. Over each one a window slides; a count for each character goes with it, and entering and
leaving characters change their counts and the sum of c * log2(c) over them, which gives the window's Shannon
entropy without counting anew.
Windows at or over their class's limit, merged, are a finding, unless the candidate is on the allow-list.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinescribe.llm.common import fresh

# The patterns asked for, in the order of their kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_WORD = r"(?i)password|passwd|secret|token|api_?key"
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_alnum", "entropy_base64")
#: Character classes by kind: what the whole candidate consists of, and the entropy limit in bits, which a hundredth of random
#: strings of one window of the class (alnum: of lower case and digits) stay under.
CLASSES = (("entropy_hex", "^[0-9a-fA-F]+$", 2.9), ("entropy_alnum", "^[A-Za-z0-9]+$", 3.35), ("entropy_base64", "", 3.6))
WINDOW = 20
#: Candidates that match one of these are no secrets: words of examples, one repeated character, UUIDs.
ALLOWED = ("(?i)example|sample|dummy|placeholder|changeme", r"^(.)\1*$", "^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")

_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _none() -> Column:
    return F.array().cast(_SPAN)


def _matches(text: Column, pattern: str, kind: int, group: int = 0, least: int = 1) -> Column:
    """Spans of the pattern's matches whose group has at least `least` characters."""
    sizes = lambda of: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(of)), lambda x: F.length(x))
    parts = [F.split(text, pattern, -1).alias("before"), sizes(0).alias("size")]
    found = F.arrays_zip(*parts, sizes(group).alias("held")) if group else F.arrays_zip(*parts)
    held = lambda x: x["held"] if group else x["size"]
    walk = F.aggregate(
        found,
        F.struct(F.lit(0).alias("at"), _none().alias("spans")),
        lambda s, x: F.struct(
            (s["at"] + F.length(x["before"]) + F.coalesce(x["size"], F.lit(0))).alias("at"),
            F.when(held(x) >= least, F.concat(s["spans"], F.array(F.struct((s["at"] + F.length(x["before"])).alias("start"), F.lit(kind).alias("kind"), (s["at"] + F.length(x["before"]) + x["size"]).alias("end"))))).otherwise(s["spans"]).alias("spans"),
        ),
        lambda s: s["spans"],
    )
    return walk


#: The characters of candidates. Their counts are packed into longs, 5 bits each, 12 a long.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
BITS, PACKED = 5, 12


def entropy_hits(chars: Column, limit: Column, window: int = WINDOW) -> Column:
    """First and last position (end exclusive) of the windows whose entropy reaches the limit; null if none.
    chars: characters of ALPHABET; a window has fewer than 2 ** BITS of them."""
    if window >= 1 << BITS:
        raise ValueError(f"a window has fewer than {1 << BITS} characters")
    terms = F.array(*[F.lit(c * math.log2(c) if c > 1 else 0.0) for c in range(window + 2)])
    shift = lambda x, by: F.call_function("shiftleft", x, by)
    slot = lambda c: F.floor(c / PACKED).cast("int")
    place = lambda c: (c % PACKED) * BITS
    count = lambda counts, c: F.call_function("shiftright", F.get(counts, slot(c)), place(c)).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")
    add = lambda counts, c, one: F.transform(counts, lambda x, i: F.when(i == slot(c), x + shift(F.lit(one).cast("long"), place(c))).otherwise(x))

    def move(counts: Column, total: Column, c: Column, one: int) -> Column:
        """struct(counts, sum) with one character c more or fewer."""
        change = lambda n: F.get(terms, n + one) - F.get(terms, n)
        return F.struct(add(counts, c, one).alias("counts"), (total + change(count(counts, c))).alias("sum"))

    codes = F.transform(chars, lambda c: F.instr(F.lit(ALPHABET), c) - 1)

    def hits(codes: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            # one-element arrays hold what is used more than once
            less = F.when(i >= window, move(s["counts"], s["sum"], F.get(codes, i - window), -1)).otherwise(F.struct(s["counts"].alias("counts"), s["sum"].alias("sum")))
            now = F.transform(F.array(less), lambda t: move(t["counts"], t["sum"], F.get(codes, i), 1))

            def mark(t: Column) -> Column:
                hit = (i >= window - 1) & (F.lit(math.log2(window)) - t["sum"] / window + 1e-9 >= limit)
                return F.struct(t["counts"].alias("counts"), t["sum"].alias("sum"), F.when(hit, F.coalesce(s["first"], i - window + 1)).otherwise(s["first"]).alias("first"), F.when(hit, i + 1).otherwise(s["last"]).alias("last"))

            return F.transform(now, mark)[0]

        none = F.lit(None).cast("int")
        start = F.struct(F.array_repeat(F.lit(0).cast("long"), -(-len(ALPHABET) // PACKED)).alias("counts"), F.lit(0.0).alias("sum"), none.alias("first"), none.alias("last"))
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))

    return F.transform(F.array(codes), hits)[0]


def _entropy_spans(text: Column, window: int, allowed: tuple[str, ...]) -> Column:
    spans = _matches(text, CANDIDATE, 0)
    strings = F.transform(spans, lambda s: F.struct(s["start"].alias("at"), F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("string")))
    odd = F.filter(strings, lambda x: x["string"].rlike("[0-9]") & x["string"].rlike("[A-Za-z]") & ~_any(x["string"], allowed))
    kind = lambda x: F.when(x.rlike(CLASSES[0][1]), 3).when(x.rlike(CLASSES[1][1]), 4).otherwise(5)
    limit = lambda x: F.when(x.rlike(CLASSES[0][1]), CLASSES[0][2]).when(x.rlike(CLASSES[1][1]), CLASSES[1][2]).otherwise(CLASSES[2][2])
    hits = F.transform(odd, lambda x: F.struct(x["at"].alias("at"), kind(x["string"]).alias("kind"), entropy_hits(F.regexp_extract_all(x["string"], F.lit("."), F.lit(0)), limit(x["string"]), window).alias("hit")))
    return F.transform(F.filter(hits, lambda x: x["hit"]["first"].isNotNull()), lambda x: F.struct((x["at"] + x["hit"]["first"]).alias("start"), x["kind"].alias("kind"), (x["at"] + x["hit"]["last"]).alias("end")))


def _any(text: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(p)
    return out


def secret_spans(docs: DataFrame, window: int = WINDOW, allowed: tuple[str, ...] = ALLOWED, base: str = "secret_base", spans: str = "secret_spans") -> DataFrame:
    """docs with two columns more, of the names given (which docs may not have): arrays of (start, kind, end), sorted;
    positions in code points, end exclusive, kind an index into KINDS. Base patterns stay whatever the allow-list
    says. A null or empty text has no spans; repeated rows have the same. Each text is scanned whole where it is
    read, in time that grows with its length and the number of its matches; nothing is shuffled."""
    if {base.lower(), spans.lower()} & {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has a column {base} or {spans}; give other names")
    text = F.coalesce(F.col("text"), F.lit(""))
    found = F.concat(
        F.when(text.rlike(ASSIGN_WORD), _matches(text, ASSIGN, 0, 2, 12)).otherwise(_none()),
        F.when(text.contains("AKIA"), _matches(text, ACCESS, 1)).otherwise(_none()),
        F.when(text.rlike(HEX), _matches(text, HEX, 2)).otherwise(_none()),
    )
    extra = F.when(text.rlike(CANDIDATE), _entropy_spans(text, window, allowed)).otherwise(_none())
    return docs.withColumn(base, F.array_sort(found)).withColumn(spans, F.array_sort(F.concat(F.col(base), extra)))


def scan(docs: DataFrame, window: int = WINDOW, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """doc_id, counts by base kind, base_sha256 and spans as text (kind:start:end, by start, then kind); one row for
    each row. Other columns are not read."""
    found = secret_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), window, allowed)
    names = F.array(*[F.lit(k) for k in KINDS])
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("secret_base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(line(F.col("secret_base")).cast("binary"), 256).alias("base_sha256"), line(F.col("secret_spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every finding replaced by `mark` (overlapping ones by one) and n_chars, where there is such
    a column, set to the new length of texts that changed. No row goes; columns stay, whatever their names.
    Each row is judged by its own text, so repeated rows and rows without doc_id are treated alike."""
    held, name = fresh(docs, "secret_base"), fresh(docs, "secret_spans")
    found = secret_spans(docs, base=held, spans=name)
    joined = F.aggregate(
        name,
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda out, s: F.when(
            (F.size(out) > 0) & (F.element_at(out, -1)["end"] >= s["start"]),
            F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.struct(F.element_at(out, -1)["start"].alias("start"), F.greatest(F.element_at(out, -1)["end"], s["end"]).alias("end")))),
        ).otherwise(F.concat(out, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))),
    )
    parts = F.transform(
        F.array(joined),
        lambda spans: F.array_join(
            F.transform(
                F.sequence(F.lit(0), F.size(spans)),
                lambda i: F.transform(
                    F.array(F.struct(F.when(i == 0, 0).otherwise(F.get(spans, i - 1)["end"]).alias("a"), F.coalesce(F.get(spans, i)["start"], F.length("text")).alias("b"))),
                    lambda p: F.substring(F.col("text"), p["a"] + 1, p["b"] - p["a"]),
                )[0],
            ),
            mark,
        ),
    )[0]
    some = F.size(name) > 0
    new = {"text": F.when(some, parts).otherwise(F.col("text"))}
    out = found.withColumns(new)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(some, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
