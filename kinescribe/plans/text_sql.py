"""SQL (DuckDB) for the text functions, as chains of common table expressions over a table with a text column.

Written from what the functions promise, in other ways than they are written: word counts by histograms, cuts by
trying every place, wrapping word by word in a recursion.
"""

from __future__ import annotations

from kinescribe.functions import rules
from kinescribe.functions.base import SPACES

S = "[" + SPACES.replace("\t", r"\t").replace("\n", r"\n").replace("\x0b", r"\v").replace("\x0c", r"\f").replace("\r", r"\r") + "]"
BREAKS = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(map(quoted, values)) + "]"


def any_of(test: str, text: str, values) -> str:
    """Whether test(text, value) holds for one of the values."""
    return f"len(list_filter({listed(values)}, lambda p: {test}({text}, p))) > 0"


def trim(x: str, chars: str = SPACES) -> str:
    return f"trim({x}, {quoted(chars)})"


def norm(x: str) -> str:
    return f"trim(regexp_replace(replace(lower({x}), '|', 'i'), '[^a-z0-9]+', ' ', 'g'))"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, {quoted(S + '+')}, ' ', 'g'))"


def starts(text: str, *values: str) -> str:
    return f"({any_of('starts_with', text, values)})"


def holds(text: str, *values: str) -> str:
    return f"({any_of('contains', text, values)})"


def _pattern(values) -> str:
    return quoted("(?i)^(?:" + "|".join(values) + ")")


def loop(n: str) -> str:
    w = f"string_split({n}, ' ')"
    most = f"list_max(map_values(list_aggregate(list_transform(range(1, len({w}) - k + 2), lambda i: array_to_string({w}[i:i + k - 1], ' ')), 'histogram')))"
    return f"(len({w}) >= 10 AND len(list_filter([2, 3, 4, 5], lambda k: {most} * k >= greatest(4 * k, len({w}) * 0.55::DOUBLE))) > 0)"


def stock(n: str) -> str:
    w = f"string_split({n}, ' ')"
    return (
        f"({starts(n, *rules.STOCK_PREFIXES)} OR contains({n}, 'translates to') OR len(string_split({n}, 'who had been')) > 4"
        f" OR (len({w}) >= 6 AND len(list_filter({w}, lambda x: NOT list_contains({listed(rules.SIZE_TOKENS)}, x))) = 0) OR {loop(n)} OR regexp_matches(replace({n}, ' ', ''), '^[0-9]{{20,}}$'))"
    )


def scene(n: str) -> str:
    return f"({starts(n, *rules.SCENE_PREFIXES)} OR (starts_with({n}, 'die bombenangriffe') AND contains({n}, 'katastrophalen zerst')) OR contains({n}, 'soft glow illuminating the scene'))"


def noise(t: str, n: str) -> str:
    """The first rule by which a text t with the norm n is noise, or null."""
    rules_ = (
        ("exact", f"list_contains({listed(rules.NOISE_TEXTS)}, {n})"),
        ("subtitle_number", f"regexp_matches({n}, '^subtitle [0-9 ]*[0-9][0-9 ]*$')"),
        ("request", starts(n, "please do not ", "please provide the image", "please provide a clearer image", "i need to read ")),
        ("note", f"starts_with({n}, 'please note ') AND ({holds(n, *rules.NOTE_ABSENCE_MARKERS)} OR {holds(n, *rules.NOTE_TEST_MARKERS)})"),
        ("test", starts(n, "this is a test", "the quick brown fox", "the text is not clearly legible")),
        ("digits", f"regexp_matches({t}, '\\p{{Nd}}{{25}}')"),
        ("other_text", holds(n, "no other text visible in the image")),
        ("russian", f"{starts(n, 'the text appears to be in russian and contains names', 'the text appears to be in a language that uses a non latin script')} OR (starts_with({n}, 'the text appears to be in russian') AND contains({n}, 'without additional context'))"),
        ("birthday", f"contains({n}, 'happy birthday') AND {holds(n, *rules.BIRTHDAY_MARKERS)}"),
        ("demonstration", holds(n, "for demonstration purposes only", "test image", "placeholder")),
        ("status", starts(n, *rules.STATUS_PREFIXES)),
        ("language_menu", f"starts_with({n}, 'subtitles ') AND len(list_filter({listed(rules.LANGUAGES)}, lambda x: list_contains(string_split({n}, ' '), x))) >= 4"),
        ("image_talk", f"{starts(n, *rules.IMAGE_PREFIXES)} OR {holds(n, *rules.IMAGE_MARKERS)}"),
        ("stock_text", stock(n)),
        ("scene_talk", scene(n)),
    )
    whens = " ".join(f"WHEN {test} THEN '{name}'" for name, test in rules_)
    return f"CASE WHEN {n} = '' AND NOT regexp_matches({t}, '[\\p{{L}}\\p{{N}}]') THEN 'no_letters' WHEN {n} = '' THEN NULL {whens} END"


def suspicious(t: str, n: str) -> str:
    return (
        f"({n} = '' OR ({noise(t, n)}) IS NOT NULL OR {stock(n)} OR {starts(n, *rules.SINGLE_PREFIXES)} OR (contains({n}, 'shown in close up') AND contains({n}, 'background is blurred'))"
        f" OR {scene(n)} OR list_contains({listed(rules.SINGLE_TEXTS)}, {n}))"
    )


def leak(low: str) -> str:
    count = f"len(list_filter({listed(rules.PROMPT_MARKERS)}, lambda p: contains({low}, p)))"
    return f"(starts_with({low}, 'this is a request to read only the subtitle text') OR {count} >= 2 OR ({count} = 1 AND length({low}) <= 80))"


def empty(t: str) -> str:
    plain = trim(trim(f"regexp_replace(lower({trim(t)}), '[ \t]+', ' ', 'g')"), ".")
    return f"(list_contains({listed(rules.EMPTY_ANSWERS)}, {plain}) OR (length({plain}) < 90 AND {holds(plain, *rules.EMPTY_PHRASES)}))"


def cleaned(source: str, column: str, out: str, p: str = "k") -> str:
    """CTEs p1 to p7: p7 has the columns of source and `out`, its cleaned column."""
    dash = f"regexp_replace(x, {quoted('^' + S + '*[-–—]' + S + '*')}, '- ')"
    parts = f"list_filter(list_transform(string_split_regex({trim('d[3:]')}, {quoted(S + '+[-–—]' + S + '*')}), lambda y: {trim('y')}), lambda y: y <> '')"
    prefix = _pattern(rules.ANSWER_PREFIXES)
    found = f"list_filter(list_transform({listed(rules.ABSENCE_SUFFIXES)}, lambda m: strpos(lower(t), m)), lambda i: i > 1)[1]"
    whole = trim(trim(trim(trim("array_to_string(flatten(ds), chr(10))"), '"'), "'"))
    rest = trim(trim(trim(trim(f"regexp_replace(t, {prefix}, '')"), '"'), "'"))
    cut = trim(trim(trim(trim(f"t[:{found} - 1]"), "."), "-"))
    return f"""{p}1 AS (SELECT *, regexp_replace(replace(replace(regexp_replace(coalesce({column}, ''), '(?im)^```(?:text)?|```$', '', 'g'), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g') AS t FROM {source}),
 {p}2 AS (SELECT * EXCLUDE t, list_transform(list_filter(list_transform(string_split(t, chr(10)), lambda x: {trim("regexp_replace(x, '[ \t]+', ' ', 'g')")}), lambda x: x <> ''), lambda x: {dash}) AS ls FROM {p}1),
 {p}3 AS (SELECT * EXCLUDE ls, list_transform(ls, lambda d: CASE WHEN starts_with(d, '- ') AND len({parts}) > 1 THEN list_transform({parts}, lambda y: '- ' || y) ELSE [d] END) AS ds FROM {p}2),
 {p}4 AS (SELECT * EXCLUDE ds, {whole} AS t FROM {p}3),
 {p}5 AS (SELECT * EXCLUDE t, CASE WHEN regexp_matches(t, {prefix}) THEN {rest} ELSE t END AS t FROM {p}4),
 {p}6 AS (SELECT * EXCLUDE t, {trim(trim(f"CASE WHEN {holds('lower(t)', *rules.ABSENCE_SUFFIXES)} THEN coalesce({cut}, t) ELSE t END", "*"))} AS t FROM {p}5),
 {p}7 AS (SELECT * EXCLUDE (t, n), CASE WHEN t = '' OR {leak('lower(t)')} OR {empty('t')} OR ({noise('t', 'n')}) IS NOT NULL THEN '' ELSE t END AS {out} FROM (SELECT *, {norm('t')} AS n FROM {p}6))"""


def sentences(x: str) -> str:
    """The sentences of x, before they are trimmed; white space at a boundary stands before the later one."""
    marked = f"regexp_replace({x}, {quoted('([.!?])(' + S + '+)([A-Z0-9' + chr(34) + chr(39) + '-])')}, '\\1' || chr(1) || '\\2\\3', 'g')"
    return f"string_split({marked}, chr(1))"


def split_index(t: str) -> str:
    """The best space of all."""
    over = lambda k: f"greatest(0, {k} - 42)"
    return f"list_sort(list_transform(list_filter(range(0, length({t})), lambda i: {t}[i + 1] = ' '), lambda i: {{'o': {over('i')} + {over(f'(length({t}) - i - 1)')}, 'f': abs(i - length({t}) / 2), 'i': i}}))[1].i"


def halves(t: str, at: str) -> str:
    return f"[{trim(f'{t}[:{at}]')}, {trim(f'{t}[{at} + 2:]')}]"


def sentence_cut(t: str) -> str:
    """The place of the boundary nearest the middle; null if none."""
    p = sentences(t)
    return f"list_sort(list_transform(list_transform(range(1, len({p})), lambda k: length(array_to_string({p}[1:k], ''))), lambda b: {{'f': abs(b - length({t}) / 2), 'b': b}}))[1].b"


def text_lines(t: str) -> str:
    return f"list_filter(list_transform(string_split_regex({trim(t)}, {quoted(BREAKS)}), lambda x: {squeeze('x')}), lambda x: x <> '')"


def wrapped(source: str, key: str, column: str, p: str = "wr") -> str:
    """CTEs p0 to p2 (WITH RECURSIVE): p2 has key and `lines`, the texts of the list `column` wrapped one after another."""
    add = "CASE WHEN line = '' THEN done ELSE list_append(done, line) END"
    chunks = "list_transform(range(0, (length(w) - 1) // 42 + 1), lambda j: w[j * 42 + 1:j * 42 + 42])"
    keys = ", ".join(f"s.{k.strip()}" for k in key.split(","))
    on = " AND ".join(f"s.{k.strip()} IS NOT DISTINCT FROM x.{k.strip()}" for k in key.split(","))
    # a null word ends a text
    words = f"flatten(list_transform({column}, lambda x: list_append(list_filter(string_split({squeeze('x')}, ' '), lambda w: w <> ''), NULL)))"
    return f"""{p}w AS (SELECT {key}, unnest({words}) AS w, unnest(range(len({words}))) AS k FROM {source}),
 {p}0 AS (SELECT {key}, 0::BIGINT AS k, []::VARCHAR[] AS done, '' AS line FROM {source} UNION ALL
  SELECT {keys}, s.k + 1, CASE WHEN w IS NULL THEN {add} WHEN length(w) > 42 THEN list_concat({add}, ({chunks})[:-2]) WHEN line = '' OR length(line) + 1 + length(w) <= 42 THEN done ELSE {add} END,
   CASE WHEN w IS NULL THEN '' WHEN length(w) > 42 THEN ({chunks})[-1] WHEN line <> '' AND length(line) + 1 + length(w) <= 42 THEN line || ' ' || w ELSE w END FROM {p}0 s JOIN {p}w x ON {on} AND x.k = s.k),
 {p}2 AS (SELECT {key}, arg_max(done, k) AS lines FROM {p}0 GROUP BY ALL)"""


def laid(source: str, column: str, p: str = "la") -> str:
    """CTEs p1 to p4: p4 has the columns of source, `fixed` (the layout where nothing need be wrapped) and `towrap` (the texts to
    wrap where something must be)."""
    fit = lambda x: f"list_max(list_transform({x}, lambda y: length(y))) <= 42"
    pair = "[array_to_string(ss[:i], ' '), array_to_string(ss[i + 1:], ' ')]"
    return f"""{p}1 AS (SELECT *, {text_lines(column)} AS ls, array_to_string({text_lines(column)}, ' ') AS j FROM {source}),
 {p}2 AS (SELECT *, list_filter(list_transform({sentences('j')}, lambda x: {trim('x')}), lambda x: x <> '') AS ss, {split_index('j')} AS cut FROM {p}1),
 {p}3 AS (SELECT *, CASE WHEN len(ss) = 2 THEN ss WHEN len(ss) > 2 AND length(j) <= 85 THEN
   list_sort(list_transform(list_filter(range(1, len(ss)), lambda i: {fit(pair)}), lambda i: {{'o': abs(length({pair}[1]) - length({pair}[2])), 'i': i, 'p': {pair}}}))[1].p END AS sp,
   CASE WHEN length(j) <= 42 OR cut IS NULL THEN [j] ELSE list_filter({halves('j', 'cut')}, lambda x: x <> '') END AS two FROM {p}2),
 {p}4 AS (SELECT * EXCLUDE (ls, j, ss, cut, sp, two), CASE WHEN len(ls) = 0 THEN [] WHEN sp IS NOT NULL AND {fit('sp')} THEN sp WHEN len(ls) <= 2 AND {fit('ls')} THEN ls
   WHEN len(ls) = 2 AND (starts_with(ls[1], '-') OR starts_with(ls[2], '-')) THEN NULL WHEN {fit('two')} THEN two END AS fixed,
   CASE WHEN len(ls) = 2 AND (starts_with(ls[1], '-') OR starts_with(ls[2], '-')) THEN ls ELSE two END AS towrap FROM {p}3)"""
