"""The registered queries of this subpackage, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinescribe.llm import audio, chat, licenses, lz, mixing, neardup, packing, quality, secrets, substrings
from kinescribe.llm.common import table


def _documents(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, "documents"))


def _chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = r"\### Assistant: </turn> ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    return chat.read_back(chat.format_conversations(turns.union(extra))).drop("loss_mask")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lz_fingerprints": _documents(lz.fingerprint_edits),
        "op2_near_duplicates": _documents(lambda d: neardup.near_duplicates(d, shingle=4, percent=80)),
        "op3_telephony_audio": _documents(audio.payload_digests),
        "op4_source_mix": _documents(mixing.mix_sources),
        "op5_repeated_passages": _documents(substrings.remove_repeats),
        "op6_secret_scan": _documents(secrets.scan),
        "op7_chat_format": _chat,
        "op8_license_scan": _documents(licenses.license_spans),
        "op9_packing": _documents(packing.pack_documents),
        "op10_quality": lambda spark, sf_dir: quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    }


NEAR_DUPLICATES = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.k >= 80 * (x.k + y.k - p.k)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id WHERE r.c < l.b)
SELECT d.doc_id, coalesce(n.k, 0) AS n_shingles, d.c AS component_id, d.doc_id = d.c AS kept
FROM (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) d LEFT JOIN n USING (doc_id)
"""

REPEATED_PASSAGES = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
v AS (SELECT doc_id, unnest(range(1, greatest(1, len(ws) - 48))) AS i, ws FROM w),
h AS (SELECT doc_id, i, array_to_string(ws[i:i+49], ' ') AS t FROM v),
m AS (SELECT t, min(doc_id) AS low FROM h GROUP BY t HAVING min(doc_id) < max(doc_id)),
c AS (SELECT DISTINCT h.doc_id, unnest(range(h.i, h.i + 50)) AS p FROM h JOIN m USING (t) WHERE m.low < h.doc_id),
x AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
k AS (SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.p) AS kept, count(*) AS n FROM x ANTI JOIN c ON c.doc_id = x.doc_id AND c.p = x.p GROUP BY x.doc_id)
SELECT w.doc_id, len(w.ws) AS n_words, len(w.ws) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""

CHAT = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
r AS (SELECT *, CASE WHEN regexp_matches(text, '\\.', 's') OR contains(text, '</turn>' || chr(10))
  THEN replace(replace(text, '\', '\\'), '</turn>' || chr(10), '<\/turn>' || chr(10)) ELSE text END AS body FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(body) + length(role) + 14)::BIGINT AS formatted_chars
FROM r GROUP BY conv_id
"""

# As shipped: weights 5, 2, 1, limit 3, blocks of 64 words at most, seed 11, 4096 shards, 64 documents a shard at least.
SOURCE_MIX = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5('11' || chr(10) || coalesce(doc_id::VARCHAR, '') || chr(10) || coalesce(text, '')) AS h FROM documents),
g AS (SELECT doc_id, source, size, ('0x' || h[1:15])::BIGINT AS draw, ('0x' || h[18:32])::BIGINT AS turn, count(*)::BIGINT AS m FROM d GROUP BY ALL),
s1 AS (SELECT source, sum(size * m)::BIGINT AS source_size, sum(m)::BIGINT AS n FROM g GROUP BY source),
s2 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM s1),
s3 AS (SELECT *, [5, 2, 1][(place - 1) % 3 + 1] AS weight, source_size * 3 AS cap FROM s2),
s4 AS (SELECT *, row_number() OVER o AS rank, coalesce(sum(cap) OVER p, 0)::DOUBLE AS caps, coalesce(sum(weight) OVER p, 0)::DOUBLE AS heavy, sum(source_size) OVER ()::DOUBLE AS total, sum(weight) OVER ()::DOUBLE AS weights
  FROM s3 WINDOW o AS (ORDER BY cap / weight, place), p AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s5 AS (SELECT *, (total - caps) / (weights - heavy) AS level FROM s4),
s6 AS (SELECT *, coalesce(least(cap, weight * (SELECT arg_min(level, rank) FROM s5 WHERE cap / weight > level)), cap)::DOUBLE AS target FROM s5),
u AS (SELECT sum(n) AS rows, greatest(1, least(64, floor(coalesce(min(target) FILTER (target > 0), 1.0) / 16)))::BIGINT AS block FROM s6),
s AS (SELECT source, place, source_size, target, block, ceil(n / greatest(64.0::DOUBLE, rows / 4096))::BIGINT AS parts, floor(target / block + 0.5::DOUBLE)::BIGINT AS seats, least(floor(target / block + 0.5::DOUBLE)::BIGINT * block, source_size * 3) AS wanted FROM s6, u),
e AS (SELECT g.*, place, source_size, target, block, seats, wanted, draw % parts AS shard FROM g JOIN s ON g.source IS NOT DISTINCT FROM s.source),
p1 AS (SELECT place, shard, sum(size * m)::BIGINT AS words, any_value(block) AS block, any_value(seats) AS seats, any_value(wanted) AS wanted, any_value(source_size) AS source_size FROM e GROUP BY place, shard),
c AS (SELECT place, shard, seats, words / (2 * unnest(range((seats * words / greatest(source_size, 1))::BIGINT + 2)) + 1)::DOUBLE AS q FROM p1 WHERE words > 0),
w AS (SELECT place, shard, count(*) AS won FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY place ORDER BY q DESC, shard) <= seats) GROUP BY ALL),
p2 AS (SELECT p1.*, words * 3 AS top, least(coalesce(won, 0) * block, words * 3) AS got FROM p1 LEFT JOIN w USING (place, shard)),
p3 AS (SELECT *, greatest(0, least(wanted, sum(top) OVER (PARTITION BY place)) - sum(got) OVER (PARTITION BY place)) AS lack,
  coalesce(sum(top - got) OVER (PARTITION BY place ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM p2),
p4 AS (SELECT place, shard, words, block, (got + greatest(0, least(lack - above, top - got)))::BIGINT AS quota FROM p3),
p5 AS (SELECT *, CASE WHEN words > 0 THEN quota // words ELSE 0 END AS turns, quota - CASE WHEN words > 0 THEN quota // words ELSE 0 END * words AS lft, words // block AS k, ('0x' || md5('11' || chr(10) || place || chr(10) || shard)[1:15])::BIGINT AS draw FROM p4),
p6 AS (SELECT place, shard, block, turns, lft, k, lft // block AS pick, CASE WHEN k > 0 THEN draw % k ELSE 0 END AS st FROM p5),
p AS (SELECT *, CASE WHEN k > pick THEN st // (k - pick) ELSE k END AS spare FROM p6),
f AS (SELECT doc_id, size, source_size, target, place, shard, unnest(range(m)) AS nth, size * m AS words, sum(size * m) OVER (PARTITION BY place, shard ORDER BY turn, draw, doc_id)::BIGINT AS stop FROM e),
x AS (SELECT f.doc_id, size, source_size, target, turns, block, k, pick, st, spare, lft, row_number() OVER () AS r, stop - f.words + nth * size AS x FROM f JOIN p USING (place, shard)),
y AS (SELECT *, x + size * side AS y, least((x + size * side) // block, k) AS b FROM x, (SELECT unnest([0, 1]) AS side)),
z AS (SELECT *, CASE WHEN k > 0 THEN (b * pick + st) // k ELSE 0 END AS d0, CASE WHEN k > 0 THEN ((b + 1) * pick + st) // k ELSE 0 END AS d1 FROM y),
v AS (SELECT *, d0 * block + CASE WHEN b < k THEN (y - b * block) * (d1 - d0) ELSE 0 END + least(greatest(y - spare * block, 0), lft - pick * block) AS t FROM z)
SELECT any_value(doc_id) AS doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target, (any_value(turns * size) + sum(CASE side WHEN 1 THEN t ELSE -t END))::BIGINT AS taken FROM v GROUP BY r
"""

# RE2 has neither lookbehind nor back-references: greedy runs need none, and one repeated character can't have both a letter and a digit.
SECRETS = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
k AS (SELECT 0 AS kind, '(?:(?i)password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)' AS p
  UNION ALL SELECT 1, 'AKIA[A-Z0-9]{14,}' UNION ALL SELECT 2, '[0-9a-f]{16,}' UNION ALL SELECT 3, '[A-Za-z0-9+/_=-]{20,}'),
m AS (SELECT doc_id, kind, p, string_split_regex(t, p) AS parts, regexp_extract_all(t, p) AS hits FROM d, k),
u AS (SELECT doc_id, kind, p, unnest(hits) AS hit, unnest(parts[1:len(hits)]) AS part, unnest(range(len(hits))) AS i FROM m),
s AS (SELECT *, sum(length(part) + length(hit)) OVER (PARTITION BY doc_id, kind ORDER BY i)::BIGINT AS stop FROM u),
base AS (SELECT doc_id, kind, stop - length(hit) AS a, stop AS z FROM s WHERE kind IN (1, 2) OR (kind = 0 AND length(regexp_extract(hit, p, 1)) >= 12)),
c AS (SELECT doc_id, hit, stop - length(hit) AS head, CASE WHEN regexp_matches(hit, '^[0-9a-fA-F]+$') THEN 3 WHEN regexp_matches(hit, '^[A-Za-z0-9]+$') THEN 4 ELSE 5 END AS kind
  FROM s WHERE kind = 3 AND regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Za-z]') AND NOT regexp_matches(hit, '(?i)example|sample|dummy|placeholder|changeme')
    AND NOT regexp_matches(hit, '^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$')),
w AS (SELECT doc_id, kind, head, hit, unnest(range(length(hit) - 19)) AS i FROM c),
e AS (SELECT doc_id, kind, head + min(i) AS a, head + max(i) + 20 AS z FROM w
  WHERE list_entropy(string_split(hit[i + 1:i + 20], '')) + 1e-9 >= CASE kind WHEN 3 THEN 2.9 WHEN 4 THEN 3.35 ELSE 3.6 END GROUP BY doc_id, kind, head),
x AS (SELECT *, true AS base FROM base UNION ALL SELECT *, false FROM e),
n AS (SELECT *, ['assign', 'access', 'hex', 'entropy_hex', 'entropy_alnum', 'entropy_base64'][kind + 1] || ':' || a || ':' || z AS line FROM x),
g AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  string_agg(line, ',' ORDER BY a, kind) FILTER (base) AS lines, string_agg(line, ',' ORDER BY a, kind) AS spans FROM n GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(lines, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries it can express whole: the rest are held against brute force in the tests."""
    return {"op4_source_mix": SOURCE_MIX, "op2_near_duplicates": NEAR_DUPLICATES, "op5_repeated_passages": REPEATED_PASSAGES, "op6_secret_scan": SECRETS, "op7_chat_format": CHAT}
