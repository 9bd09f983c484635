"""The queries of the operators, each over whole tables with the parameters of a production run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_repair, exact_dedup, fill_in_middle, language_id, mixing, near_dedup, packing, partial_matching, quality, secret_scan, sharding, substring_dedup, warc
from ._shared import table

#: Bytes of text in a shard of op2.
SHARD_BYTES = 1 << 20


def op1_mixture_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op2_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), limit=SHARD_BYTES)


def op3_poisson_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_golay_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op7_risk_controlled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("broken")


def op8_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_suffix_sort_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))


def op10_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(secret_scan.scan_in_steps(table(spark, sf_dir, "documents")))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversation_repair.damage(table(spark, sf_dir, "conversations"))
    return conversation_repair.repair_report(damaged, copies_col="copies")


def op13_partial_matching_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partial_matching.score(table(spark, sf_dir, "documents"))


OPERATORS = (
    *(op1_mixture_language_id, op2_extendible_shards, op3_poisson_mixture, op4_warc_round_trip, op5_golay_near_dedup, op6_exact_dedup),
    *(op7_risk_controlled_quality, op8_power_of_two_packing, op9_suffix_sort_dedup, op10_secret_ledger, op11_fill_in_middle),
    *(op12_conversation_repair, op13_partial_matching_scores),
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in OPERATORS}

OP2_SQL = f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, strlen(coalesce(text, '')) AS bytes, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '\\N')), 1, 15))::BIGINT AS h FROM documents
), tree AS (
  SELECT doc_id, bytes, h, 0 AS depth, sum(bytes) OVER () AS b, min(h) OVER () AS lo, max(h) OVER () AS hi, count(*) OVER () AS n FROM rows
  UNION ALL
  SELECT doc_id, bytes, h, depth + 1, sum(bytes) OVER w, min(h) OVER w, max(h) OVER w, count(*) OVER w FROM tree WHERE b > {SHARD_BYTES} AND lo < hi
  WINDOW w AS (PARTITION BY depth, h >> (59 - depth))
)
SELECT doc_id, bytes, right(lpad(bin(h >> (60 - depth)), 60, '0'), depth) AS shard, depth, CAST(b AS BIGINT) AS shard_bytes, n AS shard_rows, b <=
{SHARD_BYTES} AS fits
FROM tree WHERE b <= {SHARD_BYTES} OR lo = hi
"""

OP3_SQL = """
WITH per AS (
  SELECT source AS s, sqrt(count(*)) * sum(count(*)) OVER () / (sum(sqrt(count(*))) OVER () * count(*)) AS rate FROM documents GROUP BY source
), terms AS (
  SELECT s, k, rate, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY s ORDER BY k) AS p
  FROM per, range(0, CAST(ceil(rate + 12 * sqrt(rate) + 40) AS BIGINT)) AS t(k)
), drawn AS (
  SELECT d.*, ('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '\\N')), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents d
), counted AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, unnest(range(1, 1 + (SELECT count(*) FROM terms t WHERE t.s IS NOT DISTINCT FROM d.source AND
t.p <= d.u))) AS copy_no FROM drawn d
)
SELECT doc_id, text, lang, source, n_chars, CAST(copy_no AS INTEGER) AS copy_no, ('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '\\N')
|| ':' || copy_no), 1, 15))::BIGINT AS shuffle_key
FROM counted
"""

OP6_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""

BASE32_BITS = " + ".join(f"{16 >> k} * CAST(substr(bits, i * 5 + {k + 1}, 1) AS INT)" for k in range(5))
OP4_SQL = f"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b, CAST(CAST(unhex(sha1(coalesce(html, ''))) AS BIT) AS VARCHAR) AS bits, max(page_id) OVER (PARTITION
BY coalesce(html, '')) AS last FROM pages
)
SELECT page_id, octet_length(b) AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
CAST(1 + {BASE32_BITS} AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM last THEN last END
AS refers_to, true AS ok
FROM p
"""

_GAPS = r"[\x20\x09-\x0D]+"
_VALUES = {"symbols": "n_symbols / greatest(n_words, 1)", "marks": "n_marks / greatest(n_words, 1)", "repeats": "n_repeat_words / greatest(n_words, 1)", "long_words": "word_chars / greatest(n_words, 1)", "dup_lines": "n_dup_lines / greatest(n_lines, 1)"}


def _op7_sql(alpha: float = 0.02, delta: float = 0.05) -> str:
    """The base counts by lists, and the levels by summing binomial terms with lgamma."""
    grid = quality.CUTOFFS
    firsts = ", ".join(f"CASE WHEN {_VALUES[name]} > {cuts[0]} THEN {len(grid)} * ({len(cuts)} - len(list_filter({list(cuts)}, lambda c: c < {_VALUES[name]}))) + {i + 1} END" for i, (name, cuts) in enumerate(grid.items()))
    n_levels = sum(map(len, grid.values()))
    return f"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '{_GAPS}'), lambda x: x <> '') AS w, list_filter(string_split(text, chr(10)), lambda x:
regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
u AS (SELECT r, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM w WHERE len(w) >= 3),
g AS (SELECT r, i, a, lead(a, 1) OVER q AS b, lead(a, 2) OVER q AS c FROM u WINDOW q AS (PARTITION BY r ORDER BY i)),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS c FROM g WHERE c IS NOT NULL),
p AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM h WHERE c > 1) GROUP BY r),
f AS (
  SELECT doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '',
'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, length(text) - length(replace(text, '!', '')) AS n_marks, len(lines) AS n_lines, len(w) < 50 OR 100
* coalesce(n_repeat_words, 0) > 50 * len(w) AS base_failed
  FROM w LEFT JOIN p USING (r)
),
s AS (SELECT *, least({firsts}) AS first FROM f),
held AS (SELECT lang, first FROM s WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1)),
cells AS (SELECT lang, l, count(*) AS n, count(*) FILTER (first <= l) AS k FROM held, range(1, {n_levels + 1}) AS x(l) GROUP BY lang, l),
m AS (SELECT count(DISTINCT coalesce(lang, '~')) AS m FROM held),
sure AS (SELECT lang, max(l) AS l FROM cells, m WHERE k < n * {alpha!r} AND (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i *
ln({alpha!r}) + (n - i) * ln(1 - {alpha!r}))) FROM range(0, k + 1) AS x(i)) <= {delta!r} / m GROUP BY lang)
SELECT doc_id, n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND
coalesce(first > sure.l, true) AS kept FROM s LEFT JOIN sure ON s.lang IS NOT DISTINCT FROM sure.lang
"""


OP7_SQL = _op7_sql()

OP9_SQL = """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h FROM documents),
q AS (SELECT r, k, substr(h, 1 + 1000 * k, 1398) AS g, length(h) // 2 - 500 * k AS n FROM (SELECT r, h, unnest(range(0, length(h) // 1000 + 1)) AS k FROM d)),
s AS (SELECT r, 500 * k + unnest(range(0, least(500, n - 199))) AS p, unnest(list_transform(range(0, least(500, n - 199)), lambda o:
md5_number(substr(g, 2 * o + 1, 400)))) AS x FROM q WHERE n >= 200),
t AS (SELECT x FROM s GROUP BY x HAVING count(*) > 1),
c AS (SELECT r, p FROM s WHERE x IN (SELECT x FROM t)),
b AS (SELECT r, 500 * k + unnest(range(0, least(500, n))) AS p, unnest(list_transform(range(0, least(500, n)), lambda o: substr(g, 2 * o + 1, 2))) AS x FROM q),
m AS (SELECT b.r, b.p, x, max(c.p) OVER (PARTITION BY b.r ORDER BY b.p) AS last FROM b LEFT JOIN c ON c.r = b.r AND c.p = b.p),
g AS (SELECT r, p, x, coalesce(last > p - 200, false) AS gone, lag(coalesce(last > p - 200, false), 1, false) OVER (PARTITION BY r ORDER BY p) AS
before FROM m),
k AS (SELECT r, count(*) AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (gone AND NOT before) AS n_spans,
sha256(unhex(coalesce(string_agg(x, '' ORDER BY p) FILTER (NOT gone), ''))) AS kept_sha256 FROM g GROUP BY r)
SELECT doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(kept_sha256,
sha256('')) AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""

OP10_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
rules(kind, rank, pattern, part, least) AS (VALUES
  ('assign', 0,
'([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2,
12),
  ('access', 1, '(AKIA[A-Z0-9]+)', 1, 18),
  ('hex', 2, '([0-9a-f]+)', 1, 16),
  ('key', 3, '(-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----)', 1, 1),
  ('web', 4, '(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})', 1, 1)
),
"cut" AS (  -- two noncharacters mark where a match begins and ends
  SELECT r, kind, rank, pattern, part, least, string_split(regexp_replace(t, pattern, chr(1114110) || '\0' || chr(1114111), 'g'), chr(1114110)) AS
pieces FROM d, rules
),
piece AS (SELECT * EXCLUDE (pieces), unnest(pieces) AS x, generate_subscripts(pieces, 1) AS i FROM "cut"),
placed AS (
  SELECT r, kind, rank, pattern, part, least, i, split_part(x, chr(1114111), 1) AS found,
    sum(length(replace(x, chr(1114111), ''))) OVER (PARTITION BY r, rank ORDER BY i) - length(replace(x, chr(1114111), '')) AS start
  FROM piece
),
spans AS (
  SELECT r, kind, rank, start, kind || ':' || start || ':' || (start + length(found)) AS span FROM placed
  WHERE i > 1 AND CASE WHEN kind = 'assign' THEN length(regexp_extract(found, '["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) ELSE
length(found) END >= least
),
g AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(span, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans
  FROM spans GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS
base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (r)
"""

OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '\\N')) AS x FROM
documents),
h AS (
  SELECT *, ('0x' || substr(x, 1, 8))::BIGINT % (n + 1) AS a, ('0x' || substr(x, 9, 8))::BIGINT % (n + 1) AS b,
    ('0x' || substr(x, 17, 8))::BIGINT % 100 AS p, ('0x' || substr(x, 25, 8))::BIGINT % 100 AS q FROM d
),
f AS (
  SELECT *, least(a, b) AS i, greatest(a, b) AS j,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR p >= 90 THEN 'plain' WHEN q < 20 THEN 'spm' ELSE 'psm' END AS
form FROM h
),
o AS (
  SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substr(t, 1, i) || '<S>' || substr(t, j + 1) || '<M>' || substr(t, i + 1, j - i)
    ELSE '<S>' || substr(t, j + 1) || '<P>' || substr(t, 1, i) || '<M>' || substr(t, i + 1, j - i) END AS output FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN i END AS prefix_chars, CASE WHEN form <> 'plain' THEN j - i END AS middle_chars,
  sha256(output) AS output_sha256, sha256(t) AS restored_sha256 FROM o
"""

#: CRC-32 bit by bit over the characters of k: an entry below 0 is one of the eight shifts after each byte.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(k) + 1), lambda i: [ascii(substr(k, CAST(i AS BIGINT), 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) ELSE xor(acc >> 1, 3988292384 * (acc & 1)) END))"""


def _op12_sql() -> str:
    """Costs, edits and repaired rows of the rest of a conversation, row by row from its end, for each of four states."""

    def move(edit: str, cost: str, state: str, row: str = "") -> str:
        rows = f"list_prepend({row}, {state}.t)" if row else f"{state}.t"
        return f"{{'c': {state}.c + {cost}, 'a': '{edit}' || {state}.a, 't': {rows}}}"

    never = "{'c': 1000000000::BIGINT, 'a': '', 't': []::VARCHAR[]}"
    named = {"u": "'user:' || text", "d": "'assistant:' || text"}

    def base(state: str, leads: str, kept: dict[str, str]) -> str:
        keeps = " ".join(f"WHEN x = '{x}' THEN {move('K', 'more', to, "role || ':' || text")}" for x, to in kept.items())
        keep, rerole = f"CASE WHEN gone THEN {never} {keeps} ELSE {never} END", f"CASE WHEN gone THEN {never} ELSE {move('R', '3 + more', leads, named[leads])} END"
        return f"list_min([{move('D', '4', state)}, {rerole}, {keep}])"

    def insert(state: str) -> str:
        return move("I", "3", state, "'user:'" if state == "u" else "'assistant:'")

    return f"""
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') ||
':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
hashed AS (SELECT *, {_CRC} % 20 AS h FROM keyed),
rows AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g')
ELSE text END AS text,
    unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM hashed
),
placed AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER
(PARTITION BY conv_id) AS n FROM rows),
faults AS (
  SELECT *, left(role, 1) AS x, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id,
role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault, lag(left(role, 1)) OVER (PARTITION BY conv_id
ORDER BY i) AS before
  FROM placed
),
sums AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER
(fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND before || x NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP
BY conv_id
),
dp AS (
  SELECT DISTINCT conv_id, n + 1 AS i, {{'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]}} AS b, {{'c': 6::BIGINT, 'a': 'II', 't': ['user:', 'assistant:']}} AS s,
    {{'c': 3::BIGINT, 'a': 'I', 't': ['assistant:']}} AS u, {{'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]}} AS d FROM placed
  UNION ALL
  SELECT conv_id, i, list_min([b, {insert('u')}]), list_min([s, {insert('u')}]), u, d FROM (
    SELECT conv_id, i, b, s, list_min([u, {insert('d')}]) AS u, list_min([d, {insert('u')}]) AS d FROM (
      SELECT dp.conv_id, f.i, {base('b', 'u', {'s': 's', 'u': 'u'})} AS b, {base('s', 'u', {'u': 'u'})} AS s, {base('u', 'd', {'a': 'd'})} AS u,
{base('d', 'u', {'u': 'u'})} AS d
      FROM dp JOIN (SELECT *, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS more FROM faults) f ON
dp.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = dp.i - 1
    )
  )
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
coalesce(illegal, 0) AS illegal,
  coalesce(dp.b.c, 0) AS cost, coalesce(dp.b.a, '') AS audit, sha256(coalesce(array_to_string(dp.b.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN sums ON c.conv_id IS NOT DISTINCT FROM sums.conv_id LEFT JOIN dp ON c.conv_id IS NOT
DISTINCT FROM dp.conv_id AND dp.i = 1
"""


OP12_SQL = _op12_sql()

ORACLE: dict[str, str] = {"op12_conversation_repair": OP12_SQL, "op11_fill_in_middle": OP11_SQL, "op2_extendible_shards": OP2_SQL, "op3_poisson_mixture": OP3_SQL, "op4_warc_round_trip": OP4_SQL, "op6_exact_dedup": OP6_SQL, "op7_risk_controlled_quality": OP7_SQL, "op9_suffix_sort_dedup": OP9_SQL, "op10_secret_ledger": OP10_SQL}
