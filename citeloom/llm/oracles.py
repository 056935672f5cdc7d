"""DuckDB statements of the registered queries, for those that SQL can express."""

from __future__ import annotations

from citeloom.llm import chat_format, quality_rules, secret_scans

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

# ---------------------------------------------------------------- op3

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, hex,
        array_to_string(list_transform(range(0, 8), lambda g: array_to_string(list_transform(range(0, 4), lambda k:
          '{_BASE32}'[((CAST('0x' || substring(hex, 5 * g + 1, 5) AS BIGINT) >> (15 - 5 * k)) & 31) + 1]), '')), '') AS payload_digest,
        min(page_id) OVER (PARTITION BY hex) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM d"""

# ---------------------------------------------------------------- op4

NGRAM_JOIN = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_transform({WORDS}, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(ws) - 3, 1) + 1), lambda i: array_to_string(ws[i:i + 3], ' '))) AS sh
  FROM w WHERE len(ws) > 0),
t AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS c
  FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM o WHERE 100 * c >= 85 * (nx + ny - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT x AS doc_id, x AS seen FROM e UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.seen)
SELECT d.doc_id, CAST(coalesce(len(s.sh), 0) AS BIGINT) AS n_shingles, coalesce(c.least, d.doc_id) AS component_id
FROM documents d LEFT JOIN s USING (doc_id) LEFT JOIN (SELECT doc_id, min(seen) AS least FROM r GROUP BY doc_id) c USING (doc_id)"""

# ---------------------------------------------------------------- op5


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def _spans(name: str, rank: int, pattern: str, keep: str) -> str:
    """Spans of one kind: the text before each match, and the match, give its place."""
    return f"""
{name}_m AS (SELECT doc_id, regexp_extract_all(t, '{_quoted(pattern)}') AS ms, regexp_split_to_array(t, '{_quoted(pattern)}') AS gaps FROM texts),
{name}_p AS (SELECT doc_id, unnest(range(1, len(ms) + 1)) AS i, ms, list_transform(ms, lambda m: length(m)) AS lm, list_transform(gaps, lambda g: length(g)) AS lg FROM {name}_m),
{name} AS (SELECT doc_id, {rank} AS rank, ms[i] AS m, CAST(list_sum(lg[1:i]) + coalesce(list_sum(lm[1:i - 1]), 0) AS BIGINT) AS s,
    CAST(list_sum(lg[1:i]) + list_sum(lm[1:i]) AS BIGINT) AS e FROM {name}_p WHERE {keep})"""


def _entropy(name: str, pattern: str, bits: float, keep: str = "true") -> str:
    """Stretches of high entropy: every window of every candidate is counted anew."""
    allowed = _quoted("^(?s:" + "|".join(secret_scans.ALLOWED) + ")$")
    w = secret_scans.WINDOW
    return f"""{_spans(name + "_c", 9, pattern, keep)},
{name}_w AS (SELECT doc_id, s, m, unnest(range(1, length(m) - {w} + 2)) AS k FROM {name}_c WHERE NOT regexp_matches(m, '{allowed}')),
{name}_n AS (SELECT doc_id, s, k, ch, count(*) AS c FROM (SELECT doc_id, s, k, unnest(string_split(substring(m, k, {w}), '')) AS ch FROM {name}_w) GROUP BY ALL),
{name}_h AS (SELECT doc_id, s, k FROM {name}_n GROUP BY doc_id, s, k HAVING log2({w}) - sum(c * log2(c)) / {w} >= {bits} - 1e-9),
{name} AS (SELECT doc_id, 3 AS rank, s + min(k) - 1 AS s, s + max(k) - 1 + {w} AS e FROM {name}_h GROUP BY doc_id, s)"""


_KIND = "CASE rank " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(secret_scans.KINDS)) + " END"
_LISTED = f"string_agg({_KIND} || ':' || s || ':' || e, ',' ORDER BY s, rank, e)"
_BITS = {name: bits for name, _, _, bits in secret_scans.CLASSES}
# RE2 has no look-round: a run of hex digits between other characters is a run of letters and digits that is all hex.
SECRET_SCANS = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{_spans("assign", 0, secret_scans.ASSIGN, "length(regexp_extract(ms[i], '" + _quoted(secret_scans.ASSIGN) + f"', 2)) >= {secret_scans.ASSIGN_LEAST}")},
{_spans("access", 1, secret_scans.ACCESS, "true")},
{_spans("hex", 2, secret_scans.HEX, "true")},
{_entropy("ehex", "[A-Za-z0-9]{20,}", _BITS["hex"], "regexp_full_match(ms[i], '[0-9A-Fa-f]+')")},
{_entropy("ebase", secret_scans.CLASSES[1][1], _BITS["base64"])},
base AS (SELECT doc_id, rank, s, e FROM assign UNION ALL SELECT doc_id, rank, s, e FROM access UNION ALL SELECT doc_id, rank, s, e FROM hex),
added AS (SELECT * FROM ehex UNION SELECT * FROM ebase),
every AS (SELECT * FROM base UNION ALL SELECT * FROM added a WHERE NOT EXISTS (
  SELECT 1 FROM base b WHERE b.doc_id = a.doc_id AND b.s <= a.s AND a.e <= b.e)),
found AS (SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex,
  {_LISTED} FILTER (WHERE rank < 3) AS base, {_LISTED} AS spans FROM every GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN found USING (doc_id)"""

# ---------------------------------------------------------------- op6

_SAID = "</s>[INST] ok [/INST]"


def _escaped(text: str) -> str:
    out = f"replace({text}, '\\', '\\\\')"
    for c in chat_format.CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


CHAT_FORMAT = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_SAID}' UNION ALL SELECT -7, 1, 'assistant', '{_SAID}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_escaped('role')}) + length({_escaped('text')}) + {len(chat_format.OPEN + chat_format.ROLE_END + chat_format.CLOSE)}) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""

# ---------------------------------------------------------------- op7

EMBEDDING_DEDUP = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0
    AND list_sum(list_transform(embedding, lambda y: abs(y))) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
r AS (SELECT x AS vec_id, x AS seen FROM l UNION SELECT r.vec_id, l.y FROM r JOIN l ON l.x = r.seen),
c AS (SELECT vec_id, min(seen) AS least FROM r GROUP BY vec_id),
n AS (SELECT x AS vec_id, count(*) AS n FROM l GROUP BY x)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, coalesce(c.least, e.vec_id) AS component_id, coalesce(c.least, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)"""

# ---------------------------------------------------------------- op10

QUALITY_BASE = f"""
q AS (SELECT doc_id, lang, source, {WORDS} AS ws, coalesce(text, '') AS t,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM q WHERE len(ws) > 8)),
rep AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM
  (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, CAST(sum(least(8, i - coalesce(before, i - 8))) AS BIGINT) AS n FROM rep GROUP BY doc_id),
m AS (SELECT doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '{quality_rules.SYMBOLS}', '')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words FROM q LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    CASE WHEN n_words > 0 THEN word_chars * 100 // n_words END AS word_length, CASE WHEN n_words > 0 THEN n_symbols * 10000 // n_words END AS symbols,
    CASE WHEN n_lines > 0 THEN n_dup_lines * 10000 // n_lines END AS dup_lines, CASE WHEN n_words > 0 THEN n_repeat_words * 10000 // n_words END AS repeats FROM m)"""


def _top(v: str) -> str:
    """The largest value of the sketch bucket of a value."""
    p = f"length(bin({v}))"
    return f"CASE WHEN {v} < 32 THEN {v} ELSE ((({v} >> ({p} - 5)) + 1) << ({p} - 5)) - 1 END"


_METRICS = ("word_length", "symbols", "dup_lines", "repeats")
# (metric, reach, slack, upper, largest bound) as the operator's documentation states them
_FENCES = (("word_length", 11, 100, True, None), ("word_length", 11, 50, False, None), ("symbols", 11, 1000, True, None),
           ("dup_lines", 11, 5000, True, 9000), ("repeats", 11, 2500, True, 9000))


def _outside(level: str, metric: str, reach: int, slack: int, upper: bool, most: int | None) -> str:
    low, high = f"{level}_low_{metric}", f"{level}_high_{metric}"
    far = f"({reach} * greatest({high} - {low}, {high} / 16.0) + {slack})"
    bound = f"{high} + {far}" if upper else f"{low} - {far}"
    return f"coalesce({metric} {'>' if upper else '<'} {bound if most is None else f'least({bound}, {most})'}, false)"


_LEVELS = {"own": "lang, source, metric", "lng": "lang, metric", "every": "metric"}


def _level_sql(level: str, keys: str) -> str:
    ranked = f"row_number() OVER (PARTITION BY {keys} ORDER BY top) AS r, count(*) OVER (PARTITION BY {keys}) AS n"
    groups = ", ".join(k for k in keys.split(", ") if k != "metric")
    picks = ", ".join(f"max(CASE WHEN metric = '{m}' AND r = CAST(ceil(n * CAST({q} AS DOUBLE)) AS BIGINT) THEN top END) AS {level}_{name}_{m}"
                      for m in _METRICS for name, q in (("low", 0.35), ("high", 0.65)))
    head = f"{groups}, " if groups else ""
    return f"""
{level}_r AS (SELECT *, {ranked} FROM v),
{level} AS (SELECT {head}max(n) AS {level}_docs, {picks} FROM {level}_r {f'GROUP BY {groups}' if groups else ''})"""


_VERDICTS = {level: " OR ".join(_outside(level, *f) for f in _FENCES) for level in _LEVELS}
QUALITY_RULES = f"""
WITH {QUALITY_BASE},
v AS (SELECT lang, source, metric, {_top('x')} AS top FROM (
  {" UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, CAST({m} AS BIGINT) AS x FROM b WHERE {m} IS NOT NULL" for m in _METRICS)})),
{", ".join(_level_sql(level, keys) for level, keys in _LEVELS.items())}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT CASE WHEN own_docs >= {quality_rules.MIN_DOCS} THEN {_VERDICTS['own']} WHEN lng_docs >= {quality_rules.MIN_DOCS} THEN {_VERDICTS['lng']}
    ELSE {_VERDICTS['every']} END AS kept
FROM b LEFT JOIN own ON b.lang IS NOT DISTINCT FROM own.lang AND b.source IS NOT DISTINCT FROM own.source
  LEFT JOIN lng ON b.lang IS NOT DISTINCT FROM lng.lang, every"""
