"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from aspectspark.llm.quality import RULES, STOP_WORDS

#: Fixed: white space, word and stop-word forms, stated apart from the Spark code.
WORD = r"[^\x20\x09-\x0D]+"
STOP = ", ".join(f"'{w}'" for w in sorted({w for ws in STOP_WORDS.values() for w in ws}))


def _broken() -> str:
    """The threshold table as SQL."""
    parts = []
    for r in RULES:
        sides = [f"{r.metric} < {r.low}"] * (r.low is not None) + [f"{r.metric} > {r.high}"] * (r.high is not None)
        parts.append(f"((({' OR '.join(sides)})) AND n_words >= {r.min_words})")
    return " OR ".join(parts)


def quality_ctes(docs: str) -> str:
    """CTEs that judge the rows of ``docs`` (rid, doc_id, text); the last is
    ``judged``."""
    return rf"""
q_words AS (
  SELECT rid, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM {docs}),
q_exploded AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM q_words),
q_windows AS (
  SELECT rid, i, word || ' ' || lead(word, 1) OVER d || ' ' || lead(word, 2) OVER d || ' ' ||
         lead(word, 3) OVER d || ' ' || lead(word, 4) OVER d AS five
  FROM q_exploded WINDOW d AS (PARTITION BY rid ORDER BY i)),
q_twice AS (SELECT rid, i, (five IS NOT NULL AND count(*) OVER (PARTITION BY rid, five) > 1) AS twice FROM q_windows),
q_covered AS (
  SELECT rid, i, bool_or(twice) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c
  FROM q_twice),
q_repeats AS (SELECT rid, count(*) FILTER (c) AS n FROM q_covered GROUP BY rid),
q_lines AS (
  SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM q_words),
q_counts AS (
  SELECT q_words.rid, doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper,
    length(text) - length(replace(text, '!', '')) AS n_exclamations,
    len(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[\x20\x09-\x0D.,;:!?]', ' ', 'g'), ' +'),
        lambda x: x IN ({STOP}))) AS n_stop_words,
    len(lines) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) AS n_ellipsis_lines,
    CAST(coalesce(q_repeats.n, 0) AS BIGINT) AS n_repeat_words
  FROM q_words JOIN q_lines ON q_lines.rid = q_words.rid LEFT JOIN q_repeats ON q_repeats.rid = q_words.rid),
q_rates AS (
  SELECT *, word_chars / greatest(n_words, 1) AS mean_word_length, n_symbols / greatest(n_words, 1) AS symbol_ratio,
    n_exclamations / greatest(n_words, 1) AS exclamation_ratio, n_upper / greatest(word_chars, 1) AS upper_ratio,
    n_stop_words / greatest(n_words, 1) AS stop_word_ratio, n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio,
    n_ellipsis_lines / greatest(n_lines, 1) AS ellipsis_line_ratio,
    (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed
  FROM q_counts),
judged AS (SELECT *, (NOT base_failed AND NOT ({_broken()})) AS kept FROM q_rates)"""


QUALITY = f"""
WITH rows_in AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
{quality_ctes('rows_in')}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged
"""

URL_FILTER = r"""
WITH parts AS (
  SELECT page_id, html,
    CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    array_to_string(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)')), '&') AS query FROM parts),
canonical AS (
  SELECT page_id, host, path,
    length(html) - length(regexp_replace(html, '[%$#*&|]', '', 'g')) AS symbols, length(html) AS size,
    CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') ||
      regexp_replace(path, '/+$', '') || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS canonical
  FROM split),
listed AS (SELECT DISTINCT canonical FROM canonical WHERE symbols * 50 > size AND canonical IS NOT NULL),
ruled AS (
  SELECT page_id, host, path, listed.canonical IS NOT NULL AS listed,
    CASE WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM canonical LEFT JOIN listed ON listed.canonical = canonical.canonical)
SELECT page_id, host, path, rule,
  CASE rule WHEN 'net/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'example.com/de/' THEN 'block'
    WHEN 'org/fr/' THEN 'allow' ELSE CASE WHEN listed THEN 'block' ELSE 'allow' END END AS verdict, listed
FROM ruled
"""



def line_ctes(docs: str) -> str:
    """CTEs that drop recurring lines of ``docs`` (rid, doc_id, text); the
    last is ``deduped`` (rid, doc_id, n_lines, n_dropped, kept)."""
    return rf"""
l_split AS (SELECT rid, doc_id, text, string_split(text, chr(10)) AS lines FROM {docs}),
l_raw AS (SELECT rid, doc_id, unnest(lines) AS raw, generate_subscripts(lines, 1) - 1 AS line FROM l_split),
l_flat AS (
  SELECT rid, doc_id, line, trim(regexp_replace(raw, '[\x20\x09\x0B-\x0D]+', ' ', 'g'), ' ') AS flat FROM l_raw),
l_tokens AS (
  SELECT rid, doc_id, line, list_transform(string_split(flat, ' '),
    lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS tokens FROM l_flat WHERE flat <> ''),
l_kinds AS (
  SELECT tokens, md5(array_to_string(tokens, ' ')) AS own, len(tokens) AS size,
    array_to_string(tokens[1:3], ' ') AS lead, count(*) AS n FROM l_tokens GROUP BY ALL),
l_rounds AS (
  SELECT tokens, own, size, lead, n, CAST(NULL AS VARCHAR) AS template, FALSE AS same FROM l_kinds
  UNION ALL
  SELECT tokens, own, size, lead, n, leader_own, list_sum(list_transform(list_zip(tokens, leader),
    lambda p: CASE WHEN p[1] = p[2] THEN 1 ELSE 0 END)) >= 0.8 * size
  FROM (SELECT tokens, own, size, lead, n, first_value(tokens) OVER leaf AS leader, first_value(own) OVER leaf AS leader_own
        FROM l_rounds WHERE NOT same WINDOW leaf AS (PARTITION BY size, lead ORDER BY n DESC, own))),
l_templates AS (SELECT own, template FROM l_rounds WHERE same),
l_joined AS (
  SELECT rid, doc_id, line, len(tokens) AS size, template FROM l_tokens
  JOIN l_templates ON l_templates.own = md5(array_to_string(tokens, ' '))),
l_recurring AS (
  SELECT template, first(rid ORDER BY doc_id, line) AS first_rid, first(line ORDER BY doc_id, line) AS first_line
  FROM l_joined GROUP BY template, size
  HAVING count(DISTINCT rid) >= CASE WHEN size >= 8 THEN 2 ELSE 3 END),
l_drops AS (
  SELECT rid, list(line) AS dropped FROM l_joined JOIN l_recurring ON l_recurring.template = l_joined.template
  WHERE NOT (rid = first_rid AND line = first_line) GROUP BY rid),
deduped AS (
  SELECT l_split.rid, doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines,
    CAST(coalesce(len(dropped), 0) AS BIGINT) AS n_dropped,
    CASE WHEN dropped IS NULL THEN text ELSE array_to_string(
      list_filter(lines, lambda x, i: NOT list_contains(dropped, i - 1)), chr(10)) END AS kept
  FROM l_split LEFT JOIN l_drops ON l_drops.rid = l_split.rid)"""


LINE_DEDUP = f"""
WITH RECURSIVE rows_in AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
{line_ctes('rows_in')}
SELECT doc_id, n_lines, n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM deduped
"""

SHARDING = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)
    ORDER BY b) AS t FROM range(256) r(b)),
keyed AS (
  SELECT doc_id, md5(coalesce(text, '')) AS digest, CAST(octet_length(encode(coalesce(text, ''))) + 8 AS BIGINT) AS size,
    xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS text_crc32
  FROM documents, crc_table),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, digest) - 1 AS copy FROM keyed),
slotted AS (
  SELECT *, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || digest || ':' || copy), 1, 12) AS BIGINT)
    % 4096 AS INTEGER) AS virtual_slot FROM numbered),
slots AS (
  SELECT virtual_slot, sum(size) AS bytes, count(*) AS n,
    row_number() OVER (ORDER BY sum(size) DESC, virtual_slot) AS turn FROM slotted GROUP BY virtual_slot),
dealt AS (
  SELECT CAST(0 AS BIGINT) AS turn, NULL::INTEGER AS virtual_slot, NULL::INTEGER AS shard,
    list_transform(range(24), lambda i: CAST(0 AS HUGEINT)) AS loads
  UNION ALL
  SELECT s.turn, s.virtual_slot, CAST(list_position(loads, list_min(loads)) - 1 AS INTEGER),
    list_transform(loads, lambda x, i: CASE WHEN i = list_position(loads, list_min(loads)) THEN x + s.bytes ELSE x END)
  FROM dealt d JOIN slots s ON s.turn = d.turn + 1),
starts AS (
  SELECT d.virtual_slot, shard, sum(n) OVER (PARTITION BY shard ORDER BY d.virtual_slot) - n AS start
  FROM dealt d JOIN slots s ON s.virtual_slot = d.virtual_slot)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  CAST(start + row_number() OVER (PARTITION BY s.virtual_slot ORDER BY doc_id NULLS LAST, digest, copy) - 1 AS BIGINT) AS slot,
  CAST(NULL AS INTEGER) AS grown_shard, s.virtual_slot, 1 AS version
FROM slotted s JOIN starts ON starts.virtual_slot = s.virtual_slot
"""

HARD_NEGATIVES = """
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    CAST(coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM vectors a JOIN vectors b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT same
  AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""

COLLOCATIONS = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
found AS (
  SELECT lang, 1 AS m, unnest(w) AS phrase FROM worded
  UNION ALL
  SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM worded
  UNION ALL
  SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM worded),
counted AS (SELECT lang, m, phrase, CAST(count(*) AS HUGEINT) AS f FROM found GROUP BY lang, m, phrase),
frequent AS (SELECT *, string_split(phrase, ' ') AS p FROM counted WHERE f >= 10),
cuts AS (
  SELECT lang, phrase, f, 1 AS k, p[1] AS head, array_to_string(p[2:], ' ') AS rest FROM frequent WHERE m >= 2
  UNION ALL
  SELECT lang, phrase, f, 2, array_to_string(p[1:2], ' '), p[3] FROM frequent WHERE m = 3),
best AS (
  SELECT c.lang, c.phrase, c.f AS a, k, l.f AS l, r.f AS r, (1000000 * c.f * c.f) // (l.f * r.f) AS score
  FROM cuts c JOIN frequent l ON l.lang = c.lang AND l.phrase = head JOIN frequent r ON r.lang = c.lang AND r.phrase = rest
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, part, max(f) AS longer FROM (
    SELECT lang, unnest([array_to_string(p[1:2], ' '), array_to_string(p[2:3], ' ')]) AS part, f FROM frequent WHERE m = 3)
  GROUP BY lang, part),
kept AS (
  SELECT best.* FROM best LEFT JOIN inside ON inside.lang = best.lang AND part = phrase
  WHERE longer IS NULL OR 100 * longer < 50 * a),
totals AS (SELECT lang, sum(f) AS n FROM counted WHERE m = 1 GROUP BY lang)
SELECT kept.lang, CAST(row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS INTEGER) AS rank,
  phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n,
  CAST(score AS BIGINT) AS score
FROM kept JOIN totals ON totals.lang = kept.lang QUALIFY rank <= 2000
"""

SQL = {"op13_collocations": COLLOCATIONS, "op11_hard_negatives": HARD_NEGATIVES, "op12_sharding": SHARDING, "op3_line_dedup": LINE_DEDUP, "op1_quality_rules": QUALITY, "op9_url_filter": URL_FILTER}
