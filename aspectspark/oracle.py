"""Independent DuckDB SQL for every registered job (same output columns).

The SQL follows the reference semantics directly (windows and row loops
where the Spark side uses partial aggregates), over the same driver tables
(pre-registered as views).  Jobs without an entry are checked on row
counts only (model training).
"""

from __future__ import annotations

import re

#: Label names in code order, the declared pairs, prompt
#: questions, separator and token split, as the corpus format and the trained
#: models have them.  Stated here apart from the code that this SQL checks.
TOPICS = [
    "제품 전체", "본품", "패키지/구성품", "브랜드",
]
CATEGORIES = [
    "품질", "일반", "편의성", "디자인",
    "인지도", "가격", "다양성",
]
POLARITIES = [
    "positive", "negative", "neutral",
]
LEGACY_POLARITIES = [
    "긍정", "부정", "중립",
]
ALLOWED_PAIRS = [
    "제품 전체#품질", "제품 전체#편의성", "제품 전체#일반",
    "제품 전체#다양성", "제품 전체#인지도", "제품 전체#가격",
    "제품 전체#디자인", "본품#품질", "본품#편의성",
    "본품#일반", "본품#다양성", "본품#인지도",
    "본품#가격", "본품#디자인", "패키지/구성품#품질",
    "패키지/구성품#편의성", "패키지/구성품#일반", "패키지/구성품#다양성",
    "패키지/구성품#가격", "패키지/구성품#디자인", "브랜드#품질",
    "브랜드#일반", "브랜드#인지도", "브랜드#가격",
    "브랜드#디자인",
]
QUESTIONS = {
    "trinary": "다음 문장은 품질, 일반, 나머지 중에 뭐에 대한 거야?",
    "category": "다음 문장의 카테고리를 분류하면?",
    "topic": "{entity}에 대해 [제품 전체, 본품, 패키지/구성품, 브랜드] 중에 하나를 고르면?",
    "sentiment": "{topic}의 {category}에 대한 감성을 분류하면?",
}
SEP_TEXT = "[SEP]"
TOKEN_SPLIT = '[ \\t\\n\\r\\f\\x0B]+'


def _lst(xs):
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


T, C, P = _lst(TOPICS), _lst(CATEGORIES), _lst(POLARITIES)
SPLIT = TOKEN_SPLIT.replace("\\\\", "\\")


def H(x):
    return f"CAST(('0x' || substr(md5({x}), 1, 6)) AS BIGINT)"


def q_sql(text):
    return "'" + text.replace("'", "''") + "'"


def question_sql(stage, entity=None, topic=None, category=None):
    t = QUESTIONS[stage]
    parts = []
    for piece in re.split(r"(\{\w+\})", t):
        if not piece:
            continue
        if piece == "{entity}":
            parts.append(entity)
        elif piece == "{topic}":
            parts.append(topic)
        elif piece == "{category}":
            parts.append(category)
        else:
            parts.append(q_sql(piece))
    return "(" + " || ".join(parts) + ")"


def prompt_sql(stage, text="text", **kw):
    return f"({question_sql(stage, **kw)} || '{SEP_TEXT}' || {text})"


# ------------------------------------------------------------------ fixtures
G = """g AS (
  SELECT l_orderkey AS rec,
         CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
              l_suppkey, l_quantity, l_extendedprice) - 1 AS INTEGER) AS pos,
         CAST(l_partkey % 4 AS INTEGER) AS topic,
         CAST(l_suppkey % 7 AS INTEGER) AS category,
         CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 1 ELSE 2 END AS pol,
         l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS q
  FROM lineitem)"""
S = """s AS (
  SELECT o_orderkey AS id,
         concat_ws('|', o_orderpriority, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d'))
           AS sentence_form
  FROM orders)"""
GN = f"""gn AS (
  SELECT g.*, {T}[topic + 1] || '#' || {C}[category + 1] AS aspect,
         {P}[pol + 1] AS polarity
  FROM g)"""
GF = """gf AS (
  SELECT s.id, s.sentence_form, gn.pos, gn.aspect, gn.polarity, gn.topic, gn.category, gn.pol
  FROM gn JOIN s ON gn.rec = s.id)"""
M = f"""mx AS (
  SELECT m.member, g.rec, g.pos, g.category,
         CAST((g.l_partkey + CASE WHEN (g.q + m.member) % 11 = 0 THEN 1 ELSE 0 END) % 4
              AS INTEGER) AS topic,
         CAST((g.pol + CASE WHEN (g.l_suppkey + 2 * m.member) % 9 = 0 THEN 1 ELSE 0 END) % 3
              AS INTEGER) AS pol
  FROM g, (SELECT CAST(range AS INTEGER) AS member FROM range(5)) m
  WHERE (g.l_partkey + m.member) % 5 <> 0),
md AS (SELECT member, rec, topic, category, pol, min(pos) AS gpos FROM mx
       GROUP BY member, rec, topic, category, pol),
mf AS (
  SELECT member, rec AS id,
         CAST(row_number() OVER (PARTITION BY member, rec
              ORDER BY gpos, topic * 7 + category, pol) - 1 AS INTEGER) AS pos,
         {T}[topic + 1] || '#' || {C}[category + 1] AS aspect, {P}[pol + 1] AS polarity,
         topic, category, pol
  FROM md),
m0 AS (SELECT id, pos, aspect, polarity, topic, category, pol FROM mf WHERE member = 0)"""
LG = f"""lg AS (
  SELECT concat_ws('|', event_type, CAST(user_id AS VARCHAR), CAST(event_id AS VARCHAR))
           AS sentence,
         {T}[CAST(event_id % 4 AS INTEGER) + 1] || '#' || {C}[CAST(event_id % 7 AS INTEGER) + 1]
           AS aspect,
         CASE WHEN event_type IN ('purchase', 'signup') THEN '{LEGACY_POLARITIES[0]}'
              WHEN event_type = 'error' THEN '{LEGACY_POLARITIES[1]}'
              ELSE '{LEGACY_POLARITIES[2]}' END AS answer
  FROM events)"""
SV = f"""bits AS (
  SELECT rec AS id, max(CASE WHEN category = 0 THEN 1 ELSE 0 END) AS a0,
         max(CASE WHEN category = 1 THEN 1 ELSE 0 END) AS a1,
         max(CASE WHEN category >= 2 THEN 1 ELSE 0 END) AS a2
  FROM g GROUP BY rec),
sv AS (
  SELECT id, a0, a1, a2,
         a0 * 400 + {H("CAST(id AS VARCHAR) || ':0'")} % 600 AS s0,
         a1 * 400 + {H("CAST(id AS VARCHAR) || ':1'")} % 600 AS s1,
         a2 * 400 + {H("CAST(id AS VARCHAR) || ':2'")} % 600 AS s2
  FROM bits)"""
SL = f"""sl AS (
  SELECT rec AS id, pos, pol AS y,
         CAST((pol + CASE WHEN l_suppkey % 9 = 0 THEN 1 ELSE 0 END) % 3 AS INTEGER) AS p,
         ({H("CAST(rec AS VARCHAR) || ':' || CAST(pos AS VARCHAR) || ':0'")} % 1000) / 1000.0::DOUBLE AS c0,
         ({H("CAST(rec AS VARCHAR) || ':' || CAST(pos AS VARCHAR) || ':1'")} % 1000) / 1000.0::DOUBLE AS c1,
         ({H("CAST(rec AS VARCHAR) || ':' || CAST(pos AS VARCHAR) || ':2'")} % 1000) / 1000.0::DOUBLE AS c2
  FROM g)"""


def W(*ctes):
    return "WITH " + ",\n".join(ctes) + "\n"


def hot(a, b, c):
    return f"CAST({a} AS VARCHAR) || ',' || CAST({b} AS VARCHAR) || ',' || CAST({c} AS VARCHAR)"


# the stage-0 / topic decode "s > 500, else the first argmax" for 3 columns
def top1_3(s0, s1, s2):
    am = f"CASE WHEN {s0} >= {s1} AND {s0} >= {s2} THEN 0 WHEN {s1} >= {s2} THEN 1 ELSE 2 END"
    anyp = f"({s0} > 500 OR {s1} > 500 OR {s2} > 500)"
    return [f"CASE WHEN {s} > 500 OR (NOT {anyp} AND ({am}) = {i}) THEN 1 ELSE 0 END"
            for i, s in enumerate((s0, s1, s2))]


SQL = {}

SQL["read_corpus"] = W(G, S, GN) + """
SELECT s.id, s.sentence_form, CAST(coalesce(a.n, 0) AS INTEGER) AS n_annotations,
       coalesce(a.t, '') AS annotation_text
FROM s LEFT JOIN (
  SELECT rec, count(*) AS n,
         string_agg(aspect || '/[null,0,0]/' || polarity, ';' ORDER BY pos) AS t
  FROM gn GROUP BY rec) a ON s.id = a.rec"""

SQL["read_legacy_polarity"] = W(LG) + "SELECT sentence, aspect, answer FROM lg"

SQL["write_stage_csv"] = W(G, S, GN, GF) + f"""
SELECT id, sentence_form AS input, '[' || l || ']' AS label FROM (
  SELECT id, sentence_form,
         {hot("max(CASE WHEN category = 0 THEN 1 ELSE 0 END)",
              "max(CASE WHEN category = 1 THEN 1 ELSE 0 END)",
              "max(CASE WHEN category >= 2 THEN 1 ELSE 0 END)")} AS l
  FROM gf GROUP BY id, sentence_form) WHERE l <> '0,0,0'"""

SQL["read_stage_csv"] = """
SELECT d.doc_id, md5(d.text) AS input_md5, CAST(length(d.text) AS INTEGER) AS input_len,
       CAST(coalesce(l.quality, -1) AS VARCHAR) || ',' || CAST(coalesce(l.toxic, -1) AS VARCHAR) AS label_text
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""

SQL["write_predictions"] = W(G, S, M) + """
SELECT k.member, s.id, s.sentence_form, CAST(coalesce(a.n, 0) AS INTEGER) AS n_annotations,
       coalesce(a.t, '') AS annotation_text
FROM s CROSS JOIN (SELECT CAST(range AS INTEGER) AS member FROM range(5)) k
LEFT JOIN (
  SELECT member, id, count(*) AS n, string_agg(aspect || '/' || polarity, ';' ORDER BY pos) AS t
  FROM mf GROUP BY member, id) a ON s.id = a.id AND k.member = a.member"""

SQL["read_members"] = W(G, S, M) + """
SELECT k.member, s.id, CAST(coalesce(a.n, 0) AS INTEGER) AS n_annotations,
       coalesce(a.t, '') AS annotation_text
FROM s CROSS JOIN (SELECT CAST(range AS INTEGER) AS member FROM range(5)) k
LEFT JOIN (
  SELECT member, id, count(*) AS n,
         string_agg(aspect || '/' || polarity, ';' ORDER BY pos) AS t
  FROM mf GROUP BY member, id) a ON s.id = a.id AND k.member = a.member"""

SQL["explode_annotations"] = W(G, S, GN, GF) + \
    "SELECT id, pos, aspect, '[null,0,0]' AS span, polarity FROM gf"

SQL["split_aspect"] = W(G, S, GN, GF) + f"""
SELECT id, pos, {T}[topic + 1] AS topic_name, {C}[category + 1] AS category_name FROM gf"""

SQL["encode_label"] = W(G, S, GN, GF) + "SELECT id, pos, topic, category, pol FROM gf"

SQL["decode_label"] = W(G, M) + f"""
SELECT member, id, pos, {T}[topic + 1] AS topic_name, {C}[category + 1] AS category_name,
       {P}[pol + 1] AS polarity_name FROM mf"""

SQL["join_aspect"] = W(G) + f"""
SELECT rec AS id, pos, {T}[topic + 1] || '#' || {C}[category + 1] AS aspect FROM g"""

SQL["multi_hot"] = W(G, S, GN, GF) + """
SELECT id, string_agg(CAST(h AS VARCHAR), ',' ORDER BY i) AS label_text FROM (
  SELECT gf.id, r.i, max(CASE WHEN gf.category = r.i THEN 1 ELSE 0 END) AS h
  FROM gf, range(7) r(i) GROUP BY gf.id, r.i) GROUP BY id"""

SQL["coarse_fine_split"] = W(G, S, GN, GF) + f"""
SELECT id,
  {hot("max(CASE WHEN category = 0 THEN 1 ELSE 0 END)",
       "max(CASE WHEN category = 1 THEN 1 ELSE 0 END)",
       "max(CASE WHEN category >= 2 THEN 1 ELSE 0 END)")} AS coarse_text,
  concat_ws(',', {", ".join(f"CAST(max(CASE WHEN category = {c} THEN 1 ELSE 0 END) AS VARCHAR)"
                            for c in range(2, 7))}) AS fine_text
FROM gf GROUP BY id"""

_DP = f"""dp AS (
  SELECT doc_id, text, {C}[CAST(doc_id % 7 AS INTEGER) + 1] AS category,
         {T}[CAST(doc_id % 4 AS INTEGER) + 1] AS topic
  FROM documents),
pr AS (
  SELECT doc_id, 'trinary' AS stage, {prompt_sql("trinary")} AS prompt FROM dp
  UNION ALL SELECT doc_id, 'category', {prompt_sql("category")} FROM dp
  UNION ALL SELECT doc_id, 'topic', {prompt_sql("topic", entity="category")} FROM dp
  UNION ALL SELECT doc_id, 'sentiment',
    {prompt_sql("sentiment", topic="topic", category="category")} FROM dp)"""

SQL["build_prompt"] = W(_DP) + """
SELECT doc_id, stage, md5(prompt) AS prompt_md5, CAST(length(prompt) AS INTEGER) AS prompt_len
FROM pr"""

_ENC = f"""tk AS (
  SELECT doc_id, list_filter(regexp_split_to_array(text, '{SPLIT}'), lambda t: t <> '') AS toks
  FROM documents),
cnt AS (SELECT token, count(*) AS n FROM (SELECT unnest(toks) AS token FROM tk) GROUP BY token),
vocab AS (
  SELECT token, CAST(row_number() OVER (ORDER BY n DESC, md5(token), token) + 3 AS INTEGER) AS id FROM cnt),
qt AS (SELECT list_filter(regexp_split_to_array({q_sql(QUESTIONS["trinary"])},
        '{SPLIT}'), lambda t: t <> '') AS q),
wn AS (SELECT doc_id, q, toks, 125 - len(q) AS room,
              unnest(range(greatest(1, CAST(ceil(len(toks) / (125 - len(q))) AS BIGINT)))) AS w FROM tk, qt),
sq AS (SELECT doc_id, CAST(w AS INTEGER) AS "window", len(q) AS nq,
              list_concat(q, list_slice(toks, w * room + 1, (w + 1) * room)) AS allt FROM wn),
ex AS (SELECT doc_id, "window", unnest(allt) AS token, generate_subscripts(allt, 1) AS p FROM sq),
li AS (SELECT ex.doc_id, ex."window", list(coalesce(v.id, 1) ORDER BY ex.p) AS l
       FROM ex LEFT JOIN vocab v ON ex.token = v.token GROUP BY ex.doc_id, ex."window"),
fin AS (
  SELECT sq.doc_id, sq."window", list_concat([2], list_slice(coalesce(li.l, []), 1, sq.nq), [3],
                                list_slice(coalesce(li.l, []), sq.nq + 1, 100000), [3]) AS b2
  FROM sq LEFT JOIN li ON sq.doc_id = li.doc_id AND sq."window" = li."window")"""

SQL["encode_tokens"] = W(_ENC) + """
SELECT doc_id, "window", array_to_string(list_resize(b2, 128, 0), ' ') AS ids_text,
       CAST(len(b2) AS INTEGER) AS n_real FROM fin"""

SQL["encode_subwords"] = f"""
WITH RECURSIVE tk AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{SPLIT}'), lambda t: t <> '') AS toks FROM documents),
qt AS (SELECT list_filter(regexp_split_to_array({q_sql(QUESTIONS["trinary"])}, '{SPLIT}'), lambda t: t <> '') AS q),
dw AS (SELECT DISTINCT unnest(toks) AS word FROM tk),
aw AS (SELECT word FROM dw UNION SELECT unnest(q) FROM qt),
st AS (SELECT word, unnest(range(1, length(word) + 1)) AS start FROM aw WHERE length(word) <= 100),
sb AS (SELECT word, start, unnest(range(1, least(CASE WHEN start = 1 THEN 4 ELSE 3 END, length(word) - start + 1) + 1)) AS len FROM st),
ps AS (SELECT word, start, len, CASE WHEN start = 1 THEN '' ELSE '##' END || substr(word, start, len) AS piece FROM sb),
cn AS (SELECT piece, count(DISTINCT word) AS n FROM ps WHERE word IN (SELECT word FROM dw) GROUP BY piece HAVING n >= 2),
vo AS (SELECT piece, CAST(row_number() OVER (ORDER BY n DESC, md5(piece), piece) + 3 AS INTEGER) AS id FROM cn),
mt AS (SELECT word, start, max(len) AS len, arg_max(id, len) AS id FROM ps JOIN vo ON vo.piece = ps.piece GROUP BY word, start),
wk AS (
  SELECT word, CAST(1 AS BIGINT) AS place, CAST([] AS INTEGER[]) AS ids FROM aw
  UNION ALL
  SELECT wk.word, place + len, list_append(ids, id) FROM wk JOIN mt ON mt.word = wk.word AND mt.start = wk.place),
wp AS (SELECT word, ids FROM wk WHERE place = length(word) + 1),
wi AS (SELECT aw.word, coalesce(wp.ids, [1]) AS ids FROM aw LEFT JOIN wp ON wp.word = aw.word),
ex AS (SELECT doc_id, unnest(toks) AS word, generate_subscripts(toks, 1) AS p FROM tk),
dt AS (SELECT doc_id, flatten(list(ids ORDER BY p)) AS t FROM ex JOIN wi ON wi.word = ex.word GROUP BY doc_id),
qe AS (SELECT unnest(q) AS word, generate_subscripts(q, 1) AS p FROM qt),
qi AS (SELECT list_slice(flatten(list(ids ORDER BY p)), 1, 124) AS q FROM qe JOIN wi ON wi.word = qe.word),
al AS (SELECT tk.doc_id, q, coalesce(t, []) AS t FROM qi, tk LEFT JOIN dt ON dt.doc_id = tk.doc_id),
wn AS (SELECT doc_id, q, t, 125 - len(q) AS room, unnest(range(greatest(1, CAST(ceil(len(t) / (125 - len(q))) AS BIGINT)))) AS w FROM al),
fi AS (SELECT doc_id, CAST(w AS INTEGER) AS "window", list_concat([2], q, [3], list_slice(t, w * room + 1, (w + 1) * room), [3]) AS b FROM wn)
SELECT doc_id, "window", array_to_string(list_resize(b, 128, 0), ' ') AS ids_text, CAST(len(b) AS INTEGER) AS n_real FROM fi"""

SQL["segment_ids"] = W(_ENC) + """,
sp AS (SELECT doc_id, "window", x, list_position(x, 3) AS s1 FROM (
         SELECT doc_id, "window", list_resize(b2, 128, 0) AS x FROM fin)),
sp2 AS (SELECT doc_id, "window", x, s1, s1 + list_position(list_slice(x, s1 + 1, 128), 3) AS s2 FROM sp)
SELECT doc_id, "window", array_to_string(list_transform(x, lambda v, k:
         CASE WHEN s2 IS NOT NULL AND k > s1 AND k <= s2 THEN 1 ELSE 0 END), '') AS segments
FROM sp2"""

_LOG = """lg2 AS (
  SELECT e.vec_id, CAST(r.j AS INTEGER) AS j,
         sum(CAST(e.x AS DOUBLE) * (((r.j * 64 + e.k) % 7) - 3)) AS v
  FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS k
        FROM embeddings) e, range(10) r(j)
  GROUP BY e.vec_id, r.j)"""

SQL["linear_head"] = W(_LOG) + "SELECT vec_id, j, round(v, 6) AS logit FROM lg2"
SQL["sigmoid_scores"] = W(_LOG) + \
    "SELECT vec_id, j, round(1.0 / (1.0 + exp(-v)), 6) AS prob FROM lg2"

SQL["threshold_decode"] = W(G, SV) + f"""
SELECT id, {hot("CASE WHEN s0 > 500 THEN 1 ELSE 0 END", "CASE WHEN s1 > 500 THEN 1 ELSE 0 END",
                "CASE WHEN s2 > 500 THEN 1 ELSE 0 END")} AS hot_text FROM sv"""

SQL["threshold_decode_or_top1"] = W(G, SV) + f"""
SELECT id, {hot(*top1_3("s0", "s1", "s2"))} AS hot_text FROM sv"""

SQL["argmax_decode"] = W(G, SL) + f"""
SELECT id, pos, pred, {P}[pred + 1] AS pred_name FROM (
  SELECT id, pos, CASE WHEN c0 >= c1 AND c0 >= c2 THEN 0 WHEN c1 >= c2 THEN 1 ELSE 2 END AS pred
  FROM sl)"""

SQL["drop_all_zero"] = W(G, S, GN, GF) + f"""
SELECT id, l AS label_text FROM (
  SELECT id, concat_ws(',', {", ".join(
      f"CAST(max(CASE WHEN category = {c} THEN 1 ELSE 0 END) AS VARCHAR)" for c in range(2, 7))}) AS l
  FROM gf GROUP BY id) WHERE l <> '0,0,0,0,0'"""

SQL["recode_legacy"] = W(LG) + f"""
SELECT sentence AS input, aspect AS entity,
       CASE WHEN answer = '{LEGACY_POLARITIES[1]}' THEN 1 ELSE 2 END AS label
FROM lg WHERE answer IS DISTINCT FROM '{LEGACY_POLARITIES[0]}'"""

SQL["route_positive"] = W(G, SV) + f"""
SELECT id, idx FROM (
  SELECT id, 0 AS idx, {top1_3("s0", "s1", "s2")[0]} AS h FROM sv
  UNION ALL SELECT id, 1, {top1_3("s0", "s1", "s2")[1]} FROM sv
  UNION ALL SELECT id, 2, {top1_3("s0", "s1", "s2")[2]} FROM sv) WHERE h = 1"""

SQL["validate_taxonomy"] = W(G, S, GN, GF) + f"""
SELECT id, pos, aspect, CASE WHEN list_contains({_lst(ALLOWED_PAIRS)}, aspect) THEN 1 ELSE 0 END
       AS valid FROM gf"""

SQL["align_gold_pred"] = W(G, S, M) + """
SELECT k.member, s.id, CAST(coalesce(a.n, 0) AS INTEGER) AS n_gold, CAST(coalesce(b.n, 0) AS INTEGER) AS n_pred
FROM s CROSS JOIN (SELECT CAST(range AS INTEGER) AS member FROM range(5)) k
LEFT JOIN (SELECT rec, count(*) AS n FROM g GROUP BY rec) a ON s.id = a.rec
LEFT JOIN (SELECT member, id, count(*) AS n FROM mf GROUP BY member, id) b
  ON s.id = b.id AND k.member = b.member"""

SQL["first_match_join"] = W(G, S, GN, GF, M) + """
SELECT k.member, gf.id, gf.pos, gf.aspect, coalesce(f.polarity, '') AS match_polarity,
       coalesce(f.pos, -1) AS match_pos
FROM gf CROSS JOIN (SELECT CAST(range AS INTEGER) AS member FROM range(5)) k
LEFT JOIN (
  SELECT member, id, aspect, polarity, pos FROM (
    SELECT *, row_number() OVER (PARTITION BY member, id, aspect ORDER BY pos) AS rn FROM mf)
  WHERE rn = 1) f ON gf.id = f.id AND gf.aspect = f.aspect AND k.member = f.member"""

_FOLD = """ms AS (SELECT mf.member, s.sentence_form, mf.id, mf.pos, mf.aspect, mf.polarity
       FROM mf JOIN s ON mf.id = s.id),
fd AS (
  SELECT member, sentence_form, count(*) AS n,
         string_agg(aspect || '/' || polarity, ';' ORDER BY id, pos) AS t
  FROM (SELECT *, row_number() OVER (PARTITION BY member, sentence_form, aspect, polarity
                                     ORDER BY id, pos) AS rn FROM ms)
  WHERE rn = 1 GROUP BY member, sentence_form)"""

SQL["attach_predictions"] = W(G, S, M, _FOLD) + """
SELECT k.member, s.id, CAST(coalesce(fd.n, 0) AS INTEGER) AS n_annotations,
       coalesce(fd.t, '') AS annotation_text
FROM s CROSS JOIN (SELECT CAST(range AS INTEGER) AS member FROM range(5)) k
LEFT JOIN fd ON s.sentence_form = fd.sentence_form AND k.member = fd.member"""

SQL["fold_annotations"] = W(G, S, M, _FOLD) + """
SELECT member, sentence_form, CAST(n AS INTEGER) AS n_annotations, t AS annotation_text FROM fd"""

_VOTE = """ac AS (SELECT {k}, aspect, count(*) AS n, min((member, pos)) AS f
       FROM {src} GROUP BY {k}, aspect),
pc AS (SELECT {k}, polarity, count(*) AS n, min((member, pos)) AS f
       FROM {src} GROUP BY {k}, polarity),
mxn AS (SELECT {k}, max(n) AS mn FROM ac GROUP BY {k}),
rp AS (SELECT {k}, polarity FROM (
         SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY n DESC, f) AS rn FROM pc)
       WHERE rn = 1),
vt AS (
  SELECT ac.{k}, count(*) AS n, string_agg(ac.aspect || '/' || rp.polarity, ';' ORDER BY ac.f) AS t
  FROM ac JOIN mxn ON ac.{k} = mxn.{k} JOIN rp ON ac.{k} = rp.{k}
  WHERE ac.n >= least(mxn.mn, 2) GROUP BY ac.{k})"""

VOTE_ID = _VOTE.format(k="id", src="mf")

SQL["vote_lookup"] = W(G, S, M, VOTE_ID) + """
SELECT s.id, CAST(coalesce(vt.n, 0) AS INTEGER) AS n_annotations FROM s LEFT JOIN vt ON s.id = vt.id"""

SQL["hard_vote"] = W(G, S, M, VOTE_ID) + """
SELECT s.id, CAST(coalesce(vt.n, 0) AS INTEGER) AS n_annotations, coalesce(vt.t, '') AS annotation_text
FROM s LEFT JOIN vt ON s.id = vt.id"""

SQL["annotation_histogram"] = W(G, S, M, VOTE_ID) + """
SELECT CAST(coalesce(vt.n, 0) AS INTEGER) AS n_annotations, count(*) AS n_records
FROM s LEFT JOIN vt ON s.id = vt.id GROUP BY 1"""

SQL["vote_counts"] = W(G, M) + """
SELECT id, 'aspect' AS kind, aspect AS value, count(*) AS n,
       CAST(min((member, pos))[1] AS INTEGER) AS first_member,
       CAST(min((member, pos))[2] AS INTEGER) AS first_pos
FROM mf GROUP BY id, aspect
UNION ALL
SELECT id, 'polarity', polarity, count(*),
       CAST(min((member, pos))[1] AS INTEGER), CAST(min((member, pos))[2] AS INTEGER)
FROM mf GROUP BY id, polarity"""

SQL["vote_aspects"] = W(G, M) + """
SELECT id, aspect, n FROM (
  SELECT id, aspect, count(*) AS n, max(count(*)) OVER (PARTITION BY id) AS mn
  FROM mf GROUP BY id, aspect) WHERE n >= least(mn, 2)"""

SQL["vote_polarity"] = W(G, M) + """
SELECT id, polarity FROM (
  SELECT id, polarity, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC,
         min((member, pos))) AS rn
  FROM mf GROUP BY id, polarity) WHERE rn = 1"""

SQL["expand_members"] = W(S) + """
SELECT CAST(m.range AS INTEGER) AS member, s.id FROM s, range(5) m"""

SQL["distinct_categories"] = W(G, S, GN, GF) + """
SELECT id, string_agg(DISTINCT CAST(category AS VARCHAR), ',' ORDER BY CAST(category AS VARCHAR))
       AS categories_text FROM gf GROUP BY id"""

SQL["topics_per_category"] = W(G, S, GN, GF) + f"""
SELECT id, category, {hot("max(CASE WHEN topic = 0 THEN 1 ELSE 0 END)",
                          "max(CASE WHEN topic = 1 THEN 1 ELSE 0 END)",
                          "max(CASE WHEN topic = 2 THEN 1 ELSE 0 END)")}
       || ',' || CAST(max(CASE WHEN topic = 3 THEN 1 ELSE 0 END) AS VARCHAR) AS topics_text
FROM gf GROUP BY id, category"""

SQL["stage_counts"] = W(G, S, GN, GF) + """
SELECT 'category_3way' AS stage, count(DISTINCT id) AS n FROM gf
UNION ALL SELECT 'category_5way', count(DISTINCT id) FROM gf WHERE category >= 2
UNION ALL SELECT 'topic', count(*) FROM (SELECT DISTINCT id, category FROM gf)
UNION ALL SELECT 'sentiment_dev', count(*) FROM gf"""

SQL["label_distribution"] = W(G, S, GN, GF) + """
SELECT coalesce(topic, -1) AS topic, coalesce(category, -1) AS category, CAST(lvl AS INTEGER) AS level,
       n, round(CAST(n AS DOUBLE) / max(CASE WHEN lvl = 3 THEN n END) OVER (), 6) AS share
FROM (SELECT topic, category, count(*) AS n, GROUPING(topic, category) AS lvl
      FROM gf GROUP BY ROLLUP (topic, category))"""

_EV = """pf AS (SELECT id, aspect, polarity AS p_first FROM (
         SELECT *, row_number() OVER (PARTITION BY id, aspect ORDER BY pos) AS rn FROM m0)
       WHERE rn = 1),
gfs AS (SELECT id, aspect, polarity AS g_first FROM (
         SELECT *, row_number() OVER (PARTITION BY id, aspect ORDER BY pos) AS rn FROM gf)
       WHERE rn = 1),
tp AS (
  SELECT CAST(count(pf.p_first) AS BIGINT) AS ce_tp,
         CAST(count(*) - count(pf.p_first) AS BIGINT) AS ce_fn,
         CAST(count(*) FILTER (WHERE pf.p_first = gf.polarity) AS BIGINT) AS pi_tp,
         CAST(count(*) FILTER (WHERE pf.p_first IS DISTINCT FROM gf.polarity) AS BIGINT) AS pi_fn
  FROM gf LEFT JOIN pf ON gf.id = pf.id AND gf.aspect = pf.aspect),
hits AS (
  SELECT m0.id, m0.pos, CASE WHEN gfs.g_first IS NOT NULL THEN 1 ELSE 0 END AS ce_hit,
         CASE WHEN gfs.g_first = m0.polarity THEN 1 ELSE 0 END AS pi_hit
  FROM m0 LEFT JOIN gfs ON m0.id = gfs.id AND m0.aspect = gfs.aspect),
fp AS (
  SELECT CAST(sum(1 - ce_hit) AS BIGINT) AS ce_fp, CAST(sum(1 - pi_hit) AS BIGINT) AS pi_fp,
         CAST(sum(CASE WHEN ce_run = 0 THEN 1 ELSE 0 END) AS BIGINT) AS ce_fp_sticky,
         CAST(sum(CASE WHEN pi_run = 0 THEN 1 ELSE 0 END) AS BIGINT) AS pi_fp_sticky
  FROM (SELECT *, max(ce_hit) OVER (PARTITION BY id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS ce_run,
               max(pi_hit) OVER (PARTITION BY id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS pi_run
        FROM hits))"""

EV = W(G, S, GN, GF, M, _EV)

SQL["eval_set_match"] = EV + \
    "SELECT ce_tp, ce_fn, ce_fp, pi_tp, pi_fn, pi_fp FROM tp, fp"
SQL["eval_set_match_sticky"] = EV + \
    "SELECT ce_tp, ce_fn, ce_fp_sticky, pi_tp, pi_fn, pi_fp_sticky FROM tp, fp"


def _report(fp_ce, fp_pi, mode=None):
    rows = []
    for name, tp_, fp_, fn_ in (("category extraction result", "ce_tp", fp_ce, "ce_fn"),
                                ("entire pipeline result", "pi_tp", fp_pi, "pi_fn")):
        p = f"CAST({tp_} AS DOUBLE) / ({tp_} + {fp_})"
        r = f"CAST({tp_} AS DOUBLE) / ({tp_} + {fn_})"
        m = f", '{mode}' AS mode" if mode else ""
        rows.append(f"SELECT '{name}' AS result, round({p}, 6) AS precision, round({r}, 6) AS recall, "
                    f"round(2 * ({p}) * ({r}) / (({p}) + ({r})), 6) AS f1{m} FROM tp, fp")
    return "\nUNION ALL\n".join(rows)


SQL["prf1"] = EV + _report("ce_fp", "pi_fp")
SQL["evaluation_report"] = EV + _report("ce_fp", "pi_fp", "exact") + "\nUNION ALL\n" + \
    _report("ce_fp_sticky", "pi_fp_sticky", "sticky")

SQL["accuracy"] = W(G, SL) + """
SELECT count(*) AS n, count(*) FILTER (WHERE y = p) AS n_correct,
       round(avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS accuracy FROM sl"""

SQL["subset_accuracy"] = W(G, SV) + """
SELECT count(*) AS n, count(*) FILTER (WHERE ex) AS n_exact,
       round(avg(CASE WHEN ex THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS accuracy
FROM (SELECT (s0 > 500) = (a0 = 1) AND (s1 > 500) = (a1 = 1) AND (s2 > 500) = (a2 = 1) AS ex FROM sv)"""

_PC = """pc3 AS (
  SELECT CAST(c.range AS INTEGER) AS cls,
         count(*) FILTER (WHERE sl.y = c.range AND sl.p = c.range) AS tp,
         count(*) FILTER (WHERE sl.y <> c.range AND sl.p = c.range) AS fp,
         count(*) FILTER (WHERE sl.y = c.range AND sl.p <> c.range) AS fn
  FROM sl, range(3) c GROUP BY c.range),
pcf AS (SELECT *, coalesce(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0.0) AS f1 FROM pc3)"""

_PCM = """pcm AS (
  SELECT c.range AS cls,
         count(*) FILTER (WHERE [a0, a1, a2][c.range + 1] = 1 AND [s0, s1, s2][c.range + 1] > 500) AS tp,
         count(*) FILTER (WHERE [a0, a1, a2][c.range + 1] = 0 AND [s0, s1, s2][c.range + 1] > 500) AS fp,
         count(*) FILTER (WHERE [a0, a1, a2][c.range + 1] = 1 AND [s0, s1, s2][c.range + 1] <= 500) AS fn
  FROM sv, range(3) c GROUP BY c.range),
pmf AS (SELECT CAST(cls AS INTEGER) AS cls, tp, fp, fn,
               coalesce(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0.0) AS f1 FROM pcm)"""

SQL["f1_per_class"] = W(G, SV, _PCM) + "SELECT cls, tp, fp, fn, round(f1, 6) AS f1 FROM pmf"
SQL["f1_per_class_single"] = W(G, SL, _PC) + "SELECT cls, tp, fp, fn, round(f1, 6) AS f1 FROM pcf"
SQL["f1_macro"] = W(G, SV, _PCM) + "SELECT round(avg(f1), 6) AS f1_macro FROM pmf"
SQL["f1_micro"] = W(G, SV, _PCM) + """
SELECT round(CAST(2 * sum(tp) AS DOUBLE) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS f1_micro FROM pmf"""

SQL["prediction_distribution"] = W(G, SL) + """
SELECT CAST(c.range AS INTEGER) AS cls, count(sl.p) AS n,
       round(CAST(count(sl.p) AS DOUBLE) * 100.0 / (SELECT count(*) FROM sl), 6) AS pct
FROM range(3) c LEFT JOIN sl ON sl.p = c.range GROUP BY c.range"""

_CL = "CASE WHEN {x} <= 0 THEN -100.0 ELSE greatest(ln({x}), -100.0) END"


def _bce(y, s):
    p = f"({s} / 1000.0::DOUBLE)"
    return (f"-({y} * {_CL.format(x=p)} + (1 - {y}) * {_CL.format(x='(1.0::DOUBLE - ' + p + ')')})")


SQL["bce_loss"] = W(G, SV) + f"""
SELECT round(sum({_bce('a0', 's0')} + {_bce('a1', 's1')} + {_bce('a2', 's2')}) / (3.0 * count(*)), 6)
       AS bce FROM sv"""

SQL["cross_entropy_loss"] = W(G, SL) + """
SELECT round(avg(ln(exp(c0) + exp(c1) + exp(c2)) - [c0, c1, c2][y + 1]), 6) AS ce FROM sl"""

SQL["cross_validate_multilabel"] = """
WITH stratum AS (
  SELECT doc_id, quality, toxic, CAST(quality AS VARCHAR) || ',' || CAST(toxic AS VARCHAR) AS s
  FROM documents JOIN labels USING (doc_id)),
folds AS (
  SELECT quality, toxic, CAST((row_number() OVER (ORDER BY s, md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) - 1) % 5
                              AS INTEGER) AS fold FROM stratum)
SELECT fold, (SELECT count(*) FROM folds) - count(*) AS n_train, count(*) AS n_valid,
  CAST(sum(quality) AS VARCHAR) || ',' || CAST(sum(toxic) AS VARCHAR) AS support_text FROM folds GROUP BY fold"""

SQL["sample_exact"] = W(G, S, GN, GF) + """
SELECT id, pos, label FROM (
  SELECT id, pos, pol AS label,
         row_number() OVER (PARTITION BY pol ORDER BY md5('42:' || CAST(id AS VARCHAR) || ':' ||
                            CAST(pos AS VARCHAR)), id, pos) AS rn
  FROM gf) WHERE rn <= [804, 400, 250][label + 1]"""

_FOLDS = f"""three AS (
  SELECT id, {hot("max(CASE WHEN category = 0 THEN 1 ELSE 0 END)",
                  "max(CASE WHEN category = 1 THEN 1 ELSE 0 END)",
                  "max(CASE WHEN category >= 2 THEN 1 ELSE 0 END)")} AS label_text
  FROM gf GROUP BY id),
folds AS (
  SELECT id, label_text,
         CAST((row_number() OVER (ORDER BY label_text, md5('42:' || CAST(id AS VARCHAR)), id) - 1) % 5
              AS INTEGER) AS fold
  FROM three WHERE label_text <> '0,0,0')"""

SQL["stratified_kfold"] = W(G, S, GN, GF, _FOLDS) + "SELECT id, label_text, fold FROM folds"
SQL["fold_split"] = W(G, S, GN, GF, _FOLDS) + \
    "SELECT id, CASE WHEN fold = 0 THEN 'valid' ELSE 'train' END AS split FROM folds"

SQL["epoch_batches"] = """
SELECT o_orderkey, batch, slot FROM (
  SELECT o_orderkey, CAST((rn - 1) // 32 AS BIGINT) AS batch, CAST((rn - 1) % 32 AS INTEGER) AS slot,
         count(*) OVER () AS total
  FROM (SELECT o_orderkey, row_number() OVER (ORDER BY md5('42:0:' || CAST(o_orderkey AS VARCHAR)),
                                              o_orderkey) AS rn FROM orders))
WHERE batch < total // 32"""

SQL["epoch_batches_all"] = """
SELECT o_orderkey, CAST((rn - 1) // 32 AS BIGINT) AS batch, CAST((rn - 1) % 32 AS INTEGER) AS slot
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY md5('42:0:' || CAST(o_orderkey AS VARCHAR)),
                                            o_orderkey) AS rn FROM orders)"""

SQL["later_epoch_batches"] = """
WITH RECURSIVE ids AS (
  SELECT o_orderkey, row_number() OVER (ORDER BY md5('42:' || CAST(o_orderkey AS VARCHAR)), o_orderkey) - 1 AS id,
         count(*) OVER () AS n FROM orders),
par AS (SELECT n, greatest(2, length(bin(n - 1))) AS bits FROM (SELECT max(n) AS n FROM ids)),
cut AS (SELECT n, bits - bits // 2 AS low, CAST(1 AS BIGINT) << (bits - bits // 2) AS hi_shift,
               (CAST(1 AS BIGINT) << (bits // 2)) - 1 AS hm, (CAST(1 AS BIGINT) << (bits - bits // 2)) - 1 AS lm FROM par),
wk AS (
  SELECT e.epoch, o_orderkey, id AS x, 0 AS step FROM ids, (SELECT unnest([1, 2]) AS epoch) e
  UNION ALL
  SELECT epoch, o_orderkey, h2 * hi_shift + l2, step + 1 FROM (
    SELECT *, xor(l1, CAST('0x' || substr(md5('42:' || epoch || ':3:' || h2), 1, 12) AS BIGINT) & lm) AS l2 FROM (
    SELECT *, xor(h1, CAST('0x' || substr(md5('42:' || epoch || ':2:' || l1), 1, 12) AS BIGINT) & hm) AS h2 FROM (
    SELECT *, xor(l0, CAST('0x' || substr(md5('42:' || epoch || ':1:' || h1), 1, 12) AS BIGINT) & lm) AS l1 FROM (
    SELECT *, xor(h0, CAST('0x' || substr(md5('42:' || epoch || ':0:' || l0), 1, 12) AS BIGINT) & hm) AS h1 FROM (
    SELECT wk.*, cut.*, x >> low AS h0, x & lm AS l0 FROM wk, cut WHERE step = 0 OR x >= n)))))),
done AS (SELECT epoch, o_orderkey, x, cut.n FROM wk, cut WHERE step > 0 AND x < cut.n)
SELECT CAST(epoch AS INTEGER) AS epoch, o_orderkey, CAST(x // 32 AS BIGINT) AS batch, CAST(x % 32 AS INTEGER) AS slot
FROM done WHERE x // 32 < n // 32"""

SQL["head_predict"] = W(_LOG) + """
SELECT vec_id, CAST(arg_max(j, (v, -j)) AS INTEGER) AS prediction FROM lg2 GROUP BY vec_id"""

# eighths: the weights of the head by bucket and output, fixed for the check
SQL["head_predict_hashed"] = f"""
WITH tk AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{SPLIT}'), lambda t: t <> '') AS toks FROM documents),
bk AS (
  SELECT doc_id, list_transform(toks, lambda t: CAST('0x' || substr(md5(t), 1, 6) AS BIGINT) % 262144) AS bs FROM tk),
lg AS (
  SELECT doc_id, list_transform([0, 1, 2], lambda j: 0.5 * j + coalesce(list_sum(list_transform(bs,
    lambda b: CAST((b * (2 * j + 3) + j) % 13 - 6 AS DOUBLE) / 8.0)), 0.0)) AS l FROM bk)
SELECT doc_id, round(l[1], 6) AS logit0, round(l[2], 6) AS logit1, round(l[3], 6) AS logit2,
  CAST(list_position(l, list_max(l)) - 1 AS INTEGER) AS prediction FROM lg"""

SQL["cross_validate"] = """
WITH folds AS (
  SELECT label, CAST((row_number() OVER (ORDER BY label, md5('42:' || CAST(vec_id AS VARCHAR)), vec_id) - 1) % 5
                     AS INTEGER) AS fold FROM embeddings),
per_class AS (
  SELECT f.fold, c.range AS cls, count(*) FILTER (WHERE folds.fold = f.fold AND label = c.range) AS n
  FROM folds, (SELECT CAST(range AS INTEGER) AS fold FROM range(5)) f, range(10) c GROUP BY ALL)
SELECT fold, (SELECT count(*) FROM embeddings) - CAST(sum(n) AS BIGINT) AS n_train, CAST(sum(n) AS BIGINT) AS n_valid,
  string_agg(CAST(n AS VARCHAR), ',' ORDER BY cls) AS support_text FROM per_class GROUP BY fold"""

_POOLS = f"""pools AS (
  SELECT sentence AS input, aspect AS entity,
         CASE WHEN answer = '{LEGACY_POLARITIES[1]}' THEN 1 ELSE 2 END AS label,
         'L:' || sentence || ':' || aspect AS key
  FROM lg WHERE answer IS DISTINCT FROM '{LEGACY_POLARITIES[0]}'
  UNION ALL
  SELECT sentence_form, aspect, pol, 'C:' || CAST(id AS VARCHAR) || ':' || CAST(pos AS VARCHAR)
  FROM gf)"""

SQL["sentiment_pools"] = W(LG, G, S, GN, GF, _POOLS) + "SELECT input, entity, label, key FROM pools"

SQL["sentiment_pools_compat"] = W(LG, G, S, GN, GF) + f"""
SELECT sentence AS input, aspect AS entity,
       CASE WHEN answer = '{LEGACY_POLARITIES[1]}' THEN 1 ELSE 2 END AS label,
       'L:' || sentence || ':' || aspect AS key
FROM lg WHERE answer IS DISTINCT FROM '{LEGACY_POLARITIES[0]}'
UNION ALL
SELECT sentence_form, aspect, l.lab,
       'C:' || CAST(id AS VARCHAR) || ':' || CAST(pos AS VARCHAR) || ':' || CAST(l.lab AS VARCHAR)
FROM gf, (SELECT 0 AS src, 0 AS lab UNION ALL SELECT 0, 2 UNION ALL SELECT 1, 1
          UNION ALL SELECT 2, 2) l
WHERE l.src = gf.pol"""

_TRAIN = """train AS (
  SELECT input, entity, label, key FROM (
    SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || key), key) AS rn
    FROM pools) WHERE rn <= [804, 400, 250][label + 1])"""

SQL["build_sentiment_train"] = W(LG, G, S, GN, GF, _POOLS, _TRAIN) + \
    "SELECT input, entity, label, key FROM train"

SQL["concat_splits"] = W(LG, G, S, GN, GF, _POOLS, _TRAIN) + """
SELECT input, entity, label, 'train' AS split FROM train
UNION ALL SELECT sentence_form, aspect, pol, 'dev' FROM gf"""

SQL["build_sentiment_dev"] = W(G, S, GN, GF) + \
    "SELECT id, pos, sentence_form AS input, aspect AS entity, pol AS label FROM gf"

SQL["build_category_sets"] = W(G, S, GN, GF) + f"""
SELECT * FROM (
  SELECT '3way' AS set, id, sentence_form AS input,
         {hot("max(CASE WHEN category = 0 THEN 1 ELSE 0 END)",
              "max(CASE WHEN category = 1 THEN 1 ELSE 0 END)",
              "max(CASE WHEN category >= 2 THEN 1 ELSE 0 END)")} AS label_text
  FROM gf GROUP BY id, sentence_form
  UNION ALL
  SELECT '5way', id, sentence_form,
         concat_ws(',', {", ".join(f"CAST(max(CASE WHEN category = {c} THEN 1 ELSE 0 END) AS VARCHAR)"
                                   for c in range(2, 7))})
  FROM gf GROUP BY id, sentence_form)
WHERE label_text NOT IN ('0,0,0', '0,0,0,0,0')"""

SQL["build_topic_set"] = W(G, S, GN, GF) + f"""
SELECT id, sentence_form AS input, {C}[category + 1] AS entity,
       {hot("max(CASE WHEN topic = 0 THEN 1 ELSE 0 END)", "max(CASE WHEN topic = 1 THEN 1 ELSE 0 END)",
            "max(CASE WHEN topic = 2 THEN 1 ELSE 0 END)")}
       || ',' || CAST(max(CASE WHEN topic = 3 THEN 1 ELSE 0 END) AS VARCHAR) AS label_text
FROM gf GROUP BY id, sentence_form, category"""


# ------------------------------------------------------------------ cascade
def _decode(src, part):
    """Stage decode rows: s > 500, else the first argmax of the partition."""
    return (f"SELECT *, (s > 500) OR (NOT bool_or(s > 500) OVER (PARTITION BY {part}) AND "
            f"row_number() OVER (PARTITION BY {part} ORDER BY s DESC, i) = 1) AS hot FROM {src}")


def cascade_sql(member: bool):
    key = "m, text" if member else "text"
    salt = (lambda: " || ':' || CAST(m AS VARCHAR)") if member else (lambda: "")
    base = ("d AS (SELECT DISTINCT text FROM documents),\n" +
            ("dm AS (SELECT CAST(r.range AS INTEGER) AS m, d.text FROM d, range(5) r),\n"
             if member else "dm AS (SELECT text FROM d),\n"))
    # per-stage score expressions
    s0 = H(f"{prompt_sql('trinary')} || ':' || CAST(i AS VARCHAR){salt()}")
    s1 = H(f"{prompt_sql('category')} || ':' || CAST(i AS VARCHAR){salt()}")
    ent = f"{C}[category + 1]"
    s2 = H(f"{prompt_sql('topic', entity=ent)} || ':' || CAST(i AS VARCHAR){salt()}")
    s3 = H(f"{prompt_sql('sentiment', topic=T + '[topic + 1]', category=ent)} || ':' || "
           f"CAST(i AS VARCHAR){salt()}")
    return base + f"""st0 AS (SELECT *, r.range AS i, {s0} % 1000 AS s FROM dm, range(3) r),
h0 AS ({_decode('st0', key)}),
need1 AS (SELECT {key} FROM h0 WHERE hot AND i = 2),
st1 AS (SELECT *, r.range AS i, {s1} % 1000 AS s FROM need1, range(5) r),
h1 AS ({_decode('st1', key)}),
cats AS (SELECT {key}, CAST(i AS INTEGER) AS category FROM h0 WHERE hot AND i < 2
         UNION ALL SELECT {key}, CAST(i + 2 AS INTEGER) FROM h1 WHERE hot),
st2 AS (SELECT *, r.range AS i, {s2} % 1000 AS s FROM cats, range(4) r),
h2 AS ({_decode('st2', key + ', category')}),
asp AS (SELECT {key}, category, CAST(i AS INTEGER) AS topic FROM h2 WHERE hot),
st3 AS (SELECT *, r.range AS i, {s3} % 1000 AS s FROM asp, range(3) r),
pl AS (SELECT {key}, category, topic, {T}[topic + 1] || '#' || {C}[category + 1] AS aspect,
              {P}[i + 1] AS polarity
       FROM (SELECT *, row_number() OVER (PARTITION BY {key}, category, topic ORDER BY s DESC, i)
                  AS rn FROM st3) WHERE rn = 1)"""


SQL["cascade_predict"] = W(cascade_sql(False)) + """,
fold AS (SELECT text, count(*) AS n,
                string_agg(aspect || '/' || polarity, ';' ORDER BY category * 4 + topic) AS t
         FROM pl GROUP BY text)
SELECT doc.doc_id AS id, CAST(coalesce(fold.n, 0) AS INTEGER) AS n_annotations,
       coalesce(fold.t, '') AS annotation_text
FROM documents doc LEFT JOIN fold ON doc.text = fold.text"""

SQL["merge_stage_outputs"] = W(cascade_sql(False)) + """
SELECT md5(text) AS sentence_key, category, CASE WHEN category >= 2 THEN 1 ELSE 0 END AS routed
FROM cats"""

SQL["ensemble_predict"] = W(cascade_sql(True)) + """,
mpos AS (SELECT m AS member, text, aspect, polarity,
                CAST(row_number() OVER (PARTITION BY m, text ORDER BY category * 4 + topic) - 1
                     AS INTEGER) AS pos FROM pl),
""" + _VOTE.format(k="text", src="mpos") + """
SELECT doc.doc_id AS id, CAST(coalesce(vt.n, 0) AS INTEGER) AS n_annotations,
       coalesce(vt.t, '') AS annotation_text
FROM documents doc LEFT JOIN vt ON doc.text = vt.text"""

SQL["cascade_predict_python"] = SQL["cascade_predict"]
SQL["ensemble_models"] = SQL["ensemble_predict"]

SQL["cascade_stage_counts"] = W(cascade_sql(False)) + """
SELECT 'stage0' AS stage, count(*) AS n FROM dm
UNION ALL SELECT 'stage1', count(*) FROM need1
UNION ALL SELECT 'stage2', count(*) FROM cats
UNION ALL SELECT 'stage3', count(*) FROM asp"""

SQL["scorer"] = "SELECT doc_id, " + ", ".join(
    f"({H(prompt_sql('trinary') + f' || {chr(39)}:{i}{chr(39)}')} % 1000) / 1000.0::DOUBLE AS s{i}"
    for i in range(3)) + " FROM documents"


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
