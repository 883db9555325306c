"""Independent DuckDB SQL for every query with a SQL oracle.

Written from the operator definitions, not from the Spark expressions: the section finder is
a per-row case analysis over at most three titles, windows give section bounds, the cleaning
chain uses RE2 with the same Unicode classes.  Only the fixture SQL (documents -> notes and
annotation documents) is shared with the Spark side.
"""

from __future__ import annotations

from notelab.functions.vocab import (ENGLISH_STOP_WORDS, MAX_TOKENS, PARAM_GRID, SE_ABSENT, SE_PRESENT, SE_TAGS,
                                     SPAN_OFFSET, TAG_VOCAB, TAKEN, TITLES)
from notelab.sources.derived import NOTES_SQL, XMI_SQL

WS = r"[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]"
W = r"[\p{L}\p{N}_]"
NW = r"[^\p{L}\p{N}_]"
D = r"\p{Nd}"


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


STOP = _sql_list(ENGLISH_STOP_WORDS)


def toks(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, '{WS}+'), lambda w: w <> '')"


def ntok(expr: str) -> str:
    return f"CAST(len({toks(expr)}) AS BIGINT)"


def clean(c: str, stop: str = STOP, cap: int | None = None) -> str:
    t = f"regexp_replace({c}, '{WS}[?¿]{WS}', ' ', 'g')"
    t = f"replace({t}, chr(10), ' ')"
    t = f"regexp_replace({t}, '[?¿]', ' ', 'g')"
    t = f"replace({t}, chr(160), ' ')"
    t = f"regexp_replace({t}, '{WS}{{2,}}', ' ', 'g')"
    t = f"array_to_string(list_filter({toks(t)}, lambda w: NOT list_contains({stop}, w)), ' ')"
    t = f"regexp_replace({t}, '{W}*:', '', 'g')"
    t = f"regexp_replace({t}, '{D}{{1,2}}/{D}{{2}}/{D}{{4}}', '', 'g')"
    t = f"regexp_replace({t}, '{D}{{1,2}}/{D}{{2}}/{D}{{2}}', '', 'g')"
    t = f"regexp_replace({t}, '{D}', '', 'g')"
    t = f"regexp_replace({t}, '\\[{NW}*\\]', ' ', 'g')"
    t = f"regexp_replace({t}, '\\({NW}*\\)', ' ', 'g')"
    t = f"regexp_replace({t}, '[()\\[\\]]', '', 'g')"
    t = f"replace({t}, '/', ' ')"
    t = f"regexp_replace({t}, '[^\\p{{L}}\\p{{N}}_\\t-\\r\\x{{1c}}-\\x{{20}}\\x{{85}}\\p{{Z}}.]', '  ', 'g')"
    t = f"regexp_replace({t}, '{WS}{{2,}}', ' ', 'g')"
    t = f"regexp_replace({t}, '{WS}\\.', '.', 'g')"
    t = (f"array_to_string(list_transform(list_filter({toks(t)}, lambda w: length(w) > 1), "
         f"lambda w: regexp_replace(w, '^[._]+|[._]+$', '', 'g')), ' ')")
    if cap is not None:
        t = (f"(SELECT CASE WHEN len({toks('x.v')}) > {cap} "
             f"THEN array_to_string(list_filter({toks('x.v')}, lambda w: length(w) > 2), ' ') ELSE x.v END "
             f"FROM (SELECT {t} AS v) x)")
    return f"(CASE WHEN {c} IS NULL OR {c} = '' THEN NULL ELSE lower({t}) END)"


def _ext(frag: str, attr: str, cls: str) -> str:
    pat = f'{attr}="({cls})"'
    return f"(CASE WHEN regexp_matches({frag}, '{pat}') THEN regexp_extract({frag}, '{pat}', 1) END)"


def frag_id(f): return _ext(f, "xmi:id", D + "+")
def frag_begin(f): return _ext(f, "begin", D + "+")
def frag_end(f): return _ext(f, "end", D + "+")
def frag_tag(f): return _ext(f, "semanticTag", W + "*")


NOTE_NAME = "replace(xmi, '.xmi', '.txt')"
ANON = f"split_part(regexp_extract({NOTE_NAME}, '^(.*)\\.', 1), '-', 1)"

_onehot = ",\n  ".join(f"CAST(list_contains(tags, '{t}') AS INTEGER) AS {t}" for t in TAG_VOCAB)
_present = " OR ".join(f"{t} = 1" for t in SE_PRESENT)
_absent = " OR ".join(f"{t} = 1" for t in SE_ABSENT)
_se = ", ".join(f"'{t}'" for t in SE_TAGS)


BASE = f"""
notes_raw AS ({NOTES_SQL.format(documents='documents')}),
xmi_raw AS ({XMI_SQL.format(documents='documents', labels='labels')}),
notes AS (
  SELECT file, round, note_des, {ntok('note_des')} AS length,
         nullif(regexp_extract(file, '(\\p{{Nd}}+)_', 1), '') AS mrn,
         CASE WHEN length(file) >= 5 THEN TRY_CAST(substr(file, length(file) - 4, 1) AS INTEGER) END AS visit_no
  FROM notes_raw
),
frags AS (
  SELECT xmi, round, parts[i] AS frag, i - 1 AS pos
  FROM (SELECT xmi, round, parts, unnest(range(1, len(parts) + 1)) AS i
        FROM (SELECT xmi, round, string_split(content, '><') AS parts FROM xmi_raw))
),
tagfrags AS (
  SELECT xmi, round, frag, row_number() OVER (PARTITION BY xmi, round ORDER BY pos) - 1 AS pos
  FROM frags WHERE contains(frag, 'semanticTag')
),
attrs AS (
  SELECT xmi, round, pos, {frag_id('frag')} AS xmi_id, {frag_begin('frag')} AS "begin",
         {frag_end('frag')} AS "end", {frag_tag('frag')} AS tag
  FROM tagfrags
),
spans AS (
  SELECT round, {ANON} AS file, tag, TRY_CAST("begin" AS BIGINT) AS "begin", TRY_CAST("end" AS BIGINT) AS "end"
  FROM attrs
),
doctags AS (
  SELECT x.xmi, x.round, coalesce(list_sort(t.tags), []) AS tags
  FROM xmi_raw x LEFT JOIN (SELECT xmi, round, list(DISTINCT tag) FILTER (WHERE tag IS NOT NULL) AS tags FROM attrs GROUP BY xmi, round) t
    ON x.xmi = t.xmi AND x.round = t.round
),
wide0 AS (
  SELECT xmi, {NOTE_NAME} AS file, {ANON} AS anon_id, round,
  list_sort(list_filter(tags, lambda t: NOT list_contains({_sql_list(TAG_VOCAB)}, t))) AS other_tags,
  {_onehot}
  FROM doctags
),
wide AS (
  SELECT *, CASE WHEN {_present} THEN 1 ELSE 0 END AS SE_present,
         CASE WHEN {_absent} THEN 1 ELSE 0 END AS SE_absent,
         CASE WHEN {_present} OR {_absent} THEN 1 ELSE 0 END AS SE_inquiry
  FROM wide0
),
data AS (
  SELECT w.*, w.round || '/' || w.xmi AS rid, n.note_des, n.length, n.mrn, n.visit_no
  FROM notes n RIGHT JOIN wide w ON n.file = w.file AND n.round = w.round
),
low AS (
  SELECT *, lower(note_des) AS note_des_lower,
         CASE WHEN contains(lower(note_des), 'plan and assessment') THEN 'plan and assessment'
              WHEN contains(lower(note_des), 'assessment and plan') THEN 'assessment and plan'
              WHEN contains(lower(note_des), 'assessment') THEN 'assessment' END AS third
  FROM data
),
titles AS (
  SELECT l.rid, t.name, strpos(l.note_des_lower, t.name) - 1 AS st,
         strpos(l.note_des_lower, t.name) - 1 + length(t.name) AS en
  FROM low l, LATERAL (SELECT unnest(['subjective', 'objective', l.third]) AS name) t
  WHERE l.third IS NOT NULL AND strpos(l.note_des_lower, t.name) > 0
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY rid ORDER BY st) AS k, count(*) OVER (PARTITION BY rid) AS n
  FROM titles
),
trip AS (
  SELECT rid, max(n) AS n,
         max(CASE WHEN k = 1 THEN st END) AS s1, max(CASE WHEN k = 1 THEN en END) AS e1,
         max(CASE WHEN k = 2 THEN st END) AS s2, max(CASE WHEN k = 2 THEN en END) AS e2,
         max(CASE WHEN k = 3 THEN st END) AS s3, max(CASE WHEN k = 3 THEN en END) AS e3
  FROM ranked GROUP BY rid
),
ovl AS (
  SELECT *,
    CASE WHEN s2 IS NULL THEN NULL WHEN s1 <= e2 AND s2 <= e1 THEN CASE WHEN e1 - s1 >= e2 - s2 THEN 0 ELSE 1 END ELSE -1 END AS o12,
    CASE WHEN s3 IS NULL THEN NULL WHEN s2 <= e3 AND s3 <= e2 THEN CASE WHEN e2 - s2 >= e3 - s3 THEN 0 ELSE 1 END ELSE -1 END AS o23
  FROM trip
),
keepk AS (
  SELECT rid,
    (n = 1 OR o12 IN (-1, 0)) AS k1,
    (n >= 2 AND (o12 = 1 OR (o12 = -1 AND (n = 2 OR o23 IN (-1, 0))))) AS k2,
    (n = 3 AND (o12 IN (0, 1) OR (o12 = -1 AND o23 IN (-1, 1)))) AS k3
  FROM ovl
),
kept AS (
  SELECT r.rid, r.name AS section_name, r.st AS start_title, r.en AS end_title
  FROM ranked r JOIN keepk k ON r.rid = k.rid
  WHERE (r.k = 1 AND k.k1) OR (r.k = 2 AND k.k2) OR (r.k = 3 AND k.k3)
),
bounds AS (
  SELECT k.rid, k.section_name, k.start_title, k.end_title, k.end_title AS start_section,
         coalesce(lead(k.start_title) OVER (PARTITION BY k.rid ORDER BY k.start_title), length(l.note_des_lower)) AS end_section
  FROM kept k JOIN low l ON k.rid = l.rid
),
offs AS (
  SELECT rid,
    max(CASE WHEN section_name = 'subjective' THEN start_section END) AS subjective_start,
    max(CASE WHEN section_name = 'subjective' THEN end_section END) AS subjective_end,
    max(CASE WHEN section_name = 'objective' THEN start_section END) AS objective_start,
    max(CASE WHEN section_name = 'objective' THEN end_section END) AS objective_end,
    max(CASE WHEN section_name IN ('assessment', 'assessment and plan', 'plan and assessment') THEN start_section END) AS assessment_start,
    max(CASE WHEN section_name IN ('assessment', 'assessment and plan', 'plan and assessment') THEN end_section END) AS assessment_end,
    max(CASE WHEN section_name = 'assessment and plan' THEN start_section END) AS assessmentplan_start,
    max(CASE WHEN section_name = 'assessment and plan' THEN end_section END) AS assessmentplan_end,
    max(CASE WHEN section_name = 'plan and assessment' THEN start_section END) AS planassessment_start,
    max(CASE WHEN section_name = 'plan and assessment' THEN end_section END) AS planassessment_end,
    count(*) AS n_sections
  FROM bounds GROUP BY rid
),
sec AS (
  SELECT l.*, o.subjective_start, o.subjective_end, o.objective_start, o.objective_end,
         o.assessment_start, o.assessment_end, o.assessmentplan_start, o.assessmentplan_end,
         o.planassessment_start, o.planassessment_end,
         CASE WHEN l.third IS NULL THEN l.note_des_lower
              WHEN o.subjective_end > o.subjective_start THEN substr(l.note_des_lower, o.subjective_start + 1, o.subjective_end - o.subjective_start) END AS subjective,
         CASE WHEN o.objective_end > o.objective_start THEN substr(l.note_des_lower, o.objective_start + 1, o.objective_end - o.objective_start) END AS objective,
         CASE WHEN o.assessment_end > o.assessment_start THEN substr(l.note_des_lower, o.assessment_start + 1, o.assessment_end - o.assessment_start) END AS assessment
  FROM low l LEFT JOIN offs o ON l.rid = o.rid
),
cleaned AS (
  SELECT *, {clean('subjective')} AS subjective_clean1, {clean('objective')} AS objective_clean1,
         {clean('assessment')} AS assessment_clean1
  FROM sec
),
subset AS (SELECT * FROM spans WHERE tag IN ({_se})),
pairs AS (
  SELECT c.rid, c.file,
    CASE WHEN c.subjective_start IS NOT NULL AND NOT (s."end" - {SPAN_OFFSET} < c.subjective_start OR c.subjective_end < s."begin" - {SPAN_OFFSET}) THEN 1 ELSE 0 END AS so,
    CASE WHEN c.objective_start IS NOT NULL AND NOT (s."end" - {SPAN_OFFSET} < c.objective_start OR c.objective_end < s."begin" - {SPAN_OFFSET}) THEN 1 ELSE 0 END AS oo,
    CASE WHEN c.assessment_start IS NOT NULL AND NOT (s."end" - {SPAN_OFFSET} < c.assessment_start OR c.assessment_end < s."begin" - {SPAN_OFFSET}) THEN 1 ELSE 0 END AS ao,
    CASE WHEN c.subjective_start IS NULL AND c.objective_start IS NULL AND c.assessment_start IS NULL AND c.SE_inquiry = 1 THEN 1 ELSE 0 END AS io
  FROM cleaned c JOIN subset s ON s.file = split_part(c.file, '.txt', 1) AND s.round = c.round
  WHERE s."begin" IS NOT NULL AND s."end" IS NOT NULL
),
lab AS (
  SELECT rid, greatest(max(so), max(io)) AS subj_label, max(oo) AS obj_label, max(ao) AS asses_label
  FROM pairs GROUP BY rid
),
labeled AS (
  SELECT c.*, coalesce(l.subj_label, 0) AS subj_label, coalesce(l.obj_label, 0) AS obj_label,
         coalesce(l.asses_label, 0) AS asses_label
  FROM cleaned c LEFT JOIN lab l ON c.rid = l.rid
),
stacked AS (
  SELECT xmi, round, split_part(file, '.txt', 1) AS note_id, mrn, 'subjective' AS section, subjective_clean1 AS text, subj_label AS y FROM labeled
  UNION ALL
  SELECT xmi, round, split_part(file, '.txt', 1), mrn, 'objective', objective_clean1, obj_label FROM labeled
  UNION ALL
  SELECT xmi, round, split_part(file, '.txt', 1), mrn, 'assessment', assessment_clean1, asses_label FROM labeled
),
longrows AS (SELECT * FROM stacked WHERE coalesce({ntok('text')}, 0) >= 4),
excl AS (SELECT DISTINCT mrn FROM notes WHERE mrn IS NOT NULL AND CAST(mrn AS BIGINT) % 17 = 0),
trainset AS (
  SELECT xmi, round, note_id, section, text, y, mrn, coalesce(mrn, 'note:' || note_id) AS patient FROM longrows l
  WHERE NOT EXISTS (SELECT 1 FROM excl e WHERE e.mrn = l.mrn)
)
"""


def with_base(select: str) -> str:
    return "WITH " + BASE.strip() + "\n" + select


def _b(*names) -> str:
    return ", ".join(f'CAST("{n}" AS BIGINT) AS "{n}"' for n in names)


_LINES = ("list_filter(regexp_split_to_array(text, '\\r\\n|\\r|\\n'), lambda x: trim(x) <> '')")
_OFFS = ("subjective_start", "subjective_end", "objective_start", "objective_end", "assessment_start",
         "assessment_end", "assessmentplan_start", "assessmentplan_end", "planassessment_start", "planassessment_end")

_RID = "split_part(rid, '/', 1) AS round, split_part(rid, '/', 2) AS xmi"

ORACLE = {
    "note_body": f"SELECT doc_id, split_part({_LINES}[4], chr(9), 1) AS body FROM documents",
    "token_count": f"SELECT doc_id, {ntok('text')} AS n_tokens FROM documents",
    "file_meta": with_base(f"SELECT file, round, mrn, {_b('visit_no', 'length')} FROM notes"),
    "lower_notes": with_base("SELECT file, round, lower(note_des) AS note_des_lower FROM notes"),
    "clean_text": f"SELECT doc_id, {clean('text', cap=MAX_TOKENS)} AS clean FROM documents",
    "clean_conversations": f"SELECT conv_id, turn, {clean('text', cap=MAX_TOKENS)} AS clean FROM conversations",
    "union_rounds": with_base(
        "SELECT file, round, NULL::VARCHAR AS role, length FROM notes UNION ALL "
        f"SELECT CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) || '.txt', 'conversations', role, {ntok('text')} "
        "FROM conversations"),
    "annotation_keys": f"SELECT xmi, round, {NOTE_NAME} AS file, {ANON} AS anon_id FROM ({XMI_SQL.format(documents='documents', labels='labels')})",
    "xmi_fragments": with_base("SELECT xmi, round, CAST(pos AS BIGINT) AS pos, frag AS fragment FROM tagfrags"),
    "xmi_attributes": with_base('SELECT xmi, round, CAST(pos AS BIGINT) AS pos, xmi_id, "begin", "end", tag FROM attrs'),
    "doc_tags": with_base("SELECT xmi, round, array_to_string(tags, ',') AS tags FROM doctags"),
    "annotations_wide": with_base(f"SELECT xmi, file, anon_id, round, array_to_string(other_tags, ',') AS other_tags, {_b(*TAG_VOCAB, 'SE_present', 'SE_absent', 'SE_inquiry')} FROM wide"),
    "se_flags": with_base(f"SELECT xmi, round, {_b('SE_present', 'SE_absent', 'SE_inquiry')} FROM wide"),
    "inquiry_counts": with_base('SELECT CAST(SE_inquiry AS BIGINT) AS SE_inquiry, CAST(count(*) AS BIGINT) AS "count" FROM wide GROUP BY 1'),
    "tag_subset": with_base(f'SELECT round, file, tag, {_b("begin", "end")} FROM subset'),
    "span_rejects": with_base(
        'SELECT tag IS NULL AS no_tag, "begin" IS NULL OR "end" IS NULL AS no_position, count(*) AS n FROM spans '
        'WHERE tag IS NULL OR "begin" IS NULL OR "end" IS NULL GROUP BY 1, 2'),
    "union_wide": with_base(
        f"SELECT xmi, round, CASE WHEN round NOT LIKE '%-b' THEN array_to_string(other_tags, ',') END AS other_tags, {_b(*TAG_VOCAB, 'SE_inquiry')} FROM wide"),
    "union_spans": with_base(f'SELECT round, file, tag, {_b("begin", "end")} FROM spans'),
    "notes_right_join": with_base(
        f"SELECT xmi, file, round, mrn, {_b('visit_no', 'length', 'SE_inquiry')}, note_des IS NOT NULL AS has_note FROM data"),
    "section_route": with_base("SELECT xmi, round, third FROM low"),
    "title_spans": with_base(f"SELECT {_RID}, name AS section_name, {_b('st', 'en').replace('AS \"st\"', 'AS start_title').replace('AS \"en\"', 'AS end_title')} FROM titles"),
    "span_overlap": with_base(
        f"SELECT {_RID}, CAST(1 AS BIGINT) AS k, CAST(o12 AS BIGINT) AS overlap FROM ovl WHERE o12 IS NOT NULL "
        f"UNION ALL SELECT {_RID}, CAST(2 AS BIGINT), CAST(o23 AS BIGINT) FROM ovl WHERE o23 IS NOT NULL"),
    "overlap_resolve": with_base(f"SELECT {_RID}, section_name, {_b('start_title', 'end_title')} FROM kept"),
    "sectionize": with_base(f"SELECT {_RID}, section_name, {_b('start_title', 'end_title', 'start_section', 'end_section')} FROM bounds"),
    "section_bounds": with_base(
        f"SELECT {_RID}, section_name, {_b('start_section', 'end_section')}, CAST(end_section - start_section AS BIGINT) AS n_chars FROM bounds"),
    "section_extract": with_base(
        "SELECT l.round, l.xmi, CAST(row_number() OVER (PARTITION BY b.rid ORDER BY b.start_section) - 1 AS BIGINT) AS idx, "
        "substr(l.note_des_lower, b.start_section + 1, b.end_section - b.start_section) AS text "
        "FROM bounds b JOIN low l ON b.rid = l.rid WHERE b.end_section <> b.start_section"),
    "section_offsets": with_base(f"SELECT xmi, round, {_b(*_OFFS)} FROM sec"),
    "section_assign": with_base("SELECT xmi, round, subjective, objective, assessment FROM sec"),
    "clean_sections": with_base("SELECT xmi, round, subjective_clean1, objective_clean1, assessment_clean1 FROM cleaned"),
    "interval_overlap": with_base(
        f'SELECT DISTINCT c.xmi, c.round, {_b("begin", "end")}, '
        f'CAST(CASE WHEN c.subjective_start IS NOT NULL AND NOT (s."end" - {SPAN_OFFSET} < c.subjective_start OR c.subjective_end < s."begin" - {SPAN_OFFSET}) THEN 1 ELSE 0 END AS BIGINT) AS so, '
        f'CAST(CASE WHEN c.objective_start IS NOT NULL AND NOT (s."end" - {SPAN_OFFSET} < c.objective_start OR c.objective_end < s."begin" - {SPAN_OFFSET}) THEN 1 ELSE 0 END AS BIGINT) AS oo, '
        f'CAST(CASE WHEN c.assessment_start IS NOT NULL AND NOT (s."end" - {SPAN_OFFSET} < c.assessment_start OR c.assessment_end < s."begin" - {SPAN_OFFSET}) THEN 1 ELSE 0 END AS BIGINT) AS ao '
        "FROM sec c JOIN subset s ON s.file = split_part(c.file, '.txt', 1) AND s.round = c.round "
        'WHERE s."begin" IS NOT NULL AND s."end" IS NOT NULL'),
    "label_sections": with_base(f"SELECT xmi, file, round, {_b('subj_label', 'obj_label', 'asses_label')} FROM labeled"),
    "unpivot_sections": with_base("SELECT xmi, round, note_id, mrn, section, text, CAST(y AS BIGINT) AS y FROM stacked"),
    "min_tokens": with_base(f"SELECT xmi, round, note_id, section, {ntok('text')} AS n_tokens, CAST(y AS BIGINT) AS y FROM longrows"),
    "exclude_groups": with_base("SELECT xmi, round, note_id, section, mrn, CAST(y AS BIGINT) AS y FROM trainset"),
}
ORACLE["flagship"] = with_base(
    "SELECT section, CAST(y AS BIGINT) AS y, CAST(count(*) AS BIGINT) AS n_rows, "
    "CAST(count(DISTINCT mrn) AS BIGINT) AS n_patients FROM trainset GROUP BY section, y")


def _title_list(select: str) -> str:
    """Sections of a list of titles: the greedy pass as a walk over each note's numbered titles."""
    listed = ", ".join(f"({i}, '{t}')" for i, t in enumerate(TITLES))
    return "WITH RECURSIVE " + BASE.strip() + f"""
, tl(i, name) AS (VALUES {listed}),
nt AS (SELECT file, round, row_number() OVER () AS nid, lower(note_des) AS low FROM notes),
cand AS (SELECT nid, name, strpos(low, name) - 1 AS st, strpos(low, name) - 1 + length(name) AS en, row_number() OVER (PARTITION BY nid ORDER BY strpos(low, name), i) AS k
  FROM nt, tl WHERE strpos(low, name) > 0),
two AS (SELECT *, lead(st) OVER w AS st2, lead(en) OVER w AS en2 FROM cand WINDOW w AS (PARTITION BY nid ORDER BY k)),
step AS (SELECT nid, k, CASE WHEN st <= en2 AND st2 <= en THEN CASE WHEN en - st >= en2 - st2 THEN k ELSE k + 1 END ELSE k END AS keep,
  CASE WHEN st <= en2 AND st2 <= en THEN k + 2 ELSE k + 1 END AS next FROM two),
walk(nid, k) AS (SELECT nid, 1 FROM step WHERE k = 1 UNION ALL SELECT w.nid, s.next FROM walk w JOIN step s ON s.nid = w.nid AND s.k = w.k),
won AS (SELECT c.nid, c.name, c.st, c.en, c.k FROM walk w JOIN step s ON s.nid = w.nid AND s.k = w.k JOIN cand c ON c.nid = s.nid AND c.k = s.keep),
secs AS (SELECT nt.file, nt.round, won.*, coalesce(lead(st) OVER (PARTITION BY won.nid ORDER BY won.k), length(nt.low)) AS fin, nt.low FROM won JOIN nt USING (nid))
""" + select


ORACLE["title_list"] = _title_list("SELECT file, round, name AS section_name, CAST(st AS BIGINT) AS start_title, CAST(en AS BIGINT) AS end_title, CAST(en AS BIGINT) AS start_section, CAST(fin AS BIGINT) AS end_section FROM secs")
ORACLE["title_list_extract"] = _title_list(
    "SELECT file, round, CAST(row_number() OVER (PARTITION BY nid ORDER BY k) - 1 AS BIGINT) AS idx, substr(low, CAST(en AS BIGINT) + 1, CAST(greatest(fin - en, 0) AS BIGINT)) AS text FROM secs "
    f"WHERE name IN ({', '.join(repr(t) for t in TAKEN)})")


def _hash_int(expr: str) -> str:
    return f"CAST(('0x' || substr(md5({expr}), 1, 8)) AS BIGINT)"


FOLD_CTE = f"""
, gcc AS (SELECT patient, count(*) AS n, sum(y) AS pos FROM trainset GROUP BY patient),
gh AS (SELECT *, md5('22:' || patient) AS h, CASE WHEN pos > 0 THEN 1 ELSE 0 END AS stratum FROM gcc),
gr AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY pos DESC, n DESC, h, patient) - 1 AS r FROM gh),
folds AS (SELECT patient, n, pos, CAST(CASE WHEN (r // 5) % 2 = 0 THEN r % 5 ELSE 4 - r % 5 END AS INTEGER) AS fold FROM gr),
splits AS (
  SELECT t.*, f.fold, CASE f.fold WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split
  FROM trainset t JOIN folds f ON t.patient = f.patient
),
scored AS (SELECT *, {_hash_int("round || ':' || xmi || ':' || section")} / 4294967295.0 AS score FROM splits),
notescored AS (SELECT split, round, xmi, max(y) AS y, max(score) AS score FROM scored GROUP BY split, round, xmi)
"""


def with_folds(select: str) -> str:
    return "WITH " + BASE.strip() + FOLD_CTE + select


def _auc(src: str) -> str:
    return f"""
, ps AS (SELECT split, score, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS p, sum(CASE WHEN y = 1 THEN 0 ELSE 1 END) AS n
         FROM {src} GROUP BY split, score),
pw AS (SELECT *, sum(n) OVER (PARTITION BY split ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS below FROM ps)
SELECT split, round(sum(p * (below + 0.5 * n)) / nullif(sum(p) * sum(n), 0), 6) AS auc FROM pw GROUP BY split
"""


_VEC = """
, vecs AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS place, embedding FROM embeddings),
tok AS (
  SELECT xmi, round, section, unnest(list_filter(regexp_split_to_array(text, '{ws}+'), lambda w: w <> '')) AS token
  FROM trainset
),
tid AS (SELECT xmi, round, section, {h} % (SELECT count(*) FROM embeddings) AS place, count(*) AS c FROM tok GROUP BY ALL),
pooled AS (
  SELECT t.xmi, t.round, t.section, d.i - 1 AS dim, sum(t.c * CAST(v.embedding[d.i] AS DOUBLE)) AS value
  FROM tid t JOIN vecs v ON t.place = v.place, range(1, 65) d(i)
  GROUP BY t.xmi, t.round, t.section, d.i
)
""".format(ws=WS, h=_hash_int("token"))

_SPLIT_COUNTS = """
, sc AS (SELECT split, count(*) AS n, sum(y) AS n_case FROM splits GROUP BY split),
pc AS (SELECT split, count(*) AS n_pa, sum(y) AS n_case_pa FROM (SELECT split, round, xmi, max(y) AS y FROM splits GROUP BY ALL) GROUP BY split)
"""
_GATE = """
, gate AS (SELECT abs(sum(CASE WHEN split = 'test' THEN y ELSE 0 END) - sum(CASE WHEN split = 'val' THEN y ELSE 0 END)) < 10 AS passed FROM splits)
"""
_GRID = {k: v[0] for k, v in PARAM_GRID.items()}
_COUNTS = ", ".join(f"CAST(coalesce(max(CASE WHEN sc.split = '{split}' THEN {col} END), 0) AS BIGINT) AS {name}_{split}{pa}"
                    for name, col, pa in (("n", "n", ""), ("n", "n_pa", "_pa"), ("n_case", "n_case", ""), ("n_case", "n_case_pa", "_pa"))
                    for split in ("train", "val", "test"))

ORACLE.update({
    "group_class_counts": with_base("SELECT patient, CAST(count(*) AS BIGINT) AS n, CAST(sum(y) AS BIGINT) AS pos FROM trainset GROUP BY patient"),
    "group_folds": with_folds(f"SELECT patient, {_b('fold', 'n', 'pos')} FROM folds"),
    "split_assign": with_folds(f"SELECT xmi, round, note_id, section, mrn, {_b('y', 'fold')}, split FROM splits"),
    "balance_gate": with_folds(
        "SELECT CAST(sum(CASE WHEN split = 'test' THEN y ELSE 0 END) AS BIGINT) AS pos_test, "
        "CAST(sum(CASE WHEN split = 'val' THEN y ELSE 0 END) AS BIGINT) AS pos_val, "
        "abs(sum(CASE WHEN split = 'test' THEN y ELSE 0 END) - sum(CASE WHEN split = 'val' THEN y ELSE 0 END)) < 10 AS passed FROM splits"),
    "note_truth": with_folds("SELECT split, xmi, round, CAST(max(y) AS BIGINT) AS y FROM splits GROUP BY split, xmi, round"),
    "note_scores": with_folds("SELECT split, xmi, round, CAST(y AS BIGINT) AS y, round(score, 6) AS score FROM notescored"),
    "split_counts": with_folds(
        _SPLIT_COUNTS + "SELECT sc.split, CAST(sc.n AS BIGINT) AS n, CAST(sc.n_case AS BIGINT) AS n_case, CAST(pc.n_pa AS BIGINT) AS n_pa, "
        "CAST(pc.n_case_pa AS BIGINT) AS n_case_pa FROM sc JOIN pc ON sc.split = pc.split"),
    "auc_section": with_folds(_auc("scored")),
    "auc_note": with_folds(_auc("notescored")),
    "fit_metrics": with_folds(
        _auc("scored").replace("SELECT split, round(", ", au AS (SELECT split, round(", 1).rstrip() + "), fm AS (SELECT split, count(*) AS n, "
        "sum(CASE WHEN score > 0.5 AND y = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN score > 0.5 AND y = 0 THEN 1 ELSE 0 END) AS fp, "
        "sum(CASE WHEN score <= 0.5 AND y = 1 THEN 1 ELSE 0 END) AS fn, "
        "sum(CASE WHEN (score > 0.5 AND y = 1) OR (score <= 0.5 AND y = 0) THEN 1 ELSE 0 END) AS correct FROM scored GROUP BY split) "
        "SELECT fm.split, CAST(n AS BIGINT) AS n, CAST(tp AS BIGINT) AS tp, round(correct / n, 6) AS accuracy, "
        "round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, auc FROM fm JOIN au ON fm.split = au.split"),
    "sum_pool": with_base(_VEC + "SELECT xmi, round, section, CAST(dim AS BIGINT) AS dim, round(value, 5) + 0.0 AS value FROM pooled"),
    "embed_texts": with_base(
        _VEC + ", tot AS (SELECT xmi, round, section, sum(value) AS s FROM pooled GROUP BY xmi, round, section) "
        f"SELECT t.xmi, t.round, t.note_id, t.section, t.mrn, CAST(t.y AS BIGINT) AS y, {ntok('t.text')} AS n_tokens, "
        "round(coalesce(tot.s, 0), 4) + 0.0 AS feature_sum FROM trainset t LEFT JOIN tot ON t.xmi = tot.xmi AND t.round = tot.round AND t.section = tot.section"),
    "cooccurrence": with_base(
        f", wl AS (SELECT row_number() OVER () AS rid, {toks('text')} AS w FROM trainset), "
        "wp AS (SELECT rid, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS i FROM wl), "
        "near AS (SELECT x.t AS a, y.t AS b FROM wp x JOIN wp y ON x.rid = y.rid AND y.i - x.i BETWEEN 1 AND 4), "
        "cc AS (SELECT a, b, count(*) AS n FROM (SELECT a, b FROM near UNION ALL SELECT b, a FROM near) GROUP BY a, b), "
        "cs AS (SELECT a, sum(n) AS s FROM cc GROUP BY a), tot AS (SELECT sum(s) AS total FROM cs), "
        "pm AS (SELECT cc.a, cc.b, cc.n, ln(cc.n * CAST(total AS DOUBLE) / (CAST(x.s AS DOUBLE) * CAST(y.s AS DOUBLE))) AS v FROM cc JOIN cs x ON x.a = cc.a JOIN cs y ON y.a = cc.b, tot) "
        "SELECT a AS word_a, b AS word_b, CAST(n AS BIGINT) AS n, round(v, 6) AS ppmi FROM pm WHERE v > 0"),
    "performance_counts": with_folds(
        _SPLIT_COUNTS + _GATE + f"SELECT '{_GRID['model_type']}' AS model_type, CAST({_GRID['lr']} AS DOUBLE) AS lr, CAST({_GRID['batch_size']} AS BIGINT) AS batch_size, "
        f"CAST({_GRID['dense_node']} AS BIGINT) AS dense_node, CAST(0 AS BIGINT) AS seed, CAST(22 AS BIGINT) AS random_number, CAST({_GRID['do']} AS DOUBLE) AS \"do\", "
        f"CAST(e.epoch AS BIGINT) AS epoch, {_COUNTS} FROM sc JOIN pc ON sc.split = pc.split, gate, range(0, {_GRID['epochs']}) e(epoch) WHERE gate.passed GROUP BY e.epoch"),
    "running_metrics": with_folds(
        ", thr AS (SELECT i, CASE i WHEN 0 THEN -1e-7 WHEN 199 THEN 1 + 1e-7 ELSE CAST(i AS DOUBLE) / 199 END AS t FROM range(0, 200) r(i)), "
        "pts AS (SELECT split, i, count(*) FILTER (score > t AND y = 1) AS tp, count(*) FILTER (score > t AND y <> 1) AS fp FROM scored, thr GROUP BY split, i), "
        "area AS (SELECT *, (fp - lead(fp) OVER w) * (tp + lead(tp) OVER w) / 2 AS a FROM pts WINDOW w AS (PARTITION BY split ORDER BY i)), "
        "au AS (SELECT split, sum(a) / nullif(max(tp) * max(fp), 0) AS auc FROM area GROUP BY split), "
        "fm AS (SELECT split, count(*) AS n, count(*) FILTER (score > 0.5 AND y = 1) AS tp, count(*) FILTER (score > 0.5) AS pp, count(*) FILTER (y = 1) AS p, "
        "count(*) FILTER ((score > 0.5) = (y = 1)) AS correct FROM scored GROUP BY split) "
        "SELECT fm.split, round(correct / n, 6) AS accuracy, round(tp / nullif(pp, 0), 6) AS precision, round(tp / nullif(p, 0), 6) AS recall, round(auc, 6) AS auc FROM fm JOIN au USING (split)"),
    "split_search": with_folds(
        ", every AS (SELECT g.*, s.seed, md5(CAST(s.seed AS VARCHAR) || ':' || patient) AS hh, CASE WHEN pos > 0 THEN 1 ELSE 0 END AS st FROM gcc g, range(20, 40) s(seed)), "
        "place AS (SELECT *, row_number() OVER (PARTITION BY seed, st ORDER BY pos DESC, n DESC, hh, patient) - 1 AS r FROM every), "
        "dealt AS (SELECT seed, pos, CASE WHEN (r // 5) % 2 = 0 THEN r % 5 ELSE 4 - r % 5 END AS fold FROM place) "
        "SELECT CAST(seed AS BIGINT) AS random_number, CAST(sum(CASE WHEN fold = 0 THEN pos ELSE 0 END) AS BIGINT) AS pos_test, CAST(sum(CASE WHEN fold = 1 THEN pos ELSE 0 END) AS BIGINT) AS pos_val, "
        "abs(sum(CASE WHEN fold = 0 THEN pos ELSE 0 END) - sum(CASE WHEN fold = 1 THEN pos ELSE 0 END)) < 10 AS passed FROM dealt GROUP BY seed"),
    "score_rows": with_folds(_GATE + "SELECT xmi, round, note_id, section, split, CAST(y AS BIGINT) AS y FROM splits, gate WHERE gate.passed"),
})
