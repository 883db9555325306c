"""Note files and annotation documents derived from the given tables.

The reference reads private note files and XMI annotation files.  For tests and benches the
same shapes are derived from ``documents`` (every note holds a whole document text, split over
the sections that it has) and ``labels`` (one annotation document for every labelled document).
The SQL below is plain enough that Spark and DuckDB run the same text; ``{documents}`` and
``{labels}`` name the inputs.

What the rows cover (FIXTURES.md §2): names that occur in two rounds, notes without a patient id,
annotations without a note, documents without tags, without side-effect tags, with tags outside
the vocabulary, with positions of seven digits and without a position, and notes whose titles
touch in every way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.vocab import TAG_VOCAB

# Third title by doc_id mod 3.
_THIRD = "CASE mod(doc_id, 3) WHEN 0 THEN 'Assessment' WHEN 1 THEN 'Assessment and Plan' ELSE 'Plan and Assessment' END"

# Section orders by doc_id mod 18; 0 has no title, 12 an empty last section, 13 titles inside a phrase but no third
# title, 14 to 17 titles that touch (first longer, second longer, the last pair both ways).
_ORDERS = ["A", "OA", "AO", "SA", "AS", "AOS", "ASO", "SAO", "OSA", "OAS", "SOA"]

# Every tenth document shares the file name of the one before, in another round; one in 97 names has no patient id.
_NAME_KEY = "CASE WHEN mod(doc_id, 10) = 3 THEN doc_id - 1 ELSE doc_id END"
_ROUND = "concat(coalesce(source, 'none'), CASE WHEN mod(doc_id, 10) = 3 THEN '-b' ELSE '' END)"
_STEM = ("CASE WHEN mod(k, 97) = 5 THEN concat('nopatient', cast(k AS string)) ELSE "
         "concat(cast(cast(floor(k / 3) AS bigint) AS string), '_', cast(mod(k, 3) AS string)) END")


def _part(j: int, n: int) -> str:
    """Part j of n of the text."""
    at = [f"cast(floor(n * {i} / {n}) AS bigint)" for i in (j, j + 1)]
    return f"substr(text, {at[0]} + 1, {at[1]} - {at[0]})"


def _note_case() -> str:
    title = {"S": "'Subjective'", "O": "'Objective'", "A": _THIRD}
    parts = ["WHEN 0 THEN text"]
    for i, order in enumerate(_ORDERS, start=1):
        pieces = ", ".join(f"{title[c]}, ': ', {_part(j, len(order))}, ' '" for j, c in enumerate(order))
        parts.append(f"WHEN {i} THEN concat('note ', {pieces})")
    parts.append(f"WHEN 12 THEN concat('note Subjective: ', {_part(0, 2)}, ' Objective: ', {_part(1, 2)}, ' ', {_THIRD})")
    parts.append("WHEN 13 THEN concat('Subjective and objective findings: ', text)")
    for i, touching in ((14, "SubjectiveObjective"), (15, "ObjectiveSubjective")):
        parts.append(f"WHEN {i} THEN concat('{touching}: ', {_part(0, 2)}, ' ', {_THIRD}, ': ', {_part(1, 2)})")
    for i, touching in ((16, "ObjectiveAssessment and Plan"), (17, "Plan and AssessmentObjective")):
        parts.append(f"WHEN {i} THEN concat('Subjective: ', {_part(0, 2)}, ' {touching}: ', {_part(1, 2)})")
    return "CASE mod(doc_id, 18) " + " ".join(parts) + " END"


NOTES_SQL = f"""
WITH d AS (
  SELECT doc_id, {_ROUND} AS round, coalesce(text, '') AS text, cast(length(coalesce(text, '')) AS bigint) AS n,
         {_NAME_KEY} AS k
  FROM {{documents}}
)
SELECT concat({_STEM}, '.txt') AS file, round, {_note_case()} AS note_des
FROM d
"""


def _tag_case(code: str) -> str:
    whens = " ".join(f"WHEN {i} THEN '{tag}'" for i, tag in enumerate(TAG_VOCAB))
    return f"CASE {code} {whens} END"


def _tag(xmi_id: str, begin: str, end: str, tag: str) -> str:
    return (f"concat('<x:Tag xmi:id=\"', cast({xmi_id} AS string), '\" begin=\"', cast({begin} AS string), '\" end=\"', "
            f"cast({end} AS string), '\" semanticTag=\"', {tag}, '\"/>')")


def _element(i: int) -> str:
    code = f"mod(doc_id * 7 + {i * 5} + coalesce(quality, 0) * 3 + coalesce(toxic, 0), 13)"
    begin = f"(69 + mod(doc_id * 37 + {i * 1009}, greatest(n_chars, 1)))"
    end = f"({begin} + 1 + mod(doc_id + {13 * i}, 40))"
    return f"CASE WHEN {code} < {len(TAG_VOCAB)} THEN {_tag(f'mod(doc_id * 3 + {i}, 99999)', begin, end, _tag_case(code))} ELSE '' END"


# Elements by doc_id mod 9: 0 none, 1 one tag that is no side effect, 2 a tag outside the vocabulary, 3 positions of
# seven digits, 4 no begin, else up to three of the vocabulary.
_ELEMENTS = f"""CASE mod(doc_id, 9) WHEN 0 THEN ''
    WHEN 1 THEN {_tag('doc_id', '90', '95', _tag_case('6 + mod(doc_id, 5)'))}
    WHEN 2 THEN concat({_element(0)}, {_tag('doc_id', '80', '81', "'Unlisted_Tag'")})
    WHEN 3 THEN concat({_element(0)}, {_tag('12345678', '1000000 + mod(doc_id, 1000)', '1000001 + mod(doc_id, 1000)', "'SE_other'")})
    WHEN 4 THEN concat({_element(0)}, '<x:Tag xmi:id="3" end="88" semanticTag="SE_psych"/>')
    ELSE concat({_element(0)}, {_element(1)}, {_element(2)}) END"""

XMI_SQL = f"""
WITH a AS (
  SELECT l.doc_id, l.quality, l.toxic, {_ROUND.replace('doc_id', 'l.doc_id')} AS round, coalesce(d.n_chars, 0) AS n_chars,
         {_NAME_KEY.replace('doc_id', 'l.doc_id')} AS k
  FROM {{labels}} l JOIN {{documents}} d ON l.doc_id = d.doc_id
)
SELECT concat(CASE WHEN mod(doc_id, 23) = 7 THEN concat('lost', cast(doc_id AS string), '_1') ELSE {_STEM} END, '.xmi') AS xmi,
       round,
       concat('<?xml version="1.0" encoding="UTF-8"?><x:XMI xmi:version="2.0"><cas:Sofa xmi:id="1" sofaNum="1"/>',
              {_ELEMENTS}, '</x:XMI>') AS content
FROM a
"""


def notes_source(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """Raw note files: ``file, round, note_des`` (note body already picked)."""
    return spark.sql(NOTES_SQL, documents=documents)


def xmi_source(spark: SparkSession, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Raw annotation documents: ``xmi, round, content`` (first physical line)."""
    return spark.sql(XMI_SQL, documents=documents, labels=labels)
