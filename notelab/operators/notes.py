"""Note-side operators: the notes table (P1-P3), sectioning (P8, P14-P19) and cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sections as S
from ..functions.text import clean_text, lower_text, mrn_from_file, token_count, visit_from_file
from ..functions.vocab import ENGLISH_STOP_WORDS, SECTION_NAMES

OFFSET_COLUMNS = (
    "subjective_start", "subjective_end", "objective_start", "objective_end", "assessment_start",
    "assessment_end", "assessmentplan_start", "assessmentplan_end", "planassessment_start", "planassessment_end",
)


def notes_table(raw: DataFrame) -> DataFrame:
    """``file, note_des`` (+ any extra columns) -> adds ``length, mrn, visit_no``."""
    return raw.withColumns({
        "length": token_count(F.col("note_des")),
        "mrn": mrn_from_file(F.col("file")),
        "visit_no": visit_from_file(F.col("file")),
    })


def add_sections(df: DataFrame, text_col: str = "note_des") -> DataFrame:
    """Lower-cased note, section array, ten offset columns and three texts.

    The section array is projected once; offsets and texts read from it.  Unsectioned notes
    put the whole lower-cased note under ``subjective``.
    """
    lowered = df.withColumn("note_des_lower", lower_text(F.col(text_col)))
    with_secs = S.with_sections(lowered, "note_des_lower")
    offs = S.offset_sql("sections")
    with_offs = with_secs.withColumns({k: F.expr(offs[k]) for k in OFFSET_COLUMNS})
    texts = {name: F.expr(f"nullif(substr(note_des_lower, {name}_start + 1, {name}_end - {name}_start), '')")
             for name in SECTION_NAMES}
    texts["subjective"] = F.expr("CASE WHEN size(sections) = 0 THEN note_des_lower ELSE "
                                 "nullif(substr(note_des_lower, subjective_start + 1, subjective_end - subjective_start), '') END")
    return with_offs.withColumns(texts)


def clean_sections(df: DataFrame, stop_words=ENGLISH_STOP_WORDS, max_tokens: int | None = None) -> DataFrame:
    """Cleaned copy of each section text."""
    return df.withColumns({f"{name}_clean1": clean_text(name, stop_words, max_tokens, already_lower=True)
                          for name in SECTION_NAMES})
