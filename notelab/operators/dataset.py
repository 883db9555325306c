"""Training-set shaping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text, file_stem, token_count
from ..functions.vocab import ENGLISH_STOP_WORDS, MIN_TOKENS

_STACK = (("subjective", "subjective_clean1", "subj_label"),
          ("objective", "objective_clean1", "obj_label"),
          ("assessment", "assessment_clean1", "asses_label"))
#: What tells a training row from every other: the annotation document, its round, and the section.
ROW_KEY = ("xmi", "round", "section")


def unpivot_sections(labeled: DataFrame, raw_texts: bool = False) -> DataFrame:
    """One row per (note, section) with ``xmi, round, note_id, mrn, section, text, y``.

    ``raw_texts`` stacks the uncleaned section texts (``subjective`` ...) instead of the
    cleaned ones (``subjective_clean1`` ...).
    """
    rows = F.array(*[F.struct(F.lit(name).alias("section"), F.col(name if raw_texts else text).alias("text"),
                              F.col(label).alias("y"))
                     for name, text, label in _STACK])
    return labeled.select("xmi", "round", file_stem(F.col("file")).alias("note_id"), "mrn", F.inline(rows))


def min_tokens(df: DataFrame, n: int = MIN_TOKENS) -> DataFrame:
    """keep texts with at least ``n`` whitespace tokens; NULL text is dropped."""
    return df.where(F.coalesce(token_count(F.col("text")), F.lit(0)) >= n)


def exclude_groups(df: DataFrame, exclusions: DataFrame, key: str = "mrn") -> DataFrame:
    """Drop rows whose group is listed (anti-join; a NULL key is never excluded)."""
    return df.join(exclusions.select(key), key, "left_anti")


def training_set(labeled: DataFrame, exclusions: DataFrame | None = None, n: int = MIN_TOKENS,
                 stop_words=ENGLISH_STOP_WORDS, max_tokens: int | None = None) -> DataFrame:
    """U3, J3, P22, F3 with columns ``xmi, round, note_id, section, text, y, mrn``.

    The raw section texts are stacked, excluded patients leave before any text is cleaned (J3
    reads no text, so it commutes with F3), and one cleaning expression runs on what is left.
    """
    rows = unpivot_sections(labeled, raw_texts=True)
    if exclusions is not None:
        rows = exclude_groups(rows, exclusions)
    rows = min_tokens(rows.withColumn("text", clean_text("text", stop_words, max_tokens, already_lower=True)), n)
    return rows.select("xmi", "round", "note_id", "section", "text", "y", "mrn")
