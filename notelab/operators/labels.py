"""Joins that attach annotations and labels to notes.

Notes and annotations meet on (round, file); every copy of a note in every round keeps its row.
The side-effect spans of a note are brought to its annotation row first, as one array of distinct
positions per (round, stem): that join is slim.  After the one join that moves texts (J1), sections
and labels are row-local.

An array holds the distinct (begin, end) pairs of one note, so its size is bound by the note's
positions, not by the number of annotation rows: repeated spans collapse before the shuffle, and a
stem with a third of all span rows costs one array per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import file_stem
from ..functions.vocab import SECTION_NAMES, SPAN_OFFSET
from .annotations import with_round

NOTE_KEY = ("round", "file")


def with_label_spans(annotations: DataFrame, span_subset: DataFrame) -> DataFrame:
    """J2's spans by note stem: adds ``label_spans``, the distinct positions of the note's side-effect spans."""
    usable = span_subset.where(F.col("begin").isNotNull() & F.col("end").isNotNull())
    by_stem = (usable.groupBy("round", F.col("file").alias("_stem"))
               .agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("label_spans")))
    keyed = annotations.withColumn("_stem", file_stem(F.col("file")))
    return keyed.join(by_stem, ["round", "_stem"], "left").drop("_stem")


def notes_right_join(notes: DataFrame, annotations: DataFrame) -> DataFrame:
    """Every annotation document keeps its row, once per copy of its note; notes without one drop out.

    Planned as a sort-merge join on (round, file); AQE splits a name with many rows.
    """
    notes = with_round(notes)
    note_cols = [c for c in notes.columns if c not in annotations.columns]
    return notes.select(*NOTE_KEY, *note_cols).hint("merge").join(annotations, list(NOTE_KEY), "right")


def label_sections(sectioned: DataFrame, offset: int = SPAN_OFFSET) -> DataFrame:
    """J2 + J4 + A4: ``subj_label, obj_label, asses_label`` on every note row.

    A span labels a section when its shifted closed interval touches or overlaps the
    section's.  An unsectioned note gets ``subj_label = 1`` when its document has the
    inquiry flag and at least one side-effect span.
    """
    def touched(name: str) -> str:
        return (f"CASE WHEN {name}_start IS NULL THEN 0 ELSE CAST(exists(label_spans, s -> NOT (s.end - {offset} < {name}_start "
                f"OR {name}_end < s.begin - {offset})) AS INT) END")
    unsectioned = " AND ".join(f"{name}_start IS NULL" for name in SECTION_NAMES)
    inquiry = f"CAST({unsectioned} AND SE_inquiry = 1 AND size(label_spans) > 0 AS INT)"
    flags = {"subj_label": f"greatest({touched('subjective')}, {inquiry})", "obj_label": touched("objective"), "asses_label": touched("assessment")}
    return sectioned.withColumns({k: F.coalesce(F.expr(v), F.lit(0)) for k, v in flags.items()}).drop("label_spans")
