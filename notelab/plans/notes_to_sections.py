"""Files -> labelled, cleaned sections and the training set (§3.2).

Physical shape: the annotation side is slim (tags, flags, label spans; no text) and is staged once.
Notes are semi-joined to its names, which are broadcast if their measured size allows, so that
texts of unannotated notes then stay out of the one shuffle of texts, the join on (round, file).
Sections, labels and cleaning are projections on its output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import annotations as A
from ..operators import dataset as DS
from ..operators import labels as L
from ..operators import notes as N
from ..session import stage, table
from ..sources.derived import notes_source, xmi_source


def raw_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Raw note rows and annotation documents derived from the given tables."""
    documents = table(spark, sf_dir, "documents")
    return notes_source(spark, documents), xmi_source(spark, documents, table(spark, sf_dir, "labels"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, _ = raw_inputs(spark, sf_dir)
    return N.notes_table(raw)


def joined_notes(notes_df: DataFrame, xmi_docs: DataFrame, strict_stem: bool = False) -> DataFrame:
    """J1 on the notes of annotated names and the staged annotation rows with their label spans.

    The semi-join filters by a table whose size the planner knows: small, it is broadcast and no
    unannotated text is shuffled; large, both joins use the same key.
    """
    spans = A.tag_subset(A.spans(xmi_docs, strict_stem))
    annotated = stage(L.with_label_spans(A.annotations_wide(xmi_docs), spans))
    known = A.with_round(notes_df).join(annotated.select(*L.NOTE_KEY).distinct(), list(L.NOTE_KEY), "left_semi")
    return L.notes_right_join(known, annotated)


def labelled(notes_df: DataFrame, xmi_docs: DataFrame, clean: bool = True, strict_stem: bool = False) -> DataFrame:
    """Sectioned, labelled (and cleaned) note rows: the reference's working table ``data``."""
    data = L.label_sections(N.add_sections(joined_notes(notes_df, xmi_docs, strict_stem)))
    out = data.drop("assessmentplan_start", "assessmentplan_end", "planassessment_start", "planassessment_end")
    return N.clean_sections(out) if clean else out


def labelled_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, xmi_docs = raw_inputs(spark, sf_dir)
    return labelled(N.notes_table(raw), xmi_docs)


def exclusions_from_notes(notes_df: DataFrame, modulus: int = 17) -> DataFrame:
    """Test exclusion list: patients whose id is divisible by ``modulus``."""
    mrn = F.col("mrn")
    return notes_df.select(mrn).where(mrn.isNotNull() & (F.pmod(mrn.cast("bigint"), F.lit(modulus)) == 0)).distinct()


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled raw sections, stacked, without excluded patients, cleaned."""
    raw, xmi_docs = raw_inputs(spark, sf_dir)
    notes_df = N.notes_table(raw)
    return DS.training_set(labelled(notes_df, xmi_docs, clean=False), exclusions_from_notes(notes_df))


# ---------------------------------------------------------------- the same plan over note / annotation files

def inputs_from_files(spark: SparkSession, note_paths, xmi_paths) -> tuple[DataFrame, DataFrame]:
    """Note files (``*.txt``) and annotation files (``*.xmi``) under one or more folders."""
    from ..sources.files import scan_notes, scan_xmi
    return scan_notes(spark, note_paths), scan_xmi(spark, xmi_paths)


def labelled_from_files(spark: SparkSession, note_paths, xmi_paths, clean: bool = True) -> DataFrame:
    raw, xmi_docs = inputs_from_files(spark, note_paths, xmi_paths)
    return labelled(N.notes_table(raw), xmi_docs, clean=clean)


def training_rows_from_files(spark: SparkSession, note_paths, xmi_paths,
                             exclusions: DataFrame | None = None) -> DataFrame:
    """Files -> training rows ``xmi, round, note_id, section, text, y, mrn`` (exclusions: one ``mrn`` column).

    Notes and annotations meet within a round: the folder that holds a note and the folder that
    holds its annotations must have the same name.
    """
    return DS.training_set(labelled_from_files(spark, note_paths, xmi_paths, clean=False), exclusions)


def export_spans(spark: SparkSession, xmi_paths, out_path: str) -> None:
    """Every annotation span (``round, file, tag, begin, end``) as CSV."""
    from ..sources.files import scan_xmi, write_csv
    write_csv(A.spans(scan_xmi(spark, xmi_paths)), out_path)
