"""Structured Streaming over arriving note files.

The reference is batch only.  Everything from file scan to cleaned sections is row-local, so
the same column functions run unchanged on a file stream.  Labels need the annotation spans
and a max per note; ``foreachBatch`` applies the batch operators to each micro-batch (a
right join of the batch's names: a note is labelled when it arrives, against the annotation rows that
are staged once, before the stream starts; a note that arrives before its annotation is written with
NULL labels; ``label_state`` labels it when the annotation comes).
Checkpoint locations default to a folder under the session's ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import note_body
from ..operators import annotations as A
from ..operators import labels as L
from ..operators import notes as N
from ..session import ensure_checkpoint_dir, stage


def note_file_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Stream of ``file, round, note_des`` from ``*.txt`` files arriving under ``path``."""
    reader = (spark.readStream.format("text").option("wholetext", "true")
              .option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true"))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    raw = reader.load(path)
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    folders = F.split(F.col("_metadata.file_path"), "/")
    return raw.select(name.alias("file"), F.get(folders, F.size(folders) - 2).alias("round"), note_body(F.col("value")).alias("note_des"))


def xmi_file_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Stream of ``xmi, round, content`` (the first line) from ``*.xmi`` files arriving under ``path``."""
    reader = (spark.readStream.format("text").option("wholetext", "true")
              .option("pathGlobFilter", "*.xmi").option("recursiveFileLookup", "true"))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    folders = F.split(F.col("_metadata.file_path"), "/")
    first_line = F.get(F.split(F.col("value"), r"\r\n|\r|\n"), 0)
    return reader.load(path).select(name.alias("xmi"), F.get(folders, F.size(folders) - 2).alias("round"), first_line.alias("content"))


def sectioned_stream(notes: DataFrame) -> DataFrame:
    """Notes table, sections and cleaned texts on a stream (no state, no shuffle)."""
    return N.clean_sections(N.add_sections(N.notes_table(notes)))


def checkpoint_folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex[:8]}"


def write_sections(stream: DataFrame, out_path: str, checkpoint: str | None = None, available_now: bool = True):
    """Append cleaned sections to parquet; ``available_now`` processes what is there and stops."""
    spark = stream.sparkSession
    writer = (stream.writeStream.format("parquet").outputMode("append")
              .option("checkpointLocation", checkpoint or checkpoint_folder(spark, "sections")))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start(out_path)


def label_batches(stream: DataFrame, xmi_docs: DataFrame, out_path: str, checkpoint: str | None = None,
                  available_now: bool = True):
    """Label each micro-batch of notes against the annotation documents; one parquet folder per batch."""
    annotated = stage(L.with_label_spans(A.annotations_wide(xmi_docs), A.tag_subset(A.spans(xmi_docs))))

    def handle(batch: DataFrame, batch_id: int) -> None:
        notes = A.with_round(N.notes_table(batch))
        columns = [c for c in annotated.columns if c not in notes.columns]
        joined = notes.join(annotated.select(*L.NOTE_KEY, *columns), list(L.NOTE_KEY), "left")
        labelled = L.label_sections(N.clean_sections(N.add_sections(joined)))
        for name in ("subj_label", "obj_label", "asses_label"):
            labelled = labelled.withColumn(name, F.when(F.col("xmi").isNotNull(), F.col(name)))
        # one folder per micro-batch, overwritten on a retry: a re-run batch never duplicates rows
        (labelled.select("xmi", "round", "file", "mrn", "subjective_clean1", "objective_clean1", "assessment_clean1",
                         "subj_label", "obj_label", "asses_label")
         .write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/batch_id={batch_id}"))

    spark = stream.sparkSession
    writer = stream.writeStream.foreachBatch(handle).option(
        "checkpointLocation", checkpoint or checkpoint_folder(spark, "labels"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
