"""Labels when notes and annotations arrive in any order (S4, J1, J2): keyed state on a stream.

Both kinds of files are one stream of slim rows, keyed by round and anonymous id (the name up to its first ``-``): a note brings
its section offsets, an annotation document its flag and its side-effect spans.  No text enters the state; cleaned texts are
written by ``notes_stream.write_sections``.  A key's state holds what has come so far; whenever more comes, the labels of all
its annotation documents are emitted again with the next version, and ``latest_labels`` reads each key's last version:
the rows that the batch plan gives over all files, whatever their order.

A key's state is as large as its notes' names and offsets and its documents' distinct spans.  Names hold ``.txt`` once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import xmi as X
from ..functions.text import file_stem
from ..functions.vocab import SE_TAGS, SECTION_NAMES, SPAN_OFFSET
from ..operators import annotations as A
from ..operators import notes as N
from ..session import reachable
from .notes_stream import checkpoint_folder

_OFFSETS = [f"{name}_{side}" for name in SECTION_NAMES for side in ("start", "end")]
LABELS = ("subj_label", "obj_label", "asses_label")
OUT = "round string, key string, version long, xmi string, file string, " + ", ".join(f"{c} int" for c in LABELS)


def _slim(key: Column, note: Column, document: Column) -> list[Column]:
    text = F.lit(None).cast("string")
    return [F.col("round"), key.alias("key"), F.coalesce(note, text).alias("note"), F.coalesce(document, text).alias("document")]


def note_rows(notes: DataFrame) -> DataFrame:
    """``round, key, note, document``: a note's name and the offsets of its sections as JSON."""
    own = F.to_json(F.struct("file", F.array(*_OFFSETS).alias("offsets")), {"ignoreNullFields": "false"})
    return N.add_sections(A.with_round(notes)).select(_slim(F.substring_index(file_stem(F.col("file")), "-", 1), own, F.lit(None)))


def document_rows(docs: DataFrame) -> DataFrame:
    """``round, key, note, document``: an annotation document's flag and the distinct positions of its side-effect spans as JSON."""
    spans = F.transform(X.tag_fragments(F.col("content")), lambda f: F.struct(X.semantic_tag(f).alias("tag"), F.array(X.begin(f).try_cast("bigint"), X.end(f).try_cast("bigint")).alias("at")))
    usable = F.filter(spans, lambda s: s["tag"].isin(*SE_TAGS) & s["at"][0].isNotNull() & s["at"][1].isNotNull())
    tagged = A.with_keys(A.with_round(docs)).withColumn("_tags", F.expr(X.doc_tags_sql()))
    own = F.to_json(F.struct("xmi", "file", file_stem(F.col("file")).alias("stem"), F.arrays_overlap("_tags", F.array(*[F.lit(t) for t in SE_TAGS])).alias("inquiry"),
                             F.array_distinct(F.transform(usable, lambda s: s["at"])).alias("spans")), {"ignoreNullFields": "false"})
    return tagged.select(_slim(F.col("anon_id"), F.lit(None), own))


def _labels(offsets: list, inquiry: bool, spans: list) -> list[int]:
    """J2, J4, A4 for one annotation document and its note's offsets (none: no section)."""
    sections = list(zip(offsets[::2], offsets[1::2], strict=True))
    made = [int(s is not None and any(not (e - SPAN_OFFSET < s or f < b - SPAN_OFFSET) for b, e in spans)) for s, f in sections]
    if all(s is None for s, _ in sections) and inquiry and spans:
        made[0] = 1
    return made


def _update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held = json.loads(state.get[0]) if state.exists else {"version": 0, "notes": [], "documents": []}
    for frame in frames:
        held["notes"] += [json.loads(n) for n in frame["note"] if n is not None]
        held["documents"] += [json.loads(d) for d in frame["document"] if d is not None]
    held["version"] += 1
    state.update((json.dumps(held),))
    pool = sorted({tuple(s) for d in held["documents"] for s in d["spans"]})
    by_file: dict[str, list] = {}
    for n in held["notes"]:
        by_file.setdefault(n["file"], []).append(n["offsets"])
    rows = [(key[0], key[1], held["version"], d["xmi"], d["file"], *_labels(offsets, d["inquiry"], pool if d["stem"] == key[1] else []))
            for d in held["documents"] for offsets in by_file.get(d["file"], [[None] * len(_OFFSETS)])]
    yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])


def labelled_stream(notes: DataFrame, docs: DataFrame) -> DataFrame:
    """``round, key, version, xmi, file`` and the labels of every annotation document of a key, whenever the key gets more."""
    reachable(notes.sparkSession)
    rows = note_rows(notes).unionByName(document_rows(docs))
    return rows.groupBy("round", "key").applyInPandasWithState(_update, OUT, "held string", "update", GroupStateTimeout.NoTimeout)


def write_labels(notes: DataFrame, docs: DataFrame, out_path: str, checkpoint: str | None = None, available_now: bool = True):
    """Writes every version to parquet, a folder per micro-batch that is overwritten on a retry."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/batch_id={batch_id}")

    writer = labelled_stream(notes, docs).writeStream.outputMode("update").foreachBatch(handle).option("checkpointLocation", checkpoint or checkpoint_folder(notes.sparkSession, "label-state"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def latest_labels(spark: SparkSession, path: str) -> DataFrame:
    """``xmi, round, file`` and labels: each key's rows of its last version (keys are joined by an aggregate, not by a window of rows)."""
    seen = spark.read.schema(OUT).parquet(path)
    last = seen.groupBy("round", "key").agg(F.max("version").alias("version"))
    return seen.join(last, ["round", "key", "version"]).select("xmi", "round", "file", *LABELS)
