"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelab.llm.common import Scratch, apart, fresh, read, without
from notelab.llm.decontam import contaminated
from notelab.llm.jaccard import jaccard_components
from notelab.llm.langid import accepted
from notelab.llm.linedup import dedup_lines
from notelab.llm.mixing import mix_sources, mixed_blocks

#: Documents whose pooled probability of the predicted language is lower are rejected.
LANGUAGE_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents without letters, or of no learned language with confidence, go."""
    return accepted(docs, LANGUAGE_SCORE)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: later copies of repeated line runs go, and documents that hold nothing else."""
    kept, gone = fresh(docs, "n_lines"), fresh(docs, "n_removed")
    left = dedup_lines(docs, lines_col=kept, removed_col=gone).where((F.col(gone) == 0) | (F.col("text") != ""))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col(gone) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return left.select(docs.columns)


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with a key of id and text, so that rows that share an id (or have none) are told apart; and its name."""
    key = fresh(docs, "row_key")
    return docs.withColumn(key, F.xxhash64("doc_id", "text")), key


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of documents linked by five-word shingles (Jaccard 0.8 or more) that with the smallest id stays, once.

    Rows are told apart by id and text: rows of one id with unlike texts all stay, and rows without an id are copies of
    others like any row (one with an id stays before one without). Rows without a word link with nothing and stay.
    """
    keyed, key = _keyed(docs)
    scratch = Scratch(spark, "near-copies")
    groups = scratch.stage(jaccard_components(keyed.select(key, "text"), k=5, p=80, q=100, id_col=key).where("n_shingles > 0"), "groups")
    linked = groups.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1").select("component_id")
    members = groups.join(linked, "component_id").select("component_id", F.col("doc_id").alias(key)).distinct()
    named = members.join(keyed.select(key, "doc_id").distinct(), key)
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", key)).alias("first"))
    copies = scratch.stage(members.join(first, "component_id").where(F.col(key) != F.col(f"first.{key}")).select(key), "copies")
    twice = groups.groupBy("doc_id").count().where("count > 1").select("doc_id")
    touched, rest = apart(keyed, key, copies.union(twice))
    mark = fresh(keyed, "twice")
    once = touched.join(twice.select(F.col("doc_id").alias(key), F.lit(True).alias(mark)), key, "left")
    kept = once.where(F.col(mark)).dropDuplicates([key]).unionByName(once.where(F.col(mark).isNull())).drop(mark)
    return kept.join(copies, key, "left_anti").select(docs.columns).unionByName(rest.select(docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that hold a benchmark item go; rows are told apart by id and text, also those without an id."""
    keyed, key = _keyed(docs)
    leaks = contaminated(keyed.select(key, "text"), read(spark, sf_dir, "benchmark"), id_col=key).select("doc_id").distinct()
    return without(keyed, key, Scratch(spark, "leaks").stage(leaks, "ids")).select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: the words that the mix takes of each remaining document."""
    return mix_sources(docs)


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("ngram_jaccard", near_copies),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: Trained models, alignments and hashed draws: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each one's rows are staged in the shared folder and reread."""
    return _through(STAGES, spark, sf_dir)


def mixed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that the pipeline ends in: the mix of the documents left before the last stage, a block per row."""
    return mixed_blocks(_through(STAGES[:-1], spark, sf_dir))


def _through(stages: list, spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in stages:
        docs = scratch.stage(stage(spark, docs, sf_dir), name)
    return docs
