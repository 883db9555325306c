"""Annotation-side operators.

One annotation document is one row, so the per-document tag table is a row-local
projection of that row's fragments: no explode, no shuffle, no pivot job.  Only the
long span table explodes (one row per tag element).  ``round`` names the folder that a
document came from; documents without that column are one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import xmi as X
from ..functions.vocab import SE_ABSENT, SE_PRESENT, SE_TAGS, TAG_VOCAB

_FILE_SQL = "replace(xmi, '.xmi', '.txt')"
_ANON_SQL = f"get(split(regexp_extract({_FILE_SQL}, r'^(.*)\\.', 1), '-'), 0)"
_STEM_SQL = f"regexp_extract({_FILE_SQL}, r'^(.*)\\.', 1)"


def with_round(df: DataFrame) -> DataFrame:
    return df if "round" in df.columns else df.withColumn("round", F.lit(""))


def with_keys(docs: DataFrame) -> DataFrame:
    """P4 + P5: ``file`` (note name) and ``anon_id`` from the annotation file name."""
    return docs.selectExpr("*", f"{_FILE_SQL} AS file", f"{_ANON_SQL} AS anon_id")


def xmi_fragments(docs: DataFrame) -> DataFrame:
    """P6 + F1: one row per tag fragment."""
    return with_round(docs).select("xmi", "round", F.posexplode(X.tag_fragments(F.col("content"))).alias("pos", "fragment"))


def xmi_attributes(docs: DataFrame) -> DataFrame:
    """Id, begin, end, tag of every tag fragment (NULL where the pattern finds nothing)."""
    f = F.col("fragment")
    return xmi_fragments(docs).select("xmi", "round", "pos", X.xmi_id(f).alias("xmi_id"), X.begin(f).alias("begin"),
                                      X.end(f).alias("end"), X.semantic_tag(f).alias("tag"))


def spans(docs: DataFrame, strict_stem: bool = False) -> DataFrame:
    """Long span table ``round, file, tag, begin, end``.

    ``file`` is the anonymous id (the name cut at the first ``-``), as the reference keys it;
    with ``strict_stem`` it is the whole name, which a note of the same name matches.
    """
    frag = F.col("fragment")
    return (with_round(docs).selectExpr("round", f"{_STEM_SQL if strict_stem else _ANON_SQL} AS file", "content")
            .select("round", "file", F.explode(X.tag_fragments(F.col("content"))).alias("fragment"))
            .select("round", "file", X.semantic_tag(frag).alias("tag"),
                    X.begin(frag).try_cast("bigint").alias("begin"), X.end(frag).try_cast("bigint").alias("end")))


def tag_subset(span_df: DataFrame, tags=SE_TAGS) -> DataFrame:
    """spans whose tag is one of the side-effect tags."""
    return span_df.where(F.col("tag").isin(*tags))


def span_rejects(span_df: DataFrame) -> DataFrame:
    """Spans that can label nothing, by what they lack: a count per (tag missing, position missing)."""
    lacks = span_df.select(F.col("tag").isNull().alias("no_tag"), (F.col("begin").isNull() | F.col("end").isNull()).alias("no_position"))
    return lacks.where("no_tag or no_position").groupBy("no_tag", "no_position").agg(F.count(F.lit(1)).alias("n"))


def doc_tags(docs: DataFrame) -> DataFrame:
    """A1: sorted distinct tags per annotation document."""
    return with_round(docs).selectExpr("xmi", "round", f"{X.doc_tags_sql()} AS tags")


def annotations_wide(docs: DataFrame, vocab=TAG_VOCAB) -> DataFrame:
    """A2 + P10 + P9: ``xmi, file, anon_id, round``, one 0/1 column per vocabulary tag, ``other_tags``, three flags.

    Every document keeps its row, also without tags; all vocabulary columns always exist, and
    tags outside the vocabulary are kept in the sorted array ``other_tags``.
    """
    keyed = with_round(docs).selectExpr("xmi", "round", f"{_FILE_SQL} AS file", f"{_ANON_SQL} AS anon_id", f"{X.doc_tags_sql()} AS _tags")
    onehot = [f"CAST(array_contains(_tags, '{t}') AS INT) AS `{t}`" for t in vocab]
    known = ", ".join(f"'{t}'" for t in vocab)
    base = keyed.selectExpr("xmi", "file", "anon_id", "round", *onehot, f"array_except(_tags, array({known})) AS other_tags")
    present = f"greatest({', '.join(SE_PRESENT)})"
    absent = f"greatest({', '.join(SE_ABSENT)})"
    return base.selectExpr("*", f"{present} AS SE_present", f"{absent} AS SE_absent",
                           f"greatest({present}, {absent}) AS SE_inquiry")


def inquiry_counts(wide: DataFrame) -> DataFrame:
    """A3: value counts of the inquiry flag."""
    return wide.groupBy("SE_inquiry").agg(F.count(F.lit(1)).alias("count"))
