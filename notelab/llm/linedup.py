"""Operator 9: line dedup by prefix doubling over line-ID sequences.

Each document is the sequence of its non-blank lines (trailing spaces don't count). All suffixes of these sequences are
ranked by distributed prefix doubling: ranks of 1 line, then of 2, 4, ... lines, each from the pair (rank at i, rank at
i + 2**k). A round keeps only suffixes whose prefix so far occurs twice, since no other can start a repeated run, and
its ranks follow the order of the pairs (a range partition of the distinct pairs), so equal ranks are intervals of the
suffix array. Suffixes whose longest common prefix is at least ``min_lines`` form one such interval; doubling stops at
the first depth that covers min_lines, as the order inside an interval can't change what is deleted: every later copy of
a maximal run is covered by its windows of min_lines lines. In each interval the earliest suffix (document id, then
place) stays and all others are later copies; later copies that continue the same earlier run are joined to maximal
runs, and the lines of these runs are deleted. A single line of ``min_words`` words or more is a run by itself.

Hot lines cost one row per task before the shuffles by line (aggregates with map-side combine); the joins back to
positions are plain equi-joins that AQE splits. Window partitions are single documents.

Edge cases: null and empty texts have no lines and stay as they are; blank lines are never deleted by themselves but go
where a document loses lines; a document without a deleted line keeps its text byte for byte; a document that loses all
lines keeps an empty text; rows equal in id and text are treated as one and alike; runs repeated inside one document
count; an empty table gives an empty result; extra columns are kept, but for those
with the names of the two count columns, which can be chosen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from notelab.llm.common import Scratch, apart, fresh, read

_KEY = ["d", "key"]
_WORD = r"[^\x20\x09-\x0D]+"


def text_lines(text: Column) -> Column:
    """The non-blank lines, without trailing white space."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"[\x20\x09-\x0D]+$", "")), lambda x: x != "")


def _ranked(groups: DataFrame, by: list[str], scratch: Scratch, name: str) -> DataFrame:
    """Numbers that follow the order of the distinct keys: range partitions, sorted, then Spark's ordered ids."""
    return scratch.stage(groups.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("rank", F.monotonically_increasing_id()), name)


def _classes(rows: DataFrame, by: list[str], *extra: Column) -> DataFrame:
    """Contents that start at two places or more, each with its first place."""
    at = F.struct("d", "key", "i")
    return rows.groupBy(*by).agg(F.min(at).alias("first"), F.max(at).alias("last"), *extra).where("first < last").drop("last")


def _at(rank: str, shift: int) -> Column:
    """The rank at the place shift lines further on, null if it has none."""
    return F.max(rank).over(W.partitionBy(*_KEY).orderBy("i").rangeBetween(shift, shift))


def repeated_runs(docs: DataFrame, scratch: Scratch, min_lines: int, min_words: int) -> DataFrame:
    """(d, key, start, n, src_d, src_key, src_start): maximal runs of lines that continue one earlier copy."""
    lines = (docs.select("d", "key", F.posexplode(text_lines(F.col("text"))).alias("i", "line"))
             .select("d", "key", "i", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"),
                     (F.regexp_count("line", F.lit(_WORD)) >= min_words).alias("long")))
    lines = scratch.stage(lines, "lines")
    one = _ranked(_classes(lines, ["h1", "h2"], F.first("long").alias("long_run")), ["h1", "h2"], scratch, "rank1")
    ranks = scratch.stage(lines.join(one, ["h1", "h2"]).select("d", "key", "i", "rank", "first", "long_run"), "places1")
    singles = ranks.where("long_run").select("d", "key", "i", "first", F.lit(1).alias("n"))
    depth = 1
    while 2 * depth <= min_lines:
        pairs = ranks.withColumn("next", _at("rank", depth)).where("next is not null").select("d", "key", "i", F.col("rank").alias("r1"), F.col("next").alias("r2"))
        pairs = scratch.stage(pairs, "pairs")
        two = _ranked(_classes(pairs, ["r1", "r2"]), ["r1", "r2"], scratch, f"rank{2 * depth}")
        ranks = scratch.stage(pairs.join(two, ["r1", "r2"]).select("d", "key", "i", "rank", "first"), f"places{2 * depth}")
        depth *= 2
    if depth < min_lines:  # min_lines lines are two overlapping prefixes of depth lines
        pairs = ranks.withColumn("next", _at("rank", min_lines - depth)).where("next is not null").select("d", "key", "i", "rank", "next")
        ranks = pairs.join(_classes(pairs, ["rank", "next"]), ["rank", "next"])
    later = ranks.select("d", "key", "i", "first", F.lit(min_lines).alias("n")).union(singles).where(F.struct("d", "key", "i") > F.col("first"))
    shifted = later.withColumn("shift", F.col("i") - F.col("first.i"))
    island = F.col("i") - F.row_number().over(W.partitionBy("d", "key", "n", F.col("first.d"), F.col("first.key"), "shift").orderBy("i"))
    return (shifted.withColumn("island", island)
            .groupBy("d", "key", "n", F.col("first.d").alias("src_d"), F.col("first.key").alias("src_key"), "shift", "island")
            .agg(F.min("i").alias("start"), F.count_distinct("i").alias("c"))
            .select("d", "key", "start", (F.col("c") + F.col("n") - 1).cast("int").alias("n"), "src_d", "src_key", (F.col("start") - F.col("shift")).alias("src_start")))


def dedup_lines(docs: DataFrame, min_lines: int = 2, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text",
                lines_col: str = "n_lines", removed_col: str = "n_removed") -> DataFrame:
    """The documents with later copies of repeated line runs deleted, and two columns of counts."""
    scratch = Scratch(docs.sparkSession, "linedup")
    plain = docs.select(F.col(id_col).alias("d"), F.xxhash64(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    runs = scratch.stage(repeated_runs(plain, scratch, min_lines, min_words), "runs")
    row, at, of, lost, own = (fresh(docs, name) for name in ("row", "row_at", "row_of", "lost", "lines"))
    gone = (runs.select(F.xxhash64("d", "key").alias(at), F.col("d").alias(of), F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("i"))
            .groupBy(at, of).agg(F.collect_set("i").alias(lost)))
    gone = scratch.stage(gone, "gone")
    left = F.array_except(F.sequence(F.lit(0), F.size(own) - 1), F.col(lost))
    rest_of_text = F.array_join(F.transform(F.array_sort(left), lambda i: F.get(own, i)), "\n")
    # only documents that may lose lines are moved; the table of lost lines grows with the corpus, so it is never broadcast
    keyed = docs.withColumn(row, F.xxhash64(F.col(id_col), F.xxhash64(id_col, text_col)))
    maybe, rest = apart(keyed, row, gone.select(at))
    same = (F.col(row) == F.col(at)) & F.col(id_col).eqNullSafe(F.col(of))
    joined = maybe.join(gone.hint("merge"), same, "left").drop(at, of).unionByName(rest, allowMissingColumns=True)
    return (joined.withColumn(own, F.coalesce(text_lines(F.col(text_col)), F.array().cast("array<string>")))
            .withColumn(text_col, F.when(F.col(lost).isNull(), F.col(text_col)).otherwise(rest_of_text))
            .withColumn(lines_col, F.size(own).cast("long"))
            .withColumn(removed_col, F.when(F.col(lost).isNull(), F.lit(0)).otherwise(F.size(lost)).cast("long"))
            .drop(row, lost, own))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")
