"""Group-aware stratified folds and splits.

Folds are assigned per patient, never per row, so no patient spans two folds.  Patients are put
in one order inside their class stratum (positives, size, a seeded hash) and dealt to folds in
serpentine order.  Their places come from a range-partitioned global rank, so the folds are the same at
any size and any partition count.  A note without a patient id is a patient of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vocab import N_FOLDS
from .rank import global_rank


def hash_int(col) -> F.Column:
    """First 32 bits of md5 as a non-negative integer (same value in DuckDB)."""
    return F.conv(F.substring(F.md5(col), 1, 8), 16, 10).cast("bigint")


def with_patient(rows: DataFrame) -> DataFrame:
    """Adds ``patient``: the patient id, or the note's own name where it has none."""
    return rows.withColumn("patient", F.coalesce(F.col("mrn"), F.concat(F.lit("note:"), F.coalesce("note_id", F.lit("")))))


def group_class_counts(rows: DataFrame, group: str = "patient", label: str = "y") -> DataFrame:
    """Rows and positives per group (partial-aggregated, so a large group costs one row per task)."""
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("pos"))


def folds_of_seeds(counts: DataFrame, seeds: Sequence[int], k: int = N_FOLDS, group: str = "patient") -> DataFrame:
    """M6, M9: ``random_number, group, fold, n, pos`` of every split number, from one ranked table.

    The split number is the first column of the order, so one range partition deals the groups of all of them.
    """
    every = counts.withColumn("random_number", F.explode(F.array(*[F.lit(s) for s in seeds])))
    keyed = every.withColumns({"_stratum": (F.col("pos") > 0).cast("int"), "_pos": -F.col("pos"), "_n": -F.col("n"),
                               "_h": F.md5(F.concat(F.col("random_number").cast("string"), F.lit(":"), F.col(group).cast("string")))})
    ranked = global_rank(keyed, ["random_number", "_stratum", "_pos", "_n", "_h", group], "_r")
    first = ranked.groupBy("random_number", "_stratum").agg(F.min("_r").alias("_first"))  # two rows a split number
    r = F.col("_r") - F.col("_first")
    cycle, pin = F.floor(r / k), F.pmod(r, F.lit(k))
    deal = F.when(F.pmod(cycle, F.lit(2)) == 0, pin).otherwise(F.lit(k - 1) - pin)
    return ranked.join(first, ["random_number", "_stratum"]).select("random_number", group, deal.cast("int").alias("fold"), "n", "pos")


def group_folds(counts: DataFrame, k: int = N_FOLDS, seed: int = 22, group: str = "patient") -> DataFrame:
    """M6: ``group, fold, n, pos`` with folds 0..k-1."""
    return folds_of_seeds(counts, [seed], k, group).drop("random_number")


def seed_gates(folds: DataFrame, max_gap: int = 10) -> DataFrame:
    """F4 of every split number in one aggregate over its groups: ``random_number, pos_test, pos_val, passed``."""
    def positives(fold: int) -> F.Column:
        return F.sum(F.when(F.col("fold") == fold, F.col("pos")).otherwise(0)).cast("bigint")
    agg = folds.groupBy("random_number").agg(positives(0).alias("pos_test"), positives(1).alias("pos_val"))
    return agg.withColumn("passed", F.abs(F.col("pos_test") - F.col("pos_val")) < max_gap)


def split_name(fold) -> F.Column:
    """M7 / U4: fold 0 = test, fold 1 = validation, the rest = train."""
    return F.when(fold == 0, F.lit("test")).when(fold == 1, F.lit("val")).otherwise(F.lit("train"))


def assign_splits(rows: DataFrame, folds: DataFrame, group: str = "patient") -> DataFrame:
    """every row gets its group's fold and split (one row per group on the right side; one per split number with ``folds_of_seeds``)."""
    number = [c for c in ("random_number",) if c in folds.columns]
    return rows.join(folds.select(group, *number, "fold"), group, "inner").withColumn("split", split_name(F.col("fold")))


def balance_gate(split_rows: DataFrame, max_gap: int = 10, label: str = "y") -> DataFrame:
    """positives in test and validation and whether they differ by less than ``max_gap``."""
    agg = split_rows.agg(
        F.sum(F.when(F.col("split") == "test", F.col(label)).otherwise(0)).cast("bigint").alias("pos_test"),
        F.sum(F.when(F.col("split") == "val", F.col(label)).otherwise(0)).cast("bigint").alias("pos_val"))
    return agg.withColumn("passed", F.abs(F.col("pos_test") - F.col("pos_val")) < max_gap)
