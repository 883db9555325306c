"""Hot-key handling for equi-joins whose many side may put a large share of rows on one key.

A key is hot when it holds more than ``fraction`` of all rows of the many side (and at least
``min_rows``).  There are at most ``1 / fraction`` such keys, so the hot-key list has a proven
size bound and is broadcast.  Rows of hot keys on the many side are spread over ``salts``
sub-keys; the matching rows of the other side (few per key) are replicated once per sub-key.
Every pair that the plain equi-join would produce is produced exactly once: ``fraction`` and
``min_rows`` choose the physical plan only, the result is the same at any size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hot_keys(df: DataFrame, keys: Sequence[str], fraction: float = 0.001, min_rows: int = 100_000) -> DataFrame:
    """Keys of ``df`` holding more than ``fraction`` of its rows (at most ``1 / fraction`` rows)."""
    keys = list(keys)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.select(F.sum("_n")).scalar()  # same aggregate, its shuffle is reused
    return counts.where(F.col("_n") > F.greatest(F.lit(min_rows), total * F.lit(fraction))).select(*keys)


def salted_join(many: DataFrame, few: DataFrame, keys: Sequence[str], salt_by: Sequence[str], salts: int = 64,
                fraction: float = 0.001, min_rows: int = 100_000, how: str = "inner") -> DataFrame:
    """``many`` joined to ``few`` on ``keys`` with hot keys of ``many`` split into ``salts`` parts.

    ``salt_by`` columns of ``many`` choose the part (a hash), so equal rows land together.
    """
    keys = list(keys)
    hot = F.broadcast(hot_keys(many, keys, fraction, min_rows).withColumn("_hot", F.lit(True)))
    part = F.pmod(F.xxhash64(*[F.col(c) for c in salt_by]), F.lit(salts))
    many_s = (many.join(hot, keys, "left")
              .withColumn("_salt", F.when(F.col("_hot"), part).otherwise(F.lit(0)).cast("int")).drop("_hot"))
    few_s = (few.join(hot, keys, "left")
             .withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1)))
                                            .otherwise(F.array(F.lit(0))))).drop("_hot"))
    return many_s.join(few_s, [*keys, "_salt"], how).drop("_salt")
