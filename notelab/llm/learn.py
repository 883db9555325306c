"""Bounded, documented samples of labelled documents for the models of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from notelab.llm.common import crc_fold

#: Longer texts are left out of samples for fitting (never of scoring), so that a sample's bytes are bounded.
MAX_SAMPLE_BYTES = 100_000


def hash_sample(df: DataFrame, rows: int, n: int, *ties: str) -> DataFrame:
    """The n rows with the smallest ``h`` (an xxhash64). rows: about how many the table has.

    Hash values are uniform, so a bound on them leaves about twice n rows in the whole table; only these are
    ordered, and what tasks send to the driver doesn't grow with their number.
    """
    share = min(1.0, (2 * n + 200) / max(rows, 1))
    bound = int(-(1 << 63) + share * ((1 << 64) - 1))
    return df.where(F.col("h") <= F.lit(min(bound, (1 << 63) - 1))).orderBy("h", *ties).limit(n)


def even_shares(sizes: dict, n: int) -> dict:
    """Rows to take of each class, n in all at most: as even as the sizes allow, and of every class if n suffices."""
    out, left = {}, n
    for i, k in enumerate(sorted(sizes, key=lambda k: (sizes[k], k))):
        out[k] = min(sizes[k], -(-left // (len(sizes) - i)))
        left -= out[k]
    return out


def hash_sample_by(df: DataFrame, by: str, n: dict, rows: dict, *ties: str) -> DataFrame:
    """``hash_sample`` of each class of the text column ``by`` in one pass; n and rows are by class."""
    bounds = [(k, n[k], min(int(-(1 << 63) + min(1.0, (2 * n[k] + 200) / max(rows[k], 1)) * ((1 << 64) - 1)), (1 << 63) - 1)) for k in n]
    table = df.sparkSession.createDataFrame(bounds, "_class string, _n long, _bound long")
    near = df.join(F.broadcast(table), F.col(by) == F.col("_class")).where(F.col("h") <= F.col("_bound"))
    place = F.row_number().over(W.partitionBy("_class").orderBy("h", *ties))
    return near.withColumn("_place", place).where(F.col("_place") <= F.col("_n")).select(df.columns).orderBy("h", *ties)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: dict[int, int], folds: int = 4, held: int = 2):
    """pandas (doc_id, text, y): of each class the documents with the smallest id hashes, outside the held-out fold.

    A document with several label rows counts by the largest label. At most sum(per_class) ids are broadcast.
    """
    y = (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (crc_fold(F.col("doc_id"), folds) != held))
         .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y")))
    sizes = {r["y"]: r["count"] for r in y.groupBy("y").count().collect()}  # two classes
    hashed = y.withColumn("h", F.xxhash64("doc_id"))
    parts = [hash_sample(hashed.where(F.col("y") == c), sizes.get(c, 0), n, "doc_id").drop("h") for c, n in per_class.items()]
    picked = parts[0]
    for p in parts[1:]:
        picked = picked.unionByName(p)
    texts = docs.where(F.col("text").isNotNull() & (F.octet_length("text") <= MAX_SAMPLE_BYTES)).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").toPandas()
