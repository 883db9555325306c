"""Helpers shared by the operators of this package: tables, staged results, fixed-size bitmaps, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notelab.session import ensure_checkpoint_dir, reachable

#: Bits of the fixed-size bitmaps that are sent to every task (2 MB). The size never depends on the data.
BITMAP_BITS = 1 << 24


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class Scratch:
    """Staged tables of one operator run in the shared folder (``spark.checkpoint.dir``).

    A staged table is written once as Parquet and read back, which cuts the lineage in storage that survives lost
    executors. ``drop`` removes tables that later steps no longer read; what the result still reads stays.
    """

    def __init__(self, spark: SparkSession, name: str):
        reachable(spark)
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:02d}-{name}"

    def stage(self, df: DataFrame, name: str, codec: str | None = None, records: int = 0) -> DataFrame:
        """codec: the compression of a table that holds texts, where the session's own one isn't dense enough.
        records: most rows of a file (0: no limit), for a table whose scan must spread over tasks without a shuffle."""
        path = self.path(name)
        df.write.options(**({"compression": codec} if codec else {}), maxRecordsPerFile=records).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for t in tables:
            for f in {x.rsplit("/", 1)[0] for x in t.inputFiles()}:
                if self.root.split("/")[-1] in f:
                    path = jvm.org.apache.hadoop.fs.Path(f)
                    path.getFileSystem(conf).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32(doc_id as text) mod folds; null ids count as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def slot(hashed: np.ndarray, bits: int = BITMAP_BITS) -> np.ndarray:
    """Bitmap position of int64/uint64 hash values."""
    return (hashed.astype(np.uint64) & np.uint64(bits - 1)).astype(np.int64)


def bitmap(df: DataFrame, hashed: str, bits: int = BITMAP_BITS) -> np.ndarray:
    """Boolean array of fixed size, true at the slot of every value of the int64 column ``hashed``.

    Bits are OR-ed per 64-bit word in Spark; at most bits / 64 rows reach the driver, whatever the size of the table.
    """
    at = F.col(hashed).bitwiseAND(F.lit(bits - 1))
    words = (df.where(F.col(hashed).isNotNull())
             .select(F.shiftright(at, 6).alias("w"), F.expr(f"shiftleft(1L, cast({hashed} & 63L as int))").alias("b"))
             .groupBy("w").agg(F.bit_or("b").alias("b")).toPandas())
    out = np.zeros(bits // 64, dtype=np.int64)
    out[words["w"].to_numpy(dtype=np.int64)] = words["b"].to_numpy(dtype=np.int64)
    return np.unpackbits(out.view(np.uint8), bitorder="little").view(bool)


def _pick(wanted, at: int, inside: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(wanted.value, bitorder="little").view(bool)
        for batch in batches:
            key = batch.column(at)
            hit = bits[slot(key.fill_null(0).to_numpy())] & key.is_valid().to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(hit == inside))

    return run


def apart(df: DataFrame, key: str, keys: DataFrame, bits: int = BITMAP_BITS) -> tuple[DataFrame, DataFrame]:
    """(rows whose int64 key may be one of the keys, rows whose key certainly isn't), by a fixed-size bitmap.

    Only the first part then needs the exact join, so texts that the keys don't touch aren't shuffled. keys has one
    int64 column; null keys are in the second part.
    """
    name = keys.columns[0]
    wanted = df.sparkSession.sparkContext.broadcast(np.packbits(bitmap(keys, name, bits), bitorder="little"))
    at = df.columns.index(key)
    return df.mapInArrow(_pick(wanted, at, True), df.schema), df.mapInArrow(_pick(wanted, at, False), df.schema)


def without(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows whose int64 key is none of the keys (null keys stay)."""
    maybe, rest = apart(df, key, keys)
    return maybe.join(keys.withColumnRenamed(keys.columns[0], key).distinct(), key, "left_anti").select(df.columns).unionByName(rest)


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b", limit: int = 60) -> DataFrame:
    """(node, component): every node of the edges with the smallest node reachable.

    Alternating large-star and small-star steps (each an aggregation with map-side combine and an equi-join that AQE
    splits where one node holds many edges) until the edges no longer change; more than ``limit`` rounds are an error. Each round is staged in the shared
    folder; only a row count and a checksum reach the driver.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = scratch.stage(e, "edges")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = mark(e)
    for _ in range(limit if seen[0] else 0):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("s"))
        new = scratch.stage(small.select("s.*").where("u <> v").distinct(), "star")
        now = mark(new)
        scratch.drop(e)
        e = new
        if now == seen:
            break
        seen = now
    else:
        if seen[0]:
            raise RuntimeError(f"components still change after {limit} rounds")
    stars = e.groupBy("u").agg(F.min("v").alias("m"))
    return stars.select(F.col("u").alias("node"), F.col("m").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
