"""Operator 4: benchmark decontamination by n-gram seeds and Smith-Waterman alignment.

1. The items' n-grams set bits of a fixed-size bitmap (two bits each). One pass over the whole texts keeps the passages
   around n-grams that the bitmap knows: the only words that are moved.
2. Passages meet items by n-gram. Every n-gram that both hold is a seed, so an alignment is found if it keeps one run of
   n words, wherever the edits lie and whoever else holds the item. Seeds too far apart for one alignment are
   separate stretches, and only a stretch's own words go on to be aligned.
3. Stretches are aligned by Smith-Waterman over words (numpy, many at a time), but for those whose words, in any order,
   can't reach the threshold: a common phrase alone starts no alignment. The score is the best local score over that of
   the whole item; pairs of ``threshold`` or more are contaminations.

Words are lower-cased (A-Z) and without ASCII punctuation. Items of fewer words than n are one shorter n-gram.

Edge cases: null and empty texts have no words and match nothing; items without words match nothing; null ids stay null
in the result; repeated rows give the same pairs, reported once per (doc_id, item_id); empty tables give an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from notelab.llm.common import Scratch, bitmap, read, slot
from notelab.llm.words import mix, powers, tokens

MATCH, MISMATCH, GAP = 2, -1, -1
#: Matrix cells that are aligned at a time.
CELLS = 1 << 20


def grams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word runs that stay inside a row, and their first words."""
    last = np.repeat(first[1:], np.diff(first))
    at = np.flatnonzero(np.arange(len(h)) + n <= last)
    p, total = powers(n, 31)[0], np.zeros(len(at), dtype=np.uint64)
    for j in range(n):
        total += h[at + j] * p[j]
    return mix(total ^ np.uint64(n)), at


def _items(n: int):
    """Words and n-grams of the items."""
    schema = pa.schema([("item_id", pa.int64()), ("words", pa.list_(pa.int64())), ("size", pa.int32()), ("grams", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, t in tokens(batch.column(1), plain=True):
                h, words, sizes, lists = t.hashes(), [], [], []
                for r in range(b - a):
                    own = h[t.first[r] : t.first[r + 1]]
                    size = min(n, len(own))
                    words.append(own.view(np.int64))
                    sizes.append(size)
                    lists.append(grams(own, np.array([0, len(own)]), size)[0].view(np.int64) if size else np.zeros(0, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(words, schema.field(1).type), pa.array(sizes, pa.int32()), pa.array(lists, schema.field(3).type)], schema=schema)

    return run, "item_id long, words array<long>, size int, grams array<long>"


def _passages(sizes: list[int], margin: int, known):
    """Passages around known n-grams: their words, and the n-grams with their places in the passage."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("words", pa.list_(pa.int64())), ("grams", pa.list_(pa.int64())), ("places", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(known.value, bitorder="little").view(bool)
        for batch in batches:
            for a, b, t in tokens(batch.column(1), plain=True):
                h = t.hashes()
                found = []
                for n in sizes:
                    g, at = grams(h, t.first, n)
                    hit = bits[slot(g)] & bits[slot(g >> np.uint64(24))]
                    found.append((g[hit], at[hit]))
                g, at = (np.concatenate(x) for x in zip(*found, strict=True))
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                g, at = g[order], at[order]
                row = np.searchsorted(t.first, at, side="right") - 1
                cut = np.flatnonzero((np.diff(row) > 0) | (np.diff(at) > 2 * margin)) + 1
                edges = np.concatenate([[0], cut, [len(at)]])
                ids = batch.column(0).slice(a, b - a)
                rows, start, words, own, places = [], [], [], [], []
                for i, j in zip(edges[:-1], edges[1:], strict=True):
                    r = row[i]
                    lo, hi = max(t.first[r], at[i] - margin), min(t.first[r + 1], at[j - 1] + margin)
                    rows.append(r)
                    start.append(lo - t.first[r])
                    words.append(h[lo:hi].view(np.int64))
                    own.append(g[i:j].view(np.int64))
                    places.append((at[i:j] - lo).astype(np.int32))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(start, pa.int64()), *[pa.array(x, schema.field(k).type) for k, x in ((2, words), (3, own), (4, places))]], schema=schema)

    return run, "doc_id long, start long, words array<long>, grams array<long>, places array<int>"


def smith_waterman(passages: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local score of each row pair and the passage position where it ends; pads must differ between the sides.

    With a linear gap cost, the gaps along a matrix row are a running maximum of score plus position.
    """
    b, width = passages.shape
    place = np.arange(width, dtype=np.int32) * -GAP
    h = np.zeros((b, width + 1), dtype=np.int32)
    best, end = np.zeros(b, dtype=np.int32), np.zeros(b, dtype=np.int64)
    for i in range(items.shape[1]):
        step = np.where(passages == items[:, i : i + 1], MATCH, MISMATCH).astype(np.int32)
        x = np.maximum(np.maximum(h[:, :-1] + step, h[:, 1:] + GAP), 0)
        h[:, 1:] = np.maximum.accumulate(x + place, axis=1) - place
        at = h.argmax(axis=1)
        top = h[np.arange(b), at]
        end = np.where(top > best, at, end)
        best = np.maximum(best, top)
    return best, end


def most(passage: np.ndarray, item: np.ndarray) -> int:
    """A bound of the local score: the best run of item words, each a match if the passage holds it at all."""
    total = np.cumsum(np.concatenate([[0], np.where(np.isin(item, passage), MATCH, max(MISMATCH, GAP))]))
    return int((total - np.minimum.accumulate(total)).max())


def _lists(column) -> list[np.ndarray]:
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[i:j] for i, j in zip(offsets[:-1], offsets[1:], strict=True)]


def _align(threshold: float):
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("n_seeds", pa.int64()), ("end_word", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut, items = _lists(batch.column("words")), _lists(batch.column("item"))
            order = [k for k in range(len(cut)) if most(cut[k], items[k]) >= threshold * MATCH * len(items[k])]
            order.sort(key=lambda k: (len(cut[k]), len(items[k])))
            score, end, i = np.full(len(cut), -1.0), np.zeros(len(cut), dtype=np.int64), 0
            while i < len(order):
                j = i + 1
                while j < len(order) and (j - i) * len(cut[order[j]]) < CELLS:
                    j += 1
                part = order[i:j]
                p = np.zeros((len(part), max(len(cut[k]) for k in part)), dtype=np.int64)
                q = np.ones((len(part), max(len(items[k]) for k in part)), dtype=np.int64)
                for x, k in enumerate(part):
                    p[x, : len(cut[k])], q[x, : len(items[k])] = cut[k], items[k]
                best, at = smith_waterman(p, q)
                score[part] = best / np.array([MATCH * len(items[k]) for k in part])
                end[part] = at
                i = j
            end += batch.column("start").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("item_id"), pa.array(score), batch.column("n_seeds"), pa.array(end)], schema=schema).filter(pa.array(score >= threshold))

    return run, "doc_id long, item_id long, score double, n_seeds long, end_word long"


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 4, threshold: float = 0.5,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, score, n_seeds, end_word): documents that hold an item, copied or edited."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontam")
    run, schema = _items(n)
    items = scratch.stage(benchmark.select(F.col("item_id").cast("long"), "text").mapInArrow(run, schema).where("size > 0").withColumn("item", F.monotonically_increasing_id()), "items")
    own = items.select("item", F.size("words").alias("m"), F.explode("grams").alias("gram"))
    known = spark.sparkContext.broadcast(np.packbits(bitmap(own.select(F.explode(F.array("gram", F.shiftrightunsigned("gram", 24))).alias("g")), "g"), bitorder="little"))
    longest = items.agg(F.coalesce(F.max(F.size("words")), F.lit(0))).first()[0]
    sizes = sorted(r[0] for r in items.select("size").distinct().collect()) or [n]  # at most n lengths

    run, schema = _passages(sizes, 2 * longest + n, known)
    passages = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    passages = scratch.stage(passages.withColumn("pid", F.monotonically_increasing_id()), "passages")
    hits = passages.select("pid", F.explode(F.arrays_zip("grams", "places")).alias("g")).select("pid", F.col("g.grams").alias("gram"), F.col("g.places").alias("place"))
    seeds = own.select("item", "m", "gram").distinct()
    # what an item can align with lies within twice its length of its seeds
    by_place = W.partitionBy("pid", "item").orderBy("place")
    met = hits.join(seeds, "gram").withColumn("away", F.coalesce(F.col("place") - F.lag("place").over(by_place) > 4 * F.col("m"), F.lit(False)))
    stretches = (met.withColumn("part", F.sum(F.col("away").cast("int")).over(by_place)).groupBy("pid", "item", "m", "part")
                 .agg(F.min("place").alias("lo"), F.max("place").alias("hi"), F.count("*").alias("n_seeds"))
                 .withColumn("low", F.greatest(F.col("lo") - 2 * F.col("m"), F.lit(0))))
    both = (stretches.join(passages.select("pid", "doc_id", "start", "words"), "pid")
            .withColumn("words", F.slice("words", F.col("low") + 1, F.col("hi") + 2 * F.col("m") - F.col("low")))
            .join(items.select("item", "item_id", F.col("words").alias("item_words")), "item")
            .select("doc_id", "item_id", (F.col("start") + F.col("low")).alias("start"), "words", F.col("item_words").alias("item"), "n_seeds"))
    run, schema = _align(threshold)
    return (both.mapInArrow(run, schema).groupBy("doc_id", "item_id")
            .agg(F.max("score").alias("score"), F.sum("n_seeds").alias("n_seeds"), F.max(F.struct("score", "end_word")).getField("end_word").alias("end_word")))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
