"""Operator 7: quality scores by Bradley-Terry pairwise ranking.

Each text gets a small vector of shares and ratios over all its bytes and words. All labelled documents outside the held-out
fold teach a linear score: they are dealt over blocks with rows of both classes, and in each block every good row is paired
with every poor one. The probability that the good one is preferred is the logistic function of the difference of the scores;
Newton steps add up the blocks' gradients and Hessians, so a step's work follows the number of rows. The
threshold is a quantile of all these rows' scores: that of the share of poor documents among all labelled rows outside the
held-out fold (or ``drop_share``). Reported scores are the logistic function of the distance to the threshold, shifted
so that the threshold lies at ``keep_at``.

Edge cases: null, empty and blank texts have the vector of a text without words and are scored by it; without both
classes every score is 0; repeated rows are scored alike; null ids belong to the fold of an empty id; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelab.llm.common import Scratch, crc_fold, read, reachable
from notelab.llm.words import Tokens, tokens

SEED = 17
#: Rows of the smaller class in a block of pairs, and rows of the other class that are paired with them at a time.
BLOCK, STEP = 1000, 1024
#: Kinds of bytes, counted in each text.
_KINDS = ["lower", "upper", "digit", "high", "space", "newline", "stop", "bang", "bar", "symbol", "other"]
_KIND = np.full(256, _KINDS.index("other"), dtype=np.int64)
for _name, _bytes in {"lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "high": range(128, 256), "space": b" \t", "newline": b"\n\r", "stop": b".,;:'-\"()", "bang": b"!?", "bar": b"|_/\\<>[]{}=", "symbol": b"#$%&*+@^~`"}.items():
    _KIND[list(_bytes)] = _KINDS.index(_name)
#: Features of a text.
WIDTH = len(_KINDS) + 11


def features(t: Tokens) -> np.ndarray:
    """(rows, features): shares of byte kinds, word lengths, repetition of words and neighbouring words, length."""
    rows, k = len(t.first) - 1, len(_KINDS)
    size = np.diff(t.offsets)
    kinds = np.zeros((rows, k))
    step = 1 << 20
    row = np.repeat(np.arange(rows), size) * k
    for i in range(0, len(t.data), step):
        kinds += np.bincount(row[i : i + step] + _KIND[t.data[i : i + step]], minlength=rows * k).reshape(rows, k)
    n = t.counts.astype(np.float64)
    h = t.hashes()
    length = (t.end - t.start).astype(np.float64)
    total = np.concatenate([[0], np.cumsum(length)])
    squares = np.concatenate([[0], np.cumsum(length * length)])
    again = np.concatenate([[0], np.cumsum(np.concatenate([[False], h[1:] == h[:-1]]))])
    distinct = np.zeros(rows)
    for r in range(rows):
        own = np.sort(h[t.first[r] : t.first[r + 1]])
        distinct[r] = (own[1:] != own[:-1]).sum() + (len(own) > 0)
    some = np.maximum(n, 1)
    mean = (total[t.first[1:]] - total[t.first[:-1]]) / some
    spread = np.sqrt(np.maximum((squares[t.first[1:]] - squares[t.first[:-1]]) / some - mean**2, 0))
    shares = kinds / np.maximum(size, 1)[:, None]
    letters = np.maximum(kinds[:, 0] + kinds[:, 1] + kinds[:, 3], 1)
    more = [distinct / some, np.log1p(distinct) / np.log(some + 1.72), (again[t.first[1:]] - again[t.first[:-1]]) / some, mean, spread, np.log1p(n), np.log1p(kinds[:, 5]), kinds[:, 1] / letters, np.sqrt(shares[:, _KINDS.index("symbol")]), np.sqrt(shares[:, _KINDS.index("bar")]), np.sqrt(shares[:, _KINDS.index("bang")])]
    return np.column_stack([shares, *more])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count, sums and sums of squares of a task's feature rows."""
    total = np.zeros(1 + 2 * WIDTH)
    for batch in batches:
        x = _matrix(batch.column(0))
        total += np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])
    yield _numbers(total)


def _numbers(values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([values.tolist()], pa.list_(pa.float64()))], names=["v"])


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), WIDTH)


def _added(parts: DataFrame) -> np.ndarray | None:
    """Sums of the arrays ``v`` by place; a row per place reaches the driver."""
    rows = parts.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
    return np.array([r["x"] for r in sorted(rows, key=lambda r: r["i"])]) if rows else None


def pair_sums(good: np.ndarray, poor: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Number of (good, poor) pairs, gradient and Hessian of their logistic loss; no pair is left out."""
    g, h = np.zeros(len(w)), np.zeros((len(w), len(w)))
    low = poor @ w
    for a in range(0, len(good), STEP):
        z = good[a : a + STEP]
        p = 1 / (1 + np.exp(-np.clip((z @ w)[:, None] - low, -30, 30)))
        g += z.T @ (p - 1).sum(1) - poor.T @ (p - 1).sum(0)
        v = p * (1 - p)
        cross = z.T @ v @ poor
        h += (z * v.sum(1)[:, None]).T @ z + (poor * v.sum(0)[:, None]).T @ poor - cross - cross.T
    return np.concatenate([[len(good) * len(poor)], g, h.ravel()])


def _pairs(mean: np.ndarray, scale: np.ndarray, w: np.ndarray):
    def run(rows: pa.Table) -> pa.Table:
        z = np.clip((_matrix(rows.column("x")) - mean) / scale, -6, 6)
        y = rows.column("y").to_numpy()
        return pa.Table.from_batches([_numbers(pair_sums(z[y == 1], z[y == 0], w))])

    return run


def _blocks(rows: DataFrame, sizes: dict) -> DataFrame:
    """The labelled rows in blocks that hold rows of both classes.

    The smaller class is dealt over blocks of about ``BLOCK`` rows. Where the other one is much larger, its rows of a block
    are dealt over several, each of which has the smaller class's rows of that block: copies are at most a quarter of the larger class.
    """
    few = min((0, 1), key=lambda c: sizes[c])
    blocks = 1 + sizes[few] // BLOCK
    parts = max(1, sizes[1 - few] // (4 * max(blocks * BLOCK, sizes[few])))
    own = F.when(F.col("y") == few, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(parts)).cast("int")))
    return rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int")).withColumn("part", F.explode(own))


def _quantile(scored: DataFrame, share: float, poor: float, good: float) -> float:
    """Middle of the score at which the weighted rows (``poor`` and ``good`` a row) reach the share, and the next one.

    The range that holds it is cut into 1,000 until few rows are left in it, which are then ordered.
    """
    weight = F.when(F.col("y") == 0, F.lit(poor)).otherwise(F.lit(good))
    low, high, n = scored.agg(F.min("s"), F.max("s"), F.count("*")).first()
    under = 0.0
    while n > 10_000 and high - low > 1e-12 * max(abs(low), abs(high), 1e-300):
        width = (high - low) / 1000
        inside = scored.where(F.col("s").between(low, high)).groupBy(F.least(F.floor((F.col("s") - low) / width), F.lit(999)).alias("bin"))
        bins = sorted(inside.agg(F.sum(weight), F.count("*"), F.min("s"), F.max("s")).collect())
        total, k = under, 0
        while k < len(bins) - 1 and total + bins[k][1] < share:
            total += bins[k][1]
            k += 1
        under, n, low = total, bins[k][2], bins[k][3]
        high = bins[k][4]
    rows = scored.where(F.col("s").between(low, high)).groupBy("s").agg(F.sum(weight).alias("w"), F.count("*").alias("n")).orderBy("s").limit(20_000).collect()
    at = next((i for i, r in enumerate(rows) if (under := under + r["w"]) >= share), len(rows) - 1)
    here = rows[at]["s"]
    after = scored.where(F.col("s") > here).agg(F.min("s")).first()[0]
    return (here + after) / 2 if after is not None else here


def newton(sums, width: int, steps: int = 30) -> np.ndarray:
    """Bradley-Terry weights by Newton steps; ``sums(w)`` are the pairs' sums at these weights."""
    w = np.zeros(width)
    for _ in range(steps):
        s = sums(w)
        n = max(s[0], 1)
        step = np.linalg.solve(s[1 + width :].reshape(width, width) / n + 1e-3 * np.eye(width), s[1 : 1 + width] / n + 1e-3 * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(x: np.ndarray, y: np.ndarray, drop_share: float, keep_at: float) -> dict | None:
    """The model of rows that are at hand: all their pairs are one block."""
    if len(y) == 0 or y.min() == y.max():
        return None
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.clip((x - mean) / scale, -6, 6)
    w = newton(lambda w: pair_sums(z[y == 1], z[y == 0], w), x.shape[1])
    score = z @ w
    order = np.argsort(score)
    share = np.where(y == 0, drop_share / (y == 0).sum(), (1 - drop_share) / (y == 1).sum())[order]
    at = min(int(np.searchsorted(np.cumsum(share), drop_share)), len(order) - 2)
    cut = (score[order[at]] + score[order[at + 1]]) / 2
    return {"mean": mean, "scale": scale, "w": w, "shift": np.log(keep_at / (1 - keep_at)) - cut}


def fit_rows(rows: DataFrame, drop_share: float, keep_at: float) -> dict | None:
    """The model of a table of rows (doc_id, x, y): weights and the quantile threshold from all of them."""
    sizes = {0: 0, 1: 0} | {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if not (sizes[0] and sizes[1]):
        return None
    total = _added(rows.select("x").mapInArrow(_moments, "v array<double>"))
    mean = total[1 : 1 + WIDTH] / total[0]
    scale = np.sqrt(np.maximum(total[1 + WIDTH :] / total[0] - mean**2, 0)) + 1e-9
    dealt = _blocks(rows, sizes)
    w = newton(lambda w: _added(dealt.groupBy("block", "part").applyInArrow(_pairs(mean, scale, w), "v array<double>")), WIDTH)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(np.clip((_matrix(batch.column(0)) - mean) / scale, -6, 6) @ w)], names=["y", "s"])

    cut = _quantile(rows.select("x", "y").mapInArrow(scores, "y int, s double"), drop_share, drop_share / sizes[0], (1 - drop_share) / sizes[1])
    return {"mean": mean, "scale": scale, "w": w, "shift": np.log(keep_at / (1 - keep_at)) - cut}


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, t in tokens(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(features(t).tolist(), pa.list_(pa.float64()))], names=["doc_id", "x"])


def _score(model, keep_at: float):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for a, b, t in tokens(batch.column(2)):
                z = np.clip((features(t) - m["mean"]) / m["scale"], -6, 6) @ m["w"] + m["shift"]
                score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(score), pa.array((score >= keep_at).astype(np.int32))], schema=schema)

    return run, "doc_id long, held_out boolean, score double, predicted int"


def labelled_features(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, x, y) of every labelled document with a text, outside the held-out fold; staged.

    A document with several label rows counts by the largest label, one with several texts by the least feature row.
    """
    y = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (crc_fold(F.col("doc_id"), 4) != 2))
         .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("y")))
    texts = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (crc_fold(F.col("doc_id"), 4) != 2))
    x = texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_features, "doc_id long, x array<double>")
    rows = x.join(y, "doc_id").groupBy("doc_id").agg(F.min("x").alias("x"), F.first("y").alias("y"))
    return Scratch(docs.sparkSession, "quality").stage(rows, "labelled")


def quality(docs: DataFrame, labels: DataFrame, keep_at: float = 0.7, drop_share: float | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; every labelled document outside the held-out fold is learned from."""
    spark = docs.sparkSession
    reachable(spark)
    learned = labels.where(F.col("quality").isNotNull() & (crc_fold(F.col("doc_id"), 4) != 2))
    if drop_share is None:
        poor = learned.agg(F.avg((F.col("quality") == 0).cast("double"))).first()[0]
        drop_share = poor or 0.0
    model = fit_rows(labelled_features(docs, labels), drop_share, keep_at)
    held = (crc_fold(F.col("doc_id"), 4) == 2).alias("held_out")
    ids = F.col("doc_id").cast("long").alias("doc_id")
    if model is None:
        return docs.select(ids, held, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    run, schema = _score(spark.sparkContext.broadcast(model), keep_at)
    return docs.select(ids, held, "text").mapInArrow(run, schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
