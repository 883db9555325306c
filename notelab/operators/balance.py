"""Balance-seeking grouped folds (M6): exchanges between folds until none improves the class shares.

Groups with the same (negatives, positives) are interchangeable, so the state is a histogram: how many groups of each
signature a fold holds.  It starts from the serpentine deal.  In a round every pair of folds looks for the exchange (a group of
one for a group of the other, or for nothing) that comes nearest to the difference that would even the pair out: for every
signature of the first fold the neighbours of the wanted signature, and of it without positives, among those of the second, by a
window over sorted signatures, so no pair of groups is ever formed.  The best exchange of each pair that gains is kept unless a better one
uses one of its folds; rounds end when no exchange gains.  Last, the groups of a signature are dealt by their rank.

The driver sees the folds' totals and one proposal per pair of folds and split number, never a group.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vocab import N_FOLDS
from ..session import stage
from .folds import folds_of_seeds
from .rank import global_rank

_SIGNATURE = ("random_number", "neg", "pos")
_LEAST_GAIN = 1e-12


def _histogram(folds: DataFrame) -> DataFrame:
    return folds.groupBy("random_number", (F.col("n") - F.col("pos")).alias("neg"), "pos", "fold").agg(F.count(F.lit(1)).alias("c"))


def _totals(state: DataFrame, seeds: Sequence[int], k: int) -> dict[int, list[list[int]]]:
    """Negatives and positives of every fold."""
    out = {s: [[0, 0] for _ in range(k)] for s in seeds}
    for r in state.groupBy("random_number", "fold").agg(F.sum(F.col("neg") * F.col("c")).alias("neg"), F.sum(F.col("pos") * F.col("c")).alias("pos")).collect():
        out[r["random_number"]][r["fold"]] = [r["neg"], r["pos"]]
    return out


def _excess(total: Column, moved: Column, whole: Column, k: int) -> Column:
    """Squared distance of a fold's share of a class from 1 / k."""
    return F.pow((total + moved) / whole - 1 / k, 2)


def _proposals(state: DataFrame, totals: dict, k: int) -> list:
    """The best exchange of every pair of folds: ``random_number, f, g, gain`` and both signatures ((0, 0): nothing)."""
    spark = state.sparkSession
    rows = []
    for seed, t in totals.items():
        whole = [float(max(1, sum(x[c] for x in t))) for c in (0, 1)]
        rows += [(seed, f, g, *map(float, (*t[f], *t[g], *whole))) for f, g in itertools.permutations(range(k), 2)]
    pairs = F.broadcast(spark.createDataFrame(rows, "random_number int, f int, g int, fn double, fp double, gn double, gp double, wn double, wp double"))  # k (k - 1) rows a split number
    nothing = spark.createDataFrame([(s, 0, 0, f) for s in totals for f in range(k)], "random_number int, neg long, pos long, fold int")
    held = state.select("random_number", "neg", "pos", "fold").unionByName(nothing)
    left = held.join(pairs, ["random_number"]).where("fold = f")
    wanted = F.floor(F.col("pos") - (F.col("fp") - F.col("gp")) / 2 + 0.5)
    asked = left.select("random_number", "f", "g", "neg", "pos", F.explode(F.array_distinct(F.array(F.lit(0).cast("long"), *[(wanted + o).cast("long") for o in (-1, 0, 1)]))).alias("key"), (F.col("neg") - (F.col("fn") - F.col("gn")) / 2).alias("x"), F.lit(1).alias("kind"))
    other = held.join(pairs.select("random_number", "f", "g"), ["random_number"]).where("fold = g").select(
        "random_number", "f", "g", "neg", "pos", F.col("pos").alias("key"), F.col("neg").cast("double").alias("x"), F.lit(0).alias("kind"))
    near = Window.partitionBy("random_number", "f", "g", "key").orderBy("x", "kind", "neg", "pos")
    there = F.when(F.col("kind") == 0, F.col("neg"))
    below = F.last(there, ignorenulls=True).over(near.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    above = F.first(there, ignorenulls=True).over(near.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    found = asked.unionByName(other).withColumns({"below": below, "above": above}).where("kind = 1")
    tried = found.select("random_number", "f", "g", "neg", "pos", F.col("key").alias("tpos"), F.explode(F.array("below", "above")).alias("tneg")).where("tneg IS NOT NULL").join(pairs, ["random_number", "f", "g"])
    n, p = F.col("tneg") - F.col("neg"), F.col("tpos") - F.col("pos")  # what f wins and g loses
    zero = F.lit(0)
    gain = sum(_excess(F.col(t), zero, F.col(w), k) - _excess(F.col(t), sign * m, F.col(w), k)
               for t, w, sign, m in (("fn", "wn", 1, n), ("fp", "wp", 1, p), ("gn", "wn", -1, n), ("gp", "wp", -1, p)))
    best = F.max(F.struct(gain.alias("gain"), "neg", "pos", "tneg", "tpos"))
    return tried.groupBy("random_number", "f", "g").agg(best.alias("b")).select("random_number", "f", "g", "b.*").where(F.col("gain") > _LEAST_GAIN).collect()


def _kept(proposals: list) -> list[tuple]:
    """Changes (random_number, neg, pos, fold, c) of the exchanges that no better one excludes."""
    used, changes = set(), []
    for r in sorted(proposals, key=lambda r: (-r["gain"], r["random_number"], r["f"], r["g"])):
        s, f, g = r["random_number"], r["f"], r["g"]
        if used & {(s, f), (s, g)}:
            continue
        used |= {(s, f), (s, g)}
        for a, b, neg, pos in ((f, g, r["neg"], r["pos"]), (g, f, r["tneg"], r["tpos"])):
            if neg or pos:
                changes += [(s, neg, pos, a, -1), (s, neg, pos, b, 1)]
    return changes


def balanced_folds(counts: DataFrame, seeds: Sequence[int] = (22,), k: int = N_FOLDS, group: str = "patient") -> DataFrame:
    """M6: ``random_number, group, fold, n, pos`` with folds 0..k-1 of balanced class shares, for every split number.

    Deterministic, and the same at any number of partitions.  Every round lowers the squared distances, so rounds end.
    """
    seeds, spark = list(dict.fromkeys(seeds)), counts.sparkSession
    dealt = folds_of_seeds(counts, seeds, k, group)
    state, moving = stage(_histogram(dealt).withColumn("random_number", F.col("random_number").cast("int"))), seeds
    while moving:
        now = state.where(F.col("random_number").isin(moving))
        changes = _kept(_proposals(now, _totals(now, moving, k), k))
        moving = sorted({c[0] for c in changes})
        if changes:
            moved = state.unionByName(spark.createDataFrame(changes, "random_number int, neg long, pos long, fold int, c long"))
            state = stage(moved.groupBy(*_SIGNATURE, "fold").agg(F.sum("c").alias("c")).where("c > 0"))
    upto = F.sum("c").over(Window.partitionBy(*_SIGNATURE).orderBy("fold"))  # at most k rows a signature
    ends = state.withColumn("e", upto).groupBy(*_SIGNATURE).agg(F.sort_array(F.collect_list(F.struct("e", "fold"))).alias("ends"))
    keyed = dealt.select(F.col("random_number").cast("int").alias("random_number"), group, "n", "pos", (F.col("n") - F.col("pos")).alias("neg"), F.md5(F.concat(F.col("random_number").cast("string"), F.lit(":"), F.col(group).cast("string"))).alias("_h"))
    ranked = global_rank(keyed, [*_SIGNATURE, "_h", group], "_r")
    first = ranked.groupBy(*_SIGNATURE).agg(F.min("_r").alias("_first"))
    placed = ranked.join(first.join(ends, list(_SIGNATURE)), list(_SIGNATURE))
    fold = F.get(F.filter("ends", lambda e: e["e"] > F.col("_r") - F.col("_first")), F.lit(0))["fold"]
    return placed.select("random_number", group, fold.alias("fold"), "n", "pos")
