"""Folds (A11, M6, M7, F4, F5) and metrics."""

import random

import numpy as np

from pyspark.sql import functions as F

from notelab.operators import folds as FO
from notelab.operators import metrics as M


def _pairs_auc(scores, labels):
    pos = [s for s, y in zip(scores, labels) if y == 1]
    neg = [s for s, y in zip(scores, labels) if y == 0]
    if not pos or not neg:
        return None
    wins = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return wins / (len(pos) * len(neg))


def test_auc_golden_and_single_class(spark):
    df = spark.createDataFrame([("a", .1, 0), ("a", .4, 0), ("a", .4, 1), ("a", .35, 1), ("a", .8, 1), ("a", .8, 0),
                                ("b", .3, 1), ("b", .2, 1)], "split string, score double, y int")
    got = {r.split: r.auc for r in M.exact_auc(df).collect()}
    assert abs(got["a"] - 5 / 9) < 1e-12 and got["b"] is None


def test_auc_matches_pair_count_and_is_rank_invariant(spark):
    rng = random.Random(7)
    data = [("s", round(rng.random(), 2), rng.randint(0, 1)) for _ in range(3000)]
    df = spark.createDataFrame(data, "split string, score double, y int")
    want = _pairs_auc([d[1] for d in data], [d[2] for d in data])
    got = M.exact_auc(df, scores_per_range=16).first().auc
    assert abs(got - want) < 1e-12
    cubed = df.withColumn("score", F.pow("score", 3) * 10 - 4)
    assert abs(M.exact_auc(cubed, scores_per_range=16).first().auc - want) < 1e-12


def test_note_rollup(spark):
    df = spark.createDataFrame([("t", "r", "n1", 0, .2), ("t", "r", "n1", 1, .1), ("t", "r", "n1", 0, .7)],
                               "split string, round string, xmi string, y int, score double")
    r = M.note_scores(df).first()
    assert (r.y, r.score) == (1, .7)


def test_group_folds_keep_groups_and_balance(spark):
    rng = random.Random(3)
    rows = []
    for g in range(400):
        for _ in range(rng.randint(1, 6)):
            rows.append((f"{g}", rng.randint(0, 1) if g % 3 else 0))
    df = spark.createDataFrame(rows, "patient string, y int")
    counts = FO.group_class_counts(df)
    folds = FO.group_folds(counts, k=5, seed=22)
    assert folds.select("patient").distinct().count() == folds.count() == 400
    per_fold = {r.fold: (r.g, r.pos) for r in folds.groupBy("fold").agg(F.count("*").alias("g"), F.sum((F.col("pos") > 0).cast("int")).alias("pos")).collect()}
    assert set(per_fold) == {0, 1, 2, 3, 4}
    gs = [v[0] for v in per_fold.values()]
    ps = [v[1] for v in per_fold.values()]
    assert max(gs) - min(gs) <= 2 and max(ps) - min(ps) <= 1
    again = {r.patient: r.fold for r in FO.group_folds(counts, k=5, seed=22).collect()}
    assert again == {r.patient: r.fold for r in folds.collect()}
    # the same folds however the counts are partitioned
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        other = {r.patient: r.fold for r in FO.group_folds(counts.repartition(7), k=5, seed=22).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert other == again


def test_rows_without_a_patient_stay(spark):
    df = spark.createDataFrame([("1", "a", 1), (None, "b", 0), (None, "c", 1)], "mrn string, note_id string, y int")
    rows = FO.with_patient(df)
    got = FO.assign_splits(rows, FO.group_folds(FO.group_class_counts(rows)))
    assert {(r.patient, r.y) for r in got.collect()} == {("1", 1), ("note:b", 0), ("note:c", 1)}


def test_global_rank(spark):
    from notelab.operators.rank import global_rank
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), "id")
    assert sorted((r["v"], r["rank"]) for r in global_rank(df, ["v", "id"]).collect()) == [(i, i) for i in range(1000)]


def test_splits_gate_and_fit_metrics(spark):
    df = spark.createDataFrame([("1", 1, 0.9), ("2", 0, 0.2), ("3", 1, 0.4), ("4", 0, 0.6)], "patient string, y int, score double")
    folds = spark.createDataFrame([("1", 0), ("2", 1), ("3", 2), ("4", 2)], "patient string, fold int")
    split = FO.assign_splits(df, folds)
    assert {r.patient: r.split for r in split.collect()} == {"1": "test", "2": "val", "3": "train", "4": "train"}
    gate = FO.balance_gate(split).first()
    assert (gate.pos_test, gate.pos_val, gate.passed) == (1, 0, True)
    fm = {r.split: r for r in M.fit_metrics(split).collect()}
    assert (fm["train"].accuracy, fm["train"].precision, fm["train"].recall) == (0.0, 0.0, 0.0)
    assert fm["test"].accuracy == 1.0 and fm["val"].precision is None


def test_auc_of_many_groups_in_many_ranges(spark):
    """A row's work doesn't grow with the number of ranges: no list of bounds is searched per row."""
    rng = np.random.default_rng(4)
    rows = [(int(g), int(y), float(s)) for g, y, s in zip(rng.integers(0, 9, 600), rng.integers(0, 2, 600), rng.integers(0, 40, 600) / 40)]
    made = M.exact_auc(spark.createDataFrame(rows, "g int, y int, score double"), by=["g"], scores_per_range=5)
    for r in made.collect():
        pos, neg = ([s for g, y, s in rows if g == r.g and y == c] for c in (1, 0))
        want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
        assert abs(r.auc - want) < 1e-12
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and "_bounds" not in plan
