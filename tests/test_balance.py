"""Balance-seeking grouped folds (M6) against a greedy deal."""

import numpy as np

from notelab.operators import balance as B
from notelab.operators import folds as FO


def spread(totals):
    return (totals / np.maximum(totals.sum(0), 1)).std(0).mean()


def greedy(groups, k, seed):
    """Largest spread of classes first, each to the fold that leaves the shares most even."""
    cls = np.stack([groups[:, 0] - groups[:, 1], groups[:, 1]], 1)
    cls = cls[np.random.default_rng(seed).permutation(len(cls))]
    totals = np.zeros((k, 2))
    for c in cls[np.argsort(-cls.std(1), kind="stable")]:
        tried = []
        for f in range(k):
            t = totals.copy()
            t[f] += c
            tried.append((spread(t), t[f].sum(), f))
        totals[min(tried)[2]] += c
    return spread(totals)


def some_groups(seed, n=60):
    rng = np.random.default_rng(seed)
    rows = 1 + rng.geometric(0.25, n)
    return np.stack([rows, rng.binomial(rows, rng.choice([0, 0.3, 0.6], n))], 1)


def test_balance_is_at_least_the_greedy_deals_on_20_seeds(spark):
    groups = some_groups(5)
    counts = spark.createDataFrame([(f"p{i}", int(n), int(p)) for i, (n, p) in enumerate(groups)], "patient string, n long, pos long")
    seeds = list(range(20))
    got = B.balanced_folds(counts, seeds).collect()
    assert len(got) == 20 * len(groups) and {(r.random_number, r.patient) for r in got} == {(s, f"p{i}") for s in seeds for i in range(len(groups))}
    own = {f"p{i}": tuple(g) for i, g in enumerate(groups)}
    for s in seeds:
        totals = np.zeros((5, 2))
        for r in (r for r in got if r.random_number == s):
            assert (r.n, r.pos) == own[r.patient]
            totals[r.fold] += (r.n - r.pos, r.pos)
        assert spread(totals) <= greedy(groups, 5, s) + 1e-12
    again = B.balanced_folds(counts.repartition(7), [3]).collect()
    assert {(r.patient, r.fold) for r in again} == {(r.patient, r.fold) for r in got if r.random_number == 3}


def test_unlike_sizes_and_edge_cases(spark):
    counts = spark.createDataFrame([("big", 1000, 400), *[(f"s{i}", 3, i % 2) for i in range(50)]], "patient string, n long, pos long")
    got = B.balanced_folds(counts, [1]).collect()
    big = next(r.fold for r in got if r.patient == "big")
    assert sum(r.fold == big for r in got) == 1 and {r.fold for r in got} == {0, 1, 2, 3, 4}
    assert B.balanced_folds(counts.limit(0), [1]).collect() == []
    assert [r.patient for r in B.balanced_folds(counts.where("patient = 'big'"), [1]).collect()] == ["big"]
    one = spark.createDataFrame([(f"p{i}", 2, 0) for i in range(11)], "patient string, n long, pos long")  # a single class
    sizes = np.bincount([r.fold for r in B.balanced_folds(one, [1]).collect()], minlength=5)
    assert sorted(sizes) == [2, 2, 2, 2, 3]


def test_folds_of_many_seeds_are_those_of_each(spark):
    counts = spark.createDataFrame([(f"p{i}", int(n), int(p)) for i, (n, p) in enumerate(some_groups(2))], "patient string, n long, pos long")
    together = {(r.random_number, r.patient): r.fold for r in FO.folds_of_seeds(counts, [1, 5, 22]).collect()}
    for s in (1, 5, 22):
        assert {r.patient: r.fold for r in FO.group_folds(counts, seed=s).collect()} == {p: f for (k, p), f in together.items() if k == s}
