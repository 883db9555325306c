"""Jaccard join, line dedup and substring dedup against brute force on awkward rows."""

import hashlib
import os
import re
import sys
from collections import Counter

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
from cases import ascii_lower, awkward, documents, empty, prose, words  # noqa: E402

from notelab.llm.common import Scratch, components  # noqa: E402
from notelab.llm.jaccard import choose_matches, first_common, jaccard_components, parity, sharing  # noqa: E402
from notelab.llm.linedup import dedup_lines  # noqa: E402
from notelab.llm.substring import dedup_substrings  # noqa: E402


def key(row):
    return tuple((x is not None, x) for x in row)


def shingles(text, k):
    w = words(ascii_lower(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(rows, k, p):
    ids = [i for i, *_ in rows if i is not None]
    sets = {i: shingles(t, k) for i, t, *_ in rows if i is not None}
    low = {i: i for i in ids}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= p * len(sets[a] | sets[b])]
    for _ in ids:
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    return sorted((key((i, len(shingles(t, k)), None if i is None else low[i])) for i, t, *_ in rows))


@pytest.mark.parametrize(("k", "p"), [(3, 90), (5, 80)])
def test_jaccard_components(spark, k, p):
    rows = awkward()
    got = jaccard_components(documents(spark, rows), k=k, p=p).collect()
    assert sorted(key(r) for r in got) == brute_components(rows, k, p)


def test_jaccard_group_of_near_copies(spark):
    """Many edits of one text, linked through it only, beside a passage that all documents share."""
    shared, base, rows = prose(50, 12), prose(51, 120).split(), []
    for i in range(60):
        w = list(base)
        for j in range(1 + i % 4):
            w[(7 * i + 29 * j) % 120] = f"e{i}x{j}"
        rows.append((100 + i, " ".join(w), "en", "a"))
    rows.append((400, " ".join(base), "en", "a"))
    rows += [(500 + i, shared + " " + prose(600 + i, 40), "en", "a") for i in range(40)]
    got = jaccard_components(documents(spark, rows), k=3, p=90).collect()
    assert sorted(key(r) for r in got) == brute_components(rows, 3, 90)


def test_jaccard_family_just_under_the_threshold(spark):
    """A pair that shares most tokens without linking makes a row or two of the token join, not one per shared token."""
    rng, base, sets = np.random.default_rng(3), np.arange(1, 2001) * 7, {}
    for i in range(12):
        own = base.copy()
        own[rng.choice(2000, 110, replace=False)] = 7 * rng.choice(np.arange(2, 2000), 110, replace=False) + 1 + i % 6
        sets[i] = np.unique(own)
    near = sets[0].copy()
    near[rng.choice(len(near), 60, replace=False)] = 9_000_000 + np.arange(60)
    sets[12] = np.unique(near)
    rows, shared = [], 0
    for i, own in sets.items():
        n = len(own)
        held = own[: n + 8 - -(-90 * n // 100)].tolist()
        rows += [(t, i, (n << 32) + (8 << 8), j, i, held[max(0, j - 4) : j]) for j, t in enumerate(held)]
    seen = Counter(r[0] for r in rows)
    shared = sum(m * (m - 1) // 2 for m in seen.values())
    schema = "token long, doc_id long, meta long, place int, c long, before array<long>"
    tokens = spark.createDataFrame(rows, schema)
    pairs = first_common(tokens, 90, 100)
    assert shared > 5_000 and pairs.count() < 2 * len(sets) * (len(sets) - 1) // 2
    links = {(a, b) for a in sets for b in sets if a < b and 100 * len(np.intersect1d(sets[a], sets[b])) >= 90 * len(np.union1d(sets[a], sets[b]))}
    assert (0, 12) in links and len(links) < 40
    assert links <= {tuple(r) for r in sharing(pairs.distinct(), tokens, 90, 100).collect()}
    twice = spark.createDataFrame(rows + [r for r in rows if r[1] in (0, 12)], schema)  # repeated rows
    assert links <= {tuple(r) for r in sharing(first_common(twice, 90, 100).distinct(), twice, 90, 100).collect()}


def test_jaccard_texts_about_the_threshold(spark):
    """Families whose texts differ from each other by about as much as they may, of several sizes."""
    rows = []
    for family, n in enumerate((60, 150, 400, 900)):
        base = prose(700 + family, n).split()
        for i in range(14):
            w = list(base)
            for j in range(max(1, n // 110 + i % 3 - 1)):
                w[(n // 7 * i + 31 * j + 5) % n] = f"f{family}i{i}j{j}"
            rows.append((1000 * family + i, " ".join(w[: n - i % 4]), "en", "a"))
    got = jaccard_components(documents(spark, rows + rows[:5]), k=3, p=90).collect()
    assert sorted(key(r) for r in got) == brute_components(rows + rows[:5], 3, 90)


def test_jaccard_empty_table(spark):
    assert jaccard_components(empty(spark)).count() == 0


def test_longer_prefixes_for_costly_lists():
    cheap, costly = np.ones(60), np.full(60, 5000.0)
    assert choose_matches(cheap, 20, 100, 8, 8.0)[0] >= 1
    assert choose_matches(costly, 2, 100, 8, 8.0)[0] > choose_matches(costly, 2, 100, 8, 0.0)[0] == 1
    assert choose_matches(costly, 2, 3, 8, 8.0)[0] <= 3  # never more matches than the overlap that the threshold needs


def test_parity_bound():
    r = np.random.default_rng(0)
    a = np.unique(r.integers(0, 1 << 62, 300).astype(np.uint64))
    b = np.unique(np.concatenate([a[:280], r.integers(0, 1 << 62, 25).astype(np.uint64)]))
    bits = parity(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])).view(np.uint64)
    differing = sum(int(x).bit_count() for x in bits[0] ^ bits[1])
    assert differing <= len(np.setxor1d(a, b))


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 9), (7, 7), (3, 1), (20, 21), (21, 22), (22, 23), (23, 24)] + [(100, 200 + i) for i in range(50)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in components(df, Scratch(spark, "test")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 9, 10: 9, **{i: 20 for i in range(20, 25)}, 100: 100, **{200 + i: 100 for i in range(50)}}


def brute_lines(rows, m, long_words):
    def lines(t):
        return [y for y in (re.sub(r"[\x20\x09-\x0D]+$", "", x) for x in (t or "").split("\n")) if y]

    seen, out, done = {}, {}, set()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0))
    for i, t, *_ in order:
        if (i, t) in done:
            continue
        done.add((i, t))
        own, gone = lines(t), set()
        for j in range(len(own)):
            for n in ([m] if j + m <= len(own) else []) + ([1] if len(words(own[j])) >= long_words else []):
                run = tuple(own[j : j + n])
                if run in seen:
                    gone.update(range(j, j + n))
                seen.setdefault(run, (i, j))
        out[i, t] = (len(own), len(gone), t if not gone else "\n".join(x for j, x in enumerate(own) if j not in gone))
    return sorted(key((i, *out[i, t])) for i, t, *_ in rows)


@pytest.mark.parametrize("m", [2, 3])
def test_line_dedup(spark, m):
    rows = awkward()
    got = dedup_lines(documents(spark, rows), min_lines=m, min_words=30)
    assert got.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(key((r["doc_id"], r["n_lines"], r["n_removed"], r["text"])) for r in got.collect()) == brute_lines(rows, m, 30)


def test_line_dedup_empty_table(spark):
    assert dedup_lines(empty(spark)).count() == 0


def brute_substrings(rows, k):
    seen = Counter(tuple(w[j : j + k]) for w in (words(t) for _, t, *_ in rows) for j in range(len(w) - k + 1))
    out = []
    for i, t, *_ in rows:
        w = words(t)
        gone = {z for j in range(len(w) - k + 1) if seen[tuple(w[j : j + k])] > 1 for z in range(j, j + k)}
        kept = " ".join(x for z, x in enumerate(w) if z not in gone)
        out.append(key((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)))
    return sorted(out)


@pytest.mark.parametrize("k", [35, 8])
def test_substring_dedup(spark, k):
    rows = awkward()
    got = dedup_substrings(documents(spark, rows), window=k, with_text=True).collect()
    assert sorted(key(r) for r in got) == brute_substrings(rows, k)


def test_substring_dedup_empty_table(spark):
    assert dedup_substrings(empty(spark)).count() == 0


def test_unfinished_components_are_an_error(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    with pytest.raises(RuntimeError):
        components(chain, Scratch(spark, "test"), limit=2)
    assert {(r["node"], r["component"]) for r in components(chain, Scratch(spark, "test")).collect()} == {(i, 0) for i in range(201)}
    assert components(chain.limit(0), Scratch(spark, "test")).count() == 0
