"""Language id, toxicity and quality: gradients, exact chains, held-out accuracy, awkward rows."""

import itertools
import os
import random
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(__file__))
from cases import awkward, documents, empty, prose  # noqa: E402

from notelab.llm import langid, quality, toxicity  # noqa: E402
from notelab.llm.words import Tokens, buffers  # noqa: E402

LANGS = {"en": "the of and to in that is was for with", "de": "der die und ist nicht ein zu den von für", "fr": "le la et les des est une que dans où"}


def sentence(lang, seed, n=30):
    r = random.Random(seed)
    return " ".join(r.choice(LANGS[lang].split()) for _ in range(n))


def corpus():
    return [(i, sentence(lang, i), lang, "s") for i, lang in zip(range(240), itertools.cycle(LANGS))]


def test_language_id(spark):
    rows = corpus() + [(1000 + i, t, None, s) for i, (_, t, _, s) in enumerate(awkward())]
    got = langid.identify(documents(spark, rows), sample_docs=200).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    held = [r for i, _, lang, _ in rows[:240] if (r := by_id[i])["held_out"] for _ in [0]]
    assert held and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert np.mean([by_id[i]["lang_pred"] == lang for i, _, lang, _ in rows[:240] if by_id[i]["held_out"]]) > 0.95
    for i, t, _, _ in rows[240:]:
        assert (by_id[i]["lang_pred"] == "und") == (t is None or not any(c.isalpha() for c in t))
        assert 0 <= by_id[i]["score"] <= 1


def test_language_sample_has_every_language(spark):
    rows = [(i, sentence("de" if i % 3 else "en", i), "de" if i % 3 else "en", "s") for i in range(900)] + [(2000 + i, sentence("fr", i), "fr", "s") for i in range(4)]
    got = langid.learn_rows(documents(spark, rows), 40, 5, 0).toPandas()["lang"].value_counts().to_dict()
    fr = sum(zlib.crc32(str(2000 + i).encode()) % 5 != 0 for i in range(4))
    assert fr and got["fr"] == fr and sum(got.values()) == 40 and abs(got["de"] - got["en"]) <= 1


def test_language_id_without_rows_to_learn_from(spark):
    assert langid.identify(empty(spark)).count() == 0
    got = langid.identify(documents(spark, [(1, "abc", None, "s"), (None, None, None, None)])).collect()
    assert {(r["doc_id"], r["lang_pred"], r["score"]) for r in got} == {(1, "und", 0.0), (None, "und", 0.0)}


def test_accepted_keeps_all_columns(spark):
    rows = corpus()[:60] + [(900, "123 456", "en", "s"), (901, None, "en", "s")]
    df = documents(spark, rows)
    got = langid.accepted(df, 0.5, sample_docs=60)
    assert got.columns == df.columns
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(60))


def test_prediction_is_the_trained_network():
    """The batched float32 prediction against a plain loop over bytes; also however sequences are grouped."""
    texts = [sentence(lang, i).encode() for i, lang in enumerate(["en", "de", "fr"] * 6)]
    w = langid.train(texts, np.array([0, 1, 2] * 6), 3, steps=5)
    sig = langid._sigmoid

    def one(x):
        hidden = w["u"].shape[1]
        outs = []
        for d, seq in enumerate((x, x[::-1])):
            h, hs = np.zeros(hidden), []
            for byte in seq:
                g, u = w["x"][d, byte] + w["b"][d], h @ w["u"][d]
                z, r = sig(g[:hidden] + u[:hidden]), sig(g[hidden : 2 * hidden] + u[hidden : 2 * hidden])
                h = z * h + (1 - z) * np.tanh(g[2 * hidden :] + r * u[2 * hidden :])
                hs.append(h)
            outs.append(np.array(hs if d == 0 else hs[::-1]))
        p = np.exp(outs[0] @ w["v"][0] + outs[1] @ w["v"][1] + w["o"])
        return (p / p.sum(1, keepdims=True))[[langid._LETTER[b] for b in x]].sum(0)

    data = [b"der die und", b"", b"le", b"123", sentence("en", 5, 40).encode()]
    flat, offsets = buffers(pa.array(data, pa.binary()))
    for group in (2, 4096):
        got = langid.predict(langid.compact(w), flat, offsets, 64, group)
        for x, p in zip(data, got):
            total = sum((one(x[i : i + 64]) for i in range(0, len(x), 64)), np.zeros(3))
            letters = sum(langid._LETTER[b] for b in x)
            assert np.allclose(p, total / max(1, letters), atol=1e-4)


def test_chain_marginals_are_exact():
    r = np.random.default_rng(3)
    move, lengths = r.normal(size=(2, 2)), np.array([6, 4, 1])
    e = r.normal(size=(6, 3))
    o = toxicity.odds(e, lengths, move)
    for c, n in enumerate(lengths):
        weight = {y: np.exp(sum(e[t, c] * y[t] for t in range(n)) + sum(move[y[t], y[t + 1]] for t in range(n - 1))) for y in itertools.product((0, 1), repeat=int(n))}
        for t in range(n):
            p = sum(v for y, v in weight.items() if y[t]) / sum(weight.values())
            assert np.isclose(o[t, c] / (1 + o[t, c]), p)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    bad = ["snarp", "blorg", "vexid"]
    rows, marks = [], []
    for i in range(400):
        w = prose(i, 40, 300).split()
        if i % 5 == 0:
            for k in range(3):
                w[5 + 9 * k] = random.Random(i + k).choice(bad)
        rows.append((i, " ".join(w), "en", "s"))
        marks.append((i, 1, int(i % 5 == 0)))
    marks += [(0, 1, 1), (5000, 0, None), (None, 1, 1)]  # repeated, unknown and null rows of labels
    rows += [(1000 + i, t, la, s) for i, (_, t, la, s) in enumerate(awkward())]
    got = {r["doc_id"]: r for r in toxicity.toxicity(documents(spark, rows), labels(spark, marks)).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["predicted"] == int(i % 5 == 0) for i in range(400))
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for i, r in got.items())
    text = rows[10][1].encode()
    assert {text[s["start"] : s["end"]].decode() for s in got[10]["spans"]} <= set(bad) and got[10]["spans"]
    assert all(not got[1000 + i]["predicted"] for i in range(len(awkward())))


def test_quality(spark):
    rows = [(i, prose(i, 60) if i % 4 else " ".join(["spam!!"] * 40) + prose(i, 5).upper(), "en", "s") for i in range(200)]
    marks = [(i, int(i % 4 > 0), 0) for i in range(200)] + [(3, 1, 0), (999, None, None)]
    rows += [(1000 + i, t, la, s) for i, (_, t, la, s) in enumerate(awkward())]
    got = {r["doc_id"]: r for r in quality.quality(documents(spark, rows), labels(spark, marks)).collect()}
    assert len(got) == len(rows)
    assert np.mean([got[i]["predicted"] == int(i % 4 > 0) for i in range(200)]) > 0.98
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for i, r in got.items())


@pytest.mark.parametrize("score", [toxicity.toxicity, quality.quality])
def test_without_labels_or_rows(spark, score):
    none = labels(spark, [])
    assert score(empty(spark), none).count() == 0
    got = score(documents(spark, awkward()), none).collect()
    assert len(got) == len(awkward()) and all(r["score"] == 0 and r["predicted"] == 0 for r in got)
    one_class = labels(spark, [(1, 1, 1), (3, 1, 1)])
    assert all(r["score"] == 0 for r in score(documents(spark, awkward()), one_class).collect())


def test_pairwise_threshold_is_the_quantile():
    r = np.random.default_rng(1)
    y = (r.random(600) < 0.7).astype(int)
    x = np.column_stack([y + r.normal(0, 0.05, 600), r.normal(size=600)])
    m = quality.fit(x, y, drop_share=0.3, keep_at=0.7)
    score = 1 / (1 + np.exp(-(np.clip((x - m["mean"]) / m["scale"], -6, 6) @ m["w"] + m["shift"])))
    assert ((score >= 0.7) == (y == 1)).all()


def test_features_of_awkward_texts():
    t = Tokens(*buffers(pa.array([t for _, t, _, _ in awkward()], pa.string())), lower=False)
    assert np.isfinite(quality.features(t)).all()


def test_quality_learns_from_every_labelled_row(spark, monkeypatch):
    """All pairs of a block, none sampled: blocks in Spark give the plain sums, and a row that a sample leaves out changes the model."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, quality.WIDTH))
    y = (x[:, 0] + 0.5 * rng.normal(size=400) > 0.8).astype(int)
    frame = spark.createDataFrame([(i, r.tolist(), int(c)) for i, (r, c) in enumerate(zip(x, y))], "doc_id long, x array<double>, y int").repartition(3)
    want, got = quality.fit(x, y, 0.3, 0.7), quality.fit_rows(frame, 0.3, 0.7)
    for k in want:
        np.testing.assert_allclose(got[k], want[k], rtol=1e-6, atol=1e-8)
    pairs = quality.pair_sums(x[y == 1], x[y == 0], want["w"])
    d = (x[y == 1][:, None] - x[y == 0]).reshape(-1, quality.WIDTH)
    p = 1 / (1 + np.exp(-np.clip(d @ want["w"], -30, 30)))
    np.testing.assert_allclose(pairs[0], len(d))
    np.testing.assert_allclose(pairs[1 : 1 + quality.WIDTH], d.T @ (p - 1), rtol=1e-9, atol=1e-8)
    np.testing.assert_allclose(pairs[1 + quality.WIDTH :], ((d * (p * (1 - p))[:, None]).T @ d).ravel(), rtol=1e-9, atol=1e-8)
    monkeypatch.setattr(quality, "BLOCK", 10)  # many blocks, with the smaller class in each
    dealt = quality._blocks(frame, {0: int((y == 0).sum()), 1: int((y == 1).sum())}).groupBy("block", "part").agg({"y": "max", "doc_id": "count"}).collect()
    assert len(dealt) > 3 and all(r["max(y)"] == 1 for r in dealt)
    few = spark.createDataFrame([(i, [float(i)] * quality.WIDTH, int(i < 3)) for i in range(300)], "doc_id long, x array<double>, y int")
    parts = quality._blocks(few, {0: 297, 1: 3})
    assert parts.where("y = 0").count() == 297 and parts.where("y = 1").count() == 3 * parts.select("block", "part").distinct().count()


def test_quantile_is_exact(spark, monkeypatch):
    rng = np.random.default_rng(6)
    s, y = np.round(rng.normal(size=30_000), 4), rng.integers(0, 2, 30_000)
    frame = spark.createDataFrame(list(zip(y.tolist(), s.tolist())), "y int, s double")
    order = np.argsort(s, kind="stable")
    share = np.cumsum(np.where(y == 0, 0.4 / (y == 0).sum(), 0.6 / (y == 1).sum())[order])
    here = s[order][np.searchsorted(share, 0.4)]
    want = (here + s[s > here].min()) / 2
    assert abs(quality._quantile(frame, 0.4, 0.4 / (y == 0).sum(), 0.6 / (y == 1).sum()) - want) < 1e-9
