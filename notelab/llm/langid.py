"""Operator 5: language identification by a bidirectional gated recurrent network over bytes.

The network is trained on the driver in numpy, by backpropagation through time, on a bounded sample of labelled
documents (``sample_docs`` snippets of ``SNIPPET`` characters at a pseudorandom place, shared evenly by the languages). Prediction runs in every task over
all bytes of all texts: texts are cut into sequences of ``window`` bytes, the two directions run over each sequence,
every byte gets a probability for each language, and a document's probabilities are the means over the bytes of its
letters (ASCII letters and all bytes above 127). ``score`` is the pooled probability of the predicted language.

Edge cases: texts that are null or hold no Unicode letter get ``und`` with score 0; without any labelled row to learn
from every document does; null languages are never learned; repeated rows are scored alike; an empty table gives an
empty result; extra columns are ignored by ``identify``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelab.llm.common import crc_fold, read, reachable
from notelab.llm.learn import even_shares, hash_sample_by
from notelab.llm.words import pieces

HIDDEN = 8
#: Characters of a training snippet; bytes of a training sequence.
SNIPPET, TRAIN_BYTES = 400, 96
SEED = 5
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def learn_rows(docs: DataFrame, sample_docs: int, folds: int, held: int) -> DataFrame:
    """Snippets of at most sample_docs labelled documents: of each language those with the smallest id hashes."""
    spot = F.lit(1) + F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.greatest(F.length("text") - SNIPPET, F.lit(0)) + 1)
    labelled = docs.where(F.col("lang").isNotNull() & (crc_fold(F.col("doc_id"), folds) != held)).withColumn("h", F.xxhash64("doc_id"))
    rows = labelled.where(F.col("text").rlike(r"\p{L}")).select("lang", F.col("text").substr(spot.cast("int"), F.lit(SNIPPET)).alias("text"), "h")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # a row per language
    return hash_sample_by(rows, "lang", even_shares(sizes, sample_docs), sizes, "lang", "text")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def train(texts: list[bytes], labels: np.ndarray, n_labels: int, steps: int = 160, batch: int = 128, rate: float = 0.02, hidden: int = HIDDEN, seed: int = SEED) -> dict:
    """Weights after Adam on the mean cross-entropy of all bytes. Both directions are the first axis of every array."""
    rng = np.random.default_rng(seed)
    t_len = TRAIN_BYTES
    rows = [(np.frombuffer(x[i : i + t_len], dtype=np.uint8), y) for x, y in zip(texts, labels, strict=True) for i in range(0, max(1, len(x) - t_len // 2), t_len)]
    data = np.zeros((len(rows), t_len), dtype=np.uint8)
    mask = np.zeros((len(rows), t_len), dtype=np.float64)
    for i, (x, _) in enumerate(rows):
        data[i, : len(x)], mask[i, : len(x)] = x, 1
    target = np.array([y for _, y in rows])
    weight = len(target) / (n_labels * np.bincount(target, minlength=n_labels).clip(1))
    w = {"x": rng.normal(0, 0.2, (2, 256, 3 * hidden)), "u": rng.normal(0, 0.3, (2, hidden, 3 * hidden)), "v": rng.normal(0, 0.3, (2, hidden, n_labels)), "b": np.zeros((2, 3 * hidden)), "o": np.zeros(n_labels)}
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    two = np.arange(2)[:, None]
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(rows), batch)
        x, m, y = data[pick], mask[pick], target[pick]
        seq = np.stack([x, x[:, ::-1]])  # (2, batch, time)
        live = np.stack([m, m[:, ::-1]])[..., None]
        h = np.zeros((2, batch, hidden))
        hs, zs, rs, cs, us = [h], [], [], [], []
        for t in range(t_len):
            g = w["x"][two, seq[:, :, t]] + w["b"][:, None]
            u = h @ w["u"]
            z, r = _sigmoid(g[..., :hidden] + u[..., :hidden]), _sigmoid(g[..., hidden : 2 * hidden] + u[..., hidden : 2 * hidden])
            c = np.tanh(g[..., 2 * hidden :] + r * u[..., 2 * hidden :])
            h = live[:, :, t] * (z * h + (1 - z) * c)
            for store, value in ((hs, h), (zs, z), (rs, r), (cs, c), (us, u[..., 2 * hidden :])):
                store.append(value)
        out = np.stack(hs[1:])  # (time, 2, batch, hidden)
        fwd, bwd = out[:, 0], out[::-1, 1]
        logits = fwd @ w["v"][0] + bwd @ w["v"][1] + w["o"]
        p = np.exp(logits - logits.max(-1, keepdims=True))
        p /= p.sum(-1, keepdims=True)
        p[:, np.arange(batch), y] -= 1
        d = p * (m.T * weight[y])[..., None] / m.sum()
        grad = {k: np.zeros_like(v) for k, v in w.items()}
        grad["o"] = d.sum((0, 1))
        grad["v"] = np.stack([np.einsum("tbh,tbl->hl", fwd, d), np.einsum("tbh,tbl->hl", bwd, d)])
        dout = np.stack([d @ w["v"][0].T, (d @ w["v"][1].T)[::-1]], axis=1)  # (time, 2, batch, hidden)
        dh = np.zeros((2, batch, hidden))
        for t in range(t_len - 1, -1, -1):
            dh = (dh + dout[t]) * live[:, :, t]
            z, r, c, u, prev = zs[t], rs[t], cs[t], us[t], hs[t]
            dc = dh * (1 - z) * (1 - c * c)
            dz, dr = dh * (prev - c) * z * (1 - z), dc * u * r * (1 - r)
            dg, du = np.concatenate([dz, dr, dc], -1), np.concatenate([dz, dr, dc * r], -1)
            grad["b"] += dg.sum(1)
            np.add.at(grad["x"], (two, seq[:, :, t]), dg)
            grad["u"] += prev.transpose(0, 2, 1) @ du
            dh = dh * z + du @ w["u"].transpose(0, 2, 1)
        lr = rate * min(1, 3 * (1 - step / (steps + 1)))
        norm = np.sqrt(sum((g * g).sum() for g in grad.values()))
        for k in w:
            g, (a, b) = grad[k] * min(1, 1 / (norm + 1e-9)), moment[k]
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w[k] = w[k] - lr * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return w


def compact(w: dict) -> dict:
    """For prediction: bias folded into the byte table, gate inputs halved (sigmoid by tanh), features first, float32."""
    hidden = w["u"].shape[1]
    half = np.r_[np.full(2 * hidden, 0.5), np.ones(hidden)]
    table = (w["x"] + w["b"][:, None]) * half
    return {"x": table.transpose(0, 2, 1).astype(np.float32), "u": (w["u"] * half).transpose(0, 2, 1).astype(np.float32), "v": w["v"].transpose(0, 2, 1).astype(np.float32), "o": w["o"].astype(np.float32)}


def _direction(w: dict, d: int, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Logits (time, labels, sequences) of one direction; the sequences are sorted by falling length."""
    table, u, v = w["x"][d], w["u"][d], w["v"][d]
    hidden, top = u.shape[1], int(length[0])
    live = np.searchsorted(-length, -np.arange(1, top + 1), side="right")  # sequences longer than t
    out = np.zeros((top, v.shape[0], len(length)), dtype=np.float32)
    h = np.zeros((hidden, len(length)), dtype=np.float32)
    for t in range(top):
        k = int(live[t])
        at = start[:k] + t if d == 0 else start[:k] + length[:k] - 1 - t
        g = np.take(table, data[at], axis=1)
        own = h[:, :k]
        a = u @ own
        gates = g[: 2 * hidden]
        gates += a[: 2 * hidden]
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        z, c = gates[:hidden], g[2 * hidden :]
        a[2 * hidden :] *= gates[hidden:]
        c += a[2 * hidden :]
        np.tanh(c, out=c)
        h = (own - c) * z
        h += c
        np.matmul(v, h, out=out[t, :, :k])
    return out


def predict(w: dict, data: np.ndarray, offsets: np.ndarray, window: int, group: int = 4096) -> np.ndarray:
    """Pooled probabilities of each row (rows, labels)."""
    rows, n_labels = len(offsets) - 1, len(w["o"])
    size = np.diff(offsets)
    per_row = -(-size // window)
    row = np.repeat(np.arange(rows), per_row)
    number = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    start = offsets[row] + number * window
    length = np.minimum(window, offsets[row + 1] - start)
    order = np.argsort(-length, kind="stable")
    row, start, length = row[order], start[order], length[order]
    pooled, seen = np.zeros((rows, n_labels)), np.zeros(rows)
    whole = int(np.searchsorted(-length, -window, side="right"))  # sequences of full length come first
    edges = [*range(0, whole, group), *range(whole, len(row), group), len(row)]
    for i, j in zip(edges[:-1], edges[1:], strict=True):
        s, n, r = start[i:j], length[i:j], row[i:j]
        logits, back = _direction(w, 0, data, s, n), _direction(w, 1, data, s, n)
        t = np.arange(int(n[0]))[:, None]
        if n[-1] == n[0]:
            logits += back[::-1]
            letter = _LETTER[data[s + t]].astype(np.float32)
        else:
            inside = t < n
            logits += np.take_along_axis(back, np.broadcast_to(np.where(inside, n - 1 - t, 0)[:, None], back.shape), axis=0)
            letter = (inside & _LETTER[data[np.where(inside, s + t, s)]]).astype(np.float32)
        del back
        logits += w["o"][:, None]
        np.exp(logits, out=logits)
        logits *= (letter / logits.sum(axis=1))[:, None]  # each letter's probabilities; other bytes don't count
        sums = logits.sum(axis=0)
        for k in range(n_labels):
            pooled[:, k] += np.bincount(r, sums[k], minlength=rows)
        seen += np.bincount(r, letter.sum(axis=0), minlength=rows)
        del logits, letter  # before the next group's arrays are made
    return pooled / np.maximum(seen, 1)[:, None]


def _label(model, languages: list[str], window: int):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, names = model.value, np.array(languages, dtype=object)
        for batch in batches:
            for a, b, data, offsets in pieces(batch.column(2)):
                p = predict(w, data, offsets, window)
                best = p.argmax(axis=1)
                known = batch.column(3).slice(a, b - a).to_numpy(zero_copy_only=False).astype(bool)
                name = np.where(known, names[best], "und")
                score = np.where(known, p[np.arange(len(p)), best], 0.0).clip(0, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(name, pa.string()), pa.array(score.astype(np.float64))], schema=schema)

    return run, "doc_id long, held_out boolean, lang_pred string, score double"


def fitted(docs: DataFrame, sample_docs: int, folds: int, held: int):
    """(broadcast weights, languages) learned from doc_id, text and lang of the documents; None without labelled rows."""
    sample = learn_rows(docs, sample_docs, folds, held).toPandas()
    if not len(sample):
        return None
    languages = sorted(sample["lang"].unique())
    weights = train([x.encode() for x in sample["text"]], sample["lang"].map(languages.index).to_numpy(), len(languages))
    return docs.sparkSession.sparkContext.broadcast(compact(weights)), languages


def identify(docs: DataFrame, sample_docs: int = 3000, folds: int = 5, held: int = 0, window: int = 256, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score); learns from the given documents' labels outside the held-out fold."""
    reachable(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    held_out = (crc_fold(F.col("doc_id"), folds) == held).alias("held_out")
    model = fitted(rows, sample_docs, folds, held)
    if model is None:
        return rows.select("doc_id", held_out, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    known = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("known")
    run, schema = _label(*model, window)
    return rows.select("doc_id", held_out, "text", known).mapInArrow(run, schema)


def _accept(model, text_at: int, window: int, min_score: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in pieces(batch.column(text_at)):
                keep = predict(model.value, data, offsets, window).max(axis=1) >= min_score
                yield batch.slice(a, b - a).filter(pa.array(keep))

    return run


def accepted(docs: DataFrame, min_score: float = 0.5, sample_docs: int = 3000, folds: int = 5, held: int = 0, window: int = 256) -> DataFrame:
    """The documents, all columns unchanged, with a letter and a language of at least that pooled probability.

    Without labelled rows to learn from, only texts without a letter are rejected.
    """
    reachable(docs.sparkSession)
    model = fitted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang"), sample_docs, folds, held)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return docs.where(F.col("text").rlike(r"\p{L}")).mapInArrow(_accept(model[0], docs.columns.index("text"), window, min_score), docs.schema)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents"))
