"""Operator 1: toxic spans by a linear-chain conditional random field, document scores from its marginals.

Fitting, on a bounded sample of labelled documents (``POSITIVE`` and ``NEGATIVE`` documents):

1. Tokens are labelled from the documents' labels: a word, or a word beginning of 4 or 5 bytes, is offending if it occurs in
   toxic documents so much more often than its share of their words that chance (over the whole vocabulary) can't
   explain it, and hardly elsewhere. It is counted once per neighbourhood (word before, word after), so that copies of
   one document are no evidence.
2. A two-label chain is trained on windows of labelled tokens by exact gradients (forward-backward): features are the
   word, its beginnings, and the two neighbours.
3. A logistic curve turns a document's evidence (its largest marginal, and how many tokens are offending) into a score.

Scoring runs over all tokens of all texts: windows of ``WINDOW`` tokens with ``OVERLAP`` tokens of context on both sides
(the chain forgets its start within a few tokens), forward-backward over all windows of a piece at a time. Neighbouring
tokens with marginals over 0.5 are the offending spans, given as byte offsets into the UTF-8 text.

Edge cases: null, empty and blank texts get the score of a text without any evidence; without toxic or without clean
labelled rows every score is 0; repeated rows are scored alike; null ids belong to the fold of an empty id; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelab.llm.common import crc_fold, read, reachable
from notelab.llm.learn import labelled_sample
from notelab.llm.words import Tokens, mix, tokens

POSITIVE, NEGATIVE = 1500, 3000
#: Features of the field at most.
MAX_FEATURES = 4096
BEGINNINGS = (4, 5)
WINDOW, OVERLAP = 256, 16
SPAN = 24  # tokens of a training window on each side of its centre
SEED = 11


def beginnings(t: Tokens, size: int) -> np.ndarray:
    """Hashes of the words' first bytes; 0 for words that have no more than these."""
    out = np.zeros(len(t), dtype=np.uint64)
    longer = t.end - t.start > size
    at = t.start[longer]
    value = np.zeros(len(at), dtype=np.uint64)
    for j in range(size):
        value = (value << np.uint64(8)) | t.data[at + j].astype(np.uint64)
    out[longer] = mix(value + np.uint64(size << 56)) | np.uint64(1)
    return out


def _counted(key: np.ndarray, context: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys with their distinct contexts in toxic and in clean documents."""
    _, at = np.unique(mix(key + mix(context + y.astype(np.uint64))), return_index=True)
    keys, inverse = np.unique(key[at], return_inverse=True)
    toxic = y[at] == 1
    return keys, np.bincount(inverse, toxic), np.bincount(inverse, ~toxic)


def _evidence(pos: np.ndarray, neg: np.ndarray, share: float) -> np.ndarray:
    """Log-likelihood of the counts against the share that chance gives toxic documents; negative below the share."""
    n = pos + neg
    p = np.clip(pos / n, 1e-9, 1 - 1e-9)
    kl = n * (p * np.log(p / share) + (1 - p) * np.log((1 - p) / (1 - share)))
    return np.where(p > share, kl, -kl)


class Field:
    """The chain's parameters: feature hashes (sorted) with weights for token, previous and next token; bias; transitions."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.weight = np.zeros((3 + len(BEGINNINGS), len(keys) + 1))  # word, previous and next word, beginnings; the last column is "none"
        self.bias = np.zeros(1)
        self.move = np.zeros((2, 2))
        self.curve = np.zeros(3)
        self.filter = np.zeros(1 << 16, dtype=bool)
        self.filter[(keys & np.uint64(0xFFFF)).astype(np.int64)] = True

    def ids(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), len(self.keys))
        near = np.flatnonzero(self.filter[(h & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.searchsorted(self.keys, h[near])
        same = self.keys[np.minimum(at, len(self.keys) - 1)] == h[near] if len(self.keys) else np.zeros(0, dtype=bool)
        out[near[same]] = at[same]
        return out

    def emissions(self, t: Tokens) -> np.ndarray:
        """Log-odds of label 1 of each token before the chain."""
        word = self.ids(t.hashes())
        none = np.array([len(self.keys)])
        before, after = np.concatenate([none, word[:-1]]), np.concatenate([word[1:], none])
        edge = t.first[(t.first > 0) & (t.first < len(word))]
        before[edge], after[edge - 1] = none, none
        w = self.weight
        e = self.bias[0] + w[0][word] + w[1][before] + w[2][after]
        for k, size in enumerate(BEGINNINGS):
            e += w[3 + k][self.ids(beginnings(t, size))]
        return e


def odds(e: np.ndarray, length: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Marginal odds of label 1 for sequences in the columns of e (time, sequences), sorted by falling length.

    The forward and backward messages of a two-label chain are one number each, the ratio of label 1 to label 0.
    """
    top, n = e.shape
    live = np.searchsorted(-length, -np.arange(1, top + 1), side="right")
    x = np.exp(np.clip(e, -30, 30))
    (a, b), (c, d) = np.exp(move)  # a: 0 to 0, b: 0 to 1, c: 1 to 0, d: 1 to 1
    out = np.empty_like(x)
    f = x[0].copy()
    out[0] = f
    for t in range(1, top):
        k = int(live[t])
        g = f[:k]
        f = x[t, :k] * (b + d * g) / (a + c * g)
        out[t, :k] = f
    m = np.ones(n)
    for t in range(top - 2, -1, -1):
        k = int(live[t + 1])
        q = x[t + 1, :k] * m[:k]
        m[:k] = (c + d * q) / (a + b * q)
        out[t, :k] *= m[:k]
    return out


def marginals(field: Field, t: Tokens) -> np.ndarray:
    """Probability that each token is offending."""
    e = field.emissions(t)
    counts = t.counts
    per = -(-counts // WINDOW)
    row = np.repeat(np.arange(len(counts)), per)
    start = t.first[row] + (np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)) * WINDOW
    lo, hi = np.maximum(start - OVERLAP, t.first[row]), np.minimum(start + WINDOW + OVERLAP, t.first[row + 1])
    order = np.argsort(lo - hi, kind="stable")
    start, lo, hi = start[order], lo[order], hi[order]
    out, step = np.zeros(len(e)), 1024
    for i in range(0, len(lo), step):
        a, b, s = lo[i : i + step], hi[i : i + step], start[i : i + step]
        n = b - a
        place = a + np.arange(int(n[0]))[:, None]
        inside = place < b
        o = odds(e[np.minimum(place, len(e) - 1)], n, field.move)
        own = inside & (place >= s) & (place < s + WINDOW)
        out[place[own]] = o[own]
    return out / (1 + out)


def _train_chain(field: Field, features: np.ndarray, y: np.ndarray, steps: int = 120, rate: float = 0.15) -> None:
    """Adam on the chain's mean log-likelihood. features (kind, time, windows) are ids, y (time, windows) the labels."""
    top, n = y.shape
    full = np.full(n, top)
    params = {"weight": field.weight, "bias": field.bias, "move": field.move}
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}
    held = {(i, j): ((y[:-1] == i) & (y[1:] == j)).sum() for i in (0, 1) for j in (0, 1)}
    for step in range(1, steps + 1):
        e = field.bias[0] + sum(field.weight[k][features[k]] for k in range(len(features)))
        o = odds(e, full, field.move)
        p = o / (1 + o)
        d = (p - y) / n
        grad = {"weight": np.stack([np.bincount(features[k].ravel(), d.ravel(), minlength=field.weight.shape[1]) for k in range(len(features))]), "bias": np.array([d.sum()])}
        # pair marginals from forward messages and the marginals of the next token
        x, (f, pair) = np.exp(np.clip(e, -30, 30)), (None, np.zeros((2, 2)))
        f = x[0]
        m = np.exp(field.move)
        for t in range(1, top):
            w0, w1 = 1 / (1 + f), f / (1 + f)
            for j, pj in ((0, 1 - p[t]), (1, p[t])):
                low, high = w0 * m[0, j], w1 * m[1, j]
                pair[0, j] += (pj * low / (low + high)).sum()
                pair[1, j] += (pj * high / (low + high)).sum()
            f = x[t] * (m[0, 1] + m[1, 1] * f) / (m[0, 0] + m[1, 0] * f)
        grad["move"] = np.array([[pair[i, j] - held[i, j] for j in (0, 1)] for i in (0, 1)]) / n
        grad["weight"] += 1e-4 * field.weight
        grad["weight"][:, -1] = 0
        for k, v in params.items():
            a, b = moment[k]
            a += 0.1 * (grad[k] - a)
            b += 0.01 * (grad[k] ** 2 - b)
            v -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)


def _document_evidence(p: np.ndarray, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of the largest marginal of each row, and the logarithm of one plus its offending tokens."""
    filled = np.flatnonzero(t.counts)
    top = np.full(len(t.counts), 1e-4)
    if len(filled):
        top[filled] = np.maximum(1e-4, np.minimum(1 - 1e-4, np.maximum.reduceat(p, t.first[:-1][filled])))
    many = np.concatenate([[0], np.cumsum(p > 0.5)])
    return np.log(top / (1 - top)), np.log1p(many[t.first[1:]] - many[t.first[:-1]])


def fit(texts: list[str], toxic: np.ndarray) -> Field | None:
    """The field of a labelled sample; None if a class is missing."""
    if len(toxic) == 0 or toxic.min() == toxic.max():
        return None
    t = Tokens(*_joined(texts), lower=True, plain=True)
    h, row = t.hashes(), t.row_of_word()
    kinds, y = [h, *(beginnings(t, size) for size in BEGINNINGS)], toxic[row]
    none = np.zeros(1, dtype=np.uint64)
    context = mix(np.concatenate([none, h[:-1]]) ^ mix(np.concatenate([h[1:], none])))
    share = float(y.mean())
    bar = np.log(100.0 * len(np.unique(h)))
    label, useful = np.zeros(len(h), dtype=bool), []
    for key in kinds:
        keys, pos, neg = _counted(key, context, y)
        proof = _evidence(pos, neg, share)
        label |= np.isin(key, keys[(keys != 0) & (proof > bar) & (neg <= 0.1 * pos)])
        strong = np.argsort(-np.abs(proof))[: MAX_FEATURES // len(kinds)]
        useful.append(keys[strong][(np.abs(proof[strong]) > 0.5 * bar) & (keys[strong] != 0)])
    label = (label & (y == 1)).astype(np.int64)
    field = Field(np.unique(np.concatenate(useful)))
    rng = np.random.default_rng(SEED)
    spots = np.flatnonzero(label)
    centre = np.concatenate([rng.choice(spots, min(len(spots), 1500), replace=False), rng.integers(0, len(h), 3000)]) if len(h) else spots
    place = centre + np.arange(-SPAN, SPAN + 1)[:, None]
    same = (place >= 0) & (place < len(h))
    place = np.clip(place, 0, max(len(h) - 1, 0))
    same &= row[place] == row[centre]
    place = np.where(same, place, centre)  # past a text's border the centre is repeated: a window has one text only
    around = np.concatenate([[len(field.keys)], field.ids(h), [len(field.keys)]])
    _train_chain(field, np.stack([around[place + 1], around[place], around[place + 2], *(field.ids(x)[place] for x in kinds[1:])]), label[place])
    top, many = _document_evidence(marginals(field, t), t)
    x, w = np.stack([np.ones(len(top)), top, many]), np.zeros(3)
    for _ in range(300):  # logistic curve of the evidence, by gradient steps on a slightly regularised likelihood
        p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
        g = x @ (p - toxic) / len(toxic) + 1e-4 * w
        hess = (x * (p * (1 - p))) @ x.T / len(toxic) + 1e-4 * np.eye(3)
        new = w - np.linalg.solve(hess, g)
        if np.abs(new - w).max() < 1e-9:
            break
        w = new
    field.curve = w
    return field


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [x.encode() for x in texts]
    return np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)


def _spans(p: np.ndarray, t: Tokens) -> list[list[dict]]:
    """Byte ranges of neighbouring offending tokens by row."""
    out: list[list[dict]] = [[] for _ in t.counts]
    hot = np.flatnonzero(p > 0.5)
    if len(hot):
        row = np.searchsorted(t.first, hot, side="right") - 1
        new = np.concatenate([[True], (np.diff(hot) > 1) | (np.diff(row) > 0)])
        first, last = hot[new], hot[np.concatenate([new[1:], [True]])]
        for r, a, b in zip(row[new].tolist(), t.start[first].tolist(), t.end[last].tolist(), strict=True):
            out[r].append({"start": a - int(t.offsets[r]), "end": b - int(t.offsets[r])})
    return out


def _score(model, threshold: float):
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("spans", span)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = model.value
        for batch in batches:
            for a, b, t in tokens(batch.column(2), plain=True):
                p = marginals(field, t)
                top, many = _document_evidence(p, t)
                w = field.curve
                score = 1 / (1 + np.exp(-np.clip(w[0] + w[1] * top + w[2] * many, -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(_spans(p, t), span)], schema=schema)

    return run, "doc_id long, held_out boolean, score double, predicted int, spans array<struct<start:long,end:long>>"


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, positive: int = POSITIVE, negative: int = NEGATIVE) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans) of every document."""
    spark = docs.sparkSession
    reachable(spark)
    sample = labelled_sample(docs, labels, "toxic", {1: positive, 0: negative})
    field = fit(sample["text"].tolist(), sample["y"].to_numpy()) if len(sample) else None
    held = crc_fold(F.col("doc_id"), 4) == 2
    if field is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.expr("cast(array() as array<struct<start:long,end:long>>)").alias("spans"))
    run, schema = _score(spark.sparkContext.broadcast(field), threshold)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text").mapInArrow(run, schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
