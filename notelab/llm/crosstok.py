"""Operator 11: alignment of two tokenizers' tokens by lockstep vectorised merging.

A text is encoded by a byte-level vocabulary (A, space + text) and by a piece vocabulary (B, which puts the space
itself). One NumPy state vector holds the A and B pointers of all documents of a block; each step reads the byte ends at
both pointers, emits one link per document and a cut where both tokens end together, and moves the pointer of the token
that ends first (both on a cut). Finished documents are compacted away; as no document can finish before the smallest
number of tokens that is left on its longer side, the state is compacted after that many steps.

Cuts divide the tokens into groups; links join all tokens that share a byte. ``aligned`` returns ids, links and cuts per
document. ``digests`` has what ``op11_cross_tokenizer`` needs instead: counts, the hash of the groups, and the distinct
id pairs with their number of links. A pair's documents are counted over the whole corpus; the counts go back to the
documents by a broadcast of the ``FREQUENT`` most frequent pairs (a fixed bound, 2**18 rows of three numbers) and by an
equi-join for the others, which are rare and so not skewed.

Edge cases: texts that are null or empty, or whose joined bytes differ from space + text in A or B, have no tokens (zeros
and an empty string). Repeated rows and ids are documents of their own; null ids stay null; an empty table gives an empty
result; extra columns are ignored. Texts are taken in blocks of ``BLOCK`` bytes; a longer one is a block of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notelab.llm.common import Scratch, read, reachable
from notelab.llm.vocab import BYTE_BPE, PIECE_BPE, byte_level, piece_model
from notelab.llm.words import pieces

BLOCK = 4 << 20
#: Pairs whose counts are broadcast; all others are joined.
FREQUENT = 1 << 18


class Side:
    """One tokenizer's tokens of a block: flat ids, each document's first token, and each token's byte end in its text."""

    def __init__(self, ids: list[np.ndarray], sizes: np.ndarray):
        self.counts = np.array([len(i) for i in ids], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.ids = np.concatenate(ids).astype(np.int64) if ids else np.zeros(0, dtype=np.int64)
        total = np.cumsum(sizes[self.ids])
        before = np.concatenate([[0], total])[self.first[:-1]]
        self.ends = total - np.repeat(before, self.counts)


def _spelled(side: Side, flat: np.ndarray, start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The joined bytes of all tokens of a side."""
    n = sizes[side.ids]
    return flat[np.repeat(start[side.ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


@lru_cache(maxsize=4)
def _tables(vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All token bytes in a row, where each token's begin, and their numbers."""
    sizes = np.array([len(t) for t in vocabulary.bytes], dtype=np.int64)
    return np.frombuffer(b"".join(vocabulary.bytes), dtype=np.uint8), np.cumsum(sizes) - sizes, sizes


def encode(data: np.ndarray, offsets: np.ndarray, a: str, b: str) -> tuple[Side, Side]:
    """Both sides of a block of texts (bytes and row offsets); documents that don't give space + text on both have no tokens."""
    vocabularies, none = (byte_level(a), piece_model(b)), np.zeros(0, dtype=np.uint32)
    length = np.diff(offsets)
    texts = [data[s:e].tobytes().decode() for s, e in zip(offsets[:-1], offsets[1:], strict=True)]
    ids = [[vocabularies[0].ids(" " + t) if t else none for t in texts], [vocabularies[1].ids(t) if t else none for t in texts]]
    good = length > 0
    for v, own in zip(vocabularies, ids, strict=True):
        side = Side(own, _tables(v)[2])
        last = side.ends[np.maximum(side.first[1:] - 1, 0)] if len(side.ends) else np.zeros(len(own), dtype=np.int64)
        good &= (side.counts > 0) & (last == length + 1)
    while True:
        ids = [[i if g else none for i, g in zip(own, good, strict=True)] for own in ids]
        sides = tuple(Side(own, _tables(v)[2]) for own, v in zip(ids, vocabularies, strict=True))
        inside = np.repeat(good, length)
        want = np.insert(data[inside], (np.cumsum(length[good]) - length[good]), 32)
        edges = np.cumsum(length[good] + 1)
        wrong = np.zeros(len(good), dtype=bool)
        for side, v in zip(sides, vocabularies, strict=True):
            differs = np.flatnonzero(_spelled(side, *_tables(v)) != want)
            wrong[np.flatnonzero(good)[np.unique(np.searchsorted(edges, differs, side="right"))]] = True
        if not wrong.any():
            return sides
        good = good & ~wrong


def lockstep(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(flat A index, flat B index, whether both tokens end here) of every link in the documents' order, and each document's first link."""
    docs = np.flatnonzero(a.counts)
    room = np.concatenate([[0], np.cumsum(a.counts + b.counts)])  # a document has fewer links than tokens
    at_a, at_b = np.full(room[-1], -1, dtype=np.int64), np.empty(room[-1], dtype=np.int64)
    cut = np.zeros(room[-1], dtype=bool)
    i, j, slot = a.first[docs], b.first[docs], room[docs]
    stop_i, stop_j = a.first[docs + 1], b.first[docs + 1]
    ends_a, ends_b = a.ends, b.ends
    while len(i):
        for _ in range(int(np.maximum(stop_i - i, stop_j - j).min())):
            at_a[slot], at_b[slot] = i, j
            x, y = ends_a[i], ends_b[j]
            cut[slot] = x == y
            i = i + (x <= y)
            j = j + (y <= x)
            slot += 1
        open_ = i < stop_i
        i, j, slot, stop_i, stop_j = i[open_], j[open_], slot[open_], stop_i[open_], stop_j[open_]
    used = at_a >= 0
    return at_a[used], at_b[used], cut[used], np.concatenate([[0], np.cumsum(used)])[room]


@lru_cache(maxsize=4)
def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0..n-1, left-justified, with one more place for a separator; and the number of digits."""
    width = len(str(max(n - 1, 0)))
    table = np.array([str(i).ljust(width + 1) for i in range(n)], dtype=f"S{width + 1}").view(np.uint8).reshape(n, width + 1).copy()
    return table, np.array([len(str(i)) for i in range(n)])


def group_texts(a: Side, b: Side, at_a: np.ndarray, at_b: np.ndarray, cut: np.ndarray) -> list[bytes]:
    """Every document's groups as ``a1,a2|b1;a3|b2,b3``."""
    last_a, last_b = np.zeros(len(a.ids), dtype=bool), np.zeros(len(b.ids), dtype=bool)
    last_a[at_a[cut]] = True
    last_b[at_b[cut]] = True
    stop_a, stop_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    place_a = np.arange(len(a.ids)) + np.concatenate([[0], stop_b])[group_a]
    place_b = np.arange(len(b.ids)) + (stop_a[group_b] if len(group_b) else 0)
    n = len(a.ids) + len(b.ids)
    ids, mark = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.uint8)
    ids[place_a], ids[place_b] = a.ids, b.ids
    mark[place_a], mark[place_b] = np.where(last_a, ord("|"), ord(",")), np.where(last_b, ord(";"), ord(","))
    table, size = _digits(1 + max(int(ids.max(initial=0)), 1 << 16))
    lines, length = table[ids], size[ids]
    lines[np.arange(n), length] = mark
    flat = lines[np.arange(lines.shape[1]) <= length[:, None]]
    edges = np.concatenate([[0], np.cumsum(length + 1)])[a.first + b.first]
    return [flat[s : max(s, e - 1)].tobytes() for s, e in zip(edges[:-1], edges[1:], strict=True)]


def _lists(first: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values.astype(kind.to_pandas_dtype()), kind))


def aligned(docs: DataFrame, a: str = BYTE_BPE, b: str = PIECE_BPE, text_col: str = "text") -> DataFrame:
    """The rows without the text, with ids_a, ids_b, link_a, link_b (token numbers of each link) and cuts (byte offsets in space + text)."""
    reachable(docs.sparkSession)
    others = [c for c in docs.columns if c != text_col]
    if clash := {"ids_a", "ids_b", "link_a", "link_b", "cuts"} & {c.lower() for c in others}:
        raise ValueError(f"columns of the result: {sorted(clash)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, e, data, offsets in pieces(batch.column(len(others)), BLOCK):
                x, y = encode(data, offsets, a, b)
                at_a, at_b, cut, first = lockstep(x, y)
                cuts = np.concatenate([[0], np.cumsum(cut)])[first]
                made = [_lists(x.first, x.ids, pa.int32()), _lists(y.first, y.ids, pa.int32()), _lists(first, at_a - np.repeat(x.first[:-1], np.diff(first)), pa.int32()),
                        _lists(first, at_b - np.repeat(y.first[:-1], np.diff(first)), pa.int32()), _lists(cuts, x.ends[at_a[cut]], pa.int32())]
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(s, e - s) for i in range(len(others))], *made], names=[*others, "ids_a", "ids_b", "link_a", "link_b", "cuts"])

    kept = docs.select(*others, F.col(text_col))
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != text_col], *[f"{c} array<int>" for c in ("ids_a", "ids_b", "link_a", "link_b", "cuts")]])
    return kept.mapInArrow(run, schema)


def digests(docs: DataFrame, a: str = BYTE_BPE, b: str = PIECE_BPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times): pairs are distinct ``A id << 32 | B id`` with their links."""
    reachable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, e, data, offsets in pieces(batch.column(1), BLOCK):
                x, y = encode(data, offsets, a, b)
                at_a, at_b, cut, first = lockstep(x, y)
                texts = group_texts(x, y, at_a, at_b, cut)
                size, doc = int(y.ids.max(initial=0)) + 1, np.repeat(np.arange(e - s), np.diff(first))
                base = (int(x.ids.max(initial=0)) + 1) * size
                key, times = np.unique(doc * base + x.ids[at_a] * size + y.ids[at_b], return_counts=True)
                pair, edges = key % base, np.searchsorted(key, np.arange(e - s + 1) * base)
                groups = np.diff(np.concatenate([[0], np.cumsum(cut)])[first])
                sha = [hashlib.sha256(t).hexdigest() if t else "" for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s, e - s), pa.array(x.counts), pa.array(y.counts), pa.array(groups), pa.array(np.diff(first)), pa.array(sha, pa.string()),
                                                  _lists(edges, (pair // size) << 32 | pair % size, pa.int64()), _lists(edges, times, pa.int32())],
                                                 names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>")


def pair_counts(held: DataFrame) -> DataFrame:
    """(pair, docs, best): documents that hold each id pair, and whether none of its A id's pairs is held by more.

    Counts are combined in the tasks before the shuffle; an A id has at most as many pairs as B has ids.
    """
    counts = held.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs"))
    top = F.max("docs").over(Window.partitionBy(F.shiftright("pair", 32)))
    return counts.select("pair", "docs", (F.col("docs") == top).cast("long").alias("best"))


def with_counts(held: DataFrame, counts: DataFrame, scratch: Scratch, frequent: int = FREQUENT) -> DataFrame:
    """(row, n_best, count_sum) of every row with links; held has row, pairs, times."""
    links = held.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("row", F.col("l.pairs").alias("pair"), F.col("l.times").cast("long").alias("times"))
    top = scratch.stage(counts.orderBy(F.desc("docs"), "pair").limit(frequent), "frequent")
    found = links.join(F.broadcast(top), "pair", "left")
    hits = found.where(F.col("docs").isNotNull())
    if counts.count() > frequent:
        rest = counts.join(F.broadcast(top.select("pair")), "pair", "left_anti")
        hits = hits.unionByName(found.where(F.col("docs").isNull()).select("row", "pair", "times").join(rest, "pair"))
    return hits.groupBy("row").agg(F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))


def cross_tokenizer(docs: DataFrame, a: str = BYTE_BPE, b: str = PIECE_BPE, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """A row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    scratch = Scratch(docs.sparkSession, "crosstok")
    held = scratch.stage(digests(docs, a, b, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "held")
    counts = scratch.stage(pair_counts(held), "counts")
    sums = with_counts(held, counts, scratch, frequent)
    return held.drop("pairs", "times").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")], "groups_sha256")


def op11_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_tokenizer(read(spark, sf_dir, "documents"))
