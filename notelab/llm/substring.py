"""Operator 10: exact substring dedup with fixed-block anchors.

A window of ``window`` words that occurs twice contains, in each of its places, one whole block of that document's own
non-overlapping division into blocks of ``(window + 1) // 2`` words. So:

1. Anchors. Every document's aligned blocks are the index; every rolling window of block length probes it. Both go to
   partitions by hash: a probe as 4 bytes, an index entry with its place. What one batch already decides (a block with
   two probes in the batch) isn't sent, and a batch sends at most two probes and one entry of one content, so content
   that a third of the corpus holds stays as small as the number of batches. The answer is each document's list of
   blocks whose content occurs elsewhere (a superset, by hash).
2. Extension. Around those blocks all windows of full length are compared by a wider hash (64 bits in one of many
   partitions by a second hash), again with what a batch can decide left out. The windows that occur at least twice,
   joined where they overlap or touch, are the maximal exact repeats.
3. The words they cover go; all other documents pass through unchanged.

Documents travel in cells of bounded size (a hash of the id and the text), so all tasks stay bounded; a single text is
the unit that isn't split. Candidate documents are told from the rest by a fixed-size bitmap before any text is moved;
false hits of the bitmap or of short hashes only cost time.

Edge cases: null, empty and blank texts have no words (hash of the empty text); texts under ``window`` words lose
nothing; repeated rows are repeats of each other and lose all their windows, also when ids are null or equal; windows
never cross documents; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelab.llm.common import Scratch, bitmap, read, slot
from notelab.llm.words import Tokens, buffers, tokens, windows

#: Text bytes of one cell of candidate documents, and of one partition of hashes.
CELL_BYTES = 4 << 20
PARTITION_BYTES = 6 << 20
#: Text bytes whose windows are compared before anything is sent.
PIECE = 4 << 20
LEAST_PARTITIONS = 256

_SEND = pa.schema([("p", pa.int32()), ("probes", pa.binary()), ("refs", pa.binary()), ("key", pa.binary()), ("block", pa.binary()), ("known", pa.bool_())])
_SEND_SQL = "p int, probes binary, refs binary, key binary, block binary, known boolean"


def _split(values: np.ndarray, part: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the values by partition and the partitions' bounds in it."""
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(n + 1))


def _anchors(block: int, window: int, parts: int):
    """Probes and index entries of the texts of at least window words, by partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, t in tokens(batch.column(1), size=PIECE):
                keys = batch.column(0).slice(a, b - a).to_numpy()
                counts = t.counts
                if not (counts >= window).any():
                    continue
                h, at = windows(t.hashes(), t.first, block)
                row = np.searchsorted(t.first, at, side="right") - 1
                enough = counts[row] >= window
                h, at, row = h[enough], at[enough], row[enough]
                content, inverse, times = np.unique(h, return_inverse=True, return_counts=True)
                offset = at - t.first[row]
                aligned = np.flatnonzero(offset % block == 0)
                seen = times[inverse[aligned]] > 1
                known, asked = aligned[seen], aligned[~seen]
                # a content twice in this batch is sent as two probes; its index entries are answered here
                probes = np.concatenate([content, content[times > 1]])
                part_p = ((probes >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)
                part_r = ((h[asked] >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)
                op, bp = _split(probes, part_p, parts)
                orf, br = _split(h[asked], part_r, parts)
                fp = probes[op].astype(np.uint32)
                fr, kr, lr = h[asked][orf].astype(np.uint32), keys[row[asked]][orf], (offset[asked] // block)[orf].astype(np.int32)
                out = [[], [], [], [], [], []]
                for p in range(parts):
                    x, y = slice(bp[p], bp[p + 1]), slice(br[p], br[p + 1])
                    for column, value in zip(out, (p, fp[x].tobytes(), fr[y].tobytes(), kr[y].tobytes(), lr[y].tobytes(), False), strict=True):
                        column.append(value)
                for i in range(0, len(known), 1 << 16):
                    k = known[i : i + (1 << 16)]
                    spread = int(keys[row[k[0]]] % parts)
                    for column, value in zip(out, (spread, b"", b"", keys[row[k]].tobytes(), (offset[k] // block).astype(np.int32).tobytes(), True), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _SEND, strict=True)], schema=_SEND)

    return run


def _joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    raws = [np.frombuffer(buffers(chunk)[0].tobytes(), dtype=kind) for chunk in column.chunks]
    return np.concatenate(raws) if raws else np.zeros(0, dtype=kind)


def _repeated_blocks(table: pa.Table) -> pa.Table:
    """Index entries of one partition whose content is probed at least twice, and the entries known before."""
    known = table.filter(table.column("known"))
    asked = table.filter(pc.invert(table.column("known")))
    probes = np.sort(_joined(asked.column("probes"), np.uint32))
    refs = _joined(asked.column("refs"), np.uint32)
    twice = np.searchsorted(probes, refs, side="right") - np.searchsorted(probes, refs, side="left") > 1
    keys = np.concatenate([_joined(asked.column("key"), np.int64)[twice], _joined(known.column("key"), np.int64)])
    blocks = np.concatenate([_joined(asked.column("block"), np.int32)[twice], _joined(known.column("block"), np.int32)])
    return pa.table([pa.array(keys), pa.array(blocks)], names=["key", "block"])


def _wanted_windows(t: Tokens, blocks: list, block: int, window: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first words of the windows that hold a repeated block."""
    h, at = windows(t.hashes(salt), t.first, window, salt)
    hit = np.zeros(len(t) + 1, dtype=np.int32)
    for r, own in enumerate(blocks):
        own = np.asarray(own if own is not None else [], dtype=np.int64) * block
        start = t.first[r] + np.maximum(own - (window - block), 0)
        np.add.at(hit, start, 1)
        np.add.at(hit, t.first[r] + np.minimum(own + 1, t.counts[r]), -1)
    near = np.cumsum(hit)[at] > 0
    return h[near], at[near]


def _cell_rows(batch) -> pa.Table:
    """The rows of a cell in an order that any run repeats."""
    return batch.sort_by([("key", "ascending"), ("id_null", "ascending"), ("doc_id", "ascending")])


def _extend(block: int, window: int, parts: int):
    """Windows of one cell: content hash and number within the cell, by partition; contents that the cell decides are sent as a mere presence."""

    def run(table: pa.Table) -> pa.Table:
        table = _cell_rows(table)
        cell = table.column("cell")[0].as_py()
        blocks = table.column("blocks").to_pylist()
        h, part = [], []
        for a, b, t in tokens(table.column("text"), size=PIECE):
            one, _ = _wanted_windows(t, blocks[a:b], block, window, 0)
            two, _ = _wanted_windows(t, blocks[a:b], block, window, 1)
            h.append(one)
            part.append((two >> np.uint64(32)) % np.uint64(parts))
        h, part = np.concatenate(h), np.concatenate(part).astype(np.int64)
        order = np.lexsort((h, part))
        h, part = h[order], part[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (part[1:] != part[:-1])]) if len(h) else np.zeros(0, dtype=bool)
        group = np.cumsum(new) - 1
        times = np.bincount(group, minlength=1)[group] if len(h) else np.zeros(0, dtype=np.int64)
        single = times == 1
        bounds_s = np.searchsorted(part[single], np.arange(parts + 1))
        bounds_m = np.searchsorted(part[new & ~single], np.arange(parts + 1))
        hs, ns, hm = h[single], order[single].astype(np.uint32), h[new & ~single]
        rows = [(cell, p, hs[bounds_s[p] : bounds_s[p + 1]].tobytes(), ns[bounds_s[p] : bounds_s[p + 1]].tobytes(), hm[bounds_m[p] : bounds_m[p + 1]].tobytes(), False) for p in range(parts)]
        rows = [r for r in rows if r[2] or r[4]]
        rows.append((cell, cell % parts, b"", order[~single].astype(np.uint32).tobytes(), b"", True))
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.bool_())
        return pa.table([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["cell", "p", "once", "number", "more", "known"])

    return run


def _repeated_windows(table: pa.Table) -> pa.Table:
    """Of one partition: numbers, by cell, of the windows whose content occurs at least twice, and those known before."""
    known, table = table.filter(table.column("known")), table.filter(pc.invert(table.column("known")))
    once, more = _joined(table.column("once"), np.uint64), _joined(table.column("more"), np.uint64)
    number = _joined(table.column("number"), np.uint32)
    every = np.sort(np.concatenate([once, more, more]))
    twice = np.searchsorted(every, once, side="right") - np.searchsorted(every, once, side="left") > 1
    sizes = pc.binary_length(table.column("once")).to_numpy() // 8
    ends = np.cumsum(sizes)
    out = [(c, number[e - n : e][twice[e - n : e]].tobytes()) for c, e, n in zip(table.column("cell").to_pylist(), ends.tolist(), sizes.tolist(), strict=True)]
    out = [x for x in out if x[1]]
    mine = pa.table([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], names=["cell", "number"])
    return pa.concat_tables([mine, known.select(["cell", "number"])])


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])
_RESULT_SQL = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def _result(t: Tokens, ids: pa.Array, covered: np.ndarray | None, with_text: bool) -> pa.RecordBatch:
    n, removed, sha, kept = [], [], [], []
    for r in range(len(t.first) - 1):
        gone = covered[t.first[r] : t.first[r + 1]] if covered is not None else None
        text = t.text(r, ~gone if gone is not None else None)
        n.append(int(t.counts[r]))
        removed.append(int(gone.sum()) if gone is not None else 0)
        sha.append(hashlib.sha256(text).hexdigest())
        kept.append(text.decode("utf-8", "replace") if with_text else None)
    return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())], schema=_RESULT)


def _cover(block: int, window: int, with_text: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return _RESULT.empty_table()
        table = _cell_rows(left)
        blocks, ids = table.column("blocks").to_pylist(), table.column("doc_id").combine_chunks()
        numbers, out, base = _joined(right.column("number"), np.uint32).astype(np.int64), [], 0
        numbers.sort()
        for a, b, t in tokens(table.column("text"), size=PIECE):
            _, at = _wanted_windows(t, blocks[a:b], block, window, 0)
            i, j = np.searchsorted(numbers, [base, base + len(at)])
            starts = at[numbers[i:j] - base]
            base += len(at)
            change = np.zeros(len(t) + 1, dtype=np.int64)
            np.add.at(change, starts, 1)
            np.add.at(change, starts + window, -1)
            out.append(_result(t, ids.slice(a, b - a), np.cumsum(change)[:-1] > 0, with_text))
        return pa.Table.from_batches(out, schema=_RESULT)

    return run


def _pick(wanted, candidates: bool):
    """Rows whose key may be (or can't be) a candidate's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = np.unpackbits(wanted.value, bitorder="little").view(bool)
        for batch in batches:
            yield batch.filter(pa.array(keep[slot(batch.column(0).to_numpy())] == candidates))

    return run


def _unchanged(wanted, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pick(wanted, False)(batches):
            for a, b, t in tokens(batch.column(1), size=PIECE):
                yield _result(t, batch.column(2).slice(a, b - a), None, with_text)

    return run


def dedup_substrings(docs: DataFrame, window: int = 35, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text): words left when every repeated window's words go.

    kept_text (kept words joined by one space) is null unless with_text.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring")
    block = (window + 1) // 2
    # rows are told apart by a hash of id and text; equal rows share it and are treated alike
    texts = docs.select(F.xxhash64(id_col, text_col).alias("key"), F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("doc_id"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    parts = max(LEAST_PARTITIONS, -(-size // PARTITION_BYTES))

    sent = texts.select("key", "text").mapInArrow(_anchors(block, window, parts), _SEND_SQL)
    hits = sent.groupBy("p").applyInArrow(_repeated_blocks, "key long, block int")
    blocks = scratch.stage(hits.groupBy("key").agg(F.array_sort(F.collect_set("block")).alias("blocks")), "blocks")

    wanted = spark.sparkContext.broadcast(np.packbits(bitmap(blocks, "key"), bitorder="little"))
    moved = texts.mapInArrow(_pick(wanted, True), "key long, text string, doc_id long")
    cells = max(1, -(-size // CELL_BYTES))
    candidates = (moved.join(blocks, "key", "left").withColumn("cell", F.pmod(F.xxhash64("key", F.rand(7)), F.lit(cells)))
                  .withColumn("id_null", F.col("doc_id").isNull()))
    candidates = scratch.stage(candidates, "candidates")
    found = candidates.groupBy("cell").applyInArrow(_extend(block, window, parts), "cell long, p int, once binary, number binary, more binary, known boolean")
    numbers = found.groupBy("p").applyInArrow(_repeated_windows, "cell long, number binary")
    changed = candidates.groupBy("cell").cogroup(numbers.groupBy("cell")).applyInArrow(_cover(block, window, with_text), _RESULT_SQL)
    return changed.unionByName(texts.mapInArrow(_unchanged(wanted, with_text), _RESULT_SQL))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(read(spark, sf_dir, "documents")).drop("kept_text")
