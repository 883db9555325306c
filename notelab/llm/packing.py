"""Operator 12: best-fit packing of documents into fixed-length sequences by a grouping genetic algorithm.

A document's tokens and an end token are one piece; only documents over the capacity are cut, into pieces of the whole
capacity after a first one that may be shorter. Whole pieces fill a sequence each. The others are dealt by a hash of
their row over groups of about ``GROUP`` pieces, and every group is packed on ``ISLANDS`` islands:

- a solution gives each piece a bin; the first ones are best-fit packings of decreasing, differently disturbed lengths;
- crossover injects whole bins of one parent, the better filled the likelier, into the other, removes the other's bins
  that hold a piece again, and best-fits the displaced pieces, longest first;
- mutation dissolves the worst filled bins and a few others and best-fits their pieces;
- the fewest bins win, then the larger sum of squared fills.

An island's evolution is one row of an Arrow batch. After each of ``ROUNDS`` rounds populations are staged in the shared
folder and every island's elite moves to the next island of its group by an equi-join. The best solution of a group's
islands is taken. Random numbers depend on group, island and round alone, so that a repeated task gives the same result.

Edge cases: null and empty texts are a piece of the end token alone; repeated rows and ids are documents of their own;
null ids stay null; an empty table gives an empty result; extra columns are ignored. A text is never held longer than
its row's turn. ``pack`` takes any table with lengths from 1 to the capacity.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notelab.llm.common import Scratch, fresh, read, reachable
from notelab.llm.vocab import BYTE_BPE, byte_level
from notelab.llm.words import pieces

CAPACITY, END = 1024, 2
GROUP, ISLANDS, ROUNDS, GENERATIONS, POPULATION = 8192, 3, 3, 4, 5
SEED = 12


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: the first one takes what the others' whole capacities leave."""
    first = n - (n - 1) // capacity * capacity
    return [(0, first), *[(s, capacity) for s in range(first, n, capacity)]]


def token_pieces(docs: DataFrame, vocabulary: str = BYTE_BPE, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece, and its ids unless with_ids is false."""
    reachable(docs.sparkSession)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_level(vocabulary, special=True).ids
        for batch in batches:
            for a, b, data, offsets in pieces(batch.column(1)):
                rows, out, ids = [], [], []
                for r in range(b - a):
                    tokens = np.append(encode(data[offsets[r] : offsets[r + 1]].tobytes().decode()), np.uint32(end)).astype("<u4")
                    for k, (s, n) in enumerate(cut(len(tokens), capacity)):
                        piece = tokens[s : s + n]
                        rows.append(a + r)
                        out.append((k, s, n, zlib.crc32(piece.tobytes())))
                        if with_ids:
                            ids.append(piece.astype(np.int32))
                columns = [batch.column(0).take(pa.array(rows, pa.int64())), *[pa.array(c, pa.int32() if i == 0 else pa.int64()) for i, c in enumerate(zip(*out, strict=True))]]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(ids, pa.list_(pa.int32()))] if with_ids else []), names=names + (["ids"] if with_ids else []))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))


class Bins:
    """Bins by the room they have left; the best fit is the lowest set bit of a mask of the rooms in use."""

    def __init__(self, capacity: int, rooms: np.ndarray):
        self.capacity, self.n = capacity, len(rooms)
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]
        for b, room in enumerate(rooms.tolist()):
            self.at[room].append(b)
        self.mask = sum(1 << r for r, bins in enumerate(self.at) if bins and r)

    def put(self, lengths: list[int]) -> list[int]:
        """The bin of each length in turn: the fullest one that has room, else a new one."""
        at, mask, n, capacity, out = self.at, self.mask, self.n, self.capacity, []
        for size in lengths:
            fits = mask >> size
            if fits:
                room = size + (fits & -fits).bit_length() - 1
                bins = at[room]
                b = bins.pop()
                if not bins:
                    mask ^= 1 << room
            else:
                room, b = capacity, n
                n += 1
            left = room - size
            if left:
                at[left].append(b)
                mask |= 1 << left
            out.append(b)
        self.mask, self.n = mask, n
        return out


def _settle(assigned: np.ndarray, displaced: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The assignment with bins numbered anew and the displaced pieces (bin -1) best-fitted, longest first."""
    kept = assigned >= 0
    out = assigned.copy()
    _, out[kept] = np.unique(assigned[kept], return_inverse=True)
    fills = np.bincount(out[kept], weights=lengths[kept]).astype(np.int64)
    order = displaced[np.argsort(-lengths[displaced], kind="stable")]
    out[order] = Bins(capacity, capacity - fills).put(lengths[order].tolist())
    return out


def fitness(assigned: np.ndarray, lengths: np.ndarray) -> tuple[int, int]:
    """(bins, minus the sum of squared fills): less is better."""
    fills = np.bincount(assigned, weights=lengths).astype(np.int64)
    return len(fills), -int((fills * fills).sum())


def start(lengths: np.ndarray, capacity: int, noise: float, rng: np.random.Generator) -> np.ndarray:
    order = np.argsort(-lengths * (1 + noise * rng.random(len(lengths))), kind="stable")
    out = np.empty(len(lengths), dtype=np.int64)
    out[order] = Bins(capacity, np.zeros(0, dtype=np.int64)).put(lengths[order].tolist())
    return out


def crossover(into: np.ndarray, source: np.ndarray, lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    fills = np.bincount(source, weights=lengths) / capacity
    chosen = rng.random(len(fills)) < rng.uniform(0.1, 0.6) * fills**8
    injected = chosen[source]
    hit = np.zeros(into.max() + 1, dtype=bool)
    hit[into[injected]] = True  # bins that would hold an injected piece twice
    child = np.where(hit[into], -1, into)
    child[injected] = into.max() + 1 + source[injected]
    return _settle(child, np.flatnonzero(child < 0), lengths, capacity)


def mutate(assigned: np.ndarray, lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    fills = np.bincount(assigned, weights=lengths)
    gone = rng.random(len(fills)) < rng.uniform(0.01, 0.1)
    gone[np.argsort(fills, kind="stable")[: 1 + len(fills) // 50]] = True
    child = np.where(gone[assigned], -1, assigned)
    return _settle(child, np.flatnonzero(child < 0), lengths, capacity)


def evolve(lengths: np.ndarray, population: list[np.ndarray], migrant: np.ndarray | None, capacity: int, generations: int, size: int, rng: np.random.Generator, noise: float = 0.0) -> list[np.ndarray]:
    """An island's solutions after the generations, best first. An empty population starts anew."""
    if not population:
        population = [start(lengths, capacity, noise if i == 0 else 0.05 * i + noise, rng) for i in range(size)]
    if migrant is not None:
        population = [*population, migrant]
    ranked = sorted(((fitness(p, lengths), i, p) for i, p in enumerate(population)), key=lambda t: t[:2])
    least = -(-int(lengths.sum()) // capacity)
    born = len(ranked)
    for _ in range(generations):
        if ranked[0][0][0] == least:
            break
        children = []
        for _ in range(size - 1):
            x, y = sorted(rng.choice(len(ranked), 2, replace=len(ranked) < 2).tolist())
            one, two = (ranked[y][2], ranked[x][2]) if rng.random() < 0.5 else (ranked[x][2], ranked[y][2])
            child = crossover(one, two, lengths, capacity, rng)
            child = mutate(child, lengths, capacity, rng) if rng.random() < 0.6 else child
            children.append((fitness(child, lengths), born, child))
            born += 1
        seen, best = set(), []
        for t in sorted([*ranked, *children], key=lambda t: t[:2]):
            if t[0] not in seen:  # one solution of a fitness, so that the population stays mixed
                seen.add(t[0])
                best.append(t)
        ranked = best[:size]
    return [p for _, _, p in ranked[:size]]


def _blob(solutions: list[np.ndarray]) -> list[bytes]:
    return [p.astype("<u4").tobytes() for p in solutions]


def _island(number: int, capacity: int, generations: int, size: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.array(row["lengths"], dtype=np.int64)
                rng = np.random.default_rng([seed, row["grp"], row["island"], number])
                old = [np.frombuffer(p, dtype="<u4").astype(np.int64) for p in row["population"]]
                migrant = None if row["migrant"] is None else np.frombuffer(row["migrant"], dtype="<u4").astype(np.int64)
                new = evolve(lengths, old, migrant, capacity, generations, size, rng, noise=0.02 * row["island"])
                bins, squares = fitness(new[0], lengths)
                yield pa.RecordBatch.from_pylist([{"grp": row["grp"], "island": row["island"], "lengths": row["lengths"], "population": _blob(new), "bins": bins, "squares": squares}], schema=_ISLAND)

    return run


_ISLAND = pa.schema([("grp", pa.int64()), ("island", pa.int32()), ("lengths", pa.list_(pa.int32())), ("population", pa.list_(pa.binary())), ("bins", pa.int64()), ("squares", pa.int64())])
_ISLAND_SQL = "grp long, island int, lengths array<int>, population array<binary>, bins long, squares long"


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, grp, bin, offset) of a solution's pieces."""
    for batch in batches:
        for row in batch.to_pylist():
            assigned = np.frombuffer(row["solution"], dtype="<u4").astype(np.int64)
            lengths = np.array(row["lengths"], dtype=np.int64)
            order = np.argsort(assigned, kind="stable")
            before = np.cumsum(lengths[order]) - lengths[order]
            first = np.searchsorted(assigned[order], assigned[order])
            offset = np.empty(len(order), dtype=np.int64)
            offset[order] = before - before[first]
            yield pa.RecordBatch.from_arrays([pa.array(row["rows"], pa.int64()), pa.array(np.full(len(order), row["grp"])), pa.array(assigned), pa.array(offset)], names=["row", "grp", "bin", "offset"])


def pack(table: DataFrame, length: str = "length", capacity: int = CAPACITY, group: int = GROUP, islands: int = ISLANDS, rounds: int = ROUNDS, generations: int = GENERATIONS, population: int = POPULATION,
         seed: int = SEED) -> DataFrame:
    """The rows with sequence_id and offset; rows whose length isn't within 1 and the capacity are an error."""
    if clash := {"sequence_id", "offset"} & {c.lower() for c in table.columns}:
        raise ValueError(f"columns of the result: {sorted(clash)}")
    reachable(table.sparkSession)
    scratch, row = Scratch(table.sparkSession, "packing"), fresh(table, "row")
    n = F.col(length)
    checked = F.when(n.between(1, capacity), n).otherwise(F.raise_error(F.lit(f"{length} must be from 1 to {capacity}")))
    staged = scratch.stage(table.withColumn(length, checked).withColumn(row, F.monotonically_increasing_id()), "pieces")
    whole, short = staged.where(n == capacity), staged.where(n < capacity)
    groups = 1 + short.count() // group
    dealt = short.select(F.pmod(F.xxhash64(F.lit(seed), row), F.lit(groups)).alias("grp"), F.struct(F.col(row).alias("row"), n.cast("int").alias("length")).alias("p"))
    held = scratch.stage(dealt.groupBy("grp").agg(F.sort_array(F.collect_list("p")).alias("p")).select("grp", F.col("p.row").alias("rows"), F.col("p.length").alias("lengths")), "groups")
    tasks = 1 + groups * islands // 4

    def spread(df: DataFrame) -> DataFrame:
        return df.repartition(tasks, "grp", "island")

    state = held.select("grp", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "lengths", F.array().cast("array<binary>").alias("population"), F.lit(None).cast("binary").alias("migrant"))
    for number in range(rounds):
        ended = scratch.stage(spread(state).mapInArrow(_island(number, capacity, generations, population, seed), _ISLAND_SQL), f"round{number}")
        elites = ended.select("grp", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("population")[0].alias("migrant"))
        state = ended.select("grp", "island", "lengths", "population").join(elites, ["grp", "island"])
    best = ended.groupBy("grp").agg(F.min_by(F.struct(F.col("population")[0].alias("solution"), "lengths"), F.struct("bins", "squares", "island")).alias("b"))
    placed = best.join(held.select("grp", "rows"), "grp").select("grp", "rows", "b.lengths", "b.solution").mapInArrow(_places, "row long, grp long, bin long, offset long")
    ids = placed.select(F.col("row").alias(row), (F.col("grp") * F.lit(1 << 24) + F.col("bin")).alias("sequence_id"), "offset")
    return short.join(ids, row).drop(row).unionByName(whole.withColumn("sequence_id", -1 - F.col(row)).withColumn("offset", F.lit(0).cast("long")).drop(row))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = token_pieces(read(spark, sf_dir, "documents"), with_ids=False)
    out = pack(made)

    def column(name: str) -> Column:
        return F.col(name).cast("int" if name == "piece" else "long").alias(name)

    return out.select(*[column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")])
