"""Operator 8: Jaccard join of word shingle sets with adaptive multi-match prefixes.

All sets are sorted by one global order (estimated frequency class, then hash). If two sets are similar enough, their
l-prefixes (the base prefix |x| - ceil(t|x|) + 1 lengthened by l - 1 tokens) share at least l tokens. Every document
chooses its own l from 1 to ``max_matches``, where the estimated cost of its index entries plus that of its candidates
is least; a pair must share as many tokens as its two sizes and prefix lengths demand before it is verified.

Steps, each a Spark job over all documents:

1. One pass over the texts gives each document's set size and 128-bit set signature, and a fixed-size frequency sketch
   (2**18 counters, used for the order and the cost estimate only, never for a decision on a pair).
2. Documents with equal sets collapse to their smallest id.
3. A second pass emits the prefix tokens of the representatives; one shuffle by token keeps tokens that two hold.
4. Each document is verified against up to three hubs of its tokens' lists (of each list the holder with the longest
   lists, in a group of near copies likely the text that the others were made from, and two pseudorandom holders, the
   same ones for all lists that hold them); components of these links follow.
5. Pairs of *different* components that share enough prefix tokens are all verified, so no link that could join two
   components is lost, while a group of thousands of near copies isn't expanded into all its pairs. A pair must come up
   at its first common token only: rows carry their document's preceding tokens, and a token that follows a common one
   closely makes no row, so a pair makes about one row, not one per common token.
6. Components of all links, spread back to the copies.

Before sets are compared, pairs must pass an exact bound: the parity bitmaps of two sets (512 bits in the join, 1024 bits
afterwards) differ in at most as many bits as the sets differ in elements.

A token is held by a document at most once and a document emits about (1 - t) |x| tokens, rarest first, so a passage
that a third of all documents share only enters the prefix of documents that hold little else.

Edge cases: null, empty and blank texts have an empty set and are linked with nothing; a text of fewer words than k is
one element; null ids give rows with a null component that link with nothing; repeated rows are equal sets; an empty
table gives an empty result; ids are expected to name one text; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from notelab.llm.common import Scratch, bitmap, components, read, slot
from notelab.llm.words import Tokens, mix, powers, tokens, windows

SKETCH_BITS = 18
PARITY_BITS = 1024
#: Preceding tokens of its document that a row of the token join carries.
BEFORE = 4


def shingle_sets(t: Tokens, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every row, one after another, and the rows' offsets."""
    h = t.hashes()
    w, _ = windows(h, t.first, k)
    counts = t.counts
    at = np.concatenate([[0], np.cumsum(np.maximum(counts - k + 1, 0))])
    short = {}
    for c in range(1, k):
        rows = np.flatnonzero(counts == c)
        if len(rows):
            grid = h[t.first[rows][:, None] + np.arange(c)]
            short.update(zip(rows.tolist(), mix((grid * powers(c, 100 + c)[0]).sum(axis=1, dtype=np.uint64)), strict=True))
    sets = []
    for r in range(len(counts)):
        if counts[r] >= k:
            s = np.sort(w[at[r] : at[r + 1]])
            sets.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif counts[r]:
            sets.append(np.array([short[r]], dtype=np.uint64))
        else:
            sets.append(np.zeros(0, dtype=np.uint64))
    return (np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.uint64)]).astype(np.uint64)
    return total[at[1:]] - total[at[:-1]]


def parity(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(rows, 16) int64: bit b of the 1024 is the parity of the number of elements that hash to b."""
    rows = len(at) - 1
    out = np.empty((rows, PARITY_BITS // 64), dtype=np.int64)
    bit = (sets % np.uint64(PARITY_BITS)).astype(np.int64)
    for a in range(0, rows, 1024):
        b = min(rows, a + 1024)
        own = np.repeat(np.arange(b - a), np.diff(at[a : b + 1])) * PARITY_BITS + bit[at[a] : at[b]]
        odd = (np.bincount(own, minlength=(b - a) * PARITY_BITS) & 1).astype(np.uint8)
        out[a:b] = np.packbits(odd, bitorder="little").view(np.int64).reshape(b - a, -1)
    return out


def _profile(k: int):
    """Set size, signature and parity bits of each document; at the end of a task, its non-zero sketch counters."""
    bits = pa.list_(pa.int64())
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("bits", bits), ("counter", pa.int32()), ("seen", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        for batch in batches:
            for a, b, t in tokens(batch.column(1), lower=True):
                sets, at = shingle_sets(t, k)
                sketch += np.bincount((sets >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(sketch))
                s1, s2 = _sums(mix(sets ^ np.uint64(0x9E3779B97F4A7C15)), at), _sums(mix(sets ^ np.uint64(0xD1B54A32D192ED03)), at)
                m = b - a
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, m), pa.array(np.diff(at)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), _rows(parity(sets, at)), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64())], schema=schema)
        used = np.flatnonzero(sketch)
        z = len(used)
        yield pa.RecordBatch.from_arrays([*[pa.nulls(z, pa.int64())] * 4, pa.nulls(z, bits), pa.array(used.astype(np.int32)), pa.array(sketch[used])], schema=schema)

    return run, "doc_id long, n long, s1 long, s2 long, bits array<long>, counter int, seen long"


def _rows(table: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(table) + 1, dtype=np.int32) * table.shape[1]), pa.array(table.ravel()))


def choose_matches(freq: np.ndarray, base: int, overlap: int, max_matches: int, verify_cost: float) -> tuple[int, float]:
    """The l of least estimated cost: entries of the l-prefix and their lists, plus verified candidates (lists / l); and the base prefix's lists."""
    top = max(1, min(max_matches, overlap))
    lists = np.cumsum(freq[: base + top - 1])[base - 1 :]
    l = np.arange(1, len(lists) + 1)
    best = int(np.argmin(lists + base + l + verify_cost * lists / l))
    return best + 1, float(lists[0])


def _prefixes(k: int, p: int, q: int, max_matches: int, verify_cost: float, sketch, wanted):
    """(token, doc_id, meta, place) for the adaptive prefix of each wanted document.

    meta packs set size (bits 32 up), list length on a log scale (16 to 31) and l (8 to 15); place counts from 0 in the
    document's whole set.
    """
    schema = pa.schema([("token", pa.int64()), ("doc_id", pa.int64()), ("meta", pa.int64()), ("place", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = sketch.value
        cls = np.minimum(np.log2(seen + 1.0), 31).astype(np.uint64) << np.uint64(58)  # keys are in order as signed numbers too
        keep = np.unpackbits(wanted.value, bitorder="little").view(bool)
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            ids = batch.column(0).to_numpy()
            batch = batch.filter(pa.array(keep[slot(ids)]))
            for a, b, t in tokens(batch.column(1), lower=True):
                ids = batch.column(0).slice(a, b - a).to_numpy()
                sets, at = shingle_sets(t, k)
                counter = (sets >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
                key = cls[counter] | (sets >> np.uint64(6))
                out_t, out_d, out_m, out_p = [], [], [], []
                for r in range(b - a):
                    n = int(at[r + 1] - at[r])
                    if not n:
                        continue
                    overlap = -(-p * n // q)
                    base = n - overlap + 1
                    mine = key[at[r] : at[r + 1]]
                    freq = seen[counter[at[r] : at[r + 1]]]
                    order = np.argsort(mine)
                    l, lists = choose_matches(freq[order[: base + max_matches]], base, overlap, max_matches, verify_cost)
                    take = mine[order[: base + l - 1]]
                    out_t.append(take)
                    out_d.append(np.full(len(take), ids[r]))
                    out_m.append(np.full(len(take), (n << 32) + (int(min(65535, 1000 * np.log2(lists + 1))) << 16) + (l << 8)))
                    out_p.append(np.arange(len(take), dtype=np.int32))
                if out_t:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_t).view(np.int64)), pa.array(np.concatenate(out_d)), pa.array(np.concatenate(out_m)), pa.array(np.concatenate(out_p))], schema=schema)

    return run, "token long, doc_id long, meta long, place int"


def _sets_of(k: int, wanted):
    """(doc_id, shingles) of the wanted documents."""
    schema = pa.schema([("doc_id", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = np.unpackbits(wanted.value, bitorder="little").view(bool)
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            batch = batch.filter(pa.array(keep[slot(batch.column(0).to_numpy())]))
            for a, b, t in tokens(batch.column(1), lower=True):
                sets, at = shingle_sets(t, k)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(sets.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], schema=schema)

    return run, "doc_id long, shingles array<long>"


def _size(meta) -> F.Column:
    return F.shiftright(meta, 32)


def _lists(meta) -> F.Column:
    return F.shiftright(meta, 16).bitwiseAND(F.lit(65535))


def _matches(meta) -> F.Column:
    return F.shiftright(meta, 8).bitwiseAND(F.lit(255))


def _overlap(nx, ny, p: int, q: int) -> F.Column:
    """The elements that sets of these sizes must share to reach the threshold."""
    return F.ceil(F.lit(p) * (nx + ny) / F.lit(p + q))


def first_common(tokens: DataFrame, p: int, q: int, *conditions) -> DataFrame:
    """Pairs (a, b) of documents of different ``c``, some more than once, from (token, doc_id, meta, place, before, c, ...) rows.

    A pair that reaches the threshold comes up at its first common token: what precedes it in either set is not in the
    other, so the two places sum up to no more than the elements in which the sets may differ. That token has no common
    one before it; a token that has one among the ``before`` of both rows is a later one and makes no row. Conditions
    are functions of the two rows' columns that hold for every pair which reaches the threshold.
    """
    x, y = (tokens.select("token", *[F.col(n).alias(n + s) for n in tokens.columns if n != "token"]) for s in "xy")
    c = F.col
    nx, ny = _size(c("metax")), _size(c("metay"))
    on = (x["token"] == y["token"]) & (c("cx") < c("cy")) & (F.lit(q) * F.least(nx, ny) >= F.lit(p) * F.greatest(nx, ny))
    on = on & (c("placex") + c("placey") <= nx + ny - 2 * _overlap(nx, ny, p, q))
    for condition in conditions:
        on = on & condition(lambda name: c(name + "x"), lambda name: c(name + "y"))
    on = on & ~F.arrays_overlap("beforex", "beforey")
    return x.join(y, on).select(F.least("doc_idx", "doc_idy").alias("a"), F.greatest("doc_idx", "doc_idy").alias("b"))


def possible(nx, ny, differing, p: int, q: int) -> F.Column:
    """Whether sets of these sizes that differ in at least so many elements can reach the threshold."""
    return F.lit(q) * (nx + ny - differing) >= F.lit(p) * (nx + ny + differing)


def sharing(pairs: DataFrame, tokens: DataFrame, p: int, q: int) -> DataFrame:
    """The pairs (a, b) that share as many prefix tokens as they must.

    Sets of n elements that share o hold their first l common tokens within their first n - o + l, so prefixes of L
    tokens share at least L - n + o, for the shorter one.
    """
    held = tokens.groupBy("doc_id", "meta").agg(F.collect_set("token").alias("held"))
    x, y = (held.select(F.col("doc_id").alias(c), F.col("meta").alias(f"m{c}"), F.col("held").alias(f"held{c}")) for c in "ab")
    na, nb = _size(F.col("ma")), _size(F.col("mb"))

    def spare(n, meta):  # n - L, where L is n - ceil(p n / q) + l
        return F.ceil(F.lit(p) * n / F.lit(q)) - _matches(meta)

    need = _overlap(na, nb, p, q) - F.greatest(spare(na, F.col("ma")), spare(nb, F.col("mb")))
    return pairs.join(x, "a").join(y, "b").where(F.size(F.array_intersect("helda", "heldb")) >= need).select("a", "b").distinct()


def verified(pairs: DataFrame, texts: DataFrame, bits: DataFrame, scratch: Scratch, k: int, p: int, q: int, tokens: DataFrame | None = None) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold, by exact intersection of the whole sets; with prefix tokens, pairs that share too few go before."""
    spark = pairs.sparkSession
    x, y = (bits.select(F.col("rep").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits{c}")) for c in "ab")
    differing = F.aggregate(F.zip_with("bitsa", "bitsb", lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda t, u: t + u)
    pairs = pairs.join(x, "a").join(y, "b").where(possible(F.col("na"), F.col("nb"), differing, p, q)).select("a", "b")
    pairs = scratch.stage(pairs if tokens is None else sharing(pairs, tokens, p, q), "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    wanted = spark.sparkContext.broadcast(np.packbits(bitmap(ids, "doc_id"), bitorder="little"))
    run, schema = _sets_of(k, wanted)
    sets = texts.mapInArrow(run, schema).join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    x, y = (sets.select(F.col("doc_id").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
    inter = F.size(F.array_intersect("sa", "sb")).cast("long")
    both = pairs.join(x, "a").join(y, "b").select("a", "b", inter.alias("i"), (F.size("sa") + F.size("sb")).cast("long").alias("s"))
    links = scratch.stage(both.where(F.lit(q) * F.col("i") >= F.lit(p) * (F.col("s") - F.col("i"))).select("a", "b"), "links")
    scratch.drop(pairs)
    return links


def jaccard_components(docs: DataFrame, k: int = 5, p: int = 80, q: int = 100, max_matches: int = 8, verify_cost: float = 8.0,
                       id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): documents link when q * intersection >= p * union of their k-word shingles."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    run, schema = _profile(k)
    profile = scratch.stage(texts.mapInArrow(run, schema), "profile")
    counters = profile.where("counter is not null").groupBy("counter").agg(F.sum("seen").alias("seen")).toPandas()  # at most 2**18 rows
    seen = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    seen[counters["counter"].to_numpy(dtype=np.int64)] = counters["seen"].to_numpy(dtype=np.int64)
    sets = profile.where("counter is null").drop("counter", "seen")  # bits are read for representatives only
    nodes = sets.where("n > 0 and doc_id is not null")
    reps = scratch.stage(nodes.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.first("bits").alias("bits")), "reps")

    sc = spark.sparkContext
    sketch, wanted = sc.broadcast(seen), sc.broadcast(np.packbits(bitmap(reps, "rep"), bitorder="little"))
    run, schema = _prefixes(k, p, q, max_matches, verify_cost, sketch, wanted)
    same = W.partitionBy("token")
    who = F.struct("doc_id", "meta")
    hubs = [F.max_by(who, F.struct(_lists(F.col("meta")), -F.col("doc_id"))).over(same), *[F.min_by(who, F.xxhash64(F.lit(i), "doc_id")).over(same) for i in (1, 2)]]
    shared = (texts.mapInArrow(run, schema).withColumn("lo", F.min("doc_id").over(same)).withColumn("hi", F.max("doc_id").over(same))
              .withColumns({f"hub{i}": h for i, h in enumerate(hubs)}).where("lo <> hi").drop("lo", "hi"))
    shared = scratch.stage(shared, "shared")

    def alike(mx, my):
        return F.lit(q) * F.least(_size(mx), _size(my)) >= F.lit(p) * F.greatest(_size(mx), _size(my))

    # each document with the hubs that it shares most tokens with
    c = F.col
    met = shared.select(c("doc_id").alias("b"), "meta", F.explode(F.array_distinct(F.array("hub0", "hub1", "hub2"))).alias("h"))
    near = (met.where((c("b") != c("h.doc_id")) & alike(c("meta"), c("h.meta"))).groupBy(c("h.doc_id").alias("a"), "b")
            .agg(F.count("*").alias("c"), F.min(F.least(_matches(c("meta")), _matches(c("h.meta")))).alias("m")).where("c >= m"))
    best = F.slice(F.sort_array(F.collect_list(F.struct("c", "a")), asc=False), 1, 3)  # a document has no more hubs than three per token
    best = near.groupBy("b").agg(best.alias("x")).select("b", F.explode("x.a").alias("a")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = verified(best, texts, reps, scratch, k, p, q)
    label = scratch.stage(components(links, scratch), "labels")

    # all candidates across components
    folds = [F.expr(f"bits[{i}] ^ bits[{i + 8}]").alias(f"f{i}") for i in range(8)]  # 512 parity bits from 1024
    known = reps.join(label, c("rep") == c("node"), "left").select(c("rep").alias("doc_id"), F.coalesce("component", "rep").alias("c"), *folds)
    mine = shared.select("token", "doc_id", "meta", "place").join(known, "doc_id")
    before = F.collect_list("token").over(W.partitionBy("doc_id").orderBy("token").rowsBetween(-BEFORE, -1))
    mine = mine.withColumn("before", F.filter(before, lambda t: t < c("token")))  # repeated rows repeat the token
    mine = scratch.stage(mine.withColumn("lo", F.min("c").over(same)).withColumn("hi", F.max("c").over(same)).where("lo <> hi").drop("lo", "hi"), "across")

    def close(x, y):
        return possible(_size(x("meta")), _size(y("meta")), sum((F.bit_count(x(f"f{i}").bitwiseXOR(y(f"f{i}"))) for i in range(8)), F.lit(0)), p, q)

    more = verified(first_common(mine, p, q, close).distinct(), texts, reps, scratch, k, p, q, mine)
    label = scratch.stage(components(links.union(more), scratch), "labels")
    scratch.drop(shared, mine)

    named = reps.drop("bits").join(label, F.col("rep") == F.col("node"), "left").select("s1", "s2", "n", F.coalesce("component", "rep").alias("component_id"))
    placed = nodes.join(named, ["s1", "s2", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = sets.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return placed.unionByName(alone)


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of the query: 3-word shingles, similarity of 0.9 or more."""
    return jaccard_components(read(spark, sf_dir, "documents"), k=3, p=90, q=100)
