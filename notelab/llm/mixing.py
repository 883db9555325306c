"""Operator 6: mix sources to target weights, on DataFrame functions only.

Every source's words, in a fixed order of its documents, form one stream that is packed into blocks of ``block_words``
words. The mix is a list of slots dealt to output shards of ``shard_slots`` slots. For every slot a source is drawn
with the target probabilities, so a shard's source counts are a multinomial draw; draws beyond a source's quota are
handed, in order, to the sources that stayed below theirs, so the totals meet the targets to a block. The j-th slot of
a source takes block perm(j) of its pass j div n_blocks: perm is a swap-or-not shuffle keyed by source and pass, a
bijection on the source's block numbers. Blocks are packed from the whole texts and meet their slots in an equi-join on
(source, block): the mixed texts (``mixed_blocks``). What is taken of a document (``mix_sources``) is counted in them.

The texts are shuffled twice, by the places of documents in their source and by block, and the mix is staged once. The words
of a text are searched to count them, and again to join them by single spaces for the way to their places.

No step puts a source into one task: positions come from two-level prefix sums (buckets, then rows of a bucket), and
slots and blocks are spread by their numbers. Only tables of one row per source are broadcast, under Spark's own size
check.

Edge cases: null, empty and blank texts have size 0 and take 0; null sources form one source (last by code point);
repeated rows are separate documents; an empty table gives an empty result; a source without words has target 0. Rows
with equal ids and texts are interchangeable. Extra columns are ignored. The documents are read twice (sizes, then
texts), so a table that isn't the same at each reading must be staged before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from notelab.llm.common import Scratch, read

SEED = 20261
#: Weights by the source's rank in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: No source is taken more often than this.
MAX_PASSES = 3
ROUNDS = 24


_WORD, _GAP, _BLANKS = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+", " \t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """Words of a text; each becomes one letter, so none is a string of its own."""
    marks = F.regexp_replace(F.ltrim(text, F.lit(_BLANKS)), rf"{_WORD}[\x20\x09-\x0D]*", "x")
    return F.coalesce(F.length(marks).cast("long"), F.lit(0).cast("long"))


def spaced(text: Column) -> Column:
    """The words of a text joined by single spaces."""
    return F.regexp_replace(F.btrim(text, F.lit(_BLANKS)), _GAP, " ")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """(src, source_size) -> plus weight and target, a table of one row per source.

    Excess over the cap reshared by weight until no source is above ends at the level t for which the targets
    min(cap, t * weight) add up to all words: caps are met in the order of cap / weight.
    """
    by_name = W.orderBy(F.col("src").isNull(), F.col("src"))
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.lit(float(max_passes)) * F.col("source_size"))
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("src").isNull(), F.col("src"))
    earlier, whole = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    level = ((F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0)))
             / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))))
    leveled = ranked.withColumn("level", level)
    # the level t is that of the first source, in the order of cap / weight, whose cap lies above it
    free = F.min(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct((F.col("cap") / F.col("weight")).alias("ratio"), F.col("level")))).over(whole)
    t = free.getField("level")
    return leveled.withColumn("target", F.when(t.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), t * F.col("weight")))).drop("cap", "level")


def permuted(x: Column, n: Column, keys: list[Column], seed: int, rounds: int = ROUNDS) -> Column:
    """Swap-or-not shuffle: a pseudorandom bijection of 0..n-1 chosen by keys and seed."""
    steps = F.transform(F.sequence(F.lit(1), F.lit(rounds)), lambda r: F.struct(r.alias("r"), F.pmod(F.xxhash64(F.lit(seed), r, *keys), n).alias("k")))

    def step(at: Column, s: Column) -> Column:
        mate = F.pmod(s["k"] - at, n)
        side = F.xxhash64(F.lit(seed + 1), s["r"], F.greatest(at, mate), *keys).bitwiseAND(F.lit(1))
        return F.when(side == 1, mate).otherwise(at)

    return F.aggregate(steps, x, step)


def located(points: DataFrame, at: str, ranges: DataFrame, total: int, grain: int = 4096) -> DataFrame:
    """Join each point to the range [lo, hi) that holds it, by an equi-join on cells of 1 / grain of 0..total-1."""
    cell = max(1, total // grain)
    cells = ranges.where("hi > lo").withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor((F.col("hi") - 1) / cell))))
    return points.withColumn("cell", F.floor(F.col(at) / cell)).join(cells, "cell").where((F.col(at) >= F.col("lo")) & (F.col(at) < F.col("hi"))).drop("cell")


def before(value: str, keys: list[str], order: list[str]) -> Column:
    """Sum of the rows before this one."""
    return F.coalesce(F.sum(value).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long")


def pieces(placed: DataFrame, block_words: int) -> DataFrame:
    """(sid, block, start, doc_id, n, words): the words of each document (``spaced`` texts) by the blocks that they lie in."""
    start, end = F.col("start"), F.col("start") + F.col("size")
    numbers = F.sequence(F.floor(start / block_words), F.floor((end - 1) / block_words))

    def part(words: Column, block: Column) -> Column:
        lo, hi = F.greatest(block * block_words, start), F.least((block + 1) * block_words, end)
        return F.struct(block.alias("block"), F.slice(words, (lo - start + 1).cast("int"), (hi - lo).cast("int")).alias("part"))

    # a text is split once: the inner function sees its words as a variable
    split = F.transform(F.array(F.split("text", " ")), lambda w: F.transform(numbers, lambda b: part(w, b)))
    cut = F.transform(F.element_at(split, 1), lambda x: F.struct(x["block"].alias("block"), F.size(x["part"]).alias("n"), F.array_join(x["part"], " ").alias("words")))
    return placed.where("size > 0").select("sid", "start", "doc_id", F.explode(cut).alias("cut")).select("sid", "start", "doc_id", "cut.*")


def mix_tables(docs: DataFrame, block_words: int = 128, shard_slots: int = 1024, seed: int = SEED, buckets: int = 4096,
               id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """The mix (``mixed_blocks``) and what it takes of the documents (``mix_sources``)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("src"),
        F.crc32(F.col(text_col).cast("binary")).alias("tie"), F.xxhash64(text_col).alias("tie2"),
        F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(buckets)).alias("bucket"), F.col(text_col).alias("text"))
    sized = scratch.stage(rows.withColumn("size", word_count(F.col("text"))).drop("text"), "sized")
    per_bucket = scratch.stage(sized.groupBy("src", "bucket").agg(F.sum("size").alias("words")), "buckets")

    # quota of a source in blocks: whole passes, then as many blocks of the last pass as come nearest to the rest
    targets = source_targets(per_bucket.groupBy("src").agg(F.sum("words").alias("source_size")))
    passes = F.floor(F.col("target") / F.col("source_size")).cast("long")
    rest = F.round((F.col("target") - passes * F.col("source_size")) * F.col("n_blocks") / F.col("source_size")).cast("long")
    quota = (targets.withColumn("n_blocks", F.ceil(F.col("source_size") / F.lit(block_words)).cast("long"))
             .withColumn("quota", F.when(F.col("source_size") > 0, F.least(F.lit(MAX_PASSES) * F.col("n_blocks"), passes * F.col("n_blocks") + rest)).otherwise(F.lit(0)).cast("long"))
             .withColumn("sid", F.row_number().over(W.orderBy(F.col("src").isNull(), F.col("src"))).cast("int"))
             .withColumn("lo", before("quota", [], ["sid"])).withColumn("hi", F.col("lo") + F.col("quota")))
    quota = scratch.stage(quota.select("src", "sid", "source_size", "target", "n_blocks", "quota", "lo", "hi"), "quota")
    sid_of = quota.select(F.col("src").alias("q_src"), "sid", "source_size", "target")
    total = quota.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]

    # slots: a pseudorandom number in [0, all quotas) draws the source of each slot of each shard
    slots = (spark.range(total).select(F.col("id").alias("slot"), F.floor(F.col("id") / shard_slots).cast("long").alias("shard"))
             .withColumn("draw", F.pmod(F.xxhash64(F.lit(seed + 2), "slot"), F.lit(max(total, 1)))))
    drawn = scratch.stage(located(slots, "draw", quota.select("sid", "lo", "hi", "quota"), total).select("slot", "shard", "sid", "quota"), "drawn")
    # the shards' multinomial counts; a source's slots are numbered through its shards by two-level prefix sums
    counts = drawn.groupBy("shard", "sid").agg(F.count("*").alias("n")).withColumn("part", F.floor(F.col("shard") / 4096))
    counts = scratch.stage(counts, "counts")
    part_first = counts.groupBy("sid", "part").agg(F.sum("n").alias("pn")).select("sid", "part", before("pn", ["sid"], ["part"]).alias("p0"))
    first = counts.join(part_first, ["sid", "part"]).select("sid", "shard", (F.col("p0") + before("n", ["sid", "part"], ["shard"])).alias("j0"))
    numbered = drawn.join(first, ["sid", "shard"]).withColumn("j", F.col("j0") + F.row_number().over(W.partitionBy("shard", "sid").orderBy("slot")) - 1)
    numbered = scratch.stage(numbered.select("slot", "shard", "sid", "j", "quota"), "numbered")
    scratch.drop(drawn)

    # draws beyond a source's quota fill, in slot order, the places that other sources have left
    used = counts.groupBy("sid").agg(F.sum("n").alias("n"))
    gaps = (quota.join(used, "sid", "left").select("sid", F.least(F.coalesce("n", F.lit(0)), "quota").cast("long").alias("done"), "quota")
            .withColumn("gap", F.col("quota") - F.col("done")).where("gap > 0")
            .withColumn("lo", before("gap", [], ["sid"])).withColumn("hi", F.col("lo") + F.col("gap")))
    surplus = numbered.where("j >= quota").withColumn("part", F.floor(F.col("shard") / 64))
    first = surplus.groupBy("part").agg(F.count("*").alias("n")).select("part", before("n", [], ["part"]).alias("r0"))
    ranked = surplus.join(first, "part").select("slot", (F.col("r0") + F.row_number().over(W.partitionBy("part").orderBy("slot")) - 1).alias("r"))
    refilled = located(ranked, "r", gaps.select(F.col("sid"), "done", "lo", "hi"), total).select("slot", "sid", (F.col("done") + F.col("r") - F.col("lo")).alias("j"))
    filled = numbered.where("j < quota").select("slot", "sid", "j").unionByName(refilled)

    # slot -> block by the permutation of the source's pass, then how often each block is taken
    placed = (filled.join(quota.select("sid", "n_blocks"), "sid").withColumn("pass", F.floor(F.col("j") / F.col("n_blocks")))
              .withColumn("block", permuted(F.pmod("j", F.col("n_blocks")), F.col("n_blocks"), [F.col("sid"), F.col("pass")], seed + 3)))

    # documents -> their places in the source's stream of words, which also tell them apart
    bucket_first = scratch.stage(per_bucket.join(sid_of, F.col("src").eqNullSafe(F.col("q_src")))
                                 .select("sid", "bucket", before("words", ["sid"], ["bucket"]).alias("b0")), "firsts")

    def starts(table: DataFrame) -> DataFrame:
        known = table.join(sid_of, F.col("src").eqNullSafe(F.col("q_src"))).drop("q_src", "src")
        first = F.col("b0") + before("size", ["sid", "bucket"], ["doc_id", "tie", "tie2", "size"])
        return known.join(bucket_first, ["sid", "bucket"]).withColumn("start", F.when(F.col("size") > 0, first))

    # blocks of words, which meet their slots; a text's words are searched once, and the filter ends at the first
    texts = rows.where(F.regexp_like("text", F.lit(_WORD))).withColumn("text", spaced(F.col("text")))
    texts = texts.withColumn("size", (F.octet_length("text") - F.octet_length(F.replace("text", F.lit(" "), F.lit(""))) + 1).cast("long"))
    packed = pieces(starts(texts), block_words).groupBy("sid", "block").agg(F.array_sort(F.collect_list(F.struct("start", "doc_id", "n", "words"))).alias("held"))
    packed = packed.select("sid", "block", F.array_join(F.col("held.words"), " ").alias("words"), F.transform("held", lambda x: F.struct(x["start"].alias("start"), x["doc_id"].alias("doc_id"), x["n"].alias("n"))).alias("parts"))
    mix = scratch.stage(packed.join(placed.select("sid", "block", "slot"), ["sid", "block"])
                        .select(F.floor(F.col("slot") / shard_slots).cast("long").alias("shard"), "slot", "sid", "block", "words", "parts"), "mix", codec="zstd")

    taken = mix.select("sid", F.explode("parts").alias("p")).groupBy("sid", "p.start").agg(F.sum("p.n").alias("taken"))
    digest = starts(sized).join(taken, ["sid", "start"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    named = mix.join(sid_of.select("sid", F.col("q_src").alias("source")), "sid")
    return named.select("shard", "slot", "source", "block", "words", F.transform("parts", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["n"].alias("n"))).alias("parts")), digest


def mixed_blocks(docs: DataFrame, **options) -> DataFrame:
    """(shard, slot, source, block, words, parts): the mix, a row per slot; its order is that of shard and slot.

    words are the block's words joined by single spaces, parts the documents that they come from, in order, with the
    number of words of each.
    """
    return mix_tables(docs, **options)[0]


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken): how many words of every document the mix takes."""
    return mix_tables(docs, **options)[1]


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents"))
