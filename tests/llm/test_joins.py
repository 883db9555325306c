"""Decontamination, embeddings, archives, mixing and the pipeline on awkward rows."""

import gzip
import hashlib
import os
import re
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
from cases import awkward, documents, empty, prose, words  # noqa: E402

from notelab.llm import archives, decontam, embeddup, mixing  # noqa: E402
from notelab.llm.common import Scratch, components  # noqa: E402


# ---------------------------------------------------------------- decontamination

def local_score(p, q):
    """Plain Smith-Waterman over words."""
    h, best = [[0] * (len(p) + 1) for _ in range(len(q) + 1)], 0
    for i in range(1, len(q) + 1):
        for j in range(1, len(p) + 1):
            step = decontam.MATCH if p[j - 1] == q[i - 1] else decontam.MISMATCH
            h[i][j] = max(0, h[i - 1][j - 1] + step, h[i - 1][j] + decontam.GAP, h[i][j - 1] + decontam.GAP)
            best = max(best, h[i][j])
    return best


def test_smith_waterman_matches_the_plain_matrix():
    r = np.random.default_rng(0)
    for _ in range(30):
        p, q = r.integers(2, 6, (4, 17)), r.integers(2, 6, (4, 9))
        best, _ = decontam.smith_waterman(p, q)
        assert best.tolist() == [local_score(list(a), list(b)) for a, b in zip(p, q)]


def plain(text):
    return words(re.sub(r"[\x00-\x7f]", lambda m: m[0].lower() if m[0].isalnum() else " ", text or ""))


def test_contaminated(spark):
    items = [(1, prose(900, 30)), (2, prose(901, 40)), (3, "alpha beta gamma"), (4, None), (5, ""), (6, prose(900, 30)), (7, prose(902, 25))]
    edited = items[1][1].split()
    for i in (7, 19, 30):
        edited[i] = "edited"
    del edited[25]
    rows = [(50, prose(1, 200) + " " + items[0][1].upper() + "! " + prose(2, 5), "en", "s"), (51, " ".join(edited), "en", "s"), (52, prose(3, 90) + " Alpha, beta; gamma. " + prose(4, 9), "en", "s"),
            (53, prose(5, 3000) + " " + items[1][1] + " " + prose(6, 3000) + " " + items[1][1], "en", "s"), (54, " ".join(items[1][1].split()[:8]) + prose(8, 50), "en", "s"),
            *[(60 + i, items[6][1] + " " + prose(70 + i, 40), "en", "s") for i in range(30)], *awkward()]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontam.contaminated(documents(spark, rows), bench).collect()}
    expected = {}
    for i, t, *_ in rows:
        d = plain(t)
        if len(d) > 10_000:
            continue
        for item, q in items:
            q = plain(q)
            if q and (s := local_score(d, q) / (decontam.MATCH * len(q))) >= 0.5 and any(d[j : j + min(4, len(q))] == q[k : k + min(4, len(q))] for k in range(len(q)) for j in range(len(d)) if d[j] == q[k] and len(q) - k >= min(4, len(q))):
                expected[i, item] = s
    assert got == pytest.approx(expected)
    assert {d for d, _ in got} == {50, 51, 52, 53, *range(60, 90)}


def spread_edits(text, every, kind):
    """Every so many words one is changed, left out or followed by another."""
    out = []
    for i, w in enumerate(text.split()):
        edit = i % every == every - 1
        out += [w] * (not edit or kind == "add") + [f"x{i}"] * (edit and kind != "drop")
    return " ".join(out)


@pytest.mark.parametrize("copies", [0, 5])
def test_contaminated_by_evenly_edited_copies(spark, copies):
    """Every alignment around a shared 4-gram, also where other documents hold the items exactly."""
    items = [(i, prose(300 + i, 6 + 2 * i)) for i in range(18)]
    rows = [(1000 * i + 10 * every + k, prose(i, 30) + " " + spread_edits(t, every, kind) + " " + prose(i + 50, 30), "en", "s")
            for i, t in items for every in (5, 6, 7, 9) for k, kind in enumerate(("change", "drop", "add"))]
    rows += [(100_000 + 10 * i + c, prose(700 + c, 20) + " " + t, "en", "s") for i, t in items for c in range(copies)]
    # a lone phrase of an item, and a copy of it far from that phrase
    phrase, whole = " ".join(items[9][1].split()[3:7]), spread_edits(items[9][1], 5, "change")
    rows += [(200_000, prose(31, 50) + " " + phrase + " " + prose(32, 50), "en", "s"), (200_001, phrase + " " + prose(33, 400) + " " + whole + " " + prose(34, 400) + " " + phrase, "en", "s")]
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontam.contaminated(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    expected = {}
    for d, text, *_ in rows:
        p = plain(text)
        runs = {tuple(p[j : j + 4]) for j in range(len(p) - 3)}
        for item, q in items:
            q = plain(q)
            if any(tuple(q[j : j + 4]) in runs for j in range(len(q) - 3)) and (s := local_score(p, q) / (decontam.MATCH * len(q))) >= 0.5:
                expected[d, item] = s
    assert got == pytest.approx(expected)
    assert {(1000 * i + 60, i) for i, _ in items} <= set(got) and (200_001, 9) in got and (200_000, 9) not in got


def test_bound_of_the_score():
    r = np.random.default_rng(6)
    for _ in range(200):
        p, q = r.integers(0, 12, 15), r.integers(0, 20, 9)
        assert decontam.most(p, q) >= local_score(list(p), list(q))


def test_contaminated_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(documents(spark, awkward()), none).count() == 0
    assert decontam.contaminated(empty(spark), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0


# ---------------------------------------------------------------- embeddings

def test_near_duplicates(spark):
    r = np.random.default_rng(4)
    centre = r.normal(size=(30, 32))
    vectors = [(i, (centre[i % 30] + r.normal(0, 0.02 + 0.08 * (i % 3), 32)).tolist()) for i in range(400)]
    vectors += [(1000 + i, centre[0].tolist()) for i in range(5)] + [(2000, (3 * centre[0]).tolist()), (2001, None), (2002, []), (2003, [0.0] * 32), (2004, [float("nan")] + [1.0] * 31), (2005, [float("inf")] + [1.0] * 31), (2006, [None] + [1.0] * 31), (2007, [1.0, 2.0]), (2008, [1.0, 2.1]), (2009, [5.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in vectors], "vec_id long, embedding array<float>, node string")
    got = {x["vec_id"]: x for x in embeddup.near_duplicates(df).collect()}
    usable = {i: np.array(np.float32(v), dtype=float) for i, v in vectors if v and None not in v and np.isfinite(v).all() and np.any(v)}
    links = {i: [j for j in usable if j != i and len(usable[j]) == len(v) and v @ usable[j] / np.sqrt((v @ v) * (usable[j] @ usable[j])) >= 0.95] for i, v in usable.items()}
    low = {i: i for i, _ in vectors}
    for _ in range(20):
        for i, near in links.items():
            for j in near:
                low[i] = low[j] = min(low[i], low[j])
    assert len(got) == len(vectors)
    for i, _ in vectors:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (len(links.get(i, [])), low[i], low[i] == i), i
    assert sum(map(len, links.values())) > 500


def test_chunks_do_not_change_links(spark, monkeypatch):
    r = np.random.default_rng(5)
    v = r.normal(size=(1, 16)) + r.normal(0, 0.12, (120, 16))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    whole = sorted(map(tuple, embeddup.near_duplicates(df).collect()))
    monkeypatch.setattr(embeddup, "CHUNK", 17)
    assert sorted(map(tuple, embeddup.near_duplicates(df).collect())) == whole


def test_vectors_are_not_dealt_over_cells(spark, monkeypatch):
    """One chunk after the other meets the staged vectors: links of all pairs, a few rows per vector, and no vector in an exchange."""
    r = np.random.default_rng(6)
    raw = np.concatenate([r.normal(size=(1, 32)) + r.normal(0, 0.05, (150, 32)), r.normal(size=(90, 32))])
    nodes = spark.createDataFrame([(i, 1 + i % 3, v.tolist()) for i, v in enumerate(raw)], "node long, copies long, vec array<double>").repartition(4)
    unit = raw / np.linalg.norm(raw, axis=1)[:, None]
    near = (unit @ unit.T >= 0.95) & ~np.eye(len(raw), dtype=bool)
    assert near.sum() > 10_000
    monkeypatch.setattr(embeddup, "LINKED", 500)
    for chunk in (33, 1000):
        monkeypatch.setattr(embeddup, "CHUNK", chunk)
        met = embeddup._met(nodes, 0.95, Scratch(spark, "test"))
        assert met.count() < 60 * len(raw)
        links = {x.node: x.n for x in met.groupBy("node").agg({"links": "sum"}).toDF("node", "n").collect()}
        assert all(links.get(i, 0) == near[i] @ (1 + np.arange(len(raw)) % 3) for i in range(len(raw)))
        parts = {x.node: x.component for x in components(met.where("node <> part").selectExpr("node a", "part b"), Scratch(spark, "test")).collect()}
        assert {parts[i] for i in np.flatnonzero(near.any(axis=1))} == {0}


def test_near_duplicates_empty_table(spark):
    assert embeddup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# ---------------------------------------------------------------- archives

def test_arc_versions_and_lengths():
    block = archives.http_block(7, b"line\n\nfiledesc://x\r\n\r\nWARC/1.0")
    for version in (1, 2):
        data = archives.arc_version_block(version, "f.arc") + b"\n" + archives.arc_record(version, "http://a/", block, "f.arc", 99) + b"\n" + archives.arc_record(version, "http://b/", b"", "f.arc", 3) + b"\n"
        rows = list(archives.parse_arc(data))
        assert [(h["URL"], b) for _, h, b in rows] == [("http://a/", block), ("http://b/", b"")]
        assert data[rows[1][0] :].startswith(b"http://b/")
    with pytest.raises(ValueError):
        list(archives.parse_arc(archives.arc_version_block(2, "f.arc") + b"\nhttp://a/ 0.0.0.0 2000 text/html 0\n"))
    packed = gzip.compress(b"one") + gzip.compress(b"two")
    assert archives.unpacked(packed) == b"onetwo" and archives.unpacked(b"plain") == b"plain"


def test_archived(spark):
    big, other = "<p>é日</p>" * 200, "x\r\n\r\nWARC/1.0\r\n" * 100
    pages = [(1, "http://a/", big), (2, "http://a/ b\n", big), (3, None, big), (4, "", None), (5, "http://c/", ""), (6, "u", "small"), (7, "u", "small"), (8, "u", other), (8, "u", other), (9, "v", other), (None, "n", other), (None, "n", None), (10, "x", "y" * 300_000)]
    pages += [(100 + i, f"http://h/{i}", f"page {i} " * (i * 7)) for i in range(60)]
    df = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, path string")
    got = archived = archives.archived(df, records_per_file=10).collect()
    assert len(archived) == len(pages)
    payload = [((i, len(b), hashlib.sha1(b).hexdigest())) for i, _, h in pages for b in [(h or "").encode()]]
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in got) == Counter(payload)
    top = {}
    for i, n, d in payload:
        if n >= 1000 and i is not None:
            top[d] = max(top.get(d, i), i)
    for d in {d for _, n, d in payload}:
        group = [r for r in got if r["payload_digest"] == d]
        if group[0]["payload_bytes"] < 1000:
            assert all(r["record_type"] == "response" and r["refers_to"] is None for r in group)
        else:
            first = [r for r in group if r["record_type"] == "response"]
            assert len(first) == 1 and first[0]["page_id"] == top[d]
            assert all(r["refers_to"] == top[d] for r in group if r["record_type"] == "revisit")
    assert len({r["record_id"] for r in got}) == len(got)


def test_archived_empty_table(spark):
    assert archives.archived(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# ---------------------------------------------------------------- mixing

def brute_targets(sizes):
    """The excess over three times a source's size, reshared by weight until none is above."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        rest, w = total - sum(full.values()), sum(v for s, v in weight.items() if s not in full)
        target = {s: full.get(s, rest * weight[s] / w if w else 0.0) for s in names}
        above = {s: 3.0 * sizes[s] for s in names if s not in full and target[s] > 3 * sizes[s]}
        if not above:
            return target
        full |= above


def test_mixing(spark):
    rows = awkward() + [(3000 + i, prose(i, 5 + i % 90), "en", f"src{i % 7}") for i in range(500)]
    df = documents(spark, rows)
    got = mixing.mix_sources(df, block_words=16, shard_slots=32).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, len(words(t))) for i, t, *_ in rows)
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(words(t))
    target, source = brute_targets(sizes), {(i, len(words(t))): s for i, t, _, s in rows}
    taken = Counter()
    for r in got:
        s = source[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(target[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 32, s  # about a block
    again = mixing.mix_sources(df.repartition(5), block_words=16, shard_slots=32).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mixed_blocks(spark):
    """The mix holds the texts: whole blocks of each source's stream, as often as the documents' counts tell."""
    rows = awkward() + [(3000 + i, prose(i, 5 + i % 90), "en", f"src{i % 7}") for i in range(300)]
    mix, digest = mixing.mix_tables(documents(spark, rows), block_words=16, shard_slots=32)
    got = mix.orderBy("shard", "slot").collect()
    assert [r["slot"] for r in got] == list(range(len(got))) and all(r["shard"] == r["slot"] // 32 for r in got)
    streams, taken = {}, Counter()
    for r in got:
        w = r["words"].split(" ")
        assert len(w) == sum(p["n"] for p in r["parts"]) <= 16
        assert streams.setdefault((r["source"], r["block"]), (w, r["parts"])) == (w, r["parts"])
        for p in r["parts"]:
            taken[r["source"], p["doc_id"]] += p["n"]
    expected, source = Counter(), {(i, len(words(t))): s for i, t, _, s in rows}
    for r in digest.collect():
        expected[source[r["doc_id"], r["size"]], r["doc_id"]] += r["taken"]
    assert +taken == +expected
    # the blocks of a source in order are its documents' whole texts, one after the other
    whole = [s for s in {s for s, _ in streams} if sum(len(w) for (t, _), (w, _) in streams.items() if t == s) == sum(len(words(t)) for _, t, _, x in rows if x == s)]
    assert len(whole) >= 3
    for s in whole:
        stream = [w for b in range(sum(t == s for t, _ in streams)) for w in streams[s, b][0]]
        parts = [(p["doc_id"], p["n"]) for b in range(sum(t == s for t, _ in streams)) for p in streams[s, b][1]]
        texts, at, seen = Counter((i, tuple(words(t))) for i, t, _, x in rows if x == s and words(t)), 0, Counter()
        left = {i: [list(t) for (j, t), n in texts.items() if j == i for _ in range(n)] for i, _ in texts}
        while parts:
            doc, n = parts.pop(0)
            while parts and parts[0][0] == doc and n not in {len(t) for t in left[doc]}:
                n += parts.pop(0)[1]
            assert stream[at : at + n] in left[doc]
            left[doc].remove(stream[at : at + n])
            at, seen[doc] = at + n, seen[doc] + 1
        assert at == len(stream) and not any(left.values())


def test_words_of_odd_texts(spark):
    texts = [None, "", " \t\n\x0b\x0c\r", "a", " a", "a\n", "\r\n a  b\n\nc\t \x0b\x0cd e ", "a\u00a0b \x1c \u2003", "é 日本  🎉🎉\x85", "\x00 $1 \\", "x" * 9000]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    got = df.select("i", mixing.word_count(F.col("text")).alias("n"), mixing.spaced(F.col("text")).alias("s")).collect()
    assert {r["i"]: (r["n"], r["s"]) for r in got} == {i: (len(words(t)), None if t is None else " ".join(words(t))) for i, t in enumerate(texts)}


def test_mixing_searches_the_words_of_a_text_once(spark, monkeypatch):
    """On the way to its place a text goes through one search of all its words, not one to filter and one to count."""
    plans, cut = [], mixing.pieces

    def pieces(placed, *rest):
        plans.append(placed._jdf.queryExecution().optimizedPlan().toString())
        return cut(placed, *rest)

    monkeypatch.setattr(mixing, "pieces", pieces)
    mixing.mix_tables(documents(spark, awkward()))
    assert [len(re.findall("regexp_(?:extract|replace|count)", p)) for p in plans] == [1]


def test_mixing_empty_and_blank_tables(spark):
    assert mixing.mix_sources(empty(spark)).count() == 0
    got = mixing.mix_sources(documents(spark, [(1, None, None, None), (2, " ", "en", "a")])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in got] == [(0, 0.0, 0)] * 2


@pytest.mark.parametrize("n", [1, 2, 7, 100, 1000])
def test_permutation_is_a_bijection(spark, n):
    df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), [F.lit(3)], 1).alias("p"))
    p = [r["p"] for r in df.collect()]
    assert sorted(p) == list(range(n))
    assert n < 100 or p != list(range(n))


def test_native_plan(spark):
    plan = mixing.mix_sources(documents(spark, awkward()))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---------------------------------------------------------------- pipeline

def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp
    item = prose(77, 30)
    rows = awkward() + [(4000 + i, prose(i, 60), "en", "a") for i in range(60)] + [(5000, prose(9, 40) + " " + item, "en", "b"), (5001, "12 34 !!", "en", "b")]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    scratch, docs, seen = Scratch(spark, "test"), spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in cp.STAGES:
        docs = scratch.stage(stage(spark, docs, str(tmp_path)), name)
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
        assert name == "mixing" or docs.columns == columns
    assert 5001 not in seen["language_id"] and 8 not in seen["language_id"] and {1, 2, 5000, None} <= set(seen["language_id"])
    assert 1 in seen["line_dedup"] and 2 not in seen["line_dedup"]  # an exact copy of a long line
    assert 3 not in seen["ngram_jaccard"] and {1, 14, 5000} <= set(seen["ngram_jaccard"])
    assert set(seen["ngram_jaccard"]) - set(seen["decontamination"]) == {5000}
    assert set(seen["mixing"]) == set(seen["decontamination"])
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "ngram_jaccard", "decontamination", "mixing"]
