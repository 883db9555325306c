"""Cross-tokenizer alignment and packing against plain loops and the tokenizers themselves."""

import hashlib
import os
import sys
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(__file__))
from cases import awkward, documents, empty, prose  # noqa: E402

from notelab.llm import crosstok, packing  # noqa: E402
from notelab.llm.vocab import BYTE_BPE, PIECE_BPE, byte_level, piece_model  # noqa: E402

MORE = [(30, "<|endoftext|> plain <s> text </s> <unk>", "en", "a"), (31, "▁odd▁marks", "en", "a"), (32, "tab\tnew\nline  two   spaces ", "en", "a"), (33, "ﬁ é é ​﻿", "en", "a"), (34, "\x00\x01", "en", "a"),
        (35, " leading", "en", "a"), (35, " leading", "en", "a"), (None, "no id, twice", "en", "a"), (None, "no id, twice", "en", "a")]


@pytest.fixture(scope="module")
def plain():
    hf = Tokenizer.from_file(public_tokenizers.path(BYTE_BPE))
    return hf, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECE_BPE))


def brute_alignment(text, plain):
    """(a ids, b ids, links as id pairs, groups) by two pointers."""
    hf, sp = plain
    if not text:
        return [], [], [], ""
    hf.encode_special_tokens = True
    a, b = hf.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
    whole, size_a, size_b = (" " + text).encode(), byte_level(BYTE_BPE).bytes, piece_model(PIECE_BPE).bytes
    if b"".join(size_a[i] for i in a) != whole or b"".join(size_b[i] for i in b) != whole:
        return [], [], [], ""
    i = j = end_a = end_b = 0
    spans = []
    for ids, sizes in ((a, size_a), (b, size_b)):
        ends = np.cumsum([len(sizes[t]) for t in ids])
        spans.append([(int(e) - len(sizes[t]), int(e)) for t, e in zip(ids, ends, strict=True)])
    links, groups, ga, gb = [], [], [], []
    while i < len(a):
        links.append((a[i], b[j]))
        end_a, end_b = spans[0][i][1], spans[1][j][1]
        if end_a <= end_b:
            ga.append(str(a[i]))
            i += 1
        if end_b <= end_a:
            gb.append(str(b[j]))
            j += 1
        if end_a == end_b:
            groups.append(",".join(ga) + "|" + ",".join(gb))
            ga, gb = [], []
    return a, b, links, ";".join(groups)


def brute_cross(rows, plain):
    found = [(r[0], *brute_alignment(r[1], plain)) for r in rows]
    held = Counter(p for _, _, _, links, _ in found for p in set(links))
    top = {}
    for (a, _), n in held.items():
        top[a] = max(top.get(a, 0), n)
    return Counter((i, len(a), len(b), len(g.split(";")) if g else 0, len(links), sum(held[p] == top[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(g.encode()).hexdigest() if g else "")
                   for i, a, b, links, g in found)


def test_cross_tokenizer(spark, plain):
    rows = awkward() + MORE
    got = crosstok.cross_tokenizer(documents(spark, rows))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, got.collect())) == brute_cross(rows, plain)


def test_cross_tokenizer_with_few_counts_sent(spark, plain):
    """The pairs beyond the most frequent ones come by the join."""
    rows = awkward()[:12] + MORE
    assert Counter(map(tuple, crosstok.cross_tokenizer(documents(spark, rows), frequent=5).collect())) == brute_cross(rows, plain)


def test_cross_tokenizer_of_nothing(spark):
    assert crosstok.cross_tokenizer(empty(spark)).collect() == []
    assert [r[1:] for r in crosstok.cross_tokenizer(documents(spark, [(1, None, None, None)])).collect()] == [(0, 0, 0, 0, 0, 0, "")]


def test_aligned_has_ids_links_and_cuts(spark, plain):
    rows = awkward() + MORE
    got = crosstok.aligned(documents(spark, rows).drop("lang", "source", "n_chars")).collect()
    assert len(got) == len(rows)
    for r, (doc_id, text, *_) in zip(got, rows, strict=True):
        a, b, links, groups = brute_alignment(text, plain)
        assert (r["doc_id"], r["ids_a"], r["ids_b"]) == (doc_id, a, b) and r["key"] == "x"
        assert [(a[i], b[j]) for i, j in zip(r["link_a"], r["link_b"], strict=True)] == links
        assert len(r["cuts"]) == (groups.count(";") + 1 if groups else 0)
        ends = [{int(e) for e in np.cumsum([len(v.bytes[t]) for t in ids])} for v, ids in ((byte_level(BYTE_BPE), a), (piece_model(PIECE_BPE), b))]
        assert r["cuts"] == sorted(ends[0] & ends[1])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.lists(st.integers(1, 4), min_size=1, max_size=5)), max_size=6), max_size=5))
def test_lockstep_links_are_overlaps(docs):
    """Random token lengths: links are exactly the overlapping spans, cuts the common ends."""
    rng, sizes_a, sizes_b = np.random.default_rng(len(docs)), [], []
    for d in docs:
        total = sum(sum(t[0]) for t in d)
        sizes_a.append([x for t in d for x in t[0]])
        ends = sorted({*rng.integers(1, total, total // 2).tolist(), total}) if total > 1 else [1] * (total == 1)
        sizes_b.append(np.diff([0, *ends]).tolist())
    table = np.arange(100)
    a, b = (crosstok.Side([np.array(s, dtype=np.uint32) for s in sizes], table) for sizes in (sizes_a, sizes_b))
    at_a, at_b, cut, first = crosstok.lockstep(a, b)
    for d in range(len(docs)):
        spans = [[(e - s, e) for s, e in zip(x, np.cumsum(x), strict=True)] for x in (sizes_a[d], sizes_b[d])]
        want = [(i, j) for i, p in enumerate(spans[0]) for j, q in enumerate(spans[1]) if p[0] < q[1] and q[0] < p[1]]
        part = slice(first[d], first[d + 1])
        assert list(zip((at_a[part] - a.first[d]).tolist(), (at_b[part] - b.first[d]).tolist(), strict=True)) == want
        assert cut[part].sum() == len({e for _, e in spans[0]} & {e for _, e in spans[1]})


def test_byte_vocabulary_is_the_tokenizer(plain):
    """Every code point, special tokens and runs of white space get the ids of the tokenizers library."""
    hf, _ = plain
    texts = ["".join(f"a{chr(c)}1{chr(c)} {chr(c)}{chr(c)}!{chr(c)} \n" for c in range(b, b + 512)) for b in range(0, 0x110000, 512) if not 0xD800 <= b < 0xE000]
    texts += ["x<|endoftext|> y <|endoftext|>", " " * 3000, "it's we'll I'd  \r\n\t x", "a" * 3000]
    for special in (False, True):
        hf.encode_special_tokens = not special
        want = hf.encode_batch(texts, add_special_tokens=False)
        assert all(byte_level(BYTE_BPE, special).ids(t).tolist() == w.ids for t, w in zip(texts, want, strict=True))


def wanted_pieces(rows, plain, capacity=1024):
    hf, _ = plain
    hf.encode_special_tokens = False
    out = Counter()
    for i, text, *_ in rows:
        ids = [*hf.encode(text or "", add_special_tokens=False).ids, 2]
        n = -(-len(ids) // capacity)
        edges = [0, *[len(ids) - capacity * k for k in range(n - 1, -1, -1)]]
        for k, (s, e) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            out[i, k, s, e - s, zlib.crc32(np.array(ids[s:e], dtype="<u4").tobytes())] += 1
    return out


def check_packing(got, capacity=1024):
    used = {}
    for r in got:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in used.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= capacity
    return used


def test_best_fit_packing(spark, plain):
    rows = awkward() + MORE + [(1000 + i, prose(i, 10 + 37 * i % 400), "en", "a") for i in range(300)]
    made = packing.token_pieces(documents(spark, rows))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in made.collect()) == wanted_pieces(rows, plain)
    assert all(zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] for r in made.collect())
    got = packing.pack(made.drop("ids")).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == wanted_pieces(rows, plain)
    used = check_packing(got)
    lengths = np.array([r["length"] for r in got])
    plain_fit = len(set(packing.start(lengths[lengths < 1024], 1024, 0, np.random.default_rng(0)).tolist())) + int((lengths == 1024).sum())
    assert -(-lengths.sum() // 1024) <= len(used) <= plain_fit


def test_packing_in_groups_reruns_alike(spark):
    rng = np.random.default_rng(4)
    table = spark.createDataFrame([(i, int(n), "x") for i, n in enumerate(rng.integers(1, 101, 900))], "id long, length long, row string").repartition(3, "id")
    runs = [sorted(tuple(r) for r in packing.pack(table, capacity=100, group=200, rounds=2).collect()) for _ in range(2)]
    assert runs[0] == runs[1] and len(runs[0]) == 900
    used = check_packing([{"sequence_id": s, "offset": o, "length": n} for _, n, _, s, o in runs[0]], 100)
    lengths = np.array([r[1] for r in runs[0]])
    assert len(used) <= 1.03 * lengths.sum() / 100 + 5


def test_packing_edge_cases(spark):
    table = spark.createDataFrame([], "doc_id long, length long")
    assert packing.pack(table).collect() == []
    with pytest.raises(Exception, match="length must be"):
        packing.pack(spark.createDataFrame([(1, 2000)], "doc_id long, length long")).collect()
    with pytest.raises(ValueError, match="sequence_id"):
        packing.pack(table.withColumn("Sequence_ID", table["length"]))
    assert packing.token_pieces(empty(spark)).collect() == []
    same = spark.createDataFrame([(None, 300)] * 50, "doc_id long, length long")  # repeated rows, no ids
    assert len(check_packing(packing.pack(same).collect())) == 17


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=80), st.integers(0, 5))
def test_genetic_operators_keep_every_piece(lengths, seed):
    rng, lengths = np.random.default_rng(seed), np.array(lengths)
    x, y = packing.start(lengths, 50, 0, rng), packing.start(lengths, 50, 0.5, rng)
    for child in (packing.crossover(x, y, lengths, 50, rng), packing.mutate(x, lengths, 50, rng)):
        fills = np.bincount(child, weights=lengths)
        assert len(child) == len(lengths) and (fills > 0).all() and fills.max() <= 50
    ranked = packing.evolve(lengths, [], y, 50, 3, 4, rng)
    assert packing.fitness(ranked[0], lengths) <= min(packing.fitness(x, lengths), packing.fitness(y, lengths))


def test_best_fit_takes_the_fullest_bin():
    assert packing.Bins(10, np.array([3, 5, 0])).put([4, 3, 6, 4, 1]) == [1, 0, 3, 3, 1]


def test_a_migrant_spreads():
    """An elite that best-fit alone doesn't find survives on the island that it comes to."""
    lengths = np.array([6, 3, 3, 2, 2, 2, 7, 5, 5, 5] * 3)
    rng = np.random.default_rng(0)
    best = packing.evolve(lengths, [], None, 12, 60, 8, rng)[0]
    ranked = packing.evolve(lengths, [packing.start(lengths, 12, 0, rng)], best, 12, 1, 3, rng)
    assert packing.fitness(ranked[0], lengths) <= packing.fitness(best, lengths)
