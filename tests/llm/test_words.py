"""Word splitting, hashing and window hashing against plain Python."""

import os
import sys

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, os.path.dirname(__file__))
from cases import ascii_lower, awkward, words  # noqa: E402

from notelab.llm.words import Tokens, buffers, tokens, windows  # noqa: E402

TEXT = st.text(alphabet=" \t\n\x0b\x0c\r\x1c\x85 aAéZb.9", max_size=40) | st.none()


@given(st.lists(TEXT, max_size=8), st.booleans(), st.integers(1, 30))
@settings(max_examples=150, deadline=None)
def test_words_match_the_pattern(texts, lower, size):
    seen = 0
    for a, b, t in tokens(pa.array(texts, pa.string()), lower, size):
        for r in range(a, b):
            expected = words(ascii_lower(texts[r]) if lower else texts[r])
            assert t.text(r - a).decode() == " ".join(expected)
            assert t.counts[r - a] == len(expected)
        seen += b - a
    assert seen == len(texts)


@given(st.lists(TEXT, max_size=6), st.integers(1, 4))
@settings(max_examples=100, deadline=None)
def test_equal_windows_have_equal_hashes(texts, k):
    t = Tokens(*buffers(pa.array(texts, pa.string())), lower=False)
    h, at = windows(t.hashes(), t.first, k)
    named = [tuple(w[j : j + k]) for w in map(words, texts) for j in range(len(w) - k + 1)]
    assert len(named) == len(h)
    assert len(set(named)) == len(set(h.tolist()))
    assert len({(n, x) for n, x in zip(named, h.tolist())}) == len(set(named))


def test_hashes_do_not_depend_on_blocks(monkeypatch):
    import notelab.llm.words as w
    column = pa.array([t for _, t, _, _ in awkward()], pa.string())
    t = Tokens(*buffers(column), lower=False)
    whole, long = t.hashes(), windows(t.hashes(), t.first, 35)[0]
    monkeypatch.setattr(w, "BLOCK", 97)
    assert np.array_equal(t.hashes(), whole)
    assert np.array_equal(w.windows(whole, t.first, 35)[0], long)


def test_hashing_keeps_little_memory():
    """A worker serves many tasks: what hashing leaves behind stays small, whatever the sizes of texts and words were."""
    import tracemalloc

    import notelab.llm.words as w
    w._powers.cache_clear()
    tracemalloc.start()
    try:
        for size in (100_000, 300_000, 700_000, 1_500_000):
            for text in ("word " * (size // 5), "x" * size):
                for _, _, t in tokens(pa.array([text])):
                    windows(t.hashes(), t.first, 5)
        del t
        assert tracemalloc.get_traced_memory()[0] < 32 << 20
    finally:
        tracemalloc.stop()


def test_workers_give_memory_back(spark):
    import os

    from notelab.session import reachable
    reachable(spark)
    names = ("MALLOC_MMAP_THRESHOLD_", "MALLOC_TRIM_THRESHOLD_", "ARROW_DEFAULT_MEMORY_POOL")
    assert spark.sparkContext.parallelize([0], 1).map(lambda _: [os.environ.get(n) for n in names]).first() == [str(4 << 20), str(4 << 20), "system"]


def test_sliced_arrays():
    column = pa.array(["a b", None, "c", "d e f"], pa.string()).slice(1, 3)
    t = Tokens(*buffers(column), lower=False)
    assert t.counts.tolist() == [0, 1, 3]
