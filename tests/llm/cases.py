"""Small tables that hold the awkward rows: nulls, empty, blank and long texts, ties, repeated rows, clashing columns."""

import random
import re

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use inside or return
    *[T.StructField(c, T.StringType()) for c in ("key", "size", "score", "row", "n", "component_id", "_row")]])
EXTRA = 7
WORD = r"[^\x20\x09-\x0D]+"


def words(text):
    return re.findall(WORD, text or "")


def ascii_lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def prose(seed, n, vocabulary=4000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary):x}" for _ in range(n))


def documents(spark, rows):
    """rows: (doc_id, text, lang, source)."""
    return spark.createDataFrame([(i, t, la, s, None if t is None else len(t), *["x"] * EXTRA) for i, t, la, s in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def awkward():
    """(doc_id, text, lang, source) with near and exact copies and repeated passages."""
    base, passage = prose(1, 300), prose(2, 60)
    edited = base.split()
    edited[150] = "changed"
    twice = base.split()
    twice[10], twice[290] = "one", "two"
    far = base.split()
    for i in range(0, 300, 12):
        far[i] = f"z{i}"
    return [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, " ".join(edited), "en", "b"), (4, " ".join(twice), "en", "b"), (5, " ".join(far), "en", None),
        (6, base.upper(), "en", "c"), (7, base.replace(" ", "\n", 20).replace(" ", "\t ", 5), "en", "c"),
        (8, None, None, None), (9, "", "en", "a"), (10, " \t\n\r\x0b\x0c ", "en", "a"), (11, "one", "en", "a"), (12, "one two", "fr", "a"), (13, "one two", None, "a"),
        (14, prose(3, 80) + " " + passage + " " + prose(4, 50), "de", "a"), (15, passage, "de", "b"), (16, prose(5, 20) + "\n" + passage + "\n" + passage, "de", "b"),
        (17, prose(6, 20_000), "en", "long"), (18, "é à ü 日本語 テスト 🎉", None, "a"), (19, "x" * 50_000, None, "a"),
        (20, prose(7, 35), "en", "a"), (20, prose(7, 35), "en", "a"), (None, prose(8, 40), "en", "a"), (None, None, None, None),
        (-21, "line one\n\nline two  \nline three\nline one\nline two", "en", "a"), (22, "head\nline one\nline two\nline three\ntail", "en", "a"), (23, "line one\nother\nline two", "en", "a"),
    ]
