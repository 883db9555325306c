"""Section finder goldens (P11-P19, O1, W1, W2) and properties."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from notelab.functions import sections as S
from notelab.operators import notes as N

GOLDENS = [
    ("subjective: a b objective: c assessment: d",
     [("subjective", 10, 16), ("objective", 25, 29), ("assessment", 39, 42)]),
    ("no titles here", []),
    ("subjective x objective y", []),
    ("assessment and plan: z", [("assessment and plan", 19, 22)]),
    ("x assessment", [("assessment", 12, 12)]),
    ("subjectiveassessment objective q", [("subjective", 10, 21), ("objective", 30, 32)]),
    ("objectiveassessment w", [("assessment", 19, 21)]),
    ("objectiveassessmentsubjective t", [("assessment", 19, 19), ("subjective", 29, 31)]),
    ("assessment 1 assessment 2", [("assessment", 10, 25)]),
    ("plan and assessment: p assessment and plan", [("plan and assessment", 19, 42)]),
]


def _sections(spark, texts):
    df = S.with_sections(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t")
    return [[(s.section_name, s.start_section, s.end_section) for s in r.sections] for r in df.orderBy("i").collect()]


def test_section_goldens(spark):
    assert _sections(spark, [g[0] for g in GOLDENS]) == [g[1] for g in GOLDENS]


def test_assignment_by_name(spark):
    df = spark.createDataFrame([("objectiveassessmentsubjective t",), ("no titles here",), ("x assessment",)], "note_des string")
    out = N.add_sections(df).select("subjective", "objective", "assessment").collect()
    assert [tuple(r) for r in out] == [(" t", None, None), ("no titles here", None, None), (None, None, None)]


def test_overlap_goldens(spark):
    df = spark.createDataFrame([((0, 5), (5, 9)), ((0, 3), (2, 9)), ((0, 3), (4, 9)), ((0, 4), (1, 5))],
                               "p struct<start_title:int,end_title:int>, x struct<start_title:int,end_title:int>")
    assert [r.o for r in df.select(F.expr(S.overlap_sql("p", "x")).alias("o")).collect()] == [0, 1, -1, 0]
    df2 = spark.createDataFrame([(0, 5, 5, 9), (0, 4, 5, 9), (5, 5, 5, 5), (6, 9, 0, 5), (2, 3, 0, 9)],
                                "a int, b int, c int, d int")
    got2 = [r.o for r in df2.select(S.interval_overlap(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("o")).collect()]
    assert got2 == [1, 0, 1, 0, 1]


WORDS = st.sampled_from(["subjective", "objective", "assessment", "plan", "and", "x", " ", ": ", "assessment and plan",
                         "plan and assessment", "subjectiveassessment"])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(WORDS, max_size=10).map("".join), min_size=1, max_size=10))
def test_sections_properties(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, note_des string")
    out = N.add_sections(df).orderBy("i").collect()
    for r in out:
        low = r.note_des_lower
        prev_end = -1
        for s in r.sections:
            assert 0 <= s.start_title < s.end_title <= s.start_section <= len(low)
            assert s.start_section <= s.end_section <= len(low)
            assert low[s.start_title:s.end_title] == s.section_name
            assert s.start_title >= prev_end or prev_end == -1 or s.start_title >= 0
            prev_end = s.end_section
        by_name = {("assessment" if "assessment" in s.section_name else s.section_name): s for s in r.sections}
        for name in ("objective", "assessment"):
            s = by_name.get(name)
            want = (low[s.start_section:s.end_section] or None) if s else None
            assert getattr(r, name) == want
        if not r.sections:
            assert r.subjective == low


# ---------------------------------------------------------------- lists of titles

def _greedy(text, titles):
    """The section rows of one text by plain loops; overlaps at the end keep the longer title."""
    found = sorted((text.find(t), i, t) for i, t in enumerate(titles) if t in text)
    kept, i = [], 0
    spans = [(s, s + len(t), t) for s, _, t in found]
    while i < len(spans):
        if i + 1 < len(spans) and spans[i][0] <= spans[i + 1][1] and spans[i + 1][0] <= spans[i][1]:
            a, b = spans[i], spans[i + 1]
            kept.append(a if a[1] - a[0] >= b[1] - b[0] else b)
            i += 2
        else:
            kept.append(spans[i])
            i += 1
    ends = [k[0] for k in kept[1:]] + [len(text)]
    return [(t, s, e, e, f) for (s, e, t), f in zip(kept, ends)]


def test_title_lists_against_loops(spark):
    import random
    rng = random.Random(4)
    titles = ["plan", "plan and", "and plan", "assessment", "assessment and plan", "s", "it's", "a\\b", "ent", "n and", "zzz"]
    texts = ["".join(rng.choice([*titles, " ", "x", "\n"]) for _ in range(rng.randrange(12))) for _ in range(200)] + ["", None, "plan", "planplan and plan"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {r.id: [tuple(s) for s in r.sections] for r in S.with_title_sections(df, "text", titles).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (_greedy(t, titles) if t else [])


def test_sections_to_take_and_empty_ones(spark):
    df = spark.createDataFrame([("one: a two:three: c",)], "text string")
    titles = ["one:", "two:", "three:"]

    def texts(**kw):
        found = S.with_title_sections(df, "text", titles)
        return found.select(S.section_texts(F.col("text"), F.col("sections"), **kw).alias("t")).first().t
    kept = S.with_title_sections(df, "text", titles).first().sections
    assert [s.section_name for s in kept] == ["one:", "three:"]  # titles that touch count as overlapping
    spaced = df.select(F.lit("one:x two: three:").alias("text"))
    found = S.with_title_sections(spaced, "text", ["one:", "two: ", "three:"])
    assert [s.section_name for s in found.first().sections] == ["one:", "three:"]
    assert texts() == [" a two:", " c"] and texts(sections_list=["three:"]) == [" c"] and texts(sections_list=["no"]) == []
    last = spark.createDataFrame([("one: a three:",)], "text string")
    empty = S.extract(last, "text", titles, delete_empty=False).first()
    assert empty.section_texts == [" a ", ""] and S.extract(last, "text", titles).first().section_texts == [" a "]
    assert S.extract(last, "text", titles, ["three:"], delete_empty=False).first().section_texts == [""]


@pytest.mark.parametrize("name", ["title_list", "title_list_extract"])
def test_titles_are_searched_once(spark, name):
    """The search stands once in the plan: not again in a filter that the planner infers from the explode and pushes down."""
    import __spark_entry__ as E
    plan = E.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("instr(") == 1


def test_a_filter_on_sections_repeats_the_search_once(spark):
    df = spark.createDataFrame([("one: a two: b",), (None,), ("",)], "text string").repartition(2)
    found = S.with_title_sections(df, "text", ["one:", "two:"]).select(F.explode("sections").alias("s")).select("s.section_name")
    assert sorted(r[0] for r in found.collect()) == ["one:", "two:"]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("instr(") <= 3
