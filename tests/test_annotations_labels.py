"""Annotation parsing (P4-P7, P9, P10, A1-A3, F1, F2) and the label join."""

from pyspark.sql import functions as F

from notelab.functions.vocab import TAG_VOCAB
from notelab.operators import annotations as A
from notelab.operators import labels as L
from notelab.operators import notes as N

HEAD = '<?xml version="1.0"?><x:XMI><cas:Sofa xmi:id="1" sofaNum="1"/>'


def _tag(i, b, e, tag):
    return f'<x:Tag xmi:id="{i}" begin="{b}" end="{e}" semanticTag="{tag}"/>'


def _docs(spark):
    docs = [
        ("1_1.xmi", HEAD + _tag(5, 80, 85, "SE_psych") + _tag(6, 90, 91, "BN_social") + "</x:XMI>"),
        ("2_1.xmi", HEAD + "</x:XMI>"),                                            # annotated, no tag
        ("3_1.xmi", HEAD + _tag(7, 1234567, 1234570, "SE_other") + "</x:XMI>"),  # seven digits
        ("4_1.xmi", HEAD + _tag(8, 70, 71, "SE_physio_N") + "</x:XMI>"),
        ("9_9.xmi", HEAD + _tag(9, 70, 71, "SE_other") + "</x:XMI>"),            # Q7: no note file
    ]
    return spark.createDataFrame(docs, "xmi string, content string")


def test_spans_and_attributes(spark):
    sp = A.spans(_docs(spark)).orderBy("file", "begin").collect()
    assert [(r.file, r.tag, r.begin, r.end) for r in sp] == [
        ("1_1", "SE_psych", 80, 85), ("1_1", "BN_social", 90, 91), ("3_1", "SE_other", 1234567, 1234570),
        ("4_1", "SE_physio_N", 70, 71), ("9_9", "SE_other", 70, 71)]
    attrs = A.xmi_attributes(_docs(spark)).where(F.col("xmi") == "3_1.xmi").collect()
    assert (attrs[0].begin, attrs[0].end, attrs[0].tag) == ("1234567", "1234570", "SE_other")


def test_rejects_and_stems(spark):
    docs = spark.createDataFrame([("1_1-x.xmi", HEAD + _tag(1, 70, "", "SE_psych") + _tag(2, 70, 71, "SE_other") + "</x:XMI>")], "xmi string, content string")
    assert [tuple(r) for r in A.span_rejects(A.spans(docs)).collect()] == [(False, True, 1)]
    assert {r.file for r in A.spans(docs).collect()} == {"1_1"}
    assert {r.file for r in A.spans(docs, strict_stem=True).collect()} == {"1_1-x"}


def test_tags_outside_the_vocabulary_are_kept(spark):
    docs = spark.createDataFrame([("1_1.xmi", HEAD + _tag(1, 70, 71, "Zeta") + _tag(2, 70, 71, "Alpha") + _tag(3, 70, 71, "SE_psych") + "</x:XMI>")], "xmi string, content string")
    row = A.annotations_wide(docs).first()
    assert row.other_tags == ["Alpha", "Zeta"] and row.SE_psych == 1


def test_wide_table_keeps_every_document(spark):
    wide = A.annotations_wide(_docs(spark)).orderBy("xmi").collect()
    assert [r.xmi for r in wide] == ["1_1.xmi", "2_1.xmi", "3_1.xmi", "4_1.xmi", "9_9.xmi"]
    first = wide[0].asDict()
    assert {t for t in TAG_VOCAB if first[t] == 1} == {"SE_psych", "BN_social"}
    assert (first["SE_present"], first["SE_absent"], first["SE_inquiry"]) == (1, 0, 1)
    assert all(wide[1][t] == 0 for t in TAG_VOCAB) and wide[1]["SE_inquiry"] == 0
    assert (wide[3]["SE_present"], wide[3]["SE_absent"], wide[3]["SE_inquiry"]) == (0, 1, 1)
    counts = {r.SE_inquiry: r["count"] for r in A.inquiry_counts(A.annotations_wide(_docs(spark))).collect()}
    assert counts == {1: 4, 0: 1}


def _labelled(spark):
    pad = "x" * 60
    notes = spark.createDataFrame([
        ("1_1.txt", "subjective: " + pad + " objective: " + pad + " assessment: end"),
        ("2_1.txt", "subjective: alone"),
        ("3_1.txt", "assessment: q"),
        ("4_1.txt", "no titles at all"),
        ("5_1.txt", "not annotated"),
    ], "file string, note_des string")
    return _label(notes, _docs(spark))


def _label(notes, docs):
    from notelab.plans import notes_to_sections as P
    return P.labelled(N.notes_table(notes), docs)


def test_label_join(spark):
    out = {r.xmi: r for r in _labelled(spark).collect()}
    assert set(out) == {"1_1.xmi", "2_1.xmi", "3_1.xmi", "4_1.xmi", "9_9.xmi"}  # right join: 5_1 drops
    # span 80-85 shifted by 69 -> [11,16]: touches subjective [11, 72]
    assert (out["1_1.xmi"].subj_label, out["1_1.xmi"].obj_label, out["1_1.xmi"].asses_label) == (1, 0, 0)
    assert (out["2_1.xmi"].subj_label, out["3_1.xmi"].asses_label) == (0, 0)
    # unsectioned note with the inquiry flag and a side-effect span
    assert out["4_1.xmi"].subj_label == 1
    assert out["9_9.xmi"].note_des is None and out["9_9.xmi"].subj_label == 1


def test_label_plan_has_equi_join_and_no_python(spark):
    import re
    plan = _labelled(spark)._jdf.queryExecution().executedPlan().toString()
    for bad in ("BroadcastNestedLoopJoin", "CartesianProduct", "PythonUDF", "ArrowEvalPython", "BatchEvalPython"):
        assert bad not in plan
    # one join moves texts, and the section finder runs once on its output
    assert len(re.findall(r"SortMergeJoin [^\n]*RightOuter", plan)) == 1


def test_salted_join_is_exact(spark):
    from notelab.operators.skew import hot_keys, salted_join
    many = spark.range(0, 30000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 500).cast("string")).alias("k"),
        F.col("id").alias("v"))
    few = spark.createDataFrame([("hot", 1), ("hot", 2), ("5", 3), ("none", 4)], "k string, w int")
    assert [r.k for r in hot_keys(many, ["k"], fraction=0.01, min_rows=10).collect()] == ["hot"]
    salted = salted_join(many, few, ["k"], ["v"], salts=8, fraction=0.01, min_rows=10)
    plain = many.join(few, "k").select(*salted.columns)
    assert salted.count() == plain.count() == 2 * 10000 + 40
    assert salted.exceptAll(plain).count() == 0 and plain.exceptAll(salted).count() == 0


def test_rounds_keep_their_own_texts_and_labels(spark):
    """Two rounds of one name: each annotation row meets its own round's note, and its spans label that note only."""
    pad = "x" * 60
    notes = spark.createDataFrame([("r1", "1_1.txt", "subjective: " + pad + " objective: first"), ("r2", "1_1.txt", "objective: " + pad + " assessment: second"),
                                   ("r2", "1_1.txt", "assessment: a copy")], "round string, file string, note_des string")
    docs = spark.createDataFrame([("r1", "1_1.xmi", HEAD + _tag(1, 80, 85, "SE_psych") + "</x:XMI>"), ("r2", "1_1.xmi", HEAD + "</x:XMI>")], "round string, xmi string, content string")
    got = sorted((r["round"], r.note_des.split()[-1], r.subj_label, r.obj_label, r.asses_label) for r in _label(notes, docs).collect())
    assert got == [("r1", "first", 1, 0, 0), ("r2", "copy", 0, 0, 0), ("r2", "second", 0, 0, 0)]


def test_repeated_spans_collapse(spark):
    pad = "x" * 60
    notes = spark.createDataFrame([("1_1.txt", "subjective: " + pad + " objective: " + pad + " assessment: end")], "file string, note_des string")
    tags = "".join(_tag(i, 80, 85, "SE_psych") for i in range(200)) + _tag(900, 5000, 5001, "SE_other")
    docs = spark.createDataFrame([("1_1.xmi", HEAD + tags + "</x:XMI>")], "xmi string, content string")
    wide = L.with_label_spans(A.annotations_wide(docs), A.tag_subset(A.spans(docs)))
    assert [tuple(x) for x in wide.first().label_spans] == [(80, 85), (5000, 5001)]
    row = _label(notes, docs).first()
    assert "sections" in row.asDict()
