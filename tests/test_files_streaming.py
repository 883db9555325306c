"""File scans and sinks (S1-S6) and the streaming path, on files written to pytest's tmp_path."""

import os

from notelab.sources import files as FS
from notelab.streaming import notes_stream as NS

XMI = ('<?xml version="1.0"?><x:XMI><x:Tag xmi:id="3" begin="80" end="84" semanticTag="SE_psych"/></x:XMI>\n'
       'second line is ignored semanticTag="SE_other"\n')


def _note(body):
    return f"h1\th2\nskip one\n\nskip two\n{body}\textra\n"


def _write_tree(root):
    os.makedirs(f"{root}/notes/Round01/deep", exist_ok=True)
    os.makedirs(f"{root}/notes/telephone", exist_ok=True)
    os.makedirs(f"{root}/ann/Round01", exist_ok=True)
    with open(f"{root}/notes/Round01/12_a1.txt", "w") as fh:
        fh.write(_note("Subjective: " + "ww " * 30 + "assessment: fine"))
    with open(f"{root}/notes/Round01/deep/7 b_2.txt", "w") as fh:
        fh.write(_note("no sections"))
    with open(f"{root}/notes/telephone/5_x3.TXT", "w") as fh:   # extension is case-sensitive: skipped
        fh.write(_note("ignored"))
    with open(f"{root}/ann/Round01/12_a1.xmi", "w") as fh:
        fh.write(XMI)


def test_scan_notes_and_xmi(spark, tmp_path):
    root = str(tmp_path)
    _write_tree(root)
    notes = {r.file: r for r in FS.scan_notes(spark, f"{root}/notes").collect()}
    assert set(notes) == {"12_a1.txt", "7 b_2.txt"}
    assert notes["7 b_2.txt"].note_des == "no sections" and notes["12_a1.txt"].round == "Round01"
    xmi = FS.scan_xmi(spark, f"{root}/ann").collect()
    assert len(xmi) == 1 and xmi[0].xmi == "12_a1.xmi" and "second line" not in xmi[0].content


def test_union_and_csv_sinks(spark, tmp_path):
    a = spark.createDataFrame([("1_1.txt", "r1", "x")], "file string, round string, note_des string")
    b = spark.createDataFrame([("2_1.txt", "x", "user")], "file string, note_des string, role string")
    u = FS.union_rounds([a, b])
    assert u.columns == ["file", "round", "note_des", "role"] and u.count() == 2
    out = str(tmp_path / "spans_csv")
    FS.write_csv(u, out)
    back = spark.read.option("header", True).csv(out)
    assert sorted(back.columns) == sorted(u.columns) and back.count() == 2


def test_streaming_sections_and_labels(spark, tmp_path):
    root = str(tmp_path)
    _write_tree(root)
    stream = NS.note_file_stream(spark, f"{root}/notes", max_files_per_trigger=1)
    out = str(tmp_path / "sections")
    q = NS.write_sections(NS.sectioned_stream(stream).select("file", "mrn", "subjective_clean1", "assessment_clean1"),
                          out, checkpoint=str(tmp_path / "ck1"))
    q.awaitTermination(120)
    got = {r.file: r for r in spark.read.parquet(out).collect()}
    assert set(got) == {"12_a1.txt", "7 b_2.txt"}
    assert got["12_a1.txt"].assessment_clean1 == "fine" and got["12_a1.txt"].mrn == "12"

    xmi = FS.scan_xmi(spark, f"{root}/ann")
    stream2 = NS.note_file_stream(spark, f"{root}/notes")
    out2 = str(tmp_path / "labels")
    q2 = NS.label_batches(stream2, xmi, out2, checkpoint=str(tmp_path / "ck2"))
    q2.awaitTermination(120)
    lab = {r.file: r for r in spark.read.parquet(out2).collect()}
    assert set(lab) == {"12_a1.txt", "7 b_2.txt"}
    assert (lab["12_a1.txt"].xmi, lab["12_a1.txt"].subj_label, lab["12_a1.txt"].asses_label) == ("12_a1.xmi", 1, 0)
    assert lab["7 b_2.txt"].xmi is None and lab["7 b_2.txt"].subj_label is None  # not annotated yet


def test_training_rows_from_files_and_span_export(spark, tmp_path):
    from notelab.plans import notes_to_sections as P
    root = str(tmp_path)
    _write_tree(root)
    excl = spark.createDataFrame([("7",)], "mrn string")
    rows = {(r.note_id, r.section): r for r in
            P.training_rows_from_files(spark, f"{root}/notes", f"{root}/ann", excl).collect()}
    # only the annotated note remains (right join); its subjective section has 30 tokens and the span
    assert set(rows) == {("12_a1", "subjective")}
    assert rows[("12_a1", "subjective")].y == 1 and rows[("12_a1", "subjective")].mrn == "12"
    P.export_spans(spark, f"{root}/ann", str(tmp_path / "spans"))
    back = spark.read.option("header", True).csv(str(tmp_path / "spans")).collect()
    assert [(r.file, r.tag, r.begin, r.end) for r in back] == [("12_a1", "SE_psych", "80", "84")]


def test_exclusion_list(spark, tmp_path):
    from notelab.operators.dataset import exclude_groups
    with open(tmp_path / "list.csv", "w") as f:
        f.write("mrn,why\n 007 ,a\n12,b\n12,c\n,d\n")
    listed = FS.read_exclusions(spark, str(tmp_path / "list.csv"))
    assert sorted(r.mrn for r in listed.collect()) == ["007", "12"]
    rows = spark.createDataFrame([("12", 1), ("7", 2), (None, 3)], "mrn string, i int")
    assert sorted(r.i for r in exclude_groups(rows, listed).collect()) == [2, 3]
    with open(tmp_path / "plain.txt", "w") as f:
        f.write("5\n6\n")
    assert sorted(r.mrn for r in FS.read_exclusions(spark, str(tmp_path / "plain.txt"), header=False).collect()) == ["5", "6"]
    open(tmp_path / "none.csv", "w").close()
    assert FS.read_exclusions(spark, str(tmp_path / "none.csv")).collect() == []
