"""Labels from a stream of notes and annotations in any order are those of the batch plan."""

import os
import random

import pytest

from notelab.plans import notes_to_sections as P
from notelab.sources import files as FS
from notelab.streaming import label_state as LS
from notelab.streaming import notes_stream as NS


def _files():
    """(path, content): notes, two documents for one stem, a document without a note, a note without a document, two rounds."""
    def note(body):
        return f"h1\th2\nskip one\nskip two\n{body}\textra\n"

    def doc(*tags):
        return '<?xml version="1.0"?><x:XMI>' + "".join(f'<x:Tag xmi:id="{i}" begin="{b}" end="{e}" semanticTag="{t}"/>' for i, (t, b, e) in enumerate(tags)) + "</x:XMI>\n"

    body = "Subjective: " + "ww " * 30 + "objective: seen " + "assessment: fine"
    out = []
    for r in ("R1", "R2"):
        out += [(f"notes/{r}/12_a1.txt", note(body)), (f"notes/{r}/13_b1.txt", note("no title here " * 5)), (f"notes/{r}/14_c1.txt", note(body)), (f"notes/{r}/12_a1-x.txt", note("assessment first, subjective later"))]
        out += [(f"ann/{r}/12_a1.xmi", doc(("SE_psych", 80, 84), ("BN_other", 1, 2))), (f"ann/{r}/12_a1-x.xmi", doc(("SE_other", 190, 195))), (f"ann/{r}/13_b1.xmi", doc(("SE_physio_N", 70, 75))),
                (f"ann/{r}/99_z1.xmi", doc(("SE_physio", 70, 75)))]
    out.append(("ann/R1/14_c1.xmi", doc(("BN_social", 3, 9))))
    return out


@pytest.fixture
def small(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")  # a state store each
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "8")


@pytest.mark.parametrize("order", ["notes first", "documents first", 1])
def test_any_order_gives_the_batch(small, tmp_path, order):
    spark = small
    root, files = str(tmp_path), sorted(_files(), reverse=order == "notes first")
    for kind in ("notes", "ann"):
        for r in ("R1", "R2"):
            os.makedirs(f"{root}/{kind}/{r}")
    if isinstance(order, int):
        random.Random(order).shuffle(files)
    half = -(-len(files) // 2)
    for a in range(0, len(files), half):
        for path, content in files[a : a + half]:
            with open(f"{root}/{path}", "w") as f:
                f.write(content)
        query = LS.write_labels(NS.note_file_stream(spark, f"{root}/notes"), NS.xmi_file_stream(spark, f"{root}/ann"), f"{root}/out", checkpoint=f"{root}/ck")
        assert query.awaitTermination(120)
    got = sorted(map(tuple, LS.latest_labels(spark, f"{root}/out").collect()))
    batch = P.labelled_from_files(spark, f"{root}/notes", f"{root}/ann", clean=False).select("xmi", "round", "file", *LS.LABELS)
    assert got == sorted(map(tuple, batch.collect())) and len(got) == 9
    assert any(r[3] for r in got) and any(not r[3] for r in got)


def test_the_state_holds_no_text(spark):
    notes = spark.createDataFrame([("12_a1.txt", "r", "Subjective: secret words assessment: more")], "file string, round string, note_des string")
    row = LS.note_rows(notes).first()
    assert row.key == "12_a1" and "secret" not in row.note
    assert FS.union_rounds([notes]).count() == 1
