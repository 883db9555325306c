"""The pipeline's stages tell rows apart by id and text."""

import os
import sys

sys.path.insert(0, os.path.dirname(__file__))
from cases import documents, empty, prose  # noqa: E402

import corpus_pipeline as cp  # noqa: E402


def kept(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in df.collect())


def test_near_copies_by_id_and_text(spark, tmp_path):
    a, b, c = prose(1, 80), prose(2, 80), prose(3, 80)
    near = a.split()
    near[40] = "changed"
    rows = [(1, a, "en", "s"), (1, b, "en", "s"), (2, c, "en", "s"),  # one id, unlike texts
            (3, " ".join(near), "en", "s"), (None, a, "en", "s"), (None, prose(4, 80), "en", "s"), (2, c, "en", "s"), (2, c, "de", "s"),
            (None, prose(5, 80), "en", "s"), (9, prose(5, 80), "en", "s"), (7, "", "en", "s"), (7, "", "en", "s"), (8, None, "en", "s")]
    got = kept(cp.near_copies(spark, documents(spark, rows), str(tmp_path)))
    assert got == sorted([(False, 1, a), (False, 1, b), (False, 2, c), (True, 0, prose(4, 80)), (False, 9, prose(5, 80)), (False, 7, ""), (False, 7, ""), (False, 8, "")])
    assert cp.near_copies(spark, empty(spark), str(tmp_path)).collect() == []


def test_decontamination_by_id_and_text(spark, tmp_path):
    item = prose(77, 30)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    leak = prose(9, 40) + " " + item
    rows = [(1, leak, "en", "s"), (1, prose(1, 60), "en", "s"), (None, leak + " end", "en", "s"), (None, prose(2, 60), "en", "s"), (2, None, "en", "s")]
    got = kept(cp.decontamination(spark, documents(spark, rows), str(tmp_path)))
    assert got == sorted([(False, 1, prose(1, 60)), (True, 0, prose(2, 60)), (False, 2, "")])
