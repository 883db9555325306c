"""Driver contract: entry runs, every query has a name-matched oracle or is rows-only, and a
sample of queries agrees with DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as E
from tools.compare import TABLES, digest

ROWS_ONLY = {"train_mlp", "score_splits", "epoch_trace", "performance_table"}


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["section", "y", "n_rows", "n_patients"]
    assert df.count() > 0


def test_oracle_keys():
    q, o = E.queries(), E.oracle_sql()
    from notelab.plans.queries import QUERIES
    assert set(o) <= set(q)
    assert set(QUERIES) - set(o) == ROWS_ONLY


def test_nothing_else_imports_the_training_data_package():
    import pathlib
    root = pathlib.Path(E.__file__).parent
    for path in [*root.glob("notelab/**/*.py"), *root.glob("oracle/*.py"), *root.glob("tools/*.py"), root / "bench.py"]:
        if "llm" not in path.parts:
            assert "notelab.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text(), path


@pytest.mark.parametrize("name", ["clean_sections", "label_sections", "exclude_groups", "group_folds", "auc_note",
                                  "sum_pool", "annotations_wide", "span_overlap"])
def test_query_matches_oracle(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = E.queries()[name](spark, sf)
    s_cols, s_rows = df.columns, [tuple(r) for r in df.collect()]
    rel = con.sql(E.oracle_sql()[name])
    o_cols, o_rows = rel.columns, rel.fetchall()
    assert sorted(s_cols) == sorted(o_cols)
    cols = sorted(s_cols)
    s_map = [dict(zip(s_cols, r)) for r in s_rows]
    o_map = [dict(zip(o_cols, r)) for r in o_rows]
    assert len(s_rows) == len(o_rows)
    assert digest(cols, [[m[c] for c in cols] for m in s_map]) == digest(cols, [[m[c] for c in cols] for m in o_map])
