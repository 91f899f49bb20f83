import duckdb
import math

import __spark_entry__ as E
from tests.conftest import SF_SMALL

TABLES = ["events", "embeddings", "labels", "lineitem"]
#: Every query with SQL but the slowest (model fits, SMOTE and the plans that
#: ``tools/check_oracle.py`` runs at the larger scale).
SLOW = ("model_scores", "smote", "part_signal", "importance", "permutation", "tune_", "subject_scores_", "clean_channel",
        "channel_features_short", "fold_summary", "top_configs", "best_decomposition", "nested_fold", "nested_label", "union_results",
        "controls_summary", "leaderboard", "task_panel", "subject_panel", "op", "pipeline")


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "lab_a" in df.columns and "d_value_mean" in df.columns


def test_oracle_keys_subset_of_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def test_fast_queries_match_oracle(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    qs, sq = E.queries(), E.oracle_sql()
    names = [n for n in sq if not n.startswith(SLOW)] + ["tune_clinical_cost", "subject_scores_p90"]
    for name in names:
        sdf = qs[name](spark, SF_SMALL)
        cols = sorted(sdf.columns)
        a = sorted((tuple(_norm(r[c]) for c in cols) for r in sdf.collect()), key=repr)
        res = con.execute(sq[name])
        dcols = [d[0] for d in res.description]
        assert sorted(dcols) == cols, name
        idx = [dcols.index(c) for c in cols]
        b = sorted((tuple(_norm(r[i]) for i in idx) for r in res.fetchall()), key=repr)
        assert a == b, name
