"""The importance summaries cover every selected slot."""

import math

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from signalpanel.operators import importance as IMP
from signalpanel.plans import registry as G


def test_all_selected_features(spark):
    df = spark.createDataFrame([(f, "a", j) for f in (0, 1) for j in range(60)], "fold int, label string, feature int")
    assert sorted(map(tuple, IMP.selected_features(df).collect())) == sorted(map(tuple, df.collect()))
    assert {r["feature"] for r in IMP.selected_features(df, 5).collect()} == set(range(5))


@pytest.mark.parametrize("name", ["importance_summary", "importance_summary_by_model"])
def test_summaries_of_all_selected_slots(spark, tmp_path, name):
    """Label lo selects 60 slots a fold; the first 50 in index order are not all."""
    r = np.random.default_rng(5)
    n = 96
    pq.write_table(pa.table({"vec_id": pa.array(range(n), pa.int64()), "embedding": pa.array(r.normal(size=(n, 64)).tolist(), pa.list_(pa.float32())),
                             "label": pa.array([i % 10 for i in range(n)], pa.int32())}), tmp_path / "embeddings.parquet")
    got = sorted((tuple(row)[-6:] for row in G.QUERIES[name](spark, str(tmp_path)).collect()), key=repr)
    slots = {lab: [row for row in got if row[0] == lab] for lab in ("lo", "mid", "even")}
    assert {lab: sum(row[-1] for row in rows) for lab, rows in slots.items()} == {"lo": 180, "mid": 90, "even": 36}
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet')")
    want = sorted((row[-6:] for row in con.execute(G.ORACLE[name]).fetchall()), key=repr)  # without the model's key
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:2] == b[:2] and a[-1] == b[-1]
        assert all((x is None) == (y is None) and (x is None or math.isclose(x, y, abs_tol=2e-5)) for x, y in zip(a[2:-1], b[2:-1]))
