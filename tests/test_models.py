import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from signalpanel.operators import metrics as E
from signalpanel.plans import models as M


def _planted(spark, n=120, d=6, seed=0):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    X = rng.normal(size=(n, d)) + y[:, None] * 2.0
    part = np.where(np.arange(n) % 3 == 0, "test", "train")
    pdf = pd.DataFrame({"row_id": [f"r{i}" for i in range(n)], "part": part, "label": "a",
                        "y": y.astype(int), "x": [list(map(float, r)) for r in X]})
    return spark.createDataFrame(pdf)


def test_logreg_and_knn_separate_planted_label(spark):
    rows = _planted(spark)
    for spec in (M.ModelSpec("logreg", {"C": 1.0, "max_iter": 30}),
                 M.ModelSpec("knn", {"n_neighbors": 5}),
                 M.ModelSpec("random_forest", {"n_estimators": 10, "max_depth": 4})):
        sc = M.fit_score(rows, spec)
        pdf = sc.toPandas()
        assert pdf.p.between(0, 1).all()
        auc = E.roc_auc(sc.filter(F.col("part") == "test")).first()["auc"]
        assert auc > 0.9, (spec.family, auc)


def _brute_knn(Xq, Xt, ids, k, p):
    d = (np.abs(Xq[:, None, :] - Xt[None, :, :]) ** p).sum(-1) ** (1 / p)
    return [sorted(zip(row, ids))[:k] for row in d]


def _knn_rows(spark, X, prefix):
    return spark.createDataFrame([(f"{prefix}{i:03d}", 0, [float(v) for v in x]) for i, x in enumerate(X)],
                                 "row_id string, y int, x array<double>")


def _check_knn(spark, Xt, Xq, k=5, p=2):
    got = M.knn_neighbors(_knn_rows(spark, Xt, "r"), _knn_rows(spark, Xq, "q"), k, p, block_rows=40).toPandas()
    got = got.sort_values(["_qid", "_rank"]).groupby("_qid")["_id"].apply(list)
    want = _brute_knn(Xq, Xt, [f"r{i:03d}" for i in range(len(Xt))], k, p)
    for i, w in enumerate(want):
        assert got[f"q{i:03d}"] == [x for _, x in w], (i, got[f"q{i:03d}"], w)


def test_knn_with_many_duplicates(spark):
    """Forty equal points: ties go to the smallest ids."""
    rng = np.random.default_rng(2)
    X = rng.normal(size=(60, 4))
    X[20:60] = X[20]
    _check_knn(spark, X, X[[0, 25, 40]] + 1e-3)


def test_knn_with_large_values(spark):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(80, 6)) + 1e8
    _check_knn(spark, X, X[:10] + rng.normal(size=(10, 6)) * 0.1)


def test_knn_other_metrics(spark):
    rng = np.random.default_rng(4)
    X = rng.normal(size=(50, 5))
    _check_knn(spark, X, rng.normal(size=(7, 5)), p=1)
    _check_knn(spark, X, rng.normal(size=(7, 5)), p=3)


def test_every_family_is_a_scorer_in_range(spark):
    rows = _planted(spark, n=90)
    small = {"linear_svc": {"C": 1.0, "max_iter": 10}, "rbf_svm": {"C": 1.0, "dim": 32, "max_iter": 10}, "mlp": {"hidden": (4,), "max_iter": 15},
             "adaboost": {"n_estimators": 4}, "xgb": {"n_estimators": 3, "max_depth": 2, "gamma": 1, "min_child_weight": 2},
             "lgbm": {"n_estimators": 2, "max_depth": -1, "num_leaves": 7, "feature_fraction": 0.8}}
    for fam, params in small.items():
        pdf = M.fit_score(rows, M.ModelSpec(fam, params)).toPandas()
        assert len(pdf) == rows.count() and pdf.p.between(0, 1).all(), fam
        hit = pdf[pdf.part == "test"]
        assert hit.p[hit.y == 1].mean() > hit.p[hit.y == 0].mean(), fam


def test_class_weights_only_where_the_family_has_them():
    assert not {"gb", "xgb", "catboost", "mlp", "adaboost", "knn"} & set(M.WEIGHTED_FAMILIES)


def test_constant_scores_by_group(spark):
    df = spark.createDataFrame([("a", "train", 0), ("a", "test", 1), ("b", "train", 0), ("b", "train", 1), ("c", "test", 1)],
                               "g string, part string, y int")
    got = {r["g"]: r["constant"] for r in M.constant_scores(df, ["g"]).collect()}
    assert got == {"a": 0.0, "b": None, "c": 0.0}


def test_constant_label_gets_mean(spark):
    rows = _planted(spark, n=30).withColumn("y", F.lit(0))
    sc = M.fit_score(rows, M.ModelSpec("logreg"))
    assert set(sc.toPandas().p) == {0.0}


def test_expand_grid_order():
    g = M.expand_grid("SVM", {"gamma": [0.1, 0.2], "C": [1, 3]})
    assert [n for n, _ in g] == ["SVM_0", "SVM_1", "SVM_2", "SVM_3"]
    assert [p for _, p in g] == [{"C": 1, "gamma": 0.1}, {"C": 1, "gamma": 0.2},
                                 {"C": 3, "gamma": 0.1}, {"C": 3, "gamma": 0.2}]


def test_knn_prunes_clustered_rows(spark):
    """Clustered rows: exact, and under a fifth of all pairs are compared."""
    from signalpanel.plans import neighbors as N

    rng = np.random.default_rng(11)
    centres = rng.normal(size=(20, 5)) * 30
    X = np.vstack([c + rng.normal(size=(40, 5)) for c in centres])
    Q = np.vstack([c + rng.normal(size=(2, 5)) for c in centres])
    _check_knn(spark, X, Q, k=7)
    t = _knn_rows(spark, X, "r").select(F.lit("").alias("_g"), F.col("row_id").alias("_tid"), F.col("x").alias("_tx"))
    q = _knn_rows(spark, Q, "q").select(F.lit("").alias("_g"), F.col("row_id").alias("_qid"), F.col("row_id").alias("_rid"), F.col("x").alias("_qx"))
    cells = N.make_cells(t, 2, 100)
    routes = N.query_routes(q, cells, 7, 2).collect()
    pairs = sum(cells[""].size[c] / cells[""].blocks[c] for r in routes for c in r["_cells"])
    assert cells[""].size.sum() == len(X) and pairs < len(X) * len(Q) / 5


def test_knn_rows_meet_in_few_products():
    """Rows whose cells all differ go together by their nearest pivot, and lose no cell."""
    import pyarrow as pa

    from signalpanel.plans import neighbors as N

    rng = np.random.default_rng(5)
    cell = rng.integers(0, 200, 3000)
    near = rng.integers(0, 6, 500)
    wanted = [sorted({int(n)} | set(rng.integers(0, 200, 3 if n < 5 else 120).tolist())) for n in near]
    groups = list(N.meetings(pa.array(wanted, pa.list_(pa.int32())), near, cell))
    assert len(groups) <= 6 and sorted(np.concatenate([at for at, _ in groups]).tolist()) == list(range(500))
    for at, own in groups:
        for i in at:
            assert np.isin(np.flatnonzero(np.isin(cell, wanted[i])), own).all()


def test_knn_computes_few_distances(monkeypatch):
    """Only pairs near the k-th place are computed directly, also for p = 1, and with an outlier for 32 bits."""
    rng = np.random.default_rng(6)
    X, Q, ids, pairs = rng.normal(size=(3000, 8)), rng.normal(size=(60, 8)), np.arange(3000), []
    far = np.vstack([X[:-1], np.full((1, 8), 1e5)])
    plain = M._distances
    monkeypatch.setattr(M, "_distances", lambda q, t, p: pairs.append(len(q)) or plain(q, t, p))
    for p in (1, 2):
        for T in (X, far):
            pairs.clear()
            d, y, near = M._topk_np(Q, T, ids * 1.0, ids, 7, p)
            want = _brute_knn(Q, T, ids.tolist(), 7, p)
            assert near.tolist() == [[i for _, i in w] for w in want] and (y == near).all()
            assert sum(pairs) < 60 * 100
    same = np.ones((400, 8))
    assert M._topk_np(same[:2], same, ids[:400] * 1.0, ids[:400][::-1], 5, 1)[2].tolist() == [[0, 1, 2, 3, 4]] * 2


def test_knn_labels_share_a_search(spark, monkeypatch):
    rng = np.random.default_rng(7)
    data = [(i % 2, f"r{i // 2:02d}", rng.normal(size=3).tolist(), int(rng.integers(2)), int(rng.integers(2)) if i % 7 else None) for i in range(80)]
    rows = spark.createDataFrame(data, "fold int, row_id string, x array<double>, a int, b int")
    calls, plain = [], M.knn_neighbors
    monkeypatch.setattr(M, "knn_neighbors", lambda *a, **k: calls.append(1) or plain(*a, **k))
    got = {(r["fold"], r["row_id"], r["label"]): (r["y"], r["p"]) for r in M.knn_scores(rows, rows, ["a", "b"], k=4, by=["fold"]).collect()}
    assert len(calls) == 1 and len(got) == 160
    for label in ("a", "b"):
        one = M.knn_score(rows.select("fold", "row_id", "x", F.col(label).alias("y")), rows.select("fold", "row_id", "x", F.col(label).alias("y")), k=4, by=["fold"])
        for r in one.collect():
            assert got[r["fold"], r["row_id"], label] == (r["y"], r["p"])
