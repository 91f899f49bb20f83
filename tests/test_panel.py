import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from signalpanel.config import label_config
from signalpanel.operators import aggregate as A
from signalpanel.operators import nested as NS
from signalpanel.operators import split as C
from signalpanel.operators import windows as W
from signalpanel.operators.smote import smote
from signalpanel.plans import models as M
from signalpanel.plans import panel as PN
from signalpanel.sources import fixtures as fx
from tests.conftest import SF_SMALL


def test_panel_has_85_candidates():
    specs = PN.panel_configs()
    assert len(specs) == 85
    assert len({s.key for s in specs}) == 85


def test_smote_adds_rows_between_minority_points(spark):
    rng = np.random.default_rng(1)
    n_pos, n_neg = 6, 60
    X = np.vstack([rng.normal(0, 1, (n_neg, 3)), rng.normal(1.0, 1, (n_pos, 3))])
    y = [0] * n_neg + [1] * n_pos
    pdf = pd.DataFrame({"row_id": [f"r{i}" for i in range(len(y))], "y": y, "part": "train",
                        "x": [list(map(float, r)) for r in X]})
    tr = spark.createDataFrame(pdf)
    out = smote(tr, k=3, ratio=0.25, variant="regular").toPandas()
    assert len(out) == int(0.25 * n_neg) - n_pos
    assert (out.y == 1).all() and out.row_id.str.startswith("smote:").all()
    lo, hi = X[n_neg:].min(0), X[n_neg:].max(0)
    for v in out.x:
        assert np.all(np.asarray(v) >= lo - 1e-9) and np.all(np.asarray(v) <= hi + 1e-9)
    again = smote(tr, k=3, ratio=0.25, variant="regular").toPandas()
    assert sorted(map(tuple, out.x)) == sorted(map(tuple, again.x))


def _skewed(spark, n_pos=6, n_neg=60):
    rng = np.random.default_rng(1)
    X = np.vstack([rng.normal(0, 1, (n_neg, 3)), rng.normal(1.0, 1, (n_pos, 3))])
    rows = [(f"r{i}", f"P{i:03d}", "lab", 0, "test" if i % 5 == 0 else "train", int(i >= n_neg), [float(v) for v in x])
            for i, x in enumerate(X)]
    return spark.createDataFrame(rows, "row_id string, subject_id string, label string, fold int, part string, y int, x array<double>")


def test_synthetic_rows_are_never_scored(spark):
    g = _skewed(spark)
    syn = smote(g.filter("part = 'train'"), k=3, variant="regular")
    assert syn.count() > 0 and syn.filter("subject_id is not null").count() == 0
    out = PN.build_pipeline(g, M.ModelSpec("knn", {"n_neighbors": 3}, "standard"), None, use_smote=True)
    assert sorted(r["row_id"] for r in out.collect()) == sorted(r["row_id"] for r in g.collect())
    without = PN.build_pipeline(g, M.ModelSpec("knn", {"n_neighbors": 3}, "standard"), None)
    a = {r["row_id"]: r["p"] for r in out.collect()}
    assert any(abs(a[r["row_id"]] - r["p"]) > 1e-9 for r in without.collect())  # but they took part in the fit


def test_importance_of_fitted_models(spark):
    g = _skewed(spark, 30, 60)
    cfg = label_config(spark, ["lab"], k_best=2)
    imp = PN.fitted_importance(g, M.ModelSpec("logreg", {"C": 1.0, "max_iter": 20}, "standard", "LR"), cfg, ["lab"], [0], n_repeats=2).toPandas()
    assert len(imp) == 2 and set(imp.n_repeats) == {2} and set(imp.feature_index) <= {0, 1, 2}
    assert imp.baseline_error.between(0, 1).all() and set(imp.model_key) == {"standard__LR"}


def test_nested_choice_of_a_constant_label(spark):
    rows = [(0, c, i, inner, "inner_val" if inner == s % 2 else "inner_train", f"P{s}", lab, y, p)
            for i, c in enumerate(["a", "b"]) for inner in (0, 1) for s in range(6)
            for lab, y, p in (("flat", 0, 0.1 * s), ("real", s % 2, 0.2 + 0.1 * s))]
    scores = spark.createDataFrame(rows, "fold int, candidate string, cand_order int, inner_fold int, part string, subject_id string, "
                                         "label string, y int, p double")
    cfg = label_config(spark, ["flat", "real"])
    err = NS.inner_errors(scores, cfg)
    got = {r["label"]: r["chosen_key"] for r in NS.nested_select(err, NS.constant_labels(scores)).collect()}
    assert got["flat"] is None and got["real"] in ("a", "b")


def test_unknown_aggregation_mode(spark):
    import pytest

    with pytest.raises(ValueError):
        A.aggregate_scores(_skewed(spark).withColumn("p", F.lit(0.5)), mode="median")


def test_l1_grids():
    from signalpanel.plans import l1

    count = lambda g: sum(len(M.expand_grid(f, v)) for f, v in g.items())
    assert count(l1.WINDOW_GRIDS) == 62
    assert count(l1.TASK_GRIDS) == 10
    assert count(l1.SUBJECT_GRIDS) == 3115


def test_panel_end_to_end_and_nested(spark):
    wins = fx.features_b2(spark, SF_SMALL)
    sl = W.subject_labels(wins, fx.B2_LABELS)
    folds = C.multilabel_folds(sl, fx.B2_LABELS, k=3)
    rows = PN.model_rows(wins, folds, ["lo"], 3)
    cfg = label_config(spark, ["lo"])
    specs = [M.ModelSpec("logreg", {"C": 1.0, "max_iter": 20}, "standard", "LR1"),
             M.ModelSpec("logreg", {"C": 0.1, "max_iter": 20}, "minmax", "LR2")]
    scores = M.fit_panel(rows, specs, ["lo"], [0, 1, 2],
                         scaler_fn=lambda g, k: g if k == "none" else __import__(
                             "signalpanel.operators.prep", fromlist=["x"]).apply_scaler(
                             g, __import__("signalpanel.operators.prep", fromlist=["x"]).fit_scaler(
                                 g.filter(F.col("part") == "train"), k), k), parallelism=6)
    ev = PN.evaluate_scores(scores, cfg)
    fr = ev["fold_results"].toPandas()
    assert len(fr) == 6 and fr.n_test_subjects.gt(0).all()
    assert len(ev["best"].toPandas()) == 5
    nested = PN.run_nested(rows, sl, folds, specs, ["lo"], cfg, parallelism=6)
    ch = nested["choices"].toPandas()
    assert len(ch) == 3 and set(ch.chosen_key) <= {s.key for s in specs}
    assert len(nested["fold_results"].toPandas()) == 3


def test_registered_panels_are_whole(spark):
    """The ``_all`` panels hold every scaler and every nearest-neighbour variant, as in DuckDB."""
    import duckdb

    import __spark_entry__ as E
    from signalpanel.plans import l1
    from tests.conftest import SF_SMALL

    assert {(s.params["n_neighbors"], s.params["p"], s.params["weights"]) for s in l1.l1_specs(l1.SUBJECT_GRIDS, ["knn"])} == {
        (k, p, w) for k in (3, 5, 7, 11) for p in (1, 2) for w in ("uniform", "distance")}
    con = duckdb.connect()
    for t in ("events", "embeddings", "labels", "lineitem"):
        con.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    for name, grids in (("task_panel_all", l1.TASK_GRIDS), ("subject_panel_all", l1.SUBJECT_GRIDS)):
        got = E.queries()[name](spark, SF_SMALL)
        res = con.execute(E.oracle_sql()[name])
        cols = [d[0] for d in res.description]
        want = sorted(tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in res.fetchall())
        rows = sorted(tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in got.select(*cols).collect())
        assert rows == want
        if rows:
            assert {(r[cols.index("scaler")], r[cols.index("model")]) for r in rows} == {
                (k, x.name) for k in l1.L1_SCALERS for x in l1.l1_specs(grids, ["knn"])}


def test_power_of_large_values(spark):
    """A λ that presses all values together to within rounding of the squares is no best λ."""
    import numpy as np

    from signalpanel.operators import prep as P

    v = 40_000.0 + 900.0 * np.random.default_rng(3).normal(size=300)
    rows = spark.createDataFrame([([float(x)],) for x in v], "x array<double>").repartition(3)
    fit = P.fit_scaler(rows, "power").first()
    sl = np.log1p(v).sum()

    def likelihood(lam):
        t = np.log1p(v) if lam == 0 else np.exp(lam * np.log1p(v)) / lam  # the constant -1 / lam left out
        return -len(v) / 2 * np.log(t.var()) + (lam - 1) * sl

    best = max(P.POWER_LAMBDAS, key=likelihood)
    for digits in P.POWER_DIGITS:
        best = max((round(best + d, digits) for d in P.power_steps(digits)), key=likelihood)
    assert abs(fit["lam"][0] - best) < 0.011  # the likelihood is flat here
    assert fit["s"][0] != 1.0


def test_power_without_bounds(spark):
    """Optima inside and far outside the first window, against a plain search."""
    import numpy as np

    from signalpanel.operators import prep as P

    r = np.random.default_rng(8)
    base = r.normal(size=400)
    x = np.column_stack([np.exp(base * 0.4), 2.0 - np.exp(-base * 0.1), 0.05 * np.exp(0.9 * base), 1 + 0.05 * base])
    rows = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>").repartition(3)
    lam = P.fit_scaler(rows, "power").first()["lam"]
    for j in range(x.shape[1]):
        v = x[:, j]
        sl = (np.sign(v) * np.log1p(np.abs(v))).sum()
        value = lambda q: -len(v) / 2 * np.log(P._yj_np(v, np.float64(q)).var()) + (q - 1) * sl  # noqa: E731, B023
        grid = np.linspace(-40, 40, 8001)
        centre = grid[np.argmax([value(q) for q in grid])]
        fine = np.linspace(centre - 0.01, centre + 0.01, 2001)
        assert abs(lam[j] - fine[np.argmax([value(q) for q in fine])]) <= 1.01e-4, j
    assert max(abs(q) for q in lam) > 3.1


def test_knn_variants_share_a_search(spark, monkeypatch):
    """One search per distance serves every k and weighting of the grid."""
    import numpy as np

    from signalpanel.plans import l1

    rng = np.random.default_rng(3)
    split = spark.createDataFrame([(0, "train" if i < 40 else "test", f"s{i}", f"r{i:02d}", i % 2, rng.normal(size=2).tolist()) for i in range(50)],
                                  "fold int, part string, subject_id string, row_id string, y int, x array<double>")
    calls, plain = [], l1.M.knn_neighbors
    monkeypatch.setattr(l1.M, "knn_neighbors", lambda *a, **k: calls.append(1) or plain(*a, **k))
    specs = l1.l1_specs(l1.SUBJECT_GRIDS, ["knn"])
    got = l1.l1_scores(split, specs, ("standard",)).toPandas()
    assert len(calls) == 2 and len(got) == 10 * len(specs)
    own = l1.l1_scores(split, [s for s in specs if s.params == {"n_neighbors": 3, "weights": "distance", "p": 1}], ("standard",)).toPandas()
    both = own.merge(got, on=["model", "row_id"])
    assert len(both) == 10 and np.allclose(both["p_x"], both["p_y"], rtol=0, atol=1e-12)


def test_importance_scores_without_lambdas(spark):
    """The fixed scorer: the sum from left to right, NULL with a NULL in it, no interpreted lambda per element."""
    import numpy as np

    from signalpanel.plans import registry as G

    x = np.random.default_rng(1).normal(size=(30, 64)) * 1e3
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(30, [None] + [1.0] * 63), (31, None), (32, [1.0])]
    df = G._linear_scorer(spark.createDataFrame(data, "i int, x array<double>").repartition(2))
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()
    got = {r["i"]: r["p"] for r in df.collect()}
    for i, v in enumerate(x):
        z = 0.0
        for w, e in zip(G._W, v):
            z += w * float(e)
        assert abs(got[i] - (1 / (1 + np.exp(-z)) if z > -700 else 0.0)) < 1e-12
    assert got[30] is None and got[31] is None and got[32] is None
