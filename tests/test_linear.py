"""The block trainer against plain Newton solvers, and what its scores obey."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalpanel.plans import blocks as B
from signalpanel.plans import linear as L
from signalpanel.plans.models import ModelSpec

SPECS = [ModelSpec("logreg", {"C": 0.3}, "standard", "log"), ModelSpec("sgd_log", {"alpha": 1e-2}, "none", "sgd"),
         ModelSpec("linear_svc", {"C": 3.0}, "minmax", "svc"),
         *[ModelSpec("rbf_svm", {"C": c, "gamma": g, "dim": 12}, "standard", f"svm{c}{g}") for c in (0.5, 2.0) for g in ("scale", 0.1)]]
LABELS = ["a", "b"]


def _rows(spark, n=90):
    r = np.random.default_rng(6)
    x = r.normal(size=(n, 3)) * [1, 5, 0.3] + [0, 2, -1]
    ys = {"a": x[:, 0] + 0.3 * r.normal(size=n) > 0.4, "b": (x[:, 0] ** 2 + r.normal(size=n) * 0.2) > 1.0}
    out = [(f, "test" if i % 2 == f else "train", lab, int(ys[lab][i]), f"r{i}", x[i].tolist())
           for f in range(2) for i in range(n) for lab in LABELS]
    return spark.createDataFrame(out, "fold int, part string, label string, y int, row_id string, x array<double>").repartition(3)


@pytest.fixture(scope="module")
def fitted(spark):
    rows = _rows(spark).cache()
    blocks, designs = L.linear_blocks(rows, SPECS, LABELS)
    return rows, blocks, L.LinearPanel(blocks, SPECS, LABELS, designs, tol=1e-9)


def _design(blocks, design):
    parts = [B.open_block(r.asDict()) for r in blocks.filter(F.col("design") == design).collect()]
    return [np.vstack([p[i] for p in parts]) for i in range(3)]


def _solve(m, x, y, s):
    """Newton on the stated objective."""
    a, t = np.column_stack([x, np.ones(len(x))]), np.where(y == 1, 1.0, -1.0)
    n = len(y)
    penalty = np.full(a.shape[1], m.ridge)
    if m.spec.family in ("sgd_log", "rbf_svm"):
        penalty[-1] = 0.0

    def value(w):
        z = t * (a @ w)
        h = np.maximum(0, 1 - z)
        loss = {"logreg": np.logaddexp(0, -z), "sgd_log": np.logaddexp(0, -z), "linear_svc": h * h,
                "rbf_svm": np.where(h < 0.1, h * h / 0.2, h - 0.05)}[m.spec.family]
        return (s * loss).sum() / n + 0.5 * (penalty * w * w).sum()

    w = np.zeros(a.shape[1])
    for _ in range(500):
        z = t * (a @ w)
        h = np.maximum(0, 1 - z)
        if m.spec.family in ("logreg", "sgd_log"):
            p = 1 / (1 + np.exp(z))
            d1, d2 = -p, p * (1 - p)
        elif m.spec.family == "linear_svc":
            d1, d2 = -2 * h, 2.0 * (h > 0)
        else:
            d1, d2 = -np.where(h < 0.1, h / 0.1, 1.0), 10.0 * ((h > 0) & (h < 0.1))
        g = a.T @ (s * d1 * t) / n + penalty * w
        if np.abs(g).max() < 1e-11:
            break
        step = np.linalg.solve((a.T * (s * d2)) @ a / n + np.diag(np.maximum(penalty, 1e-9)), g)
        size = 1.0
        while value(w - size * step) > value(w) - 1e-4 * size * (g @ step) and size > 1e-10:
            size /= 2
        w = w - size * step
    return w


def test_coefficients(fitted):
    _, blocks, panel = fitted
    assert len(panel.models) == 2 * 2 * (1 + 1 + 3 + 4 * 6)
    for m in panel.models:
        x, y, k = _design(blocks, m.design)
        if m.gamma is not None:
            x = panel.base.features(panel.base.project(x), m.gamma)
        own = (k[:, m.label] != -2) & (k[:, m.label] != (-9 if m.fold is None else m.fold))
        y = y[own, m.label]
        n = np.array([(y == 0).sum(), (y == 1).sum()])
        assert n.tolist() == m.n.tolist()
        s = (len(y) / (2 * n))[y]
        want = _solve(m, x[own], y, s)
        if m.spec.family == "rbf_svm":  # where no row lies in the rounded part, the free intercept has a range of optima
            assert m.state.norm <= 1e-9
            want[-1] = m.state.best[-1]
        assert np.abs(m.state.best - want).max() <= 1e-4 * max(1.0, np.abs(want).max()), (m.spec.name, m.fold)


def test_jobs_do_not_grow_with_models(spark, fitted):
    rows, _, panel = fitted
    one, alone = L.linear_panel(rows, SPECS[:1], LABELS, tol=1e-9)
    assert len(alone.models) == 4 and panel.passes <= 400 and one.count() == 2 * 90 * 2


def test_sigmoids(fitted):
    """Each sigmoid is at the minimum of its smoothed cross entropy."""
    _, blocks, panel = fitted
    by_key = {}
    for m in panel.models:
        if m.fold is not None:
            by_key.setdefault(panel._sigmoid_key(m), []).append(m)
    assert by_key.keys() == panel.sigmoids.keys()
    for key, ms in by_key.items():
        f, y = [], []
        for m in ms:
            x, yy, k = _design(blocks, m.design)
            x = x if m.gamma is None else panel.base.features(panel.base.project(x), m.gamma)
            held = k[:, m.label] == m.fold
            f.append(x[held] @ m.state.best[:-1] + m.state.best[-1])
            y.append(yy[held, m.label])
        f, y = np.concatenate(f), np.concatenate(y)
        t = np.where(y == 1, (sum(y == 1) + 1) / (sum(y == 1) + 2), 1 / (sum(y == 0) + 2))
        a, b = panel.sigmoids[key].best
        p = 1 / (1 + np.exp(a * f + b))
        assert abs(((t - p) * f).sum()) < 1e-5 and abs((t - p).sum()) < 1e-5
        assert a < 0 or panel.targets[ms[0].label][0] == "b"  # the order of the separable label is not turned


def test_scores(spark, fitted):
    rows, blocks, panel = fitted
    got = panel.scores(blocks).cache()
    assert got.count() == 90 * 2 * 2 * len(SPECS)
    r = rows.select("fold", "part", "label", "y", "row_id").join(
        got.withColumn("fold", F.element_at(F.split("design", "\\|"), 2).cast("int")), ["fold", "label", "row_id"])
    from signalpanel.operators import metrics as E
    auc = {(x["model"], x["part"], x["label"]): x["a"] for x in
           E.roc_auc(r, by=["model", "fold", "part"]).groupBy("model", "part", "label").agg(F.avg("auc").alias("a")).collect()}
    for (model, part, label), a in auc.items():
        if label == "a" or "scale" in model:  # the square is out of reach of the linear models
            assert a > (0.6 if model.startswith("svm") else 0.9), (model, part, label, a)
    again = L.LinearPanel(blocks, SPECS, LABELS, panel_designs(blocks), tol=1e-9).scores(blocks)
    both = got.join(again.withColumnRenamed("p", "q"), ["design", "model", "label", "row_id"])
    assert both.agg(F.max(F.abs(F.col("p") - F.col("q")))).first()[0] < 1e-6


def panel_designs(blocks):
    return {r["design"]: r["design"].split("|")[0] for r in blocks.select("design").distinct().collect()}


def test_few_rows_and_one_class(spark):
    rows = [(0, "train", "one", 1, f"r{i}", [float(i)]) for i in range(6)] + [(0, "train", "few", int(i == 0), f"r{i}", [float(i)]) for i in range(6)]
    df = spark.createDataFrame(rows, "fold int, part string, label string, y int, row_id string, x array<double>")
    sc, panel = L.linear_panel(df, [ModelSpec("linear_svc", {"C": 1.0}, "none", "svc"), ModelSpec("logreg", {"C": 1.0}, "none", "log")], ["one", "few"])
    p = {(r["model"], r["label"], r["row_id"]): r["p"] for r in sc.collect()}
    assert all(p[m, "one", f"r{i}"] == 1.0 for m in ("svc", "log") for i in range(6))
    assert panel.sigmoids == {} and p["svc", "few", "r0"] > p["svc", "few", "r5"]


def test_parameters_act_or_raise():
    for spec in (ModelSpec("logreg", {"l1_ratio": 0.5}), ModelSpec("linear_svc", {"penalty": "l1"}), ModelSpec("rbf_svm", {"degree": 3})):
        with pytest.raises(ValueError):
            L.check_params(spec)


def test_block_sums_in_steps(spark):
    df = spark.range(500).select(F.lit("d").alias("design"), F.col("id").cast("string").alias("row_id"),
                                 F.array(F.col("id").cast("double")).alias("x"), F.array(F.lit(1)).alias("y"), F.array(F.lit(-1)).alias("k"))
    for parts in (1, 30):
        b = B.feature_blocks(df.repartition(parts), 7)
        got = B.block_sums(b, lambda row: {"s": B.open_block(row)[0].sum(0), "n": np.array([row["n"]], float)})
        assert got["s"][0] == 499 * 250 and got["n"][0] == 500


def test_rows_that_share_an_id(spark):
    """Rows of one id, one of them given twice: as many train rows and scores as there are rows."""
    rows = _rows(spark, 40)
    other = rows.filter("row_id in ('r3', 'r4')").withColumn("x", F.transform("x", lambda v: v + 1.0))
    many = rows.unionByName(other).unionByName(rows.filter("row_id = 'r5'"))
    specs = [s for s in SPECS if s.family in ("logreg", "linear_svc")]
    blocks, designs = L.linear_blocks(many, specs, LABELS)
    panel = L.LinearPanel(blocks, specs, LABELS, designs)
    for m in panel.models:
        if m.fold is None:
            fold, label = int(m.design.split("|")[1]), panel.targets[m.label][0]
            own = many.filter((F.col("fold") == fold) & (F.col("label") == label) & (F.col("part") == "train"))
            assert m.n.sum() == own.count()
    scored = B.with_scores(many, L.linear_panel(many, specs, LABELS)[0])
    assert scored.count() == many.count() * len(specs) and scored.filter("p is null").count() == 0
    both = panel.labelled_scores(blocks)
    keys = ["label", "part", "y"]
    plain = {tuple(r): r["count"] for r in many.groupBy(*keys).count().collect()}
    for i, s in enumerate(specs):
        got = {tuple(r): r["count"] for r in both.filter(F.col("config") == i).groupBy(*keys).count().collect()}
        assert got == plain
        want = scored.filter(F.col("scaler") == s.scaler).agg(F.sum("p")).first()[0]
        assert abs(both.filter(F.col("config") == i).agg(F.sum("p")).first()[0] - want) < 1e-6


def test_queries_of_many_subjects(spark, tmp_path):
    """Subject numbers of six digits are cut to five: windows of several subjects share their ids."""
    from signalpanel.plans import registry as G
    from signalpanel.sources import fixtures as fx

    ids = [v for s in (*range(30), *range(10000, 10004), *range(100000, 100040)) for v in range(4 * s, 4 * s + 4)]
    r = np.random.default_rng(2)
    data = [(v, [float(e) for e in r.normal(size=64)], int(r.integers(10))) for v in ids]
    spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = G._b2_rows(spark, str(tmp_path), fx.features_b2_planted)
    assert rows.groupBy("fold", "label", "row_id").count().filter("count > 1").count() > 0
    own = fx.features_b2_planted(spark, str(tmp_path)).filter("subject_id like 'P%'")
    assert own.filter((F.col("x")[65] == 0) != (F.col("even") == 1)).count() == 0  # the planted features are the row's own
    out = G.QUERIES["model_scores_logreg"](spark, str(tmp_path)).collect()
    want = {tuple(w) for w in rows.groupBy("fold", "part", "label").agg(F.count("*"), F.count_if(F.col("y") == 1), F.countDistinct("subject_id")).collect()}
    assert {(o["fold"], o["part"], o["label"], o["n_rows"], o["n_pos"], o["n_subjects"]) for o in out} == want and not any(o["n_invalid"] for o in out)
