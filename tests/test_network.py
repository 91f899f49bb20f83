"""Networks of all groups in shared passes, against plain ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalpanel.plans import models as M
from signalpanel.plans import network as N

MLP = M.ModelSpec("mlp", {"hidden": (3,), "max_iter": 12, "alpha": 0.1}, "none", "net")
FOLDS, N_ROWS = 2, 90


def _rows(spark):
    """Two folds and two labels, one of them constant; the last two rows are one row given twice."""
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, N_ROWS)
    x = np.round(rng.normal(size=(N_ROWS, 4)) + y[:, None] * [1.5, 0.0, -1.0, 0.0], 3)
    x[-1], y[-1] = x[-2], y[-2]
    ids = [f"r{min(i, N_ROWS - 2)}" for i in range(N_ROWS)]
    part = np.array([["test" if min(i, N_ROWS - 2) % FOLDS == f else "train" for i in range(N_ROWS)] for f in range(FOLDS)])
    long = [(f, str(part[f, i]), label, int(y[i]) if label == "a" else 1, ids[i], [float(v) for v in x[i]], i)
            for f in range(FOLDS) for label in ("a", "one") for i in range(N_ROWS)]
    df = spark.createDataFrame(long, "fold int, part string, label string, y int, row_id string, x array<double>, i int")
    return x, y, ids, part == "train", df


def _panel(df, spec, monkeypatch, **more):
    """Scores by (fold, label, row), from no fit per group."""
    def none(*a, **k):
        raise AssertionError("a fit of one group alone")

    monkeypatch.setattr(M, "fit_score", none)
    got = M.fit_panel(df, [spec], ["a", "one"], list(range(FOLDS)), **more)
    assert got.columns == [*df.columns, "p", "scaler", "model"]
    rows = got.collect()
    assert len(rows) == FOLDS * 2 * N_ROWS and {(r["scaler"], r["model"]) for r in rows} == {(spec.scaler, spec.name)}
    out = {(r["fold"], r["label"], r["i"]): r["p"] for r in rows}
    assert len(out) == len(rows) and all(p == 1.0 for (_, label, _), p in out.items() if label == "one")
    return out


def test_gradient_of_a_network():
    rng = np.random.default_rng(0)
    x, y, sizes = rng.normal(size=(11, 4)), rng.integers(0, 2, 11), N.shapes(4, (3, 2))
    w = rng.normal(size=sum(a * b for a, b in sizes))
    at = N.value_and_gradient(x, y, N.layers(w, sizes))
    p = N.positive(x, N.layers(w, sizes))
    assert abs(at[-1] + np.log(np.where(y == 1, p, 1 - p)).sum()) < 1e-9
    for k in range(len(w)):
        up, down = (N.value_and_gradient(x, y, N.layers(w + s * 1e-6 * (np.arange(len(w)) == k), sizes))[-1] for s in (1, -1))
        assert abs((up - down) / 2e-6 - at[k]) < 1e-5


@pytest.mark.parametrize("few", [False, True])
def test_networks_share_passes(spark, monkeypatch, few):
    x, y, _, train, df = _rows(spark)
    if few:
        monkeypatch.setattr(N, "PASS_BYTES", 0)
    got = _panel(df.repartition(3), MLP, monkeypatch)
    sizes = N.shapes(4, (3,))
    for fold in range(FOLDS):
        state = N.NetworkDescent(N.start(sizes, 42), 12)
        xs, ys = x[train[fold]], y[train[fold]]
        while not state.done:
            at = N.value_and_gradient(xs, ys, N.layers(state.point, sizes)) / len(xs)
            state.tell(at[-1], at[:-1])
        want = N.positive(x, N.layers(state.best, sizes))
        assert max(abs(got[fold, "a", i] - want[i]) for i in range(N_ROWS)) < 1e-6
    design = df.withColumn("design", F.concat_ws("\x01", "fold", "label"))
    more = design.unionByName(design.withColumn("design", F.concat("design", F.lit("again"))))
    passes = [N.fit_networks(N.train_blocks(d), [MLP])[1] for d in (design, more)]
    assert passes[0] == passes[1] > 10


def test_a_network_is_no_worse_than_mllibs(spark):
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    x, y, _, train, df = _rows(spark)
    rows = df.filter("fold = 0 and label = 'a'")
    design = rows.withColumn("design", F.lit("d"))
    spec = M.ModelSpec("mlp", {"hidden": (3,), "max_iter": 300})
    p = np.array([r["p"] for r in N.scorer(design, [spec])(rows.withColumn("design", F.lit("d")), spec).orderBy("i").collect()])
    theirs = MultilayerPerceptronClassifier(layers=[4, 3, 2], maxIter=300, seed=42).fit(
        M._with_features(rows.filter("part = 'train'")).withColumn("label", F.col("y").cast("double")))
    q = np.array([r["p"] for r in theirs.transform(M._with_features(rows).drop("label")).select("i", M._p1().alias("p")).orderBy("i").collect()])
    mine, other = (-np.log(np.maximum(np.where(y == 1, v, 1 - v), 1e-12))[train[0]].mean() for v in (p, q))
    assert mine < other + 0.05


def test_groups_are_scaled_by_their_own_train_rows(spark, monkeypatch):
    """A scaler that shifts a group by its train mean; the model of shifted rows is found again."""
    _, _, _, _, df = _rows(spark)

    def shift(g, kind):
        mean = g.filter("part = 'train'").agg(F.avg(F.col("x")[0]).alias("_m"))
        return g.crossJoin(F.broadcast(mean)).withColumn("x", F.transform("x", lambda v: v - F.col("_m"))).drop("_m")  # one row

    got = _panel(df, MLP, monkeypatch, scaler_fn=shift)
    moved = df.withColumn("x", F.transform("x", lambda v: v + 5.0 * F.col("fold")))
    again = _panel(moved, MLP, monkeypatch, scaler_fn=shift)
    assert max(abs(got[k] - again[k]) for k in got) < 1e-6
