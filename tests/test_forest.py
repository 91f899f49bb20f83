"""Forests grown over blocks against trees grown row by row with the same hashes."""

import os

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from signalpanel.plans import blocks as B
from signalpanel.plans import forest as T
from signalpanel.plans.models import ModelSpec

SPECS = [ModelSpec("random_forest", {"n_estimators": 7, "max_depth": 4, "min_samples_leaf": 2}, "none", "rf"),
         ModelSpec("extra_trees", {"n_estimators": 5, "max_depth": 3, "max_features": "all"}, "none", "et")]
BINS = 8


def _rows(spark, n=80):
    r = np.random.default_rng(9)
    x = np.round(r.normal(size=(n, 5)), 2)
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    rows = [(f, "test" if i % 2 == f else "train", lab, int(y[i] if lab == "a" else i % 3 == 0 or 1), f"r{i}", x[i].tolist())
            for f in range(2) for i in range(n) for lab in ("a", "one")]
    return x, y, spark.createDataFrame(rows, "fold int, part string, label string, y int, row_id string, x array<double>")


def _plain_tree(f, t, bins, y, times, d, seed):
    """One tree by recursion over row sets; returns a scoring function."""
    n = np.array([times[y == c].sum() for c in range(2)], float)
    weight = n.sum() / (2 * n)

    def gini(w):
        return 2 * w[0] * w[1] / w.sum() if w.sum() else 0.0

    def grow(rows, node, depth):
        w = np.array([times[rows][y[rows] == c].sum() for c in range(2)]) * weight
        leaf = lambda b: w[1] / w.sum()
        if depth == f.depth or min(w) == 0:
            return leaf
        best = (0.0, None)
        h = [int(T.mix(seed + 1, t, node, j)) for j in range(d)]
        for j in sorted(sorted(range(d), key=lambda j: (h[j], j))[:f.taken(d)]):
            lo, hi = bins[rows, j].min(), bins[rows, j].max()
            tried = [int(lo + np.floor(float(T.uniform(T.mix(seed + 2, t, node, j))) * (hi - lo)))] if f.random_cuts else range(BINS)
            for cut in tried:
                left, right = rows[bins[rows, j] <= cut], rows[bins[rows, j] > cut]
                if min(len(left), len(right)) < max(f.leaf, 1) or len(rows) < f.split:
                    continue
                sides = [np.array([times[s][y[s] == c].sum() for c in range(2)]) * weight for s in (left, right)]
                gain = round((gini(w) - gini(sides[0]) - gini(sides[1])) / w.sum(), 12)
                if gain > best[0]:
                    best = (gain, (j, cut, left, right))
        if best[1] is None:
            return leaf
        j, cut, left, right = best[1]
        a, b = grow(left, 2 * node, depth + 1), grow(right, 2 * node + 1, depth + 1)
        return lambda row: a(row) if row[j] <= cut else b(row)

    return grow(np.flatnonzero(times > 0), 1, 0)


@pytest.mark.parametrize("small_passes", [False, True])
def test_equal_to_plain_trees(spark, monkeypatch, small_passes):
    if small_passes:
        monkeypatch.setattr(T, "PASS_BYTES", 1 << 12)
        monkeypatch.setattr(B, "DIRECT", 0)
    x, y, df = _rows(spark)
    scores, panel = T.forest_panel(df.repartition(3), SPECS, ["a", "one"], bins=BINS)
    got = {(r["model"], r["fold"], r["label"], r["row_id"]): r["p"] for r in scores.collect()}
    assert len(got) == 2 * 2 * 2 * 80
    h = np.array([xxhash.xxh64_intdigest(f"r{i}") for i in range(80)], np.uint64)
    cuts = [k / BINS for k in range(1, BINS)]
    for fold in range(2):
        train = np.array([i for i in range(80) if i % 2 != fold])
        edges = []
        for j in range(5):
            q = spark.createDataFrame([(float(v),) for v in x[train, j]], "v double").agg(F.percentile_approx("v", cuts, 1000)).first()[0]
            edges.append(np.unique(q))
        bins = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
        for spec in SPECS:
            f = T.Forest.of(spec)
            trees = [_plain_tree(f, t, bins[train], y[train], T.draws(h[train], 42, t) if not f.random_cuts else np.ones(len(train), int), 5, 42)
                     for t in range(f.trees)]
            for i in range(80):
                assert abs(got[spec.name, fold, "a", f"r{i}"] - np.mean([t(bins[i]) for t in trees])) < 1e-6
                assert got[spec.name, fold, "one", f"r{i}"] == 1.0
    assert panel.passes >= 4 and (not small_passes or panel.passes > 10)


def test_draws():
    h = T.mix(np.arange(20000))
    n = T.draws(h, 1, 2)
    assert abs(n.mean() - 1) < 0.03 and abs((n == 0).mean() - np.exp(-1)) < 0.02
    f = T.drawn_features(3, 1, np.array([1, 2, 3]), 30, 5)
    assert f.shape == (3, 5) and (np.diff(f, axis=1) > 0).all() and len({tuple(r) for r in f.tolist()}) > 1


def test_parameters_act_or_raise():
    for p in ({"max_depth": None}, {"criterion": "entropy"}, {"max_depth": 40}):
        with pytest.raises(ValueError):
            T.Forest.of(ModelSpec("random_forest", p))


def test_cuts_are_made_in_spark(spark, monkeypatch):
    """With few blocks too the sums meet and the cuts are made in tasks, and all cores get a share of the trees."""
    driver, plain = os.getpid(), T.best_cuts

    def cuts(*a):
        assert os.getpid() != driver, "cut made by the driver"
        return plain(*a)

    monkeypatch.setattr(T, "best_cuts", cuts)
    _, _, df = _rows(spark)
    _, panel = T.forest_panel(df.coalesce(1), SPECS, ["a", "one"], bins=BINS)
    assert any((t.feature >= 0).any() for trees in panel.trees.values() for t in trees)
    blocks = spark.createDataFrame([("d", 1)], "design string, n long")
    out = T._shared_out(blocks).collect()
    assert sorted(r["share"] for r in out) == list(range(spark.sparkContext.defaultParallelism)) and {r["shares"] for r in out} == {len(out)}


def test_rows_that_share_an_id(spark):
    """Rows of one id: others, and one given twice. Each takes part and has a score."""
    _, _, df = _rows(spark)
    other = df.filter("row_id in ('r3', 'r4')").withColumn("x", F.transform("x", lambda v: v + 1.0))
    many = df.unionByName(other).unionByName(df.filter("row_id = 'r5'"))
    scores, panel = T.forest_panel(many, SPECS[1:], ["a", "one"], bins=BINS)
    scored = B.with_scores(many, scores)
    assert scored.count() == many.count() and scored.filter("p is null").count() == 0
    keep = ["fold", "part", "label", "y", "row_id"]
    assert sorted(scored.select(*keep).collect()) == sorted(many.select(*keep).collect())
    assert scores.groupBy("fold", "label", "row_id", "x_hash").count().filter("count > 1").count() == 0
    copies = {(r["fold"], r["label"], r["row_id"], r["copy"]) for r in B.wide_rows(many, ["a", "one"]).withColumn("label", F.lit("a")).collect()}
    assert (0, "a", "r5", 2) in copies and (0, "a", "r3", 2) not in copies
    assert B.wide_rows(many, ["a", "one"]).count() == many.filter("label = 'a'").count()
