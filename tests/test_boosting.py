"""Boosted trees of all groups in shared passes, against plain ones."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from signalpanel.plans import boosting as G
from signalpanel.plans import forest as T
from signalpanel.plans import models as M

from .test_network import FOLDS, N_ROWS, _panel, _rows

GB = M.ModelSpec("gb", {"n_estimators": 7, "learning_rate": 0.3, "subsample": 0.8, "max_depth": 3, "min_samples_leaf": 2}, "none", "boost")


def _plain_boost(bins, y, h, b, seed):
    """Boosted trees one by one, rows by rows."""
    sign, f, out = 2.0 * y - 1, np.zeros(len(y)), []

    def grow(at, r, depth):
        node, best = {"value": r[at].mean()}, (1e-9, None)
        if depth < b.depth:
            base = ((r[at] - r[at].mean()) ** 2).sum()
            for j in range(bins.shape[1]):
                for cut in range(T.BINS):
                    left, right = at[bins[at, j] <= cut], at[bins[at, j] > cut]
                    if min(len(left), len(right)) >= b.leaf:
                        gain = base - sum(((r[s] - r[s].mean()) ** 2).sum() for s in (left, right))
                        if gain > best[0] * (1 + 1e-9):
                            best = (gain, (j, cut, left, right))
        if best[1]:
            j, cut, left, right = best[1]
            node |= {"cut": (j, cut), "sides": (grow(left, r, depth + 1), grow(right, r, depth + 1))}
        return node

    def walk(node, row):
        while "cut" in node:
            node = node["sides"][int(row[node["cut"][0]] > node["cut"][1])]
        return node["value"]

    for t in range(b.trees):
        r = sign if t == 0 else 4 * sign / (1 + np.exp(2 * sign * f))
        tree = grow(np.flatnonzero(G.taken(h, seed, t, b.share)), r, 0)
        weight = b.rate if t else 1.0
        f = f + weight * np.array([walk(tree, row) for row in bins])
        out.append((weight, tree))
    return lambda row: 1 / (1 + np.exp(-2 * sum(w * walk(t, row) for w, t in out)))


@pytest.mark.parametrize("few", [False, True])
def test_equal_to_plain_boosting(spark, monkeypatch, few):
    x, y, ids, train, df = _rows(spark)
    monkeypatch.setattr(G, "REFRESH", 3)
    if few:
        monkeypatch.setattr(G, "PASS_BYTES", 0)
    got = _panel(df.repartition(3), GB, monkeypatch)
    h = np.array([xxhash.xxh64_intdigest(i) for i in ids], np.uint64)
    for fold in range(FOLDS):
        own = train[fold]
        cuts = [k / T.BINS for k in range(1, T.BINS)]
        q = spark.createDataFrame([tuple(map(float, r)) for r in x[own]], "a double, b double, c double, d double").agg(
            *[F.percentile_approx(c, cuts, 1000) for c in "abcd"]).first()
        bins = np.stack([np.searchsorted(np.unique(e), x[:, j], "left") for j, e in enumerate(q)], 1)
        score = _plain_boost(bins[own], y[own], h[own], G.Boost.of(GB), 42)
        assert max(abs(got[fold, "a", i] - score(bins[i])) for i in range(N_ROWS)) < 1e-6


def test_no_parameter_is_dropped():
    for p in ({"max_depth": 30}, {"gamma": 1.0}):
        with pytest.raises(ValueError):
            G.Boost.of(M.ModelSpec("gb", p))
