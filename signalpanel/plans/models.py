"""Scorers (M1–M16): per-label binary models on Spark ML.

Rows: ``(*keys, part, label, y, x)`` with ``x`` an ``array<double>``.
``fit_score`` fits one model on the ``train`` rows of one (fold, label)
group and scores every row of the group (fit once, transform train and test
together). Every fit is a distributed MLlib job; the panel loops over
configurations on the driver with a small thread pool (as
``CrossValidator(parallelism=…)`` does).
"""

from __future__ import annotations

import itertools
import math
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import (GBTClassifier, LinearSVC,
                                       LogisticRegression, MultilayerPerceptronClassifier,
                                       RandomForestClassifier)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import split as C
from ..session import ensure_checkpoint_dir
from . import neighbors
from .blocks import block_sums

KNN_BLOCK_ROWS = 50_000               # rows per block on the blocked path
RFF_DIM = 256
#: Families whose estimators take class weights (the linear SVMs weight in calibrated_svc).
WEIGHTED_FAMILIES = ("logreg", "sgd_log", "random_forest", "extra_trees", "hist_gb", "lgbm")


@dataclass(frozen=True)
class ModelSpec:
    """One candidate: family + parameters (+ the scaler it is paired with)."""
    family: str
    params: dict = field(default_factory=dict)
    scaler: str = "none"
    name: str = ""

    @property
    def key(self) -> str:
        return f"{self.scaler}__{self.name or self.family}"


def expand_grid(family: str, grid: dict) -> list[tuple[str, dict]]:
    """Parameter-grid expansion (keys sorted, last key varies
    fastest), variants named ``{family}_{i}``."""
    keys = sorted(grid)
    vals = [grid[k] if isinstance(grid[k], (list, tuple)) else [grid[k]] for k in keys]
    return [(f"{family}_{i}", dict(zip(keys, combo))) for i, combo in enumerate(itertools.product(*vals))]


def margin_to_prob(margin: Column) -> Column:
    """Logistic map of a decision margin."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def _p1(prob_col: str = "probability") -> Column:
    return vector_to_array(F.col(prob_col))[1]


def _margin(raw_col: str = "rawPrediction") -> Column:
    return vector_to_array(F.col(raw_col))[1]


TARGET_PARTITION_BYTES = 64 << 20


def right_size(df: DataFrame, n_rows: int, width: int) -> DataFrame:
    """Coalesce an iterative fit's input to ≈64 MB partitions (estimated
    from rows × width). Iterative trainers run one job per iteration, so
    near-empty partitions cost scheduling time; coalesce never adds
    partitions, so large inputs keep their parallelism."""
    target = max(1, -(-(int(n_rows) * max(int(width), 1) * 8) // TARGET_PARTITION_BYTES))
    return df.coalesce(target) if df.rdd.getNumPartitions() > target else df


def _with_features(df: DataFrame, col: str = "x") -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(col)))


def _weights(train: DataFrame, y: str = "y") -> DataFrame:
    """C7 as a column: balanced class weights n / (2·n_c)."""
    w = C.class_weights(train, by=(), y=y)
    return train.join(F.broadcast(w), on=y)   # two rows


# ----------------------------------------------------------------- families
def _estimator(spec: ModelSpec, n_train: int, seed: int, weighted: bool):
    p = spec.params
    wc = {"weightCol": "weight"} if weighted else {}
    fam = spec.family
    if fam == "logreg":                                               # M1
        C_ = float(p.get("C", 1.0))
        return LogisticRegression(regParam=1.0 / (C_ * max(n_train, 1)), elasticNetParam=0.0,
                                  standardization=False, maxIter=int(p.get("max_iter", 200)), **wc)
    if fam == "sgd_log":                                              # M2
        return LogisticRegression(regParam=float(p.get("alpha", 1e-4)), elasticNetParam=0.0,
                                  standardization=False, maxIter=int(p.get("max_iter", 200)), **wc)
    if fam in ("random_forest", "extra_trees"):                       # M5, M6
        return RandomForestClassifier(numTrees=int(p.get("n_estimators", 100)),
                                      maxDepth=min(int(p.get("max_depth", 10) or 30), 30),
                                      minInstancesPerNode=max(int(p.get("min_samples_leaf", 1)), int(p.get("min_samples_split", 2)) // 2),
                                      featureSubsetStrategy=str(p.get("max_features", "sqrt")),
                                      bootstrap=fam == "random_forest", seed=seed, **wc)
    if fam == "mlp":                                                  # M8
        return None  # built in fit (needs the input width)
    if fam in ("gb", "hist_gb", "xgb", "lgbm", "catboost"):           # M10
        depth = int(p.get("max_depth") or -1)
        if depth < 0:  # no depth limit: as deep as the number of leaves needs
            depth = math.ceil(math.log2(int(p.get("num_leaves", 31))))
        share = float(p.get("colsample_bytree", p.get("feature_fraction", 1.0)))
        leaf = p.get("min_samples_leaf", p.get("min_child_samples", p.get("min_child_weight", 1)))
        return GBTClassifier(maxIter=int(p.get("n_estimators", p.get("max_iter", 100))),
                             stepSize=float(p.get("learning_rate", 0.1)), maxDepth=depth,
                             subsamplingRate=float(p.get("subsample", p.get("bagging_fraction", 1.0))),
                             featureSubsetStrategy="all" if share >= 1 else str(share),
                             minInstancesPerNode=int(leaf), minInfoGain=float(p.get("gamma", 0.0)) / max(n_train, 1),
                             seed=seed, **wc)
    raise ValueError(f"unknown model family {fam!r}")


def constant_scores(rows: DataFrame, by: Sequence[str] = (), y: str = "y") -> DataFrame:
    """Per group the score that stands in for a model: mean(y) where
    the train rows hold one class (0 without rows), NULL where a model is fitted."""
    train = F.col("part") == "train"
    out = rows.groupBy(*by).agg(F.countDistinct(F.when(train, F.col(y))).alias("n_classes"),
                                F.avg(F.when(train, F.col(y).cast("double"))).alias("_m"))
    return out.withColumn("constant", F.when(F.col("n_classes") < 2, F.coalesce("_m", F.lit(0.0)))).drop("_m")


Scorer = Callable[[DataFrame], DataFrame]


def fit_scorer(rows: DataFrame, spec: ModelSpec, seed: int = 42, y: str = "y", row_id: str = "row_id",
               col: str = "x", extra_train: DataFrame | None = None) -> Scorer:
    """Fit ``spec`` on the train rows (and ``extra_train``, e.g. synthetic
    rows, which are never scored). The scorer adds column ``p`` to any rows
    with the same features. Single-class training data → constant score (M14)."""
    constant = constant_scores(rows, (), y).first()
    if constant is None or constant["constant"] is not None:
        mean = float(constant["constant"]) if constant else 0.0
        return lambda df: df.withColumn("p", F.lit(mean))
    train = rows.filter(F.col("part") == "train")
    if extra_train is not None:
        train = train.unionByName(extra_train.select(*train.columns))
    st = train.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(col)).alias("d")).first()
    train = right_size(train, st["n"], st["d"] or 1)
    fam, p = spec.family, spec.params
    if fam == "knn":
        return lambda df: knn_score(train, df, k=int(p.get("n_neighbors", 5)), p=float(p.get("p", 2)),
                                    weights=str(p.get("weights", "uniform")), row_id=row_id, col=col, y=y)
    if fam == "linear_svc":
        return calibrated_svc(train, float(p.get("C", 1.0)), seed, y=y, row_id=row_id, col=col, max_iter=int(p.get("max_iter", 100)))
    if fam == "rbf_svm":
        rff = RandomFourier(p.get("gamma", "scale"), seed=seed, dim=int(p.get("dim", RFF_DIM))).fit(train, col)
        svc = calibrated_svc(rff.transform(train, col), float(p.get("C", 1.0)), seed, y=y, row_id=row_id, col=col,
                             max_iter=int(p.get("max_iter", 100)))
        return lambda df: svc(rff.transform(df.withColumn("_raw", F.col(col)), col)).withColumn(col, F.col("_raw")).drop("_raw")
    if fam == "adaboost":
        return adaboost(train, n_rounds=int(p.get("n_estimators", 50)), lr=float(p.get("learning_rate", 0.5)), y=y, col=col)
    weighted = fam in WEIGHTED_FAMILIES and p.get("class_weight", "balanced") == "balanced"
    tr = _with_features(_weights(train, y) if weighted else train, col).withColumn("label_", F.col(y).cast("double"))
    if fam == "mlp":
        hidden = list(p.get("hidden", (64,)))
        est = MultilayerPerceptronClassifier(layers=[st["d"], *hidden, 2], maxIter=int(p.get("max_iter", 500)),
                                             stepSize=float(p.get("learning_rate", 0.03)), seed=seed)
    else:
        est = _estimator(spec, int(st["n"]), seed, weighted)
    model = est.setLabelCol("label_").setFeaturesCol("features").fit(tr)
    return lambda df: model.transform(_with_features(df, col)).select(*df.columns, _p1().alias("p"))


def fit_score(rows: DataFrame, spec: ModelSpec, seed: int = 42, y: str = "y",
              row_id: str = "row_id", col: str = "x", extra_train: DataFrame | None = None) -> DataFrame:
    """Fit ``spec`` on the train rows and score all rows (column ``p``)."""
    return fit_scorer(rows, spec, seed, y, row_id, col, extra_train)(rows)


# ----------------------------------------------------- calibrated linear SVM
def calibrated_svc(train: DataFrame, C_: float = 1.0, seed: int = 42, max_cv: int = 3, y: str = "y",
                   row_id: str = "row_id", col: str = "x", max_iter: int = 100) -> Scorer:
    """M3 + M12: LinearSVC (balanced weights) with sigmoid calibration on
    out-of-fold margins; *safe*: when the minority class has fewer than two
    rows the raw margin goes through the logistic map (M13)."""
    counts = train.groupBy(y).count().collect()   # ≤ 2 rows
    m = min(int(r["count"]) for r in counts) if len(counts) == 2 else 0
    n = sum(int(r["count"]) for r in counts)

    def svc():
        return LinearSVC(regParam=1.0 / (C_ * max(n, 1)), weightCol="weight", labelCol="label_",
                         featuresCol="features", standardization=False, maxIter=max_iter, tol=1e-4)

    def prep(df):
        return _with_features(_weights(df, y), col).withColumn("label_", F.col(y).cast("double"))

    final = svc().fit(prep(train))

    def margins(df):
        return final.transform(_with_features(df, col)).select(*df.columns, _margin().alias("_m"))

    if m < 2:
        return lambda df: margins(df).select(*df.columns, margin_to_prob(F.col("_m")).alias("p"))
    cv = max(2, min(max_cv, m))
    tr = C.deal_folds(train, cv, f"{seed}:calib", strata=[y], subject=row_id).withColumnRenamed("fold", "_cf").persist()

    def oof_fold(i):
        mi = svc().fit(prep(tr.filter(F.col("_cf") != i).drop("_cf")))
        held = _with_features(tr.filter(F.col("_cf") == i), col)
        return mi.transform(held).select(_margin().alias("_m"), F.col(y).cast("double").alias("label_"))

    as_vector = array_to_vector(F.array("_m"))
    try:
        with ThreadPoolExecutor(max_workers=cv) as ex:   # independent fits: submit concurrently
            oof = reduce(DataFrame.unionByName, list(ex.map(oof_fold, range(cv))))
        cal = LogisticRegression(regParam=0.0, standardization=False, featuresCol="_mv", labelCol="label_") \
            .fit(oof.withColumn("_mv", as_vector))
    finally:
        tr.unpersist()
    return lambda df: cal.transform(margins(df).withColumn("_mv", as_vector)).select(*df.columns, _p1().alias("p"))


# ---------------------------------------------- random Fourier features (M4)
class RandomFourier:
    """RBF kernel approximation: z(x) = √(2/D)·cos(xW + b), W ~ N(0, 2γ),
    b ~ U(0, 2π), seeded. γ = "scale" → 1 / (d · var(train values)),
    computed by one aggregate. Applied by an Arrow-batched pandas UDF."""

    def __init__(self, gamma="scale", seed: int = 42, dim: int = RFF_DIM):
        self.gamma, self.seed, self.dim = gamma, seed, dim
        self.W = self.b = None

    def fit(self, train: DataFrame, col: str = "x") -> RandomFourier:
        d = len(train.select(col).first()[0])
        if self.gamma == "scale":
            v = train.select(F.explode(col).alias("v")).agg(F.var_pop("v")).first()[0] or 1.0
            g = 1.0 / (d * v) if v > 0 else 1.0
        else:
            g = float(self.gamma)
        rng = np.random.default_rng(self.seed)
        self.W = rng.normal(0.0, math.sqrt(2.0 * g), size=(d, self.dim))
        self.b = rng.uniform(0.0, 2.0 * math.pi, size=self.dim)
        return self

    def transform(self, df: DataFrame, col: str = "x") -> DataFrame:
        W, b, D = self.W, self.b, self.dim
        scale = math.sqrt(2.0 / D)

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def rff(xs: pd.Series) -> pd.Series:
            X = np.vstack(xs.to_numpy()) if len(xs) else np.zeros((0, W.shape[0]))
            Z = scale * np.cos(X @ W + b)
            return pd.Series(list(Z))

        return df.withColumn(col, rff(F.col(col)))


# ----------------------------------------------------------- AdaBoost (M9)
STUMP_BINS = 32


def _blocks(train: DataFrame, col: str, y: str, edges: np.ndarray) -> DataFrame:
    """Train rows as blocks of binned features: ``(n, bins, y)``, one row per
    Arrow batch, so a round reads bytes and no feature arrays."""
    def run(batches):
        for b in batches:
            if b.num_rows:
                x = np.vstack([np.asarray(v, float) for v in b.column("x").to_pylist()])
                bins = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1).astype(np.uint8)
                yy = np.asarray(b.column("y").to_pylist(), np.int8)
                yield pa.RecordBatch.from_arrays([pa.array([len(x)]), pa.array([bins.tobytes()], pa.binary()),
                                                  pa.array([yy.tobytes()], pa.binary())], names=["n", "bins", "y"])

    return train.select(F.col(col).alias("x"), F.col(y).cast("int").alias("y")).mapInArrow(run, "n long, bins binary, y binary")


def _stump_sums(d: int, stumps: list[tuple]):
    """Weighted counts of a block per feature, bin and class under the stumps so far."""
    def work(row: dict) -> dict[str, np.ndarray]:
        n = row["n"]
        bins, y = np.frombuffer(row["bins"], np.uint8).reshape(n, d), np.frombuffer(row["y"], np.int8)
        log_w = np.zeros(n)
        for j, cut, left, right, alpha in stumps:
            log_w += alpha * (np.where(bins[:, j] <= cut, left, right) != y)
        w = np.exp(log_w)
        return {"sums": np.stack([np.bincount(bins[:, j] * 2 + y, w, STUMP_BINS * 2) for j in range(d)])}
    return work


def _best_stump(sums: np.ndarray) -> tuple[float, tuple[int, int, int, int]]:
    """(error, (feature, last bin of the left side, left and right class)) of
    the split with the least weighted Gini impurity."""
    all_ = sums[0].sum(0)
    left = sums.cumsum(1)[:, :-1]
    right = all_ - left
    side = [x.sum(-1) for x in (left, right)]
    gini = sum(2 * x[..., 0] * x[..., 1] / np.maximum(n, 1e-300) for x, n in zip((left, right), side))
    gini = np.where((side[0] > 0) & (side[1] > 0), gini, np.inf)
    j, cut = np.unravel_index(int(np.argmin(np.round(gini / all_.sum(), 12))), gini.shape)
    lo, hi = left[j, cut], right[j, cut]
    miss = (lo.min() + hi.min()) / all_.sum()
    return float(miss), (int(j), int(cut), int(lo.argmax()), int(hi.argmax()))


def adaboost(train: DataFrame, n_rounds: int = 50, lr: float = 0.5, y: str = "y", col: str = "x") -> Scorer:
    """SAMME with decision stumps on binned features. Rows are kept as binned
    blocks; a round is one pass over them that rebuilds the weights from the
    stumps so far (no state to lose with an executor); the weighted counts are
    added up in Spark. The score is the logistic of twice
    the normalised weighted vote."""
    d = train.select(F.max(F.size(col))).first()[0]
    cuts = [i / STUMP_BINS for i in range(1, STUMP_BINS)]
    q = train.select(F.posexplode(col).alias("j", "v")).groupBy("j").agg(
        F.percentile_approx("v", F.array(*[F.lit(c) for c in cuts]), 1000).alias("e")).orderBy("j").collect()  # d rows
    edges = np.array([r["e"] for r in q], float)
    ensure_checkpoint_dir(train.sparkSession)
    blocks = _blocks(train, col, y, edges).checkpoint()
    stumps: list[tuple] = []
    for _ in range(n_rounds):
        sums = block_sums(blocks, _stump_sums(d, list(stumps)))["sums"].reshape(d, STUMP_BINS, 2)
        miss, (j, cut, left, right) = _best_stump(sums)
        if miss >= 0.5:
            break
        alpha = lr * math.log((1.0 - max(miss, 1e-10)) / max(miss, 1e-10))
        stumps.append((j, cut, left, right, alpha))
        if miss <= 1e-10:
            break
    total = sum(s[4] for s in stumps) or 1.0
    vote = F.aggregate(
        F.array(*[F.struct(F.lit(j + 1).alias("j"), F.lit(float(edges[j][cut])).alias("t"), F.lit(2.0 * left - 1).alias("l"),
                           F.lit(2.0 * right - 1).alias("r"), F.lit(a).alias("a")) for j, cut, left, right, a in stumps])
        if stumps else F.expr("cast(array() as array<struct<j:int,t:double,l:double,r:double,a:double>>)"),
        F.lit(0.0), lambda acc, s: acc + s["a"] * F.when(F.element_at(F.col(col), s["j"]) <= s["t"], s["l"]).otherwise(s["r"]))
    return lambda df: df.withColumn("p", margin_to_prob(F.lit(2.0) * vote / F.lit(total)))


# ------------------------------------------------------------- exact kNN (M7)
def knn_score(train: DataFrame, rows: DataFrame, k: int = 5, p: float = 2, weights: str = "uniform",
              row_id: str = "row_id", col: str = "x", y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """Exact k-nearest-neighbour score = (weighted) mean label of the k
    nearest train rows (Minkowski p), ties by train ``row_id``. Train and
    scored rows are cut into blocks, every block pair computes its own
    top-k, and the candidates (k per block) are merged per row."""
    return _knn_blocked(train, rows, k, p, weights, row_id, col, y, by)


#: Doubles that one block of a distance matrix (or of its differences) may hold.
KNN_BLOCK_DOUBLES = 4_000_000
#: Numbers of a block of sums of absolute differences, which should stay in the cache.
KNN_CACHED = 1 << 18
#: Columns that each give one value to the bound of the k-th smallest.
_STRIP = 16
#: Candidates per neighbour from which on 32-bit products are too coarse for the rows at hand.
_COARSE = 32


def _distances(q: np.ndarray, t: np.ndarray, p: float) -> np.ndarray:
    """Direct Minkowski distances of row pairs."""
    diff = np.abs(q - t)
    if p == 2:
        return np.sqrt((diff * diff).sum(-1))
    return diff.sum(-1) if p == 1 else (diff ** p).sum(-1) ** (1.0 / p)


def _kth_bound(values: np.ndarray, k: int) -> np.ndarray:
    """Per row a value with at least k values at or below it: the k-th smallest
    minimum of strips of columns, or of the columns themselves if they are few."""
    strips = values.shape[1] // _STRIP
    if strips >= 4 * k:
        values = values[:, :strips * _STRIP].reshape(len(values), _STRIP, strips).min(1)
    return np.partition(values, k - 1, axis=1)[:, k - 1]


class _Approximate:
    """Quick distances of query rows to all train rows with a bound of their
    error: squared ones from matrix products (p = 2; less a term of the query
    row) or sums of absolute differences (p = 1), in 32 or 64 bits."""

    def __init__(self, Xt: np.ndarray, p: float):
        self.p, self.d = p, Xt.shape[1]
        self.centre = Xt.mean(0)  # centring keeps the products small; distances do not change
        self.raw = np.abs(Xt).max(initial=0.0)
        self.C = Xt - self.centre
        self.size = (self.C * self.C).sum(1) if p == 2 else np.abs(self.C).sum(1)
        self.most = self.size.max(initial=0.0)
        self.kinds: dict = {}

    def rough(self, q: np.ndarray) -> bool:
        """Whether 32 bits can hold all of it."""
        reach = max(self.most, self._size(q - self.centre).max(initial=0.0))
        return bool(1e-20 < self.most and reach < 1e30)

    def _size(self, c: np.ndarray) -> np.ndarray:
        return (c * c).sum(1) if self.p == 2 else np.abs(c).sum(1)

    def __call__(self, q: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray]:
        if kind not in self.kinds:
            self.kinds[kind] = np.ascontiguousarray(((-2.0 if self.p == 2 else 1.0) * self.C).T.astype(kind)), self.size.astype(kind)
        turned, size = self.kinds[kind]
        c = q - self.centre
        own, eps, raw = self._size(c), np.finfo(float).eps, np.abs(q).max(1, initial=0.0) + self.raw
        if self.p == 2:
            out = c.astype(kind) @ turned
            out += size
            room = raw * np.sqrt(own + self.most)
        else:
            c, out = c.astype(kind), np.zeros((len(q), turned.shape[1]), kind)
            diff = np.empty_like(out)
            for j in range(self.d):
                np.subtract(c[:, j, None], turned[j], out=diff)
                np.abs(diff, out=diff)
                out += diff
            room = raw
        # rounding of the sums, and of the centring (relative to the raw values)
        return out, 8 * self.d * (np.finfo(kind).eps * (own + self.most) + eps * room)


def _near_pairs(quick: _Approximate, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query row, train row) of all pairs that may be among the k nearest of a row, ties included."""
    for kind in (np.float32, np.float64) if quick.rough(q) else (np.float64,):
        approx, bound = quick(q, kind)
        limit = (_kth_bound(approx, k) + 2 * bound)[:, None]
        row, col = np.nonzero(~(approx > limit))  # a NaN is no distance above the limit
        if len(row) <= _COARSE * k * len(q):
            break
    return row, col


def _topk_np(Xq: np.ndarray, Xt: np.ndarray, yt: np.ndarray, idt: np.ndarray, k: int, p: float):
    """Top-k train rows per query row, exact, ordered by (distance, id).

    For p = 1 and 2 quick distances with a known error bound come first; every
    train row at or below a bound of the k-th quick value plus twice the error
    (all ties included) has its distance computed directly. Other p compute all
    distances directly. Query rows go through in chunks so that no matrix
    exceeds ``KNN_BLOCK_DOUBLES``."""
    n, d = Xt.shape
    kk = min(k, n)
    quick = _Approximate(Xt, p) if p in (1, 2) else None
    chunk = max(1, (KNN_BLOCK_DOUBLES if p == 2 else KNN_CACHED if p == 1 else KNN_BLOCK_DOUBLES // d) // n)
    outd, outy, outi = [], [], []
    for s0 in range(0, Xq.shape[0], chunk):
        q = Xq[s0:s0 + chunk]
        row, col = _near_pairs(quick, q, kk) if quick is not None else np.divmod(np.arange(len(q) * n), n)
        dist = np.concatenate([_distances(q[row[i:i + step]], Xt[col[i:i + step]], p)
                               for step in [max(1, KNN_BLOCK_DOUBLES // d)] for i in range(0, len(row), step)])
        ids = idt[col]
        order = np.lexsort((ids, dist, row))
        first = np.searchsorted(row[order], np.arange(len(q)))
        pick = order[first[:, None] + np.arange(kk)]
        outd.append(dist[pick])
        outy.append(yt[col[pick]])
        outi.append(ids[pick])
    return np.concatenate(outd), np.concatenate(outy), np.concatenate(outi)


def knn_neighbors(train: DataFrame, query: DataFrame, k: int, p: int = 2, row_id: str = "row_id",
                  col: str = "x", y: str | Sequence[str] | None = "y", exclude_self: bool = False,
                  block_rows: int = KNN_BLOCK_ROWS, by: Sequence[str] = ()) -> DataFrame:
    """Exact k nearest train rows of every query row within its ``by`` group:
    ``(_qid, _rid, _rank, _id, _d, _y)``, by the pruned search of
    ``neighbors``. Many groups run in one job. With several columns ``y``,
    ``_y`` is an array of them."""
    top = neighbors.nearest(train, query, k, p, _topk_np, row_id, col, y, exclude_self, block_rows, by)
    # _qid is the plain row id when there is no group
    return top if by else top.withColumn("_qid", F.col("_rid"))


def _knn_blocked(train, rows, k, p, weights, row_id, col, y, by=()):
    top = knn_neighbors(train, rows, k, p, row_id, col, y, by=by)
    return knn_vote(rows, top, k, weights, row_id, by)


def knn_vote(rows: DataFrame, top: DataFrame, k: int, weights: str = "uniform", row_id: str = "row_id", by: Sequence[str] = ()) -> DataFrame:
    """Scores of ``rows`` from the first ``k`` of their neighbours in ``top``,
    which may hold more: all variants of one distance share a search."""
    by = list(by)
    top = top.filter(F.col("_rank") <= k)
    if weights == "distance":
        agg = top.groupBy("_qid").agg(
            F.max((F.col("_d") == 0).cast("int")).alias("_z"),
            (F.sum(F.col("_y") / F.col("_d")) / F.sum(F.lit(1.0) / F.col("_d"))).alias("_pw"),
            F.avg(F.when(F.col("_d") == 0, F.col("_y"))).alias("_p0"))
        agg = agg.select("_qid", F.when(F.col("_z") == 1, F.col("_p0")).otherwise(F.col("_pw")).alias("p"))
    else:
        agg = top.groupBy("_qid").agg(F.avg("_y").alias("p"))
    return rows.withColumn("_qk", neighbors.row_key(by, row_id)).join(agg.withColumnRenamed("_qid", "_qk"), on="_qk", how="left").drop("_qk")


def knn_scores(train: DataFrame, rows: DataFrame, labels: Sequence[str], k: int = 5, p: float = 2,
               row_id: str = "row_id", col: str = "x", by: Sequence[str] = ()) -> DataFrame:
    """Uniform scores of several label columns from one search, for a row's
    neighbours do not depend on the label: ``rows`` in long form, ``(…, label, y, p)``."""
    by, labels = list(by), list(labels)
    top = knn_neighbors(train, rows, k, p, row_id, col, labels, by=by)
    agg = top.groupBy("_qid").agg(F.array(*[F.avg(F.col("_y")[i]) for i in range(len(labels))]).alias("_p"))
    scored = rows.withColumn("_qk", neighbors.row_key(by, row_id)).join(agg.withColumnRenamed("_qid", "_qk"), on="_qk", how="left")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).alias("y"), F.col("_p")[i].alias("p")) for i, c in enumerate(labels)]))
    return scored.drop("_qk").withColumn("_l", each).select(*[c for c in rows.columns if c not in labels], "_l.*")


# ------------------------------------------------------------- panel
def _scaled_groups(rows: DataFrame, labels: Sequence[str], folds: Sequence[int], kind: str, scaler_fn) -> DataFrame:
    """Stored rows of all (fold, label) groups, named by ``design``, each
    group scaled by its own train rows."""
    def stored(df: DataFrame) -> DataFrame:
        path = f"{ensure_checkpoint_dir(rows.sparkSession)}/rows-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return rows.sparkSession.read.schema(df.schema).parquet(path)

    named = stored(rows.filter(F.col("fold").isin(list(folds)) & F.col("label").isin(list(labels)))
                   .withColumn("design", F.concat_ws("\x01", F.col("fold").cast("string"), "label")))
    if scaler_fn is None or scaler_fn(named, kind) is named:
        return named
    return stored(reduce(DataFrame.unionByName, [scaler_fn(named.filter((F.col("fold") == f) & (F.col("label") == lab)), kind)
                                                 for f in folds for lab in labels]))


def fit_panel(rows: DataFrame, specs: Sequence[ModelSpec], labels: Sequence[str],
              folds: Sequence[int], seed: int = 42, parallelism: int = 4,
              scaler_fn=None) -> DataFrame:
    """Binary relevance over labels for every (spec, fold):
    ``rows`` are long ``(fold, part, label, y, x, row_id, …)``; each
    (spec, fold, label) is one pipeline (scale → fit → score). Networks and
    boosted trees of all folds and labels are fitted together in shared passes.
    The jobs of the others are submitted from a driver thread pool. Scores go to
    one long table ``(scaler, model, fold, part, …, label, y, p)`` in the shared
    folder, so the plan of the result is one scan however many models were fitted."""
    from . import boosting, network

    spark = rows.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/panel-{uuid.uuid4().hex}"
    together = {family: m.scorer for m in (network, boosting) for family in m.FAMILIES}
    tasks = [(s, f, lab) for s in specs if s.family not in together for f in folds for lab in labels]
    schemas = []
    for kind in sorted({s.scaler for s in specs if s.family in together}):
        own = [s for s in specs if s.family in together and s.scaler == kind]
        groups = _scaled_groups(rows, labels, folds, kind, scaler_fn)
        for family in sorted({s.family for s in own}):
            score = together[family](groups, [s for s in own if s.family == family], seed)
            for i, s in enumerate(own):
                if s.family == family:
                    sc = score(groups, s).drop("design").withColumns({"scaler": F.lit(s.scaler), "model": F.lit(s.name or s.family)})
                    sc.write.parquet(f"{path}/{kind}-{i}")
                    schemas.append(sc.schema)

    def run(t):
        i, (spec, f, lab) = t
        g = rows.filter((F.col("fold") == f) & (F.col("label") == lab))
        if scaler_fn is not None:
            g = scaler_fn(g, spec.scaler)
        g = g.persist()  # feeds several iterative fits
        try:
            sc = fit_score(g, spec, seed=seed).withColumns(
                {"scaler": F.lit(spec.scaler), "model": F.lit(spec.name or spec.family)})
            sc.write.parquet(f"{path}/{i}")
        finally:
            g.unpersist()
        return sc.schema

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as ex:
        schemas += ex.map(run, enumerate(tasks))
    return spark.read.schema(schemas[0]).option("recursiveFileLookup", "true").parquet(path)
