"""Window, task and subject panels (L1): frames to per-configuration summary.

One flow serves all three: sample rows ``(subject_id, row_id, y, x)`` → folds
that keep subjects together → (balanced) train part → scaler → scorer → fold
metrics → subject votes → summary. All configurations stay in one relational
plan with ``scaler`` and ``model`` as columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import metrics as E
from ..operators import prep as P
from ..operators import split as C
from ..operators import summary as R
from ..session import ensure_checkpoint_dir
from . import models as M

# ---------------------------------------------------------------------------
# Folds, scalers and parameter grids of the three panels.
# ---------------------------------------------------------------------------
L1_FOLDS = 5
L1_SCALERS = ("standard", "minmax", "robust", "power")
WINDOW_GRIDS = {
    "xgb": {"n_estimators": [100, 200, 300], "max_depth": [6], "learning_rate": [0.05, 0.1], "subsample": [1.0],
            "colsample_bytree": [1.0], "gamma": [0, 1], "min_child_weight": [1, 5]},
    "lgbm": {"n_estimators": [100, 200, 300], "num_leaves": [31, 63], "learning_rate": [0.05, 0.1], "max_depth": [-1],
             "feature_fraction": [1.0], "bagging_fraction": [1.0], "min_child_samples": [10], "reg_lambda": [0.1, 1.0]},
    "random_forest": {"n_estimators": [100, 200, 300], "max_depth": [None], "min_samples_split": [2], "min_samples_leaf": [1],
                      "max_features": ["sqrt"]},
    "rbf_svm": {"C": [1, 10], "gamma": ["scale", 0.01]},
    "logreg": {"C": [1], "penalty": ["l2"], "max_iter": [1000]},
    "knn": {"n_neighbors": [5, 7], "weights": ["uniform"], "p": [2]},
    "mlp": {"hidden": [(128,), (64, 64)], "alpha": [0.01, 0.0001], "activation": ["relu"], "learning_rate": [0.001], "batch_size": [64]},
}
TASK_GRIDS = {
    "xgb": {"n_estimators": [100, 200], "max_depth": [6], "learning_rate": [0.05], "subsample": [1.0], "colsample_bytree": [1.0],
            "gamma": [0], "min_child_weight": [1]},
    "lgbm": {"n_estimators": [100, 200], "num_leaves": [31], "learning_rate": [0.05], "max_depth": [-1], "feature_fraction": [1.0],
             "bagging_fraction": [1.0], "min_child_samples": [10], "reg_lambda": [0.1]},
    "random_forest": {"n_estimators": [100], "max_depth": [None], "min_samples_split": [2], "min_samples_leaf": [1], "max_features": ["sqrt"]},
    "rbf_svm": {"C": [1], "gamma": ["scale"]},
    "logreg": {"C": [1], "penalty": ["l2"], "max_iter": [1000]},
    "knn": {"n_neighbors": [5], "weights": ["uniform"], "p": [2]},
    "mlp": {"hidden": [(128,), (64, 64)], "alpha": [0.0001], "activation": ["relu"], "learning_rate": [0.001], "batch_size": [64]},
}
SUBJECT_GRIDS = {
    "xgb": {"n_estimators": [100, 200, 300], "max_depth": [3, 6, 9], "learning_rate": [0.01, 0.05, 0.1], "subsample": [0.8, 1.0],
            "colsample_bytree": [0.8, 1.0], "gamma": [0, 1, 5], "min_child_weight": [1, 5, 10]},
    "lgbm": {"n_estimators": [100, 200, 300], "num_leaves": [15, 31, 63], "learning_rate": [0.01, 0.05, 0.1], "max_depth": [-1, 6, 12],
             "feature_fraction": [0.8, 1.0], "bagging_fraction": [0.8, 1.0], "min_child_samples": [10, 20], "reg_lambda": [0.0, 0.1, 1.0]},
    "random_forest": {"n_estimators": [100, 200, 300], "max_depth": [None, 10, 20], "min_samples_split": [2, 5], "min_samples_leaf": [1, 2],
                      "max_features": ["sqrt", "log2"]},
    "rbf_svm": {"C": [0.1, 1, 10], "gamma": ["scale", 0.01, 0.001]},
    "logreg": {"C": [0.1, 1, 10], "penalty": ["l2"], "max_iter": [500, 1000]},
    "knn": {"n_neighbors": [3, 5, 7, 11], "weights": ["uniform", "distance"], "p": [1, 2]},
    "mlp": {"hidden": [(64,), (128,), (64, 64), (128, 64)], "alpha": [0.0001, 0.001, 0.01], "activation": ["relu", "tanh"],
            "learning_rate": [0.001, 0.01], "batch_size": [32, 64]},
}
# ---------------------------------------------------------------------------

METRICS = ["f1", "f1_neg", "accuracy", "auc"]


def l1_specs(grids: dict, families: Sequence[str] | None = None) -> list[M.ModelSpec]:
    """Every variant of every family, named ``{family}_{i}``."""
    return [M.ModelSpec(fam, params, name=name) for fam, grid in grids.items() if families is None or fam in families
            for name, params in M.expand_grid(fam, grid)]


def l1_split(rows: DataFrame, n_folds: int = L1_FOLDS, balance: bool = False, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """``(split rows, fold sizes)``. Folds whose train or test
    part holds one class are skipped (their sizes still count); ``balance``
    draws the majority of the train part down to the minority."""
    ensure_checkpoint_dir(rows.sparkSession)
    rows = rows.checkpoint()  # features are computed once; everything below reads this table
    sp = C.all_splits(rows, C.grouped_folds(rows, n_folds, seed), n_folds)
    train = F.col("part") == "train"
    f = sp.groupBy("fold").agg(
        F.count_if(train).alias("n_train"), F.count_if(~train).alias("n_test"),
        ((F.countDistinct(F.when(train, F.col("y"))) == 2) & (F.countDistinct(F.when(~train, F.col("y"))) == 2)).alias("valid"))
    sp = sp.join(f.filter("valid").select("fold"), on="fold")
    if balance:
        sp = C.downsample(sp.filter(train), seed=seed, by=["fold"]).unionByName(sp.filter(~train))
    return sp.checkpoint(), f.select("fold", "n_train", "n_test").checkpoint()


def l1_scores(split: DataFrame, specs: Sequence[M.ModelSpec], scalers: Sequence[str] = L1_SCALERS, seed: int = 42) -> DataFrame:
    """Test scores ``(scaler, model, fold, subject_id,
    row_id, y, p)``. Nearest neighbours score all scalers and folds in one job,
    and the variants of one distance share the search of the largest k;
    other families are fitted per (scaler, fold) through the panel runner."""
    train = split.filter(F.col("part") == "train")
    parts = []
    for kind in scalers:
        params = P.fit_scaler(train, kind, by=["fold"])
        scaled = P.apply_scaler(split, params, kind, by=["fold"]).withColumn("x", P.nan_to_num(F.col("x")))
        parts.append(scaled.withColumn("scaler", F.lit(kind)))
    rows = reduce(DataFrame.unionByName, parts).checkpoint()  # one copy per scaler, read by every family
    keep = ["scaler", "model", "fold", "subject_id", "row_id", "y", "p"]
    out = []
    most: dict[float, int] = {}
    for spec in specs:
        if spec.family == "knn":
            most[spec.params["p"]] = max(most.get(spec.params["p"], 0), spec.params["n_neighbors"])
    by, test = ["scaler", "fold"], rows.filter("part = 'test'")
    top = {p: M.knn_neighbors(rows.filter("part = 'train'"), test, k, p, by=by).checkpoint() for p, k in most.items()}
    for spec in specs:
        if spec.family == "knn":
            s = M.knn_vote(test, top[spec.params["p"]], spec.params["n_neighbors"], spec.params["weights"], by=by)
            out.append(s.withColumn("model", F.lit(spec.name)).select(*keep))
        else:
            folds = [r["fold"] for r in split.select("fold").distinct().collect()]  # at most the number of folds
            for kind in scalers:
                long = rows.filter(F.col("scaler") == kind).drop("scaler").withColumn("label", F.lit(""))
                s = M.fit_panel(long, [M.ModelSpec(spec.family, spec.params, kind, spec.name)], [""], folds, seed)
                out.append(s.filter("part = 'test'").select(*keep))
    return reduce(DataFrame.unionByName, out)


def l1_summary(scores: DataFrame, sizes: DataFrame) -> DataFrame:
    """E2–E6 per fold, A7–A8 votes over all folds, R1 per configuration: means
    and population deviations, vote rates, fold sizes and subject total."""
    preds = scores.withColumn("pred", (F.col("p") > 0.5).cast("int")).withColumn("label", F.lit("")).checkpoint()
    fold = E.label_metrics(preds, by=["scaler", "model", "fold"])
    out = R.fold_summary(fold, METRICS, std="pop")
    votes = A.majority_vote(preds, by=["scaler", "model"])
    right = votes.groupBy("scaler", "model").agg(
        F.stddev_pop((F.col("vote") == F.col("y")).cast("double")).alias("vote_accuracy_std"), F.count(F.lit(1)).alias("n_subjects"))
    out = out.join(A.vote_metrics(votes, by=["scaler", "model"]), on=["scaler", "model"]).join(right, on=["scaler", "model"])
    n = sizes.agg(*[g(c).alias(f"{c}_{name}") for c in ("n_train", "n_test")
                    for name, g in (("mean", F.avg), ("std", F.stddev_pop))])
    return out.crossJoin(F.broadcast(n))  # one row


def l1_panel(rows: DataFrame, grids: dict, families: Sequence[str] | None = None, scalers: Sequence[str] = L1_SCALERS,
             balance: bool = False, seed: int = 42) -> DataFrame:
    """The whole panel over sample rows."""
    split, sizes = l1_split(rows, balance=balance, seed=seed)
    return l1_summary(l1_scores(split, l1_specs(grids, families), scalers, seed), sizes)
