"""End-to-end panels: candidate list (M17), pipeline builder (M16), the
multi-label panel (L2) and nested per-label selection with refit (R10–R11).

Everything after scoring is one lazy relational plan over a long score
table ``(scaler, model, fold, part, subject_id, row_id, label, y, p)``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import importance as IMP
from ..operators import metrics as E
from ..operators import nested as NS
from ..operators import prep as P
from ..operators import split as C
from ..operators import summary as R
from ..operators import thresholds as TH
from ..session import ensure_checkpoint_dir
from . import models as M

# ---------------------------------------------------------------------------
# The candidate panel of the multi-label study.
# ---------------------------------------------------------------------------
SVM_GRID = [(0.3, "scale"), (1.0, "scale"), (3.0, "scale"), (10.0, "scale"),
            (1.0, 0.005), (3.0, 0.005), (1.0, 0.01), (3.0, 0.01), (3.0, 0.02), (10.0, 0.02),
            (1.0, 0.03), (3.0, 0.03), (3.0, 0.10), (1.0, 0.002), (3.0, 0.002), (10.0, 0.01),
            (10.0, 0.03), (10.0, 0.10)]
PANEL_SCALERS = ["standard", "minmax", "robust", "power"]
OTHER_MODELS = [
    ("logreg", {"C": 0.3, "penalty": "l2", "max_iter": 8000}, "minmax", "LogReg(p=l2,C=0.3)"),
    ("sgd_log", {"alpha": 1e-4, "penalty": "l2", "max_iter": 8000, "tol": 1e-4}, "standard", "SGDLog(p=l2,alpha=1e-4)"),
    ("linear_svc", {"C": 3.0}, "power", "LinearSVC+SafeCalib(C=3.0,cw=bal)"),
    ("knn", {"n_neighbors": 9, "weights": "uniform", "p": 2}, "minmax", "KNN(k=9,w=uniform,p=2)"),
    ("mlp", {"hidden": (64,), "alpha": 1e-3, "learning_rate": 3e-4, "max_iter": 4000, "n_iter_no_change": 20}, "standard",
     "MLP(h=(64,),a=0.001,lr0=0.0003,early_stop=0)"),
    ("random_forest", {"n_estimators": 600, "max_depth": 10, "min_samples_leaf": 2, "max_features": "sqrt"}, "none",
     "RF(n=600,depth=10,leaf=2,mf=sqrt)"),
    ("extra_trees", {"n_estimators": 800, "max_depth": 10, "min_samples_leaf": 2, "max_features": "sqrt"}, "none",
     "ET(n=800,depth=10,leaf=2,mf=sqrt)"),
    ("adaboost", {"n_estimators": 300, "learning_rate": 0.5}, "none", "AdaBoost(n=300,lr=0.5)"),
    ("gb", {"n_estimators": 400, "learning_rate": 0.05, "subsample": 0.9, "max_depth": 3}, "none",
     "GB(n=400,lr=0.05,sub=0.9)"),
    ("hist_gb", {"max_iter": 300, "learning_rate": 0.05, "max_depth": 3, "max_leaf_nodes": 31, "min_samples_leaf": 20,
                 "l2_regularization": 0.1}, "none", "HGB(it=300,lr=0.05,d=3,ln=31,ml=20,l2=0.1)"),
    ("xgb", {"n_estimators": 400, "max_depth": 3, "learning_rate": 0.05, "subsample": 0.9, "colsample_bytree": 0.9,
             "min_child_weight": 5, "reg_lambda": 5.0}, "none", "XGB(n=400,d=3,lr=0.05,sub=0.9,col=0.9,mcw=5)"),
    ("lgbm", {"n_estimators": 600, "num_leaves": 31, "learning_rate": 0.05, "subsample": 0.9, "colsample_bytree": 0.9,
              "min_child_samples": 20, "reg_lambda": 1.0}, "none", "LGBM(n=600,leaves=31,lr=0.05,mcs=20)"),
    ("catboost", {"n_estimators": 800, "max_depth": 6, "learning_rate": 0.05, "l2_leaf_reg": 3.0}, "none",
     "CAT(it=800,d=6,lr=0.05,l2=3.0)"),
]
# ---------------------------------------------------------------------------


def panel_configs(svm_grid=SVM_GRID, scalers=PANEL_SCALERS, others=OTHER_MODELS) -> list[M.ModelSpec]:
    """Every SVM setting under every scaler, then one configuration
    (with its own scaler) per other family."""
    out = [M.ModelSpec("rbf_svm", {"C": c, "gamma": g}, s, f"SVM(C={c},gamma={g})")
           for s in scalers for c, g in svm_grid]
    out += [M.ModelSpec(f, dict(p), s, n) for f, p, s, n in others]
    return out


def fit_pipeline(group: DataFrame, spec: M.ModelSpec, label_cfg: DataFrame | None = None,
                 use_selection: bool = True, use_smote: bool = False, seed: int = 42) -> tuple[M.Scorer, DataFrame | None]:
    """Scaler → K-best selection → (SMOTE) → classifier, every step
    fitted on the group's train rows only. Returns the fitted pipeline as a
    scorer of raw rows, and the selected slots (None: all). Synthetic rows
    take part in the fit alone."""
    train = group.filter(F.col("part") == "train")
    params = P.fit_scaler(train, spec.scaler) if spec.scaler != "none" else None

    def scale(df):
        return df if params is None else P.apply_scaler(df, params, spec.scaler)

    sel = P.select_k_best(scale(train), label_cfg) if use_selection and label_cfg is not None else None
    if sel is not None:  # one row per slot, read by every scoring
        ensure_checkpoint_dir(group.sparkSession)
        sel = sel.checkpoint()

    def prepare(df):
        return scale(df) if sel is None else P.apply_selection(scale(df), sel)

    g = prepare(group)
    extra = None
    if use_smote:
        from ..operators.smote import smote
        extra = smote(g.filter(F.col("part") == "train"), seed=seed)
    scorer = M.fit_scorer(g, spec, seed=seed, extra_train=extra)

    def score(df):
        raw = df.withColumn("_raw", F.col("x"))
        return scorer(prepare(raw)).withColumn("x", F.col("_raw")).select(*df.columns, "p")

    return score, sel


def build_pipeline(group: DataFrame, spec: M.ModelSpec, label_cfg: DataFrame | None = None,
                   use_selection: bool = True, use_smote: bool = False, seed: int = 42) -> DataFrame:
    """M16 applied: the scored group."""
    return fit_pipeline(group, spec, label_cfg, use_selection, use_smote, seed)[0](group)


def fitted_importance(rows: DataFrame, spec: M.ModelSpec, label_cfg: DataFrame, labels: Sequence[str], folds: Sequence[int],
                      use_selection: bool = True, n_repeats: int = 5, max_features: int = 50, seed: int = 42) -> DataFrame:
    """R12 of fitted models: per (fold, label) one fitted pipeline, its T5
    threshold on the train subjects, and the importance of the first
    ``max_features`` of its selected slots on the test windows; rows
    ``(scaler, model, model_key, fold, label, feature_index, …)``."""
    out = []
    for fold in folds:
        for i, lab in enumerate(labels):
            g = rows.filter((F.col("fold") == fold) & (F.col("label") == lab))
            score, sel = fit_pipeline(g, spec, label_cfg, use_selection, seed=seed)
            subj = A.aggregate_scores(score(g.filter(F.col("part") == "train")), mode="p90", by=["fold"])
            thr = TH.tune_thresholds(subj, label_cfg, policy="clinical_cost", by=["fold"])
            if sel is None:
                width = g.agg(F.max(F.size("x"))).first()[0]
                slots = rows.sparkSession.range(min(width, max_features)).select(
                    F.lit(fold).alias("fold"), F.lit(lab).alias("label"), F.col("id").cast("int").alias("feature"))
            else:
                slots = IMP.selected_features(sel.withColumn("fold", F.lit(fold)), max_features)
            imp = IMP.permutation_importance(g.filter(F.col("part") == "test"), score, thr, slots, n_repeats, seed,
                                             F.lit(i), by=["fold"])
            out.append(imp)
    long = reduce(DataFrame.unionByName, out)
    return long.select(F.lit(spec.scaler).alias("scaler"), F.lit(spec.name).alias("model"), F.lit(spec.key).alias("model_key"), "*")


def model_rows(windows: DataFrame, folds: DataFrame, labels: Sequence[str], k: int) -> DataFrame:
    """Long fit rows: every window × outer fold × label with ``part``."""
    sp = C.all_splits(windows, folds, k)
    lab = F.explode(F.array(*[F.struct(F.lit(l).alias("label"), F.col(l).cast("int").alias("y"))
                              for l in labels])).alias("_l")
    keep = [c for c in windows.columns if c not in labels]
    return (sp.select("fold", "part", *keep, lab).select("fold", "part", *keep, "_l.label", "_l.y")
            .withColumn("row_id", F.concat_ws(":", "subject_id", F.col("win_from").cast("string"), F.col("win_to").cast("string"))))


def evaluate_scores(scores: DataFrame, label_cfg: DataFrame, policy: str = "clinical_cost",
                    agg_mode: str = "p90", by: Sequence[str] = ("scaler", "model", "fold")) -> dict:
    """Window scores → subject scores → train-tuned thresholds → test
    predictions → fold rows, label rows, controls, decomposition, summaries."""
    by = list(by)
    subj = A.aggregate_scores(scores, mode=agg_mode, by=[*by, "part"])
    thr = TH.tune_thresholds(subj.filter(F.col("part") == "train"), label_cfg, policy=policy, by=by)
    ensure_checkpoint_dir(scores.sparkSession)
    preds = TH.apply_thresholds(subj.filter(F.col("part") == "test"), thr, by=by).checkpoint()  # read by every table below
    lm = E.label_metrics(preds, by).join(thr, on=[*by, "label"], how="left")
    res = R.fold_results(subj, preds, scores, label_cfg, by, window_col="row_id")
    board = R.leaderboard(res)
    best = R.best_configs(board)
    decomp = E.error_decomposition(preds, by=[c for c in by if c != "fold"])
    return {"fold_results": res, "label_results": lm, "controls": R.controls_table(res),
            "summary": board, "label_summary": R.label_summary(lm), "best": best,
            "best_decomposition": R.decompose_best(decomp, best), "predictions": preds}


def run_nested(rows: DataFrame, subject_labels: DataFrame, outer_folds: DataFrame,
               candidates: Sequence[M.ModelSpec], labels: Sequence[str], label_cfg: DataFrame,
               k_outer: int = 3, k_inner: int = 3, seed: int = 42, parallelism: int = 4,
               use_selection: bool = True, use_smote: bool = False) -> dict:
    """R9–R11 end to end: inner folds on each outer train set, candidate
    fits per (outer, inner, label), selection by mean inner error, refit of
    the chosen candidate on the full outer train (R10; constant score when
    no candidate could be scored), α-weighted clinical-cost thresholds, and
    the nested report tables (R11)."""
    ensure_checkpoint_dir(rows.sparkSession)
    inner = C.inner_folds(subject_labels, outer_folds, labels, k_outer, k_inner, seed)
    r = rows.filter(F.col("part") == "train").drop("part").join(inner, on=["fold", "subject_id"])
    fits = []
    for ci, spec in enumerate(candidates):
        for i in range(k_inner):
            g = r.withColumn("part", F.when(F.col("inner_fold") == i, "test").otherwise("train"))
            fits.append((ci, spec, i, g))

    def run(t):
        ci, spec, i, g = t
        outs = []
        for f in range(k_outer):
            for lab in labels:
                grp = g.filter((F.col("fold") == f) & (F.col("label") == lab)).drop("inner_fold")
                sc = build_pipeline(grp, spec, label_cfg, use_selection, use_smote, seed).checkpoint(eager=True)
                outs.append(sc.withColumn("inner_fold", F.lit(i)))
        out = reduce(DataFrame.unionByName, outs)
        return out.select(F.col("fold"), F.lit(spec.key).alias("candidate"), F.lit(ci).alias("cand_order"),
                          "inner_fold", F.when(F.col("part") == "test", "inner_val").otherwise("inner_train").alias("part"),
                          "subject_id", "label", "y", "p")

    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as ex:
        inner_scores = reduce(DataFrame.unionByName, list(ex.map(run, fits)))
    choices = NS.nested_select(NS.inner_errors(inner_scores, label_cfg), NS.constant_labels(inner_scores))
    # Refit each chosen candidate on the full outer train set
    chosen = {(r_["fold"], r_["label"]): r_["chosen_key"] for r_ in choices.collect()}  # folds × labels rows
    by_key = {s.key: s for s in candidates}
    parts = []
    for f in range(k_outer):
        for lab in labels:
            grp = rows.filter((F.col("fold") == f) & (F.col("label") == lab))
            key = chosen.get((f, lab))
            if key is None:
                mean_y = grp.filter(F.col("part") == "train").agg(F.avg(F.col("y").cast("double"))).first()[0]
                sc = grp.withColumn("p", F.lit(float(mean_y or 0.0)))
            else:
                sc = build_pipeline(grp, by_key[key], label_cfg, use_selection, use_smote, seed)
            parts.append(sc.checkpoint(eager=True).withColumn("chosen_key", F.lit(key)))
    scores = reduce(DataFrame.unionByName, parts).withColumn("scaler", F.lit("nested")) \
        .withColumn("model", F.lit("per_label_best"))
    ev = evaluate_scores(scores.drop("chosen_key"), label_cfg, policy="clinical_cost")
    label_rows = ev["label_results"].join(choices.select("fold", "label", "chosen_key"), on=["fold", "label"],
                                          how="left")
    return {"choices": choices, "choice_table": NS.nested_choices(choices, labels),
            "fold_results": ev["fold_results"], "label_results": label_rows,
            "summary": NS.nested_summary(ev["fold_results"]), "label_summary": NS.nested_label_summary(label_rows),
            "decomposition": E.error_decomposition(ev["predictions"]), "inner_scores": inner_scores}
