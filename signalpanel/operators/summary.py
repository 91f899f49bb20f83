"""Result tables, summaries, leaderboards and best-config selection
(R1–R8, R15). Inputs are small (one row per config × fold [× label]); all
operators stay relational so that they run where the panel ran."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.frames import is_control
from . import metrics as E

CONFIG = ["scaler", "model"]
FOLD_METRICS = ["macro_auc", "macro_auprc", "micro_f1", "macro_f1", "jaccard_samples",
                "hamming_acc", "exact_match", "clinical_cost", "clinical_cost_weighted"]
LABEL_METRICS = ["precision", "recall", "specificity", "f1", "auc", "auprc", "threshold",
                 "support_pos", "support_neg", "smote_used"]


def fold_results(subj: DataFrame, preds: DataFrame, windows: DataFrame,
                 label_cfg: DataFrame, by: Sequence[str] = ("scaler", "model", "fold"),
                 window_col: str = "doc_id") -> DataFrame:
    """One row per (config, fold): sizes, E8–E14, and the per-label
    thresholds and test-control FP/FPR as JSON maps (as the original fold
    rows store them). ``subj`` holds train and test subject rows (``part``),
    ``windows`` the window-level rows with ``part``."""
    by = list(by)
    sizes_s = subj.groupBy(*by).agg(
        F.countDistinct(F.when(F.col("part") == "train", F.col("subject_id"))).alias("n_train_subjects"),
        F.countDistinct(F.when(F.col("part") == "test", F.col("subject_id"))).alias("n_test_subjects"),
        F.countDistinct(F.when((F.col("part") == "test") & is_control("subject_id"),
                               F.col("subject_id"))).alias("n_controls_test"))
    wkey = F.col(window_col)
    sizes_w = windows.groupBy(*by).agg(
        F.countDistinct(F.when(F.col("part") == "train", wkey)).alias("n_train_windows"),
        F.countDistinct(F.when(F.col("part") == "test", wkey)).alias("n_test_windows"))
    fm = E.fold_metrics(preds, label_cfg, by)
    ctrl = E.controls_report(preds, by)
    thr = preds.groupBy(*by, "label").agg(F.first("threshold").alias("threshold"))
    maps = (thr.join(ctrl, on=[*by, "label"], how="left").groupBy(*by).agg(
        F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "threshold"))))).alias("thresholds"),
        F.to_json(F.map_from_entries(F.sort_array(F.collect_list(
            F.struct("label", F.coalesce(F.col("controls_fpr"), F.lit(float("nan"))).alias("v")))))).alias("controls_only_fpr"),
        F.to_json(F.map_from_entries(F.sort_array(F.collect_list(
            F.struct("label", F.coalesce(F.col("controls_fp").cast("double"), F.lit(float("nan"))).alias("v")))))).alias("controls_only_fp")))
    return sizes_s.join(sizes_w, on=by).join(fm, on=by).join(maps, on=by)


def _mean_std(cols: Sequence[str], std: str) -> list[Column]:
    sd = F.stddev_pop if std == "pop" else F.stddev_samp
    out = []
    for c in cols:
        v = F.when(~F.isnan(F.col(c)), F.col(c))  # NaN → NULL: skipped like pandas
        out += [F.avg(v).alias(f"{c}_mean"), sd(v).alias(f"{c}_std")]
    return out


def fold_summary(results: DataFrame, metrics: Sequence[str], by: Sequence[str] = CONFIG,
                 std: str = "pop", fold: str = "fold") -> DataFrame:
    """R1 (population std, window/task/subject panels) and R2 (sample std,
    multi-label panel): mean/std per config plus the number of folds."""
    return results.groupBy(*by).agg(*_mean_std(metrics, std), F.count(fold).alias("n_folds"))


def leaderboard(results: DataFrame, metrics: Sequence[str] = FOLD_METRICS,
                by: Sequence[str] = CONFIG) -> DataFrame:
    """R2: sample-std summary sorted by AUPRC, AUC, micro F1 (NULL last)."""
    s = fold_summary(results, metrics, by, std="samp")
    return s.orderBy(*[F.col(c).desc_nulls_last() for c in
                       ("macro_auprc_mean", "macro_auc_mean", "micro_f1_mean")], *by)


def label_summary(per_label: DataFrame, by: Sequence[str] = (*CONFIG, "label")) -> DataFrame:
    """Ten per-label means, sorted by AUPRC, AUC, F1."""
    cols = [c for c in LABEL_METRICS if c in per_label.columns]
    aggs = []
    for c in cols:
        v = F.col(c).cast("double")
        name = "smote_used_rate" if c == "smote_used" else f"{c}_mean"
        aggs.append(F.avg(F.when(~F.isnan(v), v)).alias(name))
    return (per_label.groupBy(*by).agg(*aggs)
            .orderBy(*[F.col(c).desc_nulls_last() for c in ("auprc_mean", "auc_mean", "f1_mean")], *by))


def controls_table(results: DataFrame, by: Sequence[str] = CONFIG) -> DataFrame:
    """JSON maps per fold row → one row per (config, fold, label)."""
    m = "map<string,double>"
    fpr = F.from_json("controls_only_fpr", m)
    fp = F.from_json("controls_only_fp", m)
    return (results.select(*by, "fold", "n_controls_test", fpr.alias("_fpr"), fp.alias("_fp"))
            .select(*by, "fold", "n_controls_test", "_fp", F.explode("_fpr").alias("label", "controls_fpr"))
            .select(*by, "fold", "label", "controls_fpr", F.col("_fp")[F.col("label")].alias("controls_fp"),
                    "n_controls_test"))


def controls_summary(controls: DataFrame, by: Sequence[str] = CONFIG) -> DataFrame:
    """Per config and label: mean / sample std of FPR and FP, fold count."""
    out = controls.groupBy(*by, "label").agg(*_mean_std(["controls_fpr", "controls_fp"], "samp"),
                                             F.count("fold").alias("n_folds"))
    return out.orderBy(F.col("controls_fp_mean").asc_nulls_last(),
                       F.col("controls_fpr_mean").asc_nulls_last(), *by, "label")


# Criterion → ordered (column, descending?) tie-break chain
CRITERIA = {
    "auprc": [("macro_auprc_mean", True), ("macro_auc_mean", True), ("micro_f1_mean", True)],
    "hamming": [("hamming_acc_mean", True), ("jaccard_samples_mean", True), ("micro_f1_mean", True)],
    "jaccard": [("jaccard_samples_mean", True), ("hamming_acc_mean", True), ("micro_f1_mean", True)],
    "auc": [("macro_auc_mean", True), ("macro_auprc_mean", True), ("micro_f1_mean", True)],
    "cost": [("clinical_cost_mean", False), ("hamming_acc_mean", True), ("jaccard_samples_mean", True)],
}


def best_configs(summary: DataFrame, by: Sequence[str] = CONFIG,
                 criteria: dict = CRITERIA) -> DataFrame:
    """The best config under each criterion (NULL sorts last; final tie
    → config name), as rows ``(criterion, scaler, model, n_folds)``: one
    aggregate with one ``min_by`` per criterion."""
    def place(c, descending):
        # means compared at 1e-12 (summation order must not break ties)
        v = F.round(c, 12)
        return F.coalesce(-v if descending else v, F.lit(float("inf")))

    row = F.struct(*by, "n_folds")
    best = [F.struct(F.lit(name).alias("criterion"),
                     F.min_by(row, F.struct(*[place(c, d).alias(f"o{i}") for i, (c, d) in enumerate(chain)], *by)).alias("r"))
            for name, chain in criteria.items()]
    rows = summary.agg(F.array(*best).alias("b")).select(F.explode("b").alias("b"))
    return rows.filter(F.col("b.r").isNotNull()).select("b.criterion", *[F.col(f"b.r.{c}") for c in by], "b.r.n_folds")


def check_complete(best: DataFrame, k: int, by: Sequence[str] = CONFIG) -> DataFrame:
    """Each best config is present with all k folds."""
    return best.select("criterion", *by, "n_folds", (F.col("n_folds") == k).alias("complete"))


def decompose_best(decomp: DataFrame, best: DataFrame, by: Sequence[str] = CONFIG) -> DataFrame:
    """Error decomposition (E18) of each best config."""
    return best.drop("n_folds").join(decomp, on=list(by), how="inner")


def top_configs(board: DataFrame, n: int = 10) -> DataFrame:
    """The first n leaderboard rows (the top-k report is the feature)."""
    return board.limit(n)


def union_results(*dfs: DataFrame) -> DataFrame:
    """Union of result tables by column name (missing → NULL)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
