"""Nested per-label model selection (R9–R11) over a long score table.

Inner scores: ``(fold, candidate, cand_order, inner_fold, part, subject_id,
label, y, p)`` at *window* level with ``part`` ∈ {inner_train, inner_val}.
Per (outer fold, label, candidate, inner split): subject aggregation,
minimum-error threshold with relaxation (T9) on inner-train subjects,
error on inner-validation subjects; candidates are ranked by the mean
inner error (first candidate wins ties).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import aggregate as A
from . import thresholds as TH


def inner_errors(inner_scores: DataFrame, label_cfg: DataFrame, agg_mode: str = "p90",
                 grid: Sequence[float] | None = None) -> DataFrame:
    """Error of every (fold, candidate, inner, label) on its validation
    subjects, at the threshold chosen on its training subjects."""
    by = ["fold", "candidate", "cand_order", "inner_fold"]
    subj = A.aggregate_scores(inner_scores, mode=agg_mode, by=[*by, "part"])
    thr = TH.min_error_threshold(subj.filter(F.col("part") == "inner_train"), label_cfg, by=by, grid=grid)
    val = TH.apply_thresholds(subj.filter(F.col("part") == "inner_val"), thr.drop("relax_level", "train_error"), by=by)
    err = val.groupBy(*by, "label").agg(
        (F.count_if(F.col("y") != F.col("pred")) / F.greatest(F.lit(1), F.count(F.lit(1)))).alias("err"))
    return err.join(thr.select(*by, "label", "relax_level"), on=[*by, "label"], how="left")


def constant_labels(inner_scores: DataFrame) -> DataFrame:
    """(fold, label) pairs whose label is the same for all outer-train subjects."""
    subj = inner_scores.groupBy("fold", "label", "subject_id").agg(F.max("y").alias("y"))
    return (subj.groupBy("fold", "label").agg(F.countDistinct("y").alias("_k"))
            .filter(F.col("_k") < 2).select("fold", "label", F.lit(True).alias("constant")))


def nested_select(errors: DataFrame, constants: DataFrame | None = None) -> DataFrame:
    """Per (outer fold, label) the candidate with the lowest mean inner
    error (ties → earlier candidate), with its meta columns. A label that is
    constant on the outer train subjects has no choice (NULL)."""
    m = errors.groupBy("fold", "label", "candidate", "cand_order").agg(
        F.avg("err").alias("mean_err"), F.avg("relax_level").alias("relax_level_mean"),
        F.count(F.lit(1)).alias("n_inner"))
    # means of equal errors may differ in the last bit with summation order:
    # rank at 1e-12 so that true ties go to the earlier candidate
    w = Window.partitionBy("fold", "label").orderBy(F.round("mean_err", 12), "cand_order")
    best = (m.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") == 1)
            .select("fold", "label", F.col("candidate").alias("chosen_key"), "mean_err",
                    (F.lit(1.0) - F.col("mean_err")).alias("mean_hamming_acc"), "relax_level_mean", "n_inner"))
    if constants is None:
        return best
    c = best.join(constants, on=["fold", "label"], how="left")
    return c.select("fold", "label", *[F.when(F.col("constant").isNull(), F.col(x)).alias(x) for x in best.columns[2:]])


def nested_choices(choices: DataFrame, labels: Sequence[str]) -> DataFrame:
    """The choice table — one row per outer fold, one column per label
    (explicit pivot list)."""
    return choices.groupBy("fold").pivot("label", list(labels)).agg(F.first("chosen_key"))


#: Metrics of the nested summary.
NESTED_METRICS = ("macro_auc", "macro_auprc", "micro_f1", "hamming_acc", "exact_match", "clinical_cost_weighted")


def nested_summary(fold_rows: DataFrame, metrics: Sequence[str] = NESTED_METRICS) -> DataFrame:
    """Mean / sample std over outer folds of the nested by-fold rows,
    ignoring rows without a chosen key (as a pandas group-by drops NULL keys)."""
    aggs = []
    for c in metrics:
        v = F.when(~F.isnan(F.col(c)), F.col(c))
        aggs += [F.avg(v).alias(f"{c}_mean"), F.stddev_samp(v).alias(f"{c}_std")]
    return fold_rows.agg(*aggs, F.count("fold").alias("n_folds"))


def nested_label_summary(label_rows: DataFrame) -> DataFrame:
    """Per (label, chosen_key): means over folds; NULL keys dropped."""
    cols = [c for c in ("precision", "recall", "specificity", "f1", "auc", "auprc", "threshold", "support_pos", "support_neg")
            if c in label_rows.columns]
    return (label_rows.filter(F.col("chosen_key").isNotNull())
            .groupBy("label", "chosen_key")
            .agg(*[F.avg(F.when(~F.isnan(F.col(c).cast("double")), F.col(c))).alias(f"{c}_mean") for c in cols],
                 F.count(F.lit(1)).alias("n_folds")))
