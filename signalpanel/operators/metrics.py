"""Subject-level metrics (E1–E18) over long prediction rows
``(*by, subject_id, label, y, p, pred, is_control)``.

Rank metrics (E6, E7) first collapse rows to distinct scores per
``(by, label)`` and then take one running sum over those in even score ranges
(no window spans a whole group). Undefined rates are NULL (NaN
in the scripts).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    y, p = F.col("y"), F.col("pred")
    return df.groupBy(*keys).agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 0) & (p == 0)).alias("tn"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b.cast("double"))


def binary_metrics(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """E1–E5, E16, E17 per ``(by, label)``."""
    keys = [*by, "label"]
    c = _counts(preds, keys)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    P, N = tp + fn, tn + fp
    rec = F.coalesce(_ratio(tp, P), F.lit(0.0))
    spec = _ratio(tn, N)
    prec = F.coalesce(_ratio(tp, tp + fp), F.lit(0.0))
    f1 = F.coalesce(_ratio(tp * 2, tp * 2 + fp + fn), F.lit(0.0))
    f1_neg = F.coalesce(_ratio(tn * 2, tn * 2 + fn + fp), F.lit(0.0))
    return c.select(
        *keys, "tp", "fp", "fn", "tn",
        P.alias("support_pos"), N.alias("support_neg"),               # E16
        _ratio(fp, N).alias("fpr"), _ratio(fn, P).alias("fnr"),       # E1
        prec.alias("precision"), rec.alias("recall"), f1.alias("f1"),  # E2
        spec.alias("specificity"),                                     # E3
        (F.lit(0.5) * (rec + spec)).alias("balanced_accuracy"),        # E4
        _ratio(tp + tn, P + N).alias("accuracy"), f1_neg.alias("f1_neg"),  # E5
        _ratio(fp + fn, P + N).alias("error_rate"))                    # E17


#: Score ranges per group in the running sums of the rank metrics.
SCORE_RANGES = 256


def _score_groups(preds: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    return (preds.groupBy(*keys, score)
            .agg(F.count_if(F.col("y") == 1).alias("_pos"), F.count_if(F.col("y") == 0).alias("_neg")))


def _rank_metrics(g: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """E6 and E7 per group from its distinct scores and one running sum.

    Each group's scores are cut at its own (approximate) quantiles, so ranges
    are even whatever the scores' distribution; range totals are prefix-summed
    and the exact running sum inside a range is a window over that range only.
    The cuts only decide where work is done: any cuts give the same sums.
    With the sums below a score known, those at or above it follow from the
    totals, so the ascending AUC and the descending AP share one pass."""
    keys = list(keys)
    cuts = F.percentile_approx(F.col(score).cast("double"),
                               F.array(*[F.lit(i / SCORE_RANGES) for i in range(1, SCORE_RANGES)]), 2000)
    st = g.groupBy(*keys).agg(F.sum("_pos").alias("_totp"), F.sum("_neg").alias("_totn"), cuts.alias("_cuts"))
    x = g.join(st, on=keys).withColumn(
        "_rg", F.size(F.filter("_cuts", lambda c: c < F.col(score)))).drop("_cuts")
    tot = x.groupBy(*keys, "_rg").agg(F.sum("_pos").alias("_rp"), F.sum("_neg").alias("_rn"))
    before = Window.partitionBy(*keys).orderBy("_rg").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(*keys, "_rg", F.coalesce(F.sum("_rp").over(before), F.lit(0)).alias("_op"),
                      F.coalesce(F.sum("_rn").over(before), F.lit(0)).alias("_on"))
    inside = Window.partitionBy(*keys, "_rg").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    y = x.join(offs, on=[*keys, "_rg"])
    y = y.select(*keys, "_totp", "_totn", "_pos", "_neg",
                 (F.col("_op") + F.coalesce(F.sum("_pos").over(inside), F.lit(0))).alias("_pb"),
                 (F.col("_on") + F.coalesce(F.sum("_neg").over(inside), F.lit(0))).alias("_nb"))
    hits = F.col("_totp") - F.col("_pb")                       # positives at or above the score
    every = hits + F.col("_totn") - F.col("_nb")
    out = y.groupBy(*keys).agg(
        F.first("_totp").alias("_totp"), F.first("_totn").alias("_totn"),
        F.sum(F.col("_pos") * (F.col("_nb") + F.col("_neg") * 0.5)).alias("_u"),
        F.sum(F.col("_pos") * (hits / every)).alias("_ap"))
    both = (F.col("_totp") > 0) & (F.col("_totn") > 0)
    return out.select(*keys, F.when(both, F.col("_u") / (F.col("_totp") * F.col("_totn")).cast("double")).alias("auc"),
                      F.when(both, F.col("_ap") / F.col("_totp")).alias("auprc"))


def roc_auc(scores: DataFrame, by: Sequence[str] = (), score: str = "p") -> DataFrame:
    """Tie-aware ROC AUC (average ranks) per ``(by, label)``; NULL
    when a class is missing. Σ_s pos(s)·(neg below s + ½·neg(s)) / (P·N)."""
    keys = [*by, "label"]
    return _rank_metrics(_score_groups(scores, keys, score), keys, score).select(*keys, "auc")


def average_precision(scores: DataFrame, by: Sequence[str] = (), score: str = "p") -> DataFrame:
    """Step-wise average precision Σ ΔR·P over distinct thresholds."""
    keys = [*by, "label"]
    return _rank_metrics(_score_groups(scores, keys, score), keys, score).select(*keys, "auprc")


def label_metrics(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per-label table of the fold rows: E1–E7, E16 on (by, label)."""
    keys = [*by, "label"]
    return binary_metrics(preds, by).join(
        _rank_metrics(_score_groups(preds, keys, "p"), keys, "p"), on=keys, how="left")


def macro(metric_df: DataFrame, by: Sequence[str] = (), cols: Sequence[str] = ("auc", "auprc")) -> DataFrame:
    """Mean over labels with both classes (NULL rows skipped; NULL if
    no label qualifies)."""
    return metric_df.groupBy(*by).agg(*[F.avg(c).alias(f"macro_{c}") for c in cols])


def controls_report(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """False positives and FPR among (test) controls per label;
    NULL when the group has no control."""
    keys = [*by, "label"]
    ctrl = F.col("is_control")
    y, p = F.col("y"), F.col("pred")
    c = preds.groupBy(*keys).agg(
        F.count_if(ctrl).alias("n_controls"),
        F.count_if(ctrl & (y == 0) & (p == 1)).alias("_fp"),
        F.count_if(ctrl & (y == 0)).alias("_neg"))
    return c.select(*keys, "n_controls",
                    F.when(F.col("n_controls") > 0, F.col("_fp")).alias("controls_fp"),
                    F.when(F.col("n_controls") > 0, _ratio(F.col("_fp"), F.col("_neg"))).alias("controls_fpr"))


def error_decomposition(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per label over all folds pooled: P, N, prevalence, confusion
    counts, FNR, FPR, errors and errors per subject."""
    keys = [*by, "label"]
    c = _counts(preds, keys)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    P, N = tp + fn, tn + fp
    return c.select(*keys, P.alias("P"), N.alias("N"), _ratio(P, P + N).alias("prevalence"),
                    tp.alias("TP"), fn.alias("FN"), fp.alias("FP"), tn.alias("TN"),
                    _ratio(fn, P).alias("FNR"), _ratio(fp, N).alias("FPR"),
                    (fp + fn).alias("errors"), _ratio(fp + fn, P + N).alias("errors_per_patient"))


def fold_metrics(preds: DataFrame, label_cfg: DataFrame | None = None, by: Sequence[str] = (),
                 label_table: DataFrame | None = None) -> DataFrame:
    """E8–E14 per ``by`` from one per-label table (E1–E7) and one
    per-subject pass: macro AUC/AUPRC, micro/macro F1, clinical cost
    (plain and α-weighted), sample Jaccard, Hamming, exact match."""
    by = list(by)
    lm = label_table if label_table is not None else label_metrics(preds, by)
    if label_cfg is not None:
        lm = lm.join(F.broadcast(label_cfg.select("label", "alpha")), on="label", how="left")
        a = F.coalesce(F.col("alpha"), F.lit(0.5))
    else:
        a = F.lit(0.5)
    both = F.col("fpr").isNotNull() & F.col("fnr").isNotNull()
    lab = lm.groupBy(*by).agg(
        F.avg("auc").alias("macro_auc"), F.avg("auprc").alias("macro_auprc"),
        F.sum("tp").alias("_tp"), F.sum("fp").alias("_fp"), F.sum("fn").alias("_fn"),
        F.avg("f1").alias("macro_f1"),
        F.avg(F.when(both, F.lit(0.5) * (F.col("fpr") + F.col("fnr")))).alias("clinical_cost"),
        F.avg(F.when(both, (F.lit(1.0) - a) * F.col("fpr") + a * F.col("fnr"))).alias("clinical_cost_weighted"))
    lab = lab.withColumn("micro_f1", F.coalesce(
        _ratio(F.col("_tp") * 2, F.col("_tp") * 2 + F.col("_fp") + F.col("_fn")), F.lit(0.0))) \
        .drop("_tp", "_fp", "_fn")
    y, p = F.col("y"), F.col("pred")
    per_subj = preds.groupBy(*by, "subject_id").agg(
        F.count_if((y == 1) & (p == 1)).alias("_i"), F.count_if((y == 1) | (p == 1)).alias("_u"),
        F.count_if(y != p).alias("_d"), F.count(F.lit(1)).alias("_l"))
    subj = per_subj.groupBy(*by).agg(
        F.avg(F.coalesce(_ratio(F.col("_i"), F.col("_u")), F.lit(0.0))).alias("jaccard_samples"),
        (F.sum("_d") / F.sum("_l")).alias("hamming_loss"),
        F.avg((F.col("_d") == 0).cast("double")).alias("exact_match"))
    out = lab.join(subj, on=by, how="inner") if by else lab.crossJoin(subj)
    return out.withColumn("hamming_acc", F.lit(1.0) - F.col("hamming_loss"))
