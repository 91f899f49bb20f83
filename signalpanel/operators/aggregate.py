"""Window scores → subject scores.

Input is long: ``(*by, subject_id, label, y, p)`` with one row per window.
Output: one row per ``(*by, subject_id, label)`` with the aggregated score,
the OR of the window labels and the control flag (A6).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.frames import is_control

MODES = ("max", "topk", "p90", "noisy_or")
CLIP = 1e-6
# Subject scores are kept at 1e-12 resolution: interpolated percentiles that
# are mathematically equal then tie in every engine (their last-ulp values
# depend on the interpolation formula), which rank metrics and threshold
# scans are sensitive to.
SCORE_DECIMALS = 12


def _score_agg(mode: str, q: float) -> Column:
    p = F.col("p")
    if mode == "max":                                       # A1
        return F.max(p)
    if mode == "p90":                                       # A3 (linear interpolation)
        return F.percentile(p, F.lit(q / 100.0))
    if mode == "noisy_or":                                  # A4
        clipped = F.least(F.greatest(p, F.lit(CLIP)), F.lit(1.0 - CLIP))
        return F.lit(1.0) - F.product(F.lit(1.0) - clipped)
    raise ValueError(f"unknown aggregation mode {mode!r}")  # A5


def aggregate_scores(scores: DataFrame, mode: str = "p90", k: int = 2, q: float = 90,
                     by: Sequence[str] = (), subject: str = "subject_id",
                     largest_group: int | None = None) -> DataFrame:
    """Aggregate window scores per subject and label."""
    if mode not in MODES:
        raise ValueError(f"unknown aggregation mode {mode!r}")  # A5
    keys = [*by, subject, "label"]
    if mode == "p90":                                       # A3, exact and skew-safe
        from . import quantile as Q
        ytab = F.max("y").cast("int").alias("y")
        if largest_group is None:
            largest_group = Q.largest_group(scores, keys, "p")
        if largest_group <= Q.SMALL_GROUP:                  # one aggregate for both
            out = scores.groupBy(*keys).agg(_score_agg(mode, q).alias("p"), ytab)
        else:
            q90 = Q.quantiles(scores, keys, "p", [q / 100.0], prefix="_q", largest=largest_group)
            out = q90.select(*keys, F.col("_q0").alias("p")).join(scores.groupBy(*keys).agg(ytab), on=keys)
    elif mode == "topk":                                    # A2: mean of the k largest
        # rank-limited window: Spark pushes the per-group top-k below the
        # shuffle (WindowGroupLimit), so only k rows per group move
        w = Window.partitionBy(*keys).orderBy(F.col("p").desc())
        top = scores.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= k)
        ytab = scores.groupBy(*keys).agg(F.max("y").cast("int").alias("y"))
        sc = top.groupBy(*keys).agg(F.avg("p").alias("p"))
        out = sc.join(ytab, on=keys)
    else:
        out = scores.groupBy(*keys).agg(_score_agg(mode, q).alias("p"),
                                        F.max("y").cast("int").alias("y"))
    return (out.withColumn("p", F.round("p", SCORE_DECIMALS))
            .withColumn("is_control", is_control(subject)))


def majority_vote(preds: DataFrame, by: Sequence[str] = (), subject: str = "subject_id",
                  pred: str = "pred", y: str = "y") -> DataFrame:
    """Subject prediction = mean(window prediction) ≥ 0.5; subject
    truth = OR of window truths."""
    return (preds.groupBy(*by, subject)
            .agg((F.avg(F.col(pred).cast("double")) >= 0.5).cast("int").alias("vote"),
                 F.max(y).cast("int").alias("y")))


def vote_metrics(votes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Vote accuracy, sensitivity, specificity (denominators ≥ 1)."""
    v, y = F.col("vote"), F.col("y")
    tp = F.count_if((v == 1) & (y == 1))
    tn = F.count_if((v == 0) & (y == 0))
    return (votes.groupBy(*by)
            .agg(F.count(F.lit(1)).alias("n"), tp.alias("tp"), tn.alias("tn"),
                 F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"))
            .select(*by,
                    (F.col("tp") + F.col("tn")) / F.greatest(F.lit(1), F.col("n")).alias("x"),
                    F.col("tp") / F.greatest(F.lit(1), F.col("pos")),
                    F.col("tn") / F.greatest(F.lit(1), F.col("neg")))
            .toDF(*by, "vote_accuracy", "vote_sensitivity", "vote_specificity"))
