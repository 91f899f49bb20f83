"""Threshold tuning as one relational job.

Each subject score is mapped to its *bucket*: the number of grid points
``t <= p`` (so the subject is predicted positive at grid index i exactly
when i < bucket). Counting ``(by, label, bucket)`` and taking a reverse
running sum over the grid yields TP/FP/FN/TN — overall and on controls —
at all 199 thresholds. Cost is O(rows) + O(groups × labels × grid),
independent of rows × grid; each running-sum partition holds at most
~2×grid rows, whatever the data size.

Policies rank thresholds per ``(by, label)`` with ties to the smallest t
(the first-best rule of a left-to-right grid scan).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import threshold_grid

POLICIES = ("fixed", "balanced", "f1", "clinical_cost", "spec_at_least")


def _grid_array(grid: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(g)) for g in grid])


def score_bucket(p: Column, grid: Sequence[float]) -> Column:
    """Number of grid points ≤ p (JVM higher-order filter, no join)."""
    return F.size(F.filter(_grid_array(grid), lambda g: g <= p))


def threshold_counts(subj: DataFrame, by: Sequence[str] = (),
                     grid: Sequence[float] | None = None) -> DataFrame:
    """Per ``(by, label, i)`` the confusion counts at grid point i,
    overall and on control subjects, plus the class totals."""
    grid = list(grid or threshold_grid())
    g = len(grid)
    keys = [*by, "label"]
    y, ctrl = F.col("y"), F.col("is_control")
    b = subj.select(*keys, (score_bucket(F.col("p"), grid) - 1).alias("i"),
                    (y == 1).cast("long").alias("pos"), (y == 0).cast("long").alias("neg"),
                    ((y == 0) & ctrl).cast("long").alias("cneg"),
                    ((y == 1) & ctrl).cast("long").alias("cpos"),
                    ctrl.cast("long").alias("nctrl"))
    per = b.groupBy(*keys, "i").agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "cneg", "cpos", "nctrl")])
    # complete grid for every (by, label): bounded, g rows per group
    zeros = (per.select(*keys).distinct()
             .select(*keys, F.explode(F.sequence(F.lit(0), F.lit(g - 1))).alias("i"))
             .withColumns({c: F.lit(0).cast("long") for c in ("pos", "neg", "cneg", "cpos", "nctrl")}))
    allrows = per.unionByName(zeros)
    w = Window.partitionBy(*keys).orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, 0)
    wall = Window.partitionBy(*keys)
    out = (allrows.groupBy(*keys, "i").agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "cneg", "cpos", "nctrl")])
           .select(*keys, "i",
                   F.sum("pos").over(w).alias("tp"), F.sum("neg").over(w).alias("fp"),
                   F.sum("cneg").over(w).alias("c_fp"),
                   F.sum("pos").over(wall).alias("P"), F.sum("neg").over(wall).alias("N"),
                   F.sum("cneg").over(wall).alias("c_N"), F.sum("nctrl").over(wall).alias("n_ctrl"))
           .filter(F.col("i") >= 0))
    gvals = F.array(*[F.lit(float(v)) for v in grid])
    return out.select(*keys, "i", gvals[F.col("i")].alias("t"), "tp", "fp",
                      (F.col("P") - F.col("tp")).alias("fn"), (F.col("N") - F.col("fp")).alias("tn"),
                      "P", "N", "c_fp", "c_N", "n_ctrl")


def _rates() -> dict[str, Column]:
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    P, N = F.col("P"), F.col("N")
    return {
        "recall": F.when(P > 0, tp / (tp + fn)).otherwise(F.lit(0.0)),
        "spec": F.when(N > 0, tn / (tn + fp)),
        "fpr": F.when(N > 0, fp / N.cast("double")),
        "fnr": F.when(P > 0, fn / P.cast("double")),
        "precision": F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0)),
        "f1": F.when(tp * 2 + fp + fn > 0, (tp * 2) / (tp * 2 + fp + fn)).otherwise(F.lit(0.0)),
        "c_fpr": F.when(F.col("c_N") > 0, F.col("c_fp").cast("double") / F.col("c_N").cast("double")),
        "err": (fp + fn) / F.greatest(F.lit(1), P + N).cast("double"),
    }


def _controls_ok() -> Column:
    """FP cap and FPR cap on (train) controls; vacuous without controls."""
    has = F.col("n_ctrl") > 0
    fp_ok = F.col("c_fp") <= F.col("fp_max")
    fpr_ok = F.col("c_fpr").isNull() | (F.col("c_fpr") <= F.col("fpr_target"))
    return ~has | (fp_ok & fpr_ok)


def _pick(df: DataFrame, keys: Sequence[str], score: Column, cond: Column, name: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col("_s").desc(), F.col("i").asc())
    return (df.filter(cond).withColumn("_s", score)
            .filter(F.col("_s").isNotNull())
            .withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") == 1)
            .select(*keys, F.col("t").alias(name)))


def tune_thresholds(subj: DataFrame, label_cfg: DataFrame, policy: str = "clinical_cost",
                    by: Sequence[str] = (), grid: Sequence[float] | None = None,
                    use_alpha: bool = True, constrain_controls: bool = True) -> DataFrame:
    """One threshold per ``(by, label)``, tuned on the given
    (train) subjects. Single-class labels and infeasible searches give 0.5."""
    if policy not in POLICIES:
        raise ValueError(f"unknown threshold policy {policy!r}")
    keys = [*by, "label"]
    base = subj.groupBy(*keys).agg(F.countDistinct("y").alias("_ncls"))
    if policy == "fixed":                                               # T2
        return base.select(*keys, F.lit(0.5).alias("threshold"))
    cfg = F.broadcast(label_cfg)  # one row per label: bounded
    cnt = threshold_counts(subj, by, grid).join(cfg, on="label").withColumns(_rates())
    ok = _controls_ok() if constrain_controls else F.lit(True)
    alpha = F.col("alpha") if use_alpha else F.lit(0.5)
    scores = {
        "balanced": F.lit(0.5) * (F.col("recall") + F.col("spec")),    # T3
        "f1": F.col("f1"),                                              # T4
        "clinical_cost": -((F.lit(1.0) - alpha) * F.col("fpr") + alpha * F.col("fnr")),  # T5
    }
    if policy == "spec_at_least":                                       # T6
        feas = ok & F.col("spec").isNotNull() & (F.col("spec") >= F.col("spec_target"))
        first = _pick(cnt, keys, F.col("recall"), feas, "_t1")
        second = _pick(cnt, keys, scores["balanced"], ok, "_t2")
        chosen = first.join(second, on=keys, how="full").select(
            *keys, F.coalesce("_t1", "_t2").alias("_t"))
    else:
        chosen = _pick(cnt, keys, scores[policy], ok, "_t")
    return (base.join(chosen, on=keys, how="left")                      # T8
            .select(*keys, F.when(F.col("_ncls") < 2, F.lit(0.5))
                    .otherwise(F.coalesce(F.col("_t"), F.lit(0.5))).alias("threshold")))


def min_error_threshold(subj: DataFrame, label_cfg: DataFrame, by: Sequence[str] = (),
                        grid: Sequence[float] | None = None,
                        relax_levels: Sequence[int] = (0, 1, 2, 3, 4)) -> DataFrame:
    """Minimum-error threshold under constraints, relaxed level by
    level (0: controls FP + controls FPR + specificity floor + recall floor;
    1: no specificity floor; 2: no controls FPR; 3: no recall floor;
    4: unconstrained). The lowest level with a feasible t wins; a constant
    label needs no threshold (0.5 at level 0)."""
    keys = [*by, "label"]
    base = subj.groupBy(*keys).agg(F.countDistinct("y").alias("_ncls"))
    cnt = threshold_counts(subj, by, grid).join(F.broadcast(label_cfg), on="label").withColumns(_rates())
    has = F.col("n_ctrl") > 0
    fp_ok = ~has | (F.col("c_fp") <= F.col("fp_max"))
    fpr_ok = ~has | F.col("c_fpr").isNull() | (F.col("c_fpr") <= F.col("fpr_target"))
    spec_ok = F.col("spec").isNull() | (F.col("spec") >= F.col("spec_target"))
    rec_ok = (F.col("P") == 0) | (F.col("recall") >= F.col("recall_min"))
    conds = {0: fp_ok & fpr_ok & spec_ok & rec_ok, 1: fp_ok & fpr_ok & rec_ok,
             2: fp_ok & rec_ok, 3: fp_ok, 4: F.lit(True)}
    lv = F.explode(F.array(*[F.lit(int(x)) for x in relax_levels])).alias("level")
    rows = cnt.select("*", lv)
    feas = F.lit(False)
    for lev, c in conds.items():
        feas = feas | ((F.col("level") == lev) & c)
    w = Window.partitionBy(*keys).orderBy(F.col("level"), F.col("err"), F.col("i"))
    best = (rows.filter(feas).withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") == 1)
            .select(*keys, F.col("t").alias("_t"), F.col("level").alias("_lv"), F.col("err").alias("_e")))
    return (base.join(best, on=keys, how="left")
            .select(*keys,
                    F.when(F.col("_ncls") < 2, F.lit(0.5)).otherwise(F.coalesce("_t", F.lit(0.5))).alias("threshold"),
                    F.when(F.col("_ncls") < 2, F.lit(0)).otherwise(F.col("_lv")).alias("relax_level"),
                    F.when(F.col("_ncls") < 2, F.lit(None).cast("double")).otherwise(F.col("_e")).alias("train_error")))


def apply_thresholds(subj: DataFrame, thresholds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``pred = p >= threshold``. The threshold table has one row per
    (by, label) — groups × labels — so it is joined on its keys (Spark
    broadcasts it when its statistics are small)."""
    keys = [*by, "label"]
    return (subj.join(thresholds.select(*keys, "threshold"), on=keys, how="left")
            .withColumn("threshold", F.coalesce("threshold", F.lit(0.5)))
            .withColumn("pred", (F.col("p") >= F.col("threshold")).cast("int")))
