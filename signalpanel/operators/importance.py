"""Subject-level permutation importance.

For every (fold, label), feature j (every selected slot, or the first
``max_features`` of them in index order) and repeat r, feature j of the test
windows is permuted; the windows are re-scored, aggregated to subjects, thresholded
and the subject error (FP+FN)/N compared with the unpermuted baseline.

All (feature, repeat) variants are scored in **one** pass: the permutation is
a join of two md5 orders (each computed with the block-wise rank), in which
only scalars move; rows are then expanded in place, slot j is replaced, and
the scorer is applied once to the expanded table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import aggregate as A
from . import split as C


def permuted_rows(test: DataFrame, features: DataFrame, n_repeats: int = 5, seed: int = 42,
                  label_index: Column | None = None, by: Sequence[str] = ("fold", "label"),
                  row_id: str = "row_id", col: str = "x", block_digits: int = C.BLOCK_DIGITS) -> DataFrame:
    """Expand test rows over (feature j, repeat r) and replace slot j with
    the value of the row that the (j, r) permutation maps onto this row.

    ``features`` lists ``(*by, feature)``: the slots to permute per group.
    Permutation seed per group: 42 + 1000·fold + 13·label_index (+ j, r).
    Only the permuted scalars are shuffled: each row gathers its replacement
    values, meets its feature array once, and is expanded in place.
    """
    by = list(by)
    li = label_index if label_index is not None else F.lit(0)
    h = F.col("_h")
    # the target order (md5 of the row id) is the same for every (j, r)
    base = test.withColumn("_seed", (F.lit(seed) + F.col("fold") * 1000 + li * 13).cast("string")) \
        .withColumn("_h", F.md5(F.concat(F.lit("id:"), F.col(row_id).cast("string"))))
    base = C.dealt_rank(base.withColumn("_b", C.rank_block(h, block_digits)), ["_b", "_h"], part=by, name="_k").drop("_b", "_h")
    slots = features.groupBy(*by).agg(F.collect_list("feature").alias("_js"))  # at most as many as a row has features
    pairs = F.flatten(F.transform("_js", lambda j: F.transform(
        F.sequence(F.lit(0), F.lit(n_repeats - 1)), lambda r: F.struct(j.alias("j"), r.alias("r")))))
    ex = (base.join(slots, on=by).select(*by, row_id, "_seed", col, F.explode(pairs).alias("_p"))
          .select(*by, row_id, "_seed", "_p.j", "_p.r", F.element_at(col, F.col("_p.j") + 1).alias("_v")))
    key = F.md5(F.concat_ws(":", "_seed", F.col("j").cast("string"), F.col("r").cast("string"), F.col(row_id)))
    ex = ex.select(*by, "j", "r", "_v", key.alias("_h"))
    ex = ex.withColumn("_b", C.rank_block(h, block_digits))
    # the row whose source rank equals a row's target rank supplies slot j
    src = C.dealt_rank(ex, ["_b", "_h"], part=[*by, "j", "r"], name="_k").select(*by, "_k", "j", "r", "_v")
    mine = src.groupBy(*by, "_k").agg(F.collect_list(F.struct("j", "r", F.col("_v").alias("v"))).alias("_new"))
    out = base.join(mine, on=[*by, "_k"]).drop("_k", "_seed").withColumn("_n", F.explode("_new")).drop("_new")
    j = F.col("_n.j")
    newx = F.concat(F.slice(col, F.lit(1), j), F.array("_n.v"), F.slice(col, j + 2, F.size(col) - j - 1))
    return out.withColumn(col, newx).withColumns({"j": F.col("_n.j"), "r": F.col("_n.r")}).drop("_n")


def subject_error(scored: DataFrame, thresholds: DataFrame, by: Sequence[str],
                  agg_mode: str = "p90", largest_group: int | None = None) -> DataFrame:
    """Window scores → subject scores → predictions at the group's
    threshold → subject error rate (FP+FN)/N per ``by`` (+ label)."""
    s = A.aggregate_scores(scored, mode=agg_mode, by=by, largest_group=largest_group)
    keys = [c for c in by if c in thresholds.columns]
    s = s.join(thresholds.select(*keys, "label", "threshold"), on=[*keys, "label"], how="left")
    s = s.withColumn("pred", (F.col("p") >= F.coalesce("threshold", F.lit(0.5))).cast("int"))
    return s.groupBy(*by, "label").agg(
        (F.count_if(F.col("y") != F.col("pred")) / F.greatest(F.lit(1), F.count(F.lit(1)))).alias("err"))


def permutation_importance(test: DataFrame, scorer: Callable[[DataFrame], DataFrame],
                           thresholds: DataFrame, features: DataFrame, n_repeats: int = 5,
                           seed: int = 42, label_index: Column | None = None, agg_mode: str = "p90",
                           by: Sequence[str] = ("fold",), row_id: str = "row_id") -> DataFrame:
    """Mean / population std over repeats of Δ subject error per
    (group, label, feature), with the baseline error."""
    by = list(by)
    # permuting a feature never changes a subject's window count: size the
    # subject groups once on the unexpanded rows
    from .quantile import largest_group
    big = largest_group(test, [*by, "subject_id", "label"], row_id)
    base = subject_error(scorer(test), thresholds, by, agg_mode, big).withColumnRenamed("err", "baseline_error")
    # rank blocks that hold some 50,000 rows each (one block for small groups)
    digits = C.digits_for(largest_group(test, [*by, "label"], row_id))
    perm = permuted_rows(test, features, n_repeats, seed, label_index, by=[*by, "label"], row_id=row_id,
                         block_digits=digits)
    perr = subject_error(scorer(perm), thresholds, [*by, "j", "r"], agg_mode, big)
    d = perr.join(base, on=[*by, "label"]).withColumn("delta", F.col("err") - F.col("baseline_error"))
    return d.groupBy(*by, "label", F.col("j").alias("feature_index")).agg(
        F.avg("delta").alias("importance_delta_error_mean"),
        F.stddev_pop("delta").alias("importance_delta_error_std"),
        F.first("baseline_error").alias("baseline_error"),
        F.count(F.lit(1)).alias("n_repeats"))


def selected_features(selection: DataFrame, max_features: int | None = None,
                      by: Sequence[str] = ("fold", "label")) -> DataFrame:
    """Every selected slot, or with ``max_features`` the first so many in
    index order (not rank order)."""
    if max_features is None:
        return selection.select(*by, "feature")
    from pyspark.sql import Window
    w = Window.partitionBy(*by).orderBy("feature")   # ≤ K rows per group
    return (selection.withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= max_features)
            .select(*by, "feature"))


def importance_summary(long: DataFrame, by: Sequence[str] = ("label", "feature_index")) -> DataFrame:
    """Over folds: mean of the per-fold mean Δ, its sample std, mean
    baseline, distinct folds; sorted by group then importance."""
    lead = list(by)[:-1]
    return (long.groupBy(*by).agg(
        F.avg("importance_delta_error_mean").alias("importance_delta_error_mean"),
        F.stddev_samp("importance_delta_error_mean").alias("importance_delta_error_std"),
        F.avg("baseline_error").alias("baseline_error_mean"),
        F.countDistinct("fold").alias("n_folds"))
        .orderBy(*lead, F.col("importance_delta_error_mean").desc()))
