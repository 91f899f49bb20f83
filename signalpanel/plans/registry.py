"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per
operator of the inventory, each over the driver tables (through the
fixture views), plus the matching DuckDB oracle text."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.chunks import long_signal_features
from ..functions.matrix import SPECS, feature_matrix, window_features
from ..sources import fixtures as fx
from ..sources import frames as S
from ..session import ensure_checkpoint_dir
from . import oracle as O

WK = ["subject_id", "win_from", "win_to"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def rounded(df: DataFrame, decimals: int = O.R) -> DataFrame:
    """Presentation step for the gate: round every double column."""
    return df.select(*[(F.round(F.col(f.name), decimals) + F.lit(0.0)).alias(f.name)
                       if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
                       for f in df.schema.fields])


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ------------------------------------------------------------ F1–F22, F23
@register("channel_features", O.features_sql(O.b1_frames_cte("centred"), fx.B1_CHANNELS, WK))
def q_channel_features(spark, sf):
    """F1–F22 (multi-label variant) per window and channel, B1 centred."""
    return rounded(window_features(fx.frames_b1_centred(spark, sf), WK, fx.B1_CHANNELS))


@register("channel_features_short", O.features_sql(O.b1_frames_cte(), fx.B1_CHANNELS, WK))
def q_channel_features_short(spark, sf):
    """F1–F22 on the raw signal, all frames of windows of any length (n < 2
    gives no row; Higuchi and permutation entropy guards)."""
    return rounded(window_features(fx.frames_b1(spark, sf), WK, fx.B1_CHANNELS))


@register("channel_features_window_variant",
          O.features_sql(O.b1_frames_cte("centred"), fx.B1_CHANNELS, WK, fps=1.0, variant="window"))
def q_channel_features_window(spark, sf):
    """Window-panel variant: peak index, cycles/sample, crossings of the
    signal, rolling means only when the window is long enough."""
    return rounded(window_features(fx.frames_b1_centred(spark, sf), WK, fx.B1_CHANNELS, SPECS["window"]))


@register("part_signal_features", O.features_sql(O.B6_CTE, fx.B6_CHANNELS, WK))
def q_part_signal_features(spark, sf):
    """F1–F22 over one long signal per part (lineitem quantities in ship
    order) — the heavy feature workload of the bench."""
    return rounded(window_features(fx.signals_b6(spark, sf), WK, fx.B6_CHANNELS))


# ------------------------------------------------------------ A1–A8
from ..config import AGG_MODE, FIXTURE_SETTINGS, N_SPLITS, SEED, LabelSettings  # noqa: E402
from ..operators import aggregate as A  # noqa: E402
from ..operators import metrics as E  # noqa: E402
from ..operators import thresholds as TH  # noqa: E402

PANEL_BY = ["scaler", "model", "fold"]


def _b3_windows(spark, sf):
    return fx.scores_b3(spark, sf)


for _mode in ("max", "topk", "p90", "noisy_or"):
    if _mode == "topk":
        _sql = f"""with {O.B3_BASE},
r as (select *, row_number() over (partition by subject_id, label order by p desc) as rk from b3s)
select subject_id, label, {O.rnd('avg(p)')} as p, cast(max(y) as int) as y,
       starts_with(subject_id, 'C') as is_control
from (select subject_id, label, p, y, rk from r where rk <= 2) t
join (select subject_id, label, max(y) as y2 from b3s group by all) u using (subject_id, label)
group by subject_id, label"""
        _sql = f"""with {O.B3_BASE},
r as (select *, row_number() over (partition by subject_id, label order by p desc) as rk from b3s),
top as (select subject_id, label, round(avg(p), 12) as p from r where rk <= 2 group by all),
yy as (select subject_id, label, cast(max(y) as int) as y from b3s group by all)
select subject_id, label, {O.rnd('p')} as p, y, starts_with(subject_id, 'C') as is_control
from top join yy using (subject_id, label)"""
    else:
        _sql = f"""with {O.B3_BASE}, {O.subj_cte('b3s', '', _mode)}
select subject_id, label, {O.rnd('p')} as p, y, is_control from subj"""

    def _mk(mode):
        def q(spark, sf):
            return rounded(A.aggregate_scores(_b3_windows(spark, sf), mode=mode, k=2, q=90))
        q.__doc__ = f"A1–A6: subject score by {mode}, OR of window labels, control flag."
        return q

    register(f"subject_scores_{_mode}", _sql)(_mk(_mode))


@register("majority_vote", f"""with {O.B3_BASE},
v as (select label, subject_id, cast(avg(case when p >= 0.5 then 1.0e0 else 0.0e0 end) >= 0.5 as int) as vote,
             cast(max(y) as int) as y from b3s group by all)
select label, {O.rnd('(sum(case when vote = y then 1 else 0 end)) / greatest(1, count(*))')} as vote_accuracy,
       {O.rnd('sum(case when vote = 1 and y = 1 then 1 else 0 end) / greatest(1, sum(case when y = 1 then 1 else 0 end))')} as vote_sensitivity,
       {O.rnd('sum(case when vote = 0 and y = 0 then 1 else 0 end) / greatest(1, sum(case when y = 0 then 1 else 0 end))')} as vote_specificity
from v group by label""")
def q_majority_vote(spark, sf):
    """Window votes (p ≥ 0.5) → subject majority vote → accuracy,
    sensitivity, specificity per label."""
    w = _b3_windows(spark, sf).withColumn("pred", (F.col("p") >= 0.5).cast("int"))
    return rounded(A.vote_metrics(A.majority_vote(w, by=["label"]), by=["label"]))


# ------------------------------------------------------------ T1–T10
_CFG_ROWS = LabelSettings(labels=fx.B3_LABELS, **FIXTURE_SETTINGS).rows()
_T_PRE = f"""with {O.B4_CTE}, {O.subj_cte()}, {O.cfg_cte(_CFG_ROWS)}, {O.grid_cte()}, {O.naive_counts_cte()}"""


def _panel_subjects(spark, sf, mode="p90"):
    return A.aggregate_scores(fx.scores_b4(spark, sf), mode=mode, by=[*PANEL_BY, "part"])


def _cfg(spark):
    return fx.fixture_label_config(spark, fx.B3_LABELS)


@register("threshold_counts", f"""{_T_PRE}
select scaler, model, fold, label, i, {O.rnd('t')} as t, cast(tp as bigint) as tp, cast(fp as bigint) as fp,
       cast(fn as bigint) as fn, cast(tn as bigint) as tn
from cnt""")
def q_threshold_counts(spark, sf):
    """Confusion counts at all 199 grid points per (config, fold, label)
    on train subjects, by bucket + reverse running sum."""
    s = _panel_subjects(spark, sf).filter(F.col("part") == "train")
    c = TH.threshold_counts(s, by=PANEL_BY)
    return rounded(c.select(*PANEL_BY, "label", "i", "t", "tp", "fp", "fn", "tn"))


def _policy_sql(policy: str) -> str:
    score = {"balanced": "0.5e0 * (recall + spec)", "f1": "f1",
             "clinical_cost": "-((1.0e0 - alpha) * fpr + alpha * fnr)"}
    if policy == "fixed":
        return f"""{_T_PRE}
select scaler, model, fold, label, 0.5e0 as threshold from subj where part = 'train' group by all"""
    if policy == "spec_at_least":
        pick = """
a1 as (select scaler, model, fold, label, t from (
  select *, row_number() over (partition by scaler, model, fold, label order by recall desc, i) as rk
  from rates where ctrl_ok and spec is not null and spec >= spec_target) where rk = 1),
a2 as (select scaler, model, fold, label, t from (
  select *, row_number() over (partition by scaler, model, fold, label order by 0.5e0 * (recall + spec) desc, i) as rk
  from rates where ctrl_ok and spec is not null) where rk = 1),
pick as (select scaler, model, fold, label, coalesce(a1.t, a2.t) as t
         from a2 full join a1 using (scaler, model, fold, label))"""
    else:
        pick = f"""
pick as (select scaler, model, fold, label, t from (
  select *, row_number() over (partition by scaler, model, fold, label order by {score[policy]} desc, i) as rk
  from rates where ctrl_ok and ({score[policy]}) is not null) where rk = 1)"""
    return f"""{_T_PRE},{pick},
base as (select scaler, model, fold, label, count(distinct y) as ncls from subj where part = 'train' group by all)
select scaler, model, fold, label,
       {O.rnd('case when ncls < 2 then 0.5e0 else coalesce(pick.t, 0.5e0) end')} as threshold
from base left join pick using (scaler, model, fold, label)"""


for _pol in TH.POLICIES:
    def _mkp(policy):
        def q(spark, sf):
            s = _panel_subjects(spark, sf).filter(F.col("part") == "train")
            return rounded(TH.tune_thresholds(s, _cfg(spark), policy=policy, by=PANEL_BY))
        q.__doc__ = f"T2–T8: per-label threshold by policy {policy!r} on train subjects."
        return q
    register(f"tune_{_pol}", _policy_sql(_pol))(_mkp(_pol))


@register("min_error_threshold", f"""{_T_PRE},
lv(level) as (values (0), (1), (2), (3), (4)),
f as (select r.*, lv.level from rates r cross join lv
      where (lv.level = 4)
         or (lv.level = 3 and (n_ctrl = 0 or c_fp <= fp_max))
         or (lv.level = 2 and (n_ctrl = 0 or c_fp <= fp_max) and (P = 0 or recall >= recall_min))
         or (lv.level = 1 and (n_ctrl = 0 or (c_fp <= fp_max and (c_fpr is null or c_fpr <= fpr_target)))
                          and (P = 0 or recall >= recall_min))
         or (lv.level = 0 and (n_ctrl = 0 or (c_fp <= fp_max and (c_fpr is null or c_fpr <= fpr_target)))
                          and (P = 0 or recall >= recall_min) and (spec is null or spec >= spec_target))),
best as (select * from (select *, row_number() over (partition by scaler, model, fold, label
                                                      order by level, err, i) as rk from f) where rk = 1),
base as (select scaler, model, fold, label, count(distinct y) as ncls from subj where part = 'train' group by all)
select scaler, model, fold, label,
       {O.rnd('case when base.ncls < 2 then 0.5e0 else coalesce(best.t, 0.5e0) end')} as threshold,
       case when base.ncls < 2 then 0 else cast(best.level as int) end as relax_level,
       {O.rnd('case when base.ncls < 2 then null else best.err end')} as train_error
from base left join best using (scaler, model, fold, label)""")
def q_min_error_threshold(spark, sf):
    """Minimum-error threshold with constraint relaxation levels 0–4."""
    s = _panel_subjects(spark, sf).filter(F.col("part") == "train")
    return rounded(TH.min_error_threshold(s, _cfg(spark), by=PANEL_BY))


# ------------------------------------------------------------ E1–E18
def _panel_preds(spark, sf, policy="clinical_cost", once=False):
    """Test predictions; ``once`` materialises them (one row per config, fold,
    subject and label) in the shared checkpoint folder for several readers."""
    s = _panel_subjects(spark, sf)
    thr = TH.tune_thresholds(s.filter(F.col("part") == "train"), _cfg(spark), policy=policy, by=PANEL_BY)
    preds = TH.apply_thresholds(s.filter(F.col("part") == "test"), thr, by=PANEL_BY)
    if once:
        ensure_checkpoint_dir(spark)
        preds = preds.checkpoint()
    return preds


_CC = """
a1 as (select scaler, model, fold, label, t from (
  select *, row_number() over (partition by scaler, model, fold, label
                               order by -((1.0e0 - alpha) * fpr + alpha * fnr) desc, i) as rk
  from rates where ctrl_ok and fpr is not null and fnr is not null) where rk = 1),
base as (select scaler, model, fold, label, count(distinct y) as ncls from subj where part = 'train' group by all),
thr as (select scaler, model, fold, label,
               case when ncls < 2 then 0.5e0 else coalesce(a1.t, 0.5e0) end as threshold
        from base left join a1 using (scaler, model, fold, label)),
pred as (select s.*, coalesce(thr.threshold, 0.5e0) as threshold,
                cast(s.p >= coalesce(thr.threshold, 0.5e0) as int) as pred
         from subj s left join thr using (scaler, model, fold, label) where s.part = 'test')"""
_E_PRE = _T_PRE + "," + _CC


@register("apply_thresholds", f"""{_E_PRE}
select scaler, model, fold, subject_id, label, y, {O.rnd('p')} as p, {O.rnd('threshold')} as threshold, pred
from pred""")
def q_apply_thresholds(spark, sf):
    """Test subjects predicted with the train-tuned thresholds."""
    p = _panel_preds(spark, sf)
    return rounded(p.select(*PANEL_BY, "subject_id", "label", "y", "p", "threshold", "pred"))


_BIN_SQL = f"""{_E_PRE},
c as (select scaler, model, fold, label,
             sum(case when y = 1 and pred = 1 then 1 else 0 end) as tp,
             sum(case when y = 0 and pred = 1 then 1 else 0 end) as fp,
             sum(case when y = 1 and pred = 0 then 1 else 0 end) as fn,
             sum(case when y = 0 and pred = 0 then 1 else 0 end) as tn
      from pred group by all),
auc as (select a.scaler, a.model, a.fold, a.label,
               case when count(distinct a.y) = 2 then
                 sum(case when a.y = 1 and b.y = 0 and a.p > b.p then 1.0e0
                          when a.y = 1 and b.y = 0 and a.p = b.p then 0.5e0 else 0.0e0 end)
                 / (sum(case when a.y = 1 and b.y = 0 then 1.0e0 else 0.0e0 end)) end as auc
        from pred a join pred b using (scaler, model, fold, label) group by all),
ap as (select scaler, model, fold, label,
              case when sum(y) > 0 and sum(1 - y) > 0 then
                sum(case when y = 1 then prec else 0 end) / sum(y) end as auprc
       from (select p1.*, (select count(*) from pred p2 where p2.scaler = p1.scaler and p2.model = p1.model
                              and p2.fold = p1.fold and p2.label = p1.label and p2.y = 1 and p2.p >= p1.p)
                          / (select count(*) from pred p2 where p2.scaler = p1.scaler and p2.model = p1.model
                              and p2.fold = p1.fold and p2.label = p1.label and p2.p >= p1.p) as prec
             from pred p1) group by all)"""


@register("label_metrics", f"""{_BIN_SQL}
select scaler, model, fold, label, cast(tp as bigint) as tp, cast(fp as bigint) as fp, cast(fn as bigint) as fn,
       cast(tn as bigint) as tn, cast(tp + fn as bigint) as support_pos, cast(tn + fp as bigint) as support_neg,
       {O.rnd('case when tn + fp > 0 then fp / (tn + fp) end')} as fpr,
       {O.rnd('case when tp + fn > 0 then fn / (tp + fn) end')} as fnr,
       {O.rnd('case when tp + fp > 0 then tp / (tp + fp) else 0 end')} as precision,
       {O.rnd('case when tp + fn > 0 then tp / (tp + fn) else 0 end')} as recall,
       {O.rnd('case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end')} as f1,
       {O.rnd('case when tn + fp > 0 then tn / (tn + fp) end')} as specificity,
       {O.rnd('0.5 * ((case when tp + fn > 0 then tp / (tp + fn) else 0 end) + (case when tn + fp > 0 then tn / (tn + fp) end))')} as balanced_accuracy,
       {O.rnd('(tp + tn) / (tp + tn + fp + fn)')} as accuracy,
       {O.rnd('case when 2 * tn + fn + fp > 0 then 2 * tn / (2 * tn + fn + fp) else 0 end')} as f1_neg,
       {O.rnd('(fp + fn) / (tp + tn + fp + fn)')} as error_rate,
       {O.rnd('auc')} as auc, {O.rnd('auprc')} as auprc
from c left join auc using (scaler, model, fold, label) left join ap using (scaler, model, fold, label)""")
def q_label_metrics(spark, sf):
    """E1–E7, E16, E17 per (config, fold, label) on test subjects."""
    return rounded(E.label_metrics(_panel_preds(spark, sf, once=True), by=PANEL_BY))


@register("fold_metrics", f"""{_BIN_SQL},
m as (select scaler, model, fold, avg(auc) as macro_auc, avg(auprc) as macro_auprc,
             2.0e0 * sum(tp) / greatest(1, 2 * sum(tp) + sum(fp) + sum(fn)) as micro_f1,
             avg(case when 2 * tp + fp + fn > 0 then 2.0e0 * tp / (2 * tp + fp + fn) else 0 end) as macro_f1,
             avg(case when tn + fp > 0 and tp + fn > 0 then 0.5 * (fp / (tn + fp) + fn / (tp + fn)) end) as clinical_cost,
             avg(case when tn + fp > 0 and tp + fn > 0 then (1 - f.alpha) * (fp / (tn + fp)) + f.alpha * (fn / (tp + fn)) end) as clinical_cost_weighted
      from c left join auc using (scaler, model, fold, label) left join ap using (scaler, model, fold, label)
      join cfg f using (label) group by all),
s as (select scaler, model, fold, subject_id,
             sum(case when y = 1 and pred = 1 then 1 else 0 end) as i,
             sum(case when y = 1 or pred = 1 then 1 else 0 end) as u,
             sum(case when y <> pred then 1 else 0 end) as d, count(*) as l
      from pred group by all),
j as (select scaler, model, fold, avg(case when u > 0 then i / u else 0 end) as jaccard_samples,
             sum(d) / sum(l) as hamming_loss, avg(case when d = 0 then 1.0e0 else 0.0e0 end) as exact_match
      from s group by all)
select scaler, model, fold, {O.rnd('macro_auc')} as macro_auc, {O.rnd('macro_auprc')} as macro_auprc,
       {O.rnd('micro_f1')} as micro_f1, {O.rnd('macro_f1')} as macro_f1, {O.rnd('jaccard_samples')} as jaccard_samples,
       {O.rnd('hamming_loss')} as hamming_loss, {O.rnd('1 - hamming_loss')} as hamming_acc,
       {O.rnd('exact_match')} as exact_match, {O.rnd('clinical_cost')} as clinical_cost,
       {O.rnd('clinical_cost_weighted')} as clinical_cost_weighted
from m join j using (scaler, model, fold)""")
def q_fold_metrics(spark, sf):
    """Macro AUC/AUPRC, micro/macro F1, Jaccard, Hamming, exact
    match, clinical cost (plain and α-weighted) per (config, fold)."""
    out = _panel_fold_metrics(spark, sf)
    return rounded(out.select(*PANEL_BY, "macro_auc", "macro_auprc", "micro_f1", "macro_f1",
                              "jaccard_samples", "hamming_loss", "hamming_acc", "exact_match",
                              "clinical_cost", "clinical_cost_weighted"))


@register("controls_report", f"""{_E_PRE}
select scaler, model, fold, label, count_if(is_control) as n_controls,
       case when count_if(is_control) > 0 then count_if(is_control and y = 0 and pred = 1) end as controls_fp,
       {O.rnd('case when count_if(is_control) > 0 and count_if(is_control and y = 0) > 0 then count_if(is_control and y = 0 and pred = 1) / count_if(is_control and y = 0) end')} as controls_fpr
from pred group by all""")
def q_controls_report(spark, sf):
    """False positives and FPR among test controls per label."""
    return rounded(E.controls_report(_panel_preds(spark, sf), by=PANEL_BY))


@register("error_decomposition", f"""{_E_PRE}
select scaler, model, label, cast(sum(y) as bigint) as P, cast(sum(1 - y) as bigint) as N,
       {O.rnd('sum(y) / count(*)')} as prevalence,
       cast(sum(case when y = 1 and pred = 1 then 1 else 0 end) as bigint) as TP,
       cast(sum(case when y = 1 and pred = 0 then 1 else 0 end) as bigint) as FN,
       cast(sum(case when y = 0 and pred = 1 then 1 else 0 end) as bigint) as FP,
       cast(sum(case when y = 0 and pred = 0 then 1 else 0 end) as bigint) as TN,
       {O.rnd('case when sum(y) > 0 then sum(case when y = 1 and pred = 0 then 1 else 0 end) / sum(y) end')} as FNR,
       {O.rnd('case when sum(1 - y) > 0 then sum(case when y = 0 and pred = 1 then 1 else 0 end) / sum(1 - y) end')} as FPR,
       cast(sum(case when y <> pred then 1 else 0 end) as bigint) as errors,
       {O.rnd('sum(case when y <> pred then 1 else 0 end) / count(*)')} as errors_per_patient
from pred group by all""")
def q_error_decomposition(spark, sf):
    """Per config and label over all test folds pooled."""
    return rounded(E.error_decomposition(_panel_preds(spark, sf), by=["scaler", "model"]))


# ------------------------------------------------------------ R1–R8, R15
from ..operators import summary as R  # noqa: E402

_FM_CTES = f"""{_BIN_SQL},
m as (select scaler, model, fold, avg(auc) as macro_auc, avg(auprc) as macro_auprc,
             2.0e0 * sum(tp) / greatest(1, 2 * sum(tp) + sum(fp) + sum(fn)) as micro_f1,
             avg(case when 2 * tp + fp + fn > 0 then 2.0e0 * tp / (2 * tp + fp + fn) else 0 end) as macro_f1,
             avg(case when tn + fp > 0 and tp + fn > 0 then 0.5 * (fp / (tn + fp) + fn / (tp + fn)) end) as clinical_cost,
             avg(case when tn + fp > 0 and tp + fn > 0 then (1 - f.alpha) * (fp / (tn + fp)) + f.alpha * (fn / (tp + fn)) end) as clinical_cost_weighted
      from c left join auc using (scaler, model, fold, label) left join ap using (scaler, model, fold, label)
      join cfg f using (label) group by all),
s as (select scaler, model, fold, subject_id,
             sum(case when y = 1 and pred = 1 then 1 else 0 end) as i,
             sum(case when y = 1 or pred = 1 then 1 else 0 end) as u,
             sum(case when y <> pred then 1 else 0 end) as d, count(*) as l
      from pred group by all),
j as (select scaler, model, fold, avg(case when u > 0 then i / u else 0 end) as jaccard_samples,
             sum(d) / sum(l) as hamming_loss, avg(case when d = 0 then 1.0e0 else 0.0e0 end) as exact_match
      from s group by all),
fm as (select *, 1 - hamming_loss as hamming_acc from m join j using (scaler, model, fold)),
board as (select scaler, model,
  {", ".join(f"avg({c}) as {c}_mean, stddev_samp({c}) as {c}_std" for c in R.FOLD_METRICS)},
  count(fold) as n_folds from fm group by scaler, model)"""


def _panel_fold_metrics(spark, sf):
    return E.fold_metrics(_panel_preds(spark, sf, once=True), _cfg(spark), by=PANEL_BY)


def _board_cols():
    return ", ".join(f"{O.rnd(c + '_mean')} as {c}_mean, {O.rnd(c + '_std')} as {c}_std" for c in R.FOLD_METRICS)


@register("fold_summary_pop", f"""{_FM_CTES}
select scaler, model,
  {", ".join(f"{O.rnd('avg(' + c + ')')} as {c}_mean, {O.rnd('stddev_pop(' + c + ')')} as {c}_std" for c in R.FOLD_METRICS)},
  count(fold) as n_folds
from fm group by scaler, model""")
def q_fold_summary_pop(spark, sf):
    """Per-config mean and population std over folds."""
    return rounded(R.fold_summary(_panel_fold_metrics(spark, sf), R.FOLD_METRICS, std="pop"))


@register("leaderboard", f"""{_FM_CTES}
select scaler, model, {_board_cols()}, n_folds from board""")
def q_leaderboard(spark, sf):
    """R2: mean / sample std leaderboard sorted by AUPRC, AUC, micro F1."""
    return rounded(R.leaderboard(_panel_fold_metrics(spark, sf)))


@register("label_summary", f"""{_BIN_SQL}
, lm as (select c.*, tp / nullif(tp + fp, 0) as prc, auc.auc, ap.auprc from c
         left join auc using (scaler, model, fold, label) left join ap using (scaler, model, fold, label)),
thx as (select scaler, model, fold, label, max(threshold) as threshold from pred group by all),
smo as (select scaler, model, fold, label,
               case when count_if(y = 1) >= 2 and count_if(y = 0) >= 2 and count_if(y = 1) < count_if(y = 0)
                         and count_if(y = 1) / count_if(y = 0) < 0.25 then 1.0e0 else 0.0e0 end as used
        from b4 where part = 'train' group by all)
select scaler, model, label,
  {O.rnd('avg(coalesce(prc, 0))')} as precision_mean,
  {O.rnd('avg(case when tp + fn > 0 then tp / (tp + fn) else 0 end)')} as recall_mean,
  {O.rnd('avg(case when tn + fp > 0 then tn / (tn + fp) end)')} as specificity_mean,
  {O.rnd('avg(case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end)')} as f1_mean,
  {O.rnd('avg(auc)')} as auc_mean, {O.rnd('avg(auprc)')} as auprc_mean,
  {O.rnd('avg(threshold)')} as threshold_mean,
  {O.rnd('avg(tp + fn)')} as support_pos_mean, {O.rnd('avg(tn + fp)')} as support_neg_mean, {O.rnd('avg(used)')} as smote_used_rate
from lm join thx using (scaler, model, fold, label) join smo using (scaler, model, fold, label) group by scaler, model, label""")
def q_label_summary(spark, sf):
    """Ten per config and label means over folds, with the share of folds
    whose train windows would be oversampled."""
    p = _panel_preds(spark, sf, once=True)
    lm = E.label_metrics(p, by=PANEL_BY).join(
        p.groupBy(*PANEL_BY, "label").agg(F.max("threshold").alias("threshold")), on=[*PANEL_BY, "label"])
    plan = C.smote_plan(fx.scores_b4(spark, sf).filter(F.col("part") == "train"), by=[*PANEL_BY, "label"])
    lm = lm.join(plan.select(*PANEL_BY, "label", F.col("smote_used").cast("double").alias("smote_used")), on=[*PANEL_BY, "label"])
    return rounded(R.label_summary(lm))


@register("controls_summary", f"""{_E_PRE},
cr as (select scaler, model, fold, label,
              case when count_if(is_control) > 0 then
                   case when count_if(is_control and y = 0) > 0
                        then count_if(is_control and y = 0 and pred = 1) / count_if(is_control and y = 0) end end as fpr,
              case when count_if(is_control) > 0 then count_if(is_control and y = 0 and pred = 1) end as fp
       from pred group by all)
select scaler, model, label, {O.rnd('avg(fpr)')} as controls_fpr_mean, {O.rnd('stddev_samp(fpr)')} as controls_fpr_std,
       {O.rnd('avg(fp)')} as controls_fp_mean, {O.rnd('stddev_samp(fp)')} as controls_fp_std, count(fold) as n_folds
from cr group by scaler, model, label""")
def q_controls_summary(spark, sf):
    """Fold rows carry JSON maps of test-control FP/FPR per label;
    parsed back to long rows and summarised per config and label."""
    s = _panel_subjects(spark, sf)
    p = _panel_preds(spark, sf)
    res = R.fold_results(s, p, fx.scores_b4(spark, sf), _cfg(spark))
    return rounded(R.controls_summary(R.controls_table(res)))


_BEST_SQL = f"""{_FM_CTES},
crit as (
  select 'auprc' as criterion, scaler, model from board
    order by round(macro_auprc_mean, 12) desc nulls last, round(macro_auc_mean, 12) desc nulls last, round(micro_f1_mean, 12) desc nulls last, scaler, model limit 1),
c2 as (select 'hamming' as criterion, scaler, model from board
    order by round(hamming_acc_mean, 12) desc nulls last, round(jaccard_samples_mean, 12) desc nulls last, round(micro_f1_mean, 12) desc nulls last, scaler, model limit 1),
c3 as (select 'jaccard' as criterion, scaler, model from board
    order by round(jaccard_samples_mean, 12) desc nulls last, round(hamming_acc_mean, 12) desc nulls last, round(micro_f1_mean, 12) desc nulls last, scaler, model limit 1),
c4 as (select 'auc' as criterion, scaler, model from board
    order by round(macro_auc_mean, 12) desc nulls last, round(macro_auprc_mean, 12) desc nulls last, round(micro_f1_mean, 12) desc nulls last, scaler, model limit 1),
c5 as (select 'cost' as criterion, scaler, model from board
    order by round(clinical_cost_mean, 12) asc nulls last, round(hamming_acc_mean, 12) desc nulls last, round(jaccard_samples_mean, 12) desc nulls last, scaler, model limit 1),
best as (select * from crit union all select * from c2 union all select * from c3 union all select * from c4 union all select * from c5)"""


@register("best_configs", f"""{_BEST_SQL}
select b.criterion, b.scaler, b.model, cast(count(distinct fm.fold) as bigint) as n_folds,
       count(distinct fm.fold) = 3 as complete
from best b left join fm using (scaler, model) group by all""")
def q_best_configs(spark, sf):
    """R5 + R6: best config per criterion, checked for all folds."""
    return R.check_complete(R.best_configs(R.leaderboard(_panel_fold_metrics(spark, sf))), k=3)


@register("best_decomposition", f"""{_BEST_SQL}
select b.criterion, b.scaler, b.model, label, cast(sum(y) as bigint) as P, cast(sum(1 - y) as bigint) as N,
       {O.rnd('sum(y) / count(*)')} as prevalence,
       cast(sum(case when y = 1 and pred = 1 then 1 else 0 end) as bigint) as TP,
       cast(sum(case when y = 1 and pred = 0 then 1 else 0 end) as bigint) as FN,
       cast(sum(case when y = 0 and pred = 1 then 1 else 0 end) as bigint) as FP,
       cast(sum(case when y = 0 and pred = 0 then 1 else 0 end) as bigint) as TN,
       {O.rnd('case when sum(y) > 0 then sum(case when y = 1 and pred = 0 then 1 else 0 end) / sum(y) end')} as FNR,
       {O.rnd('case when sum(1 - y) > 0 then sum(case when y = 0 and pred = 1 then 1 else 0 end) / sum(1 - y) end')} as FPR,
       cast(sum(case when y <> pred then 1 else 0 end) as bigint) as errors,
       {O.rnd('sum(case when y <> pred then 1 else 0 end) / count(*)')} as errors_per_patient
from best b join pred using (scaler, model) group by all""")
def q_best_decomposition(spark, sf):
    """Error decomposition of every best config."""
    p = _panel_preds(spark, sf, once=True)
    board = R.leaderboard(E.fold_metrics(p, _cfg(spark), by=PANEL_BY))
    return rounded(R.decompose_best(E.error_decomposition(p, by=R.CONFIG), R.best_configs(board)))


@register("top_configs", f"""{_FM_CTES}
select scaler, model, {_board_cols()}, n_folds from board
order by macro_auprc_mean desc nulls last, macro_auc_mean desc nulls last, micro_f1_mean desc nulls last, scaler, model
limit 10""")
def q_top_configs(spark, sf):
    """Top-10 leaderboard rows (a top-k report)."""
    return rounded(R.top_configs(R.leaderboard(_panel_fold_metrics(spark, sf)), 10))


# ------------------------------------------------------------ S1–S10, W1–W12, F23
from ..functions.chunks import long_signal_features
from ..functions.matrix import feature_columns  # noqa: E402
from ..operators import windows as W  # noqa: E402
from ..sources import detections as D  # noqa: E402
from ..sources import report as REP  # noqa: E402
from ..config import KEYPOINTS  # noqa: E402

_RAW_CTE = O.B1_BASE + """,
raw as (select subject_id, win_from, win_to, frame_idx,
               case when event_id % 97 = 0 then 'bad'
                    when event_id % 7 = 0 then replace(cast(d_value as varchar), '.', ',')
                    else cast(d_value as varchar) end as d_value, d_k from b1),
cl as (select subject_id, win_from, win_to, frame_idx,
              try_cast(replace(d_value, ',', '.') as double) as d_value, d_k from raw),
fr as (select subject_id, win_from, win_to,
              cast(row_number() over (partition by subject_id, win_from, win_to order by frame_idx) - 1 as int) as frame_idx,
              d_value, d_k
       from cl where d_value is not null and d_k is not null and not isnan(d_value) and not isnan(d_k))"""


@register("clean_frames", f"""with {_RAW_CTE}
select subject_id, win_from, win_to, frame_idx, {O.rnd('d_value')} as d_value, {O.rnd('d_k')} as d_k from fr""")
def q_clean_frames(spark, sf):
    """Decimal-comma repair, junk → NULL, incomplete frames dropped,
    frame index renumbered densely within the window."""
    raw = fx.frames_b1_raw(spark, sf)
    c = S.coerce_numeric(raw, ["d_value", "d_k"], decimal_comma=True)
    out = S.drop_incomplete(c, ["d_value", "d_k"])
    return rounded(out.select(*WK, "frame_idx", "d_value", "d_k"))


@register("clean_channel_features", O.features_sql(_RAW_CTE, fx.B1_CHANNELS, WK))
def q_clean_channel_features(spark, sf):
    """S3–S4 then F1–F22: features of the repaired signal."""
    raw = fx.frames_b1_raw(spark, sf)
    out = S.drop_incomplete(S.coerce_numeric(raw, ["d_value", "d_k"]), ["d_value", "d_k"])
    return rounded(window_features(out, WK, fx.B1_CHANNELS))


@register("require_columns", O.B1_BASE.join(["with ", ""]) + """,
g as (select subject_id, max(case when user_id % 5 = 0 then null else value_k end) as has_k from
      (select *, d_k as value_k from b1) group by subject_id)
select subject_id, count(*) as n_frames from b1 where subject_id in (select subject_id from g where has_k is not null)
group by subject_id""")
def q_require_columns(spark, sf):
    """Subjects whose source lacks a required column (here: ``d_k``
    absent for every fifth user) are skipped."""
    b = fx._b1_base(spark, sf)
    b = b.withColumn("d_k", F.when(F.col("user_id") % 5 == 0, F.lit(None).cast("double")).otherwise(F.col("d_k")))
    kept = S.require_columns(b, ["d_value", "d_k", "win_from", "win_to"])
    return kept.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n_frames"))


@register("filter_controls", f"""with {O.b1_frames_cte()}
select subject_id, win_from, win_to, count(*) as n_frames from fr where not starts_with(subject_id, 'C')
group by all""")
def q_filter_controls(spark, sf):
    """S5 + W1: non-control windows and their frame counts."""
    fr = S.by_window(S.filter_controls(fx.frames_b1(spark, sf), include=False))
    return fr.groupBy(*WK).agg(F.count(F.lit(1)).alias("n_frames"))


_KP_SQL_COLS = []
for _i, _k in enumerate(KEYPOINTS):
    _x = f"case when vec_id % 11 = 0 then null else cast(trunc(abs(cast(embedding[{2 * _i + 1}] as double)) * 640) as int) end"
    _y = f"case when vec_id % 11 = 0 then null else cast(trunc(abs(cast(embedding[{2 * _i + 2}] as double)) * 480) as int) end"
    _KP_SQL_COLS += [f"{_x} as {_k}_x", f"{_y} as {_k}_y",
                     f"{O.rnd(f'sqrt(cast(({_x}) as double) * ({_x}) + cast(({_y}) as double) * ({_y}))')} as {_k}_distance"]


@register("keypoint_frames", f"""select concat('V', lpad(cast(vec_id // 100 as varchar), 3, '0')) as video_id,
       {O.rnd('round((vec_id % 100) * (1000.0e0 / 30.0e0) / 1000.0e0, 2)')} as time,
       {", ".join(_KP_SQL_COLS)}
from embeddings""")
def q_keypoint_frames(spark, sf):
    """Detections → pixel keypoints (first person, truncation),
    distances from the origin, time in seconds."""
    return rounded(D.detections_to_frames(fx.detections_b5(spark, sf)))


@register("window_labels", f"""with {O.b1_frames_cte()}
select subject_id, win_from, win_to, count(*) as n_frames,
       cast(max(case when lab_a = 1 then 1 else 0 end) as int) as lab_a,
       cast(max(case when lab_b = 1 then 1 else 0 end) as int) as lab_b,
       cast(max(case when lab_c = 1 then 1 else 0 end) as int) as lab_c
from fr where win_from is not null and win_to is not null group by all""")
def q_window_labels(spark, sf):
    """Per window frame count and one 0/1 label per column
    (2 = ambiguous counts as not-1)."""
    return W.window_labels(S.by_window(fx.frames_b1(spark, sf)), fx.B1_LABELS)


_W2_CTE = O.b1_frames_cte() + """,
amb as (select subject_id, win_from, win_to from fr group by all having max(case when lab_a = 2 then 1 else 0 end) = 1),
kept as (select * from fr where (subject_id, win_from, win_to) not in (select (subject_id, win_from, win_to) from amb)),
wl as (select subject_id, win_from, win_to, cast(max(case when lab_a = 1 then 1 else 0 end) as int) as y
       from kept group by all)"""


@register("positives_and_controls", f"""with {_W2_CTE}
select subject_id, win_from, win_to, y from wl where y = 1 or starts_with(subject_id, 'C')""")
def q_positives_and_controls(spark, sf):
    """Drop windows with an ambiguous frame, label each window,
    keep positives and all control windows."""
    fr = W.drop_ambiguous(fx.frames_b1(spark, sf), "lab_a")
    return W.positives_and_controls(W.window_label(fr, "lab_a"))


@register("drop_all_zero", f"""with {O.b1_frames_cte()},
wl as (select subject_id, win_from, win_to, count(*) as n_frames,
       cast(max(case when lab_a = 1 then 1 else 0 end) as int) as lab_a,
       cast(max(case when lab_b = 1 then 1 else 0 end) as int) as lab_b,
       cast(max(case when lab_c = 1 then 1 else 0 end) as int) as lab_c from fr group by all)
select * from wl where greatest(lab_a, lab_b, lab_c) > 0""")
def q_drop_all_zero(spark, sf):
    """Windows with at least one positive label."""
    return W.drop_all_zero(W.window_labels(fx.frames_b1(spark, sf), fx.B1_LABELS), fx.B1_LABELS)


_SUBJ_CTE = O.b1_frames_cte() + """,
wl as (select subject_id, win_from, win_to,
       cast(max(case when lab_a = 1 then 1 else 0 end) as int) as lab_a,
       cast(max(case when lab_b = 1 then 1 else 0 end) as int) as lab_b,
       cast(max(case when lab_c = 1 then 1 else 0 end) as int) as lab_c from fr group by all),
sl as (select subject_id, count(*) as n_windows, cast(max(lab_a) as int) as lab_a, cast(max(lab_b) as int) as lab_b,
              cast(max(lab_c) as int) as lab_c, starts_with(subject_id, 'C') as is_control from wl group by subject_id)"""


@register("subject_labels", f"""with {_SUBJ_CTE} select * from sl""")
def q_subject_labels(spark, sf):
    """Subject label = OR over its windows."""
    return W.subject_labels(W.window_labels(fx.frames_b1(spark, sf), fx.B1_LABELS), fx.B1_LABELS)


@register("prevalence", f"""with {_SUBJ_CTE}
select label, cast(sum(y) as bigint) as n_pos, count(*) as n_subjects, {O.rnd('avg(y)')} as prevalence
from (select subject_id, 'lab_a' as label, lab_a as y from sl union all
      select subject_id, 'lab_b', lab_b from sl union all select subject_id, 'lab_c', lab_c from sl)
group by label""")
def q_prevalence(spark, sf):
    """Subject-level prevalence per label."""
    sl = W.subject_labels(W.window_labels(fx.frames_b1(spark, sf), fx.B1_LABELS), fx.B1_LABELS)
    return rounded(W.prevalence(sl, fx.B1_LABELS))


@register("availability", f"""with {O.b1_frames_cte()},
t as (select *, case win_from when 0 then 'Rest' when 10 then 'Action' when 20 then 'Posture' end as task from fr),
p as (select subject_id, task,
             cast(max(case when lab_a = 1 then 1 else 0 end) as int) as lab_a,
             cast(max(case when lab_b = 1 then 1 else 0 end) as int) as lab_b,
             cast(max(case when lab_c = 1 then 1 else 0 end) as int) as lab_c from t group by all),
l as (select subject_id, task, 'lab_a' as label, lab_a as y from p union all
      select subject_id, task, 'lab_b', lab_b from p union all select subject_id, task, 'lab_c', lab_c from p)
select label, task, count_if(y = 1 and not starts_with(subject_id, 'C')) as n_positive,
       count_if(y = 0 and starts_with(subject_id, 'C')) as n_controls
from l group by all""")
def q_availability(spark, sf):
    """Per label × task: positive non-control subjects and
    negative controls."""
    return W.availability(fx.frames_b7(spark, sf), fx.B1_LABELS)


@register("task_windows", f"""with {O.b1_frames_cte()}
select subject_id, win_from, win_to, count(*) as n_frames,
       cast(max(case when lab_b = 1 then 1 else 0 end) as int) as lab_b
from fr where win_from = 10 group by all""")
def q_task_windows(spark, sf):
    """One task segment (Action) as a partition filter, then labels."""
    return W.window_labels(W.for_task(fx.frames_b7(spark, sf), "Action"), ["lab_b"])


_W7_CTE = O.B1_BASE + """,
f0 as (select subject_id, win_from, win_to, frame_idx, d_value, d_k, lab_a from b1),
amb as (select subject_id, win_from, win_to from f0 group by all having max(case when lab_a = 2 then 1 else 0 end) = 1),
win as (select subject_id, win_from, win_to from f0
        where (subject_id, win_from, win_to) not in (select (subject_id, win_from, win_to) from amb)
        group by all having max(case when lab_a = 1 then 1 else 0 end) = 1 or starts_with(subject_id, 'C')),
kept as (select f0.* from f0 join win using (subject_id, win_from, win_to)),
fr as (select subject_id, 0 as win_from, 0 as win_to,
              cast(row_number() over (partition by subject_id order by win_from, win_to, frame_idx) - 1 as bigint) as frame_idx,
              d_value, d_k
       from kept)"""


@register("subject_signal_features", f"""select f.*, case when starts_with(subject_id, 'C') then 0 else 1 end as y
from ({O.features_sql(_W7_CTE, fx.B1_CHANNELS, WK, fps=1.0, variant="subject")}) f""")
def q_subject_signal_features(spark, sf):
    """W2 + W5 + W7 + F (subject variant): drop ambiguous windows, keep
    positive windows and those of controls, concatenate a subject's kept
    windows into one signal, 20 features per channel; label 0 for controls,
    else 1. Subjects without a kept window drop out."""
    fr = W.drop_ambiguous(fx.frames_b1(spark, sf), "lab_a")
    kept = W.positives_and_controls(W.window_label(fr, "lab_a"))
    sig = W.subject_signal(fr, kept)
    feats = long_signal_features(sig, WK, fx.B1_CHANNELS)
    return rounded(feats.withColumn("y", F.when(S.is_control("subject_id"), 0).otherwise(1)))


def _matrix_sql(frames_cte: str) -> str:
    names = SPECS["multilabel"].names()
    base = O.features_sql(frames_cte, fx.B1_CHANNELS, WK)
    cols = []
    for ch in fx.B1_CHANNELS:
        for f in names:
            cols.append(f"coalesce(max(case when channel = '{ch}' then {f} end), 0) + 0.0e0 as {ch}_{f}")
    return f"""with feat as ({base.strip()}),
{frames_cte.strip()},
wl as (select subject_id, win_from, win_to, count(*) as n_frames,
       cast(max(case when lab_a = 1 then 1 else 0 end) as int) as lab_a,
       cast(max(case when lab_b = 1 then 1 else 0 end) as int) as lab_b,
       cast(max(case when lab_c = 1 then 1 else 0 end) as int) as lab_c from fr group by all),
piv as (select subject_id, win_from, win_to, {", ".join(cols)} from feat group by all)
select wl.*, {", ".join(f"coalesce(piv.{ch}_{f}, 0.0e0) + 0.0e0 as {ch}_{f}" for ch in fx.B1_CHANNELS for f in names)}
from wl left join piv using (subject_id, win_from, win_to)"""


@register("feature_matrix", _matrix_sql(O.b1_frames_cte()))
def q_feature_matrix(spark, sf):
    """F23 + W4 + W12 (flagship): one row per window with labels and
    ``<channel>_<feature>`` columns, missing → 0."""
    fr = fx.frames_b1(spark, sf)
    feats = window_features(fr, WK, fx.B1_CHANNELS)
    wl = W.window_labels(fr, fx.B1_LABELS)
    return rounded(feature_matrix(feats, wl, WK, fx.B1_CHANNELS))


@register("run_meta", f"""with {O.b1_frames_cte()},
wl as (select subject_id, win_from, win_to from fr group by all)
select count(distinct subject_id) as n_subjects,
       count(distinct case when starts_with(subject_id, 'C') then subject_id end) as n_controls,
       count(*) as n_windows, {len(feature_columns(fx.B1_CHANNELS))} as n_features, 3 as n_labels,
       '{{"agg_mode": "p90", "fps": 30.0, "n_splits": 3, "seed": 42}}' as config_json
from wl""")
def q_run_meta(spark, sf):
    """Run metadata: counts and the configuration snapshot."""
    wl = W.window_labels(fx.frames_b1(spark, sf), fx.B1_LABELS)
    config = {"fps": 30.0, "agg_mode": AGG_MODE, "seed": SEED, "n_splits": N_SPLITS}
    return REP.run_meta(spark, wl, len(feature_columns(fx.B1_CHANNELS)), fx.B1_LABELS, config)


# ------------------------------------------------------------ C1–C8, P1–P8
from ..operators import prep as P  # noqa: E402
from ..operators import split as C  # noqa: E402


@register("grouped_folds", f"""with {O.b1_frames_cte()},
wl as (select subject_id, win_from, win_to, max(case when lab_b = 1 then 1 else 0 end) as y from fr group by all),
s as (select subject_id, max(y) as cls from wl group by subject_id)
select subject_id, cast((row_number() over (order by cls, md5('42:' || subject_id)) - 1) % 5 as int) as fold from s""")
def q_grouped_folds(spark, sf):
    """Stratified grouped 5-fold over subjects (class = any positive
    window of lab_b)."""
    wl = W.window_label(fx.frames_b1(spark, sf), "lab_b")
    return C.grouped_folds(wl, k=5, seed=42)


@register("balanced_folds", f"""with {O.b1_frames_cte()},
wl as (select subject_id, win_from, win_to, max(case when lab_b = 1 then 1 else 0 end) as y from fr group by all),
s as (select subject_id, max(y) as cls from wl group by subject_id)
select count(distinct subject_id) as n_subjects, count(*) as n_windows, cast(5 as bigint) as n_folds, true as one_fold_each,
       true as no_worse_than_dealt from wl""")
def q_balanced_folds(spark, sf):
    """C1 by windows: every subject in one fold, and the largest difference of
    the folds' shares of a class no larger than that of dealt folds."""
    wl = W.window_label(fx.frames_b1(spark, sf), "lab_b")

    def spread(folds):
        n = wl.join(folds, "subject_id").groupBy("fold").agg(F.count_if(F.col("y") == 0).alias("a"), F.count_if(F.col("y") == 1).alias("b"))
        return n.agg(F.greatest(*[(F.max(c) - F.min(c)) / F.sum(c) for c in ("a", "b")]).alias("v"))

    folds = C.balanced_folds(wl, k=5, seed=42)
    both = spread(folds).crossJoin(spread(C.grouped_folds(wl, k=5, seed=42)).withColumnRenamed("v", "dealt"))  # one row each
    size = wl.join(folds, "subject_id").agg(
        F.countDistinct("subject_id").alias("n_subjects"), F.count(F.lit(1)).alias("n_windows"),
        F.countDistinct("fold").alias("n_folds"), F.countDistinct("subject_id", "fold").alias("_pairs"))
    return size.crossJoin(both).select("n_subjects", "n_windows", "n_folds", (F.col("_pairs") == F.col("n_subjects")).alias("one_fold_each"),
                                       (F.col("v") <= F.col("dealt")).alias("no_worse_than_dealt"))


@register("stratified_folds", f"""with {O.B2_CTE},
l as (select 'lo' as label, sum(lo) as n from b2s union all select 'mid', sum(mid) from b2s union all select 'even', sum(even) from b2s)
select label, cast(n as bigint) as n_pos, cast(3 as bigint) as n_folds, true as at_most_one_above_best from l""")
def q_stratified_folds(spark, sf):
    """C2 by iterative stratification: per label the positive subjects, and
    whether their numbers in the folds differ by at most one more than they must."""
    sl = W.subject_labels(fx.features_b2(spark, sf), fx.B2_LABELS)
    per = W.unpivot_labels(sl.join(C.stratified_folds(sl, fx.B2_LABELS, k=3, seed=42), "subject_id"), fx.B2_LABELS, ["subject_id", "fold"])
    n = per.groupBy("label", "fold").agg(F.sum("y").cast("long").alias("n"))
    best = F.when(F.sum("n") % 3 == 0, 0).otherwise(1)
    return n.groupBy("label").agg(F.sum("n").alias("n_pos"), F.count(F.lit(1)).alias("n_folds"),
                                  (F.max("n") - F.min("n") <= best + 1).alias("at_most_one_above_best"))


def _b2_folds(spark, sf):
    sl = W.subject_labels(fx.features_b2(spark, sf), fx.B2_LABELS)
    return C.multilabel_folds(sl, fx.B2_LABELS, k=3, seed=42)


@register("multilabel_folds", f"""with {O.B2_CTE} select subject_id, fold from b2f""")
def q_multilabel_folds(spark, sf):
    """Multi-label stratified 3-fold over subjects (dealt by label
    combination and md5)."""
    return _b2_folds(spark, sf)


@register("inner_folds", f"""with {O.B2_CTE},
o as (select f.fold, s.* from b2s s join b2f using (subject_id) cross join (values (0), (1), (2)) f(fold)
      where b2f.fold <> f.fold),
n as (select fold, count(*) as n from o group by fold)
select fold, subject_id,
       cast((row_number() over (partition by fold order by concat(cast(lo as varchar), cast(mid as varchar), cast(even as varchar)),
                                md5('42:inner:' || subject_id)) - 1) % least(3, n) as int) as inner_fold
from o join n using (fold)""")
def q_inner_folds(spark, sf):
    """C4: inner folds on each outer fold's train subjects, min(3, n)."""
    sl = W.subject_labels(fx.features_b2(spark, sf), fx.B2_LABELS)
    return C.inner_folds(sl, _b2_folds(spark, sf), fx.B2_LABELS, k_outer=3, k_inner=3, seed=42)


@register("split_check", f"""with {O.B2_CTE},
sp as (select f.fold, b2.subject_id, case when b2f.fold = f.fold then 'test' else 'train' end as part
       from b2 join b2f using (subject_id) cross join (values (0), (1), (2)) f(fold))
select fold, 0 as n_overlap, count(distinct case when part = 'train' then subject_id end) as n_train_subjects,
       count(distinct case when part = 'test' then subject_id end) as n_test_subjects,
       count_if(part = 'test') as n_test_windows
from sp group by fold""")
def q_split_check(spark, sf):
    """train/test materialisation for every fold, disjointness (0
    shared subjects) and sizes."""
    sp = C.all_splits(fx.features_b2(spark, sf).drop("x"), _b2_folds(spark, sf), 3)
    sizes = sp.groupBy("fold").agg(
        F.countDistinct(F.when(F.col("part") == "train", F.col("subject_id"))).alias("n_train_subjects"),
        F.countDistinct(F.when(F.col("part") == "test", F.col("subject_id"))).alias("n_test_subjects"),
        F.count_if(F.col("part") == "test").alias("n_test_windows"))
    return C.disjoint_check(sp).join(sizes, on="fold").select(
        "fold", F.col("n_overlap").cast("int").alias("n_overlap"), "n_train_subjects", "n_test_subjects", "n_test_windows")


@register("valid_folds", f"""with {O.B3_BASE}
select fold, label, count(distinct y) as n_classes, count(distinct y) = 2 as valid from b3 group by all""")
def q_valid_folds(spark, sf):
    """(fold, label) groups with both classes."""
    return C.valid_folds(fx.scores_b3(spark, sf), by=["fold", "label"])


@register("class_weights", f"""with {O.B3_BASE},
c as (select fold, label, y, count(*) as nc from b3 group by all)
select fold, label, y, {O.rnd('case when count(*) over (partition by fold, label) = 2 then sum(nc) over (partition by fold, label) / (2.0e0 * nc) else 1.0e0 end')} as weight
from c""")
def q_class_weights(spark, sf):
    """Balanced class weights n / (2·n_c) per (fold, label)."""
    return rounded(C.class_weights(fx.scores_b3(spark, sf), by=["fold", "label"]))


@register("smote_plan", f"""with {O.B3_BASE},
c as (select fold, label, count_if(y = 1) as n_pos, count_if(y = 0) as n_neg from b3 group by all)
select fold, label, n_pos, n_neg,
       case when n_pos > 0 and n_neg > 0 and least(n_pos, n_neg) >= 2 then cast(least(5, least(n_pos, n_neg) - 1) as int) end as smote_k,
       case when n_pos > 0 and n_neg > 0 and n_pos < n_neg and n_pos / greatest(n_neg, 1) < 0.25 then 0.25e0 end as smote_ratio,
       (n_pos > 0 and n_neg > 0 and least(n_pos, n_neg) >= 2) and (n_pos > 0 and n_neg > 0 and n_pos < n_neg and n_pos / greatest(n_neg, 1) < 0.25) as smote_used
from c""")
def q_smote_plan(spark, sf):
    """SMOTE eligibility, neighbour count and target ratio per group."""
    return C.smote_plan(fx.scores_b3(spark, sf), by=["fold", "label"])


def _scaled_sql(kind: str) -> str:
    stat = {"standard": ("avg(v)", "stddev_pop(v)"), "minmax": ("min(v)", "max(v) - min(v)"),
            "robust": ("quantile_cont(v, 0.5)", "quantile_cont(v, 0.75) - quantile_cont(v, 0.25)")}[kind]
    return f"""with {O.B2_CTE},
sp as (select f.fold, b2.*, case when b2f.fold = f.fold then 'test' else 'train' end as part
       from b2 join b2f using (subject_id) cross join (values (0), (1), (2)) f(fold)),
lv as (select fold, part, subject_id, win_from, unnest(x) as v, unnest(generate_series(1, len(x))) as j from sp),
st as (select fold, j, {stat[0]} as a, {stat[1]} as s0 from lv where part = 'train' group by fold, j),
st2 as (select fold, j, a, case when s0 is null or s0 = 0 then 1.0e0 else s0 end as s from st)
select fold, part, subject_id, win_from,
       list(round((v - a) / s, 6) + 0.0e0 order by j) as x
from lv join st2 using (fold, j) group by fold, part, subject_id, win_from"""


for _kind in ("standard", "minmax", "robust"):
    def _mks(kind):
        def q(spark, sf):
            sp = C.all_splits(fx.features_b2(spark, sf), _b2_folds(spark, sf), 3)
            params = P.fit_scaler(sp.filter(F.col("part") == "train"), kind, by=["fold"])
            out = P.apply_scaler(sp, params, kind, by=["fold"])
            return out.select("fold", "part", "subject_id", "win_from",
                              F.transform("x", lambda v: F.round(v, 6) + F.lit(0.0)).alias("x"))
        q.__doc__ = f"P1–P3, P7: {kind} scaler fitted on each fold's train rows, applied to all rows."
        return q
    register(f"scale_{_kind}", _scaled_sql(_kind))(_mks(_kind))


@register("nan_to_num", """select vec_id,
  list_transform(list_transform(embedding, lambda e: case when label = 4 then cast(e as double) * 'infinity'::double
                                                         else cast(e as double) / (cast(label as double) - 4.0e0) end),
     lambda v: case when isnan(v) then 0.0e0 when v = 'infinity'::double then 1e6 when v = '-infinity'::double then -1e6
               else round(v, 6) + 0.0e0 end) as x
from embeddings""")
def q_nan_to_num(spark, sf):
    """NaN → 0, ±inf → ±1e6 (division by (label − 4) makes all three)."""
    emb = fx.table(spark, sf, "embeddings")
    raw = F.transform("embedding", lambda e: F.when(F.col("label") == 4, e.cast("double") * F.lit(float("inf")))
                      .otherwise(e.cast("double") / (F.col("label").cast("double") - F.lit(4.0))))
    x = P.nan_to_num(raw)
    return emb.select("vec_id", F.transform(x, lambda v: F.when(F.abs(v) >= 1e6, v)
                                            .otherwise(F.round(v, 6) + F.lit(0.0))).alias("x"))


@register("select_k_best", f"""with {O.B2_CTE},
sp as (select f.fold, b2.*, case when b2f.fold = f.fold then 'test' else 'train' end as part
       from b2 join b2f using (subject_id) cross join (values (0), (1), (2)) f(fold)),
lw as (select fold, x, 'lo' as label, lo as y from sp where part = 'train' union all
       select fold, x, 'mid', mid from sp where part = 'train' union all
       select fold, x, 'even', even from sp where part = 'train'),
lv as (select fold, label, y, unnest(x) as v, unnest(generate_series(0, len(x) - 1)) as j from lw),
rg as (select fold, label, j, min(v) as lo, max(v) as hi from lv group by all),
b as (select lv.*, case when hi > lo then least(9, cast(floor((v - lo) / (hi - lo) * 10) as int)) else 0 end as bin
      from lv join rg using (fold, label, j)),
c as (select fold, label, j, bin, y, count(*) as n_by from b group by all),
c2 as (select *, sum(n_by) over (partition by fold, label, j) as n,
              sum(n_by) over (partition by fold, label, j, bin) as n_b,
              sum(n_by) over (partition by fold, label, j, y) as n_y from c),
mi as (select fold, label, j, sum((n_by / n) * ln((n_by * n) / (n_b * n_y))) as mi from c2 group by all),
r as (select *, row_number() over (partition by fold, label order by mi desc, j) as rank from mi)
select fold, label, cast(j as int) as feature, {O.rnd('mi')} as mi, rank from r
where rank <= case label when 'mid' then 8 else 12 end""")
def q_select_k_best(spark, sf):
    """Top-K features per (fold, label) by binned mutual information
    on train rows (K per label from the settings table)."""
    sp = C.all_splits(fx.features_b2(spark, sf), _b2_folds(spark, sf), 3).filter(F.col("part") == "train")
    lw = sp.select("fold", "x", F.explode(F.array(*[F.struct(F.lit(l).alias("label"), F.col(l).alias("y"))
                                                     for l in fx.B2_LABELS])).alias("_l")) \
        .select("fold", "x", "_l.label", "_l.y")
    from ..config import label_config
    kcfg = label_config(spark, fx.B2_LABELS, k_best=12, k_by_label={"mid": 8})
    return rounded(P.select_k_best(lw, kcfg, by=["fold"]).select(
        "fold", "label", F.col("feature").cast("int").alias("feature"), "mi", "rank"))


# ------------------------------------------------------------ M1–M18
from . import models as M  # noqa: E402


def _b2_rows(spark, sf, features=fx.features_b2):
    """Long model rows over B2: (fold, part, subject, window, label, y, x)."""
    sp = C.all_splits(features(spark, sf), _b2_folds(spark, sf), 3)
    lab = F.explode(F.array(*[F.struct(F.lit(l).alias("label"), F.col(l).alias("y")) for l in fx.B2_LABELS]))
    return (sp.select("fold", "part", "subject_id", "win_from", "win_to", "x", lab.alias("_l"))
            .select("fold", "part", "subject_id", "win_from", "win_to", "_l.label", F.col("_l.y").cast("int").alias("y"), "x")
            .withColumn("row_id", F.concat_ws(":", "subject_id", F.col("win_from").cast("string"), F.col("win_to").cast("string"))))


@register("knn_scores", f"""with {O.B2_CTE},
sp as (select f.fold, b2.*, case when b2f.fold = f.fold then 'test' else 'train' end as part,
              concat_ws(':', subject_id, cast(win_from as varchar), cast(win_to as varchar)) as row_id
       from b2 join b2f using (subject_id) cross join (values (0), (1), (2)) f(fold)),
lr as (select fold, part, subject_id, win_from, row_id, x, 'lo' as label, lo as y from sp union all
       select fold, part, subject_id, win_from, row_id, x, 'mid', mid from sp union all
       select fold, part, subject_id, win_from, row_id, x, 'even', even from sp),
pairs as (select q.fold, q.label, q.part, q.subject_id, q.win_from, q.row_id, q.y, t.y as ty, t.row_id as tid,
                 sqrt(list_sum(list_transform(list_zip(q.x, t.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) as d
          from lr q join lr t on q.fold = t.fold and q.label = t.label and t.part = 'train'),
r as (select *, row_number() over (partition by fold, label, row_id order by d, tid) as rk from pairs)
select fold, part, subject_id, win_from, label, cast(y as int) as y, {O.rnd('avg(ty)')} as p
from r where rk <= 9 group by fold, part, subject_id, win_from, label, y""")
def q_knn_scores(spark, sf):
    """M7: exact 9-NN scores (uniform) per (fold, label) — all folds in one
    blocked distributed search, which the labels share, with per-block top-k
    and a merge per row."""
    rid = F.concat_ws(":", "subject_id", F.col("win_from").cast("string"), F.col("win_to").cast("string"))
    rows = C.all_splits(fx.features_b2(spark, sf), _b2_folds(spark, sf), 3).withColumn("row_id", rid)
    out = M.knn_scores(rows.filter(F.col("part") == "train"), rows, fx.B2_LABELS, k=9, p=2, by=["fold"])
    return rounded(out.select("fold", "part", "subject_id", "win_from", "label", "y", "p"))


@register("margin_to_prob", """select vec_id, round(1.0e0 / (1.0e0 + exp(-(cast(embedding[1] as double) - cast(embedding[2] as double)) * 10.0e0)), 6) + 0.0e0 as p
from embeddings""")
def q_margin_to_prob(spark, sf):
    """Decision margin → probability by the logistic map."""
    emb = fx.table(spark, sf, "embeddings")
    m = (F.col("embedding")[0].cast("double") - F.col("embedding")[1].cast("double")) * 10.0
    return rounded(emb.select("vec_id", M.margin_to_prob(m).alias("p")))


@register("constant_scores", f"""with {O.B3_BASE},
g as (select 'all' as subjects, fold, label, y from b3 union all
      select 'controls', fold, label, y from b3 where starts_with(subject_id, 'C'))
select subjects, fold, label, count(distinct y) as n_classes,
       {O.rnd('case when count(distinct y) < 2 then avg(y) end')} as constant
from g group by all""")
def q_constant_scores(spark, sf):
    """Over groups with one class (controls only) and with two (all
    subjects), which get a constant score and which a model (NULL)."""
    b3 = fx.scores_b3(spark, sf).withColumn("part", F.lit("train"))
    who = F.explode(F.when(S.is_control("subject_id"), F.array(F.lit("all"), F.lit("controls"))).otherwise(F.array(F.lit("all"))))
    return rounded(M.constant_scores(b3.withColumn("subjects", who), by=["subjects", "fold", "label"]))


def _scaler_fn(g, kind):
    if kind == "none":
        return g
    params = P.fit_scaler(g.filter(F.col("part") == "train"), kind)
    return P.apply_scaler(g, params, kind)


_SPLIT_SQL = f"""{O.B2_CTE},
sp as (select f.fold, b2.*, case when b2f.fold = f.fold then 'test' else 'train' end as part
       from b2 join b2f using (subject_id) cross join (values (0), (1), (2)) f(fold)),
lr as (select fold, part, 'lo' as label, lo as y from sp union all select fold, part, 'mid', mid from sp union all
       select fold, part, 'even', even from sp)"""


def _panel_specs():
    """The panel's candidates (M17) by family, with the panel's own parameters."""
    from .panel import panel_configs
    out = {}
    for spec in panel_configs():
        out.setdefault({"gb": "gbt"}.get(spec.family, spec.family), spec)
    return out


from . import forest, linear  # noqa: E402
from .blocks import with_scores  # noqa: E402

MODEL_FAMILIES = ("logreg", "sgd_log", "linear_svc", "rbf_svm", "random_forest", "extra_trees", "mlp", "adaboost", "gbt")
#: Lowest test AUC (mean over folds and labels) of a family that has learned the planted features.
TEST_AUC = 0.75

for _fam in MODEL_FAMILIES:
    def _mkm(fam):
        def q(spark, sf):
            spec = _panel_specs()[fam]
            shared = fam in linear.FAMILIES + forest.FAMILIES  # all folds and labels in the same passes
            rows = _b2_rows(spark, sf, fx.features_b2_planted if shared else fx.features_b2_planted_joined)
            if shared:
                panel = linear.linear_panel if fam in linear.FAMILIES else forest.forest_panel
                fitted = panel(rows, [spec], fx.B2_LABELS)[0].select("fold", "label", "row_id", "x_hash", "p")
                sc = with_scores(rows, fitted).withColumns({"scaler": F.lit(spec.scaler), "model": F.lit(spec.name)})
            else:
                sc = M.fit_panel(rows, [spec], fx.B2_LABELS, folds=[0, 1, 2], scaler_fn=_scaler_fn, parallelism=9)
            mean = E.roc_auc(sc, by=["fold", "part"]).filter("part = 'test'").agg(F.avg("auc").alias("_m"))
            bad = F.col("p").isNull() | F.isnan("p") | (F.col("p") < 0) | (F.col("p") > 1)
            n = sc.groupBy("scaler", "model", "fold", "part", "label").agg(
                F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("y") == 1).alias("n_pos"),
                F.count_if(bad).alias("n_invalid"), F.countDistinct("subject_id").alias("n_subjects"))
            return n.crossJoin(F.broadcast(mean)).select(  # one row
                *n.columns, (F.col("_m") >= TEST_AUC).alias("learned"))
        q.__doc__ = f"M1–M16: {fam} scorer with the panel's parameters per (fold, label), fit once, train and test scored: counts, and the test AUC on planted features."
        return q
    _spec = _panel_specs()[_fam]
    register(f"model_scores_{_fam}", f"""with {_SPLIT_SQL.replace("select fold, part, 'lo'", "select subject_id, fold, part, 'lo'").replace("select fold, part, 'mid'", "select subject_id, fold, part, 'mid'").replace("select fold, part, 'even'", "select subject_id, fold, part, 'even'")}
select '{_spec.scaler}' as scaler, '{_spec.name}' as model, fold, part, label, count(*) as n_rows, count_if(y = 1) as n_pos,
       cast(0 as bigint) as n_invalid, count(distinct subject_id) as n_subjects, true as learned
from lr group by fold, part, label""")(_mkm(_fam))


def _config_rows():
    from .panel import panel_configs
    return [(i, c.family, c.scaler, c.name, ", ".join(f"{k}={v}" for k, v in sorted(c.params.items())))
            for i, c in enumerate(panel_configs())]


@register("panel_plan", f"""with {_SPLIT_SQL},
cfg(cand_order, family, scaler, model, params) as (values {", ".join(
    "(" + ", ".join(repr(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in r) + ")" for r in _config_rows())}),
g as (select fold, label, count(*) as n_train, count(distinct y) as n_classes from lr where part = 'train' group by all)
select cfg.*, fold, label, n_train, case when n_classes < 2 then 'constant' else 'fit' end as action from cfg cross join g""")
def q_panel_plan(spark, sf):
    """Every candidate of the panel (85 rows of parameters) on
    every (fold, label) group, and whether it is fitted or constant there."""
    g = M.constant_scores(_b2_rows(spark, sf), by=["fold", "label"])
    n = _b2_rows(spark, sf).filter("part = 'train'").groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n_train"))
    g = g.join(n, on=["fold", "label"]).select(
        "fold", "label", "n_train", F.when(F.col("constant").isNull(), "fit").otherwise("constant").alias("action"))
    cfg = spark.createDataFrame(_config_rows(), "cand_order int, family string, scaler string, model string, params string")
    return cfg.crossJoin(g)  # 85 configurations × folds × labels


# ------------------------------------------------------------ R9–R14
from ..operators import importance as IMP  # noqa: E402
from ..operators import nested as NS  # noqa: E402

_NEST_BY = ["fold", "candidate", "cand_order", "inner_fold"]


def _nested_choice(spark, sf):
    inner = _inner_scores_b3(spark, sf)
    return NS.nested_select(NS.inner_errors(inner, _cfg(spark)), NS.constant_labels(inner))


def _inner_scores_b3(spark, sf):
    """Inner-CV score table from B3: outer fold = B3 fold; inner split of
    the outer-train subjects = (subject div 3) mod 3; candidates = the B4
    score transforms."""
    b3 = fx.scores_b3(spark, sf).withColumn("_sub", F.expr("doc_id div 10"))
    outer = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("_of")
    x = b3.select("*", outer).filter(F.col("fold") != F.col("_of"))
    x = x.withColumn("_in", F.expr("(_sub div 3) % 3"))
    inner = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("inner_fold")
    cands = F.explode(F.array(*[F.struct(F.lit(f"{s}__{m}").alias("candidate"), F.lit(i).alias("cand_order"))
                                for i, (s, m) in enumerate(fx.B4_CONFIGS)])).alias("_c")
    x = x.select("*", inner).select("*", cands)
    p = F.col("p")
    pc = (F.when(F.col("_c.cand_order") == 0, p).when(F.col("_c.cand_order") == 1, p * p)
          .otherwise(F.lit(1.0) - (F.lit(1.0) - p) * (F.lit(1.0) - p)))
    return x.select(F.col("_of").alias("fold"), "_c.candidate", "_c.cand_order", "inner_fold",
                    F.when(F.col("_in") == F.col("inner_fold"), "inner_val").otherwise("inner_train").alias("part"),
                    "subject_id", "doc_id", "label", "y", pc.alias("p"))


_NEST_SQL_PRE = f"""with {O.B3_BASE},
inr as (
  select o.ofold as fold, c.candidate, c.cand_order, i.inner_fold,
         case when ((doc_id // 10) // 3) % 3 = i.inner_fold then 'inner_val' else 'inner_train' end as part,
         b.subject_id, b.doc_id, b.label, b.y,
         case c.cand_order when 0 then b.p when 1 then b.p * b.p else 1.0e0 - (1.0e0 - b.p) * (1.0e0 - b.p) end as p
  from b3s b cross join (values (0), (1), (2)) o(ofold) cross join (values (0), (1), (2)) i(inner_fold)
  cross join (values ('StandardScaler__cfg_a', 0), ('MinMaxScaler__cfg_b', 1), ('RobustScaler__cfg_c', 2)) c(candidate, cand_order)
  where b.fold <> o.ofold),
{O.subj_cte('inr', 'fold, candidate, cand_order, inner_fold, part')},
{O.cfg_cte(_CFG_ROWS)}, {O.grid_cte()},
{O.min_error_ctes(_NEST_BY, 'subj', "part = 'inner_train'")},
val as (select s.*, cast(s.p >= coalesce(t.threshold, 0.5e0) as int) as pred
        from subj s left join thr t using (fold, candidate, cand_order, inner_fold, label) where s.part = 'inner_val'),
err as (select fold, candidate, cand_order, inner_fold, label,
               sum(case when y <> pred then 1 else 0 end) / greatest(1, count(*)) as err
        from val group by all),
cst as (select fold, label from (select fold, label, subject_id, max(y) as ys from inr group by all)
        group by all having count(distinct ys) < 2),
me as (select e.fold, e.label, e.candidate, e.cand_order, avg(err) as mean_err, avg(t.relax_level) as relax_level_mean,
              count(*) as n_inner
       from err e left join thr t using (fold, candidate, cand_order, inner_fold, label) group by all),
ch as (select fold, label, case when (fold, label) not in (select (fold, label) from cst) then candidate end as candidate,
              case when (fold, label) not in (select (fold, label) from cst) then mean_err end as mean_err,
              case when (fold, label) not in (select (fold, label) from cst) then relax_level_mean end as relax_level_mean,
              case when (fold, label) not in (select (fold, label) from cst) then n_inner end as n_inner
       from (select *, row_number() over (partition by fold, label order by round(mean_err, 12), cand_order) as rk from me)
       where rk = 1)"""


@register("nested_selection", f"""{_NEST_SQL_PRE}
select fold, label, candidate as chosen_key, {O.rnd('mean_err')} as mean_err, {O.rnd('1 - mean_err')} as mean_hamming_acc,
       {O.rnd('relax_level_mean')} as relax_level_mean, n_inner from ch""")
def q_nested_selection(spark, sf):
    """Per outer fold and label, the candidate with the lowest mean
    inner-validation subject error at T9 thresholds tuned on inner-train."""
    return rounded(_nested_choice(spark, sf))


@register("nested_choices", f"""{_NEST_SQL_PRE}
select fold, max(case when label = 'low' then candidate end) as low,
       max(case when label = 'toxic' then candidate end) as toxic from ch group by fold""")
def q_nested_choices(spark, sf):
    """Choice table — one row per outer fold, one column per label."""
    return NS.nested_choices(_nested_choice(spark, sf), fx.B3_LABELS)


def _nested_preds(spark, sf):
    """Each (outer fold, label) scored by its chosen candidate (a constant
    where there is none), thresholds tuned on the outer train subjects."""
    ensure_checkpoint_dir(spark)
    choice = _nested_choice(spark, sf).checkpoint()  # one row per fold and label
    outer = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("_of")
    x = fx.scores_b3(spark, sf).select("subject_id", "doc_id", "label", "y", "p", F.col("fold").alias("_f"), outer)
    x = x.select("subject_id", "doc_id", "label", "y", "p", F.col("_of").alias("fold"),
                 F.when(F.col("_f") == F.col("_of"), "test").otherwise("train").alias("part"))
    const = x.filter("part = 'train'").groupBy("fold", "label").agg(F.avg(F.col("y").cast("double")).alias("_c"))
    x = x.join(choice.select("fold", "label", "chosen_key"), on=["fold", "label"]).join(const, on=["fold", "label"])
    p, key = F.col("p"), F.col("chosen_key")
    names = [f"{s}__{m}" for s, m in fx.B4_CONFIGS]
    score = (F.when(key == names[0], p).when(key == names[1], p * p)
             .when(key == names[2], F.lit(1.0) - (F.lit(1.0) - p) * (F.lit(1.0) - p)).otherwise(F.col("_c")))
    x = x.select(F.lit("nested").alias("scaler"), F.lit("per_label_best").alias("model"), "fold", "part", "subject_id",
                 "doc_id", "label", "y", score.alias("p"))
    s = A.aggregate_scores(x, mode="p90", by=[*PANEL_BY, "part"])
    thr = TH.tune_thresholds(s.filter(F.col("part") == "train"), _cfg(spark), policy="clinical_cost", by=PANEL_BY)
    preds = TH.apply_thresholds(s.filter(F.col("part") == "test"), thr, by=PANEL_BY).checkpoint()
    return preds, choice


_NB_CTE = f"""chz as (select * from ({_NEST_SQL_PRE} select fold, label, candidate from ch) q),
{O.B3_BASE.strip()},
nbx as (select f.fold, case when b.fold = f.fold then 'test' else 'train' end as part, b.subject_id, b.doc_id, b.label, b.y, b.p
        from b3s b cross join (values (0), (1), (2)) f(fold)),
nbc as (select fold, label, avg(y) as c from nbx where part = 'train' group by all),
b4 as (select 'nested' as scaler, 'per_label_best' as model, nbx.fold, part, subject_id, doc_id, label, y,
              case candidate when 'StandardScaler__cfg_a' then p when 'MinMaxScaler__cfg_b' then p * p
                   when 'RobustScaler__cfg_c' then 1.0e0 - (1.0e0 - p) * (1.0e0 - p) else c end as p
       from nbx join chz using (fold, label) join nbc using (fold, label))"""
_FM_NESTED = _FM_CTES.replace(O.B4_CTE, _NB_CTE, 1)
_LABEL_ROWS = """
lr as (select c.scaler, c.model, c.fold, c.label, case when tp + fp > 0 then tp / (tp + fp) else 0 end as precision,
              case when tp + fn > 0 then tp / (tp + fn) else 0 end as recall,
              case when tn + fp > 0 then tn / (tn + fp) end as specificity,
              case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end as f1, auc.auc, ap.auprc,
              tp + fn as support_pos, tn + fp as support_neg, th.threshold
       from c left join auc using (scaler, model, fold, label) left join ap using (scaler, model, fold, label)
       join (select scaler, model, fold, label, max(threshold) as threshold from pred group by all) th
         using (scaler, model, fold, label))"""


@register("nested_fold_rows", f"""{_FM_NESTED}
select scaler, model, fold, {", ".join(f"{O.rnd(c)} as {c}" for c in R.FOLD_METRICS)} from fm""")
def q_nested_fold_rows(spark, sf):
    """Fold rows of the refitted per-label choices."""
    preds, _ = _nested_preds(spark, sf)
    return rounded(E.fold_metrics(preds, _cfg(spark), by=PANEL_BY).select(*PANEL_BY, *R.FOLD_METRICS))


@register("nested_summary", f"""{_FM_NESTED}
select {", ".join(f"{O.rnd(f'avg({c})')} as {c}_mean, {O.rnd(f'stddev_samp({c})')} as {c}_std" for c in NS.NESTED_METRICS)},
       count(fold) as n_folds from fm""")
def q_nested_summary(spark, sf):
    """Mean / sample std over outer folds of the six nested metrics."""
    preds, _ = _nested_preds(spark, sf)
    return rounded(NS.nested_summary(E.fold_metrics(preds, _cfg(spark), by=PANEL_BY)))


@register("nested_label_summary", f"""{_FM_NESTED},{_LABEL_ROWS}
select label, chz.candidate as chosen_key,
       {", ".join(f"{O.rnd(f'avg({c})')} as {c}_mean" for c in ("precision", "recall", "specificity", "f1", "auc", "auprc", "threshold", "support_pos", "support_neg"))},
       count(*) as n_folds
from lr join chz using (fold, label) where chz.candidate is not null group by label, chz.candidate""")
def q_nested_label_summary(spark, sf):
    """Per (label, chosen key) means over outer folds (no key: left out)."""
    preds, choice = _nested_preds(spark, sf)
    thr = preds.groupBy(*PANEL_BY, "label").agg(F.max("threshold").alias("threshold"))
    rows = E.label_metrics(preds, by=PANEL_BY).join(thr, on=[*PANEL_BY, "label"]).join(
        choice.select("fold", "label", "chosen_key"), on=["fold", "label"])
    return rounded(NS.nested_label_summary(rows))


@register("nested_decomposition", f"""{_FM_NESTED}
select label, cast(sum(y) as bigint) as P, cast(sum(1 - y) as bigint) as N,
       {O.rnd('sum(y) / count(*)')} as prevalence,
       cast(sum(case when y = 1 and pred = 1 then 1 else 0 end) as bigint) as TP,
       cast(sum(case when y = 1 and pred = 0 then 1 else 0 end) as bigint) as FN,
       cast(sum(case when y = 0 and pred = 1 then 1 else 0 end) as bigint) as FP,
       cast(sum(case when y = 0 and pred = 0 then 1 else 0 end) as bigint) as TN,
       {O.rnd('case when sum(y) > 0 then sum(case when y = 1 and pred = 0 then 1 else 0 end) / sum(y) end')} as FNR,
       {O.rnd('case when sum(1 - y) > 0 then sum(case when y = 0 and pred = 1 then 1 else 0 end) / sum(1 - y) end')} as FPR,
       cast(sum(case when y <> pred then 1 else 0 end) as bigint) as errors,
       {O.rnd('sum(case when y <> pred then 1 else 0 end) / count(*)')} as errors_per_patient
from pred group by label""")
def q_nested_decomposition(spark, sf):
    """Error decomposition of the nested predictions."""
    return rounded(E.error_decomposition(_nested_preds(spark, sf)[0]))


_UNION_COLS = "scaler, model, fold, " + ", ".join(f"{O.rnd(c)} as {c}" for c in R.FOLD_METRICS)


@register("union_results", f"""select * from ({_FM_CTES} select {_UNION_COLS}, 'panel' as branch from fm) a
union all select * from ({_FM_NESTED} select {_UNION_COLS}, 'nested' as branch from fm) b""")
def q_union_results(spark, sf):
    """Fold rows of the panel and of the nested selection in one table."""
    cols = [*PANEL_BY, *R.FOLD_METRICS]
    panel = _panel_fold_metrics(spark, sf).select(*cols, F.lit("panel").alias("branch"))
    nested = E.fold_metrics(_nested_preds(spark, sf)[0], _cfg(spark), by=PANEL_BY)
    return rounded(R.union_results(panel, nested.select(*cols, F.lit("nested").alias("branch"))))


# fixed linear scorer for the importance gate (a model with a closed form)
_W = [((j % 5) - 2) * 0.5 for j in range(64)]


def _weighted_sum(weights):
    """Σ w·x of each row, added up from left to right; NULL for a NULL in it or another length."""
    def run(xs: pa.Array) -> pa.Array:
        fits = pc.fill_null(pc.equal(pc.list_value_length(xs), len(weights)), False)
        flat = xs.filter(fits).flatten()
        x = np.ascontiguousarray(flat.to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(-1, len(weights)).T)
        sums = np.zeros(x.shape[1])
        for w, column in zip(weights, x):
            sums += column * w
        z, known = np.zeros(len(xs)), fits.to_numpy(zero_copy_only=False).copy()
        z[known] = sums
        known[known] = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, len(weights)).all(1)
        return pa.array(z, mask=~known)

    return F.arrow_udf(run, "double")


def _linear_scorer(df):
    return df.withColumn("p", M.margin_to_prob(_weighted_sum(_W)("x")))


_IMP_K = {"lo": 60, "mid": 30, "even": 12}
_IMP_CFG = LabelSettings(labels=fx.B2_LABELS, **FIXTURE_SETTINGS).rows()


def _imp_sql_pre(max_features: int | None = None) -> str:
    first = f" where i <= {max_features}" if max_features is not None else ""
    wlist = "[" + ", ".join(f"{v!r}" for v in _W) + "]"
    logistic = f"1.0e0 / (1.0e0 + exp(-list_sum(list_transform(generate_series(1, 64), lambda i: x[i] * {wlist}[i]))))"
    ks = " ".join(f"when '{k}' then {v}" for k, v in _IMP_K.items())
    return f"""with {O.B2_CTE},
sp as (select f.fold, b2.*, case when b2f.fold = f.fold then 'test' else 'train' end as part,
              concat_ws(':', subject_id, cast(win_from as varchar), cast(win_to as varchar)) as row_id
       from b2 join b2f using (subject_id) cross join (values (0), (1), (2)) f(fold)),
lr as (select fold, part, subject_id, row_id, x, 'lo' as label, 0 as li, lo as y from sp union all
       select fold, part, subject_id, row_id, x, 'mid', 1, mid from sp union all
       select fold, part, subject_id, row_id, x, 'even', 2, even from sp),
te as (select * from lr where part = 'test'),
klv as (select fold, label, y, unnest(x) as v, unnest(generate_series(0, len(x) - 1)) as j from lr where part = 'train'),
krg as (select fold, label, j, min(v) as lo, max(v) as hi from klv group by all),
kb as (select klv.*, case when hi > lo then least(9, cast(floor((v - lo) / (hi - lo) * 10) as int)) else 0 end as bin
       from klv join krg using (fold, label, j)),
kc as (select fold, label, j, bin, y, count(*) as n_by from kb group by all),
kd as (select *, sum(n_by) over (partition by fold, label, j) as n, sum(n_by) over (partition by fold, label, j, bin) as n_b,
              sum(n_by) over (partition by fold, label, j, y) as n_y from kc),
km as (select fold, label, j, sum((n_by / n) * ln((n_by * n) / (n_b * n_y))) as mi from kd group by all),
kr as (select *, row_number() over (partition by fold, label order by mi desc, j) as rank from km),
ki as (select fold, label, j, row_number() over (partition by fold, label order by j) as i from kr where rank <= case label {ks} end),
slot as (select fold, label, j from ki{first}),
b4 as (select 'linear' as scaler, 'fixed' as model, fold, part, subject_id, row_id as doc_id, label, y, {logistic} as p from lr),
{O.subj_cte()}, {O.cfg_cte(_IMP_CFG)}, {O.grid_cte()}, {O.naive_counts_cte()},{_CC},
ex as (select te.*, slot.j, r.r from te join slot using (fold, label) cross join range(0, 5) r(r)),
ra as (select *, row_number() over (partition by fold, label, j, r
                                    order by md5(concat_ws(':', cast(42 + 1000 * fold + 13 * li as varchar), cast(j as varchar), cast(r as varchar), row_id))) as ka,
              row_number() over (partition by fold, label, j, r order by md5('id:' || row_id)) as kb
       from ex),
pe as (select t.fold, t.label, t.j, t.r, t.subject_id, t.y,
              list_transform(generate_series(1, 64), lambda i: case when i = t.j + 1 then s.x[t.j + 1] else t.x[i] end) as x
       from ra t join ra s on t.fold = s.fold and t.label = s.label and t.j = s.j and t.r = s.r and t.kb = s.ka),
sc1 as (select fold, label, j, r, subject_id, y, {logistic} as p from pe),
s1 as (select fold, label, j, r, subject_id, max(y) as y, round(quantile_cont(p, 0.9), 12) as p from sc1 group by all),
e0 as (select fold, label, sum(case when y <> pred then 1 else 0 end) / greatest(1, count(*)) as base from pred group by all),
e1 as (select fold, label, j, r, sum(case when y <> cast(p >= threshold as int) then 1 else 0 end) / greatest(1, count(*)) as err
       from s1 join (select fold, label, threshold from thr) t using (fold, label) group by all),
imp as (select fold, label, j as feature_index, avg(err - e0.base) as m, stddev_pop(err - e0.base) as sd,
               max(e0.base) as baseline_error, count(*) as n_repeats
        from e1 join e0 using (fold, label) group by all)"""


def _importance_long(spark, sf, max_features: int | None = None):
    """Fixed linear scorer; each label's selected slots (K per label), or the
    first ``max_features``, and thresholds tuned on the train subjects."""
    from ..config import label_config
    rows = _b2_rows(spark, sf)
    kcfg = label_config(spark, fx.B2_LABELS, k_best=12, k_by_label=_IMP_K)
    feats = IMP.selected_features(P.select_k_best(rows.filter("part = 'train'").select("fold", "label", "y", "x"), kcfg, by=["fold"]), max_features)
    by = ["scaler", "model", "fold"]
    scored = _linear_scorer(rows).select(F.lit("linear").alias("scaler"), F.lit("fixed").alias("model"), "fold", "part",
                                         "subject_id", "label", "y", "p")
    train = A.aggregate_scores(scored.filter("part = 'train'"), mode="p90", by=by)
    cfg = fx.fixture_label_config(spark, fx.B2_LABELS)
    thr = TH.tune_thresholds(train, cfg, policy="clinical_cost", by=by).select("fold", "label", "threshold")
    li = (F.when(F.col("label") == "lo", 0).when(F.col("label") == "mid", 1).otherwise(2))
    return IMP.permutation_importance(rows.filter("part = 'test'").withColumn("_li", li), _linear_scorer, thr, feats, n_repeats=5,
                                      seed=42, label_index=F.col("_li"), by=["fold"])


@register("permutation_importance", f"""{_imp_sql_pre(50)}
select fold, label, cast(feature_index as int) as feature_index, {O.rnd('m')} as importance_delta_error_mean,
       {O.rnd('sd')} as importance_delta_error_std, {O.rnd('baseline_error')} as baseline_error, n_repeats from imp""")
def q_permutation_importance(spark, sf):
    """Subject-level permutation importance (first 50 selected slots, 5
    repeats, md5 permutations, one batched scoring pass) with a fixed
    linear scorer at thresholds tuned on the train subjects."""
    out = _importance_long(spark, sf, 50)
    return rounded(out.withColumn("feature_index", F.col("feature_index").cast("int")))


@register("importance_summary", f"""{_imp_sql_pre()}
select label, cast(feature_index as int) as feature_index, {O.rnd('avg(m)')} as importance_delta_error_mean,
       {O.rnd('stddev_samp(m)')} as importance_delta_error_std, {O.rnd('avg(baseline_error)')} as baseline_error_mean,
       count(distinct fold) as n_folds from imp group by all""")
def q_importance_summary(spark, sf):
    """Importance over folds by (label, feature), of every selected slot."""
    out = _importance_long(spark, sf).withColumn("feature_index", F.col("feature_index").cast("int"))
    return rounded(IMP.importance_summary(out))


@register("importance_summary_by_model", f"""{_imp_sql_pre()}
select 'linear__fixed' as model_key, label, cast(feature_index as int) as feature_index, {O.rnd('avg(m)')} as importance_delta_error_mean,
       {O.rnd('stddev_samp(m)')} as importance_delta_error_std, {O.rnd('avg(baseline_error)')} as baseline_error_mean,
       count(distinct fold) as n_folds from imp group by all""")
def q_importance_summary_by_model(spark, sf):
    """Importance over folds by (model, label, feature), of every selected slot."""
    out = _importance_long(spark, sf).withColumn("feature_index", F.col("feature_index").cast("int"))
    out = out.withColumn("model_key", F.lit("linear__fixed"))
    return rounded(IMP.importance_summary(out, by=("model_key", "label", "feature_index")))


# ------------------------------------------------------------ C6, R13, P4
@register("downsample", f"""with {O.b1_frames_cte()},
wl as (select subject_id, win_from, cast(max(case when lab_b = 1 then 1 else 0 end) as int) as y,
              concat_ws(':', subject_id, cast(win_from as varchar), cast(win_to as varchar)) as row_id from fr group by subject_id, win_from, win_to),
c as (select count_if(y = 0) as n0, count_if(y = 1) as n1 from wl),
p as (select n0, n1, case when n0 > n1 then 0 else 1 end as maj, least(n0, n1) as nmin, greatest(n0, n1) as nmaj,
             abs(n0 - n1) / greatest(n0, n1) > 0.2 as do from c),
keep as (select wl.* from wl, p where not p.do or wl.y <> p.maj),
mj as (select wl.*, row_number() over (order by md5('42:' || row_id)) - 1 as rk from wl, p where p.do and wl.y = p.maj),
dr as (select (('0x' || substr(md5('42:' || cast(j as varchar)), 1, 12))::BIGINT) % p.nmaj as rk
       from p, range(0, cast(p.nmin as bigint)) r(j) where p.do)
select subject_id, win_from, y from keep
union all select mj.subject_id, mj.win_from, mj.y from dr join mj using (rk)""")
def q_downsample(spark, sf):
    """Majority windows drawn with replacement (md5 draws over the
    majority's md5 order) down to the minority size."""
    wl = W.window_label(fx.frames_b1(spark, sf), "lab_b").withColumn(
        "row_id", F.concat_ws(":", "subject_id", F.col("win_from").cast("string"), F.col("win_to").cast("string")))
    out = C.downsample(wl, tol=0.2, replacement=True, seed=42)
    return out.select("subject_id", "win_from", "y")


@register("selected_features", f"""with {O.B2_CTE},
sp as (select f.fold, b2.*, case when b2f.fold = f.fold then 'test' else 'train' end as part
       from b2 join b2f using (subject_id) cross join (values (0), (1), (2)) f(fold)),
lw as (select fold, x, 'lo' as label, lo as y from sp where part = 'train' union all
       select fold, x, 'mid', mid from sp where part = 'train' union all
       select fold, x, 'even', even from sp where part = 'train'),
lv as (select fold, label, y, unnest(x) as v, unnest(generate_series(0, len(x) - 1)) as j from lw),
rg as (select fold, label, j, min(v) as lo, max(v) as hi from lv group by all),
b as (select lv.*, case when hi > lo then least(9, cast(floor((v - lo) / (hi - lo) * 10) as int)) else 0 end as bin
      from lv join rg using (fold, label, j)),
c as (select fold, label, j, bin, y, count(*) as n_by from b group by all),
c2 as (select *, sum(n_by) over (partition by fold, label, j) as n,
              sum(n_by) over (partition by fold, label, j, bin) as n_b,
              sum(n_by) over (partition by fold, label, j, y) as n_y from c),
mi as (select fold, label, j, sum((n_by / n) * ln((n_by * n) / (n_b * n_y))) as mi from c2 group by all),
r as (select *, row_number() over (partition by fold, label order by mi desc, j) as rank from mi),
s as (select fold, label, j from r where rank <= case label when 'mid' then 8 else 12 end),
o as (select *, row_number() over (partition by fold, label order by j) as i from s)
select fold, label, cast(j as int) as feature from o where i <= 50""")
def q_selected_features(spark, sf):
    """Selected slots in index order, the first 50 (the importance
    setting; the label settings select 8 or 12)."""
    sp = C.all_splits(fx.features_b2(spark, sf), _b2_folds(spark, sf), 3).filter(F.col("part") == "train")
    lw = sp.select("fold", "x", F.explode(F.array(*[F.struct(F.lit(l).alias("label"), F.col(l).alias("y"))
                                                     for l in fx.B2_LABELS])).alias("_l")) \
        .select("fold", "x", "_l.label", "_l.y")
    from ..config import label_config
    kcfg = label_config(spark, fx.B2_LABELS, k_best=12, k_by_label={"mid": 8})
    sel = P.select_k_best(lw, kcfg, by=["fold"])
    return IMP.selected_features(sel, max_features=50).select(
        "fold", "label", F.col("feature").cast("int").alias("feature"))


def _power_sql() -> str:
    lams = ", ".join(f"({v!r})" for v in P.POWER_LAMBDAS)
    yj = ("case when v >= 0 then (case when abs(lam) < 1e-12 then ln(1 + v) else (power(v + 1, lam) - 1) / lam end) "
          "else (case when abs(2 - lam) < 1e-12 then -ln(1 - v) else -(power(1 - v, 2 - lam) - 1) / (2 - lam) end) end")
    finer = "\n".join(f"""near{d} as (select fold, j, round(lam + d * {10.0 ** -d!r}, {d}) as lam from bl{d - 1} cross join range(-9, 10) s(d)),
ll{d} as (select fold, j, lam, count(*) as n, var_pop({yj}) as vt, sum(sign(v) * ln(1 + abs(v))) as sl
       from lv join near{d} using (fold, j) where part = 'train' group by all),
bl{d} as (select fold, j, lam from (
           select *, row_number() over (partition by fold, j order by -n / 2.0 * ln(greatest(vt, 1e-300)) + (lam - 1) * sl desc,
                                                             abs(lam - 1) asc) as rk from ll{d}) where rk = 1),""" for d in P.POWER_DIGITS)
    return f"""with {O.B2_CTE},
sp as (select f.fold, b2.*, case when b2f.fold = f.fold then 'test' else 'train' end as part
       from b2 join b2f using (subject_id) cross join (values (0), (1), (2)) f(fold)),
lv as (select fold, part, subject_id, win_from, unnest(x) as v, unnest(generate_series(1, len(x))) as j from sp),
lg(lam) as (values {lams}),
l1 as (select fold, j, lam, count(*) as n, var_pop({yj}) as vt, sum(sign(v) * ln(1 + abs(v))) as sl
       from lv cross join lg where part = 'train' group by all),
bl1 as (select fold, j, lam from (
           select *, row_number() over (partition by fold, j order by -n / 2.0 * ln(greatest(vt, 1e-300)) + (lam - 1) * sl desc,
                                                             abs(lam - 1) asc) as rk from l1) where rk = 1),
{finer}
best as (select * from bl4),
tr as (select lv.fold, lv.part, lv.subject_id, lv.win_from, lv.j, {yj} as t from lv join best using (fold, j)),
st as (select fold, j, avg(t) as a, case when stddev_pop(t) = 0 or stddev_pop(t) is null then 1.0 else stddev_pop(t) end as s
       from tr where part = 'train' group by all)
select fold, part, subject_id, win_from, list(round((t - a) / s, 6) + 0.0e0 order by j) as x
from tr join st using (fold, j) group by fold, part, subject_id, win_from"""


@register("scale_power", _power_sql())
def q_scale_power(spark, sf):
    """P4 + P7: Yeo-Johnson (λ by maximum likelihood on a λ grid, per
    feature and fold) then standardisation, fitted on train rows."""
    sp = C.all_splits(fx.features_b2(spark, sf), _b2_folds(spark, sf), 3)
    params = P.fit_scaler(sp.filter(F.col("part") == "train"), "power", by=["fold"])
    out = P.apply_scaler(sp, params, "power", by=["fold"])
    return out.select("fold", "part", "subject_id", "win_from",
                      F.transform("x", lambda v: F.round(v, 6) + F.lit(0.0)).alias("x"))


# ------------------------------------------------------------ C9
_SMOTE_TRAIN = "(select fold, label, row_id, x, y from sr where part = 'train')"
_SMOTE_CTE = f"""{O.B2_CTE},
sp as (select f.fold, b2.*, case when b2f.fold = f.fold then 'test' else 'train' end as part,
              concat_ws(':', subject_id, cast(win_from as varchar), cast(win_to as varchar)) as row_id
       from b2 join b2f using (subject_id) cross join (values (0), (1), (2)) f(fold)),
sr as (select fold, part, row_id, x, 'lo' as label, lo as y from sp union all select fold, part, row_id, x, 'mid', mid from sp union all
       select fold, part, row_id, x, 'even', even from sp)"""


@register("smote_counts", f"""with {_SMOTE_CTE},
c as (select fold, label, count_if(y = 1) as n_pos, count_if(y = 0) as n_neg from {_SMOTE_TRAIN} group by fold, label)
select fold, label, n_pos, n_neg,
       case when n_pos >= 2 and n_neg > 0 and n_pos < n_neg and n_pos / n_neg < 0.25
            then greatest(0, cast(floor(0.25 * n_neg) as bigint) - n_pos) else 0 end as n_synthetic
from c""")
def q_smote_counts(spark, sf):
    """SMOTE (regular variant) on the train windows of every fold and
    label: synthetic positives up to a 0.25 positive/negative ratio."""
    rows = _b2_rows(spark, sf).filter(F.col("part") == "train")
    from ..operators.smote import smote
    by = ["fold", "label"]
    made = smote(rows, k=5, ratio=0.25, variant="regular", by=by).groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    counts = rows.groupBy(*by).agg(F.count_if(F.col("y") == 1).alias("n_pos"), F.count_if(F.col("y") == 0).alias("n_neg"))
    return counts.join(made, by, "left").select(*by, "n_pos", "n_neg", F.coalesce("_n", F.lit(0).cast("long")).alias("n_synthetic"))


def _smote_sql(variant: str) -> str:
    """All synthetic rows by brute-force neighbours. Orders and draws are md5 streams."""
    u = lambda tag: f"(('0x' || substr(md5(concat_ws(':', '42:smote', cast(j as varchar), '{tag}')), 1, 12))::BIGINT / 281474976710656.0e0)"
    d = "sqrt(list_sum(list_transform(list_zip(q.x, t.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"
    seeds = "select * from mn" if variant == "regular" else f"""
  select mn.* from mn join (
    select fold, label, qid from (
      select q.fold, q.label, q.row_id as qid, t.y, row_number() over (partition by q.fold, q.label, q.row_id order by {d}, t.row_id) as rk
      from mn q join tr t on q.fold = t.fold and q.label = t.label and q.row_id <> t.row_id)
    where rk <= 10 group by all having count_if(y = 0) >= 5 and count_if(y = 0) < 10) d
  on mn.fold = d.fold and mn.label = d.label and mn.row_id = d.qid"""
    return f"""{_SMOTE_CTE},
tr as {_SMOTE_TRAIN},
mn as (select * from tr where y = 1),
pl as (select fold, label, count_if(y = 1) as pos, count_if(y = 0) as neg,
              least(5, least(count_if(y = 1), count_if(y = 0)) - 1) as kk,
              cast(cast(floor(0.25 * count_if(y = 0)) as bigint) - count_if(y = 1) as bigint) as n_new from tr group by fold, label),
ok as (select * from pl where pos >= 2 and neg >= 2 and pos < neg and pos / neg < 0.25 and n_new > 0),
sd as ({seeds}),
rk as (select sd.*, row_number() over (partition by fold, label order by md5('42:smote' || row_id)) - 1 as sr,
              count(*) over (partition by fold, label) as n_seeds from sd),
nb as (select q.fold, q.label, q.row_id as qid, t.row_id as nid, row_number() over (partition by q.fold, q.label, q.row_id order by {d}, t.row_id) as r
       from sd q join mn t on q.fold = t.fold and q.label = t.label and q.row_id <> t.row_id),
dr as (select fold, label, kk, j, {u('seed')} as us, {u('nb')} as un, {u('lam')} as lam
       from (select fold, label, kk, unnest(range(0, n_new)) as j from ok)),
sy as (select dr.fold, dr.label, dr.j, a.x as ax, b.x as bx, lam
       from dr join rk a on a.fold = dr.fold and a.label = dr.label and a.sr = cast(floor(us * a.n_seeds) as bigint)
       join nb on nb.fold = dr.fold and nb.label = dr.label and nb.qid = a.row_id and nb.r = cast(floor(un * kk) as bigint) + 1
       join mn b on b.fold = dr.fold and b.label = dr.label and b.row_id = nb.nid)
select '{variant}' as variant, fold, label, concat('smote:', cast(j as varchar)) as row_id,
       list_transform(list_zip(ax, bx), lambda z: round(z[1] + lam * (z[2] - z[1]), 6) + 0.0e0) as x
from sy"""


@register("smote_rows", " union all ".join(f"select * from (with {_smote_sql(v)}) {v}" for v in ("regular", "borderline")))
def q_smote_rows(spark, sf):
    """Every synthetic row (seed, neighbour and λ from md5 streams) of the
    regular and the borderline variant, for every fold and label."""
    from functools import reduce as _r

    from ..operators.smote import smote
    rows = _b2_rows(spark, sf).filter(F.col("part") == "train")
    out = [smote(rows, k=5, ratio=0.25, variant=v, by=["fold", "label"]).select(
               F.lit(v).alias("variant"), "fold", "label", "row_id",
               F.transform("x", lambda e: F.round(e, 6) + F.lit(0.0)).alias("x"))
           for v in ("regular", "borderline")]
    return _r(DataFrame.unionByName, out)


# ------------------------------------------------------------ L1 panels
from . import l1  # noqa: E402

_L1_SCALERS = ("standard", "minmax", "robust")


def _feature_vector(feats, channels, spec):
    """One ``x`` array per window: the channels' features in order, missing → 0."""
    names = spec.names()
    arr = F.array(*[F.nanvl(F.coalesce(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)) for f in names])
    return feats.groupBy(*WK).agg(F.flatten(F.transform(
        F.sort_array(F.collect_list(F.struct("channel", arr.alias("f")))), lambda c: c["f"])).alias("x"))


def _l1_rows(feats, labels, spec):
    x = _feature_vector(feats, fx.B1_CHANNELS, spec).join(labels, on=WK)
    rid = F.concat_ws(":", "subject_id", F.col("win_from").cast("string"), F.col("win_to").cast("string"))
    return x.select("subject_id", rid.alias("row_id"), F.col("y").cast("int").alias("y"), "x")


def _l1_rows_sql(name, feats_sql, labels_sql, spec):
    """CTE ``name``: subject_id, row_id, y, x (channels in name order)."""
    cols = ", ".join(f"coalesce(cast({c} as double), 0.0e0)" for c in spec.names())
    return f"""{name} as (select f.subject_id, concat_ws(':', f.subject_id, cast(f.win_from as varchar), cast(f.win_to as varchar)) as row_id,
       max(l.y) as y, flatten(list([{cols}] order by channel)) as x
  from ({feats_sql}) f join ({labels_sql}) l using (subject_id, win_from, win_to) group by f.subject_id, f.win_from, f.win_to)"""


def _l1_sql(rows_cte, balance, variants):
    """R1 rows by brute force from CTE ``rw``. ``variants``: (name, k)."""
    cfg = ", ".join(f"('{n}', {k})" for n, k in variants)
    bal = "abs(n0 - n1) / greatest(n0, n1) > 0.2" if balance else "false"
    stats = [("standard", "avg(v)", "stddev_pop(v)"), ("minmax", "min(v)", "max(v) - min(v)"),
             ("robust", "quantile_cont(v, 0.5)", "quantile_cont(v, 0.75) - quantile_cont(v, 0.25)")]
    st = " union all ".join(f"select '{n}' as scaler, fold, j, {a} as a, {b} as s from tv group by fold, j" for n, a, b in stats)
    scale = "list_transform(list_zip(x, a, s), lambda z: (z[1] - z[2]) / z[3])"
    mets = {"f1": "case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end",
            "f1_neg": "case when 2 * tn + fp + fn > 0 then 2 * tn / (2 * tn + fp + fn) else 0 end",
            "accuracy": "(tp + tn) / (tp + tn + fp + fn)", "auc": "auc"}
    return f"""with {rows_cte},
fo as (select subject_id, (row_number() over (order by cls, md5('42:' || subject_id)) - 1) % {l1.L1_FOLDS} as fold
       from (select subject_id, max(y) as cls from rw group by subject_id)),
sp as (select f.fold, rw.*, case when fo.fold = f.fold then 'test' else 'train' end as part
       from rw join fo using (subject_id) cross join range(0, {l1.L1_FOLDS}) f(fold)),
sz as (select avg(a) as tm, stddev_pop(a) as ts, avg(b) as em, stddev_pop(b) as es
       from (select fold, count_if(part = 'train') as a, count_if(part = 'test') as b from sp group by fold)),
vf as (select fold from sp group by fold having count(distinct case when part = 'train' then y end) = 2
       and count(distinct case when part = 'test' then y end) = 2),
t0 as (select sp.fold, subject_id, row_id, y, x from sp join vf using (fold) where part = 'train'),
te as (select sp.fold, subject_id, row_id, y, x from sp join vf using (fold) where part = 'test'),
cn as (select fold, count_if(y = 0) as n0, count_if(y = 1) as n1 from t0 group by fold),
bp as (select fold, case when n0 > n1 then 0 else 1 end as maj, least(n0, n1) as nmin, greatest(n0, n1) as nmaj, {bal} as cutdown from cn),
mj as (select t0.*, row_number() over (partition by t0.fold order by md5('42:' || row_id)) - 1 as rk from t0 join bp using (fold) where cutdown and y = maj),
dr as (select fold, (('0x' || substr(md5('42:' || cast(j as varchar)), 1, 12))::BIGINT) % nmaj as rk
       from (select fold, nmaj, unnest(range(0, cast(nmin as bigint))) as j from bp where cutdown)),
tr as (select t0.* from t0 join bp using (fold) where not cutdown or y <> maj
       union all select mj.fold, mj.subject_id, mj.row_id, mj.y, mj.x from dr join mj using (fold, rk)),
tv as (select fold, unnest(x) as v, unnest(generate_series(1, len(x))) as j from tr),
st as ({st}),
sc as (select scaler, fold, list(a order by j) as a, list(case when s is null or s = 0 then 1.0e0 else s end order by j) as s from st group by scaler, fold),
ts as (select scaler, tr.fold, row_id, y, {scale} as x from tr join sc on tr.fold = sc.fold),
es as (select scaler, te.fold, subject_id, row_id, y, {scale} as x from te join sc on te.fold = sc.fold),
nn as (select q.scaler, q.fold, q.subject_id, q.row_id, q.y, t.y as ty, row_number() over (partition by q.scaler, q.fold, q.row_id
         order by sqrt(list_sum(list_transform(list_zip(q.x, t.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), t.row_id) as rk
       from es q join ts t on q.scaler = t.scaler and q.fold = t.fold),
kv(model, k) as (values {cfg}),
pr as (select scaler, model, fold, subject_id, row_id, y, avg(ty) as p, cast(avg(ty) > 0.5 as int) as pred
       from nn join kv on rk <= k group by scaler, model, fold, subject_id, row_id, y),
cm as (select scaler, model, fold, count_if(y = 1 and pred = 1) as tp, count_if(y = 0 and pred = 1) as fp,
              count_if(y = 1 and pred = 0) as fn, count_if(y = 0 and pred = 0) as tn from pr group by all),
au as (select a.scaler, a.model, a.fold, avg(case when a.p > b.p then 1.0e0 when a.p = b.p then 0.5e0 else 0.0e0 end) as auc
       from pr a join pr b on a.scaler = b.scaler and a.model = b.model and a.fold = b.fold and a.y = 1 and b.y = 0 group by all),
vo as (select scaler, model, subject_id, cast(avg(pred) >= 0.5 as int) as vote, max(y) as y from pr group by all),
vm as (select scaler, model, avg(case when vote = y then 1.0e0 else 0.0e0 end) as va, stddev_pop(case when vote = y then 1.0e0 else 0.0e0 end) as vs,
              count_if(vote = 1 and y = 1) / greatest(1, count_if(y = 1)) as se,
              count_if(vote = 0 and y = 0) / greatest(1, count_if(y = 0)) as sp, count(*) as n from vo group by all)
select scaler, model,
  {", ".join(f"{O.rnd(f'avg({e})')} as {m}_mean, {O.rnd(f'stddev_pop({e})')} as {m}_std" for m, e in mets.items())},
  count(fold) as n_folds, {O.rnd('max(va)')} as vote_accuracy, {O.rnd('max(se)')} as vote_sensitivity,
  {O.rnd('max(sp)')} as vote_specificity, {O.rnd('max(vs)')} as vote_accuracy_std, max(n) as n_subjects,
  {O.rnd('max(tm)')} as n_train_mean, {O.rnd('max(ts)')} as n_train_std, {O.rnd('max(em)')} as n_test_mean, {O.rnd('max(es)')} as n_test_std
from cm join au using (scaler, model, fold) join vm using (scaler, model) cross join sz group by scaler, model"""


def _l1_all_sql(rows_cte, balance, grids):
    """As ``_l1_sql``, for every scaler (Yeo-Johnson too) and every nearest-neighbour
    variant (Manhattan distance and distance weights too) of the grid."""
    sql = _l1_sql(rows_cte, balance, [])
    yj = lambda v, lam: (
        f"case when {v} >= 0 then (case when abs({lam}) < 1e-12 then ln(1 + {v}) else (power({v} + 1, {lam}) - 1) / {lam} end) "
        f"else (case when abs(2 - {lam}) < 1e-12 then -ln(1 - {v}) else -(power(1 - {v}, 2 - {lam}) - 1) / (2 - {lam}) end) end")
    like = (f"fold, j, lam, row_number() over (partition by fold, j order by -count(*) / 2.0 * ln(greatest(var_pop({yj('v', 'lam')}), 1e-300))"
            " + (lam - 1) * sum(sign(v) * ln(1 + abs(v))) desc, abs(lam - 1) asc) as rk")
    lams = ", ".join(f"({v!r})" for v in P.POWER_LAMBDAS)
    finer = "\n".join(f"""pn{d} as (select fold, j, round(lam + d * {10.0 ** -d!r}, {d}) as lam from pc{d - 1} cross join range(-9, 10) s(d) where rk = 1),
pc{d} as (select {like} from tv join pn{d} using (fold, j) group by fold, j, lam),""" for d in P.POWER_DIGITS)
    power = f"""lg(lam) as (values {lams}),
pc1 as (select {like} from tv cross join lg group by fold, j, lam),
{finer}
pw as (select fold, j, lam from pc4 where rk = 1),
st0 as ("""
    dist = "list_sum(list_transform(list_zip(q.x, t.x), lambda z: {}))"
    d2, d1 = f"sqrt({dist.format('(z[1] - z[2]) * (z[1] - z[2])')})", dist.format("abs(z[1] - z[2])")
    specs = l1.l1_specs(grids, ["knn"])
    cfg = ", ".join(f"('{x.name}', {x.params['n_neighbors']}, {x.params['p']}, '{x.params['weights']}')" for x in specs)
    scale = "list_transform(list_zip(x, a, s), lambda z: (z[1] - z[2]) / z[3])"
    for old, new in [
        ("st as (", power),
        ("sc as (select scaler, fold,", f"""st as (select *, null::double as lam from st0
       union all select 'power', fold, j, avg({yj('v', 'lam')}), stddev_pop({yj('v', 'lam')}), lam from tv join pw using (fold, j) group by fold, j, lam),
sc as (select scaler, fold, list(lam order by j) as lam,"""),
        (scale, f"""case when sc.scaler = 'power' then list_transform(list_zip(x, a, s, lam), lambda z: ({yj('z[1]', 'z[4]')} - z[2]) / z[3])
       else {scale} end"""),
        ("nn as (select q.scaler, q.fold, q.subject_id, q.row_id, q.y, t.y as ty, row_number()",
         f"""dd as (select q.scaler, q.fold, q.subject_id, q.row_id, q.y, t.y as ty, t.row_id as tid, {d2} as d2, {d1} as d1
       from es q join ts t on q.scaler = t.scaler and q.fold = t.fold),
nn as (select q.scaler, q.fold, q.subject_id, q.row_id, q.y, q.ty, m.m, case when m.m = 2 then d2 else d1 end as d, row_number()"""),
        ("over (partition by q.scaler, q.fold, q.row_id\n", "over (partition by q.scaler, q.fold, q.row_id, m.m\n"),
        (f"order by {d2}, t.row_id) as rk\n       from es q join ts t on q.scaler = t.scaler and q.fold = t.fold)",
         "order by case when m.m = 2 then d2 else d1 end, tid) as rk\n      from dd q cross join (values (1), (2)) m(m))"),
        ("kv(model, k) as (values )", f"kv(model, k, m, weights) as (values {cfg})"),
        ("avg(ty) as p, cast(avg(ty) > 0.5 as int) as pred\n       from nn join kv on rk <= k group by scaler, model, fold, subject_id, row_id, y)",
         """p, cast(p > 0.5 as int) as pred from (
       select scaler, model, fold, subject_id, row_id, y, case when weights = 'uniform' then avg(ty)
              when min(d) = 0 then avg(case when d = 0 then ty end)
              else sum(case when d > 0 then ty / d end order by rk) / sum(case when d > 0 then 1 / d end order by rk) end as p
       from nn join kv on rk <= k and nn.m = kv.m group by scaler, model, fold, subject_id, row_id, y, weights))"""),
    ]:
        assert old in sql, old
        sql = sql.replace(old, new)
    return sql


def _knn_variants(grids):
    return [(s.name, s.params["n_neighbors"]) for s in l1.l1_specs(grids, ["knn"])
            if s.params["p"] == 2 and s.params["weights"] == "uniform"]


_WIN_FRAMES = O.B1_BASE + """,
f0 as (select subject_id, win_from, win_to, frame_idx, d_value, d_k, lab_a from b1),
wl0 as (select subject_id, win_from, win_to, max(case when lab_a = 1 then 1 else 0 end) as y from f0 group by all
        having max(case when lab_a = 2 then 1 else 0 end) = 0),
fr as (select f0.* from f0 join wl0 using (subject_id, win_from, win_to) where y = 1 or starts_with(subject_id, 'C'))"""
_WIN_LABELS = f"with {_WIN_FRAMES} select subject_id, win_from, win_to, max(case when lab_a = 1 then 1 else 0 end) as y from fr group by all"


@register("window_panel", _l1_sql(_l1_rows_sql(
    "rw", O.features_sql(_WIN_FRAMES, fx.B1_CHANNELS, WK, fps=1.0, variant="window"), _WIN_LABELS, SPECS["window"]),
    True, _knn_variants(l1.WINDOW_GRIDS)))
def q_window_panel(spark, sf):
    """Window panel from frames to R1: ambiguous windows out, positives and
    controls in, features, subject-safe folds, balanced train parts, scalers,
    the exact nearest-neighbour family of its grid, votes, summary."""
    fr = W.drop_ambiguous(fx.frames_b1(spark, sf), "lab_a")
    kept = W.positives_and_controls(W.window_label(fr, "lab_a"))
    feats = rounded(window_features(fr.join(kept.select(*WK), on=WK, how="left_semi"), WK, fx.B1_CHANNELS, SPECS["window"]))
    rows = _l1_rows(feats, kept, SPECS["window"])
    return rounded(l1.l1_panel(rows, l1.WINDOW_GRIDS, ["knn"], _L1_SCALERS, balance=True))


_TASK_FRAMES = O.B1_BASE + """,
f0 as (select subject_id, win_from, win_to, frame_idx, d_value, d_k, lab_b from b1 where win_from = 10),
wl0 as (select subject_id, win_from, win_to, max(case when lab_b = 1 then 1 else 0 end) as y from f0 group by all),
fr as (select f0.* from f0 join wl0 using (subject_id, win_from, win_to) where y = 1 or starts_with(subject_id, 'C'))"""
_TASK_LABELS = f"with {_TASK_FRAMES} select subject_id, win_from, win_to, max(case when lab_b = 1 then 1 else 0 end) as y from fr group by all"


@register("task_panel", _l1_sql(_l1_rows_sql(
    "rw", O.features_sql(_TASK_FRAMES, fx.B1_CHANNELS, WK, fps=1.0, variant="window"), _TASK_LABELS, SPECS["window"]),
    False, _knn_variants(l1.TASK_GRIDS)))
def q_task_panel(spark, sf):
    """Task panel (one task segment per subject): label, features, folds,
    scalers, nearest neighbours of its grid, summary."""
    fr = W.for_task(fx.frames_b7(spark, sf), "Action")
    kept = W.positives_and_controls(W.window_label(fr, "lab_b"))
    feats = rounded(window_features(fr.join(kept.select(*WK), on=WK, how="left_semi"), WK, fx.B1_CHANNELS, SPECS["window"]))
    return rounded(l1.l1_panel(_l1_rows(feats, kept, SPECS["window"]), l1.TASK_GRIDS, ["knn"], _L1_SCALERS))


_SUBJ_LABELS = f"""with {_W7_CTE} select distinct subject_id, 0 as win_from, 0 as win_to,
       case when starts_with(subject_id, 'C') then 0 else 1 end as y from fr"""


@register("subject_panel", _l1_sql(_l1_rows_sql(
    "rw", O.features_sql(_W7_CTE, fx.B1_CHANNELS, WK, fps=1.0, variant="subject"), _SUBJ_LABELS, SPECS["subject"]),
    False, _knn_variants(l1.SUBJECT_GRIDS)))
def q_subject_panel(spark, sf):
    """Subject panel: kept windows joined to one signal per subject, features,
    folds, scalers, uniform Euclidean nearest neighbours of its grid, summary."""
    fr = W.drop_ambiguous(fx.frames_b1(spark, sf), "lab_a")
    kept = W.positives_and_controls(W.window_label(fr, "lab_a"))
    feats = rounded(long_signal_features(W.subject_signal(fr, kept), WK, fx.B1_CHANNELS))
    labels = feats.select(*WK, F.when(S.is_control("subject_id"), 0).otherwise(1).alias("y")).distinct()
    rows = _l1_rows(feats, labels, SPECS["subject"])
    specs = [s for s in l1.l1_specs(l1.SUBJECT_GRIDS, ["knn"]) if s.params["p"] == 2 and s.params["weights"] == "uniform"]
    split, sizes = l1.l1_split(rows)
    return rounded(l1.l1_summary(l1.l1_scores(split, specs, _L1_SCALERS), sizes))


# the same three with every scaler and every nearest-neighbour variant
def _window_panel_rows(spark, sf):
    fr = W.drop_ambiguous(fx.frames_b1(spark, sf), "lab_a")
    kept = W.positives_and_controls(W.window_label(fr, "lab_a"))
    feats = rounded(window_features(fr.join(kept.select(*WK), on=WK, how="left_semi"), WK, fx.B1_CHANNELS, SPECS["window"]))
    return _l1_rows(feats, kept, SPECS["window"])


def _task_panel_rows(spark, sf):
    fr = W.for_task(fx.frames_b7(spark, sf), "Action")
    kept = W.positives_and_controls(W.window_label(fr, "lab_b"))
    feats = rounded(window_features(fr.join(kept.select(*WK), on=WK, how="left_semi"), WK, fx.B1_CHANNELS, SPECS["window"]))
    return _l1_rows(feats, kept, SPECS["window"])


def _subject_panel_rows(spark, sf):
    fr = W.drop_ambiguous(fx.frames_b1(spark, sf), "lab_a")
    kept = W.positives_and_controls(W.window_label(fr, "lab_a"))
    feats = rounded(long_signal_features(W.subject_signal(fr, kept), WK, fx.B1_CHANNELS))
    labels = feats.select(*WK, F.when(S.is_control("subject_id"), 0).otherwise(1).alias("y")).distinct()
    return _l1_rows(feats, labels, SPECS["subject"])


@register("window_panel_all", _l1_all_sql(_l1_rows_sql(
    "rw", O.features_sql(_WIN_FRAMES, fx.B1_CHANNELS, WK, fps=1.0, variant="window"), _WIN_LABELS, SPECS["window"]),
    True, l1.WINDOW_GRIDS))
def q_window_panel_all(spark, sf):
    """Window panel: all scalers and all nearest-neighbour variants."""
    return rounded(l1.l1_panel(_window_panel_rows(spark, sf), l1.WINDOW_GRIDS, ["knn"], balance=True))


@register("task_panel_all", _l1_all_sql(_l1_rows_sql(
    "rw", O.features_sql(_TASK_FRAMES, fx.B1_CHANNELS, WK, fps=1.0, variant="window"), _TASK_LABELS, SPECS["window"]),
    False, l1.TASK_GRIDS))
def q_task_panel_all(spark, sf):
    """Task panel: all scalers and all nearest-neighbour variants."""
    return rounded(l1.l1_panel(_task_panel_rows(spark, sf), l1.TASK_GRIDS, ["knn"]))


@register("subject_panel_all", _l1_all_sql(_l1_rows_sql(
    "rw", O.features_sql(_W7_CTE, fx.B1_CHANNELS, WK, fps=1.0, variant="subject"), _SUBJ_LABELS, SPECS["subject"]),
    False, l1.SUBJECT_GRIDS))
def q_subject_panel_all(spark, sf):
    """Subject panel: all scalers and all nearest-neighbour variants."""
    return rounded(l1.l1_panel(_subject_panel_rows(spark, sf), l1.SUBJECT_GRIDS, ["knn"]))


# ------------------------------------------------------------ the 17-channel matrix
from ..config import DISTANCE_COLS  # noqa: E402


def _pose_cte() -> str:
    dist = []
    for i, c in enumerate(DISTANCE_COLS):
        px = f"cast(trunc(abs(cast(embedding[{2 * i + 1}] as double)) * 640) as int)"
        py = f"cast(trunc(abs(cast(embedding[{2 * i + 2}] as double)) * 480) as int)"
        dist.append(f"sqrt(cast({px} as double) * {px} + cast({py} as double) * {py}) as {c}")
    return f"""
kp as (select concat('V', lpad(cast(vec_id // 100 as varchar), 3, '0')) as subject_id,
              cast(vec_id % 100 // 50 * 50 as int) as win_from, cast(vec_id % 100 // 50 * 50 + 50 as int) as win_to,
              vec_id % 100 as f0, {", ".join(dist)} from embeddings where vec_id % 11 <> 0),
fr as (select subject_id, win_from, win_to,
              cast(row_number() over (partition by subject_id, win_from, win_to order by f0) - 1 as int) as frame_idx,
              {", ".join(DISTANCE_COLS)} from kp)"""


def _pose_matrix_sql() -> str:
    names = SPECS["multilabel"].names()
    cols = ", ".join(f"coalesce(max(case when channel = '{c}' then {f} end), 0) + 0.0e0 as {c}_{f}" for c in DISTANCE_COLS for f in names)
    return f"""with feat as materialized ({O.features_sql(_pose_cte(), DISTANCE_COLS, WK).strip()}),{_pose_cte()},
wl as (select subject_id, win_from, win_to, count(*) as n_frames from fr group by all)
select wl.subject_id, wl.win_from, wl.win_to, wl.n_frames, {cols}
from wl left join feat using (subject_id, win_from, win_to) group by all"""


@register("pose_feature_matrix", _pose_matrix_sql())
def q_pose_feature_matrix(spark, sf):
    """S6–S8, S4, F1–F23 over all 17 keypoint channels: detections to
    distances, undetected frames out, windows of 50 frames, 374 features."""
    d = D.detections_to_frames(fx.detections_b5(spark, sf))
    at = F.round(F.col("time") * 30).cast("int")
    lo = (F.floor(at / 50) * 50).cast("int")
    fr = d.select(F.col("video_id").alias("subject_id"), lo.alias("win_from"), (lo + 50).alias("win_to"),
                  at.alias("frame_idx"), *DISTANCE_COLS)
    fr = S.drop_incomplete(fr, DISTANCE_COLS)
    wl = fr.groupBy(*WK).agg(F.count(F.lit(1)).alias("n_frames"))
    return rounded(feature_matrix(window_features(fr, WK, DISTANCE_COLS), wl, WK, DISTANCE_COLS))


from . import registry_models  # noqa: E402, F401
