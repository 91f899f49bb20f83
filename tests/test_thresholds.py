import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from signalpanel.config import label_config, threshold_grid
from signalpanel.operators import thresholds as TH
from signalpanel.operators import metrics as E


def choice_table(g: pd.DataFrame, alpha: float) -> pd.DataFrame:
    """Every threshold of the grid with its rates, as one table: the subjects
    crossed with the grid, counted by group."""
    x = g.merge(pd.DataFrame({"t": threshold_grid()}), how="cross")
    x["hit"] = x.p >= x.t
    x["ctrl"] = x.subject_id.str.startswith("C")
    c = x.groupby("t").apply(lambda d: pd.Series({
        "recall": d.hit[d.y == 1].mean(), "specificity": 1 - d.hit[d.y == 0].mean(),
        "precision": d.y[d.hit].mean() if d.hit.any() else 0.0,
        "alarms": int(d.hit[d.ctrl & (d.y == 0)].sum()), "quiet": int((d.ctrl & (d.y == 0)).sum())}),
        include_groups=False).reset_index()
    both = c.precision + c.recall
    return c.assign(
        balanced=(c.recall + c.specificity) / 2, f1=(2 * c.precision * c.recall / both.where(both > 0, 1)),
        clinical_cost=-((1 - alpha) * (1 - c.specificity) + alpha * (1 - c.recall)))


def best_threshold(g: pd.DataFrame, policy: str, alpha=0.5, fp_max=1, fpr_target=0.1, spec_target=0.8) -> float:
    """Filter the table by the control limits, sort by (score, threshold), take the first."""
    c = choice_table(g, alpha)
    allowed = c[(c.quiet == 0) | ((c.alarms <= fp_max) & (c.alarms <= fpr_target * c.quiet + 1e-12))]
    if policy == "spec_at_least":
        strict = allowed[allowed.specificity >= spec_target]
        allowed, policy = (strict, "recall") if len(strict) else (allowed, "balanced")
    ranked = allowed.assign(score=allowed[policy].round(12)).sort_values(["score", "t"], ascending=[False, True])
    return float(ranked.t.iloc[0]) if len(ranked) else 0.5


def _subj(spark, rows):
    return spark.createDataFrame(pd.DataFrame(rows, columns=["g", "subject_id", "label", "y", "p"])) \
        .withColumn("is_control", F.col("subject_id").startswith("C"))


def test_policies_match_the_choice_table(spark):
    rng = np.random.default_rng(7)
    rows = []
    for g in range(6):
        n = 30
        y = rng.integers(0, 2, n)
        p = np.round(np.clip(0.35 * y + rng.uniform(0, 0.7, n), 0, 1), 3)
        for i in range(n):
            sid = ("C" if i % 5 == 0 else "P") + f"{i:03d}"
            yy = 0 if sid.startswith("C") else int(y[i])
            rows.append((g, sid, "lab", yy, float(p[i])))
    subj = _subj(spark, rows)
    cfg = label_config(spark, ["lab"], alpha=0.5, fp_max=1, fpr_target=0.1, spec_target=0.8)
    pdf = subj.toPandas()
    for policy in ("balanced", "f1", "clinical_cost", "spec_at_least"):
        got = {r["g"]: r["threshold"] for r in TH.tune_thresholds(subj, cfg, policy, by=["g"]).collect()}
        for g, grp in pdf.groupby("g"):
            want = best_threshold(grp, policy)
            assert abs(got[g] - want) < 1e-12, (policy, g, got[g], want)


#: Two controls at 0.2 and 0.4, two patients without (0.3, 0.5) and two with the sign (0.45, 0.8).
HAND = [("C1", 0, 0.2), ("C2", 0, 0.4), ("P1", 0, 0.3), ("P2", 0, 0.5), ("P3", 1, 0.45), ("P4", 1, 0.8)]


@pytest.mark.parametrize("policy,limit,between", [
    # balanced: t in (0.4, 0.45] has recall 1 and specificity 3/4
    ("balanced", 1, (0.4, 0.45)),
    # no alarm among controls allowed: needs t over 0.4, so the same place
    ("balanced", 0, (0.4, 0.45)),
    # f1: 2 of 3 hits right and recall 1 = 0.8 in (0.4, 0.45]; above 0.5 it is 2/3
    ("f1", 1, (0.4, 0.45)),
    # specificity of 0.8 needs all four quiet: t over 0.5
    ("spec_at_least", 1, (0.5, 0.51)),
])
def test_by_hand(spark, policy, limit, between):
    subj = _subj(spark, [(0, s, "lab", y, p) for s, y, p in HAND])
    cfg = label_config(spark, ["lab"], alpha=0.5, fp_max=limit, fpr_target=1.0, spec_target=0.8)
    t = TH.tune_thresholds(subj, cfg, policy, by=["g"]).first()["threshold"]
    first = min(x for x in threshold_grid() if x > between[0])
    assert t == first and t <= between[1]


def test_relaxation_by_hand(spark):
    """Constant label: 0.5 at level 0. Otherwise the first level that some t meets."""
    rows = [(0, "P1", "lab", 0, 0.2), (0, "P2", "lab", 0, 0.9)]
    rows += [(1, s, "lab", y, p) for s, y, p in HAND]
    rows += [(2, "C1", "lab", 0, 0.995), (2, "P1", "lab", 1, 0.6), (2, "P2", "lab", 0, 0.1)]
    cfg = label_config(spark, ["lab"], fp_max=0, fpr_target=0.0, spec_target=0.7, recall_min=0.9)
    got = {r["g"]: r for r in TH.min_error_threshold(_subj(spark, rows), cfg, by=["g"]).collect()}
    assert (got[0]["threshold"], got[0]["relax_level"]) == (0.5, 0)
    assert got[1]["relax_level"] == 0 and 0.4 < got[1]["threshold"] <= 0.45 and abs(got[1]["train_error"] - 1 / 6) < 1e-12
    # the control scores above the grid: no t keeps it quiet, so all constraints go
    assert got[2]["relax_level"] == 4 and got[2]["threshold"] <= 0.6


def test_single_class_and_infeasible(spark):
    rows = [(0, "P1", "lab", 0, 0.2), (0, "P2", "lab", 0, 0.9),   # single class → 0.5
            (1, "C1", "lab", 0, 0.99), (1, "C2", "lab", 0, 0.995), (1, "P3", "lab", 1, 0.5)]
    subj = _subj(spark, rows)
    cfg = label_config(spark, ["lab"], fp_max=0, fpr_target=0.0)
    got = {r["g"]: r["threshold"] for r in TH.tune_thresholds(subj, cfg, "balanced", by=["g"]).collect()}
    assert got[0] == 0.5
    # controls score above every feasible... FP cap 0 needs t > 0.995 → none on the grid → 0.5
    assert got[1] == 0.5


def test_threshold_counts_equal_naive(spark):
    rng = np.random.default_rng(3)
    rows = [(0, f"P{i}", "lab", int(rng.integers(0, 2)), float(np.round(rng.uniform(), 2))) for i in range(50)]
    subj = _subj(spark, rows)
    c = TH.threshold_counts(subj, by=["g"]).toPandas().sort_values("i")
    pdf = subj.toPandas()
    for _, r in c.iterrows():
        pred = pdf.p >= r.t
        assert r.tp == int(((pdf.y == 1) & pred).sum())
        assert r.fp == int(((pdf.y == 0) & pred).sum())


def test_auc_ap_with_ties(spark):
    y = [0, 0, 1, 1, 0, 1, 1, 0]
    p = [0.1, 0.4, 0.35, 0.8, 0.4, 0.4, 0.9, 0.2]
    df = spark.createDataFrame(pd.DataFrame({"label": "a", "y": y, "p": p}))
    auc = E.roc_auc(df).first()["auc"]
    pairs = [(pi, pj) for pi, yi in zip(p, y) if yi == 1 for pj, yj in zip(p, y) if yj == 0]
    want = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in pairs) / len(pairs)
    assert abs(auc - want) < 1e-12
    ap = E.average_precision(df).first()["auprc"]
    order = sorted(set(p), reverse=True)
    P = sum(y)
    want_ap, tp_prev = 0.0, 0
    for s in order:
        tp = sum(1 for pi, yi in zip(p, y) if pi >= s and yi == 1)
        k = sum(1 for pi in p if pi >= s)
        want_ap += (tp - tp_prev) / P * (tp / k)
        tp_prev = tp
    assert abs(ap - want_ap) < 1e-12
