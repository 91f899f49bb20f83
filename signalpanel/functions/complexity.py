"""Zero crossings, second-difference energy, Higuchi fractal
dimension and permutation entropy, each as conditional aggregates over the
lag/lead columns of :func:`signal_rows` (no per-window Python)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

KMAX = 5
PE_EPS = 1e-10
HFD_FLOOR = 1e-12


def crossing_rows() -> dict[str, Column]:
    x, l1, l2 = F.col("x"), F.col("lag1"), F.col("lag2")
    d, dprev = x - l1, l1 - l2
    # second difference with both diffs prepended: frame 0 → 0, frame 1 → |x1-x0|
    return {
        "_zc": l1 * x < 0,
        "_zcd": dprev * d < 0,
        "_acc": F.coalesce(F.abs(d - F.coalesce(dprev, F.lit(0.0))), F.lit(0.0)),
    }


def crossing_aggs() -> dict[str, Column]:
    return {
        "zero_crossings": F.count_if(F.col("_zc")),             # F17 on the signal
        "zero_crossings_delta": F.count_if(F.col("_zcd")),      # F18 on the first difference
        "_accel": F.sum("_acc"),                                # F19
    }


def higuchi_rows(kmax: int = KMAX) -> dict[str, Column]:
    """Curve-length terms: frame p contributes |x_p − x_{p−k}| to
    (k, p mod k) when it is neither the first of its sub-series nor past the
    last full step, i.e. when both lag_k and lead_k exist."""
    x = F.col("x")
    return {f"_t{k}": F.when(F.col(f"lead{k}").isNotNull(), F.abs(x - F.col(f"lag{k}")))
            for k in range(1, kmax + 1)}


def higuchi_aggs(kmax: int = KMAX) -> dict[str, Column]:
    """Partial sums S[k][m] over the terms of :func:`higuchi_rows`."""
    idx = F.col("frame_idx")
    return {f"_hg{k}_{m}": F.sum(F.when(idx % k == m, F.col(f"_t{k}")))
            for k in range(1, kmax + 1) for m in range(k)}


def higuchi_fd(kmax: int = KMAX) -> list[dict[str, Column]]:
    """−slope of ln L(k) on ln k; windows shorter than kmax+1 → 0.
    Returned as successive projections (L(k), then the fit)."""
    n = F.col("n")
    us, lks = [], {}
    for k in range(1, kmax + 1):
        acc, cnt = None, None
        for m in range(k):
            nmax = F.floor((n - m - 1) / k)
            ok = nmax > 1
            s = F.coalesce(F.col(f"_hg{k}_{m}"), F.lit(0.0))
            lm = F.when(ok, s * ((n - 1).cast("double") / (F.lit(k) * nmax * F.lit(k))))
            c = F.when(ok, F.lit(1)).otherwise(F.lit(0))
            acc = F.coalesce(lm, F.lit(0.0)) if acc is None else acc + F.coalesce(lm, F.lit(0.0))
            cnt = c if cnt is None else cnt + c
        lk = F.when(cnt > 0, acc / cnt).otherwise(F.lit(0.0))
        lks[f"_lnL{k}"] = F.log(F.when(lk <= HFD_FLOOR, F.lit(HFD_FLOOR)).otherwise(lk))
        us.append(math.log(k))
    vs = [F.col(c) for c in lks]
    ubar = sum(us) / len(us)
    vbar = vs[0]
    for v in vs[1:]:
        vbar = vbar + v
    vbar = vbar / float(len(vs))
    num = None
    for u, v in zip(us, vs):
        t = (v - F.col("_vbar")) * float(u - ubar)
        num = t if num is None else num + t
    den = sum((u - ubar) ** 2 for u in us)
    fd = F.when(n < kmax + 1, F.lit(0.0)).otherwise(-(num / float(den)))
    return [lks, {"_vbar": vbar}, {"higuchi_fd": fd}]


def perm_rows() -> dict[str, Column]:
    """Ordinal-pattern code (order 3, delay 1). Ties rank the earlier
    sample first (stable argsort), so a pattern is fixed by three ≤ tests."""
    a, b, c = F.col("x"), F.col("lead1"), F.col("lead2")
    code = ((a <= b).cast("int") * 4 + (a <= c).cast("int") * 2 + (b <= c).cast("int"))
    return {"_pe": F.when(b.isNotNull() & c.isNotNull(), code)}


def perm_aggs() -> dict[str, Column]:
    return {f"_pe{j}": F.count_if(F.col("_pe") == j) for j in range(8)}


def perm_entropy() -> Column:
    """−Σ p ln(p + 1e-10) over observed patterns; n < 3 → 0."""
    n = F.col("n")
    tot = (n - 2).cast("double")
    h = None
    for j in range(8):
        cj = F.col(f"_pe{j}").cast("double")
        p = cj / tot
        term = F.when(cj > 0, p * F.log(p + F.lit(PE_EPS))).otherwise(F.lit(0.0))
        h = term if h is None else h + term
    return F.when(n < 3, F.lit(0.0)).otherwise(-h)
