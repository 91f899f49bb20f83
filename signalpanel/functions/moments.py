"""Moments, order statistics, energy, slope and histogram entropy.

All are aggregates over ``(window, channel)``; the algebraic ones combine
map-side (partial aggregation), the quantiles use the exact ``percentile``
aggregate (linear interpolation, same as NumPy).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HIST_BINS = 10
HIST_EPS = 1e-6


def moment_aggs(quartiles: bool = True) -> dict[str, Column]:
    """``quartiles=False`` leaves out the one aggregate whose state grows with the group."""
    x = F.col("x")
    out = {
        "n": F.count(x).cast("int"),
        "mean": F.avg(x),                       # F1
        "std": F.stddev_pop(x),                 # F2 population
        "min": F.min(x),                        # F3
        "max": F.max(x),                        # F4
        "skew": F.skewness(x),                  # F7 biased
        "kurtosis": F.kurtosis(x),              # F8 biased, excess
        "energy": F.sum(x * x),                 # F9
        "slope": F.regr_slope(x, F.col("frame_idx").cast("double")),  # F10
        "var": F.var_pop(x),                    # F13
    }
    if quartiles:
        out["_q"] = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return out


def hist_rows(bins: int = HIST_BINS) -> list[dict[str, Column]]:
    """Bin index of ``x`` in ``bins`` equal bins on [lo, hi] (±0.5 when the
    signal is constant), with the edge checks NumPy applies. Returned as
    successive projections so that no sub-expression is duplicated."""
    x, lo0, hi0 = F.col("x"), F.col("lo"), F.col("hi")
    const = lo0 == hi0
    s1 = {"_hlo": F.when(const, lo0 - 0.5).otherwise(lo0),
          "_hhi": F.when(const, hi0 + 0.5).otherwise(hi0)}
    lo, hi = F.col("_hlo"), F.col("_hhi")
    raw = F.floor(((x - lo) / (hi - lo)) * F.lit(float(bins))).cast("int")
    s2 = {"_hstep": (hi - lo) / F.lit(float(bins)),
          "_b0": F.when(raw >= bins, bins - 1).otherwise(raw)}

    def edge(j: Column) -> Column:
        return F.when(j >= bins, hi).otherwise(j.cast("double") * F.col("_hstep") + lo)

    b0 = F.col("_b0")
    s3 = {"_b1": F.when(x < edge(b0), b0 - 1).otherwise(b0)}
    b1 = F.col("_b1")
    s4 = {"_bin": F.when((x >= edge(b1 + 1)) & (b1 != bins - 1), b1 + 1).otherwise(b1)}
    return [s1, s2, s3, s4]


def hist_aggs(bins: int = HIST_BINS) -> dict[str, Column]:
    b = F.col("_bin")
    return {f"_h{j}": F.count_if(b == j) for j in range(bins)}


def hist_entropy(bins: int = HIST_BINS, eps: float = HIST_EPS) -> Column:
    """entropy of the density histogram + eps, normalised."""
    n = F.col("n").cast("double")
    lo0, hi0 = F.col("min"), F.col("max")
    width = F.when(lo0 == hi0, F.lit(1.0)).otherwise(hi0 - lo0) / F.lit(float(bins))
    dens = [F.col(f"_h{j}") / width / n + F.lit(eps) for j in range(bins)]
    total = dens[0]
    for d in dens[1:]:
        total = total + d
    ent = None
    for d in dens:
        p = d / total
        term = p * F.log(p)
        ent = term if ent is None else ent + term
    return -ent


def moment_finals() -> dict[str, Column]:
    q = F.col("_q")
    return {
        "median": q[1],                                      # F5
        "range": F.col("max") - F.col("min"),                # F6
        "iqr": q[2] - q[0],                                  # F11
        "entropy": hist_entropy(),                           # F12
        # constant signals: the moment ratio is undefined (NULL here, NaN in
        # NumPy); both become 0 in the filled feature matrix
        "skew": F.coalesce(F.col("skew"), F.lit(0.0)),
        "kurtosis": F.coalesce(F.col("kurtosis"), F.lit(0.0)),
    }
