"""Scaling and feature selection (P1–P8), fitted on train rows only.

Features are one ``array<double>`` column ``x`` per row (assembled once
from the wide matrix), so a fitted scaler is a tiny table — one row per
``by`` group (e.g. fold) holding per-feature statistics as arrays. Its size
is groups × features, independent of the row count, so it is broadcast and
applied row-locally with ``zip_with`` (no shuffle of the feature rows).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import ensure_checkpoint_dir

SCALERS = ("standard", "minmax", "robust", "power", "none")
#: Yeo-Johnson search: a first window, moved on while its best point is at an
#: end, then finer steps around the best point, down to 1e-4.
POWER_LAMBDAS = [round(-3.0 + 0.1 * i, 10) for i in range(61)]
POWER_DIGITS = (2, 3, 4)


def power_steps(digits: int) -> list[float]:
    return [round(i * 10.0 ** -digits, 10) for i in range(-9, 10)]


def assemble(df: DataFrame, cols: Sequence[str], out: str = "x") -> DataFrame:
    """Wide feature columns → one ``array<double>`` column."""
    return df.withColumn(out, F.array(*[F.col(c).cast("double") for c in cols]))


def nan_to_num(x: Column, posinf: float = 1e6, neginf: float = -1e6) -> Column:
    """NaN → 0, +inf → posinf, −inf → neginf, element-wise."""
    return F.transform(x, lambda v: F.when(F.isnan(v) | v.isNull(), F.lit(0.0))
                       .when(v == float("inf"), F.lit(posinf))
                       .when(v == float("-inf"), F.lit(neginf)).otherwise(v))


def _long(df: DataFrame, by: Sequence[str], col: str = "x") -> DataFrame:
    return df.select(*by, F.posexplode(col).alias("j", "v"))


def _to_arrays(stats: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    s = stats.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("j", *names))).alias("_s"))
    return s.select(*by, *[F.col("_s")[n].alias(n) for n in names])


def fit_scaler(train: DataFrame, kind: str = "standard", by: Sequence[str] = (),
               col: str = "x", exact: bool = True) -> DataFrame:
    """P1–P5 fit: per-feature statistics on the train rows of each group.

    standard: mean and population std (0 → 1); minmax: min and range
    (0 → 1, so constants map to 0); robust: median and IQR (0 → 1), exact
    percentiles, or ``exact=False`` for bounded-memory sketches at scale;
    power: Yeo-Johnson λ by maximum likelihood (to 1e-4, no bounds),
    then the mean/std of the transformed values.
    """
    if kind not in SCALERS:
        raise ValueError(f"unknown scaler {kind!r}")
    by = list(by)
    lf = _long(train, by, col)
    v = F.col("v")
    if kind == "none":
        return train.select(*by).distinct().withColumn("kind", F.lit("none"))
    if kind == "standard":
        st = lf.groupBy(*by, "j").agg(F.avg(v).alias("a"), F.stddev_pop(v).alias("s"))
    elif kind == "minmax":
        st = lf.groupBy(*by, "j").agg(F.min(v).alias("a"), (F.max(v) - F.min(v)).alias("s"))
    elif kind == "robust":
        if exact:   # exact, skew-safe order statistics (no group held in one task)
            from .quantile import quantiles
            qq = quantiles(lf, [*by, "j"], "v", [0.25, 0.5, 0.75])
            st = qq.select(*by, "j", F.col("q1").alias("a"), (F.col("q2") - F.col("q0")).alias("s"))
        else:       # bounded-memory sketch
            q = F.percentile_approx(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 10000)
            st = lf.groupBy(*by, "j").agg(q.alias("_q")).select(
                *by, "j", F.col("_q")[1].alias("a"), (F.col("_q")[2] - F.col("_q")[0]).alias("s"))
    else:
        st = _fit_power(train, by, col)
    st = st.withColumn("s", F.when(F.col("s").isNull() | (F.col("s") == 0), F.lit(1.0)).otherwise(F.col("s")))
    names = ["a", "s"] + (["lam"] if kind == "power" else [])
    return _to_arrays(st, by, names).withColumn("kind", F.lit(kind))


def _yj(v: Column, lam: Column) -> Column:
    """Yeo-Johnson transform of v for λ."""
    pos = F.when(F.abs(lam) < 1e-12, F.log1p(v)).otherwise((F.pow(v + 1.0, lam) - 1.0) / lam)
    l2 = F.lit(2.0) - lam
    neg = F.when(F.abs(l2) < 1e-12, -F.log1p(-v)).otherwise(-(F.pow(-v + 1.0, l2) - 1.0) / l2)
    return F.when(v >= 0, pos).otherwise(neg)


def _yj_np(v, lam):
    """Yeo-Johnson transform, vectorised over values × λ."""
    grow, fall = np.log1p(np.maximum(v, 0)), np.log1p(np.maximum(-v, 0))
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        up = np.where(np.abs(lam) < 1e-12, grow, np.expm1(lam * grow) / np.where(lam == 0, 1, lam))
        low = np.where(np.abs(2 - lam) < 1e-12, fall, np.expm1((2 - lam) * fall) / np.where(lam == 2, 1, 2 - lam))
    return np.where(v >= 0, up, -low)


def _power_sums(keys: list[str]):
    """Per batch, group and feature: count, Σ sign·ln(1+|x|), and for each λ
    the mean and the sum of squared deviations of the transformed values."""
    def run(batches):
        for b in batches:
            pdf = b.to_pandas()
            if not len(pdf):
                continue
            out = []
            for key, g in pdf.groupby(keys, dropna=False) if keys else [((), pdf)]:
                x = np.vstack(g["x"].to_numpy())
                lam = np.vstack(g["lams"].iloc[0]).astype(float)           # features × λ
                for j in range(x.shape[1]):
                    t = _yj_np(x[:, j, None], lam[j][None, :])
                    mean = t.mean(0)
                    out.append((*(key if isinstance(key, tuple) else (key,)), j, len(g),
                                float((np.sign(x[:, j]) * np.log1p(np.abs(x[:, j]))).sum()),
                                mean.tolist(), ((t - mean) ** 2).sum(0).tolist()))
            yield pa.RecordBatch.from_pylist([dict(zip([*keys, "j", "n", "sl", "mean", "m2"], r)) for r in out],
                                             schema=run.schema) if out else pa.RecordBatch.from_pylist([], schema=run.schema)
    return run


def _likelihood(train: DataFrame, by: Sequence[str], col: str, lams: DataFrame) -> DataFrame:
    """``(*by, j, lam, L, a, s)``: log-likelihood, mean and std at each λ of
    ``lams`` (``*by, lams``: one array of λ per feature). Batches are reduced
    to one row per group and feature before anything is shuffled."""
    by = list(by)
    rows = train.select(*by, F.col(col).alias("x"))
    rows = rows.join(F.broadcast(lams), on=by) if by else rows.crossJoin(F.broadcast(lams))  # one row per group
    fields = [f"`{c}` {dict(train.dtypes)[c]}" for c in by]
    schema = ", ".join([*fields, "j int", "n long", "sl double", "mean array<double>", "m2 array<double>"])
    run = _power_sums(by)
    empty = train.sparkSession.createDataFrame([], schema)
    run.schema = to_arrow_schema(empty.schema)
    part = rows.mapInArrow(run, schema)
    wide = part.select(*by, "j", "n", "sl", F.posexplode(F.arrays_zip("mean", "m2")).alias("i", "z"))
    n, mean = F.col("n"), F.col("z.mean")
    # around the common mean: squares of the means would cancel where a λ presses all values together
    at = Window.partitionBy(*by, "j", "i")  # one row per batch
    wide = wide.withColumn("a", F.sum(n * mean).over(at) / F.sum("n").over(at))
    off = mean - F.col("a")
    total = wide.groupBy(*by, "j", "i").agg(
        F.sum("n").alias("n"), F.sum("sl").alias("sl"), F.first("a").alias("a"), F.sum(F.col("z.m2") + n * off * off).alias("w"))
    var = F.col("w") / F.col("n")
    at = lams.select(*by, F.posexplode("lams").alias("j", "_l")).select(*by, "j", F.posexplode("_l").alias("i", "lam"))
    out = total.withColumn("vt", var).join(at, on=[*by, "j", "i"])
    like = (-F.col("n") / 2.0 * F.log(F.greatest(F.col("vt"), F.lit(1e-300))) + (F.col("lam") - 1.0) * F.col("sl"))
    return out.select(*by, "j", "lam", like.alias("L"), "a", F.sqrt("vt").alias("s"))


def _fit_power(train: DataFrame, by: Sequence[str], col: str = "x") -> DataFrame:
    """λ per feature maximising the Yeo-Johnson log-likelihood
    −n/2·ln σ²(ψ) + (λ−1)·Σ sign(x)·ln(1+|x|), for all features at once:
    the window of λ is moved until its best point is inside, then finer steps
    around it follow; one aggregate per step. With mean and std at that λ."""
    by = list(by)

    def best(like):
        pick = F.max_by(F.struct("lam", "a", "s"), F.struct("L", -F.abs(F.col("lam") - 1.0)))
        return like.groupBy(*by, "j").agg(pick.alias("b")).select(*by, "j", "b.*")

    def around(found, steps, digits):
        """One array of λ per feature, around the best so far."""
        near = F.transform(F.array(*[F.lit(x) for x in steps]), lambda d: F.round(F.col("lam") + d, digits))
        return found.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("j", near.alias("v")))), lambda s: s["v"]).alias("lams"))

    ensure_checkpoint_dir(train.sparkSession)
    width = train.groupBy(*by).agg(F.max(F.size(col)).alias("_d"))
    grid = F.array(*[F.lit(x) for x in POWER_LAMBDAS])
    found = best(_likelihood(train, by, col, width.select(*by, F.array_repeat(grid, F.col("_d")).alias("lams")))).checkpoint()
    reach = max(POWER_LAMBDAS)
    varies = F.col("s") > 1e-12 * F.abs("a")  # a constant feature has no best λ
    at_end = found.filter(varies & (F.abs("lam") >= reach - 1e-9))
    while not at_end.isEmpty():  # one row per group and feature
        # features at an end of their window look one window further; the others look around their best again
        moved = best(_likelihood(train, by, col, around(found, POWER_LAMBDAS, 1))).checkpoint()
        ends = moved.join(found.select(*by, "j", F.col("lam").alias("_was")), [*by, "j"])
        at_end, found = ends.filter(varies & (F.abs(F.col("lam") - F.col("_was")) >= reach - 1e-9)), moved
    for digits in POWER_DIGITS[:-1]:
        found = best(_likelihood(train, by, col, around(found, power_steps(digits), digits))).checkpoint()
    return best(_likelihood(train, by, col, around(found, power_steps(POWER_DIGITS[-1]), POWER_DIGITS[-1]))).select(*by, "j", "a", "s", "lam")


def apply_scaler(df: DataFrame, params: DataFrame, kind: str = "standard", by: Sequence[str] = (),
                 col: str = "x", out: str | None = None) -> DataFrame:
    """P7 transform: join the (broadcast) parameter row of the group and
    scale element-wise; no shuffle of ``df``."""
    out = out or col
    if kind == "none":
        return df
    p = params.drop("kind")
    j = df.join(F.broadcast(p), on=list(by)) if by else df.crossJoin(F.broadcast(p))
    if kind == "power":
        t = F.zip_with(col, "lam", lambda v, lm: _yj(v, lm))
        j = j.withColumn("_t", t)
        src = "_t"
    else:
        src = col
    scaled = F.zip_with(F.zip_with(src, "a", lambda v, a: v - a), "s", lambda d, s: d / s)
    cols = [c for c in df.columns if c != out]
    return j.select(*cols, scaled.alias(out))


def select_k_best(train: DataFrame, label_k: DataFrame, by: Sequence[str] = (), col: str = "x",
                  y: str = "y", bins: int = 10) -> DataFrame:
    """Rank features by (binned) mutual information with the label on
    train rows and keep the top K per group (K per label, capped at the
    feature count; ties → lower feature index).

    ``label_k`` has ``label, k_best``; rows are long ``(*by, label, x, y)``.
    Equal-width bins on the train range; MI = Σ p(b,y)·ln(p(b,y)/(p(b)p(y))).
    """
    keys = [*by, "label"]
    lf = train.select(*keys, F.posexplode(col).alias("j", "v"))
    rng = lf.groupBy(*keys, "j").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    rng = rng.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("j", "lo", "hi"))).alias("_r"))

    def bin_of(v, r):
        return F.when(r["hi"] > r["lo"], F.least(F.lit(bins - 1), F.floor((v - r["lo"]) / (r["hi"] - r["lo"]) * bins))
                      ).otherwise(F.lit(0)).cast("int")

    # one range row per group (features × 2 numbers), joined to whole rows; a
    # row is binned in place and only partial counts are shuffled
    b = (train.join(F.broadcast(rng), on=keys)
         .select(*keys, y, F.posexplode(F.zip_with(col, "_r", bin_of)).alias("j", "bin")))
    c = b.groupBy(*keys, "j", "bin", y).agg(F.count(F.lit(1)).alias("n_by"))
    wj = Window.partitionBy(*keys, "j")
    c = c.withColumns({"n": F.sum("n_by").over(wj),
                       "n_b": F.sum("n_by").over(Window.partitionBy(*keys, "j", "bin")),
                       "n_y": F.sum("n_by").over(Window.partitionBy(*keys, "j", y))})
    term = (F.col("n_by") / F.col("n")) * F.log((F.col("n_by") * F.col("n")) / (F.col("n_b") * F.col("n_y")))
    mi = c.groupBy(*keys, "j").agg(F.sum(term).alias("mi"))
    nfeat = rng.select(*keys, F.size("_r").alias("_d"))
    w = Window.partitionBy(*keys).orderBy(F.col("mi").desc(), F.col("j"))
    ranked = (mi.withColumn("rank", F.row_number().over(w))
              .join(F.broadcast(label_k.select("label", "k_best")), on="label")
              .join(nfeat, on=keys)
              .filter(F.col("rank") <= F.least(F.col("k_best"), F.col("_d"))))
    return ranked.select(*keys, F.col("j").alias("feature"), "mi", "rank")


def apply_selection(df: DataFrame, selected: DataFrame, by: Sequence[str] = (), col: str = "x") -> DataFrame:
    """Keep the selected feature slots (in index order) of each row."""
    keys = [*by, "label"]
    sel = selected.groupBy(*keys).agg(F.sort_array(F.collect_list("feature")).alias("_sel"))
    j = df.join(F.broadcast(sel), on=keys)   # groups × labels rows, each ≤ K ints
    return j.withColumn(col, F.transform("_sel", lambda i: F.element_at(col, i + 1))).drop("_sel")
