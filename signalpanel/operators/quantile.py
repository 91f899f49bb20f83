"""Exact quantiles without holding a group in one task.

``percentile`` keeps every distinct value of a group in one aggregation
buffer; for a subject or feature that holds a large share of the rows that
is one task's memory. Here a sketch with a guaranteed rank error brackets each
quantile of a large group, and only the few distinct values inside the bracket
are ordered, which holds for any distribution (outliers, ties, narrow ranges).
The result uses NumPy's linear interpolation, including its two-sided formula.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000  # of the bracketing sketch: rank error n / ACCURACY
SMALL_GROUP = 100_000   # values per group that one aggregation buffer may hold


def largest_group(df: DataFrame, keys: Sequence[str], value: str) -> int:
    """Size of the largest group (one small aggregate job)."""
    n = df.groupBy(*keys).agg(F.count(F.col(value)).alias("_n"))
    return int(n.agg(F.max("_n")).first()[0] or 0)


def quantiles(df: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float],
              small_group: int = SMALL_GROUP, prefix: str = "q",
              largest: int | None = None) -> DataFrame:
    """Exact quantiles with a hot-group split: groups of at most
    ``small_group`` values use the ``percentile`` aggregate (its buffer is
    bounded by that size); larger groups go through
    :func:`exact_quantiles`, which never holds a group in one task. Both
    use NumPy's linear interpolation."""
    keys = list(keys)
    n = df.groupBy(*keys).agg(F.count(F.col(value)).alias("_n"))
    arr = F.percentile(F.col(value).cast("double"), F.array(*[F.lit(float(q)) for q in qs]))
    # one small job decides the plan: without hot groups the single
    # percentile aggregate is the whole plan
    if largest is None:   # callers that know the group sizes pass them in
        largest = int(n.agg(F.max("_n")).first()[0] or 0)
    if largest <= small_group:
        return df.groupBy(*keys).agg(arr.alias("_qa")).select(
            *keys, *[F.col("_qa")[i].alias(f"{prefix}{i}") for i in range(len(qs))])
    big = n.filter(F.col("_n") > small_group).select(*keys)
    small_rows = df.join(big, on=keys, how="left_anti")
    big_rows = df.join(big, on=keys, how="left_semi")
    small = small_rows.groupBy(*keys).agg(arr.alias("_qa")).select(
        *keys, *[F.col("_qa")[i].alias(f"{prefix}{i}") for i in range(len(qs))])
    return small.unionByName(exact_quantiles(big_rows, keys, value, qs, prefix=prefix))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float],
                    accuracy: int = ACCURACY, prefix: str = "q") -> DataFrame:
    """One row per group with columns ``{prefix}{i}`` = quantile ``qs[i]``.

    A sketch with a guaranteed rank error of n / accuracy brackets each
    quantile between two values, whatever the distribution. Rows below a
    bracket are only counted, rows inside it (some thousandths of the group)
    are counted by distinct value, and the exact order statistics follow from
    a running sum over those."""
    keys = list(keys)
    v, margin = F.col("_v"), 5.0 / accuracy
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(v.isNotNull())
    edges = [F.lit(min(1.0, max(0.0, q + d))) for q in qs for d in (-margin, margin)]
    st = rows.groupBy(*keys).agg(F.count(v).alias("_n"), F.min(v).alias("_mn"), F.max(v).alias("_mx"),
                                 F.percentile_approx(v, F.array(*edges), accuracy).alias("_e"))
    # target ranks (0-based) as NumPy: virtual index q·(n−1); bracket [_a, _b]
    few = F.col("_n") <= accuracy  # the margin must span whole ranks: a small group is its own bracket
    parts = [F.struct(F.lit(i).alias("qi"), (F.lit(float(q)) * (F.col("_n") - 1)).alias("vi"),
                      (F.col("_mn") if q <= margin else F.when(few, F.col("_mn")).otherwise(F.col("_e")[2 * i])).alias("a"),
                      (F.col("_mx") if q >= 1 - margin else F.when(few, F.col("_mx")).otherwise(F.col("_e")[2 * i + 1])).alias("b"))
             for i, q in enumerate(qs)]
    tg = st.select(*keys, "_n", F.explode(F.array(*parts)).alias("_t")).select(
        *keys, "_t.qi", F.col("_t.a").alias("_a"), F.col("_t.b").alias("_b"),
        F.floor("_t.vi").cast("long").alias("_lo"), (F.col("_t.vi") - F.floor("_t.vi")).alias("_frac"),
        F.least(F.floor("_t.vi").cast("long") + 1, F.col("_n") - 1).alias("_hi"))
    x = rows.join(tg.select(*keys, "qi", "_a", "_b"), on=keys).filter(v <= F.col("_b"))
    # rows in front of the bracket share one value key (NULL)
    c = x.groupBy(*keys, "qi", F.when(v >= F.col("_a"), v).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    run = Window.partitionBy(*keys, "qi").orderBy(F.col("_v").asc_nulls_first())
    c = c.withColumn("_upto", F.sum("_c").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    hit = c.join(tg.select(*keys, "qi", "_lo", "_hi", "_frac"), on=[*keys, "qi"]).groupBy(*keys, "qi").agg(
        F.min(F.when(F.col("_upto") > F.col("_lo"), F.col("_v"))).alias("_a"),
        F.min(F.when(F.col("_upto") > F.col("_hi"), F.col("_v"))).alias("_b"), F.first("_frac").alias("_t"))
    d, t = F.col("_b") - F.col("_a"), F.col("_t")
    lerp = F.when(t >= 0.5, F.col("_b") - d * (F.lit(1.0) - t)).otherwise(F.col("_a") + d * t)
    return hit.groupBy(*keys).agg(*[F.max(F.when(F.col("qi") == i, lerp)).alias(f"{prefix}{i}") for i in range(len(qs))])
