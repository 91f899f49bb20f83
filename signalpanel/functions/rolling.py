"""mean of the centred rolling mean (min_periods 1), widths 3/5/7.

Built from the lag/lead columns of :func:`signal_rows` (window sums that
stop at the channel's ends), so it shares the one window stage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDTHS = (3, 5, 7)


def rolling_rows(widths: Sequence[int] = WIDTHS) -> dict[str, Column]:
    out = {}
    for w in widths:
        h = w // 2
        s, c = F.col("x"), F.lit(1)
        for j in range(1, h + 1):
            for name in (f"lag{j}", f"lead{j}"):
                v = F.col(name)
                s = s + F.coalesce(v, F.lit(0.0))
                c = c + F.when(v.isNotNull(), 1).otherwise(0)
        out[f"_r{w}"] = s / c
    return out


def rolling_aggs(widths: Sequence[int] = WIDTHS) -> dict[str, Column]:
    return {f"mean_w{w}": F.avg(f"_r{w}") for w in widths}
