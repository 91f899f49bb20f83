"""Row-level stage shared by all per-window features.

Input: long frames ``(*window_key, channel, frame_idx, x)`` with a dense
``frame_idx`` (0..n-1 per window and channel).

One window specification — partitioned by the *window key only*, ordered by
``(channel, frame_idx)`` — gives every lag/lead the features need. Because
``HashPartitioning(window_key)`` also satisfies every later grouping on
``(window_key, channel[, k])`` and the final pivot on ``window_key``, the
whole feature plan costs one exchange of the frames (zero when the input is
already clustered by the window key, e.g. after ``drop_incomplete``).

A lag or lead that would cross into the neighbouring channel is masked by
index arithmetic (the index is dense), so no second partitioning is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_LAG = 5  # Higuchi kmax; also covers rolling half-width 3 and lead 2


def signal_rows(long_df: DataFrame, window_key: Sequence[str],
                max_lag: int = MAX_LAG) -> DataFrame:
    """Attach ``n, lo, hi, lag1..lagK, lead1..leadK`` to every frame."""
    wk = list(window_key)
    w = Window.partitionBy(*wk).orderBy("channel", "frame_idx")
    wch = Window.partitionBy(*wk, "channel")
    idx = F.col("frame_idx")
    n = F.col("n")
    cols: dict[str, Column] = {
        "n": F.count("x").over(wch).cast("int"),
        "lo": F.min("x").over(wch),
        "hi": F.max("x").over(wch),
    }
    out = long_df.withColumns(cols)
    lagcols = {}
    for k in range(1, max_lag + 1):
        lagcols[f"lag{k}"] = F.when(idx >= k, F.lag("x", k).over(w))
        lagcols[f"lead{k}"] = F.when(idx + k <= n - 1, F.lead("x", k).over(w))
    return out.withColumns(lagcols)


def long_frames(frames: DataFrame, window_key: Sequence[str],
                channels: Sequence[str]) -> DataFrame:
    """Unpivot wide channel columns to ``(…, channel, frame_idx, x)``.

    Written as an explode of ``array<struct<channel, x>>`` rather than
    ``unpivot``: a generator keeps the child's partitioning, so frames that
    arrive clustered by the window key are not shuffled again (an Expand
    would forget the clustering and re-shuffle the 17× larger long table).
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).cast("double").alias("x"))
                      for c in channels])
    return (frames.select(*window_key, "frame_idx", F.explode(pairs).alias("_cx"))
            .select(*window_key, "frame_idx", "_cx.channel", "_cx.x"))
