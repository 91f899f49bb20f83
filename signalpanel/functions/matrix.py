"""Feature extraction plan (F1–F22 per window-channel) and the wide
feature matrix (F23).

Physical plan: [one exchange on the window key] → Window (lags/leads,
per-channel n/min/max) → aggregate on (window, channel) with every feature as
a (conditional) aggregate and the samples as an array for the FFT. The wide
matrix gathers one feature array per channel and flattens it once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import complexity, moments, rolling, spectral
from .signal import long_frames, signal_rows


@dataclass(frozen=True)
class FeatureSpec:
    """Switches between the feature variants of the four pipelines."""
    name: str = "multilabel"
    fps: float = 30.0                 # Hz; 1.0 → cycles per sample
    zero_cross_on: str = "delta"      # "delta" | "signal"
    with_fft_peak_index: bool = False
    rolling: str = "always"           # "always" | "if_len" | "none"
    rolling_widths: tuple = (3, 5, 7)

    def names(self) -> list[str]:
        out = ["mean", "std", "min", "max", "median", "range", "skew", "kurtosis",
               "energy", "slope", "iqr", "entropy", "var"]
        if self.with_fft_peak_index:
            out.append("fft_peak")
        out += ["fft_peak_freq", "fft_peak_amp"]
        out.append("zero_crossings_delta" if self.zero_cross_on == "delta" else "zero_crossings")
        out += ["abs_accel_mean", "higuchi_fd", "perm_entropy"]
        if self.rolling != "none":
            out += [f"mean_w{w}" for w in self.rolling_widths]
        return out


SPECS = {
    # multi-label panel: 22 per channel, Hz at 30 fps, crossings of the delta
    "multilabel": FeatureSpec(),
    # window-level panel: 23 per channel, cycles/sample, crossings of the signal,
    # rolling means only when the window is at least w long
    "window": FeatureSpec("window", fps=1.0, zero_cross_on="signal",
                          with_fft_peak_index=True, rolling="if_len"),
    # subject-level panel: 20 per channel, no rolling means
    "subject": FeatureSpec("subject", fps=1.0, zero_cross_on="signal",
                           with_fft_peak_index=True, rolling="none"),
}


def channel_features(long_df: DataFrame, window_key: Sequence[str],
                     spec: FeatureSpec = SPECS["multilabel"]) -> DataFrame:
    """F1–F22 per ``(window, channel)`` from long frames
    ``(*window_key, channel, frame_idx, x)``. Channels with fewer than two
    frames produce no row (their features are filled with 0 later)."""
    wk = list(window_key)
    keys = wk + ["channel"]
    rows = signal_rows(long_df, wk).filter(F.col("n") >= 2)
    feat_rows = rows
    for stage in moments.hist_rows():
        feat_rows = feat_rows.withColumns(stage)
    helpers = {**complexity.crossing_rows(), **complexity.higuchi_rows(),
               **complexity.perm_rows()}
    if spec.rolling != "none":
        helpers.update(rolling.rolling_rows(spec.rolling_widths))
    feat_rows = feat_rows.withColumns(helpers)
    aggs = {**moments.moment_aggs(), **moments.hist_aggs(),
            **complexity.crossing_aggs(), **complexity.higuchi_aggs(),
            **complexity.perm_aggs(), "_xs": spectral.signal_agg()}
    if spec.rolling != "none":
        aggs.update(rolling.rolling_aggs(spec.rolling_widths))
    agg = feat_rows.groupBy(*keys).agg(*[c.alias(k) for k, c in aggs.items()])
    agg = agg.withColumns(moments.moment_finals())
    n = F.col("n")
    agg = agg.withColumns({
        "abs_accel_mean": F.col("_accel") / n,
        "perm_entropy": complexity.perm_entropy(),
    })
    for stage in complexity.higuchi_fd():
        agg = agg.withColumns(stage)
    if spec.rolling == "if_len":
        agg = agg.withColumns({f"mean_w{w}": F.when(n >= w, F.col(f"mean_w{w}"))
                               for w in spec.rolling_widths})
    out = agg.withColumn("_peak", spectral.fft_peak("_xs")).withColumns({
        "fft_peak": F.col("_peak.k"), "fft_peak_amp": F.col("_peak.amp"),
        "fft_peak_freq": spectral.fft_freq(F.col("_peak.k"), n, spec.fps),
    })
    return out.select(*keys, "n", *spec.names())


def window_features(frames: DataFrame, window_key: Sequence[str],
                    channels: Sequence[str],
                    spec: FeatureSpec = SPECS["multilabel"]) -> DataFrame:
    """Wide frames → long per-channel feature rows."""
    return channel_features(long_frames(frames, window_key, channels), window_key, spec)


def feature_matrix(features: DataFrame, windows: DataFrame,
                   window_key: Sequence[str], channels: Sequence[str],
                   spec: FeatureSpec = SPECS["multilabel"]) -> DataFrame:
    """F23 + W12: one row per window with ``<channel>_<feature>`` columns,
    missing → 0, joined to the window table (labels etc.). Both sides are
    grouped by the window key, so the join is co-partitioned."""
    names = spec.names()
    # one array of features per (window, channel); the wide row picks from it
    arr = F.array(*[F.nanvl(F.coalesce(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)) for f in names])
    by_channel = features.select(*window_key, "channel", arr.alias("_f")).groupBy(*window_key).agg(
        F.map_from_entries(F.collect_list(F.struct("channel", "_f"))).alias("_m"))
    out = windows.join(by_channel, on=list(window_key), how="left")
    out = out.select(*windows.columns, *[F.col("_m")[c].alias(f"_a_{i}") for i, c in enumerate(channels)])
    return out.select(*windows.columns, *[F.coalesce(F.col(f"_a_{i}")[j], F.lit(0.0)).alias(f"{c}_{f}")
                                          for i, c in enumerate(channels) for j, f in enumerate(names)])


def feature_columns(channels: Sequence[str], spec: FeatureSpec = SPECS["multilabel"]) -> list[str]:
    return [f"{c}_{f}" for c in channels for f in spec.names()]
