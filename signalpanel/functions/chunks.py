"""F1–F21 of signals of any length, no task holding a signal.

A signal (a subject's kept windows in a row, W7) is cut into chunks of
``chunk`` frames. Each chunk also gets the ``MAX_LAG`` frames on either side,
so every lag and lead of its own frames is there, and its frames are reduced
where they lie:

* moments, slope, extremes, crossings, second differences, curve lengths by
  (step, residue), ordinal patterns and rolling sums have states that merge;
  Spark's partial aggregation builds one per chunk's task and merges them by
  signal, so a signal reaches its last aggregate as a few rows;
* histogram counts need the signal's extremes: a second pass over the chunks,
  each of which takes its own copy of its signal's extremes;
* quartiles come from the bracketing order statistics of ``operators.quantile``;
* the spectrum comes from ``functions.long_spectrum``.

Signals differ in length; a short one is a single chunk and takes the same way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.quantile import exact_quantiles
from ..session import ensure_checkpoint_dir
from . import complexity, long_spectrum, moments, rolling, spectral
from .matrix import SPECS, FeatureSpec
from .signal import MAX_LAG, long_frames

#: Frames of a chunk (each lag window sorts one chunk and its borders).
CHUNK = 4096


def chunk_rows(signals: DataFrame, keys: Sequence[str], chunk: int = CHUNK, max_lag: int = MAX_LAG) -> DataFrame:
    """Every frame of ``(*keys, frame_idx, x)`` once, with its ``chunk`` and
    the lags and leads up to ``max_lag``, missing just at the signal's ends."""
    if chunk < max_lag:
        raise ValueError(f"a chunk of {chunk} frames is shorter than the lag {max_lag}")
    own, at = F.floor(F.col("frame_idx") / chunk), F.pmod(F.col("frame_idx"), F.lit(chunk))
    homes = F.array_compact(F.array(own, F.when((at < max_lag) & (own > 0), own - 1), F.when(at >= chunk - max_lag, own + 1)))
    rows = signals.select(*keys, "frame_idx", "x", own.alias("_own"), F.explode(homes).alias("chunk"))
    w = Window.partitionBy(*keys, "chunk").orderBy("frame_idx")
    near = {f"{name}{k}": fn("x", k).over(w) for k in range(1, max_lag + 1) for name, fn in (("lag", F.lag), ("lead", F.lead))}
    return rows.withColumns(near).filter("chunk = _own").drop("_own")


def signal_states(rows: DataFrame, keys: Sequence[str], spec: FeatureSpec) -> DataFrame:
    """One merged state per signal from the frames of all its chunks."""
    helpers = {**complexity.crossing_rows(), **complexity.higuchi_rows(), **complexity.perm_rows()}
    aggs = {**moments.moment_aggs(quartiles=False), **complexity.crossing_aggs(), **complexity.higuchi_aggs(), **complexity.perm_aggs()}
    if spec.rolling != "none":
        helpers.update(rolling.rolling_rows(spec.rolling_widths))
        aggs.update(rolling.rolling_aggs(spec.rolling_widths))
    return rows.withColumns(helpers).groupBy(*keys).agg(*[c.alias(k) for k, c in aggs.items()])


def histogram_counts(signals: DataFrame, states: DataFrame, keys: Sequence[str], chunk: int = CHUNK) -> DataFrame:
    """Second pass: bin counts between each signal's extremes, which are
    copied to the signal's chunks so that the join meets chunks, not signals."""
    copies = states.select(*keys, F.col("min").alias("lo"), F.col("max").alias("hi"),
                           F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / chunk))).alias("chunk"))
    rows = signals.withColumn("chunk", F.floor(F.col("frame_idx") / chunk)).join(copies, [*keys, "chunk"])
    for stage in moments.hist_rows():
        rows = rows.withColumns(stage)
    return rows.groupBy(*keys).agg(*[c.alias(k) for k, c in moments.hist_aggs().items()])


def long_signal_features(frames: DataFrame, window_key: Sequence[str], channels: Sequence[str],
                         spec: FeatureSpec = SPECS["subject"], chunk: int = CHUNK) -> DataFrame:
    """The rows of ``matrix.window_features`` for signals of any length.
    Frames hold a dense ``frame_idx`` per key; signals of one frame give no row."""
    keys = [*window_key, "channel"]
    ensure_checkpoint_dir(frames.sparkSession)
    # read once: the states, the histogram, the quartiles and the spectrum each pass over it
    signals = long_frames(frames, window_key, channels).filter("x is not null").checkpoint()
    states = signal_states(chunk_rows(signals, keys, chunk), keys, spec).filter("n >= 2").checkpoint()
    quartiles = exact_quantiles(signals, keys, "x", [0.25, 0.5, 0.75], prefix="_q")
    peaks = long_spectrum.spectral_peaks(signals, states.select(*keys, "n"), keys, chunk)
    out = (states.join(histogram_counts(signals, states, keys, chunk), keys).join(quartiles, keys).join(peaks, keys)
           .withColumn("_q", F.array("_q0", "_q1", "_q2")).withColumns(moments.moment_finals()))
    n = F.col("n")
    out = out.withColumns({"abs_accel_mean": F.col("_accel") / n, "perm_entropy": complexity.perm_entropy()})
    for stage in complexity.higuchi_fd():
        out = out.withColumns(stage)
    if spec.rolling == "if_len":
        out = out.withColumns({f"mean_w{w}": F.when(n >= w, F.col(f"mean_w{w}")) for w in spec.rolling_widths})
    out = out.withColumns({"fft_peak": F.col("_peak.k"), "fft_peak_amp": F.col("_peak.amp"),
                           "fft_peak_freq": spectral.fft_freq(F.col("_peak.k"), n, spec.fps)})
    return out.select(*keys, "n", *spec.names())
