"""Dominant non-DC frequency of each window-channel signal.

Peak = first maximum of |DFT[k]| over k = 1..n−1. For a real signal
|X[k]| = |X[n−k]|, so the first maximum always lies in k ≤ n/2 and only
that half is evaluated. Amplitudes are compared after rounding to 1e-9 so
that mirror-equal bins tie deterministically (smallest k wins).

The signal is gathered as one array by the aggregate that computes all other
features of the window (no branch, join or shuffle of its own), and a
vectorised function transforms a batch of arrays of any length with the real
FFT: O(n log n) per window and one row per window and channel.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

AMP_DECIMALS = 9
PEAK = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("amp", T.DoubleType())])


def signal_agg() -> Column:
    """The window's samples in frame order, as an aggregate."""
    return F.transform(F.sort_array(F.collect_list(F.struct("frame_idx", "x"))), lambda s: s["x"])


@F.pandas_udf(PEAK)
def fft_peak(signals: pd.Series) -> pd.DataFrame:
    """Peak bin and amplitude of each array (at least two samples)."""
    bins, sizes = np.empty(len(signals), np.int32), np.empty(len(signals))
    for i, x in enumerate(signals):
        amps = np.abs(np.fft.rfft(np.asarray(x, float)))[1:]
        k = int(np.argmax(np.round(amps, AMP_DECIMALS)))
        bins[i], sizes[i] = k + 1, amps[k]
    return pd.DataFrame({"k": bins, "amp": sizes})


def fft_freq(k: Column, n: Column, fps: float) -> Column:
    """Signed FFT bin frequency: k·fps/n, and −fps/2 at the Nyquist bin of
    an even-length signal (the sign convention of the usual fftfreq)."""
    d = 1.0 / fps
    val = F.lit(1.0) / (n.cast("double") * F.lit(d))
    return F.when(k * 2 == n, -(n / 2).cast("int") * val).otherwise(k * val)
