"""Expected window features, stated per feature from the published
definitions as strided-array expressions, plus hand-worked signals with
closed-form values. Used only as a test oracle."""

from __future__ import annotations

import math

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view


def _curve_length(x: np.ndarray, k: int) -> float | None:
    """Mean normalised length of the k decimated curves (Higuchi 1988). A
    decimated curve counts with its whole steps but the last; curves with
    fewer than two whole steps are left out."""
    lengths = []
    for curve in (x[m::k] for m in range(k)):
        whole = len(curve) - 1
        if whole >= 2:
            steps = np.abs(curve[1:whole] - curve[:whole - 1]).sum()
            lengths.append(steps * (len(x) - 1) / (whole * k * k))
    return float(np.mean(lengths)) if lengths else None


def higuchi_dimension(x, kmax: int = 5) -> float:
    x = np.asarray(x, float)
    if len(x) <= kmax:
        return 0.0
    lengths = [max(_curve_length(x, k) or 0.0, 1e-12) for k in range(1, kmax + 1)]
    design = np.column_stack([np.log(np.arange(1, kmax + 1)), np.ones(kmax)])
    return float(-np.linalg.lstsq(design, np.log(lengths), rcond=None)[0][0])


def ordinal_entropy(x) -> float:
    """Entropy of the order patterns of three successive samples (Bandt & Pompe)."""
    x = np.asarray(x, float)
    if len(x) < 3:
        return 0.0
    ranks = np.argsort(sliding_window_view(x, 3), axis=1, kind="stable") @ np.array([9, 3, 1])
    share = np.unique(ranks, return_counts=True)[1] / len(ranks)
    return float(-(share * np.log(share + 1e-10)).sum())


def density_entropy(x) -> float:
    density = np.histogram(x, bins=10, density=True)[0] + 1e-6
    share = density / density.sum()
    return float(-(share @ np.log(share)))


def peak(x) -> tuple[int, float]:
    """First largest non-constant component, by the Fourier sum itself."""
    x = np.asarray(x, float)
    bins, times = np.arange(1, len(x) // 2 + 1), np.arange(len(x))
    size = np.abs(np.exp(-2j * np.pi * np.outer(bins, times) / len(x)) @ x)
    best = int(np.argmax(np.round(size, 9)))
    return int(bins[best]), float(size[best])


def peak_frequency(k: int, n: int, rate: float) -> float:
    return -rate / 2 if 2 * k == n else k * rate / n


def rolling_mean(x, width: int) -> float:
    """Mean of the centred moving average that shrinks at the borders."""
    sums = np.convolve(x, np.ones(width), "same") if len(x) >= width else np.array(
        [x[max(0, i - width // 2):i + width // 2 + 1].sum() for i in range(len(x))])
    sizes = [min(len(x), i + width // 2 + 1) - max(0, i - width // 2) for i in range(len(x))]
    return float(np.mean(sums / sizes))


def expected(x, rate: float = 30.0) -> dict[str, float] | None:
    x = np.asarray(x, float)
    n = len(x)
    if n < 2:
        return None
    centred = x - x.mean()
    second = (centred ** 2).mean()
    steps = np.concatenate([[0.0], x[1:] - x[:-1]])
    bends = np.concatenate([[0.0], steps[1:] - steps[:-1]])
    low, mid, high = np.quantile(x, [0.25, 0.5, 0.75])
    k, size = peak(x)
    t = np.arange(n) - (n - 1) / 2
    return {
        "mean": x.mean(), "std": math.sqrt(second), "var": second, "min": x.min(), "max": x.max(),
        "median": mid, "iqr": high - low, "range": x.max() - x.min(), "energy": x @ x,
        "skew": (centred ** 3).mean() / second ** 1.5 if second > 0 else 0.0,
        "kurtosis": (centred ** 4).mean() / second ** 2 - 3 if second > 0 else 0.0,
        "slope": (t @ x) / (t @ t), "entropy": density_entropy(x),
        "fft_peak": k, "fft_peak_amp": size, "fft_peak_freq": peak_frequency(k, n, rate),
        "zero_crossings": np.count_nonzero(np.signbit(x[:-1] * x[1:]) & (x[:-1] * x[1:] != 0)),
        "zero_crossings_delta": np.count_nonzero(steps[:-1] * steps[1:] < 0),
        "abs_accel_mean": np.abs(bends).mean(), "higuchi_fd": higuchi_dimension(x), "perm_entropy": ordinal_entropy(x),
        **{f"mean_w{w}": rolling_mean(x, w) for w in (3, 5, 7)},
    }


def close(a, b, rel=1e-6, abs_=1e-6) -> bool:
    return math.isclose(float(a), float(b), rel_tol=rel, abs_tol=abs_)


#: Signals and the values that follow from their closed forms.
BY_HAND = {
    # 0, 1, ..., 11: every step is 1
    "ramp": ([float(v) for v in range(12)], {
        "mean": 5.5, "median": 5.5, "var": 143 / 12, "std": math.sqrt(143 / 12), "min": 0.0, "max": 11.0, "range": 11.0,
        "skew": 0.0, "slope": 1.0, "iqr": 5.5, "energy": 506.0, "zero_crossings_delta": 0, "abs_accel_mean": 1 / 12,
        "perm_entropy": -math.log(1 + 1e-10), "mean_w3": 5.5, "mean_w5": 5.5, "mean_w7": 5.5}),
    # three whole periods of a cosine over 24 samples: one spectral line of height n / 2
    "cosine": ([math.cos(2 * math.pi * 3 * i / 24) for i in range(24)], {
        "mean": 0.0, "var": 0.5, "kurtosis": -1.5, "skew": 0.0, "energy": 12.0, "fft_peak_amp": 12.0,
        "fft_peak_freq": 30 * 3 / 24, "range": 2.0}),
    "constant": ([2.5] * 9, {
        "mean": 2.5, "std": 0.0, "range": 0.0, "skew": 0.0, "kurtosis": 0.0, "slope": 0.0, "iqr": 0.0, "energy": 56.25,
        "zero_crossings_delta": 0, "abs_accel_mean": 0.0, "higuchi_fd": 0.0, "fft_peak_amp": 0.0, "mean_w7": 2.5}),
    # +1, -1, ...: all energy at half the sampling rate, every step turns
    "alternating": ([1.0, -1.0] * 4, {
        "mean": 0.0, "var": 1.0, "kurtosis": -2.0, "energy": 8.0, "fft_peak_amp": 8.0, "fft_peak_freq": -15.0,
        "zero_crossings_delta": 6, "abs_accel_mean": (2 + 6 * 4) / 8, "perm_entropy": -math.log(0.5 + 1e-10)}),
    "two": ([1.0, 4.0], {
        "mean": 2.5, "var": 2.25, "slope": 3.0, "iqr": 1.5, "fft_peak_amp": 3.0, "fft_peak_freq": -15.0,
        "higuchi_fd": 0.0, "perm_entropy": 0.0, "mean_w3": 2.5, "abs_accel_mean": 1.5}),
    # values 1, -2, 3, 3, 0.5: sum 5.5, squares 1 + 4 + 9 + 9 + 0.25
    "five": ([1.0, -2.0, 3.0, 3.0, 0.5], {
        "mean": 1.1, "median": 1.0, "energy": 23.25, "range": 5.0, "iqr": 2.5, "slope": 0.4, "higuchi_fd": 0.0,
        "zero_crossings_delta": 1, "abs_accel_mean": (3 + 8 + 5 + 2.5) / 5}),
    "pulse": ([0.0] * 7 + [8.0] + [0.0] * 8, {
        "mean": 0.5, "median": 0.0, "iqr": 0.0, "energy": 64.0, "fft_peak_amp": 8.0, "fft_peak_freq": 30 / 16,
        "zero_crossings_delta": 1, "abs_accel_mean": (8 + 16 + 8) / 16}),
}
