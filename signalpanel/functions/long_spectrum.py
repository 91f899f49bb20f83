"""F14–F16 for signals of any length: a Fourier transform spread over tasks.

The transform of n samples, n any number, is a convolution with a chirp
(Bluestein): with ``w(t) = exp(-iπt²/n)``,
``X[k] = w(k) · Σ_t x(t) w(t) · conj(w(k − t))``, taken over a circle of
``M = M1·M2`` points, a power of two. Transforms over the circle are split in
two dimensions, ``t = M2·t1 + t2`` and ``k = k1 + M1·k2``:

1. columns: the strided sub-signals ``t2 fixed``, transformed over t1 and
   multiplied by the twiddle factors ``exp(-2πi·t2·k1/M)``; the chirp takes
   the same way in the same group (it needs no rows);
2. rows: met again by k1, transformed over t2, signal times chirp, and the
   first half of the way back: inverse over k2, inverse twiddle factors;
3. columns: met again by t2, inverse over k1, giving ``X[k]`` of the bins in
   the block; each block keeps its largest bin of 1..n/2.

A group holds a block of columns or rows, ``BLOCK`` points or 16 lines of about
√M points, whichever is more; blocks travel between the steps as packed
sub-matrices. Signals of at most one chunk are transformed where they lie, in
one group each, with the real transform.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spectral import AMP_DECIMALS

#: Points that a group of columns or rows holds (in a few complex arrays), and lines at least.
BLOCK, LEAST_LINES = 1 << 16, 16


def circle(n: int) -> tuple[int, int]:
    """M1, M2: powers of two with M1·M2 >= 2n − 1."""
    bits = max(2, int(2 * n - 2).bit_length())
    return 1 << (bits + 1) // 2, 1 << bits // 2


def lines(points: int, hold: tuple[int, int] = (BLOCK, LEAST_LINES)) -> int:
    """Lines of so many points that a group takes."""
    return max(hold[1], hold[0] // points)


def _chirp(t: np.ndarray, n: int, sign: float) -> np.ndarray:
    """exp(sign·iπt²/n), the square reduced exactly."""
    return np.exp(sign * 1j * np.pi * ((t * t) % (2 * n)) / n)


def _peak_of(amp: np.ndarray, bins: np.ndarray) -> tuple[int, float]:
    k = int(np.argmax(np.round(amp, AMP_DECIMALS)))
    return int(bins[k]), float(amp[k])


def _packed(key: dict, at: int, size: int, matrix: np.ndarray) -> list[dict]:
    """Cut the lines × points matrix into the groups of the next step."""
    return [{**key, "_block": k // size, "_at": at, "_data": np.ascontiguousarray(matrix[..., k:k + size]).tobytes()}
            for k in range(0, matrix.shape[-1], size)]


def _columns(keys: Sequence[str], names: Sequence[str], hold: tuple[int, int]):
    """Step 1 on the frames of one block of columns."""
    def run(group, rows):
        n, at = rows.column("n")[0].as_py(), group[-1].as_py()
        m1, m2 = circle(n)
        wide = min(lines(m1, hold), m2)
        t2 = np.arange(at * wide, (at + 1) * wide)
        t = (np.arange(m1) * m2)[None, :] + t2[:, None]
        a = np.zeros((wide, m1), complex)
        real = rows.filter(rows.column("x").is_valid())
        idx = real.column("frame_idx").to_numpy()
        a[idx % m2 - at * wide, idx // m2] = real.column("x").to_numpy() * _chirp(idx, n, -1.0)
        back = np.minimum(t, m1 * m2 - t)  # the chirp is even on the circle
        b = np.where(back < n, _chirp(np.minimum(back, n), n, 1.0), 0)
        twiddle = np.exp(-2j * np.pi * (t2[:, None] * np.arange(m1)[None, :]) / (m1 * m2))
        both = np.stack([np.fft.fft(a, axis=1) * twiddle, np.fft.fft(b, axis=1) * twiddle])
        key = {c: v.as_py() for c, v in zip(keys, group)}
        return pa.Table.from_pylist([{**r, "n": n} for r in _packed(key, at, min(lines(m2, hold), m1), both)], _schema(rows, keys, names))
    return run


def _rows(keys: Sequence[str], names: Sequence[str], hold: tuple[int, int]):
    """Step 2 on the sub-matrices of one block of rows."""
    def run(group, parts):
        n, at = parts.column("n")[0].as_py(), group[-1].as_py()
        m1, m2 = circle(n)
        high, wide = min(lines(m2, hold), m1), min(lines(m1, hold), m2)
        whole = np.empty((2, m2, high), complex)
        for p, data in zip(parts.column("_at").to_pylist(), parts.column("_data").to_pylist()):
            whole[:, p * wide:(p + 1) * wide] = np.frombuffer(data, complex).reshape(2, wide, high)
        over = np.fft.fft(whole, axis=1)
        product = np.fft.ifft(over[0] * over[1], axis=0)  # over k2, back to t2
        k1 = np.arange(at * high, (at + 1) * high)
        product = product * np.exp(2j * np.pi * (np.arange(m2)[:, None] * k1[None, :]) / (m1 * m2))
        key = {c: v.as_py() for c, v in zip(keys, group)}
        return pa.Table.from_pylist([{**r, "n": n} for r in _packed(key, at, wide, product.T)], _schema(parts, keys, names))
    return run


def _back(keys: Sequence[str], hold: tuple[int, int]):
    """Step 3 on the sub-matrices of one block of columns: its largest bin."""
    def run(group, parts):
        n, at = parts.column("n")[0].as_py(), group[-1].as_py()
        m1, m2 = circle(n)
        high, wide = min(lines(m2, hold), m1), min(lines(m1, hold), m2)
        whole = np.empty((m1, wide), complex)
        for p, data in zip(parts.column("_at").to_pylist(), parts.column("_data").to_pylist()):
            whole[p * high:(p + 1) * high] = np.frombuffer(data, complex).reshape(high, wide)
        x = np.abs(np.fft.ifft(whole, axis=0))  # the last chirp factor has size 1
        bins = (np.arange(m1) * m2)[:, None] + np.arange(at * wide, (at + 1) * wide)[None, :]
        ours = (bins >= 1) & (bins <= n // 2)
        order = np.argsort(bins[ours])
        found = [_peak_of(x[ours][order], bins[ours][order])] if ours.any() else []
        return pa.Table.from_pylist([{**{c: v.as_py() for c, v in zip(keys, group)}, "k": k, "amp": s} for k, s in found],
                                    pa.schema([*[parts.schema.field(c) for c in keys], ("k", pa.int64()), ("amp", pa.float64())]))
    return run


def _schema(table: pa.Table, keys: Sequence[str], names: Sequence[str]) -> pa.Schema:
    kinds = {"_block": pa.int64(), "_at": pa.int64(), "_data": pa.binary(), "n": pa.int64()}
    return pa.schema([table.schema.field(c) if c in keys else pa.field(c, kinds[c]) for c in names])


def _short(keys: Sequence[str]):
    def run(group, rows):
        order = np.argsort(rows.column("frame_idx").to_numpy())
        amp = np.abs(np.fft.rfft(rows.column("x").to_numpy()[order]))[1:]
        k, size = _peak_of(amp, np.arange(1, len(amp) + 1))
        return pa.Table.from_pylist([{**{c: v.as_py() for c, v in zip(keys, group)}, "k": k, "amp": size}],
                                    pa.schema([*[rows.schema.field(c) for c in keys], ("k", pa.int64()), ("amp", pa.float64())]))
    return run


def _m2(n: Column) -> Column:
    """``circle(n)[1]`` as a column."""
    bits = F.greatest(F.lit(2), F.length(F.bin(2 * n - 2)))
    return F.pow(F.lit(2.0), F.floor(bits / 2)).cast("long")


def _wide(n: Column, hold: tuple[int, int]) -> Column:
    """Columns in a group of step 1."""
    bits = F.greatest(F.lit(2), F.length(F.bin(2 * n - 2)))
    m1 = F.pow(F.lit(2.0), F.floor((bits + 1) / 2)).cast("long")
    return F.least(F.greatest(F.lit(hold[1]), F.floor(F.lit(hold[0]) / m1)), _m2(n)).cast("long")


def spectral_peaks(signals: DataFrame, sizes: DataFrame, keys: Sequence[str], chunk: int,
                   hold: tuple[int, int] = (BLOCK, LEAST_LINES)) -> DataFrame:
    """Per signal ``_peak`` (``k``, ``amp``): the first largest of the bins
    1..n/2. ``signals`` holds ``(*keys, frame_idx, x)``, ``sizes`` ``(*keys, n)``
    with n >= 2. ``hold`` (points, lines) are powers of two."""
    if any(h < 1 or h & (h - 1) for h in hold):
        raise ValueError(f"{hold} are not powers of two")
    keys = list(keys)
    kinds = dict(signals.dtypes)
    key_schema = ", ".join(f"`{c}` {kinds[c]}" for c in keys)
    peak = f"{key_schema}, k long, amp double"
    sizes = sizes.select(*keys, F.col("n").cast("long").alias("n"))
    # lengths are copied to the chunks, so that the join meets chunks, not signals
    per_chunk = sizes.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / chunk))).alias("chunk"))
    sized = signals.withColumn("chunk", F.floor(F.col("frame_idx") / chunk)).join(per_chunk, [*keys, "chunk"]).drop("chunk")
    short = sized.filter(F.col("n") <= chunk).groupBy(*keys).applyInArrow(_short(keys), peak)
    names = [*keys, "n", "_block", "_at", "_data"]
    packed = f"{key_schema}, n long, _block long, _at long, _data binary"
    frames = sized.filter(F.col("n") > chunk).withColumn("frame_idx", F.col("frame_idx").cast("long"))
    frames = frames.select(*keys, "n", "frame_idx", "x", F.floor(F.pmod("frame_idx", _m2(F.col("n"))) / _wide(F.col("n"), hold)).alias("_block"))
    # every block of columns takes part, also where the circle holds no frame
    blocks = sizes.filter(F.col("n") > chunk).select(
        *keys, "n", F.lit(None).cast("long").alias("frame_idx"), F.lit(None).cast("double").alias("x"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((_m2(F.col("n")) - 1) / _wide(F.col("n"), hold)))).alias("_block"))
    step = frames.unionByName(blocks).groupBy(*keys, "_block").applyInArrow(_columns(keys, names, hold), packed)
    step = step.groupBy(*keys, "_block").applyInArrow(_rows(keys, names, hold), packed)
    long = step.groupBy(*keys, "_block").applyInArrow(_back(keys, hold), peak)
    first = F.max_by(F.struct("k", "amp"), F.struct(F.round("amp", AMP_DECIMALS), -F.col("k")))
    return short.unionByName(long).groupBy(*keys).agg(first.alias("_peak"))
