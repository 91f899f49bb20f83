"""Signals in chunks: the same features as of the whole signal, whatever the
chunk, and a spectrum that no group holds."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from signalpanel.functions import chunks, long_spectrum
from signalpanel.functions.matrix import SPECS, window_features
from tests.closed_forms import close, expected, peak

WK = ["subject_id", "win_from", "win_to"]


def _signals():
    r = np.random.default_rng(4)
    lengths = {"two": 2, "three": 3, "five": 5, "six": 6, "eight": 8, "nine": 9, "ten": 10, "prime": 101, "pow": 128, "long": 1000, "hot": 3001}
    out = {k: np.round(r.normal(size=n).cumsum(), 3) for k, n in lengths.items()}
    return out | {"flat": np.full(40, 2.5), "ties": np.tile([1.0, 1, 2, 2], 30), "alternating": np.tile([1.0, -1], 33), "one": np.array([3.0])}


def _frames(spark, signals):
    pdf = pd.DataFrame([(s, 0, 0, i, float(v)) for s, x in signals.items() for i, v in enumerate(x)], columns=[*WK, "frame_idx", "sig"])
    return spark.createDataFrame(pdf).repartition(5)


@pytest.mark.parametrize("chunk,spec", [(8, "subject"), (64, "multilabel"), (8, "window"), (1 << 20, "subject")])
def test_equal_to_the_whole_signal(spark, chunk, spec):
    signals = _signals()
    rate = SPECS[spec].fps
    got = chunks.long_signal_features(_frames(spark, signals), WK, ["sig"], SPECS[spec], chunk).toPandas().set_index("subject_id")
    assert sorted(got.index) == sorted(k for k, x in signals.items() if len(x) > 1)
    bad = []
    for name, x in signals.items():
        want = expected(x, rate)
        if want is None:
            continue
        for f in SPECS[spec].names():
            if spec == "window" and f.startswith("mean_w") and len(x) < int(f[-1]):
                assert pd.isna(got.loc[name, f])
            elif not close(got.loc[name, f], want[f]):
                bad.append((name, f, got.loc[name, f], want[f]))
    assert bad == []


def test_equal_to_the_window_plan(spark):
    fr = _frames(spark, {k: v for k, v in _signals().items() if k in ("long", "prime", "flat")})
    a = chunks.long_signal_features(fr, WK, ["sig"], SPECS["subject"], 100).toPandas().set_index("subject_id")
    b = window_features(fr, WK, ["sig"], SPECS["subject"]).toPandas().set_index("subject_id")
    for s in b.index:
        assert all(close(a.loc[s, f], b.loc[s, f]) for f in SPECS["subject"].names())


def test_no_group_holds_the_hot_signal(spark):
    """Half of all frames in one signal: no (signal, chunk) group exceeds the chunk and its borders."""
    r = np.random.default_rng(1)
    signals = {"hot": r.normal(size=5000)} | {f"s{k}": r.normal(size=50) for k in range(100)}
    df = _frames(spark, signals).withColumnRenamed("sig", "x").withColumn("channel", F.lit("c"))
    rows = chunks.chunk_rows(df, [*WK, "channel"], 128)
    assert rows.count() == 10_000
    assert rows.groupBy(*WK, "channel", "chunk").count().agg(F.max("count")).first()[0] <= 128
    lag = rows.filter("frame_idx > 4").select(F.count("*"), *[F.count(f"lag{k}") for k in range(1, 6)]).first()
    assert set(lag) == {lag[0]}


@pytest.mark.parametrize("n", [65, 127, 128, 997, 4096, 10_007, 65_537, 100_000])
def test_spectrum_of_a_long_signal(spark, n):
    r = np.random.default_rng(n)
    x = r.normal(size=n) + 0.5 * np.cos(2 * np.pi * (n // 3) * np.arange(n) / n)
    df = spark.createDataFrame(pd.DataFrame({"s": "a", "frame_idx": np.arange(n), "x": x}))
    sizes = spark.createDataFrame([("a", n)], "s string, n int")
    hold = (1 << max(6, n.bit_length() - 3), 4)
    got = long_spectrum.spectral_peaks(df, sizes, ["s"], 64, hold).first()["_peak"]
    amp = np.abs(np.fft.rfft(x))[1:]
    assert got["k"] == int(np.argmax(np.round(amp, 9))) + 1 and close(got["amp"], amp.max(), 1e-9)
    if n < 1000:
        assert got["k"] == peak(x)[0]
    m1, m2 = long_spectrum.circle(n)
    assert m1 * m2 >= 2 * n - 1 and m1 * long_spectrum.lines(m1, hold) <= max(hold[0], 4 * m1)
