import pandas as pd
import pytest
from pyspark.sql import functions as F

from signalpanel.functions.matrix import SPECS, feature_matrix, window_features
from signalpanel.operators import windows as W
from signalpanel.sources import fixtures as fx
from tests.closed_forms import BY_HAND, close, expected
from tests.conftest import SF_SMALL

WK = ["subject_id", "win_from", "win_to"]


def _short(spark):
    """Windows of 1–8 frames: the guards of every feature."""
    fr = fx._b1_base(spark, SF_SMALL)
    return fr.filter(F.col("frame_idx") < 1 + F.col("user_id") % 8).drop("event_id", "user_id")


def _check(spark, pdf, channels, spec_name="multilabel", rate=30.0):
    res = window_features(spark.createDataFrame(pdf), WK, channels, SPECS[spec_name]).toPandas()
    rows = res.set_index([*WK, "channel"])
    bad = []
    for key, g in pdf.groupby(WK):
        g = g.sort_values("frame_idx")
        for ch in channels:
            want = expected(g[ch].to_numpy(), rate)
            if want is None:
                assert (*key, ch) not in rows.index
                continue
            got = rows.loc[(*key, ch)]
            for name in SPECS[spec_name].names():
                if spec_name == "window" and name.startswith("mean_w") and len(g) < int(name[-1]):
                    assert pd.isna(got[name])
                elif not close(got[name], want[name]):
                    bad.append((key[0], ch, name, got[name], want[name]))
    return bad


def test_features_on_events(spark):
    assert _check(spark, fx.frames_b1_centred(spark, SF_SMALL).toPandas(), fx.B1_CHANNELS) == []


def test_features_on_short_windows(spark):
    pdf = _short(spark).toPandas()
    assert _check(spark, pdf, fx.B1_CHANNELS) == []
    assert _check(spark, pdf, fx.B1_CHANNELS, "window", 1.0) == []


@pytest.mark.parametrize("name", sorted(BY_HAND))
def test_closed_forms(spark, name):
    signal, want = BY_HAND[name]
    pdf = pd.DataFrame([(name, 0, 1, i, v) for i, v in enumerate(signal)], columns=[*WK, "frame_idx", "sig"])
    got = window_features(spark.createDataFrame(pdf), WK, ["sig"], SPECS["multilabel"]).first().asDict()
    wrong = {k: (got[k], v) for k, v in want.items() if not close(got[k], v)}
    assert wrong == {}


def test_ties_and_one_frame(spark):
    rows = [("one", 0, 1, 0, 3.0)] + [("ties", 0, 1, i, float(v)) for i, v in enumerate([1, 1, 2, 2, 1, 1, 3, 3])]
    assert _check(spark, pd.DataFrame(rows, columns=[*WK, "frame_idx", "sig"]), ["sig"]) == []


def test_long_window(spark):
    """More than a thousand frames: same spectrum as the Fourier sum."""
    rows = [("long", 0, 1, i, ((i * 37) % 101) / 7 + (i % 13)) for i in range(1500)]
    assert _check(spark, pd.DataFrame(rows, columns=[*WK, "frame_idx", "sig"]), ["sig"]) == []


def test_feature_matrix_fills_missing(spark):
    fr = _short(spark)
    wl = W.window_labels(fr, fx.B1_LABELS)
    pdf = feature_matrix(window_features(fr, WK, fx.B1_CHANNELS), wl, WK, fx.B1_CHANNELS).toPandas()
    fcols = [c for c in pdf.columns if c.startswith("d_")]
    assert len(pdf) == wl.count() and len(fcols) == 2 * len(SPECS["multilabel"].names())
    assert not pdf[fcols].isna().any().any()
    assert (pdf[pdf.n_frames == 1][fcols] == 0).all().all()
