import pandas as pd

from signalpanel.sources import fixtures as fx
from signalpanel.streaming.features import batch_features, stream_window_features
from tests.conftest import SF_SMALL


def test_stream_matches_batch(spark, tmp_path):
    src = tmp_path / "frames"
    src.mkdir()
    fr = fx.frames_b1(spark, SF_SMALL).toPandas()
    subjects = sorted(fr.subject_id.unique())[:6]
    for sid in subjects:
        g = fr[fr.subject_id == sid].sort_values(["win_from", "frame_idx"])
        g = g.rename(columns={"win_from": "From", "win_to": "To"}).drop(columns=["subject_id", "frame_idx"])
        g.to_parquet(src / f"{sid}.parquet", index=False)
    schema = spark.read.parquet(str(src)).schema
    q = stream_window_features(spark, str(src), schema, fx.B1_CHANNELS, fx.B1_LABELS,
                               str(tmp_path / "out"), str(tmp_path / "ckpt"), max_files_per_trigger=2)
    q.awaitTermination(300)
    got = spark.read.parquet(str(tmp_path / "out")).drop("_epoch")
    frames = spark.createDataFrame(fr[fr.subject_id.isin(subjects)])
    want = batch_features(frames, fx.B1_CHANNELS, fx.B1_LABELS)
    cols = sorted(want.columns)
    a = got.select(*cols).toPandas().sort_values(["subject_id", "win_from"]).reset_index(drop=True)
    b = want.select(*cols).toPandas().sort_values(["subject_id", "win_from"]).reset_index(drop=True)
    assert len(a) == len(b) > 0
    pd.testing.assert_frame_equal(a, b, check_exact=False, rtol=1e-9, check_dtype=False)
