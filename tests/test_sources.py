
import pandas as pd

from signalpanel.sources import frames as S
from signalpanel.sources import detections as D


def test_read_frames_folder(spark, tmp_path):
    for sid, n in (("C001", 4), ("P002", 3)):
        pdf = pd.DataFrame({"From": [0] * n, "To": [5] * n, "nose_distance": [f"{i},5" for i in range(n)],
                            "Tremor": [0] * n})
        pdf.to_parquet(tmp_path / f"{sid}.parquet")
    df = S.read_frames(spark, str(tmp_path), suffix=".parquet")
    df = S.coerce_numeric(df, ["nose_distance"])
    out = df.select("subject_id", "frame_idx", "win_from", "nose_distance").toPandas()
    assert set(out.subject_id) == {"C001", "P002"}
    assert sorted(out[out.subject_id == "C001"].frame_idx) == [0, 1, 2, 3]
    assert out[out.subject_id == "C001"].sort_values("frame_idx").nose_distance.tolist() == [0.5, 1.5, 2.5, 3.5]
    assert S.filter_controls(df, include=False).select("subject_id").distinct().count() == 1


def test_read_frames_with_mixed_types(spark, tmp_path):
    """One file with decimal commas (text), one numeric, one with a further column."""
    pd.DataFrame({"From": [0, 0], "To": [5, 5], "d": ["1,5", "2,5"]}).to_parquet(tmp_path / "C1_x.parquet")
    pd.DataFrame({"From": [0, 0], "To": [5, 5], "d": [3.5, 4.5]}).to_parquet(tmp_path / "P2_x.parquet")
    pd.DataFrame({"From": [0], "To": [5], "d": [7], "more": [1]}).to_parquet(tmp_path / "P3_x.parquet")
    pd.DataFrame({"From": [0]}).to_parquet(tmp_path / "other.parquet")
    df = S.coerce_numeric(S.read_frames(spark, str(tmp_path), suffix="_x.parquet"), ["d"])
    got = sorted((r["subject_id"], r["frame_idx"], r["d"], r["more"]) for r in df.collect())
    assert got == [("C1", 0, 1.5, None), ("C1", 1, 2.5, None), ("P2", 0, 3.5, None), ("P2", 1, 4.5, None), ("P3", 0, 7.0, 1)]


def test_drop_incomplete_reindexes(spark):
    pdf = pd.DataFrame({"subject_id": "P1", "win_from": 0, "win_to": 1, "frame_idx": range(5),
                        "a": ["1", "bad", "3", None, "5,5"]})
    df = S.coerce_numeric(spark.createDataFrame(pdf), ["a"])
    out = S.drop_incomplete(df, ["a"]).orderBy("frame_idx").toPandas()
    assert out.frame_idx.tolist() == [0, 1, 2] and out.a.tolist() == [1.0, 3.0, 5.5]


def test_detections(spark):
    pts = [{"x": 0.5, "y": 0.25}] * 17
    pdf = pd.DataFrame({"video_id": ["v", "v"], "pos_msec": [1234.0, 40.0], "width": 640, "height": 480,
                        "persons": [[pts], []]})
    out = D.detections_to_frames(spark.createDataFrame(pdf)).orderBy("time").toPandas()
    assert out.time.tolist() == [0.04, 1.23]
    assert out.nose_x.iloc[1] == 320 and out.nose_y.iloc[1] == 120
    assert abs(out.nose_distance.iloc[1] - (320 ** 2 + 120 ** 2) ** 0.5) < 1e-9
    assert pd.isna(out.nose_x.iloc[0])


def test_write_report_and_run_meta(spark, tmp_path):
    from signalpanel.sources import report as REP
    df = spark.createDataFrame(pd.DataFrame({"subject_id": ["C1", "P2", "P2"], "win_from": [0, 0, 5],
                                             "label": ["a", "a", "b"], "model": ["m", "m", "m"]}))
    locs = REP.write_report({"windows": df, "meta": REP.run_meta(spark, df, 44, ["a", "b"], {"fps": 30.0})},
                            str(tmp_path / "rep"))
    back = spark.read.parquet(locs["meta"]).first()
    assert back["n_subjects"] == 2 and back["n_controls"] == 1 and back["n_windows"] == 3
    assert spark.read.parquet(locs["windows"]).count() == 3
    REP.append_results(df, str(tmp_path / "res"))
    REP.append_results(df, str(tmp_path / "res"))
    assert spark.read.parquet(str(tmp_path / "res")).count() == 6
