import numpy as np
import pandas as pd

from signalpanel.operators.quantile import exact_quantiles, quantiles


def test_bracketed_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(5)
    rows = []
    for g in range(4):
        vals = np.round(rng.normal(g, 1 + g, 200 + 37 * g), 3)
        if g == 3:
            vals[:120] = 1.5  # a heavy tie
        if g == 2:
            vals[0] = 1e15  # an outlier
        rows += [(g, float(v)) for v in vals]
    pdf = pd.DataFrame(rows, columns=["g", "v"])
    df = spark.createDataFrame(pdf)
    qs = [0.25, 0.5, 0.75, 0.9]
    for res in (exact_quantiles(df, ["g"], "v", qs, accuracy=100),
                quantiles(df, ["g"], "v", qs, small_group=50)):
        got = res.toPandas().set_index("g")
        for g, grp in pdf.groupby("g"):
            want = np.percentile(grp.v.to_numpy(), [q * 100 for q in qs])
            for i, w in enumerate(want):
                assert abs(got.loc[g, f"q{i}"] - w) < 1e-12, (g, i, got.loc[g, f"q{i}"], w)
