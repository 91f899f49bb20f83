"""Report sinks (S9) and the run-metadata row."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_report(tables: Mapping[str, DataFrame], path: str, mode: str = "overwrite",
                 partition_by: Mapping[str, Sequence[str]] | None = None) -> dict[str, str]:
    """One parquet table per name under ``path`` (the workbook sheets of
    the scripts). Each write is its own job; a lost executor only re-runs
    that table's tasks. Returns name → location."""
    out = {}
    for name, df in tables.items():
        loc = f"{path.rstrip('/')}/{name}"
        w = df.write.mode(mode)
        cols = (partition_by or {}).get(name)
        if cols:
            w = w.partitionBy(*cols)
        w.parquet(loc)
        out[name] = loc
    return out


def append_results(df: DataFrame, path: str, partition_by: Sequence[str] = ("label", "model")) -> None:
    """Incremental checkpoint of result rows: append one partition per
    (label, config) as it completes (the scripts rewrite a whole file after
    every config)."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def run_meta(spark: SparkSession, windows: DataFrame, n_features: int,
             labels: Sequence[str], config: Mapping[str, object],
             subject: str = "subject_id") -> DataFrame:
    """One row with the configuration snapshot (JSON) and the counts
    of subjects, controls, windows, features and labels."""
    counts = windows.agg(
        F.countDistinct(subject).alias("n_subjects"),
        F.countDistinct(F.when(F.col(subject).startswith("C"), F.col(subject))).alias("n_controls"),
        F.count(F.lit(1)).alias("n_windows"))
    return counts.select(
        "n_subjects", "n_controls", "n_windows",
        F.lit(int(n_features)).alias("n_features"), F.lit(len(labels)).alias("n_labels"),
        F.lit(json.dumps(dict(config), sort_keys=True, default=str)).alias("config_json"))
