"""Incremental feature extraction with Structured Streaming.

New per-subject frame files landing in a folder are turned into feature
rows as they arrive (the scripts re-read the whole folder and rewrite a
whole workbook each run). Each micro-batch runs the same batch plan as
:func:`signalpanel.functions.matrix.feature_matrix`; a subject file is a
complete set of windows, so batches never split a window.

Exactly-once output: every micro-batch overwrites its own ``_epoch=<id>``
folder, so a batch replayed after a failure (same epoch id, same files
from the checkpointed offsets) replaces its earlier partial output.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.matrix import SPECS, FeatureSpec, feature_matrix, window_features
from ..operators.windows import window_labels
from ..sources.frames import WINDOW_KEY, _escape, by_window, coerce_numeric, drop_incomplete


def batch_features(frames: DataFrame, channels: Sequence[str], labels: Sequence[str],
                   spec: FeatureSpec = SPECS["multilabel"], decimal_comma: bool = True) -> DataFrame:
    """Clean → windows → feature matrix with labels (the batch plan)."""
    fr = by_window(frames)
    fr = drop_incomplete(coerce_numeric(fr, channels, decimal_comma), channels)
    feats = window_features(fr, WINDOW_KEY, channels, spec)
    return feature_matrix(feats, window_labels(fr, labels), WINDOW_KEY, channels, spec)


def stream_window_features(spark: SparkSession, source_dir: str, schema: T.StructType,
                           channels: Sequence[str], labels: Sequence[str], sink_dir: str,
                           checkpoint_dir: str, spec: FeatureSpec = SPECS["multilabel"],
                           suffix: str = ".parquet", max_files_per_trigger: int = 64,
                           available_now: bool = True):
    """Start the stream; returns the ``StreamingQuery``. Subject id = file
    name without ``suffix``; frame order = row order in the file."""
    src = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
           .option("pathGlobFilter", f"*{suffix}")
           .parquet(source_dir)
           .select(F.regexp_replace(F.col("_metadata.file_name"), _escape(suffix) + "$", "").alias("subject_id"),
                   F.col("_metadata.row_index").alias("frame_idx"), "*")
           .withColumnRenamed("From", "win_from").withColumnRenamed("To", "win_to"))

    def write_batch(df: DataFrame, epoch_id: int) -> None:
        out = batch_features(df, channels, labels, spec)
        out.write.mode("overwrite").parquet(f"{sink_dir.rstrip('/')}/_epoch={epoch_id}")

    w = src.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
