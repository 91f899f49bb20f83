"""Windows, labels and subject-level filters.

Label columns hold 0/1 and 2 = ambiguous. All window-level operators group
by the window key; every subject-level one groups the (much smaller)
window table, never the frames.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.frames import WINDOW_KEY, is_control


def drop_ambiguous(frames: DataFrame, label: str,
                   key: Sequence[str] = WINDOW_KEY) -> DataFrame:
    """Drop every window in which ``label`` is 2 on some frame.
    A window aggregate over the window key (the clustering the feature
    stage needs anyway), so no extra exchange."""
    w = Window.partitionBy(*key)
    bad = F.max((F.col(label) == 2).cast("int")).over(w)
    return frames.withColumn("_amb", bad).filter(F.col("_amb") == 0).drop("_amb")


def window_label(frames: DataFrame, label: str,
                 key: Sequence[str] = WINDOW_KEY) -> DataFrame:
    """Window label = any frame equals 1."""
    return frames.groupBy(*key).agg(F.max((F.col(label) == 1).cast("int")).alias("y"))


def window_labels(frames: DataFrame, labels: Sequence[str],
                  key: Sequence[str] = WINDOW_KEY) -> DataFrame:
    """One 0/1 column per label (2 counts as not-1), plus frame count."""
    return frames.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_frames"),
        *[F.max((F.col(l) == 1).cast("int")).alias(l) for l in labels])


def positives_and_controls(win: DataFrame, y: str = "y",
                           subject: str = "subject_id") -> DataFrame:
    """Keep positive windows and all windows of controls."""
    return win.filter((F.col(y) == 1) | is_control(subject))


def any_label(labels: Sequence[str]) -> Column:
    return F.greatest(*[F.col(l) for l in labels]) if len(labels) > 1 else F.col(labels[0])


def drop_all_zero(win: DataFrame, labels: Sequence[str], keep: bool = False) -> DataFrame:
    """Drop windows without any positive label (``keep=True`` is the
    default of the multi-label panel and returns the input)."""
    return win if keep else win.filter(any_label(labels) > 0)


def subject_signal(frames: DataFrame, kept: DataFrame,
                   key: Sequence[str] = WINDOW_KEY) -> DataFrame:
    """Concatenate a subject's kept windows (ordered by From, To,
    frame) into one signal with a new dense ``frame_idx``.

    Skew-safe renumbering: count frames per window, prefix-sum the counts
    over the subject's windows (the window table, not the frames), and add
    the offset — frames are only joined co-partitioned on the window key.
    """
    fr = frames.join(kept.select(*key), on=list(key), how="left_semi")
    counts = fr.groupBy(*key).agg(F.count(F.lit(1)).alias("_c"))
    w = (Window.partitionBy("subject_id").orderBy("win_from", "win_to")
         .rowsBetween(Window.unboundedPreceding, -1))
    offs = counts.withColumn("_off", F.coalesce(F.sum("_c").over(w), F.lit(0)))
    return (fr.join(offs.select(*key, "_off"), on=list(key))
            .withColumn("frame_idx", (F.col("frame_idx") + F.col("_off")).cast("long"))
            .withColumn("win_from", F.lit(0)).withColumn("win_to", F.lit(0))
            .drop("_off"))


def for_task(df: DataFrame, task: str, col: str = "task") -> DataFrame:
    """One task segment (a partition filter when ``task`` partitions
    the table on disk)."""
    return df.filter(F.col(col) == task)


def subject_labels(win: DataFrame, labels: Sequence[str],
                   subject: str = "subject_id") -> DataFrame:
    """Subject label = OR over its windows, plus control flag."""
    return (win.groupBy(subject)
            .agg(F.count(F.lit(1)).alias("n_windows"),
                 *[F.max(l).cast("int").alias(l) for l in labels])
            .withColumn("is_control", is_control(subject)))


def unpivot_labels(win: DataFrame, labels: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """Wide label columns → long ``(…, label, y)``."""
    return win.select(*ids, *[F.col(l).cast("int").alias(l) for l in labels]) \
        .unpivot(list(ids), list(labels), "label", "y")


def prevalence(subj: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Positives, subjects and prevalence per label."""
    long_ = unpivot_labels(subj, labels, ["subject_id"])
    return (long_.groupBy("label")
            .agg(F.sum("y").cast("long").alias("n_pos"),
                 F.count(F.lit(1)).alias("n_subjects"),
                 F.avg(F.col("y").cast("double")).alias("prevalence")))


def availability(frames: DataFrame, labels: Sequence[str], task: str = "task",
                 subject: str = "subject_id") -> DataFrame:
    """Per label × task: positive non-control subjects and negative
    controls (label over all frames of the subject's task segment)."""
    per = (frames.groupBy(subject, task)
           .agg(*[F.max((F.col(l) == 1).cast("int")).alias(l) for l in labels]))
    long_ = unpivot_labels(per, labels, [subject, task])
    ctrl = is_control(subject)
    return (long_.groupBy("label", task)
            .agg(F.count_if((F.col("y") == 1) & ~ctrl).alias("n_positive"),
                 F.count_if((F.col("y") == 0) & ctrl).alias("n_controls")))
