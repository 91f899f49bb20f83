"""Run configuration and the label-settings table.

Everything a user of the scripts edited in module constants is a parameter
here; the per-label settings become one small DataFrame keyed by ``label``
(one row per label, so its size is bounded by the label count and it is
always safe to broadcast).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the original study's settings for equal results).
# ---------------------------------------------------------------------------
SYMPTOMS = ["Dystonia", "Tremor", "Myoclonus", "Chorea", "Athetosis",
            "Ballismus", "Stereotypies", "Tics"]

KEYPOINTS = ["nose", "left_eye", "right_eye", "left_ear", "right_ear",
             "left_shoulder", "right_shoulder", "left_elbow", "right_elbow",
             "left_wrist", "right_wrist", "left_hip", "right_hip",
             "left_knee", "right_knee", "left_ankle", "right_ankle"]
DISTANCE_COLS = [f"{k}_distance" for k in KEYPOINTS]

SEED = 42
N_SPLITS = 3
FPS = 30.0
TOPK = 2
PERCENTILE_Q = 90
AGG_MODE = "p90"
THRESHOLD_POLICY = "clinical_cost"
SPEC_TARGET = 0.80
CONTROL_FPR_TARGET = 0.10
CONTROL_FP_MAX = 1
FEATURE_SELECT_K = 75
NESTED_INNER_SPLITS = 3
RELAX_LEVELS = [0, 1, 2, 3, 4]
SMOTE_K_NEIGHBORS = 5
SMOTE_RATIO = 0.25
# threshold grid: 199 evenly spaced points on [0.01, 0.99]
GRID_START, GRID_STOP, GRID_NUM = 0.01, 0.99, 199

K_BY_LABEL = {"Myoclonus": 150, "Athetosis": 150, "Stereotypies": 50}
ALPHA_BY_LABEL = {"Athetosis": 0.70, "Myoclonus": 0.60, "Stereotypies": 0.40}
FP_MAX_BY_LABEL = {"Dystonia": 0, "Tremor": 0, "Myoclonus": 0, "Stereotypies": 0}
FPR_TARGET_BY_LABEL = {"Dystonia": 0.05, "Tremor": 0.02, "Myoclonus": 0.02}
SPEC_TARGET_BY_LABEL = {"Ballismus": 0.70, "Tics": 0.70, "Dystonia": 0.90, "Tremor": 0.85}
RECALL_MIN_BY_LABEL = {"Dystonia": 0.70, "Tremor": 0.70, "Myoclonus": 0.50,
                       "Chorea": 0.50, "Athetosis": 0.50, "Stereotypies": 0.50,
                       "Ballismus": 0.33, "Tics": 0.33}
# ---------------------------------------------------------------------------


def threshold_grid(start: float = GRID_START, stop: float = GRID_STOP,
                   num: int = GRID_NUM) -> list[float]:
    """The evenly spaced threshold grid as exact Python floats; the same list
    is emitted as literals into Spark and into the SQL oracle."""
    return [float(v) for v in np.linspace(start, stop, num)]


LABEL_CONFIG_SCHEMA = T.StructType([
    T.StructField("label", T.StringType(), False),
    T.StructField("k_best", T.IntegerType(), False),
    T.StructField("alpha", T.DoubleType(), False),
    T.StructField("fp_max", T.IntegerType(), False),
    T.StructField("fpr_target", T.DoubleType(), False),
    T.StructField("spec_target", T.DoubleType(), False),
    T.StructField("recall_min", T.DoubleType(), False),
])


@dataclass
class LabelSettings:
    """Defaults plus per-label overrides; ``rows()`` resolves them."""
    labels: list[str]
    k_best: int = FEATURE_SELECT_K
    alpha: float = 0.5
    fp_max: int = CONTROL_FP_MAX
    fpr_target: float = CONTROL_FPR_TARGET
    spec_target: float = SPEC_TARGET
    recall_min: float = 0.0
    k_by_label: dict = field(default_factory=lambda: dict(K_BY_LABEL))
    alpha_by_label: dict = field(default_factory=lambda: dict(ALPHA_BY_LABEL))
    fp_max_by_label: dict = field(default_factory=lambda: dict(FP_MAX_BY_LABEL))
    fpr_target_by_label: dict = field(default_factory=lambda: dict(FPR_TARGET_BY_LABEL))
    spec_target_by_label: dict = field(default_factory=lambda: dict(SPEC_TARGET_BY_LABEL))
    recall_min_by_label: dict = field(default_factory=lambda: dict(RECALL_MIN_BY_LABEL))

    def rows(self) -> list[tuple]:
        out = []
        for lab in self.labels:
            out.append((lab,
                        int(self.k_by_label.get(lab, self.k_best)),
                        float(self.alpha_by_label.get(lab, self.alpha)),
                        int(self.fp_max_by_label.get(lab, self.fp_max)),
                        float(self.fpr_target_by_label.get(lab, self.fpr_target)),
                        float(self.spec_target_by_label.get(lab, self.spec_target)),
                        float(self.recall_min_by_label.get(lab, self.recall_min))))
        return out

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), LABEL_CONFIG_SCHEMA)


def label_config(spark: SparkSession, labels: list[str], **overrides) -> DataFrame:
    """A6 label-settings table (one row per label)."""
    return LabelSettings(labels=list(labels), **overrides).to_df(spark)


# Settings used with the driver-table fixtures: the fixture labels carry
# their own overrides so that every per-label branch is exercised.
FIXTURE_SETTINGS = dict(
    k_by_label={"lab_b": 8},
    alpha_by_label={"toxic": 0.7, "lab_c": 0.6},
    fp_max_by_label={"low": 0, "lab_a": 0},
    fpr_target_by_label={"toxic": 0.05},
    spec_target_by_label={"low": 0.7, "lab_b": 0.85},
    recall_min_by_label={"low": 0.5, "toxic": 0.33, "lab_a": 0.5},
)
