"""signalpanel — labelled multichannel time-series analytics on Spark.

Layers (all DataFrame in, DataFrame out):

* ``sources``   — frame tables, detections, fixture views, report sinks (S*)
* ``operators`` — windows/labels (W*), folds (C*), scaling/selection (P*),
  subject aggregation (A*), threshold tuning (T*), metrics (E*),
  summaries / nested selection / importance (R*)
* ``functions`` — per-window signal features (F*)
* ``plans``     — model panel: MLlib scorers and the end-to-end panel (M*)
* ``streaming`` — incremental feature extraction with Structured Streaming
"""

__version__ = "0.1.0"
