"""Frame-table sources and cleaning.

A *frames* table is one row per video frame:
``subject_id, win_from, win_to, frame_idx, <channel>..., <label>...``.
The scripts read one spreadsheet per subject and rely on file row order;
here the subject is a column and ``frame_idx`` is a real column, so the
whole corpus is one partitioned table that Spark scans in parallel.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW_KEY = ["subject_id", "win_from", "win_to"]


def _by_footer(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """Files of one folder whose columns may differ in type or presence: files
    are grouped by their footers and each group is read with its own schema;
    columns that are text in one group are text in all, absent ones NULL."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(path)
             .select("path").collect())  # names only
    names = sorted(r["path"] for r in files)
    with ThreadPoolExecutor(max_workers=32) as ex:
        schemas = list(ex.map(lambda n: spark.read.parquet(n).schema, names))
    groups: dict[str, tuple[T.StructType, list[str]]] = {}
    for n, schema in zip(names, schemas):
        groups.setdefault(schema.json(), (schema, []))[1].append(n)
    kinds: dict[str, set] = {}
    for schema, _ in groups.values():
        for f in schema.fields:
            kinds.setdefault(f.name, set()).add(f.dataType)
    mixed = {c for c, k in kinds.items() if len(k) > 1}
    parts = []
    for schema, paths in groups.values():
        df = spark.read.schema(schema).parquet(*paths).select(
            F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"), "*")
        parts.append(df.withColumns({c: F.col(c).cast("string") for c in mixed if c in schema.names}))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_frames(spark: SparkSession, path: str, suffix: str = ".parquet",
                fmt: str = "parquet", order_col: str | None = None,
                rename: dict[str, str] | None = None, merge_schema: bool = True) -> DataFrame:
    """Load a folder of per-subject tables; ``subject_id`` is the file
    name with ``suffix`` stripped. Row order within a file becomes
    ``frame_idx`` (parquet row index; other formats must name an
    ``order_col``). ``rename`` maps source names (``From``/``To``) to ours.

    With ``merge_schema`` parquet files may differ: a column that is text in
    one file (decimal commas) and numeric in another becomes text, for
    ``coerce_numeric`` to repair. Without it, all files share the first
    file's schema and no other footer is read up front.
    """
    if fmt == "parquet" and merge_schema:
        df = _by_footer(spark, path, suffix)
    else:
        reader = spark.read.format(fmt).option("pathGlobFilter", f"*{suffix}")
        df = (reader.option("header", "true") if fmt == "csv" else reader).load(path)
        if fmt != "parquet" and order_col is None:
            raise ValueError("non-parquet sources need an explicit order_col")
        row = F.col("_metadata.row_index") if fmt == "parquet" else F.lit(None).cast("long")
        df = df.select(F.col("_metadata.file_name").alias("_file"), row.alias("_row"), "*")
    sid = F.regexp_replace("_file", _escape(suffix) + "$", "")
    idx = F.col(order_col).cast("long") if order_col is not None else F.col("_row")
    df = df.select(sid.alias("subject_id"), idx.alias("frame_idx"), *[c for c in df.columns if c not in ("_file", "_row")])
    for src, dst in (rename or {"From": "win_from", "To": "win_to"}).items():
        if src in df.columns:
            df = df.withColumnRenamed(src, dst)
    return df


def _escape(s: str) -> str:
    return "".join("\\" + c if c in ".^$*+?()[]{}|\\" else c for c in s)


def require_columns(df: DataFrame, cols: Sequence[str],
                    by: str = "subject_id") -> DataFrame:
    """Keep only subjects whose source has every required column.

    With a merged schema a file lacking a column reads as all-NULL for it,
    so a subject is kept when each required column is non-null somewhere.
    Missing-from-schema columns drop everything. One partial aggregate over
    subjects, then a left-semi join (the subject list is one row per subject).
    """
    missing = [c for c in cols if c not in df.columns]
    if missing:
        return df.limit(0)
    present = (df.groupBy(by)
               .agg(*[F.max(F.col(c).isNotNull().cast("int")).alias(f"_h{i}")
                      for i, c in enumerate(cols)]))
    ok = F.lit(True)
    for i, _ in enumerate(cols):
        ok = ok & (F.col(f"_h{i}") == 1)
    return df.join(present.filter(ok).select(by), on=by, how="left_semi")


def to_double(c: Column | str, decimal_comma: bool = True,
              source_type: T.DataType | None = None) -> Column:
    """S3 scalar: decimal-comma repair and numeric coercion; bad → NULL,
    NaN → NULL (pandas treats NaN as missing)."""
    col = F.col(c) if isinstance(c, str) else c
    if source_type is not None and isinstance(source_type, T.NumericType):
        v = col.cast("double")
    else:
        s = col.cast("string")
        if decimal_comma:
            s = F.regexp_replace(s, ",", ".")
        v = s.try_cast("double")
    return F.when(F.isnan(v), F.lit(None).cast("double")).otherwise(v)


def coerce_numeric(df: DataFrame, cols: Sequence[str],
                   decimal_comma: bool = True) -> DataFrame:
    """S3: coerce ``cols`` to double (comma decimals optional)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({c: to_double(c, decimal_comma, types.get(c)) for c in cols})


def drop_incomplete(df: DataFrame, cols: Sequence[str],
                    key: Sequence[str] = WINDOW_KEY,
                    reindex: bool = True) -> DataFrame:
    """Drop frames with any missing channel, then renumber ``frame_idx``
    densely within the window (positions drive slope, lags and the DFT).

    The renumbering is a window over the window key — the same clustering
    the feature stage needs, so Spark reuses that exchange.
    """
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull() & ~F.isnan(F.col(c))
    out = df.filter(cond)
    if reindex:
        w = Window.partitionBy(*key).orderBy("frame_idx")
        out = out.withColumn("frame_idx", (F.row_number().over(w) - 1).cast("int"))
    return out


def is_control(subject: Column | str = "subject_id") -> Column:
    """Control subjects are those whose id starts with ``C``."""
    col = F.col(subject) if isinstance(subject, str) else subject
    return col.startswith("C")


def filter_controls(df: DataFrame, include: bool = True,
                    subject: str = "subject_id") -> DataFrame:
    """Include or exclude control subjects (pushed to the scan as a
    ``StartsWith`` filter on parquet)."""
    return df if include else df.filter(~is_control(subject))


def by_window(df: DataFrame) -> DataFrame:
    """Frames that belong to a window (NULL bounds leave the grouping,
    as in pandas ``groupby``)."""
    return df.filter(F.col("win_from").isNotNull() & F.col("win_to").isNotNull())
