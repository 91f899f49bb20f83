"""Rows as feature blocks, and sums of vectors in Spark.

A block is one row: the features of up to ``BLOCK_ROWS`` rows of one design
(say, one scaler and fold) as a matrix, with their labels. Iterative fits pass
over stored blocks, so a pass reads bytes and multiplies matrices. What a pass
returns is added up in Spark, in two steps, so that the driver gets one vector
per key whatever the number of partitions, and no task meets more than about
the square root of them. Where a result is made of each sum, that happens in
Spark too, however few the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

BLOCK_ROWS = 4096
DIRECT = 8
SENT_BYTES = 8 << 20  # of the vectors that a task hands over at a time
PASS_BYTES = 32 << 20  # of the vectors of all tasks that the driver adds up in a pass
TASK_ROWS, TASK_BYTES = BLOCK_ROWS // 2, 64 << 20  # of a task: at least, if not all cores have work; at most

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_BLOCK = "design string, n long, x binary, y binary, k binary, ids array<string>"


def feature_blocks(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Stored blocks of ``(design, row_id, x array<double>, y array<int>, k
    array<int>)``: labels (−1: none) and one mark per label. Rows are taken in
    the order of their design within each task; a block holds one design."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        design = None

        def flush():
            x = np.array([h[1] for h in held], float)
            y, k = (np.array([h[i] for h in held], np.int8) for i in (2, 3))
            return pa.RecordBatch.from_arrays(
                [pa.array([design]), pa.array([len(held)], pa.int64()), *[pa.array([m.tobytes()], pa.binary()) for m in (x, y, k)],
                 pa.array([[h[0] for h in held]], pa.list_(pa.string()))], names=["design", "n", "x", "y", "k", "ids"])

        for b in batches:
            for d, *row in zip(*[b.column(c).to_pylist() for c in ("design", "row_id", "x", "y", "k")]):
                if held and (d != design or len(held) == block_rows):
                    yield flush()
                    held = []
                design = d
                held.append(row)
        if held:
            yield flush()

    ordered = rows.select("design", "row_id", "x", "y", "k").sortWithinPartitions("design")
    ensure_checkpoint_dir(rows.sparkSession)
    return ordered.mapInArrow(run, _BLOCK).checkpoint()


def train_blocks(rows: DataFrame) -> DataFrame:
    """Stored blocks of the train rows of long rows ``(design, part, y, x,
    row_id)`` that have a label, each row with its one label, in as many tasks
    as there are cores, or fewer if rows are few and more if they are many."""
    train = rows.filter((F.col("part") == "train") & F.col("y").isNotNull())
    r = train.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d")).first()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(cores, -(-r["n"] // TASK_ROWS)), r["n"] * (r["d"] or 1) * 8 // TASK_BYTES)
    return feature_blocks(train.select("design", F.col("row_id").cast("string").alias("row_id"), "x", F.array(F.col("y").cast("int")).alias("y"),
                                       F.array(F.lit(-1)).alias("k")).repartition(tasks))


ABSENT = -2  # of a row that has not the label at all; −1: its label is NULL


def wide_rows(rows: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Long rows ``(fold, part, label, y, row_id, x)`` with their labels side by
    side: ``(fold, part, row_id, x_hash, copy, x, y array<int>)``. Several rows
    may have one id: those that differ in ``x`` are told apart by its hash, and
    those that do not are numbered, in the order of their labels."""
    ys = [F.sort_array(F.collect_list(F.when(F.col("label") == lab, F.coalesce(F.col("y").cast("int"), F.lit(-1))))).alias(f"_y{i}")
          for i, lab in enumerate(labels)]
    wide = rows.groupBy("fold", "part", F.col("row_id").cast("string").alias("row_id"), F.xxhash64("x").alias("x_hash")).agg(F.first("x").alias("x"), *ys)
    most = F.greatest(F.lit(1), F.lit(1), *[F.size(f"_y{i}") for i in range(len(labels))])
    wide = wide.withColumn("copy", F.explode(F.sequence(F.lit(1), most)))
    own = [F.coalesce(F.get(f"_y{i}", F.col("copy") - 1), F.lit(ABSENT)) for i in range(len(labels))]
    return wide.select("fold", "part", "row_id", "x_hash", "copy", "x", F.array(*own).alias("y"))


def row_key() -> Column:
    """What names a row of ``wide_rows`` in a block."""
    return F.concat_ws("\x01", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("part", "x_hash", "copy", "row_id")])


def open_keys(ids: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Part, hash of ``x``, number and id of the rows of a block."""
    part, x_hash, copy, row_id = zip(*(i.split("\x01", 3) for i in ids))
    return np.array(part, object), np.array(x_hash, np.int64), np.array(copy, np.int32), np.array(row_id, object)


def with_scores(rows: DataFrame, scores: DataFrame) -> DataFrame:
    """Long rows, without ``x``, and the scores ``(fold, label, row_id, x_hash, …)`` of each."""
    return rows.withColumn("x_hash", F.xxhash64("x")).drop("x").join(scores, ["fold", "label", "row_id", "x_hash"]).drop("x_hash")


def open_block(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and marks of a block."""
    n = row["n"]
    return (np.frombuffer(row["x"]).reshape(n, -1), np.frombuffer(row["y"], np.int8).reshape(n, -1),
            np.frombuffer(row["k"], np.int8).reshape(n, -1))


def _merge(keys: Sequence[str], finish: Callable[[str, np.ndarray], np.ndarray] | None = None, kind: type = float):
    def run(key, parts):
        data = parts.column("data").to_pylist()
        total = np.frombuffer(data[0], kind).astype(float)
        for d in data[1:]:
            total += np.frombuffer(d, kind)
        if finish is not None:
            total = np.ascontiguousarray(finish(key[0].as_py(), total), float)
        return pa.table({**{c: pa.array([v.as_py()], parts.schema.field(c).type) for c, v in zip(keys, key)},
                         "data": pa.array([total.tobytes()], pa.binary())})
    return run


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries made inside remove their shuffle files when they have run, so
    that the passes of a fit do not pile them up."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def block_sums(blocks: DataFrame, work: Callable[[dict], dict[str, np.ndarray] | Iterator[tuple[str, np.ndarray]]],
               finish: Callable[[str, np.ndarray], np.ndarray] | None = None, kind: type = float,
               direct: int | None = None) -> dict[str, np.ndarray]:
    """Add up ``work(block)``, vectors by key, over all blocks: in each task,
    then over groups of tasks, then over all; the few vectors of at most
    ``direct`` tasks (``DIRECT`` if not given) are added up as they come. ``finish(key, sum)`` makes the
    result of a key where its sum is, in Spark. Tasks add up numbers of ``kind``."""
    tasks = blocks.rdd.getNumPartitions()
    fan = math.isqrt(tasks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total: dict[str, np.ndarray] = {}
        for b in batches:
            for row in b.to_pylist():
                sums = work(row)
                for key, v in sums.items() if isinstance(sums, dict) else sums:
                    if key in total and total[key].dtype == v.dtype and total[key].flags.writeable:
                        total[key] += v
                    else:
                        total[key] = total[key] + v if key in total else v
        part = TaskContext.get().partitionId() % max(1, fan)
        keys, held = [], []
        while total:
            key, v = total.popitem()
            keys.append(key)
            held.append(np.ascontiguousarray(v, kind).tobytes())
            if not total or sum(map(len, held)) > SENT_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([part] * len(keys), pa.int32()), pa.array(held, pa.binary())],
                                                 names=["key", "part", "data"])
                keys, held = [], []

    few = tasks <= (DIRECT if direct is None else direct)
    with shuffles_removed(blocks.sparkSession):
        sums = blocks.mapInArrow(run, "key string, part int, data binary")
        if not few:
            sums = sums.groupBy("key", "part").applyInArrow(_merge(["key", "part"], kind=kind), "key string, part int, data binary")
        if not few or finish is not None:
            sums = sums.groupBy("key").applyInArrow(_merge(["key"], finish, kind if few else float), "key string, data binary")
            kind = float
        found = sums.collect()  # one vector per key, or at most that of a few tasks
    out: dict[str, np.ndarray] = {}
    for r in found:
        v = np.frombuffer(r["data"], kind).astype(float, copy=False)
        out[r["key"]] = out[r["key"]] + v if r["key"] in out else v
    return out
