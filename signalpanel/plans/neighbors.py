"""Exact nearest neighbours with pruning.

Per group a few train rows, the smallest by hash, are pivots; every train row
belongs to the cell of its nearest pivot, whose radius is the largest distance
in it. For a query row the distances to the pivots alone bound its k-th
neighbour from above: the nearest cells that hold k rows together reach no
further than pivot distance plus radius. It then meets only the cells whose
pivot distance less radius is within that bound (triangle inequality, Minkowski
p >= 1, with room for rounding), so the result is exact, ties included.

Cells are packed into blocks of at most ``block_rows`` rows (a larger cell is
split), a query row travels once to each block that holds a cell of its own, and
each (train block, query block) keeps the best k of a row. There, rows of the same
nearest pivot meet the union of their cells in one matrix product, and rows whose
cells hold most of the block meet the whole block. What the driver
holds is the pivots, radii and sizes: groups × at most ``MOST_CELLS``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Train rows of a cell on average, and cells of a group at most.
CELL_ROWS, MOST_CELLS = 16, 256
#: Pivot candidates drawn for each pivot.
_SPARE = 4
#: Rows whose distances to the pivots are computed at a time.
_STRIDE = 512
#: Share of a block's rows from which on a query row meets the whole block.
_MOST = 0.5

TopK = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int, float], tuple[np.ndarray, np.ndarray, np.ndarray]]


@dataclass
class Cells:
    """The cells of a group: pivots, radii, sizes, first block and number of blocks of each."""
    pivots: np.ndarray
    radius: np.ndarray
    size: np.ndarray
    block: np.ndarray
    blocks: np.ndarray


def distances(a: np.ndarray, b: np.ndarray, p: float) -> np.ndarray:
    """Minkowski distances of all rows of ``a`` to the few rows of ``b``."""
    out = np.empty((len(a), len(b)))
    for i in range(0, len(a), _STRIDE):
        part = a[i:i + _STRIDE]
        for j, row in enumerate(b):
            diff = np.abs(part - row)
            out[i:i + _STRIDE, j] = np.sqrt((diff * diff).sum(1)) if p == 2 else diff.sum(1) if p == 1 else (diff ** p).sum(1) ** (1.0 / p)
    return out


def _slack(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Room for the rounding of a distance, per row."""
    return 64 * np.finfo(float).eps * x.shape[1] * (np.abs(x).max(1, initial=0.0) + np.abs(pivots).max(initial=0.0))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if column.null_count or not len(column):
        return np.array(column.to_pylist(), float)
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(column), -1)


def _by_group(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
    groups = np.array(batch.column("_g").to_pylist())
    for g in np.unique(groups):
        yield g, np.flatnonzero(groups == g)


def make_cells(train: DataFrame, p: float, block_rows: int) -> dict[str, Cells]:
    """Cells of every group of ``(_g, _tid, _tx)``."""
    sizes = {r["_g"]: r["n"] for r in train.groupBy("_g").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per group
    cells = {g: min(MOST_CELLS, max(1, -(-n // CELL_ROWS))) if p >= 1 else 1 for g, n in sizes.items()}
    spark = train.sparkSession
    share = spark.createDataFrame([(g, min(1.0, _SPARE * cells[g] / n)) for g, n in sizes.items()], "_g string, _share double")
    h = F.pmod(F.xxhash64("_tid"), F.lit(1 << 30))
    drawn = train.join(F.broadcast(share), "_g").filter(h < F.col("_share") * float(1 << 30)).select("_g", "_tx", h.alias("_h"), "_tid")
    pivots: dict[str, np.ndarray] = {}
    rows: dict[str, list] = {}
    for r in drawn.collect():  # some _SPARE × MOST_CELLS rows per group
        rows.setdefault(r["_g"], []).append((r["_h"], r["_tid"], r["_tx"]))
    for g, drawn_rows in rows.items():
        pivots[g] = np.array([x for *_, x in sorted(drawn_rows)[:cells[g]]], float)
    shared = spark.sparkContext.broadcast(pivots)
    stats = (train.mapInArrow(_assign(shared, p), "_g string, _tid string, _cell int, _pd double")
             .groupBy("_g", "_cell").agg(F.max("_pd").alias("r"), F.count(F.lit(1)).alias("n")).collect())  # groups × cells
    out = {}
    for g in sizes:
        m = len(pivots.get(g, [0]))
        radius, size = np.zeros(m), np.zeros(m, np.int64)
        for r in stats:
            if r["_g"] == g:
                radius[r["_cell"]], size[r["_cell"]] = r["r"], r["n"]
        block, blocks, at, filled = np.zeros(m, np.int64), np.ones(m, np.int64), 0, 0
        for c in range(m):
            if filled and filled + size[c] > block_rows:
                at, filled = at + 1, 0
            block[c], blocks[c] = at, max(1, -(-size[c] // block_rows))
            filled += size[c]
            if blocks[c] > 1:  # a cell of several blocks shares none
                at, filled = at + blocks[c], 0
        out[g] = Cells(pivots.get(g, np.zeros((1, 0))), radius, size, block, blocks)
    return out


def _assign(shared, p: float):
    """Cell and pivot distance of each train row; without a pivot all rows are in cell 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, dist = np.zeros(b.num_rows, np.int32), np.full(b.num_rows, np.inf)
            x = _matrix(b.column("_tx"))
            for g, at in _by_group(b):
                pivots = shared.value.get(g)
                if pivots is not None:
                    d = distances(x[at], pivots, p)
                    cell[at] = d.argmin(1)
                    dist[at] = d.min(1) + _slack(x[at], pivots)
            yield pa.RecordBatch.from_arrays([b.column("_g"), b.column("_tid"), pa.array(cell), pa.array(dist)],
                                             names=["_g", "_tid", "_cell", "_pd"])
    return run


def cells_within(x: np.ndarray, cells: Cells, k: int, p: float) -> tuple[np.ndarray, np.ndarray]:
    """Which cells each row must meet for its k nearest (rows × cells), and its nearest pivot."""
    if p < 1 or not cells.pivots.shape[1]:
        return np.broadcast_to(cells.size > 0, (len(x), len(cells.size))), np.zeros(len(x), np.int32)
    d = distances(x, cells.pivots, p)
    room = _slack(x, cells.pivots)[:, None]
    far = np.where(cells.size > 0, d + cells.radius, np.inf)
    order = np.argsort(far, axis=1)
    held = np.cumsum(cells.size[order], axis=1)
    enough = np.argmax(held >= min(k, cells.size.sum()), axis=1)
    bound = np.take_along_axis(np.take_along_axis(far, order, 1), enough[:, None], 1)
    return (d - cells.radius <= bound + 2 * room) & (cells.size > 0), d.argmin(1).astype(np.int32)


def _route(shared, k: int, p: float):
    """One row per query row and train block that holds a cell of its own, with the row's nearest pivot."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("_qx"))
            rows, blocks, near, counts, lists = [[np.zeros(0, t)] for t in (np.int64, np.int32, np.int32, np.int64, np.int32)]
            for g, at in _by_group(b):
                cells = shared.value.get(g)
                if cells is None:
                    continue
                within, pivot = cells_within(x[at], cells, k, p)
                for block in range(int((cells.block + cells.blocks).max(initial=0))):
                    here = (cells.block <= block) & (block < cells.block + cells.blocks)
                    row, cell = np.nonzero(within & here)
                    meets, count = np.unique(row, return_counts=True)
                    rows.append(at[meets])
                    blocks.append(np.full(len(meets), block, np.int32))
                    near.append(pivot[meets])
                    counts.append(count)
                    lists.append(cell.astype(np.int32))
            ends = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32)
            out = b.take(pa.array(np.concatenate(rows)))
            yield (out.append_column("_tb", pa.array(np.concatenate(blocks)))
                   .append_column("_cells", pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists))))
                   .append_column("_near", pa.array(np.concatenate(near))))
    return run


def _place(shared, p: float):
    """Train rows with their cell and block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, first, many = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows, np.int64), np.ones(b.num_rows, np.int64)
            x = _matrix(b.column("_tx"))
            for g, at in _by_group(b):
                cells = shared.value[g]
                if cells.pivots.shape[1]:
                    cell[at] = distances(x[at], cells.pivots, p).argmin(1)
                first[at], many[at] = cells.block[cell[at]], cells.blocks[cell[at]]
            block = first + b.column("_h").to_numpy() % many
            yield b.append_column("_cell", pa.array(cell)).append_column("_tb", pa.array(block.astype(np.int32)))
    return run


def query_routes(query: DataFrame, cells: dict[str, Cells], k: int, p: float) -> DataFrame:
    """``(_g, _qid, _rid, _qx)`` with the train block ``_tb``, its ``_cells`` to meet and the nearest pivot ``_near``."""
    kinds = ", ".join(f"`{c}` {t}" for c, t in query.dtypes)
    return query.mapInArrow(_route(query.sparkSession.sparkContext.broadcast(cells), k, p), f"{kinds}, _tb int, _cells array<int>, _near int")


def meetings(cells: pa.ListArray, near: np.ndarray, cell: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Query rows that go together, and the train rows they meet: rows of one
    nearest pivot meet all cells of any of them; rows that would meet most of
    the block go together and meet all of it. More rows met change no result."""
    ends, held = cells.offsets.to_numpy(), cells.values.to_numpy()
    order, whole = np.argsort(near, kind="stable"), []
    for at in np.split(order, np.flatnonzero(np.diff(near[order])) + 1):
        met = np.zeros(max(held.max(initial=0), cell.max(initial=0)) + 1, bool)
        for i in at:
            met[held[ends[i]:ends[i + 1]]] = True
        own = np.flatnonzero(met[cell])
        if len(own) > _MOST * len(cell):
            whole.append(at)
        elif len(own):
            yield at, own
    if whole:
        yield np.concatenate(whole), np.arange(len(cell))


def _block_pair(topk: TopK, k: int, p: float, several: bool):
    def run(train: pa.Table, query: pa.Table) -> pa.Table:
        qid, rid, tid = (t.column(c).combine_chunks() for t, c in ((query, "_qid"), (query, "_rid"), (train, "_tid")))
        rows, dist, ys, ids = [], [], [], []
        if len(train) and len(query):
            xt, xq = _matrix(train.column("_tx")), _matrix(query.column("_qx"))
            yt = _matrix(train.column("_ty")) if several else train.column("_ty").to_numpy()
            by_id = pc.sort_indices(tid).to_numpy()  # in byte order, as Spark's
            rank = np.empty(len(by_id), np.int64)
            rank[by_id] = np.arange(len(by_id))
            for at, own in meetings(query.column("_cells").combine_chunks(), query.column("_near").to_numpy(), train.column("_cell").to_numpy()):
                d, y, near = topk(xq[at], xt[own], yt[own], rank[own], k, p)
                rows.append(np.repeat(at, d.shape[1]))
                dist.append(d.ravel())
                ys.append(y.reshape(d.size, *yt.shape[1:]))
                ids.append(by_id[near.ravel()])
        if not rows:
            return pa.table({"_qid": pa.array([], pa.string()), "_rid": pa.array([], pa.string()), "_d": pa.array([], pa.float64()),
                             "_y": pa.array([], pa.list_(pa.float64()) if several else pa.float64()), "_id": pa.array([], pa.string())})
        row, y = pa.array(np.concatenate(rows)), np.concatenate(ys)
        values = pa.array(y.ravel(), from_pandas=True)
        if several:
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1], pa.int32()), values)
        return pa.table({"_qid": qid.take(row), "_rid": rid.take(row), "_d": pa.array(np.concatenate(dist), from_pandas=True), "_y": values,
                         "_id": tid.take(pa.array(np.concatenate(ids)))})
    return run


def group_key(by: Sequence[str], *more: str) -> Column:
    return F.concat_ws("\u0001", *[F.col(c).cast("string") for c in [*by, *more]]) if by or more else F.lit("")


def row_key(by: Sequence[str], row_id: str) -> Column:
    """How the search names its query rows: the plain row id when there is no group."""
    return group_key(by, row_id) if by else F.col(row_id).cast("string")


def nearest(train: DataFrame, query: DataFrame, k: int, p: float, topk: TopK, row_id: str, col: str, y: str | Sequence[str] | None,
            exclude_self: bool, block_rows: int, by: Sequence[str]) -> DataFrame:
    """``(_qid, _rid, _rank, _id, _d, _y)`` of the k nearest train rows of every query row in its group;
    ``_y`` is an array if ``y`` names several columns."""
    kk = k + 1 if exclude_self else k
    several = y is not None and not isinstance(y, str)
    kind = "array<double>" if several else "double"
    t = train.select(group_key(by).alias("_g"), F.col(row_id).cast("string").alias("_tid"), F.col(col).alias("_tx"),
                     (F.lit(0.0) if not y else F.array(*[F.col(c).cast("double") for c in y]) if several else F.col(y).cast("double")).alias("_ty"))
    q = query.select(group_key(by).alias("_g"), group_key(by, row_id).alias("_qid"), F.col(row_id).cast("string").alias("_rid"), F.col(col).alias("_qx"))
    cells = make_cells(t, p, block_rows)
    most = q.groupBy("_g").count().agg(F.max("count")).first()[0] or 0
    parts = max(1, -(-most // block_rows))
    shared = train.sparkSession.sparkContext.broadcast(cells)
    placed = t.withColumn("_h", F.pmod(F.xxhash64("_tid"), F.lit(1 << 30))).mapInArrow(
        _place(shared, p), f"_g string, _tid string, _tx array<double>, _ty {kind}, _h long, _cell int, _tb int").drop("_h")
    placed = placed.withColumn("_qb", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    routed = query_routes(q, cells, kk, p).withColumn("_qb", F.pmod(F.xxhash64("_rid"), F.lit(parts)).cast("int"))
    found = placed.groupBy("_g", "_tb", "_qb").cogroup(routed.groupBy("_g", "_tb", "_qb")).applyInArrow(
        _block_pair(topk, kk, p, several), f"_qid string, _rid string, _d double, _y {kind}, _id string")
    if exclude_self:
        found = found.filter(F.col("_id") != F.col("_rid"))
    w = Window.partitionBy("_qid").orderBy("_d", "_id")  # at most k rows per block that the row has met
    return found.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k)
