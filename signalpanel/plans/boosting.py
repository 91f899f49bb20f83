"""Boosted trees of all folds and labels in the same passes.

Gradient boosting as MLlib's ``GBTClassifier`` does it: labels are ±1, the
first tree fits them, each later one the gradient 4y / (1 + exp(2yF)) of the
log loss at the margin F so far, with least squares, and adds its leaf means
times the learning rate; the score is 1 / (1 + exp(−2F)). Trees of all groups
grow together on binned blocks, one pass per level: a block walks its rows down
the trees since the stored margins and adds up rows and gradients by (node,
feature, bin). Every ``REFRESH`` rounds the blocks are stored again with their
margins, so a pass walks few trees however many there are, and no state is lost
with an executor. A round takes a row by the hash of (row, round).

Cuts are at the edges of up to ``BINS`` quantile bins, the best by the fall of
the variance, ties to the smaller feature, then the smaller bin. Groups with
one class score constantly (M14).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import PASS_BYTES, block_sums, train_blocks
from .forest import BINS, Tree, bin_edges, binned_blocks, mix, uniform
from .models import ModelSpec
from .network import by_design, constant_of

FAMILIES = ("gb",)
REFRESH = 25
MOST_DEPTH = 8
_PARAMS = {"n_estimators", "max_depth", "learning_rate", "subsample", "min_samples_leaf"}


@dataclass(frozen=True)
class Boost:
    """The settings of a configuration."""
    trees: int
    rate: float
    share: float
    depth: int
    leaf: int

    @staticmethod
    def of(spec: ModelSpec) -> Boost:
        p, extra = spec.params, set(spec.params) - _PARAMS
        depth = int(p.get("max_depth") or 5)
        if extra or not 1 <= depth <= MOST_DEPTH:
            raise ValueError(f"{spec.family} does not take {sorted(extra) or f'max_depth={depth}'}")
        return Boost(int(p.get("n_estimators", 100)), float(p.get("learning_rate", 0.1)), float(p.get("subsample", 1.0)),
                     depth, int(p.get("min_samples_leaf", 1)))


def new_tree(depth: int) -> Tree:
    tree = Tree(depth)
    tree.value = np.zeros(2 << depth)
    return tree


def margins(trees: Sequence[Tree], x: np.ndarray) -> np.ndarray:
    """Sum of the trees' values, which hold their weight."""
    out = np.zeros(len(x))
    for t in trees:
        out += t.value[t.walk(x, len(t.value).bit_length() - 2)]
    return out


def target(sign: np.ndarray, margin: np.ndarray | None) -> np.ndarray:
    """What a tree fits: the labels at first, then the log loss' gradient."""
    return sign if margin is None else 4.0 * sign / (1.0 + np.exp(np.clip(2.0 * sign * margin, -700, 700)))


def taken(h: np.ndarray, seed: int, round_: int, share: float) -> np.ndarray:
    return np.ones(len(h), bool) if share >= 1 else uniform(mix(h, seed, round_)) < share


def best_cuts(sums: np.ndarray, leaf: int) -> np.ndarray:
    """Per node, of rows and sums by (feature, bin): feature (−1: none), cut,
    rows and sum left, rows and sum of the whole node."""
    n, s = sums[:, 0], sums[:, 1]
    rows, left = n.cumsum(2), s.cumsum(2)
    all_, total = rows[:, :, -1:], left[:, :, -1:]
    with np.errstate(divide="ignore", invalid="ignore"):
        both = left ** 2 / rows + (total - left) ** 2 / (all_ - rows)
        gain = both - total ** 2 / all_
        fits = (rows >= max(leaf, 1)) & (all_ - rows >= max(leaf, 1)) & (gain > 1e-12 * both)
        gain = np.where(fits, gain, 0.0).reshape(len(n), -1)
        best = np.round(gain / gain.max(1, keepdims=True), 12).argmax(1)
    i, (j, cut) = np.arange(len(n)), np.divmod(best, n.shape[2])
    return np.column_stack([np.where(gain[i, best] > 0, j, -1), cut, rows[i, j, cut], left[i, j, cut], all_[:, 0, 0], total[:, 0, 0]])


def _open(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = row["n"]
    return (np.frombuffer(row["x"], np.uint8).reshape(n, -1), np.frombuffer(row["y"], np.int8) * 2.0 - 1.0,
            np.frombuffer(row["h"], np.uint64), np.frombuffer(row["f"]).reshape(n, -1))


def _sums(shared, bins: int):
    """Rows and what is to be fitted, by (node, feature, bin)."""
    def work(row: dict) -> dict[str, np.ndarray]:
        x, sign, h, f = _open(row)
        d, out = x.shape[1], {}
        for j in shared.value.get(row["design"], ()):
            at = j["grown"].walk(x, j["level"])
            place = np.searchsorted(j["nodes"], at)
            m = len(j["nodes"])
            ok = (j["nodes"][np.minimum(place, m - 1)] == at) & taken(h, j["seed"], j["round"], j["share"])
            xs = x[ok]
            r = target(sign[ok], f[ok, j["column"]] + margins(j["since"], xs) if j["round"] else None)
            cell = ((place[ok, None] * d + np.arange(d)) * bins + xs).ravel()
            sums = np.stack([np.bincount(cell, w, m * d * bins).reshape(m, -1) for w in (None, np.repeat(r, d))], 1)
            out[j["key"]] = sums.ravel()
        return out
    return work


class BoostPanel:
    """Boosted trees of every (configuration, design) of binned blocks."""

    def __init__(self, blocks: DataFrame, specs: Sequence[ModelSpec], seed: int = 42, bins: int = BINS):
        self.bins, self.passes = bins, 0
        settings = [Boost.of(s) for s in specs]
        blocks = blocks.drop("ids").withColumn("f", F.lit(b""))
        self.tasks = blocks.rdd.getNumPartitions()
        counts = block_sums(blocks, lambda row: {row["design"]: np.array(
            [*np.bincount(np.frombuffer(row["y"], np.int8), minlength=2), len(row["x"])], float)})
        self.constants: dict[tuple, float] = {}
        self.trees: dict[tuple, list[Tree]] = {}
        models = []
        for design, n in counts.items():
            for column, (spec, b) in enumerate(zip(specs, settings)):
                if (p := constant_of(n)) is not None:
                    self.constants[spec.key, design] = p
                    continue
                trees = self.trees[spec.key, design] = []
                models.append({"boost": b, "design": design, "column": column, "trees": trees, "d": int(round(n[2] / n[:2].sum())),
                               "key": f"{column}\x01{design}", "seed": seed + column})
        stored = 0
        for round_ in range(max((m["boost"].trees for m in models), default=0)):
            if round_ % REFRESH == 0:
                blocks = self._store(blocks, models, stored, len(specs))
                stored = round_
            growing = [m for m in models if round_ < m["boost"].trees]
            for m in growing:
                m["grown"], m["nodes"] = new_tree(m["boost"].depth), np.array([1])
            level = 0
            while active := [m for m in growing if len(m["nodes"]) and level < m["boost"].depth]:
                self._grow(blocks, active, level, round_, stored)
                level += 1
            for m in growing:
                m["grown"].value *= m["boost"].rate if round_ else 1.0
                m["trees"].append(m["grown"])

    def _store(self, blocks: DataFrame, models: Sequence[dict], since: int, columns: int) -> DataFrame:
        """Blocks with the margins of all trees so far."""
        plan: dict[str, list] = {}
        for m in models:
            plan.setdefault(m["design"], []).append((m["column"], m["trees"][since:]))
        shared = blocks.sparkSession.sparkContext.broadcast(plan)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                new = []
                for row in b.to_pylist():
                    x = np.frombuffer(row["x"], np.uint8).reshape(row["n"], -1)
                    f = np.frombuffer(row["f"]).reshape(row["n"], -1).copy() if row["f"] else np.zeros((row["n"], columns))
                    for column, trees in shared.value.get(row["design"], ()):
                        f[:, column] += margins(trees, x)
                    new.append(f.tobytes())
                yield b.set_column(b.schema.get_field_index("f"), "f", pa.array(new, pa.binary()))

        out = blocks.mapInArrow(run, ", ".join(f"{c} {k}" for c, k in blocks.dtypes)).checkpoint()
        shared.destroy()
        return out

    def _grow(self, blocks: DataFrame, active: Sequence[dict], level: int, round_: int, stored: int) -> None:
        self.passes += 1
        plan: dict[str, list[dict]] = {}
        for m in active:
            plan.setdefault(m["design"], []).append({
                "key": m["key"], "column": m["column"], "seed": m["seed"], "round": round_, "share": m["boost"].share, "level": level,
                "nodes": m["nodes"], "grown": m["grown"].top(level), "since": m["trees"][stored:]})
        shapes = {m["key"]: ((len(m["nodes"]), 2, m["d"], self.bins), m["boost"].leaf) for m in active}

        def cuts(key: str, total: np.ndarray) -> np.ndarray:
            shape, leaf = shapes[key]
            return best_cuts(total.reshape(shape), leaf).ravel()

        shared = blocks.sparkSession.sparkContext.broadcast(plan)
        # few numbers are added up by the driver as they come, others in Spark, where their cuts are made
        small = self.tasks * sum(8 * int(np.prod(shape)) for shape, _ in shapes.values()) <= PASS_BYTES
        found = block_sums(blocks, _sums(shared, self.bins), None if small else cuts, direct=self.tasks if small else 0)
        shared.destroy()
        for m in active:
            best = (cuts(m["key"], found[m["key"]]) if small else found[m["key"]]).reshape(-1, 6)
            tree, nodes, leaf = m["grown"], m["nodes"], m["boost"].leaf
            tree.value[nodes] = best[:, 5] / np.maximum(best[:, 4], 1)
            cutting = best[:, 0] >= 0
            at, n, s = nodes[cutting], best[cutting, 4], best[cutting, 5]
            tree.feature[at], tree.cut[at] = best[cutting, 0], best[cutting, 1]
            nexts = []
            for child, rows, total in ((2 * at, best[cutting, 2], best[cutting, 3]), (2 * at + 1, n - best[cutting, 2], s - best[cutting, 3])):
                tree.value[child] = total / rows
                nexts.append(child[rows >= 2 * max(leaf, 1)])
            m["nodes"] = np.sort(np.concatenate(nexts))


def scorer(rows: DataFrame, specs: Sequence[ModelSpec], seed: int = 42, bins: int = BINS) -> Callable[[DataFrame, ModelSpec], DataFrame]:
    """Fit every configuration on the train rows of every ``design`` of long
    rows ``(design, part, y, x, row_id)``. The scorer adds column ``p``."""
    edges = bin_edges(rows.withColumn("train", (F.col("part") == "train") & F.col("y").isNotNull()), bins)
    panel = BoostPanel(binned_blocks(train_blocks(rows), edges), specs, seed, bins)

    def run(df: DataFrame, spec: ModelSpec) -> DataFrame:
        own = {d: (edges[d], t) for (name, d), t in panel.trees.items() if name == spec.key}
        constants = {d: p for (name, d), p in panel.constants.items() if name == spec.key}
        shared = df.sparkSession.sparkContext.broadcast((own, constants))

        def score(design: str, x: np.ndarray) -> np.ndarray:
            fitted, constant = shared.value
            if design not in fitted:
                return np.full(len(x), constant.get(design, 0.0))
            cuts, trees = fitted[design]
            bins_ = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(cuts)], 1).astype(np.uint8)
            return 1.0 / (1.0 + np.exp(np.clip(-2.0 * margins(trees, bins_), -700, 700)))

        return df.withColumn("p", by_design(score))
    return run
