"""Perceptrons of all folds and labels in the same passes (M8).

Sigmoid layers below a softmax of two classes, mean cross-entropy, L-BFGS from
small uniform weights: the model of MLlib's ``MultilayerPerceptronClassifier``,
with its rule for the end of a fit. Train rows are feature blocks (``blocks``);
a pass adds up values and gradients of every network that is not done, each at
its own point, so the number of Spark jobs is that of the network that takes
the most, however many there are. The driver holds networks × weights numbers.
Groups with one class score constantly (M14).
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import PASS_BYTES, block_sums, open_block, train_blocks
from .linear import Descent
from .models import ModelSpec

FAMILIES = ("mlp",)
#: A fit ends when its value falls by no more than this share of the first value in ``MEMORY`` steps.
TOL, MEMORY = 1e-6, 20


def shapes(d: int, hidden: Sequence[int]) -> list[tuple[int, int]]:
    """Inputs (and one for the intercept) and outputs of each layer."""
    return [(a + 1, b) for a, b in itertools.pairwise([d, *hidden, 2])]


def layers(w: np.ndarray, sizes: Sequence[tuple[int, int]]) -> list[np.ndarray]:
    ends = np.cumsum([a * b for a, b in sizes])
    return [part.reshape(size) for part, size in zip(np.split(w, ends[:-1]), sizes)]


def start(sizes: Sequence[tuple[int, int]], seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.uniform(-2.4, 2.4, a * b) / (a - 1) for a, b in sizes])


def _forward(x: np.ndarray, ws: Sequence[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Inputs of each layer, and the last layer's log odds of the two classes."""
    inputs = [x]
    for w in ws[:-1]:
        inputs.append(1.0 / (1.0 + np.exp(-np.clip(inputs[-1] @ w[:-1] + w[-1], -700, 700))))
    return inputs, inputs[-1] @ ws[-1][:-1] + ws[-1][-1]


def positive(x: np.ndarray, ws: Sequence[np.ndarray]) -> np.ndarray:
    """Probability of class 1."""
    z = _forward(x, ws)[1]
    return 1.0 / (1.0 + np.exp(np.clip(z[:, 0] - z[:, 1], -700, 700)))


def value_and_gradient(x: np.ndarray, y: np.ndarray, ws: Sequence[np.ndarray]) -> np.ndarray:
    """Sums over the rows: the gradient, and behind it the cross-entropy."""
    inputs, z = _forward(x, ws)
    whole = np.logaddexp(z[:, 0], z[:, 1])
    delta = np.exp(z - whole[:, None])
    rows = np.arange(len(x))
    delta[rows, y] -= 1.0
    out: list[np.ndarray] = [np.array([(whole - z[rows, y]).sum()])]
    for w, a in zip(reversed(ws), reversed(inputs)):
        out += [delta.sum(0), (a.T @ delta).ravel()]
        if a is not x:
            delta = (delta @ w[:-1].T) * a * (1.0 - a)
    return np.concatenate(out[::-1])


class NetworkDescent(Descent):
    """L-BFGS that ends as MLlib's does."""

    def __init__(self, first: np.ndarray, max_iter: int):
        super().__init__(len(first), 0.0)
        self.point = self._x = first
        self.max_iter, self.values = max_iter, []

    def tell(self, f: float, g: np.ndarray) -> None:
        at = self.point
        super().tell(f, g)
        if self._x is at:  # a step was made
            self.values.append(f)
            flat = len(self.values) > 1 and abs(f - max(self.values[-MEMORY:])) <= TOL * abs(self.values[0])
            self.done |= bool(flat or np.linalg.norm(g) <= max(TOL * abs(f), 1e-8) or len(self.values) > self.max_iter)


def _sums(shared):
    def work(row: dict) -> dict[str, np.ndarray]:
        x, y, _ = open_block(row)
        return {key: value_and_gradient(x, y[:, 0], layers(w, sizes)) for key, w, sizes in shared.value.get(row["design"], ())}
    return work


def class_counts(row: dict) -> dict[str, np.ndarray]:
    """Rows by class and number of features, summed over the rows of a design."""
    x, y, _ = open_block(row)
    return {row["design"]: np.array([(y == 0).sum(), (y == 1).sum(), x.size], float)}


def constant_of(n: np.ndarray | None) -> float | None:
    """The score of a design with at most one class."""
    if n is None:
        return 0.0
    return float(n[1] / (n[0] + n[1])) if min(n[:2]) == 0 else None


def fit_networks(blocks: DataFrame, specs: Sequence[ModelSpec], seed: int = 42) -> tuple[dict, int]:
    """``{(name of the configuration, design): weights by layer, or a constant}`` and the number of passes."""
    blocks = blocks.drop("ids")
    counts, tasks = block_sums(blocks, class_counts), blocks.rdd.getNumPartitions()
    fits, out = {}, {}
    for design, n in counts.items():
        for i, spec in enumerate(specs):
            if (p := constant_of(n)) is not None:
                out[spec.key, design] = p
                continue
            sizes = shapes(int(round(n[2] / n[:2].sum())), list(spec.params.get("hidden", (64,))))
            fits[f"{i}\x01{design}"] = (spec.key, design, sizes, n[:2].sum(), NetworkDescent(start(sizes, seed), int(spec.params.get("max_iter", 500))))
    passes = 0
    while active := {k: v for k, v in fits.items() if not v[-1].done}:
        plan: dict[str, list[tuple]] = {}
        for key, (_, design, sizes, _, state) in active.items():
            plan.setdefault(design, []).append((key, state.point, sizes))
        shared = blocks.sparkSession.sparkContext.broadcast(plan)
        size = 8 * sum(len(v[-1].point) + 1 for v in active.values())
        sums = block_sums(blocks, _sums(shared), direct=PASS_BYTES // size)
        shared.destroy()
        for key, (_, _, _, n, state) in active.items():
            state.tell(sums[key][-1] / n, sums[key][:-1] / n)
        passes += 1
    return out | {(name, design): layers(state.best, sizes) for name, design, sizes, _, state in fits.values()}, passes


def by_design(score: Callable[[str, np.ndarray], np.ndarray]):
    """A column of scores of ``(design, x)`` from ``score(design, rows)``."""
    @F.pandas_udf("double")
    def run(design: pd.Series, x: pd.Series) -> pd.Series:
        out = np.zeros(len(x))
        for d, at in design.groupby(design).indices.items():
            out[at] = score(d, np.vstack(x.to_numpy()[at]))
        return pd.Series(out)

    return run("design", "x")


def scorer(rows: DataFrame, specs: Sequence[ModelSpec], seed: int = 42) -> Callable[[DataFrame, ModelSpec], DataFrame]:
    """Fit every configuration on the train rows of every ``design`` of long
    rows ``(design, part, y, x, row_id)``. The scorer adds column ``p``."""
    fitted, _ = fit_networks(train_blocks(rows), specs, seed)

    def run(df: DataFrame, spec: ModelSpec) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast({d: m for (name, d), m in fitted.items() if name == spec.key})

        def score(design: str, x: np.ndarray) -> np.ndarray:
            m = shared.value.get(design, 0.0)
            return np.full(len(x), m) if isinstance(m, float) else positive(x, m)

        return df.withColumn("p", by_design(score))
    return run
