"""Many linear models in one pass.

All (configuration, fold, label) models, and the models of their calibration
folds, are fitted together: rows are feature blocks (``blocks``), each pass
multiplies every block by the weight matrix of all models of its design, and
the sums of losses and gradients come back as one vector per weight matrix.
Each model keeps its own L-BFGS state and step on the driver, asks for the
value at one point per pass and leaves the passes when its gradient is small.
So the number of Spark jobs is the largest number of steps that a model needs,
however many models there are; the driver holds models × features numbers.

Objectives, with weights s balanced over the classes of the model's own rows:
``Σ s·loss(margin) / n + λ/2·(|w|² + [intercept²])``

* ``logreg``: logistic loss, λ = 1/(C·n), intercept penalised;
* ``sgd_log``: logistic loss, λ = alpha, free intercept (the optimum itself);
* ``linear_svc``: squared hinge, λ = 1/(C·n), intercept penalised;
* ``rbf_svm``: hinge, rounded over ``HINGE_WIDTH`` below the margin, on random
  Fourier features; λ = 1/(C·n), free intercept. One base ``x·Ω`` serves every
  γ of a design: features are cos(√(2γ)·x·Ω + b).

Calibration: ``linear_svc`` has one sigmoid per calibration fold, fitted on the
fold's margins under the model of the other folds, and scores with their mean;
``rbf_svm`` has one sigmoid on the margins of all folds and scores with the
model of all rows. Sigmoids are two-parameter Newton steps on summed
derivatives with smoothed targets, all sigmoids in one pass per step. Labels
with fewer than two rows of a class stay uncalibrated (M13); with one class the
score is constant (M14).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import prep as P
from ..operators import split as C
from ..session import ensure_checkpoint_dir
from .blocks import ABSENT, block_sums, feature_blocks, open_block, open_keys, row_key, wide_rows
from .models import RFF_DIM, ModelSpec

FAMILIES = ("logreg", "sgd_log", "linear_svc", "rbf_svm")
_LOSS = {"logreg": "log", "sgd_log": "log", "linear_svc": "squared_hinge", "rbf_svm": "hinge"}
_PARAMS = {"logreg": {"C", "penalty", "max_iter", "class_weight"}, "sgd_log": {"alpha", "penalty", "max_iter", "tol", "class_weight"},
           "linear_svc": {"C", "max_iter", "class_weight"}, "rbf_svm": {"C", "gamma", "dim", "class_weight"}}
CALIBRATION_FOLDS = {"linear_svc": 3, "rbf_svm": 5}
HINGE_WIDTH = 0.1
#: Largest gradient entry (of the mean loss) that ends a fit; the rounded hinge needs no more than its library's default.
GRADIENT_TOL, HINGE_TOL, MAX_PASSES = 1e-5, 2e-3, 400
_HISTORY = 10
#: Marks of a row for a label: not in the train part, or in it without a calibration fold.
_TEST, _TRAIN = -2, -1
_MARKS = 1 + max(CALIBRATION_FOLDS.values())


def losses(kind: str, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loss and derivative at the margins y·f."""
    if kind == "log":
        return np.logaddexp(0.0, -m), -1.0 / (1.0 + np.exp(np.clip(m, -700, 700)))
    short = np.maximum(0.0, 1.0 - m)
    if kind == "squared_hinge":
        return short * short, -2.0 * short
    near = short < HINGE_WIDTH
    return (np.where(near, short * short / (2 * HINGE_WIDTH), short - HINGE_WIDTH / 2), -np.where(near, short / HINGE_WIDTH, 1.0))


class Descent:
    """L-BFGS of one model, one evaluation at a time."""

    def __init__(self, size: int, tol: float = GRADIENT_TOL):
        self.tol, self.point = tol, np.zeros(size)
        self._x = self.point
        self._f, self._g, self._pairs, self._step, self.done, self.norm = math.inf, None, [], 1.0, False, math.inf

    def _direction(self) -> np.ndarray:
        q, kept = self._g.copy(), []
        for s, y, rho in reversed(self._pairs):
            kept.append(rho * (s @ q))
            q -= kept[-1] * y
        if self._pairs:
            s, y, _ = self._pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y, rho), a in zip(self._pairs, reversed(kept)):
            q += s * (a - rho * (y @ q))
        return -q

    def tell(self, f: float, g: np.ndarray) -> None:
        """Value and gradient at ``point``; moves ``point`` or is done."""
        if self._g is not None:
            slope = self._g @ self._d
            if f > self._f + 1e-4 * self._step * slope + 1e-15 * abs(self._f):
                # too far: the minimum of the parabola through both values, within bounds
                rise = f - self._f - self._step * slope
                self._step *= min(0.5, max(0.1, -0.5 * slope * self._step / rise)) if rise > 0 else 0.5
                self.done = self._step < 1e-14
                self.point = self._x + self._step * self._d
                return
            s, y = self.point - self._x, g - self._g
            if s @ y > 1e-14 * (y @ y):
                self._pairs = [*self._pairs, (s, y, 1.0 / (s @ y))][-_HISTORY:]
        self._x, self._f, self._g = self.point, f, g
        self.norm = float(np.abs(g).max())
        self.done = self.norm <= self.tol
        self._d = self._direction()
        self._step = 1.0 if self._pairs else min(1.0, 1.0 / np.abs(g).sum()) if self.norm else 1.0
        self.point = self._x if self.done else self._x + self._step * self._d

    @property
    def best(self) -> np.ndarray:
        return self._x


class Sigmoid:
    """Newton steps for ``p = 1 / (1 + exp(A·f + B))`` on smoothed targets."""

    def __init__(self, n_pos: float, n_neg: float):
        self.low, self.high = 1.0 / (n_neg + 2.0), (n_pos + 1.0) / (n_pos + 2.0)
        self.point = self._x = np.array([0.0, math.log((n_neg + 1.0) / (n_pos + 1.0))])
        self._f, self._g, self._step, self.done = math.inf, None, 1.0, False

    def tell(self, sums: np.ndarray) -> None:
        """``sums``: value, two first and three second derivatives at ``point``."""
        f, g, (haa, hab, hbb) = sums[0], sums[1:3], sums[3:]
        if self._g is not None and f > self._f + 1e-4 * self._step * (self._g @ self._d) + 1e-12 * abs(self._f):
            self._step /= 2
            self.done = self._step < 1e-10
            self.point = self._x + self._step * self._d
            return
        self._x, self._f, self._g = self.point, f, g
        self.done = bool(np.abs(g).max() < 1e-7)
        self._d = -np.linalg.solve(np.array([[haa + 1e-12, hab], [hab, hbb + 1e-12]]), g)
        self._step = 1.0
        self.point = self._x if self.done else self._x + self._d

    @property
    def best(self) -> np.ndarray:
        return self._x


@dataclass
class _Model:
    """One fit: a configuration, its design and label; ``fold`` is the
    calibration fold it leaves out (None: it has all train rows)."""
    spec: ModelSpec
    design: str
    label: int
    fold: int | None
    gamma: float | None
    n: np.ndarray  # train rows by class
    size: int
    state: Descent | None = None

    @property
    def group(self) -> str:
        """Models that share a weight matrix."""
        return f"{self.design}\x01{self.gamma}\x01{_LOSS[self.spec.family]}"

    @property
    def ridge(self) -> float:
        p = self.spec.params
        return float(p.get("alpha", 1e-4)) if self.spec.family == "sgd_log" else 1.0 / (float(p.get("C", 1.0)) * self.n.sum())

    @property
    def weights(self) -> np.ndarray:
        return self.n.sum() / (2.0 * self.n) if self.spec.params.get("class_weight", "balanced") == "balanced" else np.ones(2)


def check_params(spec: ModelSpec) -> None:
    """Every parameter acts, or is refused."""
    extra = set(spec.params) - _PARAMS[spec.family]
    if extra or spec.params.get("penalty", "l2") != "l2":
        raise ValueError(f"{spec.family} does not take {sorted(extra) or spec.params['penalty']}")


class Base:
    """Random Fourier base of a feature count, the same for every γ."""

    def __init__(self, d: int, dim: int, seed: int):
        rng = np.random.default_rng(seed)
        self.omega, self.shift = rng.normal(size=(d, dim)), rng.uniform(0.0, 2.0 * math.pi, dim)

    def project(self, x: np.ndarray) -> np.ndarray:
        return x @ self.omega

    def features(self, projected: np.ndarray, gamma: float) -> np.ndarray:
        return math.sqrt(2.0 / len(self.shift)) * np.cos(math.sqrt(2.0 * gamma) * projected + self.shift)


def _group_features(x: np.ndarray, base: Base | None, groups: Sequence[dict]) -> Iterator[tuple[dict, np.ndarray]]:
    projected, made = None, {}
    for g in groups:
        gamma = g["gamma"]
        if gamma is None:
            yield g, x
            continue
        if projected is None:
            projected = base.project(x)
        if gamma not in made:
            made = {gamma: base.features(projected, gamma)}  # groups come sorted by γ
        yield g, made[gamma]


def _train_mask(k: np.ndarray, label: np.ndarray, fold: np.ndarray) -> np.ndarray:
    own = k[:, label]
    return (own != _TEST) & (own != fold[None, :])


def _loss_sums(shared, base: Base | None):
    def work(row: dict) -> dict[str, np.ndarray]:
        x, y, k = open_block(row)
        out = {}
        for g, z in _group_features(x, base, shared.value.get(row["design"], ())):
            label = g["label"]
            sign = np.where(y[:, label] == 1, 1.0, -1.0)
            weight = np.where(_train_mask(k, label, g["fold"]), np.where(y[:, label] == 1, g["weight"][1], g["weight"][0]), 0.0)
            value, slope = losses(g["loss"], sign * (z @ g["w"] + g["b"]))
            slope = slope * sign * weight
            out[g["key"]] = np.concatenate([z.T @ slope, slope.sum(0)[None], (value * weight).sum(0)[None]])
        return out
    return work


def _shared_groups(models: Sequence[_Model], points: Sequence[np.ndarray]) -> dict[str, list[dict]]:
    """Weight matrices by design, those of one γ next to each other."""
    by_group: dict[str, list[tuple[_Model, np.ndarray]]] = {}
    for m, w in zip(models, points):
        by_group.setdefault(m.group, []).append((m, w))
    out: dict[str, list[dict]] = {}
    for key, ms in sorted(by_group.items()):
        first = ms[0][0]
        out.setdefault(first.design, []).append({
            "key": key, "gamma": first.gamma, "loss": _LOSS[first.spec.family], "label": np.array([m.label for m, _ in ms]),
            "fold": np.array([-9 if m.fold is None else m.fold for m, _ in ms]), "weight": np.array([m.weights for m, _ in ms]).T,
            "w": np.stack([w[:-1] for _, w in ms], 1), "b": np.array([w[-1] for _, w in ms]), "models": [m for m, _ in ms]})
    return out


def _broadcast(blocks: DataFrame, groups: dict[str, list[dict]]):
    """Weights to the workers: models × features numbers, whatever the rows."""
    plain = {d: [{k: v for k, v in g.items() if k != "models"} for g in gs] for d, gs in groups.items()}
    return blocks.sparkSession.sparkContext.broadcast(plain)


def descend(blocks: DataFrame, models: Sequence[_Model], base: Base | None, tol: float | None = None,
            max_passes: int = MAX_PASSES) -> int:
    """Fit all models; the number of passes (one Spark job each)."""
    for m in models:
        m.state = Descent(m.size + 1, tol or (HINGE_TOL if m.spec.family == "rbf_svm" else GRADIENT_TOL))
    for passes in range(max_passes):
        active = [m for m in models if not m.state.done]
        if not active:
            return passes
        groups = _shared_groups(active, [m.state.point for m in active])
        shared = _broadcast(blocks, groups)
        sums = block_sums(blocks, _loss_sums(shared, base))
        shared.destroy()
        for gs in groups.values():
            for g in gs:
                total = sums[g["key"]].reshape(-1, len(g["models"]))
                for c, m in enumerate(g["models"]):
                    w, n = m.state.point, m.n.sum()
                    free = 0.0 if m.spec.family in ("logreg", "linear_svc") else 1.0
                    penalised = w.copy()
                    penalised[-1] *= 1.0 - free
                    m.state.tell(total[-1, c] / n + m.ridge / 2 * (penalised @ penalised), total[:-1, c] / n + m.ridge * penalised)
    return max_passes


def _sigmoid_sums(shared, base: Base | None):
    def work(row: dict) -> dict[str, np.ndarray]:
        x, y, k = open_block(row)
        out: dict[str, np.ndarray] = {}
        for g, z in _group_features(x, base, shared.value.get(row["design"], ())):
            f = z @ g["w"] + g["b"]
            for c, (key, a, b, low, high) in enumerate(g["sigmoids"]):
                held = k[:, g["label"][c]] == g["fold"][c]
                m = f[held, c]
                t = np.where(y[held, g["label"][c]] == 1, high, low)
                u = a * m + b
                p = 1.0 / (1.0 + np.exp(np.clip(u, -700, 700)))
                first, second = t - p, p * (1.0 - p)
                own = np.array([(t * u + np.logaddexp(0.0, -u)).sum(), (m * first).sum(), first.sum(),
                                (m * m * second).sum(), (m * second).sum(), second.sum()])
                out[key] = out[key] + own if key in out else own
        return out
    return work


def _counts(n_targets: int):
    """Per design: train rows by target, calibration fold and class, then
    train rows, features, and the sum and sum of squares over both."""
    def work(row: dict) -> dict[str, np.ndarray]:
        x, y, k = open_block(row)
        n = np.zeros((n_targets, _MARKS, 2))
        for t in range(n_targets):
            ok = (k[:, t] != _TEST) & (y[:, t] >= 0)
            np.add.at(n, (t, k[ok, t] + 1, y[ok, t]), 1)
        train = x[(k != _TEST).any(1)]
        return {row["design"]: np.concatenate([n.ravel(), [len(train), train.size, train.sum(), (train * train).sum()]])}
    return work


def targets_of(specs: Sequence[ModelSpec], labels: Sequence[str]) -> list[tuple[str, int]]:
    """The columns of a block: each label with each number of calibration folds in use."""
    folds = sorted({CALIBRATION_FOLDS.get(s.family, 0) for s in specs})
    return [(label, f) for label in labels for f in folds]


class LinearPanel:
    """Fitted models of a set of configurations over blocks of designs."""

    def __init__(self, blocks: DataFrame, specs: Sequence[ModelSpec], labels: Sequence[str], designs: dict[str, str], seed: int = 42,
                 tol: float | None = None, whole: bool = False):
        """``designs``: name of each design in the blocks → its scaler;
        ``whole``: fit every configuration on all train rows too."""
        for s in specs:
            check_params(s)
        self.specs, self.targets = list(specs), targets_of(specs, labels)
        counts = block_sums(blocks, _counts(len(self.targets)))
        dims = {int(s.params.get("dim", RFF_DIM)) for s in specs if s.family == "rbf_svm"}
        if len(dims) > 1:
            raise ValueError(f"one random base serves all configurations, not {sorted(dims)} features")
        self.base, self.constants, self.whole = None, {}, whole
        self._held: dict[str, np.ndarray] = {d: v[:-4].reshape(len(self.targets), _MARKS, 2) for d, v in counts.items()}
        self._uses: dict[tuple, list[_Model]] = {}
        for design, scaler in designs.items():
            rows, cells, total, squares = counts[design][-4:]
            width = int(cells // max(rows, 1))
            if dims and self.base is None:
                self.base = Base(width, dims.pop(), seed)
            spread = squares / cells - (total / cells) ** 2 if cells else 0.0
            scale = 1.0 / (width * spread) if spread > 0 else 1.0
            for spec in (s for s in specs if s.scaler == scaler):
                gamma = None
                if spec.family == "rbf_svm":
                    gamma = scale if spec.params.get("gamma", "scale") == "scale" else float(spec.params["gamma"])
                size = width if gamma is None else len(self.base.shift)
                for t, (_, folds) in enumerate(self.targets):
                    if folds == CALIBRATION_FOLDS.get(spec.family, 0):
                        self._plan(spec, design, t, gamma, size)
        self.models = [m for ms in self._uses.values() for m in ms]
        self.passes = descend(blocks, self.models, self.base, tol)
        self.sigmoids = self._calibrate(blocks)

    def _plan(self, spec: ModelSpec, design: str, target: int, gamma: float | None, size: int) -> None:
        """The fits that a configuration needs for a label."""
        n = self._held[design][target]
        rows, use = n.sum(0), (spec.key, design, target)
        if min(rows) == 0:
            self.constants[use] = float(rows[1] / rows.sum()) if rows.sum() else 0.0
            return
        folds = [f for f in range(_MARKS - 1) if n[f + 1].sum()]
        whole = [None] if not folds or spec.family == "rbf_svm" or self.whole else []
        # a fold that leaves a class without rows has no model of its own
        fits = [_Model(spec, design, target, f, gamma, rows - (n[f + 1] if f is not None else 0), size) for f in [*whole, *folds]]
        self._uses[use] = [m for m in fits if min(m.n) > 0]

    def _sigmoid_key(self, m: _Model) -> str:
        """One sigmoid per fold, or one for all folds of a configuration."""
        one = f"{m.spec.key}\x01{m.design}\x01{m.label}"
        return one if m.spec.family == "rbf_svm" else f"{one}\x01{m.fold}"

    def _calibrate(self, blocks: DataFrame) -> dict[str, Sigmoid]:
        held = [m for m in self.models if m.fold is not None]
        sizes: dict[str, np.ndarray] = {}
        for m in held:
            key = self._sigmoid_key(m)
            sizes[key] = sizes.get(key, 0) + self._held[m.design][m.label][m.fold + 1]
        out = {k: Sigmoid(n[1], n[0]) for k, n in sizes.items()}
        while True:
            active = [m for m in held if not out[self._sigmoid_key(m)].done]
            if not active:
                return out
            groups = _shared_groups(active, [m.state.best for m in active])
            for gs in groups.values():
                for g in gs:
                    keys = [self._sigmoid_key(m) for m in g["models"]]
                    g["sigmoids"] = [(k, *out[k].point, out[k].low, out[k].high) for k in keys]
            shared = _broadcast(blocks, groups)
            sums = block_sums(blocks, _sigmoid_sums(shared, self.base))
            shared.destroy()
            for k, v in sums.items():
                out[k].tell(v)

    def scores(self, blocks: DataFrame) -> DataFrame:
        """``(design, model, label, row_id, x_hash, p)`` of every row of the blocks, once for its copies."""
        def run(row: dict, g: dict, p: np.ndarray) -> Iterator[pa.RecordBatch]:
            if "opened" not in row:
                _, x_hash, copy, row_id = open_keys(row["ids"])
                once = copy == 1
                row["opened"] = once, pa.array(row_id[once], pa.string()), pa.array(x_hash[once])
            once, row_id, x_hash = row["opened"]
            yield pa.RecordBatch.from_arrays(
                [*[pa.repeat(v, len(row_id)) for v in (row["design"], g["model"], g["label"])], row_id, x_hash, pa.array(p[once])],
                names=["design", "model", "label", "row_id", "x_hash", "p"])

        return self._scored(blocks, run, "design string, model string, label string, row_id string, x_hash long, p double")

    def labelled_scores(self, blocks: DataFrame) -> DataFrame:
        """``(design, config, label, part, y, p)`` of every row and label that it
        has: the scores beside what they are compared with, so that scores of
        many configurations (by their place in ``specs``) need not meet their rows in a join."""
        column: dict[str, int] = {}
        for t, (label, _) in enumerate(self.targets):
            column.setdefault(label, t)
        place = {s.key: i for i, s in enumerate(self.specs)}

        def run(row: dict, g: dict, p: np.ndarray) -> Iterator[pa.RecordBatch]:
            if "opened" not in row:
                row["opened"] = open_keys(row["ids"])[0]
            y = open_block(row)[1][:, column[g["label"]]]
            has = y != ABSENT
            n = int(has.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(row["design"], n), pa.repeat(pa.scalar(place[g["spec"]], pa.int32()), n), pa.repeat(g["label"], n),
                 pa.array(row["opened"][has], pa.string()), pa.array(y[has].astype(np.int32), mask=y[has] < 0), pa.array(p[has])],
                names=["design", "config", "label", "part", "y", "p"])

        return self._scored(blocks, run, "design string, config int, label string, part string, y int, p double")

    def _scored(self, blocks: DataFrame, rows: Callable[[dict, dict, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """What ``rows`` makes of each block, configuration and label, and the scores of the block's rows."""
        plan: dict[str, list[dict]] = {}
        for (_, design, target), ms in self._uses.items():
            held = [m for m in ms if m.fold is not None]
            if held and ms[0].spec.family == "rbf_svm":
                parts = [(ms[0], self.sigmoids[self._sigmoid_key(held[0])].best)]
            elif held:
                parts = [(m, self.sigmoids[self._sigmoid_key(m)].best) for m in held]
            else:  # the plain logistic map of the margin
                parts = [(ms[0], np.array([-1.0, 0.0]))]
            plan.setdefault(design, []).append({
                "spec": ms[0].spec.key, "model": ms[0].spec.name or ms[0].spec.family, "label": self.targets[target][0], "gamma": ms[0].gamma,
                "w": np.stack([m.state.best for m, _ in parts], 1), "ab": np.array([ab for _, ab in parts]).T})
        for (key, design, target), p in self.constants.items():
            spec = next(s for s in self.specs if s.key == key)
            plan.setdefault(design, []).append({"spec": key, "model": spec.name or spec.family, "label": self.targets[target][0], "gamma": None, "constant": p})
        for gs in plan.values():
            gs.sort(key=lambda g: (g["gamma"] is not None, g["gamma"] or 0.0))
        shared, base = blocks.sparkSession.sparkContext.broadcast(plan), self.base

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in b.to_pylist():
                    x, _, _ = open_block(row)
                    for g, z in _group_features(x, base, shared.value.get(row["design"], ())):
                        if "constant" in g:
                            p = np.full(len(x), g["constant"])
                        else:
                            u = (z @ g["w"][:-1] + g["w"][-1]) * g["ab"][0] + g["ab"][1]
                            p = (1.0 / (1.0 + np.exp(np.clip(u, -700, 700)))).mean(1)
                        yield from rows(row, g, p)

        return blocks.mapInArrow(run, schema)

    @property
    def worst_gradient(self) -> float:
        return max((m.state.norm for m in self.models), default=0.0)


def fit_sigmoids(margins: DataFrame, by: Sequence[str], margin: str = "margin", y: str = "y") -> DataFrame:
    """Sigmoids of any margins: ``(*by, a, b)`` per group with both classes,
    all groups in one aggregate per Newton step (one small row per group)."""
    by, spark = list(by), margins.sparkSession
    sizes = margins.groupBy(*by).agg(F.count_if(F.col(y) == 1).alias("_p"), F.count_if(F.col(y) == 0).alias("_n"))
    state = {tuple(r[c] for c in by): Sigmoid(r["_p"], r["_n"]) for r in sizes.filter("_p > 0 and _n > 0").collect()}  # one row per group
    kinds = ", ".join(f"`{c}` {dict(margins.dtypes)[c]}" for c in by)
    f = F.col(margin).cast("double")
    while any(not s.done for s in state.values()):
        now = spark.createDataFrame([(*k, *map(float, s.point), s.low, s.high) for k, s in state.items() if not s.done],
                                    f"{kinds}, _a double, _b double, _low double, _high double")
        r = margins.join(F.broadcast(now), by).select(
            *by, f.alias("_f"), (F.col("_a") * f + F.col("_b")).alias("_u"), F.when(F.col(y) == 1, F.col("_high")).otherwise(F.col("_low")).alias("_t"))
        r = r.withColumn("_q", 1.0 / (1.0 + F.exp(F.col("_u"))))
        first, second = F.col("_t") - F.col("_q"), F.col("_q") * (1.0 - F.col("_q"))
        fx = F.col("_f")
        loss = F.col("_t") * F.col("_u") + F.greatest(F.lit(0.0), -F.col("_u")) + F.log1p(F.exp(-F.abs("_u")))
        sums = r.groupBy(*by).agg(*[F.sum(v).alias(f"_s{i}") for i, v in enumerate(
            (loss, fx * first, first, fx * fx * second, fx * second, second))])
        for row in sums.collect():  # one row per group
            state[tuple(row[c] for c in by)].tell(np.array([row[f"_s{i}"] for i in range(6)]))
    return spark.createDataFrame([(*k, *map(float, s.best)) for k, s in state.items()], f"{kinds}, a double, b double")


def linear_blocks(rows: DataFrame, specs: Sequence[ModelSpec], labels: Sequence[str], seed: int = 42) -> tuple[DataFrame, dict[str, str]]:
    """Blocks of long rows ``(fold, part, label, y, row_id, x)`` under the
    scalers of ``specs``, each fitted on a fold's train rows, and the designs
    with their scalers. Calibration folds are dealt by class within (fold,
    label); there are as many as the smaller class has rows, if those are fewer."""
    targets = targets_of(specs, labels)
    row = ["row_id", "x_hash", "copy"]
    slim = rows.select("fold", "part", "label", F.col("y").cast("int").alias("y"), F.col("row_id").cast("string").alias("row_id"), F.xxhash64("x").alias("x_hash"))
    same = Window.partitionBy("fold", "part", "label", "row_id", "x_hash").orderBy("y")  # rows given more than once, numbered as in ``wide_rows``
    train = slim.withColumn("copy", F.row_number().over(same)).filter(F.col("part") == "train").withColumnRenamed("fold", "_f")
    least = train.groupBy("_f", "label").agg(F.least(F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0)).alias("_m"))
    marked = []
    for f in sorted({f for _, f in targets}):
        if f:
            dealt = C.deal_folds(train.join(least.filter("_m >= 2"), ["_f", "label"]), F.greatest(F.lit(2), F.least(F.lit(f), F.col("_m"))),
                                 f"{seed}:calib", strata=["y"], subject="row_id", part=["_f", "label"], ties=["x_hash", "copy"])
            marked.append(dealt.select("_f", "label", *row, F.lit(f).alias("folds"), F.col("fold").alias("mark")))
    wide = wide_rows(rows, labels)
    if marked:
        every = marked[0]
        for m in marked[1:]:
            every = every.unionByName(m)
        marks = every.groupBy(F.col("_f").alias("fold"), *row).agg(F.map_from_entries(F.collect_list(
            F.struct(F.concat_ws(":", "label", "folds").alias("t"), "mark"))).alias("marks"))
        wide = wide.join(marks, ["fold", *row], "left")
    else:
        wide = wide.withColumn("marks", F.lit(None).cast("map<string,int>"))
    own = {label: F.col("y")[i] for i, label in enumerate(labels)}
    k = [F.when((F.col("part") != "train") | (own[label] < 0), _TEST)
         .otherwise(F.coalesce(F.col("marks")[f"{label}:{f}"], F.lit(_TRAIN))) for label, f in targets]
    wide = wide.select("fold", "part", row_key().alias("row_id"), "x", F.array(*[own[label] for label, _ in targets]).alias("y"), F.array(*k).alias("k"))
    scalers = sorted({s.scaler for s in specs})
    if len(scalers) > 1:
        ensure_checkpoint_dir(rows.sparkSession)
        wide = wide.checkpoint()  # read twice by every scaler
    parts = []
    for kind in scalers:
        scaled = wide if kind == "none" else P.apply_scaler(wide, P.fit_scaler(wide.filter(F.col("part") == "train"), kind, by=["fold"]), kind, by=["fold"])
        parts.append(scaled.select(F.concat_ws("|", F.lit(kind), F.col("fold").cast("string")).alias("design"), "row_id", "x", "y", "k"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    blocks = feature_blocks(every)
    designs = {r["design"]: r["design"].split("|")[0] for r in blocks.select("design").distinct().collect()}  # scalers × folds
    return blocks, designs


def linear_panel(rows: DataFrame, specs: Sequence[ModelSpec], labels: Sequence[str], seed: int = 42,
                 tol: float | None = None) -> tuple[DataFrame, LinearPanel]:
    """Fit and score every (configuration, fold, label):
    ``(scaler, model, fold, label, row_id, x_hash, p)``, and the fitted panel.
    Rows that share an id and ``x`` have one score."""
    blocks, designs = linear_blocks(rows, specs, labels, seed)
    panel = LinearPanel(blocks, specs, labels, designs, seed, tol)
    fold = dict(rows.dtypes)["fold"]
    return panel.scores(blocks).select(
        F.element_at(F.split("design", "\\|"), 1).alias("scaler"), "model",
        F.element_at(F.split("design", "\\|"), 2).cast(fold).alias("fold"), "label", "row_id", "x_hash", "p"), panel
