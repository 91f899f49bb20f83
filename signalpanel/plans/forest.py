"""Random forests and extra trees on binned blocks (M5, M6).

All trees of all (fold, label) groups grow together, level by level. A level is
one pass over blocks of binned features for as many trees as ``PASS_BYTES`` of
histograms allow: a block walks its rows down each tree, and adds the rows'
weights by (node, drawn feature, bin, class); the sums meet in Spark, and what
comes back is each node's best cut. No row is stored with its node or its
draws: both follow from the tree so far and from hashes. Where there are fewer
blocks than cores, each block is stored once for each share of the trees.

* bootstrap: a row is drawn into a tree 0, 1, 2, … times as a Poisson(1)
  variable of the hash of (row id, tree), rows that share an id together; extra
  trees take every row once;
* weights: balanced over the classes of the tree's own draws;
* features of a node: the first ``max_features`` in the order of the hashes of
  (tree, node, feature);
* cuts: at the edges of up to ``BINS`` quantile bins, the best by Gini gain;
  extra trees try one cut per feature, drawn between the smallest and largest
  bin that the node holds;
* ties go to the smaller feature, then the smaller bin.

The score of a row is the mean of its leaves' weighted shares of positives.
Groups with one class score constantly (M14).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .blocks import block_sums, feature_blocks, open_keys, row_key, wide_rows
from .models import ModelSpec

FAMILIES = ("random_forest", "extra_trees")
BINS = 32
#: Of a pass, at 8 bytes a number; tasks hold and send them in 4.
PASS_BYTES = 192 << 20
#: Of the trees whose sums meet under one key, unless it is one tree.
BUNDLE_BYTES = 4 << 20
#: Of a task, if there are more tasks than cores.
TASK_BLOCKS = 256
WIDE_ROWS = 1 << 16
MOST_DEPTH = 16
_PARAMS = {"n_estimators", "max_depth", "min_samples_leaf", "min_samples_split", "max_features", "class_weight"}
_ROW = 1 << 24  # of a row, in a sum of draws: a block has fewer
_POISSON = np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(12)])


def mix(*parts) -> np.ndarray:
    """A hash of integers (or arrays of them), element by element."""
    h = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for p in parts:
            h = (h ^ np.asarray(p, np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(31))
    return h


def uniform(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(float) / float(1 << 53)


def draws(rows: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often each row (its hash) is drawn into a tree."""
    return np.searchsorted(_POISSON, uniform(mix(rows, seed, tree)), "right")


def drawn_features(seed: int, tree: int, nodes: np.ndarray, d: int, take: int) -> np.ndarray:
    """The features that each node tries, in rising order."""
    h = mix(seed + 1, tree, nodes[:, None], np.arange(d)[None, :])
    return np.sort(np.argsort(h, axis=1, kind="stable")[:, :take], axis=1)


@dataclass(frozen=True)
class Forest:
    """The settings of a family."""
    trees: int
    depth: int
    leaf: int
    split: int
    take: str
    random_cuts: bool
    balanced: bool
    name: str

    @staticmethod
    def of(spec: ModelSpec) -> Forest:
        p, extra = spec.params, set(spec.params) - _PARAMS
        depth = p.get("max_depth", 10)
        if extra or depth is None or not 1 <= int(depth) <= MOST_DEPTH:
            raise ValueError(f"{spec.family} does not take {sorted(extra) or f'max_depth={depth}'}")
        return Forest(int(p.get("n_estimators", 100)), int(depth), int(p.get("min_samples_leaf", 1)), int(p.get("min_samples_split", 2)),
                      str(p.get("max_features", "sqrt")), spec.family == "extra_trees",
                      p.get("class_weight", "balanced") == "balanced", spec.name or spec.family)

    def taken(self, d: int) -> int:
        return {"sqrt": max(1, math.isqrt(d)), "log2": max(1, int(math.log2(d))), "all": d}[self.take]


class Tree:
    """Nodes by heap place (root 1, children 2i and 2i + 1): feature tried (−1: leaf), last bin of the left side, value."""

    def __init__(self, depth: int):
        self.feature = np.full(2 << depth, -1, np.int16)
        self.cut = np.zeros(2 << depth, np.uint8)
        self.value = np.zeros(2 << depth, np.float32)

    def top(self, levels: int) -> Tree:
        """What a walk over so many levels needs."""
        out = Tree.__new__(Tree)
        out.feature, out.cut = self.feature[:1 << levels], self.cut[:1 << levels]
        return out

    def walk(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """Place of each row after so many levels; rows in a leaf stay there."""
        at, flat, first = np.ones(len(bins), np.int64), bins.ravel(), np.arange(0, bins.size, max(1, bins.shape[1]))
        leaf = self.feature < 0
        feature, cut = np.where(leaf, 0, self.feature).astype(np.int64), np.where(leaf, 255, self.cut).astype(np.uint8)
        left = np.arange(len(leaf)) * np.where(leaf, 1, 2)  # no bin is above 255, so a row in a leaf takes no step to the right
        for _ in range(levels):
            at = left.take(at) + (flat.take(first + feature.take(at)) > cut.take(at))
        return at


def bin_edges(rows: DataFrame, bins: int = BINS) -> dict[str, list[np.ndarray]]:
    """Per design and feature the rising cuts between quantile bins of the
    train rows: designs × features × bins numbers."""
    cuts = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    q = (rows.filter("train").select("design", F.posexplode("x").alias("j", "v")).groupBy("design", "j")
         .agg(F.percentile_approx("v", cuts, 1000).alias("e")).collect())
    out: dict[str, dict[int, np.ndarray]] = {}
    for r in q:
        out.setdefault(r["design"], {})[r["j"]] = np.unique(np.array(r["e"], float))
    return {d: [e[j] for j in sorted(e)] for d, e in out.items()}


def binned_blocks(blocks: DataFrame, edges: dict[str, list[np.ndarray]], keyed: bool = False) -> DataFrame:
    """Blocks with their features as bins (``x``: bytes) and the hashes of the
    rows' ids, which are part of the rows' keys if ``keyed``."""
    shared = blocks.sparkSession.sparkContext.broadcast(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            bins, hashes = [], []
            for d, n, x, ids in zip(*(b.column(c).to_pylist() for c in ("design", "n", "x", "ids"))):
                x = np.frombuffer(x).reshape(n, -1)
                bins.append(np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(shared.value[d])], 1).astype(np.uint8).tobytes())
                hashes.append(np.array([xxhash.xxh64_intdigest(i) for i in (open_keys(ids)[-1] if keyed else ids)], np.uint64).tobytes())
            b = b.set_column(b.schema.get_field_index("x"), "x", pa.array(bins, pa.binary()))
            yield b.append_column("h", pa.array(hashes, pa.binary()))

    ensure_checkpoint_dir(blocks.sparkSession)
    kinds = ", ".join(f"{c} {k}" for c, k in blocks.dtypes)
    return blocks.mapInArrow(run, f"{kinds}, h binary").checkpoint()


def _shared_out(blocks: DataFrame) -> DataFrame:
    """Blocks with the ``share`` of the trees, of ``shares``, that they are read
    for: one, or as many as give every core a block. Many blocks are read in one
    task per core, or per ``TASK_BLOCKS``, for each task sends sums of all nodes,
    and are put together up to ``WIDE_ROWS`` rows, for each makes sums of all nodes."""
    n, cores = blocks.count(), blocks.sparkSession.sparkContext.defaultParallelism
    shares = max(1, -(-cores // max(1, n)))
    out = blocks.drop("ids").withColumns({"share": F.explode(F.sequence(F.lit(0), F.lit(shares - 1))), "shares": F.lit(shares)})
    if shares > 1:
        return out.repartition(n * shares).checkpoint()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def flush():
            row = {c: b"".join(h[c] for h in held) for c in ("x", "y", "k", "h")} | {"n": sum(h["n"] for h in held)}
            return pa.RecordBatch.from_pylist([held[0] | row], schema)

        for b in batches:
            schema = b.schema
            for row in b.to_pylist():
                if held and (row["design"] != held[0]["design"] or sum(h["n"] for h in held) + row["n"] > WIDE_ROWS):
                    yield flush()
                    held = []
                held.append(row)
        if held:
            yield flush()

    out = out.repartition(max(min(cores, n), -(-n // TASK_BLOCKS))).sortWithinPartitions("design")
    return out.mapInArrow(run, out.schema).checkpoint()


def _open(row: dict):
    n = row["n"]
    return (np.frombuffer(row["x"], np.uint8).reshape(n, -1), np.frombuffer(row["y"], np.int8).reshape(n, -1),
            np.frombuffer(row["k"], np.int8).reshape(n, -1), np.frombuffer(row["h"], np.uint64))


def _histograms(shared, bins: int):
    """Sums by (node, tried feature, bin): weight of each class, and rows."""
    def work(row: dict) -> Iterator[tuple[str, np.ndarray]]:
        x, y, k, h = _open(row)
        train: dict[int, tuple] = {}  # by label, its train rows
        held: tuple[str | None, list] = (None, [])
        for j in shared.value.get(row["design"], ()):
            if int(j["key"]) % row["shares"] != row["share"]:
                continue
            if j["label"] not in train:
                own = (k[:, j["label"]] == -1) & (y[:, j["label"]] >= 0)
                train = {j["label"]: (x[own], y[own, j["label"]], h[own])}
            xs, cls, hs = train[j["label"]]
            times = None
            if j["bootstrap"]:
                times = draws(hs, j["seed"], j["tree"])
                drawn = np.flatnonzero(times)
                xs, cls, times = xs[drawn], cls[drawn], times[drawn]
            at = j["grown"].walk(xs, j["level"])
            place = np.full(2 << j["level"], -1)
            place[j["nodes"]] = np.arange(len(j["nodes"]))
            place = place[at]
            ok = np.flatnonzero(place >= 0)
            place, xs, cls = place[ok], xs if len(ok) == len(xs) else xs[ok], cls[ok]
            m, take = j["features"].shape
            value = xs.ravel().take(np.arange(0, xs.size, xs.shape[1])[:, None] + j["features"][place])
            cell = ((place[:, None] * take + np.arange(take)) * bins + value) * 2 + cls[:, None]
            sums = np.empty((m, take, bins, 3), np.int32)
            if times is None:
                n = np.bincount(cell.ravel(), None, sums.size // 3 * 2).reshape(m, take, bins, 2)
                sums[..., :2] = n
            else:  # draws, and above them the rows
                n = np.bincount(cell.ravel(), np.repeat(times[ok] + float(_ROW), take), sums.size // 3 * 2).astype(np.int64).reshape(m, take, bins, 2)
                sums[..., :2] = n & (_ROW - 1)
                n >>= _ROW.bit_length() - 1
            np.add(n[..., 0], n[..., 1], out=sums[..., 2], casting="unsafe")
            if held[0] not in (None, j["key"]):
                yield held[0], np.concatenate(held[1])
                held = (None, [])
            held = (j["key"], [*held[1], sums.ravel()])
        if held[1]:
            yield held[0], np.concatenate(held[1])
    return work


def best_cuts(sums: np.ndarray, features: np.ndarray, weight: np.ndarray, leaf: int, split: int,
              cut_draw: np.ndarray | None) -> np.ndarray:
    """Per node: feature (−1: none), cut, the class weights left and right, and the rows left and right."""
    w = sums[..., :2] * weight
    left, rows = w.cumsum(2), sums[..., 2].cumsum(2)
    total, n = left[:, :, -1:], rows[:, :, -1:]
    right = total - left

    def impurity(s):
        whole = s.sum(-1)
        return 2.0 * s[..., 0] * s[..., 1] / np.maximum(whole, 1e-300)

    gain = impurity(total) - impurity(left) - impurity(right)
    fits = (rows >= max(leaf, 1)) & (n - rows >= max(leaf, 1)) & (n >= split)
    if cut_draw is not None:
        held = sums[..., 2] > 0
        low, high = held.argmax(2), held.shape[2] - 1 - held[:, :, ::-1].argmax(2)
        drawn = low + np.floor(cut_draw * (high - low)).astype(np.int64)
        fits &= np.arange(held.shape[2]) == drawn[:, :, None]
    gain = np.where(fits, np.round(gain / np.maximum(total.sum(-1), 1e-300), 12), -1.0)
    best = gain.reshape(len(gain), -1).argmax(1)
    q, cut = np.divmod(best, gain.shape[2])
    i = np.arange(len(gain))
    feature = np.where(gain[i, q, cut] > 0, features[i, q], -1)
    return np.column_stack([feature, cut, left[i, q, cut], right[i, q, cut], rows[i, q, cut], n[i, q, 0] - rows[i, q, cut]])


class ForestPanel:
    """Grown forests of every (settings, design, label)."""

    def __init__(self, blocks: DataFrame, forests: Sequence[Forest], labels: Sequence[str], designs: Sequence[str], seed: int = 42, bins: int = BINS):
        """``blocks``: binned, with one label column per label."""
        self.labels, self.bins, self.passes = list(labels), bins, 0
        spark = blocks.sparkSession
        shared_out = _shared_out(blocks)

        def class_counts(row: dict) -> dict[str, np.ndarray]:
            x, y, k, h = _open(row)
            out = {f"{row['design']}\x01d": np.array([float(x.shape[1]), 0.0, 1.0])}
            for f in forests:
                for label in range(len(labels)):
                    ok = (k[:, label] == -1) & (y[:, label] >= 0)
                    times = np.array([[(t * (y[ok, label] == c)).sum() for c in range(2)] for t in (
                        draws(h[ok], seed, tree) if not f.random_cuts else np.ones(int(ok.sum())) for tree in range(f.trees))], float)
                    out[f"{row['design']}\x01{f.name}\x01{label}"] = np.vstack([times, [[(y[ok, label] == c).sum() for c in range(2)]]]).ravel()
            return out

        counts = block_sums(blocks, class_counts)
        self.trees: dict[tuple, list[Tree]] = {}
        self.constants: dict[tuple, float] = {}
        growing: list[dict] = []
        for design in designs:
            d = int(round(counts[f"{design}\x01d"][0] / counts[f"{design}\x01d"][2]))
            for f in forests:
                for label in range(len(labels)):
                    n = counts[f"{design}\x01{f.name}\x01{label}"].reshape(-1, 2)
                    if min(n[-1]) == 0:
                        self.constants[f.name, design, label] = float(n[-1, 1] / n[-1].sum()) if n[-1].sum() else 0.0
                        continue
                    own = self.trees[f.name, design, label] = []
                    for t in range(f.trees):
                        tree = Tree(f.depth)
                        weight = n[t].sum() / (2.0 * np.maximum(n[t], 1e-300)) if f.balanced else np.ones(2)
                        tree.value[1] = weight[1] * n[t, 1] / max((weight * n[t]).sum(), 1e-300)
                        own.append(tree)
                        if min(n[t]) > 0:
                            growing.append({"forest": f, "design": design, "label": label, "tree": t, "grown": tree, "weight": weight,
                                            "d": d, "nodes": np.array([1]), "seed": seed, "bootstrap": not f.random_cuts})
        for level in range(max((f.depth for f in forests), default=0)):
            growing = [g for g in growing if len(g["nodes"]) and level < g["forest"].depth]
            for part in self._batches(growing):
                self._grow(spark, shared_out, part, level)

    def _batches(self, growing: list[dict]) -> Iterator[list[dict]]:
        part, size = [], 0
        for g in growing:
            own = len(g["nodes"]) * g["forest"].taken(g["d"]) * self.bins * 3 * 8
            if part and size + own > PASS_BYTES:
                yield part
                part, size = [], 0
            part.append(g)
            size += own
        if part:
            yield part

    def _grow(self, spark, blocks: DataFrame, part: list[dict], level: int) -> None:
        self.passes += 1
        plan: dict[str, list[dict]] = {}
        cuts: dict[str, list] = {}
        bundles: list[list[dict]] = []
        size = 0
        for g in part:
            own = len(g["nodes"]) * g["forest"].taken(g["d"]) * self.bins * 3 * 8
            if not bundles or size + own > BUNDLE_BYTES or any(g[c] != bundles[-1][-1][c] for c in ("forest", "design")):
                bundles.append([])
                size = 0
            bundles[-1].append(g)
            size += own
        for key, g in ((str(i), g) for i, bundle in enumerate(bundles) for g in bundle):
            f = g["forest"]
            features = drawn_features(g["seed"], g["tree"], g["nodes"], g["d"], f.taken(g["d"]))
            plan.setdefault(g["design"], []).append({
                "key": key, "label": g["label"], "tree": g["tree"], "seed": g["seed"], "bootstrap": g["bootstrap"], "grown": g["grown"].top(level),
                "level": level, "nodes": g["nodes"], "features": features})
            draw = uniform(mix(g["seed"] + 2, g["tree"], g["nodes"][:, None], features)) if f.random_cuts else None
            cuts.setdefault(key, []).append((features, np.repeat(g["weight"][None, None, None], len(features), 0), f.leaf, f.split, draw))
        shared, rules, bins = spark.sparkContext.broadcast(plan), spark.sparkContext.broadcast(cuts), self.bins

        def finish(key: str, total: np.ndarray) -> np.ndarray:
            features, weight, draw = (np.concatenate(v) if v[0] is not None else None for v in ([r[c] for r in rules.value[key]] for c in (0, 1, 4)))
            leaf, split = rules.value[key][0][2:4]
            return best_cuts(total.reshape(*features.shape, bins, 3), features, weight, leaf, split, draw).ravel()

        found = block_sums(blocks, _histograms(shared, bins), finish, np.int32)
        ends = {key: iter(np.split(found[key].reshape(-1, 8), np.cumsum([len(g["nodes"]) for g in bundle])[:-1]))
                for key, bundle in ((str(i), b) for i, b in enumerate(bundles))}
        for g, best in ((g, next(ends[str(i)])) for i, bundle in enumerate(bundles) for g in bundle):
            tree, nodes, f = g["grown"], g["nodes"], g["forest"]
            cutting = best[:, 0] >= 0
            at = nodes[cutting]
            tree.feature[at], tree.cut[at] = best[cutting, 0], best[cutting, 1]
            nexts = []
            for side, w, n in ((0, best[cutting, 2:4], best[cutting, 6]), (1, best[cutting, 4:6], best[cutting, 7])):
                child = 2 * at + side
                tree.value[child] = w[:, 1] / np.maximum(w.sum(1), 1e-300)
                nexts.append(child[(w > 0).all(1) & (n >= max(2 * f.leaf, 2, f.split))])  # a pure node is a leaf, and one of too few rows to cut
            g["nodes"] = np.sort(np.concatenate(nexts))
        shared.destroy()
        rules.destroy()

    def scores(self, blocks: DataFrame) -> DataFrame:
        """``(design, model, label, row_id, x_hash, p)`` of every row of the blocks, once for its copies."""
        plan: dict[str, list] = {}
        for (name, design, label), trees in self.trees.items():
            plan.setdefault(design, []).append((name, self.labels[label], trees))
        for (name, design, label), p in self.constants.items():
            plan.setdefault(design, []).append((name, self.labels[label], p))
        shared = blocks.sparkSession.sparkContext.broadcast(plan)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in b.to_pylist():
                    _, x_hash, copy, row_id = open_keys(row["ids"])
                    once = copy == 1
                    x, x_hash, row_id = _open(row)[0][once], pa.array(x_hash[once]), pa.array(row_id[once], pa.string())
                    for name, label, trees in shared.value.get(row["design"], ()):
                        if isinstance(trees, float):
                            p = np.full(len(x), trees)
                        else:
                            p = np.zeros(len(x))
                            for t in trees:
                                p += t.value[t.walk(x, int(len(t.value)).bit_length() - 2)]
                            p /= len(trees)
                        yield pa.RecordBatch.from_arrays(
                            [*[pa.repeat(v, len(x)) for v in (row["design"], name, label)], row_id, x_hash, pa.array(p)],
                            names=["design", "model", "label", "row_id", "x_hash", "p"])

        return blocks.mapInArrow(run, "design string, model string, label string, row_id string, x_hash long, p double")


def forest_panel(rows: DataFrame, specs: Sequence[ModelSpec], labels: Sequence[str], seed: int = 42, bins: int = BINS) -> tuple[DataFrame, ForestPanel]:
    """Grow and score every (settings, fold, label) of long rows ``(fold, part,
    label, y, row_id, x)``: ``(model, fold, label, row_id, x_hash, p)``, and the
    forests. Rows that share an id and ``x`` have one score."""
    wide = wide_rows(rows, labels).select(
        F.col("fold").cast("string").alias("design"), row_key().alias("row_id"), "x", (F.col("part") == "train").alias("train"), "y",
        F.array(*[F.when(F.col("part") == "train", -1).otherwise(-2) for _ in labels]).alias("k"))
    edges = bin_edges(wide, bins)
    blocks = binned_blocks(feature_blocks(wide), edges, keyed=True)
    panel = ForestPanel(blocks, [Forest.of(s) for s in specs], labels, sorted(edges), seed, bins)
    return panel.scores(blocks).withColumn("fold", F.col("design").cast(dict(rows.dtypes)["fold"])).drop("design"), panel
