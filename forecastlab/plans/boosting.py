"""Regularised boosted trees over histograms, for one or many models at once.

Rows are binned once and written as blocks of bins, targets and weights. Models grow ``RENEW`` trees at a time, from sums of gradients and curvature by (node,
feature, bin), which give the best split of each node. How follows from a model's counted rows:

* up to ``TASK_ROWS``: its rows are dealt to one task, which grows these trees; as many models grow side by side as there are tasks;
* more: a job a level over the blocks as they are read. Tasks add sums, Spark shuffles and adds those of all tasks. Margins are renewed every ``RENEW_LEVELS`` trees.

Only splits come back to the driver. A row has a whole-number slot (member, month, ...) and a model learns from a range of slots, so the models of
all members, or of all months before each month, grow together.

One more job over the blocks renews the margins that are carried in them and scores the holdout after each of the trees. A model goes on ``patience``
trees beyond its best one and keeps the trees up to that; what it grew beyond its end in a job is dropped. Nothing depends on executor storage:
blocks are in the shared folder.

A missing value (null or NaN) goes to the side where it gains more. Of equal gains the first feature and the lowest cut win. Rows without a
target, weight or slot take no part; a model without rows has no trees and predicts nothing.
"""

from __future__ import annotations

import math
import pickle
import random
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from forecastlab.session import discard, scratch_path, settle

MISSING = 255
BLOCK_ROWS = 16_384
HELD_MEMORY = 192 << 20  # bytes of histograms a task holds before it hands them on
RENEW = 32  # trees a job
RENEW_LEVELS = 4  # trees until margins are renewed, where a job grows a level: each job adds the trees since then
TASK_ROWS = 1 << 22  # of a model that one task grows: some 90 bytes a row
NO_GAIN = -1e300
LEAST_GAIN = 1e-6


@dataclass(frozen=True)
class Params:
    """How trees grow. ``quantile`` turns the squared loss into that quantile's; ``max_leaves`` counts for ``lossguide`` only, 0: no limit."""

    rounds: int = 1000
    patience: int = 20
    eta: float = 0.1
    depth: int = 6
    reg_lambda: float = 1.0
    reg_alpha: float = 0.0
    gamma: float = 0.0
    min_child: float = 1.0
    subsample: float = 1.0
    colsample: float = 1.0
    grow: str = "depthwise"
    max_leaves: int = 0
    quantile: float | None = None
    seed: int = 17


@dataclass(frozen=True)
class Job:
    """One model to fit: on training rows with ``low <= slot < high``; ``held`` is the range of slots of its holdout rows, the same if not given."""

    name: str
    params: Params = Params()
    low: int = -(1 << 40)
    high: int = 1 << 40
    held: tuple[int, int] | None = None

    def covers(self, slot: int, held: bool) -> bool:
        low, high = self.held if held and self.held is not None else (self.low, self.high)
        return low <= slot < high


@dataclass
class Tree:
    """Nodes by number, 0 the root; a node without a feature (-1) is a leaf."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [True])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    gain: list[float] = field(default_factory=lambda: [0.0])
    grad: list[float] = field(default_factory=lambda: [0.0])
    hess: list[float] = field(default_factory=lambda: [0.0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def add(self, grad: float, hess: float) -> int:
        for name, x in (("feature", -1), ("cut", 0), ("missing_left", True), ("left", -1), ("right", -1), ("gain", 0.0), ("grad", grad), ("hess", hess), ("value", 0.0)):
            getattr(self, name).append(x)
        return len(self.feature) - 1

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of every row of a matrix of bins."""
        return _Walk(self).leaf(bins)

    def depth(self) -> int:
        """Splits on the longest way to a leaf."""
        todo, most = [(0, 0)], 0
        while todo:
            node, depth = todo.pop()
            most = max(most, depth)
            if self.feature[node] >= 0:
                todo += [(self.left[node], depth + 1), (self.right[node], depth + 1)]
        return most

    def output(self, bins: np.ndarray) -> np.ndarray:
        return _Walk(self).output(bins)


class _Walk:
    """A tree's nodes as arrays, made once for all rows that go through it.

    ``shift`` turns the bin of missing values into the lowest one where these go left.
    """

    def __init__(self, tree: Tree):
        feature, number = np.array(tree.feature), np.arange(len(tree.feature))
        inner = feature >= 0
        self.column, self.shift = np.maximum(feature, 0), np.array(tree.missing_left).astype(np.uint8)
        self.limit = (np.where(inner, tree.cut, 0) + self.shift).astype(np.uint8)
        self.below = np.column_stack([np.where(inner, tree.left, number), np.where(inner, tree.right, number)]).reshape(-1)
        self.value, self.depth = np.array(tree.value), tree.depth()

    def leaf(self, bins: np.ndarray) -> np.ndarray:
        flat, start = bins.reshape(-1), np.arange(len(bins)) * bins.shape[1]
        node, at = np.zeros(len(bins), np.int64), np.empty(len(bins), np.int64)
        for _ in range(self.depth):
            np.take(self.column, node, out=at, mode="clip")
            at += start
            own = flat.take(at, mode="clip")
            own += self.shift.take(node, mode="clip")
            np.multiply(node, 2, out=at)
            at += own > self.limit.take(node, mode="clip")
            np.take(self.below, at, out=node, mode="clip")
        return node

    def output(self, bins: np.ndarray) -> np.ndarray:
        return self.value.take(self.leaf(bins))


@dataclass
class Boosted:
    """A fitted model. ``history`` has the holdout error after 0, 1, ... trees; ``best`` trees are kept."""

    name: str
    features: list[str]
    edges: list[np.ndarray]
    params: Params
    base: float | None = None
    trees: list[Tree] = field(default_factory=list)
    history: list[float] = field(default_factory=list)

    @property
    def n_trees(self) -> int:
        return len(self.trees)

    def margins(self, bins: np.ndarray, walks: Sequence[_Walk] | None = None) -> np.ndarray:
        total = np.full(len(bins), np.nan if self.base is None else self.base)
        for tree in self.trees if walks is None else walks:
            total += tree.output(bins)
        return total

    def threshold(self, feature: int, cut: int) -> float:
        """The largest number that goes left; infinite where only missing values go right."""
        return float(self.edges[feature][cut]) if cut < len(self.edges[feature]) else math.inf

    def splits(self) -> list[tuple]:
        """``(model, tree, node, feature, threshold, missing_left, gain, cover, left, right, value)``; null threshold in leaves."""
        rows = []
        for t, tree in enumerate(self.trees):
            reached, todo = [], [0]
            while todo:
                node = todo.pop()
                reached.append(node)
                if tree.feature[node] >= 0:
                    todo += [tree.right[node], tree.left[node]]
            for node in sorted(reached):
                f = tree.feature[node]
                inner = f >= 0
                rows.append((
                    self.name, t, node, self.features[f] if inner else None, self.threshold(f, tree.cut[node]) if inner else None,
                    bool(tree.missing_left[node]) if inner else None, float(tree.gain[node]), float(tree.hess[node]),
                    tree.left[node] if inner else None, tree.right[node] if inner else None, None if inner else float(tree.value[node]),
                ))
        return rows

    def importance(self) -> list[tuple[str, float]]:
        """Features with their mean gain per split, as shares of all; highest first, unused ones 0."""
        gains: dict[str, list[float]] = {f: [] for f in self.features}
        for _, _, _, feature, _, _, gain, *_ in self.splits():
            if feature is not None:
                gains[feature].append(gain)
        means = {f: sum(g) / len(g) if g else 0.0 for f, g in gains.items()}
        total = sum(means.values()) or 1.0
        return sorted(((f, m / total) for f, m in means.items()), key=lambda pair: (-pair[1], pair[0]))


SPLIT_SCHEMA = (
    "model string, tree int, node int, feature string, threshold double, missing_left boolean, gain double, cover double, left int, right int, value double"
)


def split_table(spark, models: Sequence[Boosted]) -> DataFrame:
    return spark.createDataFrame([row for m in models for row in m.splits()], SPLIT_SCHEMA)


def _number(name: str) -> Column:
    value = F.col(f"`{name}`").cast("double")
    return F.when(F.isnan(value), F.lit(None)).otherwise(value)


def bin_edges(rows: DataFrame, features: Sequence[str], max_bin: int = 64) -> list[np.ndarray]:
    """Cut points of every feature, fewer than ``max_bin``: all distinct values where these are few, else about equal shares of rows."""
    if not 2 <= max_bin <= MISSING - 1:
        raise ValueError(f"max_bin must be between 2 and {MISSING - 1}")
    points = F.array(*[F.lit(k / max_bin) for k in range(1, max_bin)])
    counts = rows.agg(*[F.approx_count_distinct(_number(f)) for f in features]).first()
    few = [i for i in range(len(features)) if counts[i] <= max_bin * 0.8]
    told = [F.collect_set(_number(f)) if i in few else F.percentile_approx(_number(f), points, 10_000) for i, f in enumerate(features)]
    first = rows.agg(*[c.alias(f"v{i}") for i, c in enumerate(told)]).first()
    edges = []
    for i in range(len(features)):
        values = sorted(set(first[f"v{i}"] or []))
        edges.append(np.array(values[:-1] if i in few and len(values) <= max_bin else values, np.float64))
    return edges


def bins_of(values: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """Bins of a matrix of numbers: how many cut points lie below, ``MISSING`` for NaN."""
    bins = np.empty(values.shape, np.uint8)
    for f, cuts in enumerate(edges):
        bins[:, f] = np.searchsorted(cuts, values[:, f], side="left")
    bins[np.isnan(values)] = MISSING
    return bins


#: Blocks are large rows: a task gets a few megabytes of them at a time, as it reads a group of rows whole.
SMALL_GROUPS = {"parquet.block.size": str(8 << 20), "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "4"}
BLOCK = "slot long, held boolean, n long, weight double, weighted_y double, bins binary, y binary, w binary"


def binned_blocks(
    rows: DataFrame, features: Sequence[str], target: str, edges: Sequence[np.ndarray], weight: str | None = None,
    slot: Column | None = None, held: Column | None = None,
) -> DataFrame:
    """Written blocks of rows with one slot and one purpose each; the order of rows in them is fixed from here on."""
    given = rows.select(
        (F.lit(0) if slot is None else slot).cast("long").alias("slot"),
        (F.lit(False) if held is None else held).alias("held"),
        F.col(target).cast("double").alias("y"),
        (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("w"),
        *[_number(f).alias(f"f{i}") for i, f in enumerate(features)],
    ).filter("slot IS NOT NULL AND held IS NOT NULL AND y IS NOT NULL AND w IS NOT NULL AND NOT isnan(y) AND NOT isnan(w) AND w > 0")
    n_features = len(features)
    names = [c.split()[0] for c in BLOCK.split(", ")]

    def row(key: tuple, parts: list[tuple]) -> pa.RecordBatch:
        bins, y, w = (np.concatenate([p[k] for p in parts]) for k in range(3))
        cells = [key[0], key[1], len(y), float(w.sum()), float((w * y).sum()), bins.tobytes(), y.tobytes(), w.tobytes()]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.record_batch([pa.array([c], k) for c, k in zip(cells, kinds)], names=names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[tuple, list[tuple]] = {}
        size: dict[tuple, int] = {}
        for batch in batches:
            numbers = np.column_stack([batch.column(4 + i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(n_features)])
            bins = bins_of(numbers, edges)
            y, w = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            slots, is_held = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for s, h in set(zip(slots.tolist(), is_held.tolist())):
                own = (slots == s) & (is_held == h)
                key = (s, h)
                open_.setdefault(key, []).append((bins[own], y[own], w[own]))
                size[key] = size.get(key, 0) + int(own.sum())
                if size[key] >= BLOCK_ROWS:
                    yield row(key, open_.pop(key))
                    size[key] = 0
        for key in list(open_):
            yield row(key, open_.pop(key))

    blocks = given.mapInArrow(work, BLOCK).withColumn("block", F.monotonically_increasing_id()).withColumn("margins", F.lit(b"").cast("binary"))
    return settle(blocks, "tree_blocks", **SMALL_GROUPS)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of batches, one at a time: a block is large, and a batch may have many."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


class _Block:
    """A block's arrays, and the margins of the models that cover it."""

    def __init__(self, row: dict, n_features: int):
        self.slot, self.held, self.number, self.n = row["slot"], row["held"], row["block"], row["n"]
        self.bins = np.frombuffer(row["bins"], np.uint8).reshape(self.n, n_features)
        self.y, self.w = np.frombuffer(row["y"], np.float64), np.frombuffer(row["w"], np.float64)
        self.stored = np.frombuffer(row["margins"], np.float64).reshape(-1, self.n)

    def covering(self, jobs: Sequence[Job]) -> list[int]:
        return [m for m, job in enumerate(jobs) if job.covers(self.slot, self.held)]

    def margins(self, models: Sequence[Boosted], model: int, place: int, since: int) -> np.ndarray:
        """Margins of one model: what is stored plus the trees after that; ``place`` is the model's row in the stored ones."""
        total = self.stored[place].copy() if len(self.stored) else np.full(self.n, models[model].base)
        for tree in models[model].trees[since:]:
            total += tree.output(self.bins)
        return total

    def drawn(self, params: Params, tree: int) -> np.ndarray | None:
        """Rows that a tree learns from; None: all."""
        return None if params.subsample >= 1 else _drawn(self.number, self.n, params, tree)


def _drawn(block: int, n: int, params: Params, tree: int) -> np.ndarray:
    """Which rows of a block a tree learns from, by a hash of row, tree and seed."""
    mixed = (np.uint64(block) << np.uint64(20)) + np.arange(n, dtype=np.uint64)
    mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + np.uint64((params.seed * 1_000_003 + tree) % (1 << 63))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    return (mixed >> np.uint64(11)).astype(np.float64) / float(1 << 53) < params.subsample


def _gradients(params: Params, y: np.ndarray, w: np.ndarray, margin: np.ndarray) -> np.ndarray:
    if params.quantile is None:
        return w * (margin - y)
    return w * np.where(y <= margin, 1.0 - params.quantile, -params.quantile)


def _loss(params: Params, y: np.ndarray, margin: np.ndarray) -> np.ndarray:
    if params.quantile is None:
        return (y - margin) ** 2
    return np.where(y >= margin, params.quantile, params.quantile - 1.0) * (y - margin)


@dataclass
class _Level:
    """What a job needs: the models so far, the trees being grown, their open nodes and columns."""

    jobs: list[Job]
    models: list[Boosted]
    since: int
    growing: dict[int, Tree]
    open_nodes: dict[int, list[int]]
    columns: dict[int, list[int]]
    n_bins: int
    n_features: int


HISTOGRAM = "model int, node int, feature int, grad array<double>, hess array<double>"


def _lists(matrix: np.ndarray) -> pa.ListArray:
    offsets = np.arange(0, matrix.size + 1, matrix.shape[1], dtype=np.int32) if matrix.size else np.zeros(1, np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(matrix.reshape(-1)))


def _histograms(level: _Level):
    """Sums by model, node, feature and bin of a task's blocks; the last bin is that of missing values."""

    def batch(model: int, nodes: list[int], columns: list[int], sums: np.ndarray) -> pa.RecordBatch:
        filled = np.flatnonzero(sums[1, :, 0].sum(axis=1) > 0)  # nodes with rows
        shape = (len(filled) * len(columns), level.n_bins)
        keys = [np.full(shape[0], model, np.int32), np.repeat(np.array(nodes, np.int32)[filled], len(columns)), np.tile(np.array(columns, np.int32), len(filled))]
        lists = [_lists(np.ascontiguousarray(sums[k][filled]).reshape(shape)) for k in (0, 1)]
        return pa.record_batch([*map(pa.array, keys), *lists], names=["model", "node", "feature", "grad", "hess"])

    def added(m: int, parts: list[tuple]) -> np.ndarray:
        """The sums of some blocks: (block, bins, y, w, margin, leaf)."""
        params, nodes, tree = level.jobs[m].params, level.open_nodes[m], level.growing[m]
        parts = sorted(parts, key=lambda part: part[0])
        rows = _Rows([part[:5] for part in parts], level.n_features)
        at = np.full(len(tree.feature), -1, np.int32)
        at[nodes] = np.arange(len(nodes))
        place = at[np.concatenate([part[5] for part in parts])]
        drawn = rows.drawn(params, len(level.models[m].trees))
        if drawn is not None:
            place[~drawn] = -1
        return rows.sums(place, len(nodes), level.columns[m], _gradients(params, rows.y, rows.w, rows.margin), level.n_bins)[:2]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        parts: dict[int, list[tuple]] = {}
        walks = {m: _Walk(level.growing[m]) for m in level.open_nodes}
        held = 0

        def add_up() -> None:
            for m in list(parts):
                told = added(m, parts.pop(m))
                sums[m] = sums[m] + told if m in sums else told

        for row in _each(batches):
            block = _Block(row, level.n_features)
            for place, m in enumerate(block.covering(level.jobs)):
                if m in level.open_nodes:
                    margin = block.margins(level.models, m, place, level.since)
                    parts.setdefault(m, []).append((block.number, block.bins, block.y, block.w, margin, walks[m].leaf(block.bins)))
                    held += block.n
            if held >= LEVEL_ROWS:
                held = 0
                add_up()
            if sum(s.nbytes for s in sums.values()) > HELD_MEMORY:
                for k in list(sums):
                    yield batch(k, level.open_nodes[k], level.columns[k], sums.pop(k))
        add_up()
        for k in list(sums):
            yield batch(k, level.open_nodes[k], level.columns[k], sums.pop(k))

    return work


def _score(grad, hess, reg_lambda, reg_alpha):
    """The gain of a leaf with these sums; the part of the gradient within ``reg_alpha`` of 0 doesn't count."""
    soft = np.abs(grad)
    soft -= reg_alpha
    np.maximum(soft, 0.0, out=soft)
    soft *= soft
    below = hess + reg_lambda
    empty = below <= 0
    if empty.any():
        below[empty], soft[empty] = 1.0, 0.0
    soft /= below
    return soft


BEST = "model int, node int, feature int, gain double, cut int, missing_left boolean, grad_left double, hess_left double, grad double, hess double"


CELLS = 4608  # of a code: two features of 66 bins, or more of fewer
LEVEL_ROWS = 1 << 19  # that are added up at once in a job a level
SMALL_NODE = 1024  # rows; fewer are not worth a code's cells
CUT_ROWS = 128  # histograms looked at together: their arrays stay in the processor's cache


def best_cuts(grad: np.ndarray, hess: np.ndarray, params: Sequence[Params]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each histogram (a row) the best cut: gain, last bin on the left, side of missing values, and the sums on the left."""
    told = {id(p): [p.reg_lambda, p.reg_alpha, p.min_child] for p in params}
    limits = np.array([told[id(p)] for p in params]).reshape(-1, 3)
    if len(told) > 1:
        parts = [_best_cuts(grad[k : k + CUT_ROWS], hess[k : k + CUT_ROWS], *limits[k : k + CUT_ROWS].T[:, :, None]) for k in range(0, len(grad), CUT_ROWS)]
    else:
        parts = [_best_cuts(grad[k : k + CUT_ROWS], hess[k : k + CUT_ROWS], *limits[0]) for k in range(0, len(grad), CUT_ROWS)]
    kinds = np.float64, np.int32, bool, np.float64, np.float64
    return tuple(np.concatenate([np.zeros(0, kind), *[part[k] for part in parts]]) for k, kind in enumerate(kinds))


def _best_cuts(grad: np.ndarray, hess: np.ndarray, lam, alpha, least) -> tuple[np.ndarray, ...]:
    gone_g, gone_h = grad[:, -1:], hess[:, -1:]
    run_g, run_h = np.cumsum(grad[:, :-1], axis=1), np.cumsum(hess[:, :-1], axis=1)  # the last cut parts all numbers from missing values
    total_g, total_h = grad.sum(axis=1)[:, None], hess.sum(axis=1)[:, None]
    whole = _score(total_g, total_h, lam, alpha)

    def gains(left_g: np.ndarray, left_h: np.ndarray, own, lam, alpha, least) -> np.ndarray:
        right_g, right_h = total_g[own] - left_g, total_h[own] - left_h
        gain = _score(left_g, left_h, lam, alpha)
        gain += _score(right_g, right_h, lam, alpha)
        gain -= whole[own]
        gain[(left_h < least) | (right_h < least) | (left_h <= 0) | (right_h <= 0)] = NO_GAIN
        return gain

    left_g, left_h = run_g + gone_g, run_h + gone_h  # missing left
    gain, rows = gains(left_g, left_h, slice(None), lam, alpha, least), np.arange(len(grad))
    cut, side = gain.argmax(axis=1), np.ones(len(grad), bool)
    best = gain[rows, cut], cut, side, left_g[rows, cut], left_h[rows, cut]
    some = np.flatnonzero((gone_h[:, 0] != 0) | (gone_g[:, 0] != 0))
    if len(some):  # missing right, which wins by more gain, or by the same one at a lower cut
        own = [x[some] if isinstance(x, np.ndarray) and x.ndim else x for x in (lam, alpha, least)]
        gain, at = gains(run_g[some], run_h[some], some, *own), np.arange(len(some))
        cut = gain.argmax(axis=1)
        found = gain[at, cut]
        better = (found > best[0][some]) | ((found == best[0][some]) & (cut < best[1][some]))
        won, at, cut = some[better], at[better], cut[better]
        for x, values in zip(best, (found[better], cut, False, run_g[won, cut], run_h[won, cut])):
            x[won] = values
    return best[0], best[1].astype(np.int32), best[2], best[3], best[4]


def _best_per_feature(jobs: Sequence[Job]):
    """Sums of equal keys in sorted histograms and the best cut of each; carries the last key on to the next batch."""

    def cells(columns: list) -> pa.RecordBatch:
        return pa.record_batch([pa.array(np.ascontiguousarray(c)) for c in columns], names=[c.split()[0] for c in BEST.split(", ")])

    def matrices(rows: pa.RecordBatch) -> list[np.ndarray]:
        return [rows.column(k).flatten().to_numpy().reshape(rows.num_rows, -1) for k in (3, 4)]

    def answer(keys: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> pa.RecordBatch:
        gain, cut, side, left_g, left_h = best_cuts(grad, hess, [jobs[m].params for m in keys[:, 0]])
        return cells([keys[:, 0], keys[:, 1], keys[:, 2], gain, cut, side, left_g, left_h, grad.sum(axis=1), hess.sum(axis=1)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None
        for rows in batches:
            if not rows.num_rows:
                continue
            keys = np.column_stack([rows.column(k).to_numpy() for k in range(3)]).astype(np.int32)
            grad, hess = matrices(rows)
            if carried is not None:
                keys, grad, hess = (np.concatenate([a, b]) for a, b in zip(carried, (keys, grad, hess)))
            first = np.flatnonzero(np.r_[True, (np.diff(keys, axis=0) != 0).any(axis=1)])
            keys, grad, hess = keys[first], np.add.reduceat(grad, first, axis=0), np.add.reduceat(hess, first, axis=0)
            carried = keys[-1:], grad[-1:], hess[-1:]
            if len(keys) > 1:
                yield answer(keys[:-1], grad[:-1], hess[:-1])
        if carried is not None:
            yield answer(*carried)

    return work


PICKED = (
    "max_by(struct(feature, gain, cut, missing_left, grad_left, hess_left, grad, hess), struct(gain, -feature AS first)) AS best"
)


def _run_level(blocks: DataFrame, level: _Level) -> dict[tuple[int, int], dict]:
    """The best split of every open node."""
    shared = blocks.sparkSession.sparkContext.broadcast(level)
    jobs = level.jobs
    told = blocks.filter(~F.col("held")).mapInArrow(lambda batches: _histograms(shared.value)(batches), StructType.fromDDL(HISTOGRAM))
    sums = told.repartition("model", "node", "feature").sortWithinPartitions("model", "node", "feature")
    cuts = sums.mapInArrow(lambda batches: _best_per_feature(jobs)(batches), StructType.fromDDL(BEST))
    rows = cuts.groupBy("model", "node").agg(F.expr(PICKED)).collect()
    shared.destroy()
    return {(r["model"], r["node"]): r["best"].asDict() for r in rows}


def _leaf_value(params: Params, grad: float, hess: float) -> float:
    soft = math.copysign(max(abs(grad) - params.reg_alpha, 0.0), grad)
    return -params.eta * soft / (hess + params.reg_lambda) if hess + params.reg_lambda > 0 else 0.0


def best_first(tree: Tree, max_leaves: int) -> None:
    """Keep the splits that growing the leaf of the highest gain first makes, up to ``max_leaves`` leaves.

    A node's best split does not depend on other nodes, so this choice among the splits of a whole tree is what such growth gives.
    """
    kept, open_ = set(), [0]
    while len(kept) + 1 < max_leaves:
        ready = [n for n in open_ if tree.feature[n] >= 0]
        if not ready:
            break
        node = max(ready, key=lambda n: (tree.gain[n], -n))
        kept.add(node)
        open_.remove(node)
        open_ += [tree.left[node], tree.right[node]]
    for node in range(len(tree.feature)):
        if node not in kept:
            tree.feature[node] = -1


SKETCH = "model int, leaf int, n long, ranks binary, numbers binary"
SKETCHED = 128  # of a leaf's residuals in a task


def _leaf_quantiles(blocks: DataFrame, jobs: list[Job], models: list[Boosted], since: int, trees: dict[int, Tree], n_features: int) -> dict[tuple[int, int], float]:
    """Exact quantiles of the residuals in every leaf, from two looks at the blocks, neither of which writes anything.

    Every task first tells some of its sorted residuals with their ranks. These leave a small range for the residuals on both sides of a quantile; the second
    look tells how many lie below it and which lie in it.
    """
    context = blocks.sparkSession.sparkContext
    shared = context.broadcast((jobs, models, since, trees))
    q = {m: jobs[m].params.quantile for m in trees}

    def residuals(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
        jobs, models, since, trees = shared.value
        walks, held = {m: _Walk(tree) for m, tree in trees.items()}, {}
        for row in _each(batches):
            block = _Block(row, n_features)
            for place, m in enumerate(block.covering(jobs)):
                if m in trees:
                    held.setdefault(m, []).append((walks[m].leaf(block.bins), block.y - block.margins(models, m, place, since)))
        for m in list(held):
            leaf, told = (np.concatenate(x) for x in zip(*held.pop(m)))
            order = np.lexsort((told, leaf))
            leaf, told = leaf[order], told[order]
            first = np.flatnonzero(np.r_[True, np.diff(leaf) != 0])
            for start, stop in zip(first, [*first[1:], len(leaf)]):
                yield m, int(leaf[start]), told[start:stop]

    def row(m: int, leaf: int, n: int, ranks: np.ndarray, numbers: np.ndarray) -> pa.RecordBatch:
        cells = zip((m, leaf, n, ranks.astype(np.int64).tobytes(), numbers.tobytes()), (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))
        return pa.record_batch([pa.array([c], k) for c, k in cells], names=[c.split()[0] for c in SKETCH.split(", ")])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m, leaf, told in residuals(batches):
            ranks = np.unique(np.linspace(0, len(told) - 1, SKETCHED + 1).astype(np.int64))
            yield row(m, leaf, len(told), ranks, told[ranks])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m, leaf, told in residuals(batches):
            low, high = ranges.value[m, leaf]
            a, b = np.searchsorted(told, low, "left"), np.searchsorted(told, high, "right")
            numbers, counts = np.unique(told[a:b], return_counts=True)
            yield row(m, leaf, a, counts, numbers)

    def collected(work) -> dict[tuple[int, int], list[tuple]]:
        found: dict[tuple[int, int], list[tuple]] = {}
        for r in blocks.filter(~F.col("held")).mapInArrow(work, SKETCH).collect():
            found.setdefault((r["model"], r["leaf"]), []).append((r["n"], np.frombuffer(r["ranks"], np.int64), np.frombuffer(r["numbers"])))
        return found

    told, wanted, bounds = collected(sketch), {}, {}
    for key, parts in told.items():
        at = (sum(n for n, _, _ in parts) - 1) * q[key[0]]
        wanted[key] = at
        tried = np.unique(np.concatenate([numbers for _, _, numbers in parts]))
        below, upto = np.zeros(len(tried), np.int64), np.zeros(len(tried), np.int64)  # most residuals that are less, fewest that are not more
        for n, ranks, numbers in parts:
            below += np.r_[ranks, n][np.searchsorted(numbers, tried, "left")]
            upto += np.r_[0, ranks + 1][np.searchsorted(numbers, tried, "right")]
        bounds[key] = float(tried[np.flatnonzero(below <= math.floor(at))[-1]]), float(tried[np.flatnonzero(upto > math.ceil(at))[0]])
    ranges = context.broadcast(bounds)
    found = {}
    for key, parts in collected(within).items():
        numbers, counts = (np.concatenate([part[k] for part in parts]) for k in (2, 1))
        order = np.argsort(numbers, kind="stable")
        upto = sum(n for n, _, _ in parts) + np.cumsum(counts[order])
        low, high = (float(numbers[order][np.searchsorted(upto, rank, "right")]) for rank in (math.floor(wanted[key]), math.ceil(wanted[key])))
        found[key] = low + (high - low) * (wanted[key] - math.floor(wanted[key]))
    for x in (shared, ranges):
        x.destroy()
    return found


class _Rows:
    """A task's rows of one model. Features are packed into few codes: a code has up to ``CELLS`` values, one for each way the bins of its features go together.

    A code is counted in one pass, and the sums of each of its features are sums over the others. A feature has as many bins as occur here, the last one for
    missing values where there are any.
    """

    def __init__(self, parts: list[tuple], n_features: int):
        """``parts``: (block, bins, y, w, margin)."""
        parts = sorted(parts, key=lambda part: part[0])
        self.n_features, self.sizes = n_features, [(part[0], len(part[2])) for part in parts]
        most, self.gaps = np.zeros(n_features, np.int64), np.zeros(n_features, bool)
        for part in parts:
            gone = part[1] == MISSING
            self.gaps |= gone.any(axis=0)
            most = np.maximum(most, np.where(gone, 0, part[1]).max(axis=0, initial=0))
        self.numbers = most + 1
        self.widths = self.numbers + self.gaps
        self.bundles = _bundles(self.widths.tolist())
        self.place = {f: (b, a) for b, own in enumerate(self.bundles) for a, f in enumerate(own)}
        self.shapes = [tuple(int(self.widths[f]) for f in own) for own in self.bundles]
        self.codes = [np.empty(sum(n for _, n in self.sizes), np.uint16) for _ in self.bundles]
        start = 0
        for part in parts:
            columns = np.ascontiguousarray(part[1].T)
            for code, own in zip(self.codes, self.bundles):
                packed = code[start : start + columns.shape[1]]
                packed[:] = 0
                for f in own:
                    packed *= np.uint16(self.widths[f])
                    packed += np.where(columns[f] == MISSING, self.numbers[f], columns[f]).astype(np.uint16) if self.gaps[f] else columns[f]
            start += columns.shape[1]
        self.y, self.w, self.margin = (np.concatenate([np.zeros(0), *[part[k] for part in parts]]) for k in (2, 3, 4))
        self.plain = bool((self.w == 1.0).all())
        # Sums of whole numbers are exact: what is left of such a sum is 0 without rows, so rows need not be counted beside it.
        self.counted = not self.plain and not (bool((self.w == np.floor(self.w)).all()) and float(self.w.sum()) < 2.0**53)
        self.root = None

    def drawn(self, params: Params, tree: int) -> np.ndarray | None:
        return None if params.subsample >= 1 else np.concatenate([np.zeros(0, bool), *[_drawn(block, n, params, tree) for block, n in self.sizes]])

    def bins(self, code: np.ndarray, feature: int) -> np.ndarray:
        """The bins of one feature in values of its code."""
        b, axis = self.place[feature]
        below = math.prod(self.shapes[b][axis + 1 :])
        code = code // np.uint16(below) if below > 1 else code
        return code % np.uint16(self.widths[feature]) if axis else code

    def _weights(self, rows: np.ndarray | None, grad: np.ndarray | None) -> dict[int, np.ndarray | None]:
        """What is added up, by its place in the sums: gradient (if given), curvature, and a row count where curvature doesn't tell if there are rows."""
        given = {**({} if grad is None else {0: grad}), 1: None if self.plain else self.w, **({2: None} if self.counted else {})}
        return {i: x if x is None or rows is None else x.take(rows) for i, x in given.items()}

    def _fill(self, total: np.ndarray, feature: int, sums: np.ndarray) -> None:
        """Put the sums of the bins that occur where all bins have their places."""
        numbers = self.numbers[feature]
        total[..., :numbers] = sums[..., :numbers]
        if self.gaps[feature]:
            total[..., -1] = sums[..., numbers]

    def _asked(self, columns: list[int]) -> dict[int, list[tuple[int, int]]]:
        asked: dict[int, list[tuple[int, int]]] = {}
        for k, f in enumerate(columns):
            asked.setdefault(self.place[f][0], []).append((k, f))
        return asked

    def _of_node(self, total: np.ndarray, rows: np.ndarray | None, weights: dict[int, np.ndarray | None], columns: list[int]) -> None:
        """The sums of one node's rows (None: all)."""
        for b, own in self._asked(columns).items():
            code, shape = self.codes[b] if rows is None else self.codes[b].take(rows), self.shapes[b]
            code = code.astype(np.int64)
            for i, weight in weights.items():
                cells = np.bincount(code, weight, math.prod(shape)).reshape(shape)
                for k, f in own:
                    axis = self.place[f][1]
                    self._fill(total[i, k], f, cells.sum(axis=tuple(a for a in range(len(shape)) if a != axis)) if len(shape) > 1 else cells)

    def _of_small(self, total: np.ndarray, nodes: list[int], rows: list[np.ndarray], columns: list[int], grad: np.ndarray) -> None:
        """Nodes with few rows, together and feature by feature."""
        number, at = np.repeat(np.arange(len(nodes)), [len(r) for r in rows]), np.concatenate(rows)
        weights = self._weights(at, grad)
        for b, own in self._asked(columns).items():
            code = self.codes[b].take(at)
            for k, f in own:
                width = int(self.widths[f])
                cell = number * width + self.bins(code, f)
                for i, weight in weights.items():
                    part = np.zeros((len(nodes), total.shape[3]))
                    self._fill(part, f, np.bincount(cell, weight, len(nodes) * width).reshape(len(nodes), width))
                    total[i, nodes, k] = part

    def sums(self, place: np.ndarray, nodes: int, columns: list[int], grad: np.ndarray, n_bins: int, held: list[np.ndarray | None] | None = None) -> np.ndarray:
        """Gradient, curvature and what is above 0 where there are rows, by node, feature and bin. ``place`` is a row's node, -1 for rows that take no part;
        ``held`` has the numbers of each node's rows where these are known, None: all rows."""
        if held is None:
            place = place.astype(np.int16) if nodes < 1 << 15 else place  # short numbers are sorted by their digits
            order = np.argsort(place, kind="stable")
            held = np.split(order, np.searchsorted(place[order], np.arange(nodes + 1)))[1:-1]
        total = np.zeros((3, nodes, len(columns), n_bins))
        small = [k for k, rows in enumerate(held) if rows is not None and len(rows) < SMALL_NODE]
        for k, rows in enumerate(held):
            if rows is None:
                if self.root is None:  # all but the gradient stays the same from tree to tree
                    self.root = np.zeros((3, self.n_features, n_bins))
                    self._of_node(self.root, None, self._weights(None, None), list(range(self.n_features)))
                self._of_node(total[:, k], None, {0: grad}, columns)
                total[1:, k] = self.root[1:, columns]
            elif len(rows) >= SMALL_NODE:
                self._of_node(total[:, k], rows, self._weights(rows, grad), columns)
        if small:
            self._of_small(total, small, [held[k] for k in small], columns, grad)
        if not self.counted:
            total[2] = total[1]
        return total

    def sums_below(
        self, place: np.ndarray, above: np.ndarray, columns: list[int], grad: np.ndarray, n_bins: int, held: list[np.ndarray] | None = None
    ) -> np.ndarray:
        """The same for both nodes below each node of ``above``, side by side: the one with fewer rows is added up, the other is what is left of the sums above.

        A bin without rows has the sum 0, and not what rounding leaves.
        """
        pairs = above.shape[1]
        size = (np.bincount(place[place >= 0], minlength=2 * pairs) if held is None else np.array([len(rows) for rows in held])).reshape(pairs, 2)
        small = 2 * np.arange(pairs) + (size[:, 1] < size[:, 0])
        order = np.full(2 * pairs + 1, -1, np.int32)
        order[small] = np.arange(pairs)
        few = self.sums(order[place], pairs, columns, grad, n_bins, None if held is None else [held[k] for k in small])  # place -1 is the last entry
        rest = above - few
        rest *= rest[2] > 0
        total = np.empty((3, 2 * pairs, *above.shape[2:]))
        total[:, small], total[:, small ^ 1] = few, rest
        return total

    def parted(self, rows: np.ndarray | None, tree: Tree, node: int) -> tuple[np.ndarray, np.ndarray]:
        """A split node's rows that go left and right."""
        feature = tree.feature[node]
        code = self.codes[self.place[feature][0]]
        own = self.bins(code if rows is None else code.take(rows), feature)
        left = own <= tree.cut[node]
        if self.gaps[feature]:
            left[own == self.numbers[feature]] = tree.missing_left[node]
        sides = np.flatnonzero(left), np.flatnonzero(~left)
        return sides if rows is None else (rows.take(sides[0]), rows.take(sides[1]))


def _bundles(widths: list[int]) -> list[list[int]]:
    """Features that share a code: widest first, each into the first code that has room."""
    bundles: list[list[int]] = []
    size: list[int] = []
    for f in sorted(range(len(widths)), key=lambda f: (-widths[f], f)):
        k = next((k for k, n in enumerate(size) if n * widths[f] <= CELLS), None)
        if k is None:
            bundles.append([f])
            size.append(widths[f])
        else:
            bundles[k].append(f)
            size[k] *= widths[f]
    return bundles


def _best_splits(sums: np.ndarray, nodes: list[int], columns: list[int], params: Params) -> dict[tuple[int, int], dict]:
    """The best split of every node with rows, under the model's number 0."""
    filled = np.flatnonzero(sums[2, :, 0].sum(axis=1) > 0)
    grad, hess = (sums[k][filled].reshape(-1, sums.shape[3]) for k in (0, 1))
    gain, cut, side, grad_left, hess_left = (x.reshape(len(filled), -1) for x in best_cuts(grad, hess, [params] * len(grad)))
    grad, hess = (x.sum(axis=1).reshape(len(filled), -1) for x in (grad, hess))
    found = {}
    for i, k in enumerate(gain.argmax(axis=1).tolist() if len(filled) else []):
        found[0, nodes[filled[i]]] = {
            "feature": columns[k], "gain": float(gain[i, k]), "cut": int(cut[i, k]), "missing_left": bool(side[i, k]),
            "grad_left": float(grad_left[i, k]), "hess_left": float(hess_left[i, k]), "grad": float(grad[i, k]), "hess": float(hess[i, k]),
        }
    return found


def _grown_here(params: Params, first: int, count: int, rows: _Rows, n_bins: int) -> list[Tree]:
    """The trees ``first``, ``first + 1``, ... of one model; fewer than ``count`` if one has no split and none can come."""
    trees, job = [], [Job("", params)]
    for t in range(first, first + count):
        tree, columns = Tree(), _columns(params, t, rows.n_features)
        drawn, grad = rows.drawn(params, t), _gradients(params, rows.y, rows.w, rows.margin)
        # A node's rows: those it learns from, and those that only go through it.
        held = {0: [None] if drawn is None else [np.flatnonzero(drawn), np.flatnonzero(~drawn)]}
        place = np.zeros(len(rows.y), np.int32) if drawn is None else np.where(drawn, np.int32(0), np.int32(-1))
        open_, depth, sums = [0], 0, rows.sums(place, 1, columns, grad, n_bins, [held[0][0]])
        while open_:
            below = _apply(_best_splits(sums, open_, columns, params), job, {0: tree}, depth).get(0, [])
            for n in open_:
                if tree.feature[n] >= 0:
                    sides = [rows.parted(part, tree, n) for part in held.pop(n)]
                    held[tree.left[n]], held[tree.right[n]] = ([side[k] for side in sides] for k in (0, 1))
            if below:  # the nodes that were split, in the order of those below
                place[:] = -1
                for k, n in enumerate(below):
                    place[held[n][0]] = k
                above = sums[:, [k for k, n in enumerate(open_) if tree.feature[n] >= 0]]
                sums = rows.sums_below(place, above, columns, grad, n_bins, [held[n][0] for n in below])
            open_, depth = below, depth + 1
        if params.grow == "lossguide" and params.max_leaves:
            best_first(tree, params.max_leaves)
        leaves: dict[int, list] = {}
        kept = _leaf_above(tree)
        for n, parts in held.items():
            leaves.setdefault(kept[n], []).extend(parts)
        told = {}
        if params.quantile is not None:
            residual = rows.y - rows.margin
            for n, parts in leaves.items():
                own = residual if parts[0] is None else residual.take(np.concatenate(parts))
                if len(own):
                    told[n] = float(np.quantile(own, params.quantile))
        _set_leaves(tree, params, told)
        if _stuck(tree, params):
            break
        for n, parts in leaves.items():
            for part in parts:
                rows.margin[slice(None) if part is None else part] += tree.value[n]
        trees.append(tree)
    return trees


def _leaf_above(tree: Tree) -> list[int]:
    """The leaf of each node: itself, or the first node without a split on the way down to it."""
    kept = list(range(len(tree.feature)))
    for node in range(len(tree.feature)):  # nodes come after the ones above them
        for below in (tree.left[node], tree.right[node]):
            if below >= 0 and (kept[node] != node or tree.feature[node] < 0):
                kept[below] = kept[node]
    return kept


def _set_leaves(tree: Tree, params: Params, quantiles: dict[int, float]) -> None:
    for node, f in enumerate(tree.feature):
        if f < 0:
            tree.value[node] = _leaf_value(params, tree.grad[node], tree.hess[node]) if params.quantile is None else params.eta * quantiles.get(node, 0.0)


def _stuck(tree: Tree, params: Params) -> bool:
    """A tree without a split changes nothing, and comes again where nothing is drawn at random: such a model is done."""
    return tree.feature[0] < 0 and params.subsample >= 1 and params.colsample >= 1


DEALT = "place int, block long, n long, bins binary, y binary, w binary, margin binary"
GROWN = "model int, trees binary"


def _grow_by_model(
    blocks: DataFrame, jobs: list[Job], models: list[Boosted], counts: dict[int, int], rows: dict[int, int], done: int, n_bins: int, n_features: int
) -> dict[int, list[Tree]]:
    """Trees of models that fit a task, a task for each; the largest start first."""
    bases = [m.base for m in models]
    order = sorted(counts, key=lambda m: (-rows[m] * counts[m] * jobs[m].params.depth, m))
    place_of = {m: k for k, m in enumerate(order)}
    names = [c.split()[0] for c in DEALT.split(", ")]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            block = _Block(row, n_features)
            for place, m in enumerate(block.covering(jobs)):
                if m in counts:
                    margin = block.stored[place] if len(block.stored) else np.full(block.n, bases[m])
                    cells = place_of[m], block.number, block.n, row["bins"], row["y"], row["w"], margin.tobytes()
                    kinds = pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4
                    yield pa.record_batch([pa.array([c], k) for c, k in zip(cells, kinds)], names=names)

    def grow_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, place = [], None
        for r in _each(batches):
            place = r["place"]
            parts.append((r["block"], np.frombuffer(r["bins"], np.uint8).reshape(r["n"], n_features), *[np.frombuffer(r[k]) for k in ("y", "w", "margin")]))
        if place is None:
            return
        own = _Rows(parts, n_features)
        parts.clear()
        m = order[place]
        trees = _grown_here(jobs[m].params, done, counts[m], own, n_bins)
        yield pa.record_batch([pa.array([m], pa.int32()), pa.array([pickle.dumps(trees)], pa.binary())], names=["model", "trees"])

    dealt = blocks.filter(~F.col("held")).mapInArrow(deal, DEALT)
    found = dealt.repartitionById(len(order), F.col("place")).mapInArrow(grow_one, GROWN).collect()
    return {r["model"]: pickle.loads(r["trees"]) for r in found}


def _grow_by_level(blocks: DataFrame, jobs: list[Job], models: list[Boosted], counts: dict[int, int], done: int, n_bins: int, n_features: int) -> dict[int, list[Tree]]:
    """Trees of models with many rows: a job a level."""
    models = [replace(model, trees=list(model.trees)) for model in models]
    grown: dict[int, list[Tree]] = {m: [] for m in counts}
    active = set(counts)
    for t in range(max(counts.values())):
        growing = {m: Tree() for m in sorted(active) if t < counts[m]}
        columns = {m: _columns(jobs[m].params, done + t, n_features) for m in growing}
        frontier, depth = {m: [0] for m in growing}, 0
        while frontier:
            splits = _run_level(blocks, _Level(jobs, models, done, growing, frontier, columns, n_bins, n_features))
            frontier, depth = _apply(splits, jobs, growing, depth), depth + 1
        for m, tree in growing.items():
            if jobs[m].params.grow == "lossguide" and jobs[m].params.max_leaves:
                best_first(tree, jobs[m].params.max_leaves)
        sharp = {m: tree for m, tree in growing.items() if jobs[m].params.quantile is not None}
        leaves = _leaf_quantiles(blocks, jobs, models, done, sharp, n_features) if sharp else {}
        for m, tree in growing.items():
            _set_leaves(tree, jobs[m].params, {node: v for (k, node), v in leaves.items() if k == m})
            if _stuck(tree, jobs[m].params):
                active.discard(m)
            else:
                models[m].trees.append(tree)
                grown[m].append(tree)
    return grown


def _grow_some(blocks: DataFrame, jobs: list[Job], models: list[Boosted], counts: dict[int, int], rows: dict[int, int], done: int, n_bins: int, n_features: int) -> dict[int, list[Tree]]:
    """The next ``counts[m]`` trees of each model ``m``."""
    few = {m: n for m, n in counts.items() if rows[m] <= TASK_ROWS}
    many = {m: n for m, n in counts.items() if m not in few}
    grown = _grow_by_model(blocks, jobs, models, few, rows, done, n_bins, n_features) if few else {}
    return grown | _grow_by_level(blocks, jobs, models, many, done, n_bins, n_features) if many else grown


def _renewed(
    blocks: DataFrame, jobs: list[Job], models: list[Boosted], grown: dict[int, list[Tree]], score: list[int], n_features: int
) -> tuple[DataFrame, dict[tuple[int, int], float], str]:
    """The blocks with the margins of the trees grown last, the holdout errors after 0, 1, ... of these, and where the blocks are."""
    shared = blocks.sparkSession.sparkContext.broadcast((jobs, [m.base for m in models], grown, set(score)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        jobs, bases, grown, score = shared.value
        walks = {m: [_Walk(tree) for tree in trees] for m, trees in grown.items()}
        kind = pa.list_(pa.struct([("model", pa.int32()), ("tree", pa.int32()), ("error", pa.float64()), ("weight", pa.float64())]))
        for rows in batches:
            for k in range(rows.num_rows):
                given = rows.slice(k, 1)
                block = _Block(given.to_pylist()[0], n_features)
                covering, told, weight = block.covering(jobs), [], float(block.w.sum())
                margins = block.stored.copy() if len(block.stored) else np.empty((len(covering), block.n))
                for place, m in enumerate(covering):
                    margin = margins[place]
                    if not len(block.stored):
                        margin[:] = bases[m] if bases[m] is not None else np.nan
                    for t, walk in enumerate([*walks.get(m, []), None] if m in walks or m in score else []):
                        if block.held and m in score:
                            told.append((m, t, float((block.w * _loss(jobs[m].params, block.y, margin)).sum()), weight))
                        if walk is not None:
                            margin += walk.output(block.bins)
                out = given.set_column(given.schema.get_field_index("margins"), "margins", pa.array([margins.tobytes()], pa.binary()))
                yield out.append_column("errors", pa.array([[dict(zip(("model", "tree", "error", "weight"), e)) for e in told]], kind))

    path = scratch_path(blocks.sparkSession, "tree_blocks")
    schema = StructType([*blocks.schema.fields, *StructType.fromDDL("errors array<struct<model:int,tree:int,error:double,weight:double>>").fields])
    blocks.mapInArrow(work, schema).write.options(**SMALL_GROUPS).parquet(path)
    shared.destroy()
    errors = {}
    if score:
        told = blocks.sparkSession.read.schema(schema).parquet(path).filter("held").select(F.inline("errors"))
        told = told.groupBy("model", "tree").agg(F.expr("sum(error) / sum(weight) AS error")).collect()
        errors = {(r["model"], r["tree"]): r["error"] for r in told}
    return blocks.sparkSession.read.schema(blocks.schema).parquet(path), errors, path


def fit_blocks(
    blocks: DataFrame, features: Sequence[str], edges: Sequence[np.ndarray], jobs: Sequence[Job], prune_after: int | None = None
) -> list[Boosted]:
    """All models, grown some trees at a time together.

    ``prune_after``: from that many trees on, a model whose best holdout error is worse than the median of the others' errors at the same number of trees ends,
    as a study of many trials does.
    """
    jobs, n_features = list(jobs), len(features)
    models = [Boosted(j.name, list(features), list(edges), j.params) for j in jobs]
    sums = blocks.groupBy("slot", "held").agg(F.sum("weight").alias("w"), F.sum("weighted_y").alias("wy"), F.sum("n").alias("n")).collect()
    scored, rows = set(), {}
    for m, job in enumerate(jobs):
        own = [r for r in sums if not r["held"] and job.covers(r["slot"], False)]
        weight, rows[m] = sum(r["w"] for r in own), sum(r["n"] for r in own)
        models[m].base = sum(r["wy"] for r in own) / weight if weight > 0 else None
        if any(r["held"] and job.covers(r["slot"], True) for r in sums):
            scored.add(m)
    # Models without rows keep their places, since margins are stored by place.
    active = [m for m in range(len(jobs)) if models[m].base is not None]
    blank = replace(Params(), rounds=0)
    run_jobs = [j if models[m].base is not None else Job(j.name, blank, 0, 0, (0, 0)) for m, j in enumerate(jobs)]
    quantiles = [m for m in active if jobs[m].params.quantile is not None]
    if quantiles:
        for m in quantiles:
            models[m].base = 0.0
        roots = _leaf_quantiles(blocks, run_jobs, models, 0, {m: Tree() for m in quantiles}, n_features)
        for m in quantiles:
            models[m].base = roots[m, 0]
    n_bins = max((len(e) for e in edges), default=0) + 2
    done, made = 0, None
    while active:
        renew = min(RENEW, RENEW_LEVELS) if any(rows[m] > TASK_ROWS for m in active) else RENEW
        counts = {m: min(renew, jobs[m].params.rounds - done) for m in active if jobs[m].params.rounds > done}
        grown = _grow_some(blocks, run_jobs, models, counts, rows, done, n_bins, n_features) if counts else {}
        score, errors = [m for m in active if m in scored], {}
        if score or any(jobs[m].params.rounds > done + renew for m in counts):
            blocks, errors, path = _renewed(blocks, run_jobs, models, grown, score, n_features)
            if made is not None:
                discard(blocks.sparkSession, made)  # nobody reads it again
            made = path
        for t in range(renew):
            growing = [m for m in active if jobs[m].params.rounds > done]
            score = [m for m in active if m in scored]
            for m in score:
                error = errors[m, t]
                models[m].history.append(math.sqrt(error) if jobs[m].params.quantile is None else error)
            ended = _ended(models, jobs, score, prune_after)
            stuck = {m for m in growing if len(grown[m]) <= t}
            for m in growing:
                if m not in ended and m not in stuck:
                    models[m].trees.append(grown[m][t])
            active = [m for m in active if m in growing and m not in ended and m not in stuck and (m in scored or jobs[m].params.rounds > done + 1)]
            done += 1
            if not active:
                break
    if made is not None:
        discard(blocks.sparkSession, made)
    for m in scored:
        if models[m].history:
            models[m].trees = models[m].trees[: int(np.argmin(models[m].history))]
    return models


def _columns(params: Params, tree: int, n_features: int) -> list[int]:
    """The features of a tree: all, or a share of them drawn by seed and tree."""
    if params.colsample >= 1:
        return list(range(n_features))
    count = max(1, round(params.colsample * n_features))
    return sorted(random.Random(f"{params.seed}/{tree}").sample(range(n_features), count))


def _apply(splits: dict[tuple[int, int], dict], jobs: Sequence[Job], growing: dict[int, Tree], depth: int) -> dict[int, list[int]]:
    """Split the open nodes that gain enough; returns the nodes that may split at the next level."""
    frontier: dict[int, list[int]] = {}
    for (m, node), best in sorted(splits.items()):
        tree, params = growing[m], jobs[m].params
        if node == 0:
            tree.grad[0], tree.hess[0] = best["grad"], best["hess"]
        if depth >= params.depth or best["gain"] <= LEAST_GAIN or best["gain"] < params.gamma:
            continue
        tree.feature[node], tree.cut[node], tree.missing_left[node], tree.gain[node] = best["feature"], best["cut"], best["missing_left"], best["gain"]
        tree.left[node] = tree.add(best["grad_left"], best["hess_left"])
        tree.right[node] = tree.add(best["grad"] - best["grad_left"], best["hess"] - best["hess_left"])
        if depth + 1 < params.depth:
            frontier.setdefault(m, []).extend([tree.left[node], tree.right[node]])
    return frontier


def _ended(models: Sequence[Boosted], jobs: Sequence[Job], score: Sequence[int], prune_after: int | None) -> set[int]:
    """Scored models that have all their trees, ran out of patience, or fell behind the others."""
    ended = set()
    for m in score:
        history, params = models[m].history, jobs[m].params
        trees = len(history) - 1
        if trees >= params.rounds or trees - int(np.argmin(history)) >= params.patience:
            ended.add(m)
        elif prune_after is not None and trees >= prune_after:
            others = [models[k].history[trees] for k in range(len(models)) if k != m and len(models[k].history) > trees]
            if others and min(history) > float(np.median(others)):
                ended.add(m)
    return ended


def fit(
    rows: DataFrame, features: Sequence[str], target: str, jobs: Sequence[Job], weight: str | None = None, slot: Column | None = None,
    held: Column | None = None, max_bin: int = 64, edges: Sequence[np.ndarray] | None = None, prune_after: int | None = None,
) -> list[Boosted]:
    """Models of all jobs on rows with a target. ``held`` marks holdout rows, ``slot`` says which models a row belongs to."""
    if edges is None:
        learnt = F.col(target).isNotNull() if held is None else F.col(target).isNotNull() & ~held
        edges = bin_edges(rows.filter(learnt), features, max_bin)
    return fit_blocks(binned_blocks(rows, features, target, edges, weight, slot, held), features, edges, jobs, prune_after)


def predict(models: Sequence[Boosted], rows: DataFrame, name: str = "local_power_pred", which: Column | None = None, scale: str | None = None) -> DataFrame:
    """Predictions of the model whose number ``which`` gives (the first one if not given); null where there is no such model or it has no rows."""
    shared = rows.sparkSession.sparkContext.broadcast(list(models))

    def work(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.Series]:
        walks: dict[int, list[_Walk]] = {}
        for number, values in batches:
            out = np.full(len(number), np.nan)
            number = number.to_numpy(np.float64, na_value=np.nan)
            given, bins = values.to_numpy(np.float64, na_value=np.nan), {}
            for m, model in enumerate(shared.value):
                own = number == m
                if own.any() and model.base is not None:
                    if m not in walks:
                        walks[m] = [_Walk(tree) for tree in model.trees]
                    same = tuple(map(id, model.edges))  # models that were grown together share their edges
                    if same not in bins:
                        bins[same] = bins_of(given, model.edges)
                    out[own] = model.margins(bins[same][own], walks[m])
            yield pd.Series(out).astype(object).where(~np.isnan(out), None)

    features = models[0].features
    number = (F.lit(0) if which is None else which).cast("int")
    raw = F.pandas_udf(work, "double")(number, F.struct(*[_number(f).alias(f"f{i}") for i, f in enumerate(features)]))
    return rows.withColumn(name, raw if scale is None else raw * F.col(scale))
