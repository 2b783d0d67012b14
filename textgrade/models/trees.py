"""Tree ensembles for many fits at once: random forest, gradient boosting with curvature, boosted forest.

Rows are binned once, by quantiles of each feature. Trees of all fits (models, folds, feature subsets) grow
level by level from histograms: sums of the rows' statistics by (fit, tree, node, feature, bin). Forests sum
class counts and split by Gini impurity; boosting sums first and second derivatives of the softmax loss and
grows one tree a class and round, with leaf weights ``-G / (H + reg)``.

Where the binned table is large, every level is one Spark job over its rows: tasks add up their share of all
fits' histograms, the sums are shuffled by node, and only the chosen splits reach the driver. Where the whole
binned table is at most ``LOCAL_BYTES`` (it is counted first), it is broadcast and Spark deals out the fits
instead; members of a forest are dealt out in pieces where rows are many. A task grows few members at a time, so that
at most about ``PAIRS`` pairs of a row and a tree are held, and keeps sums of scores or importances, no grown trees.
Both ways choose splits by the same function from the same sums and give the same trees.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, fields, replace

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textgrade.fixed_values import SEED
from textgrade.session import materialize

BINS = 32
LOCAL_BYTES = 64 << 20  # of a binned table that every task may hold
CELLS = 1 << 21  # histogram cells worked on together
PIECE = 13  # members of a forest that one task grows where they are dealt out
PAIRS = 1 << 20  # pairs of a row and a tree held together, unless one member has more
ROWS = 1 << 14  # rows that are led through trees together
DEAL = 1 << 20  # pairs of a row and a member from which the members of a predicting fit are dealt out
NO_SPLIT = -1


@dataclass(frozen=True)
class Spec:
    """What is grown. ``members`` trees a class and round; ``columns`` is the share of features a node sees."""

    gini: bool = False
    rounds: int = 100
    members: int = 1
    depth: int = 6
    rate: float = 0.3
    reg: float = 1.0
    min_weight: float = 1.0
    rows: float = 1.0
    columns: float | str = 1.0
    seed: int = SEED

    def width(self, n_features: int) -> int:
        share = np.sqrt(n_features) / n_features if self.columns == "sqrt" else self.columns
        return max(1, int(share * n_features + 1e-9))


#: Values of the libraries' defaults: depth 6, rate 0.3, L2 term 1 for boosting; 100 parallel trees, rate 1,
#: 80 % of rows and of features a node, L2 term 1e-5 for the boosted forest; trees down to pure leaves for the forest.
FOREST = Spec(gini=True, rounds=1, members=100, depth=40, columns="sqrt")
BOOSTED = Spec()
BOOSTED_FOREST = Spec(rounds=1, members=100, rate=1.0, reg=1e-5, rows=0.8, columns=0.8)


@dataclass(frozen=True)
class Fit:
    """One model to grow, with these features, from the rows outside ``fold`` (all if None) and ``apart``."""

    spec: Spec
    features: tuple[int, ...]
    fold: int | None = None
    apart: tuple[int, ...] = ()
    first: int = 0  # with ``last``, only these members
    last: int | None = None

    @property
    def members(self) -> int:
        return (self.spec.members if self.last is None else self.last) - self.first

    def trees(self, n_classes: int) -> int:
        return self.members * (1 if self.spec.gini else n_classes)

    def pieces(self, size: int = PIECE) -> list[Fit]:
        """The fit as parts that can be grown apart: members of one round don't depend on each other."""
        if self.spec.rounds > 1:
            return [self]
        end = self.first + self.members
        return [replace(self, first=a, last=min(a + size, end)) for a in range(self.first, end, size)]

    def handfuls(self, rows: int, n_classes: int) -> list[Fit]:
        """Pieces of so few members that a task can hold all their pairs of a row and a tree, and boosting's histograms of a level."""
        if self.spec.gini:
            return self.pieces(max(1, PAIRS // max(rows, 1)))
        cells = (n_classes << min(self.spec.depth - 1, 30)) * len(self.features) * BINS * 2
        return self.pieces(max(1, min(PAIRS // max(rows * n_classes, 1), CELLS // max(cells, 1))))

    def learns(self, folds: np.ndarray) -> np.ndarray:
        out = [f for f in (self.fold, *self.apart) if f is not None]
        return ~np.isin(folds, out)

    def predicts(self, folds: np.ndarray) -> np.ndarray:
        return np.ones(len(folds), bool) if self.fold is None else folds == self.fold


def _mix(*parts: np.ndarray | int) -> np.ndarray:
    """Uniform numbers in [0, 1) that depend on ``parts`` alone."""
    h = np.uint64(0)
    with np.errstate(over="ignore"):
        for p in parts:
            h = (h ^ np.asarray(p).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)  # fixed value: odd multiplier
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)  # fixed value: odd multiplier
            h = h ^ (h >> np.uint64(32))
    return (h >> np.uint64(11)).astype(np.float64) / float(1 << 53)


@dataclass
class Trees:
    """Trees as flat arrays; the right child of a node stands behind its left one."""

    roots: np.ndarray
    feature: np.ndarray  # NO_SPLIT in leaves
    cut: np.ndarray  # rows with a bin up to this one go left
    left: np.ndarray
    value: np.ndarray  # (node, outputs)
    gain: np.ndarray
    weight: np.ndarray

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """Node in which each row ends, by tree."""
        if len(bins) > ROWS:
            return np.concatenate([self.leaves(bins[a : a + ROWS]) for a in range(0, len(bins), ROWS)], axis=1)
        at = np.repeat(self.roots[:, None], len(bins), axis=1)
        rows = np.arange(len(bins))[None, :]
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return at
            down = self.left[at] + (bins[rows, np.maximum(f, 0)] > self.cut[at])
            at = np.where(inner, down, at)


@dataclass
class Growing:
    """The trees of one round of one fit while they grow: open nodes are ``slots``."""

    spec: Spec
    features: np.ndarray
    round: int
    n_trees: int
    first: int = 0  # number of the first tree
    feature: list = field(default_factory=list)
    cut: list = field(default_factory=list)
    left: list = field(default_factory=list)
    totals: list = field(default_factory=list)
    gain: list = field(default_factory=list)
    slots: np.ndarray = None  # node of each slot
    tree: np.ndarray = None
    path: np.ndarray = None  # 1 for a root, then a bit more for each step
    subset: np.ndarray = None
    level: int = 0

    def __post_init__(self) -> None:
        self.feature, self.cut, self.left = ([NO_SPLIT] * self.n_trees, [0] * self.n_trees, [0] * self.n_trees)
        self.totals, self.gain = [None] * self.n_trees, [0.0] * self.n_trees
        self.slots = self.tree = np.arange(self.n_trees)  # trees are numbered from 0 here
        self.path = np.ones(self.n_trees, np.uint64)
        self._draw()

    def _draw(self) -> None:
        """The features each slot may split by."""
        d, m = len(self.features), self.spec.width(len(self.features))
        if m == d:
            self.subset = np.broadcast_to(self.features, (len(self.slots), d))
            return
        u = _mix(self.spec.seed, 1, self.round, self.first + self.tree[:, None], self.path[:, None], self.features[None, :])
        self.subset = np.sort(self.features[np.argsort(u, axis=1, kind="stable")[:, :m]], axis=1)

    def settle(self, splits: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Take the best split of every slot (see :func:`best_splits`) and open the next level.

        Gives, by old slot, the feature and cut of the split (``NO_SPLIT`` if it stays a leaf) and the new left slot.
        """
        good = splits["gain"] > 1e-6
        k = int(good.sum())
        first = len(self.feature)
        for slot, total in zip(self.slots.tolist(), splits["total"]):
            self.totals[slot] = total
        at = self.slots[good].tolist()
        chosen = self.subset[np.flatnonzero(good), splits["which"][good]]
        for i, (node, f, c, g) in enumerate(zip(at, chosen.tolist(), splits["cut"][good].tolist(), splits["gain"][good].tolist())):
            self.feature[node], self.cut[node], self.left[node], self.gain[node] = f, c, first + 2 * i, g
        for column, blank in ((self.feature, NO_SPLIT), (self.cut, 0), (self.left, 0), (self.gain, 0.0)):
            column.extend([blank] * (2 * k))
        left = splits["left"][good]
        self.totals.extend(np.stack([left, splits["total"][good] - left], axis=1).reshape(2 * k, -1) if k else [])
        feature, goes = np.full(len(good), NO_SPLIT), np.zeros(len(good), np.int64)
        feature[good], goes[good] = chosen, 2 * np.arange(k)
        cut = splits["cut"]
        self.slots = np.arange(first, first + 2 * k)
        self.tree = np.repeat(self.tree[good], 2)
        self.path = np.repeat(self.path[good] * np.uint64(2), 2) + np.tile(np.array([0, 1], np.uint64), k)
        self.level += 1
        self._draw()
        return feature, cut, goes

    def trees_so_far(self) -> Trees:
        """The nodes there are, to find where rows are now."""
        kinds = (self.feature, np.int64), (self.cut, np.int64), (self.left, np.int64)
        none = np.zeros(0)
        return Trees(np.arange(self.n_trees), *(np.array(c, t) for c, t in kinds), none, none, none)

    def trees(self) -> Trees:
        totals = np.stack(self.totals)
        if self.spec.gini:
            weight = totals.sum(axis=1)
            value = totals / np.maximum(weight, 1e-12)[:, None]
        else:
            weight = totals[:, 1]
            value = -self.spec.rate / self.spec.members * totals[:, :1] / (totals[:, 1:] + self.spec.reg)
        kinds = (self.feature, np.int64), (self.cut, np.int64), (self.left, np.int64)
        return Trees(np.arange(self.n_trees), *(np.array(c, t) for c, t in kinds), value, np.array(self.gain), weight)


def paired(bins: np.ndarray, features: Sequence[int]) -> np.ndarray:
    """The bins of every two neighbouring features as one number, column by column; of an odd one, its bins times ``BINS``."""
    out = np.empty((len(bins), (len(features) + 1) // 2), np.uint16, order="F")
    for j in range(out.shape[1]):
        out[:, j] = bins[:, features[2 * j]].astype(np.uint16) * BINS
        if 2 * j + 1 < len(features):
            out[:, j] += bins[:, features[2 * j + 1]].astype(np.uint16)
    return out


def _all_histograms(
    bins: np.ndarray, rows: np.ndarray, slots: np.ndarray, stats: np.ndarray, features: np.ndarray, n: int, pairs: np.ndarray | None = None, tiled: bool = False
) -> np.ndarray:
    """:func:`histograms` of the same features for all slots, two at a time (``pairs`` of :func:`paired`) where that leaves few cells empty.

    ``tiled`` says that every slot holds all rows, in order, one slot after another.
    """
    m, c = len(features), stats.shape[1]
    out, columns = np.empty((n, m, BINS, c)), [np.ascontiguousarray(stats[:, k]) for k in range(c)]
    if n * BINS * BINS > len(rows):
        first = slots * BINS
        for j in range(m):
            where = first + bins[:, features[j]].take(rows)
            for k in range(c):
                out[:, j, :, k] = np.bincount(where, columns[k], n * BINS).reshape(n, BINS)
        return out
    pairs = paired(bins, features) if pairs is None else pairs
    first, found = None if tiled else slots * (BINS * BINS), np.empty((n, BINS * BINS))
    for j in range(0, m, 2):
        code = pairs[:, j // 2]
        where = code.astype(np.int64) if tiled else first + code.take(rows)
        for k in range(c):
            if tiled:
                for slot in range(n):
                    found[slot] = np.bincount(where, columns[k][slot * len(bins) : (slot + 1) * len(bins)], BINS * BINS)
                both = found.reshape(n, BINS, BINS)
            else:
                both = np.bincount(where, columns[k], n * BINS * BINS).reshape(n, BINS, BINS)
            out[:, j, :, k] = both.sum(axis=2)
            if j + 1 < m:
                out[:, j + 1, :, k] = both.sum(axis=1)
    return out


def _picked(bins: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """``bins[rows, columns]`` of a matrix that lies row by row or column by column."""
    if bins.flags.f_contiguous:
        return bins.ravel(order="F").take(columns * len(bins) + rows)
    return bins[rows, columns]


def histograms(
    bins: np.ndarray, rows: np.ndarray, slots: np.ndarray, stats: np.ndarray, subset: np.ndarray, pairs: np.ndarray | None = None, n_features: int = 0, tiled: bool = False
) -> np.ndarray:
    """Sums (slot, subset feature, bin, statistic) over pairs of a row and the slot it is in.

    ``pairs`` are :func:`paired` bins of the ``n_features`` that a fit has, by number, for ``tiled`` see :func:`_all_histograms`.
    """
    n, m, c = len(subset), subset.shape[1], stats.shape[1]
    every = np.unique(subset)
    # where slots see most features, to count all is less than to look up each slot's
    if n and (m == len(every) or 2 * m >= len(every) and n * len(every) * BINS * c <= 2 * CELLS):
        sums = _all_histograms(bins, rows, slots, stats, every, n, pairs if len(every) == n_features else None, tiled)
        return sums if m == len(every) and (subset == every).all() else sums[np.arange(n)[:, None], np.searchsorted(every, subset)]
    out = np.empty((n, m, BINS, c))
    first, columns = slots * BINS, [np.ascontiguousarray(stats[:, k]) for k in range(c)]
    for j in range(m):
        where = first + _picked(bins, rows, subset[:, j].take(slots))
        for k in range(c):
            out[:, j, :, k] = np.bincount(where, columns[k], n * BINS).reshape(n, BINS)
    return out


def class_histograms(bins: np.ndarray, rows: np.ndarray, slots: np.ndarray, weight: np.ndarray, label: np.ndarray, c: int, subset: np.ndarray) -> np.ndarray:
    """:func:`histograms` where a pair's only statistic that is not 0 is that of its class."""
    n, m = len(subset), subset.shape[1]
    out = np.empty((c, n, m, BINS))  # class by class, for that is how splits are weighed
    first = (label * n + slots) * BINS
    for j in range(m):
        where = first + _picked(bins, rows, subset[:, j].take(slots))
        out[:, :, j] = np.bincount(where, weight, c * n * BINS).reshape(c, n, BINS)
    return np.moveaxis(out, 0, -1)


def best_splits(sums: np.ndarray, spec: Spec) -> dict[str, np.ndarray]:
    """The best split of each slot from its histograms; ``gain`` is 0 where there is none.

    Gains are compared to nine significant digits; of equal ones the first feature and lowest cut win.
    """
    if spec.gini:
        below = np.moveaxis(np.cumsum(np.moveaxis(sums, -1, 0), axis=3), 0, -1)
    else:
        below = sums.cumsum(axis=2)
    total = below[:, 0, -1]
    below = below[:, :, :-1]
    above = total[:, None, None] - below
    if spec.gini:
        def score(s):
            n = s.sum(axis=-1)
            return np.divide((s * s).sum(axis=-1), n, out=np.zeros(n.shape), where=n > 0)

        fits = (below.sum(axis=-1) >= spec.min_weight) & (above.sum(axis=-1) >= spec.min_weight)
    else:
        def score(s):
            return s[..., 0] ** 2 / (s[..., 1] + spec.reg)

        fits = (below[..., 1] >= spec.min_weight) & (above[..., 1] >= spec.min_weight)
    parent = score(total)
    gain = np.where(fits, score(below) + score(above) - parent[:, None, None], 0.0)
    digits = 10.0 ** (9 - np.ceil(np.log10(np.maximum(np.abs(parent), 1e-9))))
    flat = np.round(gain.reshape(len(gain), -1) * digits[:, None])
    best = flat.argmax(axis=1)
    which, cut = np.divmod(best, gain.shape[2])
    every = np.arange(len(gain))
    return {"gain": gain[every, which, cut], "which": which, "cut": cut, "left": below[every, which, cut], "total": total}


class Sample:
    """The pairs of rows and trees of a round with their statistics."""

    def __init__(self, fit: Fit, round_: int, ids: np.ndarray, labels: np.ndarray, margins: np.ndarray, n_classes: int):
        spec, trees = fit.spec, fit.trees(n_classes)
        self.gini, self.tiled = spec.gini, not spec.gini and spec.rows >= 1
        per = 1 if spec.gini else n_classes
        parts = []
        for t in range(0, trees, per):  # trees of one member see the same rows
            u = _mix(spec.seed, 2, round_, fit.first + t // per, ids) if spec.gini or spec.rows < 1 else None
            # a bootstrap gives each row about a Poisson number of copies; else a share of the rows is seen
            weight = np.ones(len(ids)) if u is None else np.searchsorted(POISSON, u, side="right") if spec.gini else u < spec.rows
            seen = np.flatnonzero(weight)
            parts += [(np.full(len(seen), t + k), seen, weight[seen].astype(np.float64)) for k in range(per)]
        self.tree, self.row, w = (np.concatenate(p) for p in zip(*parts))
        self.weight, self.label = w, labels[self.row]
        if spec.gini:
            return
        p = np.exp(margins - margins.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        k = self.tree % n_classes
        mine = p[self.row, k]
        self.stats = np.stack([w * (mine - (self.label == k)), w * np.maximum(2 * mine * (1 - mine), 1e-16)], axis=1)

    def sums(
        self, bins: np.ndarray, here: np.ndarray, slots: np.ndarray, subset: np.ndarray, n_classes: int, pairs: np.ndarray | None = None, n_features: int = 0
    ) -> np.ndarray:
        """Histograms of the pairs ``here``, which are in ``slots``."""
        rows = self.row[here]
        if self.gini:
            return class_histograms(bins, rows, slots, self.weight[here], self.label[here], n_classes, subset)
        return histograms(bins, rows, slots, self.stats[here], subset, pairs, n_features, self.tiled and slots is self.tree)

    def totals(self, here: np.ndarray, slots: np.ndarray, n: int, n_classes: int) -> np.ndarray:
        if self.gini:
            return np.bincount(slots * n_classes + self.label[here], self.weight[here], n * n_classes).reshape(n, n_classes)
        return np.stack([np.bincount(slots, self.stats[here, k], n) for k in range(2)], axis=1)


POISSON = np.cumsum(np.exp(-1.0) / np.array([1.0, 1, 2, 6, 24, 120, 720, 5040, 40320]))


def _open(spec: Spec, totals: np.ndarray) -> np.ndarray:
    """Slots that could be split at all."""
    if spec.gini:
        return (totals.sum(axis=1) >= 2 * spec.min_weight) & ((totals > 0).sum(axis=1) > 1)
    return totals[:, 1] >= 2 * spec.min_weight


def _growing(fit: Fit, round_: int, n_classes: int) -> Growing:
    first = fit.first * (1 if fit.spec.gini else n_classes)
    return Growing(fit.spec, np.array(fit.features), round_, fit.trees(n_classes), first)


def grow_here(
    fit: Fit,
    round_: int,
    bins: np.ndarray,
    ids: np.ndarray,
    labels: np.ndarray,
    margins: np.ndarray,
    n_classes: int,
    both: np.ndarray | None = None,
    ends: np.ndarray | None = None,
) -> Trees:
    """One round of a fit over rows that are all here, few members at a time; ``both`` are :func:`paired` bins of its features.

    ``ends`` takes up the leaf of each row by tree, of a fit with many rounds whose trees see all rows.
    """
    return joined([_grow_here(few, round_, bins, ids, labels, margins, n_classes, both, ends) for few in fit.handfuls(len(ids), n_classes)])


def joined(parts: Sequence[Trees]) -> Trees:
    if len(parts) == 1:
        return parts[0]
    starts = np.cumsum([0] + [len(p.feature) for p in parts[:-1]])
    moved = [replace(p, roots=p.roots + at, left=p.left + at) for p, at in zip(parts, starts)]
    return Trees(*(np.concatenate([getattr(p, f.name) for p in moved]) for f in fields(Trees)))


def _grow_here(
    fit: Fit,
    round_: int,
    bins: np.ndarray,
    ids: np.ndarray,
    labels: np.ndarray,
    margins: np.ndarray,
    n_classes: int,
    both: np.ndarray | None = None,
    ends: np.ndarray | None = None,
) -> Trees:
    """All open nodes of a level at a time. In boosting over rounds the histograms of the larger of two children are their
    parent's less the other's."""
    pairs = Sample(fit, round_, ids, labels, margins, n_classes)
    growing = _growing(fit, round_, n_classes)
    every = growing.features
    on, slots, c = np.arange(len(pairs.row)), pairs.tree, n_classes if fit.spec.gini else 2
    widest = growing.n_trees << min(fit.spec.depth - 1, 30)
    # a single round has but two gradients, so that many splits are equally good and rounding would choose: it counts anew
    halve = fit.spec.rounds > 1 and not fit.spec.gini and 2 * growing.subset.shape[1] >= len(every) and widest * len(every) * BINS * c <= CELLS
    above = None  # histograms over all features of the parents of the open nodes
    while len(growing.slots):
        n = len(growing.slots)
        total = pairs.totals(on, slots, n, n_classes)
        found = {"gain": np.zeros(n), "which": np.zeros(n, np.int64), "cut": np.zeros(n, np.int64), "left": np.zeros((n, c)), "total": total}
        ready = np.flatnonzero(_open(fit.spec, total)) if growing.level < fit.spec.depth else np.zeros(0, np.int64)
        sums = None
        if halve and len(ready):
            sums = _all_sums(bins, pairs, on, slots, every, above, n, n_classes, both)
            at = np.searchsorted(every, growing.subset[ready])
            picked = sums[ready] if at.shape[1] == len(every) else sums[ready[:, None], at]
            for key, values in best_splits(picked, fit.spec).items():
                found[key][ready] = values
        else:
            at_once = max(1, CELLS // (growing.subset.shape[1] * BINS * c))
            number = np.full(n, -1)
            for a in range(0, len(ready), at_once):
                few = ready[a : a + at_once]
                number[:] = -1
                number[few] = np.arange(len(few))
                mine = number[slots]
                here = mine >= 0
                got = best_splits(pairs.sums(bins, on[here], mine[here], growing.subset[few], n_classes, both, len(every)), fit.spec)
                for key, values in got.items():
                    found[key][few] = values
        found["total"] = total
        nodes = growing.slots
        feature, cut, goes = growing.settle(found)
        stays = (feature >= 0).take(slots)
        if not stays.all():
            if ends is not None:  # pairs are all rows of a tree, then those of the next
                ends.ravel()[on[~stays]] = nodes[slots[~stays]]
            on, slots = on[stays], slots[stays]
        slots = goes.take(slots) + (_picked(bins, pairs.row.take(on), feature.take(slots)) > cut.take(slots))
        above = None if sums is None else sums[feature >= 0]
    return growing.trees()


def _all_sums(
    bins: np.ndarray, pairs: Sample, on: np.ndarray, slots: np.ndarray, every: np.ndarray, above: np.ndarray | None, n: int, n_classes: int, both: np.ndarray | None = None
) -> np.ndarray:
    """Histograms of all slots over all features; of two children only the smaller one is counted."""
    if above is None:
        return pairs.sums(bins, on, slots, np.broadcast_to(every, (n, len(every))), n_classes, both, len(every))
    rows = np.bincount(slots, minlength=n).reshape(-1, 2)
    less = 2 * np.arange(n // 2) + (rows[:, 1] < rows[:, 0])
    number = np.full(n, -1)
    number[less] = np.arange(n // 2)
    mine = number[slots]
    here = mine >= 0
    counted = pairs.sums(bins, on[here], mine[here], np.broadcast_to(every, (n // 2, len(every))), n_classes, both, len(every))
    out = np.empty((n, *counted.shape[1:]))
    out[less], out[less ^ 1] = counted, above - counted
    return out


def outputs(trees: Trees, fit: Fit, bins: np.ndarray, n_classes: int) -> np.ndarray:
    """What a round adds to each row's class scores."""
    if len(bins) > ROWS:
        return np.concatenate([outputs(trees, fit, bins[a : a + ROWS], n_classes) for a in range(0, len(bins), ROWS)])
    value = trees.value[trees.leaves(bins)]  # (tree, row, outputs)
    if fit.spec.gini:
        return value.mean(axis=0)
    return value[:, :, 0].reshape(fit.members, n_classes, len(bins)).sum(axis=0).T


def fit_here(fit: Fit, bins: np.ndarray, ids: np.ndarray, labels: np.ndarray, n_classes: int) -> list[Trees]:
    """All rounds of a fit over rows that are all here."""
    margins, rounds, bins = np.zeros((len(ids), n_classes)), [], np.asfortranarray(bins)  # histograms go feature by feature
    both = None if fit.spec.gini else paired(bins, sorted(fit.features))
    ends = np.zeros((fit.trees(n_classes), len(ids)), np.int64) if fit.spec.rounds > 1 and not fit.spec.gini and fit.spec.rows >= 1 else None
    for k in range(fit.spec.rounds):
        trees = grow_here(fit, k, bins, ids, labels, margins, n_classes, both, ends)
        rounds.append(trees)
        if ends is not None:
            margins = margins + trees.value[ends, 0].reshape(fit.members, n_classes, len(ids)).sum(axis=0).T
        elif fit.spec.rounds > 1:
            margins = margins + outputs(trees, fit, bins, n_classes)
    return rounds


def part_scores(fit: Fit, learn: tuple[np.ndarray, np.ndarray, np.ndarray], bins: np.ndarray, n_classes: int) -> np.ndarray:
    """Sums of class scores over the members of a fit grown from ``learn`` (bins, ids, labels), which are let go one after another."""
    scores = np.zeros((len(bins), n_classes))
    for few in fit.handfuls(len(learn[0]), n_classes):
        got = class_scores(fit_here(few, *learn, n_classes), few, bins, n_classes)
        scores += got * few.members if fit.spec.gini else got
    return scores


def part_weights(fit: Fit, learn: tuple[np.ndarray, np.ndarray, np.ndarray], n_features: int, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`weights` of a fit, whose members are let go one after another."""
    found = [weights(fit_here(few, *learn, n_classes), few, n_features) for few in fit.handfuls(len(learn[0]), n_classes)]
    return sum(t for t, _ in found), found[0][1] if fit.spec.gini else sum(n for _, n in found)


def class_scores(rounds: Sequence[Trees], fit: Fit, bins: np.ndarray, n_classes: int) -> np.ndarray:
    scores = np.zeros((len(bins), n_classes))
    for trees in rounds:
        scores += outputs(trees, fit, bins, n_classes)
    return scores


def weights(rounds: Sequence[Trees], fit: Fit, n_features: int) -> tuple[np.ndarray, np.ndarray]:
    """Per feature, a sum and what it is to be divided by; sums of parts of a fit may be added.

    A forest adds up each tree's shares of impurity decrease (and divides by 1); boosting adds up gains
    of splits and divides by their number.
    """
    if fit.spec.gini:
        total = np.zeros(n_features)
        for trees in rounds:
            owner = np.zeros(len(trees.feature), np.int64)
            owner[trees.roots] = np.arange(len(trees.roots))
            inner = np.flatnonzero(trees.feature >= 0)
            for node in inner.tolist():  # parents stand before their children
                owner[trees.left[node] : trees.left[node] + 2] = owner[node]
            table = np.zeros((len(trees.roots), n_features))
            np.add.at(table, (owner[inner], trees.feature[inner]), trees.gain[inner])
            sums = table.sum(axis=1, keepdims=True)
            total += np.divide(table, sums, out=np.zeros_like(table), where=sums > 0).sum(axis=0)
        return total, np.ones(n_features)
    feature = np.concatenate([t.feature[t.feature >= 0] for t in rounds])
    gain = np.concatenate([t.gain[t.feature >= 0] for t in rounds])
    return np.bincount(feature, gain, n_features), np.bincount(feature, minlength=n_features).astype(np.float64)


def importances(rounds: Sequence[Trees], fit: Fit, n_features: int) -> np.ndarray:
    """Per feature, adding up to 1: mean share of impurity decrease (forest) or mean gain of its splits (boosting)."""
    total, n = weights(rounds, fit, n_features)
    total = np.divide(total, n, out=np.zeros(n_features), where=n > 0)
    return total / total.sum() if total.sum() > 0 else total


@dataclass
class Binned:
    """``id, label, fold, bins`` as a table, with the bin edges of each feature and the classes."""

    table: DataFrame
    edges: list[np.ndarray]
    classes: list[int]
    rows: int

    held: Broadcast | None = None

    @property
    def small(self) -> bool:
        return self.rows * (len(self.edges) + 24) <= LOCAL_BYTES

    def shared(self) -> Broadcast:
        """Bins, ids, class numbers and folds of all rows for every task; only of a small table."""
        if self.held is None:
            if not self.small:
                raise ValueError("too many rows to broadcast")
            rows = self.table.toArrow()
            bins = np.frombuffer(b"".join(rows["bins"].to_pylist()), np.uint8).reshape(-1, len(self.edges))
            labels = np.searchsorted(self.classes, rows["label"].to_numpy())
            data = bins, rows["id"].to_numpy().astype(np.int64), labels, rows["fold"].fill_null(-1).to_numpy().astype(np.int64)
            self.held = self.table.sparkSession.sparkContext.broadcast(data)
        return self.held


def _binner(edges: list[np.ndarray]):
    """Bins of vectors as bytes, one a feature; undefined values are in the last bin."""

    @F.pandas_udf("binary")
    def bins_of(xs):
        import pandas as pd

        if not len(xs):
            return pd.Series([], dtype=object)
        x = np.stack(xs.to_numpy()).astype(np.float64)
        out = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        return pd.Series([row.tobytes() for row in out.astype(np.uint8)])

    return bins_of


def _array(df: DataFrame, vector: str = "features"):
    return vector_to_array(vector) if isinstance(df.schema[vector].dataType, VectorUDT) else F.col(vector).cast("array<double>")


def bin_rows(df: DataFrame) -> Binned:
    """``df (id, features, label[, fold])`` binned by quantiles of all its rows, ``BINS`` to a feature."""
    folds = F.col("fold").cast("int") if "fold" in df.columns else F.lit(None).cast("int")
    key = F.col("id").cast("long") if "id" in df.columns else F.monotonically_increasing_id()
    rows = materialize(df.select(key.alias("id"), _array(df).alias("x"), F.col("label").cast("int").alias("label"), folds.alias("fold")))
    shares = [i / BINS for i in range(1, BINS)]
    values = rows.select(F.posexplode("x").alias("at", "v")).where(~F.isnan("v"))
    found = {r["at"]: r["q"] for r in values.groupBy("at").agg(F.percentile_approx("v", shares, 10_000).alias("q")).collect()}
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d"), F.sort_array(F.collect_set("label")).alias("classes")).first()
    edges = [np.unique(found.get(j, [])) for j in range(facts["d"] or 0)]
    table = materialize(rows.select("id", "label", "fold", _binner(edges)("x").alias("bins")))
    return Binned(table, edges, list(facts["classes"]), facts["n"])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, np.uint8).reshape(-1, width)


def _grow_fits(data: Binned, fits: Sequence[Fit]) -> list[list[Trees]]:
    """All fits over a table of any size, level by level, all of them in each job."""
    width, classes = len(data.edges), data.classes
    number = {c: i for i, c in enumerate(classes)}
    n_classes, spark = len(classes), data.table.sparkSession
    state = data.table.withColumn("margins", F.array_repeat(F.lit(0.0), len(fits) * n_classes))
    grown: list[list[Trees]] = [[] for _ in fits]

    def share(batch: pa.RecordBatch) -> tuple:
        bins = _matrix(batch["bins"], width)
        labels = np.array([number[v] for v in batch["label"].to_pylist()], np.int64)
        margins = np.array(batch["margins"].to_pylist(), np.float64).reshape(len(bins), len(fits), n_classes)
        folds = np.array([-1 if v is None else v for v in batch["fold"].to_pylist()], np.int64)
        return bins, labels, margins, folds, np.asarray(batch["id"]).astype(np.int64)

    for k in range(max(f.spec.rounds for f in fits)):
        going = {i: None for i, f in enumerate(fits) if k < f.spec.rounds}
        for i in going:
            going[i] = _growing(fits[i], k, n_classes)
        waiting = dict(going)
        while waiting:
            partial = {i: g.trees_so_far() for i, g in waiting.items()}
            opened = {i: (g.slots, g.subset) for i, g in waiting.items()}

            def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    if not batch.num_rows:
                        continue
                    bins, labels, margins, folds, ids = share(batch)
                    for i, (slots, subset) in opened.items():
                        on = fits[i].learns(folds)
                        pairs = Sample(fits[i], k, ids[on], labels[on], margins[on, i], n_classes)
                        node = partial[i].leaves(bins[on])[pairs.tree, pairs.row]
                        slot = np.full(len(partial[i].feature), -1)
                        slot[slots] = np.arange(len(slots))
                        here = slot[node] >= 0
                        table = pairs.sums(bins[on], np.flatnonzero(here), slot[node[here]], subset, n_classes)
                        table = table.reshape(len(slots), -1)
                        for at in np.unique(slot[node[here]]).tolist():
                            cells = np.flatnonzero(table[at])
                            same = lambda v: pa.array(np.full(len(cells), v, np.int32))
                            yield pa.RecordBatch.from_arrays([same(i), same(at), pa.array(cells.astype(np.int32)), pa.array(table[at, cells])], ["fit", "slot", "cell", "value"])

            def choose(table: pa.Table) -> pa.Table:
                i, at = table["fit"][0].as_py(), table["slot"][0].as_py()
                spec, m = fits[i].spec, opened[i][1].shape[1]
                c = n_classes if spec.gini else 2
                dense = np.zeros(m * BINS * c)
                dense[table["cell"].to_numpy()] = table["value"].to_numpy()
                got = best_splits(dense.reshape(1, m, BINS, c), spec)
                if not _open(spec, got["total"])[0] or waiting_level[i] >= spec.depth:
                    got["gain"][:] = 0
                row = [[i], [at], got["gain"], got["which"].astype(np.int32), got["cut"].astype(np.int32), got["left"].tolist(), got["total"].tolist()]
                kinds = [pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64())]
                return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(row, kinds)], ["fit", "slot", "gain", "which", "cut", "left", "total"])

            waiting_level = {i: g.level for i, g in waiting.items()}
            cells = state.mapInArrow(sums, "fit int, slot int, cell int, value double")
            added = cells.groupBy("fit", "slot", "cell").agg(F.sum("value").alias("value"))
            chosen = added.groupBy("fit", "slot").applyInArrow(
                choose, "fit int, slot int, gain double, which int, cut int, left array<double>, total array<double>"
            )
            found = chosen.collect()
            for i, growing in list(waiting.items()):
                mine = {r["slot"]: r for r in found if r["fit"] == i}
                c = n_classes if fits[i].spec.gini else 2
                none = {"gain": 0.0, "which": 0, "cut": 0, "left": [0.0] * c, "total": [0.0] * c}
                rows = [mine.get(s, none) for s in range(len(growing.slots))]
                growing.settle({key: np.array([r[key] for r in rows]) for key in none})
                if not len(growing.slots):
                    del waiting[i]
        for i, growing in going.items():
            grown[i].append(growing.trees())
        boosted = [i for i in going if fits[i].spec.rounds > 1]
        if boosted and k + 1 < max(fits[i].spec.rounds for i in boosted):

            def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    bins, _, margins, _, _ = share(batch)
                    for i in boosted:
                        margins[:, i] += outputs(grown[i][-1], fits[i], bins, n_classes)
                    flat = margins.reshape(len(bins), -1).tolist()
                    yield batch.set_column(batch.schema.get_field_index("margins"), "margins", pa.array(flat, pa.list_(pa.float64())))

            state = materialize(state.mapInArrow(add, state.schema))
    return grown


def run_fits(data: Binned, fits: Sequence[Fit]) -> DataFrame:
    """Grow all ``fits`` over the binned rows and predict.

    Gives ``fit, id, label, prediction`` of the rows of each fit's fold (all rows if it has none). Of
    classes with equal scores the lowest is predicted.
    """
    width, classes = len(data.edges), np.array(data.classes, np.int32)
    names = ["fit", "id", "label", "prediction"]

    def guess(i: int, rounds: Sequence[Trees], bins: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> pa.RecordBatch:
        best = class_scores(rounds, fits[i], bins, len(classes)).argmax(axis=1)
        columns = [np.full(len(ids), i, np.int32), ids, classes[labels], classes[best]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    schema = "fit int, id long, label int, prediction int"
    if data.small:
        parts = [(i, p) for i, fit in enumerate(fits) for p in (fit.pieces() if data.rows * fit.members > DEAL else [fit])]

        def scored(k: int, bins: np.ndarray, ids: np.ndarray, labels: np.ndarray, folds: np.ndarray) -> pa.RecordBatch:
            i, part = parts[k]
            on, off = part.learns(folds), np.flatnonzero(part.predicts(folds))
            scores = part_scores(part, (bins[on], ids[on], labels[on]), bins[off], len(classes))
            columns = [np.full(len(off), i, np.int32), off, ids[off], classes[labels[off]], list(scores)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["fit", "at", "id", "label", "scores"])

        found = _deal(data, [p for _, p in parts], scored, "fit int, at long, id long, label int, scores array<double>")
        each = [F.col("scores")[c] for c in range(len(classes))]
        if len(parts) > len(fits):  # rows are known by their place, for ids may repeat
            sums = [F.sum(c).alias(f"s{n}") for n, c in enumerate(each)]
            found = found.groupBy("fit", "at").agg(F.first("id").alias("id"), F.first("label").alias("label"), *sums)
            each = [F.col(f"s{n}") for n in range(len(classes))]
        each = [F.round(c, 12) for c in each]
        best, top = F.lit(int(classes[-1])), F.greatest(*each) if len(each) > 1 else each[0]
        for n in range(len(classes) - 2, -1, -1):
            best = F.when(each[n] == top, int(classes[n])).otherwise(best)
        return found.select("fit", "id", "label", best.cast("int").alias("prediction"))
    shared = data.table.sparkSession.sparkContext.broadcast(_grow_fits(data, fits))  # trees only
    number = {c: i for i, c in enumerate(data.classes)}

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, folds = _matrix(batch["bins"], width), np.array([-1 if v is None else v for v in batch["fold"].to_pylist()], np.int64)
            ids, labels = np.asarray(batch["id"]).astype(np.int64), np.array([number[v] for v in batch["label"].to_pylist()], np.int64)
            for i, fit in enumerate(fits):
                on = fit.predicts(folds)
                yield guess(i, shared.value[i], bins[on], ids[on], labels[on])

    return data.table.mapInArrow(predict, schema)


def hold_out(spec: Spec, train: DataFrame, validation: DataFrame) -> DataFrame:
    """``id, label, prediction`` of the rows of ``validation``, by trees grown in tasks over ``train``; both have ``id, features, label``."""
    data = bin_rows(train.drop("fold"))
    # rows asked go by a number of their own, for ids may repeat; their labels, which may be others, take no part
    asked = materialize(validation.select("id", "label", _binner(data.edges)(_array(validation)).alias("bins"), F.monotonically_increasing_id().alias("at")))
    marked = asked.select(F.col("at").alias("id"), F.lit(int(data.classes[0])).alias("label"), F.lit(1).alias("fold"), "bins")
    both = replace(data, table=data.table.withColumn("fold", F.lit(0)).unionByName(marked), rows=data.rows + asked.count(), held=None)
    found = run_fits(both, [Fit(spec, tuple(range(len(data.edges))), 1)])
    return asked.select("id", "label", "at").join(found.select(F.col("id").alias("at"), "prediction"), "at").drop("at")


def run_importances(data: Binned, fits: Sequence[Fit]) -> DataFrame:
    """Grow all ``fits`` over the binned rows and give ``fit, feature, importance``.

    Importances are those of :func:`importances`, but not divided by their sum.
    """
    spark, width, n_classes = data.table.sparkSession, len(data.edges), len(data.classes)
    schema = "fit int, feature int, total double, n double"
    if data.small:
        parts = [(i, part) for i, fit in enumerate(fits) for part in fit.pieces()]

        def weigh(k: int, bins: np.ndarray, ids: np.ndarray, labels: np.ndarray, folds: np.ndarray) -> pa.RecordBatch:
            i, part = parts[k]
            on = part.learns(folds)
            total, n = part_weights(part, (bins[on], ids[on], labels[on]), width, n_classes)
            n = n if not part.spec.gini or part.first == 0 else np.zeros(width)
            columns = [np.full(width, i, np.int32), np.arange(width, dtype=np.int32), total, n]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["fit", "feature", "total", "n"])

        found = _deal(data, [part for _, part in parts], weigh, schema).groupBy("fit", "feature").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    else:
        rows = [(i, f, float(t), float(n)) for i, rounds in enumerate(_grow_fits(data, fits)) for f, (t, n) in enumerate(zip(*weights(rounds, fits[i], width)))]
        found = spark.createDataFrame(rows, schema)
    return found.select("fit", "feature", F.when(F.col("n") > 0, F.col("total") / F.col("n")).otherwise(0.0).alias("importance"))


def _deal(data: Binned, fits: Sequence[Fit], work, schema: str) -> DataFrame:
    """``work(k, bins, ids, labels, folds)`` for the number k of every fit, a task each, the longest first.

    For tables small enough to be held by all tasks.
    """
    spark, held, n = data.table.sparkSession, data.shared(), len(fits)
    order = sorted(range(n), key=lambda k: (-fits[k].spec.rounds, -len(fits[k].features)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, ids, labels, folds = held.value
        for batch in batches:
            for k in batch.column(0).to_pylist():
                yield work(order[k], bins, ids, labels, folds)

    return spark.range(0, n, numPartitions=max(n, 1)).mapInArrow(run, schema)


def _grow_model(data: Binned, fit: Fit) -> list[Trees]:
    """The trees of one fit, grown by tasks; the driver gets them and nothing else."""
    if not data.small:
        return _grow_fits(data, [fit])[0]
    parts, n_classes = fit.pieces(), len(data.classes)

    def grow(k: int, bins: np.ndarray, ids: np.ndarray, labels: np.ndarray, folds: np.ndarray) -> pa.RecordBatch:
        on = parts[k].learns(folds)
        rounds = fit_here(parts[k], bins[on], ids[on], labels[on], n_classes)
        return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([pickle.dumps(rounds)])], ["part", "rounds"])

    grown = _deal(data, parts, grow, "part int, rounds binary").orderBy("part").toArrow()["rounds"]
    rounds = [pickle.loads(r) for r in grown.to_pylist()]
    return rounds[0] if len(parts) == 1 else [joined([r[0] for r in rounds])]


class TreeEnsemble(Estimator):
    """Estimator over ``features`` (vector) and ``label`` for one fit."""

    def __init__(self, spec: Spec):
        super().__init__()
        self.spec = spec

    def _fit(self, dataset: DataFrame) -> TreeEnsembleModel:
        data = bin_rows(dataset)
        fit = Fit(self.spec, tuple(range(len(data.edges))))
        return TreeEnsembleModel(data.edges, data.classes, fit, _grow_model(data, fit))


class TreeEnsembleModel(Model):
    def __init__(self, edges: list[np.ndarray], classes: list[int], fit: Fit, rounds: list[Trees]):
        super().__init__()
        self.edges, self.classes, self.fit_of, self.rounds = edges, classes, fit, rounds

    def importance(self) -> np.ndarray:
        return importances(self.rounds, self.fit_of, len(self.edges))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        width, classes, fit, rounds = len(self.edges), self.classes, self.fit_of, self.rounds

        @F.arrow_udf("double")
        def predict(bins: pa.Array) -> pa.Array:
            if not len(bins):
                return pa.array([], pa.float64())
            scores = class_scores(rounds, fit, _matrix(bins, width), len(classes))
            return pa.array(np.array(classes, np.float64)[scores.argmax(axis=1)])

        return dataset.withColumn("prediction", predict(_binner(self.edges)(_array(dataset))))
