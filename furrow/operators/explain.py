"""Per-row additive explanations of a random-forest class probability (exact Shapley values).

The value of a feature subset S for a row is the forest's expected class probability when the features in S are fixed to the row's
values and the others are integrated out along the tree paths, weighted by the training cover of each branch (the path-dependent
rule of tree explainers).

Every leaf stands for a product over features: ``o`` (1 if the row meets all conditions of the leaf's path on the feature, else 0)
where the feature is fixed, ``z`` (the product of the cover shares of those branches) where it is not. With the Beta integral
``s! (m-1-s)! / m! = int t^s (1-t)^(m-1-s) dt`` the Shapley sum over all subsets becomes

    phi_i = sum over leaves  value * (o_i - z_i) * int_0^1 prod_{j != i} (z_j (1 - t) + o_j t) dt,

the integral of a polynomial of degree m - 1, which Gauss quadrature with m / 2 nodes gives exactly, and base + sum(phi) = predicted
probability. That costs rows x leaves x features (``shapley``), and a forest without a depth limit has leaves in proportion to its rows.

``Subforest.shapley`` sums over subsets instead: phi is a weighted sum of the expectations v(S). For a small S, v(S) depends on few
bins (intervals between the thresholds), so that one table of all leaves serves every row. For a large S only leaves count whose
conditions fail on few features, which a walk from the root finds. Only leaves that hold the row's class count in either.

Scale: the forest is bounded by the model, not the data. Its trees are broadcast in groups of about ``GROUP_BYTES``; rows are ordered
by class (one shuffle) and pass through one vectorised map per group.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.operators.ranking import top_of_row

#: Bytes of leaf table in one broadcast, and row x leaf entries of one numpy block.
GROUP_BYTES = 128 << 20
PAIRS = 1 << 14
#: Cells of the largest table of expectations; most features whose subsets are listed; rows x trees that a walk starts from.
CELLS = 1 << 21
SUBSET_FEATURES = 10
FRONTIER = 1 << 15
#: Rows of a task that are worked on together, and tasks per core.
ROWS = 1 << 16
TASKS = 12


def forest_tables(spark: SparkSession, forest) -> list[dict]:
    """The trees of a fitted forest as node arrays."""
    trees, g = [], forest.grower
    for _, t in forest.nodes():
        inner = np.flatnonzero(t.left >= 0)
        sets = inner[g.categorical[t.feature[inner]]]
        feat, thr, cats = np.where(t.left >= 0, t.feature, -1), np.zeros(len(t.left)), [None] * len(t.left)
        for j in range(g.d):
            on = inner[t.feature[inner] == j]
            if not g.arity[j]:
                thr[on] = g.cuts[j][t.cut[on]]
        for i in sets.tolist():
            cats[i] = np.flatnonzero(t.goes[t.cut[i], :g.arity[t.feature[i]]]).astype(float)
        stats = t.stats(g.classes)
        cover = stats.sum(axis=1)
        trees.append({"feat": feat, "thr": thr, "left": t.left, "right": np.where(t.left >= 0, t.left + 1, -1), "cover": cover,
                      "value": stats / np.where(cover > 0, cover, 1.0)[:, None], "cats": cats,
                      "ncat": max([g.arity[t.feature[i]] for i in sets.tolist()], default=0)})
    return trees


@dataclass
class Leaves:
    """Leaves of a forest: per leaf and feature the interval (low, high] or the allowed categories, and the cover share z; per leaf
    and class the value over the number of trees."""

    low: np.ndarray
    high: np.ndarray
    z: np.ndarray
    value: np.ndarray
    allowed: dict[int, np.ndarray]  # categorical feature -> leaf x category
    tree: np.ndarray  # of a leaf, and its node there
    node: np.ndarray

    def __len__(self) -> int:
        return len(self.value)

    @property
    def nbytes(self) -> int:
        return self.low.nbytes + self.high.nbytes + self.z.nbytes + self.value.nbytes + sum(a.nbytes for a in self.allowed.values())

    def part(self, lo: int, hi: int) -> Leaves:
        return self.pick(slice(lo, hi))

    def pick(self, rows) -> Leaves:
        return Leaves(self.low[rows], self.high[rows], self.z[rows], self.value[rows], {f: a[rows] for f, a in self.allowed.items()},
                      self.tree[rows], self.node[rows])

    def groups(self, size: int = GROUP_BYTES) -> list[Leaves]:
        step = max(1, int(len(self) * size / max(self.nbytes, 1)))
        return [self.part(lo, lo + step) for lo in range(0, len(self), step)]


def leaf_table(trees: list[dict], n_features: int) -> Leaves:
    """The leaves of all trees; nodes of a tree are numbered in pre-order, so parents come before children."""
    arity: dict[int, int] = {}
    for t in trees:
        for f, cats in zip(t["feat"], t["cats"]):
            if cats is not None:
                arity[f] = max(arity.get(f, 0), t["ncat"])
    low, high, z, value, place = [], [], [], [], []
    allowed: dict[int, list[np.ndarray]] = {f: [] for f in arity}
    for i, t in enumerate(trees):
        stack = [(0, np.full(n_features, -np.inf), np.full(n_features, np.inf), np.ones(n_features),
                  {f: np.ones(n, dtype=bool) for f, n in arity.items()})]
        while stack:
            node, lo, hi, share, sets = stack.pop()
            left, right = t["left"][node], t["right"][node]
            if left < 0:
                for out, v in zip((low, high, z, value, place), (lo, hi, share, t["value"][node] / len(trees), (i, node))):
                    out.append(v)
                for f, v in sets.items():
                    allowed[f].append(v)
                continue
            f, total = t["feat"][node], t["cover"][left] + t["cover"][right]
            for child in (left, right):
                lo2, hi2, share2, sets2 = lo.copy(), hi.copy(), share.copy(), sets
                share2[f] *= t["cover"][child] / total
                if t["cats"][node] is not None:
                    here = np.zeros(arity[f], dtype=bool)
                    here[t["cats"][node].astype(int)] = True
                    sets2 = sets | {f: sets[f] & (here if child == left else ~here)}
                elif child == left:
                    hi2[f] = min(hi2[f], t["thr"][node])
                else:
                    lo2[f] = max(lo2[f], t["thr"][node])
                stack.append((child, lo2, hi2, share2, sets2))
    return Leaves(np.array(low), np.array(high), np.array(z), np.array(value), {f: np.array(a) for f, a in allowed.items()},
                  *np.array(place).T)


def shapley(leaves: Leaves, x: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phi [n, m], base [n], prob [n]) for the class ``cls`` of each row."""
    n, m = x.shape
    phi, base, prob = np.zeros((n, m)), np.zeros(n), np.zeros(n)
    nodes, weights = np.polynomial.legendre.leggauss(m // 2 + 1)
    step = 512
    for a in range(0, len(leaves), step):
        part = leaves.part(a, a + step)
        for b in range(0, n, max(1, PAIRS // step)):
            rows = slice(b, b + max(1, PAIRS // step))
            xr, value = x[rows], part.value[:, cls[rows]].T
            met = []
            for j in range(m):
                if j in part.allowed:
                    code = xr[:, j].astype(int)
                    known = (code >= 0) & (code < part.allowed[j].shape[1])
                    met.append((part.allowed[j][:, np.where(known, code, 0)].T & known[:, None]).astype(float))
                else:
                    met.append(((xr[:, j, None] > part.low[:, j]) & (xr[:, j, None] <= part.high[:, j])).astype(float))
            base[rows] += (value * part.z.prod(axis=1)).sum(axis=1)
            prob[rows] += (value * np.prod(met, axis=0)).sum(axis=1)
            used = np.flatnonzero((part.z < 1).any(axis=0))  # other features have o = z = 1 everywhere here
            sums = np.zeros((len(used), *value.shape))
            for t, w in zip((nodes + 1) / 2, weights / 2):
                terms = [met[j] * t + part.z[:, j] * (1 - t) for j in used]
                whole = value * w
                for f in terms:
                    whole = whole * f
                for i, f in enumerate(terms):  # z > 0 and t < 1, so no term is 0
                    sums[i] += whole / f
            for i, j in enumerate(used):
                phi[rows, j] += (sums[i] * (met[j] - part.z[:, j])).sum(axis=1)
    return phi, base, prob


@dataclass
class Subforest:
    """Some trees of a forest: their leaves, their nodes numbered through, and numbers as bins between their thresholds."""

    leaves: Leaves
    cuts: list[np.ndarray]  # thresholds of each number
    feat: np.ndarray
    left: np.ndarray
    right: np.ndarray
    below: np.ndarray  # last bin that goes left, of splits on numbers
    cats: np.ndarray  # row of ``goes`` of splits on categories, else -1
    goes: np.ndarray
    leaf: np.ndarray  # row of ``leaves``, else -1
    roots: np.ndarray
    first: int  # number of the first tree

    @classmethod
    def of(cls, trees: list[dict], leaves: Leaves, first: int) -> Subforest:
        """``trees`` and the ``leaves`` of these, which count trees from ``first``."""
        m = leaves.z.shape[1]
        sizes = [len(t["feat"]) for t in trees]
        roots = np.cumsum([0, *sizes])[:-1]
        join = lambda k: np.concatenate([t[k] for t in trees])
        feat, thr, start = join("feat"), join("thr"), np.repeat(roots, sizes)
        left, right = (np.where(join(k) < 0, -1, join(k) + start) for k in ("left", "right"))
        sets = [c for t in trees for c in t["cats"]]
        cats = np.full(len(feat), -1)
        on = np.array([c is not None for c in sets], dtype=bool)
        cats[on] = np.arange(on.sum())
        goes = np.zeros((on.sum(), 1 + max((a.shape[1] for a in leaves.allowed.values()), default=0)), dtype=bool)
        for k, c in enumerate(c for c in sets if c is not None):
            goes[k, c.astype(int)] = True
        cuts = [np.unique(thr[(feat == j) & (left >= 0) & ~on]) for j in range(m)]
        below = np.zeros(len(feat), dtype=np.int64)
        for j in range(m):
            at = (feat == j) & ~on
            below[at] = np.searchsorted(cuts[j], thr[at])
        leaf = np.full(len(feat), -1)
        leaf[roots[leaves.tree - first] + leaves.node] = np.arange(len(leaves))
        return cls(leaves, cuts, feat, left, right, below, cats, goes, leaf, roots, first)

    def bins(self, x: np.ndarray) -> np.ndarray:
        """The bin of every entry; the last bin of a feature (a value without one) meets no condition."""
        out = np.empty(x.shape, dtype=np.int64)
        for j, size in enumerate(self.sizes()):
            if j in self.leaves.allowed:
                code = x[:, j].astype(int)
                out[:, j] = np.where((code >= 0) & (code < size - 1), code, size - 1)
            else:
                out[:, j] = np.where(x[:, j] > -np.inf, np.searchsorted(self.cuts[j], x[:, j]), size - 1)
        return out

    def sizes(self) -> list[int]:
        allowed = self.leaves.allowed
        return [allowed[j].shape[1] + 1 if j in allowed else len(c) + 2 for j, c in enumerate(self.cuts)]

    def edges(self, leaves: Leaves, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each leaf's bins of a feature begin (1) and end (-1): (first entry of each leaf, bin, sign)."""
        n = len(leaves)
        if j in leaves.allowed:
            step = np.diff(leaves.allowed[j].astype(np.int64), axis=1, prepend=0, append=0)
            owner, at = np.nonzero(step)
            return np.searchsorted(owner, np.arange(n + 1)), at, step[owner, at].astype(float)
        start = np.searchsorted(self.cuts[j], leaves.low[:, j], side="right")
        end = np.maximum(np.searchsorted(self.cuts[j], leaves.high[:, j]) + 1, start)
        return np.arange(n + 1) * 2, np.stack([start, end], axis=1).ravel(), np.tile([1.0, -1.0], n)

    def shapley(self, x: np.ndarray, c: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phi [n, m], base [n], prob [n]) for class ``c``."""
        here = np.flatnonzero(self.leaves.value[:, c])
        leaves = self.leaves.pick(here)
        value = leaves.value[:, c]
        used = np.flatnonzero((leaves.z < 1).any(axis=0)).tolist()  # the others contribute nothing
        sizes = self.sizes()
        subsets = [s for k in range(len(used) + 1) for s in combinations(used, k)] if len(used) <= SUBSET_FEATURES else []
        small = [s for s in subsets if not s or np.prod([sizes[j] for j in s], dtype=float) <= CELLS]
        cells = sum(np.prod([sizes[j] for j in s], dtype=float) for s in small)
        if not subsets or 16 * len(x) * len(leaves) <= cells:
            return shapley(leaves, x, np.full(len(x), c))
        n, m = len(x), len(used)
        bins = self.bins(x)
        phi = np.zeros((n, x.shape[1]))
        weight = {s: np.array([factorial(len(s) - 1) * factorial(m - len(s)) if j in s else -factorial(len(s)) * factorial(m - 1 - len(s))
                               for j in used]) / factorial(m) for s in subsets}
        edges = {j: self.edges(leaves, j) for j in used}
        for s in small:
            v = self._table(leaves, value, edges, sizes, used, s)[tuple(bins[:, j] for j in s)]
            if not s:
                base = np.full(n, float(v))
            if len(s) == m:
                prob = np.full(n, v)
            phi[:, used] += np.multiply.outer(np.broadcast_to(v, n), weight[s])
        large = [s for s in subsets if s not in set(small)]
        if large:
            more, prob = self._walk(here, leaves, value, bins, sizes, used, large, weight)
            phi[:, used] += more
        unknown = (bins == np.array(sizes) - 1).any(axis=1)
        return phi, base, np.where(unknown, 0.0, prob)

    def _table(self, leaves, value, edges, sizes, used, s) -> np.ndarray:
        """v(s) by the bins of ``s``, from the corners of the leaves."""
        w = value * np.prod(leaves.z[:, [j for j in used if j not in s]], axis=1)
        leaf, cell, stride = np.arange(len(w)), np.zeros(len(w), dtype=np.int64), 1
        for j in reversed(s):
            first, at, sign = edges[j]
            k = first[leaf + 1] - first[leaf]
            e = np.repeat(first[leaf] - np.cumsum(k) + k, k) + np.arange(k.sum())
            leaf, cell, w = np.repeat(leaf, k), np.repeat(cell, k) + at[e] * stride, np.repeat(w, k) * sign[e]
            stride *= sizes[j]
        v = np.bincount(cell, w, stride).reshape([sizes[j] for j in s])
        for axis in range(len(s)):
            np.cumsum(v, axis=axis, out=v)
        return v

    def _walk(self, here, leaves, value, bins, sizes, used, large, weight) -> tuple[np.ndarray, np.ndarray]:
        """(phi, prob) of the subsets ``large``: the leaves whose conditions fail only on features that one of these leaves out."""
        n, m = len(bins), len(used)
        slot = np.full(bins.shape[1], -1)
        slot[used] = np.arange(m)
        free = [tuple(j for j in used if j not in s) for s in large]  # with each set, all sets within it
        number = {sum(1 << slot[j] for j in f): i for i, f in enumerate(free)}
        masks = np.array(list(number))
        after = np.array([[number.get(mask | 1 << i, -1) for i in range(m)] for mask in masks.tolist()])
        within = ((masks[:, None] & masks) == masks[:, None]).astype(float)
        spread = within[:, :, None] * np.array([weight[s] for s in large])
        alive = np.zeros(len(self.feat), dtype=bool)
        parent = np.full(len(self.feat), -1)
        inner = np.flatnonzero(self.left >= 0)
        parent[self.left[inner]] = parent[self.right[inner]] = inner
        node = np.flatnonzero(np.isin(self.leaf, here))
        while len(node):
            alive[node] = True
            node = np.unique(parent[node])
            node = node[node >= 0]
            node = node[~alive[node]]
        place = np.full(len(self.leaves), -1)
        place[here] = np.arange(len(here))
        missing = ((bins[:, used] == np.array(sizes)[used] - 1) << np.arange(m)).sum(axis=1)
        begin = np.array([number.get(k, -1) for k in missing.tolist()])
        rows = np.flatnonzero(begin >= 0)
        phi, prob = np.zeros((n, m)), np.zeros(n)
        trees = max(1, FRONTIER // max(1, len(rows)))
        for a in range(0, len(self.roots), trees):
            lo, hi = np.searchsorted(leaves.tree, [self.first + a, self.first + a + trees])
            z = np.stack([np.prod(leaves.z[lo:hi][:, list(f)], axis=1) for f in free], axis=1) * value[lo:hi, None]
            terms = np.einsum("lf,ufi->lui", z, spread)
            roots = self.roots[a:a + trees]
            roots = roots[alive[roots]]
            for b in range(0, len(rows), FRONTIER):
                part = rows[b:b + FRONTIER]
                r, p = np.repeat(np.arange(len(part)), len(roots)), np.tile(roots, len(part))
                u = begin[part][r]
                mine = bins[part]
                while len(p):
                    at = self.leaf[p]
                    end = at >= 0
                    if end.any():
                        at, who, fails = place[at[end]], r[end], u[end]
                        got = terms[at - lo, fails]
                        for i in range(m):
                            phi[part, i] += np.bincount(who, got[:, i], len(part))
                        met = fails == number[0]
                        prob[part] += np.bincount(who[met], value[at[met]], len(part))
                        r, p, u = r[~end], p[~end], u[~end]
                    f = self.feat[p]
                    code = mine[r, f]
                    goes = code <= self.below[p]
                    if len(self.goes):
                        k = self.cats[p]
                        goes = np.where(k >= 0, self.goes[k, np.minimum(code, self.goes.shape[1] - 1)], goes)
                    left, right = self.left[p], self.right[p]
                    on, off = np.where(goes, left, right), np.where(goes, right, left)
                    then = after[u, slot[f]]
                    go, stray = alive[on], alive[off] & (then >= 0)
                    r, p, u = (np.concatenate(v) for v in ((r[go], r[stray]), (on[go], off[stray]), (u[go], then[stray])))
        return phi, prob


def subforests(trees: list[dict], n_features: int, size: int | None = None) -> Iterator[Subforest]:
    """The forest in groups of whole trees of about ``size`` bytes of leaves."""
    leaves = leaf_table(trees, n_features)
    per = max(1, int(len(trees) * (size or GROUP_BYTES) / max(leaves.nbytes, 1)))
    for a in range(0, len(trees), per):
        lo, hi = np.searchsorted(leaves.tree, [a, a + per])
        yield Subforest.of(trees[a:a + per], leaves.part(lo, hi), a)


def _buffered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of a task in few pieces: tables are built for each piece and class."""
    held, n = [], 0
    for pdf in batches:
        held.append(pdf)
        n += len(pdf)
        if n >= ROWS:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if n:
        yield pd.concat(held, ignore_index=True)


def explained(spark: SparkSession, pipeline_model, df: DataFrame, key: str, raw_col: str = "raw") -> DataFrame:
    """(row_id, x, pred_class, phi, base, prob): one row per row of ``df``."""
    scored = pipeline_model.transform(df).select(F.col(key).cast("long").alias("row_id"), vector_to_array(raw_col).alias("x"),
                                                 F.col("prediction").cast("int").alias("pred_class"))
    trees = forest_tables(spark, pipeline_model.stages[-1])
    n_features = pipeline_model.stages[-1].numFeatures
    out = scored.repartitionByRange(TASKS * spark.sparkContext.defaultParallelism, "pred_class", "row_id", "x")
    out = out.withColumn("phi", F.array_repeat(F.lit(0.0), n_features)).withColumn("base", F.lit(0.0)).withColumn("prob", F.lit(0.0))
    for group in subforests(trees, n_features):
        shared = spark.sparkContext.broadcast(group)

        def run(batches, shared=shared):
            for pdf in _buffered(batches):
                x, cls = np.stack(pdf["x"].to_numpy()), pdf["pred_class"].to_numpy()
                phi, base, prob = np.stack(pdf["phi"].to_numpy()), pdf["base"].to_numpy().copy(), pdf["prob"].to_numpy().copy()
                for c in np.unique(cls):
                    at = np.flatnonzero(cls == c)
                    more = shared.value.shapley(x[at], int(c))
                    phi[at] += more[0]
                    base[at] += more[1]
                    prob[at] += more[2]
                yield pdf.assign(phi=list(phi), base=base, prob=prob)

        out = out.mapInPandas(run, out.schema)
    return out


def _parts(names: list[str]):
    one = [F.struct(F.lit(f).alias("feature"), F.col("x")[i].alias("value"), F.col("phi")[i].alias("contribution")) for i, f in enumerate(names)]
    return F.array(*one)


def explain_rows(spark: SparkSession, pipeline_model, df: DataFrame, key: str, feature_names: list[str], raw_col: str = "raw") -> DataFrame:
    """Long table (row_id, pred_class, feature, value, contribution, base, prob) for every row of ``df``."""
    e = explained(spark, pipeline_model, df, key, raw_col)
    return (e.select("row_id", "pred_class", "base", "prob", F.inline(_parts(feature_names)))
            .select("row_id", "pred_class", "feature", "value", "contribution", "base", "prob"))


def explain_top(spark: SparkSession, pipeline_model, df: DataFrame, key: str, feature_names: list[str], raw_col: str = "raw",
                n_pos: int = 3, n_neg: int = 2) -> DataFrame:
    """The largest contributions of each sign per row, chosen within the row (no shuffle)."""
    e = explained(spark, pipeline_model, df, key, raw_col)
    return (e.select("row_id", "pred_class", "base", "prob", F.inline(top_of_row(_parts(feature_names), n_pos, n_neg)))
            .select("row_id", "pred_class", "feature", "value", "contribution", "base", "prob", "sign", "rank"))
