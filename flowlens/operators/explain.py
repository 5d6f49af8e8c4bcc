"""Feature contributions of scores (X1-X7) as batch jobs.

A scorer is any picklable function from a matrix of (scaled) features to one score per row; every detector has one. The
background is a seeded sample of at most a few hundred rows, so it is the only data a task receives besides its rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from flowlens.detect.base import Detector, matrix_column, prepared
from flowlens.operators.sampling import sample_n

Scorer = Callable[[np.ndarray], np.ndarray]
MAX_BACKGROUND = 1_000
ENUMERATE_UP_TO = 10
CELLS = 2_000_000     # masked cells scored at once
LINE_CELLS = 30_000   # cells of lines that gradients are summed along at once, few enough for a core's cache


def background_matrix(df: DataFrame, features: list[str], keys: list[str], n: int = 100, seed: int = 42,
                      scaler=None) -> np.ndarray:
    """A seeded sample of the background rows, scaled like the rows to explain."""
    if n > MAX_BACKGROUND:
        raise ValueError(f"a background of more than {MAX_BACKGROUND} rows is not sent to tasks; take a smaller sample")
    sample = sample_n(df.select(*keys, *features), keys, n, seed)
    rows = sample.select(prepared(features, scaler).alias("x"), *keys).orderBy(*keys).select("x.*").collect()
    return np.array([tuple(r) for r in rows], dtype=float)


def frame_scorer(function: Callable[[pd.DataFrame], pd.Series], features: list[str]) -> Scorer:
    """A user function over a pandas frame of features as a matrix scorer."""
    return lambda rows: np.asarray(function(pd.DataFrame(rows, columns=features)), dtype=float)


def coalitions(m: int, nsamples: int | None, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """0/1 rows and their weights: all subsets if they are no more than ``nsamples`` (or of few features, where no number is
    given), else that many paired draws by subset size."""
    if 2**m - 2 <= nsamples if nsamples else m <= ENUMERATE_UP_TO:
        masks = np.array([z for z in itertools.product((0.0, 1.0), repeat=m) if 0 < sum(z) < m]).reshape(-1, m)
        sizes = masks.sum(axis=1).astype(int)
        return masks, np.array([(m - 1) / (math.comb(m, s) * s * (m - s)) for s in sizes])
    nsamples = nsamples or 2 * m + 2048
    rng = np.random.default_rng(seed)
    sizes = np.arange(1, m)
    share = 1.0 / (sizes * (m - sizes))
    masks = np.zeros((nsamples, m))
    for i in range(0, nsamples - 1, 2):
        chosen = rng.choice(m, rng.choice(sizes, p=share / share.sum()), replace=False)
        masks[i, chosen] = 1.0
        masks[i + 1] = 1.0 - masks[i]
    if nsamples % 2:
        masks[-1, rng.choice(m, m // 2, replace=False)] = 1.0
    return masks, np.ones(len(masks))


def projection(masks: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted least squares for the first m-1 contributions; the last follows from additivity. A tiny ridge keeps a
    poorly sampled system solvable."""
    z = masks[:, :-1] - masks[:, -1:]
    gram = z.T @ (weights[:, None] * z)
    ridge = 1e-12 * np.trace(gram) / max(1, len(gram))
    return np.linalg.solve(gram + ridge * np.eye(len(gram)), (weights[:, None] * z).T)


def kernel_contributions(score: Scorer, background: np.ndarray, nsamples: int | None = None, seed: int = 42) -> Scorer:
    """A function from rows to their contributions; all rows share one coalition matrix and one projection."""
    m = background.shape[1]
    base = float(score(background).mean())
    if m == 1:
        return lambda rows: (score(rows) - base)[:, None]
    masks, weights = coalitions(m, nsamples, seed)
    solve = projection(masks, weights)
    b = len(background)

    def contributions(rows: np.ndarray) -> np.ndarray:
        out = np.empty((len(rows), m))
        step = max(1, CELLS // (len(masks) * b * m))
        for at in range(0, len(rows), step):
            block = rows[at:at + step]
            values = np.empty((len(block), len(masks)))
            per = max(1, CELLS // (len(block) * b * m))
            for c in range(0, len(masks), per):
                z = masks[c:c + per, None, :]
                mixed = block[:, None, None, :] * z + background * (1.0 - z)
                values[:, c:c + per] = score(mixed.reshape(-1, m)).reshape(len(block), -1, b).mean(axis=2)
            full = score(block) - base
            rest = (values - base - masks[:, -1] * full[:, None]) @ solve.T
            out[at:at + step, :-1] = rest
            out[at:at + step, -1] = full - rest.sum(axis=1)
        return out

    return contributions


def explain(df: DataFrame, features: list[str], score: Scorer, background: np.ndarray, nsamples: int | None = None,
            scaler=None, seed: int = 42) -> DataFrame:
    """``shap`` (array aligned with ``features``) and ``expected_value``."""
    contributions = kernel_contributions(score, background, nsamples, seed)
    return df.withColumns({
        "shap": matrix_column(contributions, prepared(features, scaler), "array<double>"),
        "expected_value": F.lit(expected_value(score, background)),
    })


def expected_value(score: Scorer, background: np.ndarray) -> float:
    """Mean score of the background."""
    return float(score(background).mean())


def explain_linear(df: DataFrame, weights: dict[str, float], means: dict[str, float], scaler=None,
                   base: float | None = None) -> DataFrame:
    """X1 for a linear score: weight * (x - background mean), exact and without leaving the JVM.

    ``means`` are those of the background as the score sees it; with a scaler (or a ``base`` value) features are prepared
    as for scoring.
    """
    if scaler is None and base is None:
        return df.withColumn("shap", F.array(*[F.lit(w) * (F.col(f) - F.lit(means[f])) for f, w in weights.items()]))
    x = prepared(list(weights), scaler)
    shap = F.array(*[F.lit(float(w)) * (x.getField(f) - F.lit(float(means[f]))) for f, w in weights.items()])
    return df.withColumns({"shap": shap, "expected_value": F.lit(base)})


def top_features(features: list[str], shap: Column, k: int = 10) -> Column:
    """``array<struct<feature,shap_value,feature_value,importance>>``, largest first, ties by feature order."""
    entries = F.array(*[
        F.struct((-F.abs(shap[i])).alias("_rank"), F.lit(i).alias("_i"), F.lit(f).alias("feature"),
                 shap[i].alias("shap_value"), F.col(f).cast("double").alias("feature_value"),
                 F.abs(shap[i]).alias("importance"))
        for i, f in enumerate(features)])
    return F.transform(F.slice(F.array_sort(entries), 1, k), lambda e: F.struct(
        e["feature"].alias("feature"), e["shap_value"].alias("shap_value"), e["feature_value"].alias("feature_value"),
        e["importance"].alias("importance")))


def explain_batch(df: DataFrame, features: list[str], n_top: int = 3, shap: str = "shap",
                  keep: list[str] | None = None) -> DataFrame:
    """One wide row per flow: ``top_i_feature``, ``top_i_contribution``, ``top_i_value``."""
    top = df.withColumn("_top", top_features(features, F.col(shap), n_top))
    n = min(n_top, len(features))
    columns = []
    for i in range(n):
        item = F.col("_top")[i]
        columns += [item["feature"].alias(f"top_{i + 1}_feature"),
                    item["shap_value"].alias(f"top_{i + 1}_contribution"),
                    item["feature_value"].alias(f"top_{i + 1}_value")]
    return top.select(*(keep or []), *columns)


def summary(df: DataFrame, features: list[str], shap: str = "shap", top: int = 20) -> DataFrame:
    """Mean absolute contribution per feature, largest first."""
    names = F.array(*[F.lit(f) for f in features])
    return (
        df.select(F.posexplode(shap).alias("i", "v"))
        .groupBy(names[F.col("i")].alias("feature"))
        .agg(F.avg(F.abs("v")).alias("mean_abs_shap"))
        .orderBy(F.col("mean_abs_shap").desc(), "feature").limit(top)
    )


# ---- trees ---------------------------------------------------------------------------------------------------------

#: Numbers in the tables of leaf contributions; a forest that needs more is explained in the linear form.
MAX_TABLE = 8_000_000
#: Numbers in the tables of subset values, which a task makes for itself from the trees, and the features they are made for.
MAX_GRID, GRID_FEATURES = 32_000_000, (2, 3, 4)
#: Rows that are explained at once.
TREE_ROWS = 1024


class _Forest:
    """Node arrays of all trees in one index space, level by level, with the share of training points of every edge."""

    def __init__(self, table: dict[str, np.ndarray]):
        roots = np.flatnonzero(table["node"] == 0)
        base = np.repeat(roots, np.diff(np.append(roots, len(table["node"]))))
        self.roots, self.feature, self.threshold = roots, table["feature"], table["threshold"]
        self.left, self.right = table["left"] + base, table["right"] + base
        size = table["size"].astype(float)
        self.inner = self.feature >= 0
        self.share = np.ones(len(size))  # of the parent's points, by child
        for child in (self.left, self.right):
            self.share[child[self.inner]] = size[child[self.inner]] / size[self.inner]
        levels, at = [], roots
        while len(at):
            levels.append(at)
            at = at[self.inner[at]]
            at = np.concatenate([self.left[at], self.right[at]])
        self.levels = levels

    def path_shares(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        """By node and feature: the share of points that pass the feature's splits on the path, and whether it has any."""
        shares, used = np.ones((len(self.feature), d)), np.zeros((len(self.feature), d), bool)
        for at in self.levels:
            at = at[self.inner[at]]
            for child in (self.left[at], self.right[at]):
                shares[child], used[child] = shares[at], used[at]
                shares[child, self.feature[at]] *= self.share[child]
                used[child, self.feature[at]] = True
        return shares, used


def _quadrature(longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Gauss-Legendre nodes and weights on [0, 1], exact for the products along a path of so many features."""
    points, weights = np.polynomial.legendre.leggauss(max(1, (longest + 1) // 2))
    return (points + 1.0) / 2.0, weights / 2.0


def tree_contributions(model) -> tuple[Scorer, float]:
    """Path-dependent contributions to the mean path length of an isolation forest, and their base value.

    For each leaf the chance to reach it factors over the features on its path: 1 or 0 for a known feature, the share of
    training points for an unknown one. The Shapley weights of such a product are an integral of a polynomial, exact by a
    few quadrature points. With very few features the value of every set of known features is looked up instead, in a table
    per tree; with few features the contributions of a leaf are a table by which features the row meets;
    else a pass down and up each tree shares the products of common paths, linear in its nodes.
    """
    from flowlens.detect.forest import average_path

    table, d = model.table, len(model.features)
    forest, value = _Forest(table), table["depth"] + average_path(table["size"])
    leaves = np.concatenate([at[~forest.inner[at]] for at in forest.levels])
    shares, used = forest.path_shares(d)
    n_trees = len(forest.roots)
    base = float((value[leaves] * shares[leaves].prod(axis=1)).sum() / n_trees)
    if d in GRID_FEATURES and _Grids.size(forest, d) <= MAX_GRID:
        explain_block = _Grids(forest, leaves, value[leaves], shares[leaves], base * n_trees)
    elif len(leaves) * d * 2.0 ** d <= MAX_TABLE:
        explain_block = _by_tables(forest, leaves, value[leaves], shares[leaves], used[leaves])
    else:
        explain_block = _by_paths(forest, value, int(used.sum(axis=1).max()))

    def contributions(rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), d))
        for i in range(0, len(rows), TREE_ROWS):
            out[i : i + TREE_ROWS] = explain_block(np.ascontiguousarray(rows[i : i + TREE_ROWS].T)).T
        return out / n_trees

    return contributions, base


def _by_tables(forest: _Forest, leaves: np.ndarray, value: np.ndarray, shares: np.ndarray, used: np.ndarray):
    """A leaf's contributions by the set of features whose splits on its path the row passes."""
    d = shares.shape[1]
    t, wt = _quadrature(d)
    passed = (np.arange(1 << d)[:, None] >> np.arange(d) & 1).astype(float)  # by set and feature
    tables = np.empty((d, len(leaves), 1 << d))
    for i in range(0, len(leaves), 512):
        part = slice(i, i + 512)
        share = np.where(used[part], shares[part], 1.0)[:, None, :]
        change = np.where(used[part][:, None, :], passed[None], 1.0) - share
        factors = share[..., None] + t * change[..., None]  # never 0: shares are above 0 and t below 1
        product = factors.prod(axis=2)
        for j in range(d):
            tables[j, part] = value[part, None] * change[:, :, j] * ((product / factors[:, :, j]) @ wt)
    tables = tables.reshape(d, -1)
    kind = np.min_scalar_type((1 << d) - 1)
    slot = np.full(len(forest.feature), -1)
    slot[leaves] = np.arange(len(leaves))

    def block(x: np.ndarray) -> np.ndarray:
        out = np.zeros(x.shape)
        at, sets = forest.roots, np.full((len(forest.roots), x.shape[1]), (1 << d) - 1, kind)
        while len(at):
            inner = forest.inner[at]
            ends, own = at[~inner], sets[~inner]
            for i in range(0, len(ends), 64):
                places = own[i : i + 64] + (slot[ends[i : i + 64]] << d)[:, None]
                for j in range(d):
                    out[j] += tables[j].take(places).sum(axis=0)
            at, sets = at[inner], sets[inner]
            if not len(at):
                break
            feature = forest.feature[at]
            less = x[feature] <= forest.threshold[at][:, None]
            lost = np.invert(np.left_shift(1, feature).astype(kind))[:, None]
            full = kind.type((1 << d) - 1)
            sets = np.concatenate([sets & np.where(less, full, lost), sets & np.where(less, lost, full)])
            at = np.concatenate([forest.left[at], forest.right[at]])
        return out

    return block


class _Grids:
    """The value of every proper subset of known features by the row's place among a tree's thresholds, and one walk down the
    tree for all features; Shapley values are fixed sums of them. Travels as the trees; the tables are made where it runs."""

    def __init__(self, forest: _Forest, leaves: np.ndarray, value: np.ndarray, shares: np.ndarray, empty: float):
        self.forest, self.leaves, self.value, self.shares, self.empty = forest, leaves, value, shares, empty
        self.tables = None

    def __getstate__(self):
        return vars(self) | {"tables": None}

    @staticmethod
    def size(forest: _Forest, d: int) -> float:
        tree = np.searchsorted(forest.roots, np.arange(len(forest.feature)), "right") - 1
        bins = np.array([np.bincount(tree[forest.feature == j], minlength=len(forest.roots)) + 1.0 for j in range(d)])
        return float(sum(bins[list(s)].prod(axis=0).sum() for k in range(1, d) for s in itertools.combinations(range(d), k)))

    def _make(self, d: int) -> None:
        f = self.forest
        low, high = np.full((len(f.feature), d), -np.inf), np.full((len(f.feature), d), np.inf)
        for at in f.levels:
            at = at[f.inner[at]]
            for child, edge in ((f.left[at], high), (f.right[at], low)):
                low[child], high[child] = low[at], high[at]
                edge[child, f.feature[at]] = f.threshold[at]
        tree = np.searchsorted(f.roots, self.leaves, "right") - 1
        ends = np.append(f.roots, len(f.feature))
        self.cuts = [np.unique(f.threshold[f.feature == j]) for j in range(d)]
        sets = [s for k in range(1, d) for s in itertools.combinations(range(d), k)]
        tables = []
        for r in range(len(f.roots)):
            nodes = np.arange(ends[r], ends[r + 1])
            mine = tree == r
            bins, meets = [], []
            for j in range(d):
                cuts = np.unique(f.threshold[nodes[f.feature[nodes] == j]])
                bins.append(np.searchsorted(cuts, np.append(self.cuts[j], np.inf), "left").astype(np.int32))
                first = np.searchsorted(cuts, low[self.leaves[mine], j], "right")
                last = np.searchsorted(cuts, high[self.leaves[mine], j], "left")
                place = np.arange(len(cuts) + 1)
                meets.append(((place >= first[:, None]) & (place <= last[:, None])).astype(float))
            grids = []
            for s in sets:
                weight = self.value[mine] * self.shares[mine][:, [j for j in range(d) if j not in s]].prod(axis=1)
                grid = weight[:, None]
                for j in s[:-1]:
                    grid = (grid[:, :, None] * meets[j][:, None, :]).reshape(len(grid), -1)
                grids.append((grid.T @ meets[s[-1]]).ravel())
            leaf = np.zeros(len(nodes))
            leaf[self.leaves[mine] - ends[r]] = self.value[mine]
            inner = f.inner[nodes]
            to = np.stack([np.where(inner, f.left[nodes] - ends[r], np.arange(len(nodes))),
                           np.where(inner, f.right[nodes] - ends[r], np.arange(len(nodes)))], axis=1).ravel()
            tables.append((bins, [m.shape[1] for m in meets], grids, np.maximum(f.feature[nodes], 0),
                           f.threshold[nodes], to, leaf))
        self.sets, self.tables = sets, tables

    def __call__(self, x: np.ndarray) -> np.ndarray:
        d, n = x.shape
        if self.tables is None:
            self._make(d)
        ranks = [np.searchsorted(self.cuts[j], x[j], "left") for j in range(d)]
        values, full = np.zeros((len(self.sets), n)), np.zeros(n)
        flat, line, depth = x.ravel(), np.arange(n), len(self.forest.levels) - 1
        for bins, sizes, grids, feature, threshold, to, leaf in self.tables:
            own = [bins[j].take(ranks[j]) for j in range(d)]
            places: dict[tuple, np.ndarray] = {}
            for i, s in enumerate(self.sets):
                places[s] = own[s[0]] if len(s) == 1 else places[s[:-1]] * sizes[s[-1]] + own[s[-1]]
                values[i] += grids[i].take(places[s])
            start = feature * n
            at = np.zeros(n, np.intp)
            for _ in range(depth):
                at = to.take(2 * at + (flat.take(start.take(at) + line) > threshold.take(at)))
            full += leaf.take(at)
        out = np.zeros((d, n))
        every = [((), np.full(n, self.empty)), *zip(self.sets, values), (tuple(range(d)), full)]
        for s, v in every:
            k = len(s)
            for j in range(d):
                out[j] += v * (1.0 / (d * math.comb(d - 1, k - 1)) if j in s else -1.0 / (d * math.comb(d - 1, k)))
        return out


def _by_paths(forest: _Forest, value: np.ndarray, longest: int):
    """The linear form: products of factors go down a tree, their sums over leaves come up, and every edge adds what its
    feature gains over the feature's edge before on the path."""
    t, wt = _quadrature(longest)
    q = len(t)

    def block(x: np.ndarray) -> np.ndarray:
        out, n = np.zeros(x.shape), x.shape[1]

        def walk(node: int, product: np.ndarray, path: dict[int, tuple[float, np.ndarray]]) -> np.ndarray:
            if not forest.inner[node]:
                return product * value[node]
            f = int(forest.feature[node])
            less = x[f] <= forest.threshold[node]
            before_share, before = path.get(f, (1.0, np.ones(n, bool)))
            total = np.zeros((q, n))
            for child, goes in ((int(forest.left[node]), less), (int(forest.right[node]), ~less)):
                share, inside = before_share * forest.share[child], before & goes
                new = np.where(inside, share + t[:, None] * (1 - share), share * (1 - t[:, None]))
                old = np.where(before, before_share + t[:, None] * (1 - before_share), before_share * (1 - t[:, None]))
                sums = walk(child, product * (new / old), {**path, f: (share, inside)})
                gain = (inside - share) / new - ((before - before_share) / old if f in path else 0.0)
                out[f] += wt @ (sums * gain)
                total += sums
            return total

        for root in forest.roots:
            walk(int(root), np.ones((q, n)), {})
        return out

    return block


def explain_forest(df: DataFrame, model) -> DataFrame:
    """``shap`` and ``expected_value`` for the mean path length (shorter is more anomalous)."""
    contributions, base = tree_contributions(model)
    return df.withColumns({
        "shap": matrix_column(contributions, prepared(model.features, model.scaler), "array<double>"),
        "expected_value": F.lit(base),
    })


# ---- networks ------------------------------------------------------------------------------------------------------

def gradient_contributions(gradient: Scorer, background: np.ndarray, steps: int = 20) -> Scorer:
    """Gradients of the score, integrated from every background row to the explained row, averaged.

    A gradient that can be summed ``along`` lines is asked for the whole sum of many of them.
    """
    points, weights = np.polynomial.legendre.leggauss(steps)
    t, wt = (points + 1.0) / 2.0, weights / 2.0
    d = background.shape[1]

    def contributions(rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), d))
        step = max(1, LINE_CELLS // (len(background) * d))
        for at in range(0, len(rows), step):
            delta = rows[at:at + step, None, :] - background
            if hasattr(gradient, "along"):
                across = np.ascontiguousarray(delta.reshape(-1, d).T)
                total = gradient.along(np.tile(background.T, len(delta)), across, t, wt)
                if total is not None:
                    out[at:at + step] = (total * across).reshape(d, len(delta), -1).mean(axis=2).T
                    continue
            total = np.zeros_like(delta)
            for u, w in zip(t, wt):
                total += w * gradient((background + u * delta).reshape(-1, d)).reshape(delta.shape)
            out[at:at + step] = (total * delta).mean(axis=1)
        return out

    return contributions


def explain_network(df: DataFrame, model, background: np.ndarray, steps: int = 20) -> DataFrame:
    """Contributions to the anomaly score of an autoencoder."""
    contributions = gradient_contributions(model.error_gradient(), background, steps)
    return df.withColumns({
        "shap": matrix_column(contributions, prepared(model.features, model.scaler), "array<double>"),
        "expected_value": F.lit(expected_value(model.matrix_score(), background)),
    })


def explain_model(df: DataFrame, model: Detector, background_rows: DataFrame, keys: list[str], n_background: int = 100,
                  nsamples: int | None = None, seed: int = 42, method: str = "auto") -> DataFrame:
    """The fitting method per model: trees for a forest, the closed form for a linear score, gradients for networks, else
    the kernel method."""
    if method == "auto" and model.kind == "isolation_forest":
        return explain_forest(df, model)
    background = background_matrix(background_rows, model.features, keys, n_background, seed, model.scaler)
    if method == "auto" and model.kind == "one_class_svm" and model.fmap.kernel == "linear":
        return explain_linear(df, dict(zip(model.features, model.weights)), dict(zip(model.features, background.mean(axis=0))),
                              model.scaler, expected_value(model.matrix_score(), background))
    if method == "auto" and hasattr(model, "error_gradient"):
        return explain_network(df, model, background)
    return explain(df, model.features, model.matrix_score(), background, nsamples, model.scaler, seed)
