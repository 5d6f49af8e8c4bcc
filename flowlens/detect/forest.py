"""Isolation forest: trees grown on small hashed samples, one Spark group per tree."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from flowlens.detect.base import Detector, prepared
from flowlens.functions.hashing import unit_interval
from flowlens.operators.quantiles import exact_percentiles
from flowlens.operators.schema import check_feature_count
from flowlens.session import keep

NODES = "tree int, node int, feature int, threshold double, left int, right int, size int, depth int"
EULER = 0.5772156649015329


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search among ``n`` points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3.0)
    many = 2.0 * (np.log(safe - 1.0) + EULER) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, many))


def grow_tree(points: np.ndarray, tree: int, seed: int, columns: np.ndarray, max_depth: int) -> pd.DataFrame:
    """Random splits of one sample until points are alone, equal or too deep."""
    rng = np.random.default_rng([seed, tree])
    nodes: list[list] = []
    todo = [(np.arange(len(points)), 0, -1, "")]
    while todo:
        rows, depth, parent, side = todo.pop()
        node = len(nodes)
        if parent >= 0:
            nodes[parent][4 if side == "left" else 5] = node
        low, high = points[rows][:, columns].min(axis=0), points[rows][:, columns].max(axis=0)
        varied = np.flatnonzero(high > low)
        if len(rows) <= 1 or depth >= max_depth or len(varied) == 0:
            nodes.append([tree, node, -1, 0.0, node, node, len(rows), depth])
            continue
        pick = rng.choice(varied)
        cut = rng.uniform(low[pick], high[pick])
        if cut >= high[pick]:
            cut = low[pick]
        goes_left = points[rows, columns[pick]] <= cut
        nodes.append([tree, node, int(columns[pick]), float(cut), -1, -1, len(rows), depth])
        todo.append((rows[~goes_left], depth + 1, node, "right"))
        todo.append((rows[goes_left], depth + 1, node, "left"))
    return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "left", "right", "size", "depth"])


class IsolationForest:
    """D1. ``keys`` identify a row; samples follow the hash of keys and features, so layout does not matter."""

    def __init__(self, features: list[str], keys: list[str], n_trees: int = 100, max_samples: int = 256,
                 contamination: float | str = 0.1, max_features: float = 1.0, seed: int = 42, scaler=None):
        self.features, self.keys, self.n_trees, self.max_samples = list(features), list(keys), n_trees, max_samples
        self.contamination, self.max_features, self.seed, self.scaler = contamination, max_features, seed, scaler

    def fit(self, df: DataFrame) -> "IsolationForestModel":
        check_feature_count(df, self.features)
        n = df.count()
        psi = min(self.max_samples, n)
        if psi < 2:
            raise ValueError("an isolation forest needs at least two rows")
        nodes = self._nodes(df, n, psi)
        model = IsolationForestModel.from_nodes(nodes, self.features, psi, self.scaler)
        if self.contamination == "auto":
            model.threshold = -0.5
        else:
            scores = keep(df.select(model.raw_score().alias("s")))
            model.threshold = exact_percentiles(scores, ["s"], [float(self.contamination)])[
                ("s", float(self.contamination))]
            scores.unpersist()
        return model

    def _nodes(self, df: DataFrame, n: int, psi: int) -> DataFrame:
        seed, d, depth = self.seed, len(self.features), math.ceil(math.log2(psi))
        chosen = max(1, int(self.max_features * d))
        # Twice the sample and a margin, so that a root is never short.
        wanted = 2 * psi + 40
        pool_share = min(1.0, 4.0 * self.n_trees * wanted / n)
        draw = min(1.0, wanted / (n * pool_share))
        x = prepared(self.features, self.scaler)
        hashed = df.select(
            F.array(*[x[f] for f in self.features]).alias("x"),
            F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in self.keys],
                              *[F.col(f).cast("string") for f in self.features], F.lit(str(seed)))).alias("h"))
        # Full copies are one row with a weight. The pool keeps floor(weight * share + u) copies of it, a tree draws from
        # those in the same way: a value held by many rows has its share in the pool and in every root.
        weighted = hashed.groupBy("h", "x").agg(F.count("*").alias("m"))
        if pool_share < 1:
            kept = F.floor(F.col("m") * F.lit(pool_share) + unit_interval(F.col("h")))
            weighted = weighted.select("h", "x", kept.alias("m")).where("m > 0")

        def uniform(t: Column) -> Column:
            return F.pmod(F.xxhash64(F.col("h"), t), F.lit(1 << 30)) / F.lit(float(1 << 30))

        def copies(t: Column) -> Column:
            return F.floor(F.col("m") * F.lit(draw) + uniform(t)).cast("int")

        trees = F.sequence(F.lit(0), F.lit(self.n_trees - 1))
        hit = F.filter(F.transform(trees, lambda t: F.struct(t.alias("tree"), copies(t).alias("n"))),
                       lambda s: s["n"] > 0)
        drawn = (
            weighted.select("x", "h", F.inline(hit))
            .select("x", "h", "tree", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
        )
        place = F.row_number().over(Window.partitionBy("tree").orderBy(F.xxhash64("h", "tree", "copy"), "h", "copy"))
        sample = drawn.withColumn("place", place).where(F.col("place") <= psi).select("tree", "x")

        def build(group: pd.DataFrame) -> pd.DataFrame:
            points = np.stack(group["x"].to_numpy())
            points = points[np.lexsort(points.T)]  # the order of rows inside a group is not defined
            tree = int(group["tree"].iloc[0])
            columns = np.sort(np.random.default_rng([seed, tree, 1]).choice(d, chosen, replace=False))
            return grow_tree(points, tree, seed, columns, depth)

        return sample.groupBy("tree").applyInPandas(build, NODES)


class IsolationForestModel(Detector):
    kind = "isolation_forest"
    higher_is_worse = False

    @classmethod
    def from_nodes(cls, nodes: DataFrame, features: list[str], psi: int, scaler=None,
                   threshold: float = -0.5) -> "IsolationForestModel":
        """The node table has at most ``trees * (2 * psi - 1)`` rows: it is model state and fits every executor."""
        table = nodes.toPandas().sort_values(["tree", "node"]).reset_index(drop=True)
        model = cls()
        model.features, model.scaler, model.psi, model.threshold = list(features), scaler, psi, threshold
        model.table = {c: table[c].to_numpy() for c in table.columns}
        return model

    def _flat(self) -> dict[str, np.ndarray]:
        """All trees in one index space; leaves point to themselves."""
        t = self.table
        starts = np.flatnonzero(t["node"] == 0)
        base = np.repeat(starts, np.diff(np.append(starts, len(t["node"]))))
        return {"roots": starts, "feature": np.maximum(t["feature"], 0), "threshold": t["threshold"],
                "left": t["left"] + base, "right": t["right"] + base, "is_leaf": t["feature"] < 0,
                "path": t["depth"] + average_path(t["size"]), "levels": np.array(int(t["depth"].max()))}

    def path_length(self):
        """Mean path length per row, as a function of a matrix."""
        flat = self._flat()

        def mean_path(rows: np.ndarray) -> np.ndarray:
            out = np.empty(len(rows))
            for start in range(0, len(rows), 4096):
                x = rows[start:start + 4096]
                at = np.broadcast_to(flat["roots"], (len(x), len(flat["roots"]))).copy()
                line = np.arange(len(x))[:, None]
                for _ in range(int(flat["levels"])):
                    left = x[line, flat["feature"][at]] <= flat["threshold"][at]
                    at = np.where(left, flat["left"][at], flat["right"][at])
                out[start:start + 4096] = flat["path"][at].mean(axis=1)
            return out

        return mean_path

    def matrix_score(self):
        mean_path, norm = self.path_length(), float(average_path(self.psi))
        return lambda rows: -np.exp2(-mean_path(rows) / norm)

    def decision(self, raw: Column) -> Column:
        """Negative for anomalies."""
        return raw - F.lit(self.threshold)

    def prediction(self, raw: Column) -> Column:
        return (self.decision(raw) < 0).cast("int")

    def probability(self, raw: Column) -> Column:
        return forest_probability(self.decision(raw))

    def nodes_frame(self, spark: SparkSession) -> DataFrame:
        frame = pd.DataFrame(self.table)
        return spark.createDataFrame(frame, NODES)

    def feature_importance(self, spark: SparkSession, with_data: bool = True) -> DataFrame:
        """Share of splits per feature; without data every feature counts the same."""
        if not with_data:
            share = 1.0 / len(self.features)
            return spark.createDataFrame([(f, share) for f in self.features], "feature string, importance double")
        return split_importance(self.nodes_frame(spark), self.features)

    def metadata(self) -> dict:
        return {"psi": int(self.psi), "trees": int(self.table["tree"].max()) + 1}

    def arrays(self) -> dict[str, np.ndarray]:
        return {name: np.asarray(values, dtype=float) for name, values in self.table.items()}

    @classmethod
    def restore(cls, metadata, arrays):
        model = cls()
        model.psi = metadata["psi"]
        model.table = {n: a if n == "threshold" else a.astype(int) for n, a in arrays.items()}
        return model


def forest_probability(decision: Column) -> Column:
    """D3."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(5.0) * decision))


def split_importance(nodes: DataFrame, features: list[str]) -> DataFrame:
    """D4 on a node table (at most a few ten thousand rows)."""
    names = F.array(*[F.lit(f) for f in features])
    counts = nodes.where("feature >= 0").groupBy("feature").agg(F.count("*").alias("n"))
    every = nodes.sparkSession.range(len(features)).select(F.col("id").cast("int").alias("feature"))
    total = F.sum("n").over(Window.partitionBy())
    return every.join(counts, "feature", "left").select(
        names[F.col("feature")].alias("feature"),
        F.coalesce(F.when(total > 0, F.col("n") / total), F.lit(0.0)).alias("importance"))
