"""One-class SVM as a distributed primal problem over an explicit feature map.

The kernel is replaced by a map z(x): random Fourier features for rbf, the identity for linear, all monomials for poly or,
where they are too many, a tensor sketch of them. ``svm_solver`` finds the shortest vector of the dual's hull in rounds of two
passes over the data, for any number of fits at once; no row leaves the executors. Rounds go on until the duality gap is
within ``tol`` of the squared length. With nu = 1 the first point, the mean of z over all rows, is already exact.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowlens.detect.base import Detector, matrix_column, prepared
from flowlens.detect.svm_solver import SAME, Problem, in_blocks, solve, sums
from flowlens.functions.numeric import ratio
from flowlens.operators.ordering import with_previous
from flowlens.operators.scale import FlowScaler
from flowlens.operators.schema import check_feature_count
from flowlens.functions.hashing import seeded_hash
from flowlens.session import materialise, spread

#: Columns of the exact polynomial map; beyond them a tensor sketch of ``SKETCH`` columns (or ``n_components``, if more).
MAX_MONOMIALS, SKETCH = 5_000, 2_048
#: Support vectors that travel with the scoring function; more of them are joined in blocks of that size.
VECTORS_PER_PASS, MAX_SENT = 2_000, 8_000
#: Flows in a chunk of such a join.
FLOWS_PER_CHUNK = 50_000
#: Rows whose pairs tell the error of a feature map.
ERROR_ROWS = 400


def pooled_gamma(df: DataFrame, features: list[str], rule: str | float = "scale") -> float:
    """``scale`` is 1 / (d * variance of all entries), ``auto`` is 1 / d, a number is itself."""
    if isinstance(rule, (int, float)):
        return float(rule)
    if rule == "auto":
        return 1.0 / len(features)
    return gamma_table(df, features).first()["gamma_scale"]


def gamma_table(df: DataFrame, features: list[str]) -> DataFrame:
    """D6 as one row, from one pass; the variance pools every entry of the matrix that is not missing."""
    sums = df.agg(*[F.coalesce(F.var_pop(f), F.lit(0.0)).alias(f"v{i}") for i, f in enumerate(features)],
                  *[F.coalesce(F.avg(f), F.lit(0.0)).alias(f"m{i}") for i, f in enumerate(features)],
                  *[F.count(f).cast("double").alias(f"n{i}") for i, f in enumerate(features)])
    d = float(len(features))

    def pooled(value) -> Column:
        return sum((F.col(f"n{i}") * value(i) for i in range(len(features))), F.lit(0.0)) / F.col("entries")

    sums = sums.withColumn("entries", sum((F.col(f"n{i}") for i in range(len(features))), F.lit(0.0)))
    sums = sums.withColumn("entries", F.when(F.col("entries") > 0, F.col("entries")))
    sums = sums.withColumn("center", pooled(lambda i: F.col(f"m{i}")))
    variance = pooled(lambda i: F.col(f"v{i}") + F.pow(F.col(f"m{i}") - F.col("center"), F.lit(2.0)))
    return sums.select(
        F.when(variance > 0, 1.0 / (d * variance)).otherwise(F.lit(1.0)).alias("gamma_scale"),
        F.lit(1.0 / d).alias("gamma_auto"))


class FeatureMap:
    """z(x) for one kernel; a few arrays of bounded size, drawn from a seed or given (a saved model's)."""

    def __init__(self, kernel: str, d: int, gamma: float, n_components: int, degree: int, coef0: float, seed: int,
                 arrays: dict[str, np.ndarray] | None = None):
        self.kernel, self.gamma, self.coef0, self.degree = kernel, gamma, coef0, degree
        self.arrays = dict(arrays or {})
        rng = np.random.default_rng(seed)
        if kernel == "rbf":
            if not self.arrays:
                self.arrays = {"frequencies": rng.normal(0.0, math.sqrt(2.0 * gamma), (d, n_components)),
                               "phases": rng.uniform(0.0, 2.0 * math.pi, n_components)}
        elif kernel == "poly":
            width = d + (coef0 > 0)
            self.sketched = "places" in self.arrays or math.comb(width + degree - 1, degree) > MAX_MONOMIALS
            if self.sketched and not self.arrays:
                size = 1 << (max(SKETCH, n_components) - 1).bit_length()
                self.arrays = {"places": rng.integers(0, size, (degree, width)).astype(float),
                               "signs": rng.choice([-1.0, 1.0], (degree, width)), "size": np.array([float(size)])}
            if not self.sketched:
                self.monomials = list(itertools.combinations_with_replacement(range(width), degree))
                self.weights = np.sqrt([math.factorial(degree) / math.prod(math.factorial(m.count(i)) for i in set(m))
                                        for m in self.monomials])
        elif kernel != "linear":
            raise ValueError("kernel is 'rbf', 'linear' or 'poly'; a sigmoid kernel can be scored but not trained")

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        if self.kernel == "rbf":
            phases = self.arrays["phases"]
            z = rows @ self.arrays["frequencies"]
            z += phases
            np.cos(z, out=z)
            z *= np.sqrt(2.0 / len(phases))
            return z
        if self.kernel == "linear":
            return rows
        x = math.sqrt(self.gamma) * rows
        if self.coef0 > 0:
            x = np.hstack([x, np.full((len(x), 1), math.sqrt(self.coef0))])
        if self.sketched:
            return np.concatenate([self._sketch(x[i : i + 1024]) for i in range(0, max(len(x), 1), 1024)])
        return np.stack([x[:, list(m)].prod(axis=1) for m in self.monomials], axis=1) * self.weights

    def _sketch(self, x: np.ndarray) -> np.ndarray:
        """Count sketches of x, one per factor, convolved: the product of two such vectors estimates the power kernel."""
        size = int(self.arrays["size"][0])
        product = np.ones((len(x), size // 2 + 1), complex)
        for places, signs in zip(self.arrays["places"].astype(int), self.arrays["signs"]):
            to = np.zeros((x.shape[1], size))
            to[np.arange(x.shape[1]), places] = signs
            product *= np.fft.rfft(x @ to, axis=1)
        return np.fft.irfft(product, size, axis=1)

    def kernel_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The kernel itself, for every pair of rows."""
        return _kernels(self.gamma, self.degree, self.coef0)[self.kernel](a, b)


def _kernels(gamma: float, degree: int, coef0: float) -> dict:
    return {
        "rbf": lambda a, b: np.exp(-gamma * np.maximum(
            (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * a @ b.T, 0.0)),
        "linear": lambda a, b: a @ b.T,
        "poly": lambda a, b: (gamma * (a @ b.T) + coef0) ** degree,
        "sigmoid": lambda a, b: np.tanh(gamma * (a @ b.T) + coef0),
    }


class OneClassSVM:
    """D5. Without ``max_iter`` a fit ends when its gap is within ``tol``, or fails; with it, it may end before and warns."""

    def __init__(self, features: list[str], nu: float = 0.1, kernel: str = "rbf", gamma: str | float = "scale",
                 degree: int = 3, coef0: float = 0.0, tol: float = 1e-3, max_iter: int | None = None,
                 n_components: int = 256, seed: int = 42, scale: bool = True):
        if not 0 < nu <= 1:
            raise ValueError("nu lies in (0, 1]")
        self.features, self.nu, self.kernel, self.gamma = list(features), nu, kernel, gamma
        self.degree, self.coef0, self.tol, self.max_iter = degree, coef0, tol, max_iter
        self.n_components, self.seed, self.scale = n_components, seed, scale

    def fit(self, df: DataFrame) -> "OneClassSVMModel":
        return fit_all(df, [self])[0]


def fit_all(df: DataFrame, estimators: list[OneClassSVM]) -> list["OneClassSVMModel"]:
    """Models of several estimators over the same features and rows, from shared passes."""
    first = estimators[0]
    if any((e.features, e.scale) != (first.features, first.scale) for e in estimators):
        raise ValueError("fits that share their passes need the same features and scaling")
    check_feature_count(df, first.features)
    scaler = FlowScaler(first.features).fit(df) if first.scale else None
    rows = spread(df.select(prepared(first.features, scaler).alias("x")))
    try:
        gammas = {rule: pooled_gamma(rows.select("x.*"), first.features, rule) for rule in {e.gamma for e in estimators}}
        # Rules for gamma that give the same number but for rounding share a map; on scaled features these two do.
        gammas = {rule: next(g for g in gammas.values() if math.isclose(g, gamma, rel_tol=SAME))
                  for rule, gamma in gammas.items()}
        maps: dict[tuple, FeatureMap] = {}
        problems = []
        for e in estimators:
            key = (e.kernel, gammas[e.gamma] if e.kernel != "linear" else 0.0, e.n_components, e.degree, e.coef0, e.seed)
            if key not in maps:
                maps[key] = FeatureMap(e.kernel, len(e.features), gammas[e.gamma], e.n_components, e.degree, e.coef0, e.seed)
            problems.append(Problem(maps[key], e.nu, e.tol, e.max_iter))
        total = solve(rows, problems)
    finally:
        rows.unpersist()
    models = []
    for e, p in zip(estimators, problems):
        model = OneClassSVMModel()
        model.features, model.scaler, model.fmap, model.weights = e.features, scaler, p.fmap, p.weights
        model.rho, model.threshold, model.nu, model.rounds, model.gap = p.rho, 0.0, e.nu, p.rounds, p.gap
        model.n_rows, model.seed = total, e.seed
        model.support = {"directions": np.stack([way[0] for way in p.ways]), "cuts": np.array([way[1] for way in p.ways]),
                         "shares": p.shares / np.array([way[2] for way in p.ways])}
        models.append(model)
    return models


class OneClassSVMModel(Detector):
    """Decision w.z(x) - rho, positive for normal rows."""

    kind = "one_class_svm"
    higher_is_worse = False
    support: dict[str, np.ndarray] | None = None

    def matrix_score(self):
        fmap, w, rho = self.fmap, self.weights, self.rho
        return in_blocks(lambda rows: fmap(rows) @ w - rho, len(w))

    def prediction(self, raw: Column) -> Column:
        return (raw < 0).cast("int")

    def probability(self, raw: Column) -> Column:
        return svm_probability(raw)

    def coefficient(self) -> Column:
        """A row's dual coefficient, the sum of share / rows over the solver's points that the row belongs to.

        The coefficients of the training rows sum to 1, none exceeds 1 / (nu n), and with them as weights the rows' z add
        up to the model's weights. Rows that are no support vectors have 0.
        """
        if self.support is None:
            raise ValueError("this model has no record of its support vectors")
        fmap, support = self.fmap, self.support
        directions, cuts, shares = support["directions"].T, support["cuts"], support["shares"]
        share = in_blocks(lambda rows: (fmap(rows) @ directions <= cuts) @ shares, len(directions))
        return matrix_column(share, prepared(self.features, self.scaler))

    def support_vectors(self, df: DataFrame, keys: list[str]) -> DataFrame:
        """Keys (the indices), ``coefficient`` and ``raw_score`` of the support vectors among the training rows."""
        scored = df.withColumn("coefficient", self.coefficient()).withColumn("raw_score", self.raw_score())
        return scored.select(*keys, "coefficient", "raw_score").where("coefficient > 0")

    def support_report(self, df: DataFrame) -> DataFrame:
        """Training rows on or outside the margin, support vectors and the sum of their coefficients, weights norm,
        offset, duality gap."""
        made = [] if self.support is None else [self.coefficient().alias("a")]
        rows = df.select(self.raw_score().alias("s"), *(made or [F.lit(None).cast("double").alias("a")]))
        return rows.agg(
            F.count("*").alias("rows"), F.count_if(F.col("s") <= 0).alias("support_rows"),
            F.count_if(F.col("a") > 0).alias("support_vectors"), F.sum("a").alias("coefficient_sum"),
            F.lit(float(self.rho)).alias("intercept"), F.lit(float(np.linalg.norm(self.weights))).alias("weight_norm"),
            F.lit(len(self.weights)).alias("n_components"), F.lit(float(self.gap)).alias("gap"))

    def support_rows(self, df: DataFrame) -> DataFrame:
        """The rows themselves."""
        return df.withColumn("raw_score", self.raw_score()).where("raw_score <= 0")

    def support_sum(self, df: DataFrame) -> np.ndarray:
        """The sum of coefficient times z over rows, one number per component: the weights, if these are the training rows."""
        fmap, support = self.fmap, self.support

        def weighted(rows: np.ndarray) -> np.ndarray:
            z = fmap(rows)
            return z * ((z @ support["directions"].T <= support["cuts"]) @ support["shares"])[:, None]

        rows = df.select(prepared(self.features, self.scaler).alias("x"))
        return sums(rows, [weighted], [(0, None, None)])[0][0, :-1]

    def kernel_error(self, df: DataFrame, rows: int = ERROR_ROWS) -> float:
        """Mean distance of z.z to the kernel over the pairs of some rows, in shares of the kernel's mean size."""
        n = df.count()
        spot = F.pmod(F.xxhash64(*self.features), F.lit(1 << 20)) / F.lit(float(1 << 20))
        some = df.select(*self.features).where(spot < min(1.0, 2 * rows / max(n, 1))).limit(rows)
        x = some.select(prepared(self.features, self.scaler).alias("x")).select("x.*").toPandas().to_numpy(dtype=float)
        if len(x) < 2:
            return 0.0
        z, pairs = self.fmap(x), ~np.eye(len(x), dtype=bool)
        exact = self.fmap.kernel_of(x, x)
        return float(np.abs(z @ z.T - exact)[pairs].mean() / max(np.abs(exact)[pairs].mean(), 1e-300))

    def weight_importance(self, spark: SparkSession) -> DataFrame:
        """D10, linear kernel only."""
        if self.fmap.kernel != "linear":
            raise ValueError("weights belong to features only with a linear kernel; use permutation importance")
        weights = spark.createDataFrame(list(zip(self.features, map(float, self.weights))),
                                        "feature string, weight double")
        return weight_importance(weights)

    def metadata(self) -> dict:
        m = self.fmap
        return {"kernel": m.kernel, "gamma": m.gamma, "degree": m.degree, "coef0": m.coef0, "rho": self.rho,
                "nu": self.nu, "rounds": self.rounds, "gap": self.gap, "rows": self.n_rows, "seed": self.seed,
                "components": len(self.weights)}

    def arrays(self) -> dict[str, np.ndarray]:
        return {"weights": self.weights, **{f"map_{name}": a for name, a in self.fmap.arrays.items()},
                **{f"support_{name}": a for name, a in (self.support or {}).items()}}

    @classmethod
    def restore(cls, metadata, arrays):
        model = cls()
        model.weights = arrays["weights"]
        model.rho, model.nu, model.rounds = metadata["rho"], metadata["nu"], metadata["rounds"]
        model.n_rows, model.seed, model.gap = metadata["rows"], metadata["seed"], metadata.get("gap", float("nan"))
        model.support = {name[8:]: a for name, a in arrays.items() if name.startswith("support_")} or None
        model.pending_map = metadata, {name[4:]: a for name, a in arrays.items() if name.startswith("map_")}
        return model

    def finish(self) -> "OneClassSVMModel":
        m, arrays = self.pending_map
        self.fmap = FeatureMap(m["kernel"], len(self.features), m["gamma"], m["components"], m["degree"], m["coef0"],
                               m["seed"], arrays)
        return self


def svm_probability(decision: Column) -> Column:
    """D8."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(2.0) * decision))


def weight_importance(weights: DataFrame) -> DataFrame:
    """``abs(weight) / sum`` on a table of (feature, weight)."""
    total = weights.agg(F.sum(F.abs("weight"))).scalar()
    return weights.select("feature", ratio(F.abs("weight"), total).alias("importance"))


def kernel_decision(df: DataFrame, features: list[str], vectors: DataFrame, intercept: float, kernel: str = "rbf",
                    gamma: float = 1.0, degree: int = 3, coef0: float = 0.0, scaler=None,
                    output: str = "raw_score") -> DataFrame:
    """D7 for a given table of support vectors (feature columns and ``weight``): sum of weight * k(x, v) - intercept.

    Up to ``MAX_SENT`` vectors travel to the tasks in slices of bounded size. More of them stay in Spark: vectors are dealt
    into numbered blocks, flows into chunks, a pair of them meets in one task, and the partial sums of a flow are added up;
    the driver sees neither.
    """
    k = _kernels(gamma, degree, coef0)[kernel]
    struct = prepared(features, scaler)
    given = vectors.select(struct.alias("x"), F.col("weight").cast("double").alias("weight"))
    n = given.count()
    if n > MAX_SENT:
        return _blocked_decision(df, struct, given, n, k, intercept, output)
    total: Column = F.lit(0.0)
    block = np.array([(*row["x"], row["weight"]) for row in given.collect()], dtype=float).reshape(-1, len(features) + 1)
    for i in range(0, max(n, 1), VECTORS_PER_PASS):
        def part(x: np.ndarray, block=block[i : i + VECTORS_PER_PASS]) -> np.ndarray:
            return _partial_sums(x, block[:, :-1], block[:, -1], k)

        total = total + matrix_column(part, struct)
    return df.withColumn(output, total - F.lit(float(intercept)))


def _partial_sums(x: np.ndarray, vectors: np.ndarray, weights: np.ndarray, k) -> np.ndarray:
    return np.concatenate([k(x[i:i + 4096], vectors) @ weights for i in range(0, len(x), 4096)] or [np.zeros(0)])


def _blocked_decision(df: DataFrame, struct: Column, vectors: DataFrame, n: int, k, intercept: float,
                      output: str) -> DataFrame:
    blocks = -(-n // VECTORS_PER_PASS)
    numbered = materialise(df.withColumn("_flow", F.monotonically_increasing_id()), "numbered-flows")
    chunks = max(1, -(-numbered.count() // FLOWS_PER_CHUNK))
    left = numbered.select("_flow", _entries(struct, numbered).alias("v"),
                           (F.col("_flow") % chunks).alias("chunk"),
                           F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = vectors.select(_entries(F.col("x"), vectors.select("x")).alias("v"), "weight",
                           (F.monotonically_increasing_id() % blocks).cast("int").alias("block"),
                           F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"))

    def matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
        return np.concatenate([part.flatten().to_numpy(zero_copy_only=False) for part in column.chunks]).reshape(rows, -1)

    def run(flows: pa.Table, block: pa.Table) -> pa.Table:
        if not flows.num_rows or not block.num_rows:
            return pa.table({"_flow": pa.array([], pa.int64()), "_part": pa.array([], pa.float64())})
        made = _partial_sums(matrix(flows["v"], flows.num_rows), matrix(block["v"], block.num_rows),
                             block["weight"].to_numpy(), k)
        return pa.table({"_flow": flows["_flow"], "_part": pa.array(made)})

    parts = (left.groupBy("chunk", "block").cogroup(right.groupBy("chunk", "block"))
             .applyInArrow(run, "_flow long, _part double"))
    totals = parts.groupBy("_flow").agg(F.sum("_part").alias("_total"))
    return numbered.join(totals, "_flow").withColumn(output, F.col("_total") - F.lit(float(intercept))).drop("_flow", "_total")


def _entries(struct: Column, df: DataFrame) -> Column:
    """The fields of a struct as one array."""
    names = df.select(struct.alias("s")).schema["s"].dataType.names
    return F.array(*[struct.getField(name) for name in names])


def permutation_importance(df: DataFrame, model: Detector, keys: list[str], seed: int = 42) -> DataFrame:
    """|variance of scores - variance with one feature permuted|, as shares.

    Every row takes the feature from the row before it in hash order (the first from the last): one permutation for all
    features, made within range partitions, with one row each for their edges. One pass scores them all.
    """
    features = model.features
    base = df.select(*keys, *[F.col(f).cast("double").alias(f) for f in features]).withColumn(
        "_h", seeded_hash(keys, seed))
    paired = with_previous(base, ["_h", *keys], features, "_o_")
    own = prepared(features, model.scaler)
    foreign = prepared(features, model.scaler)
    score = model.matrix_score()

    def scores(batch: np.ndarray) -> np.ndarray:
        d = len(features)
        x, o = batch[:, :d], batch[:, d:]
        out = [score(x)]
        for i in range(d):
            swapped = x.copy()
            swapped[:, i] = o[:, i]
            out.append(score(swapped))
        return np.stack(out, axis=1)

    renamed = paired.select(own.alias("_own"), *[F.col(f"_o_{f}").alias(f) for f in features]).select(
        "_own", foreign.alias("_foreign"))
    both = F.struct(*[F.col("_own").getField(f).alias(f"a_{i}") for i, f in enumerate(features)],
                    *[F.col("_foreign").getField(f).alias(f"b_{i}") for i, f in enumerate(features)])
    scored = renamed.select(matrix_column(scores, both, "array<double>").alias("s"))
    spreads = scored.agg(*[F.var_pop(F.get("s", F.lit(i))).alias(f"v{i}") for i in range(len(features) + 1)])
    changes = [F.abs(F.col(f"v{i + 1}") - F.col("v0")) for i in range(len(features))]
    total = sum(changes[1:], changes[0])
    return spreads.select(F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), ratio(c, total).alias("importance")) for f, c in zip(features, changes)])))
