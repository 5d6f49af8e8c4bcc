"""The small dense networks of the two autoencoders, and their data-parallel training (H6).

A network is a flat list of layers; its parameters are one vector, so that shards can be averaged. Every epoch is one
Spark job: each shard runs its mini-batches from the averaged weights, and the shards' vectors are averaged part by part in a
shuffle, in the order of the shards, so the driver receives one vector and the same one every time (parameter mixing). Shards
are fixed by the hash of a row, not by input partitions, so a result depends only on the data, the seed and their number.

A snapshot is one row with all that the loop knows (weights, moments, step count, rate, patience, best weights, history) and
a hash of the settings; a resumed run goes on as if it had not stopped.
"""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import asdict, dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowlens.detect.base import prepared
from flowlens.functions.hashing import unit_interval
from flowlens.session import keep

BN_EPS, BN_MOMENTUM = 1e-3, 0.99
ROWS_PER_SHARD = 50_000
#: Longest part of a shard's values, and most numbers that one task adds up.
PART, PART_ROOM = 512, 1_000_000
ACTIVATIONS = {
    "relu": (lambda a: np.maximum(a, 0.0), lambda a: (a > 0).astype(float)),
    "tanh": (np.tanh, lambda a: 1.0 - np.tanh(a) ** 2),
    "sigmoid": (lambda a: 1.0 / (1.0 + np.exp(-a)), lambda a: (s := 1.0 / (1.0 + np.exp(-a))) * (1.0 - s)),
    "linear": (lambda a: a, lambda a: np.ones_like(a)),
}


@dataclass
class Dense:
    inputs: int
    outputs: int
    activation: str = "relu"
    regularised: bool = True
    normalised: bool = False    # batch normalisation after the activation
    dropout: float = 0.0

    def sizes(self) -> list[tuple[int, ...]]:
        out = [(self.inputs, self.outputs), (self.outputs,)]
        return out + [(self.outputs,)] * 4 if self.normalised else out


def views(layers: list[Dense], theta: np.ndarray) -> list[list[np.ndarray]]:
    """The parameter arrays of every layer as views into one vector."""
    out, at = [], 0
    for layer in layers:
        arrays = []
        for shape in layer.sizes():
            n = math.prod(shape)
            arrays.append(theta[at:at + n].reshape(shape))
            at += n
        out.append(arrays)
    return out


def initial(layers: list[Dense], rng: np.random.Generator) -> np.ndarray:
    """Uniform weights scaled by fan-in and fan-out, zero biases, neutral normalisation."""
    parts = []
    for layer in layers:
        limit = np.sqrt(6.0 / (layer.inputs + layer.outputs))
        parts += [rng.uniform(-limit, limit, layer.inputs * layer.outputs), np.zeros(layer.outputs)]
        if layer.normalised:
            zero, one = np.zeros(layer.outputs), np.ones(layer.outputs)
            parts += [one, zero, zero, one]     # gain, shift, running mean, running variance
    return np.concatenate(parts)


def _mean(rows: np.ndarray) -> np.ndarray:
    """``rows.mean(0)`` to the bit; that call costs more than the sum on a batch of a few thousand numbers."""
    return np.add.reduce(rows, 0) / len(rows)


def forward(layers, params, x, rng=None):
    """Output and what backward needs; ``rng`` switches dropout and batch statistics on."""
    caches = []
    for layer, p in zip(layers, params):
        a = x @ p[0] + p[1]
        h = ACTIVATIONS[layer.activation][0](a)
        norm = None
        if layer.normalised:
            mean = _mean(h) if rng is not None else p[4]
            centred = h - mean
            var = _mean(centred * centred) if rng is not None else p[5]
            scale = 1.0 / np.sqrt(var + BN_EPS)
            norm = (centred * scale, scale, mean, var)
            h = norm[0] * p[2] + p[3]
        mask = None
        if rng is not None and layer.dropout > 0:
            mask = (rng.random(h.shape) >= layer.dropout) * (1.0 / (1.0 - layer.dropout))
            h = h * mask
        caches.append((x, a, norm, mask))
        x = h
    return x, caches


def backward(layers, params, caches, grad, l2: float, trained: bool = True):
    """Gradients per layer and for the input. Running statistics get no gradient."""
    grads = []
    for layer, p, (x, a, norm, mask) in zip(reversed(layers), reversed(params), reversed(caches)):
        if mask is not None:
            grad = grad * mask
        extra = []
        if norm is not None:
            hat, scale, _, _ = norm
            zero = np.zeros_like(p[4])
            extra = [np.add.reduce(grad * hat, 0), np.add.reduce(grad, 0), zero, zero]
            g = grad * p[2]
            grad = scale * (g - _mean(g) - hat * _mean(g * hat)) if trained else scale * g
        if layer.activation != "linear":
            grad = grad * ACTIVATIONS[layer.activation][1](a)
        gw = x.T @ grad + (2.0 * l2 * p[0] if layer.regularised else 0.0)
        grads.append([gw, np.add.reduce(grad, 0), *extra])
        grad = grad @ p[0].T
    return list(reversed(grads)), grad


def update_running(layers, params, caches) -> None:
    for layer, p, (_, _, norm, _) in zip(layers, params, caches):
        if layer.normalised:
            p[4][:] = BN_MOMENTUM * p[4] + (1 - BN_MOMENTUM) * norm[2]
            p[5][:] = BN_MOMENTUM * p[5] + (1 - BN_MOMENTUM) * norm[3]


def penalty(layers, params, l2: float) -> float:
    return l2 * sum(float((p[0] ** 2).sum()) for layer, p in zip(layers, params) if layer.regularised)


@dataclass
class TrainingPlan:
    """Hyper-parameters of one training run."""

    learning_rate: float = 1e-3
    batch_size: int = 256
    epochs: int = 100
    validation: float = 0.1
    patience: int = 10
    halve_after: int = 5
    min_rate: float = 1e-7
    shards: int | None = None       # None: one per ROWS_PER_SHARD rows
    seed: int = 42
    checkpoint_every: int = 5
    checkpoint_path: str | None = None
    history: list = field(default_factory=list)


@dataclass
class _State:
    """All that the loop knows after an epoch."""

    epoch: int
    theta: np.ndarray
    moments: np.ndarray
    rate: float
    best: np.ndarray
    steps: int = 0
    best_loss: float = float("inf")
    flat: int = 0
    since_halved: int = 0
    history: list = field(default_factory=list)


def train(df: DataFrame, features: list[str], keys: list[str], scaler, theta: np.ndarray, loss_and_gradient,
          validation_loss, plan: TrainingPlan, validation_data: DataFrame | None = None) -> tuple[np.ndarray, list[tuple]]:
    """Averaged training. Returns the best weights and the history (epoch, loss, val_loss, learning_rate).

    ``loss_and_gradient(theta, rows, rng) -> (loss, gradient)`` may update running statistics inside theta;
    ``validation_loss(theta, rows) -> per-row losses``. With ``validation_data`` those rows are validated on and all of
    ``df`` trains; without, a share of ``df`` chosen by hash is held back.
    """
    spark = df.sparkSession
    shards = plan.shards or max(1, -(-df.count() // ROWS_PER_SHARD))

    def placed(rows: DataFrame, held) -> DataFrame:
        h = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys],
                              *[F.col(f).cast("string") for f in features], F.lit(str(plan.seed))))
        rows = rows.select(prepared(features, scaler).alias("x"), h.alias("h"))
        return rows.select("x.*", "h", F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int").alias("shard"), held.alias("held"))

    if validation_data is None:
        rows = placed(df, unit_interval(F.col("h")) < plan.validation)
    else:
        rows = placed(df, F.lit(False)).unionByName(placed(validation_data, F.lit(True)))
    # The hash only gives the order of a shard's rows. They are packed once: an epoch moves and converts no single row.
    ordered = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("h").drop("h")
    sharded = keep(ordered.mapInPandas(_pack_task(features), "shard int, held binary, x binary"))
    settings = _settings(plan, features, keys, theta, shards, validation_data is not None)
    s = _State(0, theta, np.zeros(2 * len(theta)), plan.learning_rate, theta.copy())
    if plan.checkpoint_path:
        s = _resume(spark, plan.checkpoint_path, settings) or s
    try:
        while True:
            # The job of an epoch also measures the weights it starts from, so validation costs no pass of its own.
            last = s.epoch >= plan.epochs
            sent = spark.sparkContext.broadcast((s.theta, s.moments, s.rate, s.steps, s.epoch, last))
            part = max(1, min(PART, PART_ROOM // shards))
            task = _shard_task(sent, loss_and_gradient, validation_loss, plan.batch_size, plan.seed, part)
            made, most = _summed(sharded.mapInPandas(task, "shard int, part int, values array<double>"))
            sent.unpersist()
            if not len(made):
                break
            n, loss, held_n, held_loss = made[:4]
            if s.epoch > 0 or last:
                val = held_loss / held_n if held_n else s.history[-1][1] if s.history else np.inf
                if s.history:
                    s.history[-1] = (*s.history[-1][:2], float(val), s.history[-1][3])
                if val < s.best_loss - 1e-12:
                    s.best, s.best_loss, s.flat, s.since_halved = s.theta.copy(), float(val), 0, 0
                else:
                    s.flat, s.since_halved = s.flat + 1, s.since_halved + 1
                if s.since_halved >= plan.halve_after:
                    s.rate, s.since_halved = max(s.rate * 0.5, plan.min_rate), 0
                if s.flat >= plan.patience:
                    break
            if last or n == 0:
                break
            s.theta, s.moments = np.split(made[5:] / n, [len(theta)])
            s.steps += int(most[4])
            s.epoch += 1
            s.history.append((s.epoch, float(loss / n), float("nan"), s.rate))
            if plan.checkpoint_path and s.epoch % plan.checkpoint_every == 0:
                _checkpoint(spark, plan.checkpoint_path, s, settings)
    finally:
        sharded.unpersist()
    return s.best, s.history


def _summed(parts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sum and largest value of every component over the shards; added up in the order of the shards, part by part."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        values = list(rows.sort_values("shard")["values"])
        return pd.DataFrame({"part": rows["part"].iloc[:1], "total": [reduce(np.add, values, 0.0)],
                             "most": [reduce(np.maximum, values)]})

    rows = parts.groupBy("part").applyInPandas(add, "part int, total array<double>, most array<double>").toPandas()
    rows = rows.sort_values("part")
    return tuple(np.concatenate([*rows[name], np.zeros(0)]) for name in ("total", "most"))


def _pack_task(features):
    """The rows of an Arrow batch as one row with their bytes: a mark per row whether it is held, and the features."""

    def run(batches):
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"shard": batch["shard"].iloc[:1], "held": [batch["held"].to_numpy(dtype=bool).tobytes()],
                                    "x": [batch[features].to_numpy(dtype=float).tobytes()]})

    return run


def _shard_task(state, loss_and_gradient, validation_loss, batch_size, seed, part):
    """One shard's share of an epoch: Adam steps over its batches, streamed; memory holds one Arrow batch.

    A shard's values: rows, loss, held rows, their loss, steps, then weights and moments times rows; in parts of a fixed
    length, which are added up apart from each other.
    """

    def run(batches):
        theta, moments, rate, steps, epoch, measure_only = state.value
        incoming, theta, moments = theta, theta.copy(), moments.copy()
        m, v = np.split(moments, 2)
        n = done = held_n = 0
        loss_sum = held_loss = 0.0
        rng = shard = None
        for shard, held, x in (row for batch in batches for row in zip(batch["shard"], batch["held"], batch["x"])):
            held = np.frombuffer(held, dtype=bool)
            x = np.frombuffer(x).reshape(len(held), -1)
            if held.any():
                held_loss += float(validation_loss(incoming, x[held]).sum())
                held_n += int(held.sum())
            if measure_only:
                continue
            rng = rng or np.random.default_rng([seed, epoch, shard])
            x = x[~held]
            x = x[rng.permutation(len(x))]
            for at in range(0, len(x), batch_size):
                rows = x[at:at + batch_size]
                loss, grad = loss_and_gradient(theta, rows, rng)
                done += 1
                t = steps + done
                m[:] = 0.9 * m + 0.1 * grad
                v[:] = 0.999 * v + 0.001 * grad**2
                theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-7)
                loss_sum += loss * len(rows)
                n += len(rows)
        if shard is not None:
            head = np.array([n, loss_sum, held_n, held_loss, done], float)
            values = head if measure_only else np.concatenate([head, theta * n, moments * n])
            pieces = [values[at:at + part] for at in range(0, len(values), part)]
            yield pd.DataFrame({"shard": int(shard), "part": range(len(pieces)), "values": pieces})

    return run


def history_frame(spark: SparkSession, history: list[tuple]) -> DataFrame:
    """One row per epoch."""
    return spark.createDataFrame(history, "epoch int, loss double, val_loss double, learning_rate double")


def _settings(plan: TrainingPlan, features, keys, theta, shards: int, own_validation: bool) -> str:
    """A hash of all that a run must share with the one it resumes; a later run may have more epochs."""
    free = {"epochs", "history", "checkpoint_path", "checkpoint_every"}
    fixed = {name: value for name, value in asdict(plan).items() if name not in free}
    text = json.dumps([fixed, features, keys, len(theta), hashlib.sha256(theta.tobytes()).hexdigest(), shards,
                       own_validation], sort_keys=True)
    return hashlib.sha256(text.encode()).hexdigest()


_SNAPSHOT = ("epoch int, theta array<double>, moments array<double>, rate double, best array<double>, steps bigint, "
             "best_loss double, flat int, since_halved int, "
             "history array<struct<epoch:int,loss:double,val_loss:double,learning_rate:double>>, settings string")


def _checkpoint(spark, path, state: _State, settings: str) -> None:
    """One row in one file, which the commit of the write puts there whole or not at all."""
    row = {**vars(state), "settings": settings, **{name: [float(x) for x in getattr(state, name)]
                                                   for name in ("theta", "moments", "best")}}
    spark.createDataFrame([tuple(row[field.split()[0]] for field in _SNAPSHOT.split(", "))], _SNAPSHOT).coalesce(1) \
        .write.mode("append").parquet(path)


def _resume(spark, path, settings: str) -> _State | None:
    """The last snapshot under ``path``; one of other settings is an error, none is a fresh start."""
    from pyspark.errors import AnalysisException

    try:
        row = spark.read.schema(_SNAPSHOT).parquet(path).orderBy(F.col("epoch").desc()).first()
    except AnalysisException:
        return None
    if row is None:
        return None
    if row["settings"] != settings:
        raise ValueError(f"the snapshots in {path} belong to a run with other settings")
    values = row.asDict()
    values.pop("settings")
    values |= {name: np.array(values[name]) for name in ("theta", "moments", "best")}
    return _State(**values | {"history": [tuple(entry) for entry in row["history"]]})


def layers_to_json(layers: list[Dense]) -> str:
    return json.dumps([vars(layer) for layer in layers])


def layers_from_json(text: str) -> list[Dense]:
    return [Dense(**entry) for entry in json.loads(text)]
