"""Toxicity by weak supervision.

Voters are words of a small public lexicon, words and word beginnings that stand out in the toxic rows of a bounded
labelled sample, and a few fixed patterns. A generative label model over the sample (latent toxic or not) estimates by
expectation maximisation how often each voter, the given label among them, speaks in either class; voters that agree more
than the classes explain share their weight by the estimated correlations. A linear classifier is trained on the posterior
labels and scores every text.

Mining counts features with partial aggregates over the sample; what reaches the driver is the chosen voters and their
votes on the sample, both bounded by parameters. Scoring is a narrow map.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm.common import held_out

#: Labelled documents per class that the model learns from, in expectation; they are picked by a hash of the id.
SAMPLE = 4_000
#: Most marked documents that are broadcast; beyond it the planner joins the chosen texts.
MAX_BROADCAST = 100_000
#: Most voters mined from the sample, the strongest first.
VOTERS = 600
MIN_DOCUMENTS, MIN_Z, MIN_LOG_ODDS = 4, 4.0, 1.0
ROUNDS, RIDGE = 12, 1.0
BEGINNINGS = (4, 5, 6)

# A small public list of insults.
LEXICON = ["idiot", "idiots", "stupid", "moron", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown",
           "dumb", "imbecile", "idiota", "estúpido", "basura", "imbécil", "asqueroso", "payaso", "dummkopf", "trottel",
           "abschaum", "wertlos", "erbärmlich", "crétin", "minable", "dégoûtant", "ordure", "débile"]

# Patterns that hint at attacks.
PATTERNS = {
    "second person": r"\b(?:you are|you're|du bist|tu es|eres)\s+(?:a|an|ein|eine|un|une|so|such)?\b",
    "shut up": r"\b(?:shut up|halt die klappe|ferme[- ]la|cállate)\b",
    "hate": r"\b(?:i hate|ich hasse|je déteste|odio a)\b",
}
_WORD = re.compile(r"[^\W\d_]+")
_PATTERNS = {f"r:{name}": re.compile(pattern) for name, pattern in PATTERNS.items()}


def features_of(text: str) -> set[str]:
    """Words and word beginnings of a text, each once."""
    words = set(_WORD.findall(text.lower()))
    return {f"w:{w}" for w in words} | {f"{n}:{w[:n]}" for w in words for n in BEGINNINGS if len(w) > n}


class Votes:
    """The votes of chosen voters on texts."""

    def __init__(self, names: list[str]):
        self.names = names
        self.index = {name: i for i, name in enumerate(names)}
        self.words = {name[2:]: i for name, i in self.index.items() if name.startswith("w:")}
        self.starts = [(n, {name[2:]: i for name, i in self.index.items() if name.startswith(f"{n}:")})
                       for n in BEGINNINGS]
        self.patterns = [(pattern, self.index[name]) for name, pattern in _PATTERNS.items() if name in self.index]

    def __call__(self, text: str) -> list[int]:
        lowered = text.lower()
        words = set(_WORD.findall(lowered))
        found = {self.words[w] for w in words & self.words.keys()}
        for n, known in self.starts:
            if known:
                found.update(known[w] for w in {w[:n] for w in words if len(w) > n} & known.keys())
        found.update(i for pattern, i in self.patterns if pattern.search(lowered))
        return sorted(found)


@dataclass
class Model:
    names: list[str]
    weights: np.ndarray
    bias: float
    accuracies: np.ndarray | None = None
    correlations: np.ndarray | None = None


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of each row, share of rows voted on by class, correlations of voters within the classes).

    ``votes`` is a 0/1 matrix; the given label is one voter more, where the rounds start. Evidence of a voter is divided
    by the sum of its positive correlations, so repeated evidence counts once.
    """
    both = np.column_stack([votes, labels]).astype(np.float32)
    posterior = labels.astype(float) * 0.98 + 0.01
    speaks = corr = None
    for step in range(rounds):
        masses = np.array([(1 - posterior).sum(), posterior.sum()])
        speaks = np.stack([((1 - posterior) @ both + 0.5) / (masses[0] + 1), (posterior @ both + 0.5) / (masses[1] + 1)])
        if step in (0, rounds // 2):
            centred = both - np.where(posterior[:, None] > 0.5, speaks[1], speaks[0]).astype(np.float32)
            cov = centred.T @ centred / len(both)
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            corr = cov / np.outer(sd, sd)
            share = 1 / np.maximum(np.where(corr > 0.05, corr, 0).sum(axis=0), 1)
        yes, no = np.log(speaks[1] / speaks[0]), np.log((1 - speaks[1]) / (1 - speaks[0]))
        logit = np.log(masses[1] / masses[0]) + both @ (share * (yes - no)) + (share * no).sum()
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if np.abs(new - posterior).max() < 1e-4:
            posterior = new
            break
        posterior = new
    return posterior, speaks, corr


def fit_linear(votes: np.ndarray, target: np.ndarray, ridge: float = RIDGE, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on soft labels by Newton steps."""
    x = np.column_stack([votes, np.ones(len(votes), np.float32)]).astype(float)
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - target) + penalty * w
        hessian = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, voters: int = VOTERS) -> Model:
    """The classifier from text of documents not held out and their ``toxic`` labels.

    Rows without text, label or document teach nothing; repeated texts of a class count once. Without two classes the
    lexicon alone decides.
    """
    marks = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"))
    sizes = {row.toxic: row.n for row in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    fixed = [f"w:{w}" for w in LEXICON] + list(_PATTERNS)
    fallback = Model(fixed, np.array([4.0] * len(LEXICON) + [0.5] * len(_PATTERNS)), -3.0)
    if len(sizes) < 2:
        return fallback
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    shares = [min(1.0, sample / sizes[toxic]) for toxic in (0, 1)]
    marks = marks.where(place < F.when(F.col("toxic") == 1, shares[1]).otherwise(shares[0]))
    if marks.count() <= MAX_BROADCAST:
        marks = F.broadcast(marks)
    chosen = docs.where(F.col("text").isNotNull() & ~held_out(F.col("doc_id")) & (place < max(shares)))
    texts = (chosen.select("doc_id", "text").join(marks, "doc_id")
             .groupBy(F.xxhash64("text").alias("key"), "toxic").agg(F.min_by("text", "doc_id").alias("text")))
    texts = texts.select("key", "toxic", "text").persist()
    try:
        return _train_on(texts, fixed, voters) or fallback
    finally:
        texts.unpersist()


def _train_on(texts: DataFrame, fixed: list[str], voters: int) -> Model | None:
    counts = {row.toxic: row.n for row in texts.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return None

    def mine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: dict[str, list[int]] = {}
            for toxic, text in zip(batch.toxic, batch.text):
                for name in features_of(text):
                    found.setdefault(name, [0, 0])[toxic] += 1
            yield pd.DataFrame([(name, a, b) for name, (a, b) in found.items()], columns=["name", "n0", "n1"])

    n0, n1 = float(counts[0]), float(counts[1])
    p0, p1 = (F.col("n0") + 0.5) / (n0 + 1), (F.col("n1") + 0.5) / (n1 + 1)
    all_p = (F.col("n0") + F.col("n1") + 1) / (n0 + n1 + 2)
    z = (p1 - p0) / F.sqrt(all_p * (1 - all_p) * (1 / n0 + 1 / n1))
    mined = (texts.select("toxic", "text").mapInPandas(mine, "name string, n0 long, n1 long").groupBy("name")
             .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where(F.col("n0") + F.col("n1") >= MIN_DOCUMENTS)
             .select("name", z.alias("z"), F.log(p1 / p0).alias("odds"))
             .where((F.col("z") >= MIN_Z) & (F.col("odds") >= MIN_LOG_ODDS)).orderBy(F.desc("z"), "name").limit(voters))
    names = list(dict.fromkeys([row.name for row in mined.select("name").collect()] + fixed))
    vote = Votes(names)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def cast(values: pd.Series) -> pd.Series:
        return values.map(vote)

    rows = texts.select("toxic", cast("text").alias("votes"), "key").toPandas().sort_values(["key", "toxic"])
    matrix = np.zeros((len(rows), len(names)), np.float32)
    for i, found in enumerate(rows.votes):
        matrix[i, list(found)] = 1
    posterior, speaks, corr = label_model(matrix, rows.toxic.to_numpy())
    weights, bias = fit_linear(matrix, posterior)
    return Model(names, weights, bias, speaks, corr)


def score(df: DataFrame, model: Model, column: str = "text", out: str = "toxicity") -> DataFrame:
    """``df`` with ``out``, the probability that a text is toxic; null and empty texts get that of a text without votes.

    Rows are independent; a column already named ``out`` is replaced.
    """
    names, weights, bias = model.names, model.weights, model.bias

    @F.pandas_udf(T.DoubleType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vote = Votes(names)
        for texts in batches:
            logit = np.fromiter((weights[vote(text)].sum() for text in texts.fillna("")), float, len(texts)) + bias
            yield pd.Series(1 / (1 + np.exp(-np.clip(logit, -30, 30))))

    return df.withColumn(out, run(F.col(column)))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The digest of the query: doc_id, held_out, score, predicted."""
    made = score(docs.select("doc_id", "text"), train(docs, labels), "text", "score")
    return made.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                       (F.col("score") >= 0.5).cast("int").alias("predicted"))
