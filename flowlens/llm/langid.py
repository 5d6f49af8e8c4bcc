"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary.

A word is a sequence of vocabulary pieces; which sequence is not known, so its probability in a language is the sum over
all segmentations, given by a forward pass over the lattice of pieces. Piece probabilities per language come from a few
rounds of expectation maximisation over the words of a bounded sample of labelled documents per language. Pieces never
cross words, so a text's score is a sum over its words and a task needs the lattice of a distinct word only once.

Prediction is a narrow map with the model (a row per piece, a column per language) as its only state.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm.common import groups, held_out

#: Documents per language that the model learns from, in expectation; they are picked by a hash of the id.
SAMPLE = 2_000
ROUNDS, SMOOTHING = 4, 0.05
#: Levels of a lattice after which sums are rescaled.
STEP = 24
#: Distinct words in each of the two generations that a task remembers, and words of one lattice.
MEMO, LATTICE = 200_000, 20_000
UNDETERMINED = "und"
_WORD = re.compile(r"[^\W\d_]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Trie:
    """The ordinary pieces of the vocabulary, numbered in order; ``n`` is the number of a character that none covers."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = dict.fromkeys(model.id_to_piece(i) for i in range(model.get_piece_size())
                              if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)))
        self.n, self.longest = len(names), max(map(len, names))
        states: dict[str, int] = {"": 0}
        for name in names:
            for i in range(1, len(name) + 1):
                states.setdefault(name[:i], len(states))
        self.piece = np.full(len(states), -1)
        self.piece[[states[name] for name in names]] = np.arange(self.n)
        moves = {states[prefix[:-1]] << 21 | ord(prefix[-1]): state for prefix, state in states.items() if prefix}
        self.mask = (1 << (4 * len(moves)).bit_length()) - 1
        self.keys, self.next = np.full(self.mask + 1, -1), np.full(self.mask + 1, -1)
        for key, state in moves.items():
            slot = self._slot(np.array([key]))[0]
            while self.keys[slot] >= 0:
                slot = slot + 1 & self.mask
            self.keys[slot], self.next[slot] = key, state

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        x = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((x >> np.uint64(40)) & np.uint64(self.mask)).astype(np.int64)

    def step(self, states: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The state after one more character of each, -1 where no piece goes on."""
        keys = states << 21 | chars
        slots = self._slot(keys)
        made, open_ = np.full(len(keys), -1), np.arange(len(keys))
        while len(open_):
            there = self.keys[slots]
            hit = there == keys[open_]
            made[open_[hit]] = self.next[slots[hit]]
            on = ~hit & (there >= 0)
            open_, slots = open_[on], slots[on] + 1 & self.mask
        return made


@lru_cache(maxsize=2)
def trie(path: str) -> Trie:
    return Trie(path)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Lattices:
    """All pieces of many words as flat edges; one pass over them serves all words and languages at once.

    A word starts with a mark; it has a node before, between and after its characters. All places of all words walk the
    trie together, a character at a time. Sums are rescaled every ``STEP`` levels, so a run of any length is scored whole.
    """

    def __init__(self, words: list[str], path: str):
        known = trie(path)
        chars = np.frombuffer("".join("▁" + word for word in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        stops = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(words)), sizes)
        at, states, depth = np.arange(len(chars)), np.zeros(len(chars), np.int64), 0
        starts, lengths, pieces = [], [], []
        while len(at):
            states = known.step(states, chars[at + depth])
            depth += 1
            piece = np.where(states >= 0, known.piece[states], -1)
            if depth == 1:
                piece[piece < 0] = known.n
            found = piece >= 0
            starts.append(at[found])
            pieces.append(piece[found])
            lengths.append(np.full(int(found.sum()), depth))
            on = (states >= 0) & (at + depth < stops[owner[at]])
            at, states = at[on], states[on]
        start, length, piece = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, lengths, pieces))
        self.words, self.longest = len(words), known.longest
        self.nodes = len(chars) + len(words)
        self.last = stops + np.arange(len(words))
        self.first = self.last - sizes
        self.sizes, unit = sizes, owner[start]
        end = start + length + unit
        level = end - self.first[unit]
        order = np.argsort(level * self.nodes + end)
        self.starts, self.ends, self.piece, self.unit = (start + unit)[order], end[order], piece[order], unit[order]
        # runs of edges with one end, and the runs of each level: an end's edges are added up at once
        runs = np.flatnonzero(np.diff(self.ends, prepend=-1))
        cuts = np.concatenate([[0], np.cumsum(np.bincount(level))]).astype(np.int64)
        own = np.searchsorted(runs, cuts)
        self.levels = [(slice(a, b), runs[i:j] - a, self.ends[runs[i:j]])
                       for a, b, i, j in zip(cuts[1:-1].tolist(), cuts[2:].tolist(), own[1:-1].tolist(), own[2:].tolist())]

    def _window(self, units: np.ndarray, level: int, back: int) -> np.ndarray:
        """Nodes of the last levels of units, up to ``level``: those that edges to come can start from."""
        return self.first[units][:, None] + np.arange(max(0, level - back), level + 1)

    def forward(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sum over all segmentations from the start of a word to each node, logarithm of each node's scale, of each
        word's), a column per column of the piece probabilities ``p``."""
        alpha, scale = np.zeros((self.nodes, p.shape[1])), np.zeros((self.words, p.shape[1]))
        node_scale = np.zeros_like(alpha) if len(self.levels) >= STEP else None
        alpha[self.first] = 1
        for level, (edges, runs, to) in enumerate(self.levels, 1):
            alpha[to] = np.add.reduceat(alpha[self.starts[edges]] * p[self.piece[edges]], runs)
            if level % STEP == 0 and len(going := np.flatnonzero(self.sizes > level)):
                window = self._window(going, level, self.longest)
                top = alpha[window].max(axis=1)
                alpha[window] /= top[:, None]
                scale[going] += np.log(top)
                node_scale[window] = scale[going][:, None]
                ahead = self.first[going][:, None] + np.arange(level + 1, level + STEP + 1)
                inside = ahead <= self.last[going][:, None]
                node_scale[ahead[inside]] = np.repeat(scale[going], inside.sum(axis=1), axis=0)
        return alpha, node_scale, scale

    def backward(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sum from each node to the end of its word, logarithm of each node's scale) for one column of ``p``; from the
        last level down, a node is complete when its edges end."""
        beta, scale = np.zeros(self.nodes), np.zeros(self.words)
        node_scale = np.zeros(self.nodes)
        beta[self.last] = 1
        for level in range(len(self.levels), 0, -1):
            edges = self.levels[level - 1][0]
            np.add.at(beta, self.starts[edges], beta[self.ends[edges]] * p[self.piece[edges]])
            if level % STEP == 0 and len(going := np.flatnonzero(self.sizes >= level)):
                window = self._window(going, level - 1, self.longest)
                top = beta[window].max(axis=1)
                beta[window] /= top[:, None]
                scale[going] += np.log(top)
                below = self.first[going][:, None] + np.arange(max(0, level - STEP - self.longest), level)
                node_scale[below] = scale[going][:, None]
        return beta, node_scale

    def log_likelihood(self, p: np.ndarray) -> np.ndarray:
        """Log probability of each word, a column per column of ``p``."""
        alpha, _, scale = self.forward(p)
        return np.log(alpha[self.last]) + scale

    def expected(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, of one column of probabilities, when word w occurs counts[w] times."""
        alpha, alpha_scale, scale = self.forward(p[:, None])
        beta, beta_scale = self.backward(p)
        use = alpha[self.starts, 0] * p[self.piece] * beta[self.ends] / alpha[self.last, 0][self.unit]
        if alpha_scale is not None:
            use *= np.exp(alpha_scale[self.starts, 0] + beta_scale[self.ends] - scale[self.unit, 0])
        return np.bincount(self.piece, use * counts[self.unit], len(p))


def fit_pieces(words: list[str], counts: np.ndarray, path: str, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities of one language by expectation maximisation, smoothed so that none is zero."""
    size = trie(path).n + 1
    p, lattice = np.full(size, 1 / size), Lattices(words, path)
    for _ in range(rounds):
        use = lattice.expected(p, counts) + SMOOTHING
        p = use / use.sum()
    return p


def train(docs: DataFrame, path: str | None = None, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """(languages in order, probabilities by piece and language) from text and lang of documents not held out.

    Rows with a null lang or text teach nothing; a language without a word is not learned.
    """
    path = path or default_path()
    rows = docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    sizes = {row.lang: row.n for row in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    size = 1 + trie(path).n
    if not sizes:
        return [], np.zeros((size, 0))
    share = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1.0, sample / n))])
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    picked = rows.where(place < share[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: dict[str, Counter] = {}
            for lang, text in zip(batch.lang, batch.text.fillna("")):
                found.setdefault(lang, Counter()).update(words_of(text))
            yield pd.DataFrame([(lang, w, n) for lang, c in found.items() for w, n in c.items()],
                               columns=["lang", "word", "n"])

    def fit(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("word")
        p = fit_pieces(frame.word.tolist(), frame.n.to_numpy(float), path)
        return pd.DataFrame({"lang": key[0], "piece": np.arange(len(p)), "p": p})

    counts = picked.mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(
        F.sum("n").alias("n"))
    model = counts.groupBy("lang").applyInPandas(fit, "lang string, piece int, p double").toPandas()
    langs = sorted(model.lang.unique())
    table = np.empty((size, len(langs)))
    for i, lang in enumerate(langs):
        own = model[model.lang == lang]
        table[own.piece.to_numpy(), i] = own.p.to_numpy()
    return langs, table


class Scorer:
    """Log likelihoods of texts in every language; remembers words in two generations, so that frequent ones stay."""

    def __init__(self, table: np.ndarray, path: str):
        self.table, self.path = table, path
        self.rows, self.scores = {}, np.zeros((0, table.shape[1]))
        self.old, self.old_scores = self.rows, self.scores

    def _learn(self, words: set[str]) -> None:
        new = words.difference(self.rows)
        if len(self.rows) + len(new) > MEMO:
            self.old, self.old_scores = self.rows, self.scores
            self.rows, self.scores, new = {}, self.scores[:0], words
        moved = [w for w in new if w in self.old]
        parts = [self.scores, self.old_scores[[self.old[w] for w in moved]]]
        new = [w for w in new if w not in self.old]
        parts += [Lattices(new[i : i + LATTICE], self.path).log_likelihood(self.table) for i in range(0, len(new), LATTICE)]
        self.rows.update(zip(moved + new, range(len(self.rows), len(self.rows) + len(moved) + len(new))))
        self.scores = np.concatenate(parts)

    def score(self, texts: list[str]) -> Iterator[np.ndarray]:
        """One row of log likelihoods per text; NaN for a text without letters."""
        for start, stop in groups(texts):
            split = [words_of(text) for text in texts[start:stop]]
            self._learn(set().union(*split))
            for words, text in zip(split, texts[start:stop]):
                if not words or not any(w.isalpha() or any(map(str.isalpha, w)) for w in words):
                    yield np.full(self.table.shape[1], np.nan)
                else:
                    yield self.scores[list(map(self.rows.__getitem__, words))].sum(axis=0)


def predict(df: DataFrame, model: tuple[list[str], np.ndarray], column: str = "text", path: str | None = None,
            out: str = "language") -> DataFrame:
    """``df`` with ``out``, a struct of ``lang_pred`` and ``score`` (the posterior under equal priors, 0 to 1).

    A text that is null or has no letter is ``und`` with score 0, and so is every text if no language was learned. Equal
    likelihoods go to the language that sorts first. Rows are independent.
    """
    path = path or default_path()
    langs, table = model
    schema = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(table, path)
        for texts in batches:
            if not langs:
                yield pd.DataFrame({"lang_pred": [UNDETERMINED] * len(texts), "score": 0.0})
                continue
            found = np.stack(list(scorer.score(texts.fillna("").tolist()))) if len(texts) else np.zeros((0, len(langs)))
            none = np.isnan(found).any(axis=1)
            found[none] = 0
            best = found.argmax(axis=1)
            score = 1 / np.exp(found - found.max(axis=1, keepdims=True)).sum(axis=1)
            yield pd.DataFrame({"lang_pred": np.where(none, UNDETERMINED, np.array(langs, object)[best]),
                                "score": np.where(none, 0.0, score)})

    return df.withColumn(out, run(F.col(column)))


def report(docs: DataFrame) -> DataFrame:
    """The digest of the query: doc_id, held_out, lang_pred, score."""
    made = predict(docs.select("doc_id", "text"), train(docs), "text", out="language")
    return made.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "language.lang_pred", "language.score")
