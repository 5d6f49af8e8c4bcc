"""Hard-negative mining by slots: what every positive of an anchor may be confused with, in two passes over all rows.

A positive of score s allows negatives between ``low`` and ``high`` percent of s. The upper limits of an anchor's positives
split the scores into disjoint slots. Cells keep the best k rows of each slot, merges keep k of them again, and since slots
lie in descending order, the rows under any limit are a suffix of the anchor's merged slots: its first k answer the window,
however the windows overlap.

Anchors and rows meet in cells of a grid: anchors are dealt into blocks, rows into chunks, and a cell is one block against
one chunk. Both sides of a cell have a bounded size, so no task holds all anchors or all rows, nothing is broadcast, and a
common vector is spread like any other row. Scores are exact integers: float64 products where they must stay below 2**53,
Python integers for longer vectors or larger components.

Rows without id, label or vector, and rows with a missing or non-finite component (also after scaling) take no part.
Rows of one id and one score count once, so repeated rows change nothing; "other rows" are those of another id. Vectors of
different lengths are filled up with zeros. Scores beyond 64 bits are held at the ends of that range. Anchors without
positives, positives of a negative score and empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowlens.llm.common import Scratch

POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 5, 10, 30, 90, 256
#: Bytes of the vectors (as float64) of one block of anchors or one chunk of rows.
CELL_BYTES = 32_000_000
#: Rows that a chunk has at least, where fewer chunks would still keep every core busy.
CHUNK_ROWS = 1024
#: Anchors and rows that are multiplied at once.
TILE = (512, 4096)
_EXACT, _MOST = 1 << 53, (1 << 63) - 1


def usable(rows: DataFrame, vec_id: str, vector: str, label: Column, scale: int) -> DataFrame:
    """``vec_id, label, vector`` of the rows that take part."""
    def finite(x):
        return x.isNotNull() & (F.abs(x.cast("double") * F.lit(float(scale))) < F.lit(math.inf))

    return (rows.select(F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"),
                        F.col(vector).alias("vector"))
            .where("vec_id is not null and label is not null and vector is not null").where(F.forall("vector", finite)))


def _matrix(column: pa.ChunkedArray, width: int, scale: int) -> np.ndarray:
    lists = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    made = np.zeros((len(sizes), width))
    made[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(made * scale)


def _longest(column: pa.ChunkedArray) -> int:
    return pc.max(pc.list_value_length(column)).as_py() or 0


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of two matrices of whole numbers, held at the ends of 64 bits."""
    limit = math.isqrt(_EXACT // max(anchors.shape[1], 1)) - 1
    with np.errstate(invalid="ignore", over="ignore"):
        made = np.nan_to_num(anchors @ rows.T, nan=0.0, posinf=0.0, neginf=0.0)
        made = np.clip(made, -float(_EXACT), float(_EXACT)).astype(np.int64)

    def whole(vector):
        return [int(x) for x in vector]

    def exact(a, b):
        return max(-_MOST, min(_MOST, sum(x * y for x, y in zip(a, b))))

    large_a, large_r = np.flatnonzero(np.abs(anchors).max(1, initial=0) > limit), np.abs(rows).max(1, initial=0) > limit
    if len(large_a) or large_r.any():
        ints = [whole(v) for v in rows]
        for i in range(len(anchors)):
            wanted = range(len(rows)) if i in large_a else np.flatnonzero(large_r)
            if len(wanted):
                a = whole(anchors[i])
                for j in wanted:
                    made[i, j] = exact(a, ints[j])
    return made


def best(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple:
    """The best k of each group by score, then smaller id; one id and score count once."""
    order = np.lexsort((ids, -score, group))
    group, score, ids = group[order], score[order], ids[order]
    new = np.ones(len(group), bool)
    new[1:] = (group[1:] != group[:-1]) | (score[1:] != score[:-1]) | (ids[1:] != ids[:-1])
    group, score, ids = group[new], score[new], ids[new]
    first = np.searchsorted(group, group)
    kept = np.arange(len(group)) - first < k
    return group[kept], score[kept], ids[kept]


class _Best:
    """Running best k per group over parts that come in ascending order of id."""

    def __init__(self, n_groups: int, k: int):
        self.k, self.least = k, np.full(n_groups, -_MOST - 1, np.int64)
        self.kept = (np.zeros(0, np.int64),) * 3

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(group):
            return
        self.kept = best(*(np.concatenate(x) for x in zip(self.kept, (group, score, ids))), self.k)
        kept, score, _ = self.kept
        counts = np.bincount(kept, minlength=len(self.least))
        full = np.flatnonzero(counts == self.k)
        self.least[full] = score[np.cumsum(counts)[full] - 1]


def _in_cells(anchors: DataFrame, rows: DataFrame, work, schema: str, scale: int, blocks: int, chunks: int) -> DataFrame:
    """``work(anchor table, its scores against a tile of rows, row ids, row labels, state)`` over the grid of cells."""
    left = (anchors.withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(blocks)).cast("int"))
            .withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))))
    # The place of a row in its file decides its chunk, so that copies of one row are spread as well.
    right = (rows.withColumn("cell", (F.monotonically_increasing_id() % chunks).cast("int"))
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))

    def run(a: pa.Table, r: pa.Table) -> pa.Table:
        made = []
        if a.num_rows and r.num_rows:
            width = max(_longest(a["vector"]), _longest(r["vector"]))
            r = r.sort_by("vec_id")
            vectors, ids = _matrix(r["vector"], width, scale), r["vec_id"].to_numpy()
            labels = r["label"].to_numpy()
            for i in range(0, a.num_rows, TILE[0]):
                part = a.slice(i, TILE[0])
                state, own = work(part), _matrix(part["vector"], width, scale)
                for j in range(0, len(ids), TILE[1]):
                    tile = slice(j, j + TILE[1])
                    state.see(scores(own, vectors[tile]), ids[tile], labels[tile])
                made.append(state.table())
        return pa.concat_tables(made) if made else pa.table({n: [] for n in names}).cast(empty)

    names = [field.split()[0] for field in schema.split(",")]
    empty = pa.schema([(n, pa.int64()) for n in names])
    return (left.groupBy("block", "cell").cogroup(right.groupBy("block", "cell")).applyInArrow(run, schema))


class _Positives:
    """The best rows of the anchor's label."""

    def __init__(self, part: pa.Table, k: int):
        self.anchor, self.id = part["anchor"].to_numpy(), part["vec_id"].to_numpy()
        self.label, self.best = part["label"].to_numpy(), _Best(part.num_rows, k)

    def see(self, s, ids, labels):
        ok = (s > self.best.least[:, None]) & (labels == self.label[:, None]) & (ids != self.id[:, None])
        a, r = np.nonzero(ok)
        self.best.add(a, s[a, r], ids[r])

    def table(self):
        a, s, ids = self.best.kept
        return pa.table({"anchor": self.anchor[a], "positive_id": ids, "positive_score": s})


class _Slots:
    """The best rows of other labels in every slot of the anchor."""

    def __init__(self, part: pa.Table, k: int):
        self.anchor, self.label = part["anchor"].to_numpy(), part["label"].to_numpy()
        slots = part["slots"].to_pylist()
        self.n = max(map(len, slots))
        self.high = np.full((len(slots), self.n), -_MOST - 1, np.int64)  # a slot that is not there holds nothing
        self.low = np.full((len(slots), self.n), _MOST, np.int64)
        for i, own in enumerate(slots):
            above = -1
            for j, slot in enumerate(own):
                self.high[i, j], self.low[i, j] = slot["high"], max(slot["low"], above + 1)
                above = slot["high"]
        self.best = _Best(len(slots) * self.n, k)

    def see(self, s, ids, labels):
        other, least = labels != self.label[:, None], self.best.least.reshape(-1, self.n)
        found = []
        for j in range(self.n):
            a, r = np.nonzero((s <= self.high[:, j, None]) & (s >= self.low[:, j, None]) & (s > least[:, j, None]) & other)
            found.append((a * self.n + j, s[a, r], ids[r]))
        self.best.add(*(np.concatenate(x) for x in zip(*found)))

    def table(self):
        g, s, ids = self.best.kept
        return pa.table({"anchor": self.anchor[g // self.n], "high": self.high.reshape(-1)[g], "negative_id": ids,
                         "negative_score": s})


def _merge(rows: DataFrame, keys: list[str], score: str, vec_id: str, k: int) -> DataFrame:
    """The best k rows of every key over all cells; partial limits run before the shuffle."""
    order = W.partitionBy(*keys).orderBy(F.desc(score), F.asc(vec_id))
    return rows.withColumn("place", F.dense_rank().over(order)).where(F.col("place") <= k).distinct()


def mine(rows: DataFrame, is_anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", label: Column | None = None,
         positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE,
         scratch: Scratch | None = None) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``is_anchor`` is a condition on the column ``vec_id``; ``low`` and ``high`` are percent of the positive's score,
    0 <= low <= high <= 100. The module says what awkward rows mean.
    """
    scratch = scratch or Scratch(rows.sparkSession)
    rows = usable(rows, vec_id, vector, F.col("label") if label is None else label, scale)
    n, n_anchors, width = rows.agg(F.count(F.lit(1)), F.count_if(is_anchor), F.max(F.size("vector"))).first()
    size = max(1, CELL_BYTES // (8 * max(width or 1, 1)))
    cores = rows.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-n_anchors // size))
    chunks = max(1, -(-n // size), min(cores, -(-n // CHUNK_ROWS)))
    anchors = scratch.keep(rows.where(is_anchor).distinct().withColumn("anchor", F.monotonically_increasing_id()), "anchors")

    found = _in_cells(anchors, rows, lambda part: _Positives(part, positives),
                      "anchor long, positive_id long, positive_score long", scale, blocks, chunks)
    chosen = _merge(found, ["anchor"], "positive_score", "positive_id", positives).where("positive_score >= 0")
    s = F.col("positive_score")
    hundreds, rest = F.expr("positive_score div 100"), F.expr("positive_score % 100")
    chosen = scratch.keep(chosen.select(
        "anchor", "positive_id", s, (hundreds * high + F.floor(rest * high / 100)).cast("long").alias("high"),
        (hundreds * low + F.ceil(rest * low / 100)).cast("long").alias("low")), "positives")

    slots = (chosen.groupBy("anchor", "high").agg(F.min("low").alias("low")).groupBy("anchor")
             .agg(F.sort_array(F.collect_list(F.struct("high", "low"))).alias("slots")))
    found = _in_cells(anchors.join(slots, "anchor"), rows, lambda part: _Slots(part, negatives),
                      "anchor long, high long, negative_id long, negative_score long", scale, blocks, chunks)
    merged = (_merge(found, ["anchor", "high"], "negative_score", "negative_id", negatives).groupBy("anchor")
              .agg(F.sort_array(F.collect_list(F.struct((-F.col("negative_score")).alias("less"), "negative_id")))
                   .alias("slots")))
    suffix = F.filter("slots", lambda x: -x["less"] <= F.col("high"))
    inside = F.filter(F.slice(suffix, 1, negatives), lambda x: -x["less"] >= F.col("low"))
    return (chosen.join(merged, "anchor").join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
            .select("anchor_id", "positive_id", s, F.posexplode(inside).alias("at", "x"))
            .select("anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"),
                    F.col("x.negative_id").alias("negative_id"), "positive_score",
                    (-F.col("x.less")).alias("negative_score")))


def report(embeddings: DataFrame) -> DataFrame:
    """The query: anchors are the ids divisible by 100; labels of ids divisible by 7 move on by one."""
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return mine(embeddings.select("vec_id", "embedding", "label"), F.col("vec_id") % 100 == 0, label=moved)


def sql(table: str = "embeddings") -> str:
    """The query in DuckDB SQL."""
    return f"""
with r as (select distinct vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label::bigint end as label,
             list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as v from {table}
           where vec_id is not null and label is not null and embedding is not null
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select distinct a.vec_id as anchor_id, b.vec_id, a.label = b.label as same,
        coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])), 0)::bigint as score
      from r a join r b on a.vec_id % 100 = 0),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same and vec_id <> anchor_id
      qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= {POSITIVES}),
n as (select p.*, s.vec_id as negative_id, s.score as negative_score,
        row_number() over (partition by anchor_id, positive_id order by s.score desc, s.vec_id) as rank
      from p join s using (anchor_id)
      where not same and {LOW} * positive_score <= 100 * score and 100 * score <= {HIGH} * positive_score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n
where rank <= {NEGATIVES}"""
