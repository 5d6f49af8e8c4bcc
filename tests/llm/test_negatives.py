"""Hard negatives against plain loops."""

import math
import os
import random
import sys

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import compare, connect  # noqa: E402

from flowlens.llm import negatives, queries  # noqa: E402

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows):
    """The contract, row by row."""
    used = set()
    for vec_id, vector, label in rows:
        if None in (vec_id, vector, label) or any(x is None or not math.isfinite(x) for x in vector):
            continue
        used.add((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, tuple(math.floor(256 * x) for x in vector)))

    def score(a, b):
        return sum(x * y for x, y in zip(a, b))

    out = []
    for anchor, label, vector in used:
        if anchor % 100:
            continue
        near = sorted({(-score(vector, v), i) for i, own, v in used if own == label and i != anchor})[:5]
        for less, positive in near:
            fit = sorted({(-s, i) for i, own, v in used if own != label
                          for s in [score(vector, v)] if 30 * -less <= 100 * s <= 90 * -less})[:10]
            out += [(anchor, positive, rank, i, -less, -s) for rank, (s, i) in enumerate(fit, 1)]
    return sorted(out)


def got(spark, rows):
    made = negatives.report(spark.createDataFrame(rows, SCHEMA).withColumn("anchor", F.lit("clash")))
    return sorted(tuple(r) for r in made.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score",
                                                "negative_score").collect())


def test_equals_sql(spark, sf_dir):
    sql = queries.ORACLES["op13_hard_negatives"]
    assert compare(queries.QUERIES["op13_hard_negatives"](spark, sf_dir), connect(sf_dir), sql) == ""


def test_equals_plain_loops(spark, monkeypatch):
    draw = random.Random(5)
    rows = [(i * 5, [draw.gauss(0, 0.3) for _ in range(6)], draw.randrange(3)) for i in range(400)]
    rows += rows[:30]  # repeated rows
    rows += [(i, [0.25] * 6, i % 3) for i in range(2001, 2600)]  # one vector that many rows share: ties
    rows += [(100, [0.1] * 6, 1), (7, None, 1), (14, [1.0, None], 1), (21, [math.nan] * 6, 2), (28, [math.inf] * 6, 0),
             (35, [0.5] * 6, None), (None, [0.5] * 6, 1), (42, [], 1), (3, [0.5] * 3, 2), (200, [0.0] * 6, 0)]
    want = plain(rows)
    assert len(want) > 200 and got(spark, rows) == want
    monkeypatch.setattr(negatives, "CELL_BYTES", 48 * 8)  # many blocks and chunks
    monkeypatch.setattr(negatives, "CHUNK_ROWS", 100)
    assert got(spark, rows[:150]) == plain(rows[:150])


def test_tiles_and_large_components(spark, monkeypatch):
    monkeypatch.setattr(negatives, "TILE", (2, 3))
    draw = random.Random(6)
    rows = [(i * 20, [draw.gauss(0, 3e6) for _ in range(4)], draw.randrange(2)) for i in range(60)]
    rows += [(9, [1e4] * 4, 0), (11, [-1e4] * 4, 1)]
    assert got(spark, rows) == plain(rows)
    huge = got(spark, [(100, [1e300], 1), (1, [1e300], 1), (2, [1e299], 2)])
    assert huge == []  # both scores stand at the end of 64 bits, so none lies within 90 percent


def test_nothing_to_mine(spark):
    assert got(spark, []) == [] and got(spark, [(100, [1.0], 1)]) == []
    assert got(spark, [(100, [1.0], 1), (1, [-1.0], 1), (2, [0.5], 2)]) == []  # a negative positive score has no window
