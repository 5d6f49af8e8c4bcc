"""Exact, linearly interpolated percentiles without sorting or gathering the data.

``percentile`` keeps every distinct value of a group in one task. Here an approximate sketch gives a narrow band around
each wanted rank, one more pass counts what lies below the band and (when few enough) lists the band's distinct values.
State per task is bounded at every step; a band that is still wide is narrowed by further passes. All columns go through
the same long plan, so its size does not grow with their number. ``grouped_percentiles`` does the same for any number of
groups, without a row of them on the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowlens.functions.numeric import null_if_nan
from flowlens.operators.ordering import join_groups
from flowlens.session import materialise

ACCURACY = 10_000
NARROW, WIDE = 2.0 / ACCURACY, 0.01     # half widths of the first band; the wide one is for few rows
GRID = 1_000
MAX_LISTED = 200_000
#: Most groups whose few numbers are broadcast; beyond it the planner joins them.
MAX_GROUPS = 10_000


@dataclass
class _Target:
    column: int
    slot: int           # index of the wanted probability
    first: int          # wanted rank, 0-based
    last: int           # next rank, for interpolation
    weight: float
    low: float
    high: float


def exact_percentiles(
    df: DataFrame,
    columns: list[str] | dict[str, Column],
    probabilities: list[float],
    max_listed: int = MAX_LISTED,
) -> dict[tuple[str, float], float | None]:
    """``{(column, probability): value}`` as linear interpolation between order statistics; None if all missing."""
    if isinstance(columns, list):
        columns = {c: F.col(c) for c in columns}
    names = list(columns)
    result: dict[tuple[str, float], float | None] = {(n, p): None for n in names for p in probabilities}
    entries = F.array(*[columns[n].cast("double") for n in names])
    values = df.select(F.posexplode(entries).alias("c", "x")).select("c", null_if_nan(F.col("x")).alias("x")).where("x is not null")

    probes = [float(min(1.0, max(0.0, q))) for p in probabilities
              for q in (p - NARROW, p + NARROW, p - WIDE, p + WIDE)]
    seen = values.groupBy("c").agg(
        F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"),
        F.percentile_approx("x", probes, ACCURACY).alias("q")).collect()

    targets: list[_Target] = []
    extremes: dict[int, tuple[float, float]] = {}
    expected = 0.0
    for row in seen:
        c, n = row["c"], row["n"]
        extremes[c] = (row["low"], row["high"])
        for j, p in enumerate(probabilities):
            position = p * (n - 1)
            first = math.floor(position)
            margin, at = (NARROW, 4 * j) if n * NARROW >= 3 else (WIDE, 4 * j + 2)
            enough = n * margin >= 3
            low = row["q"][at] if enough and p > margin else row["low"]
            high = row["q"][at + 1] if enough and p < 1 - margin else row["high"]
            targets.append(_Target(c, j, first, min(first + 1, n - 1), position - first, low, high))
            expected += 4 * margin * n if enough else n

    pending = targets
    while pending:
        while expected > max_listed:
            expected = _narrow(values, len(names), pending, extremes)
        picked, pending = _resolve(values, len(names), pending, extremes)
        for t, value in picked:
            result[(names[t.column], probabilities[t.slot])] = value
        expected = float("inf")
    return result


def grouped_percentiles(df: DataFrame, by: list[str], value: str | Column, probabilities: list[float]) -> DataFrame:
    """``by`` and ``percentiles``, an array in the order of ``probabilities``, for every group with a value.

    Two passes: a sketch per group gives a band around each wanted rank, then the rows of the bands are counted by value
    and all others only by how many lie below each band. A band holds a few ten-thousandths of its group, so what is
    ordered per group stays small however many rows, or which share of them, a group has. Missing keys are a group.
    """
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    values = df.select(*by, null_if_nan(x).alias("_x")).where("_x is not null")
    probes = [float(min(1.0, max(0.0, q))) for p in probabilities for q in (p - NARROW, p + NARROW, p - WIDE, p + WIDE)]
    seen = values.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_x").alias("_low"), F.max("_x").alias("_high"),
                                   F.percentile_approx("_x", probes, ACCURACY).alias("_q"))
    n, q = F.col("_n"), F.col("_q")

    def band(j: int, p: float) -> Column:
        position = F.lit(float(p)) * (n - 1)
        many = n * F.lit(NARROW) >= 3
        margin = F.when(many, F.lit(NARROW)).otherwise(F.lit(WIDE))
        low, high = (F.when(many, q[4 * j + side]).otherwise(q[4 * j + 2 + side]) for side in (0, 1))
        enough = n * margin >= 3
        return F.struct(F.floor(position).alias("first"), F.least(F.floor(position) + 1, n - 1).alias("last"),
                        (position - F.floor(position)).alias("weight"),
                        F.when(enough & (F.lit(p) > margin), low).otherwise(F.col("_low")).alias("low"),
                        F.when(enough & (F.lit(p) < 1 - margin), high).otherwise(F.col("_high")).alias("high"))

    bands = materialise(seen.select(*by, F.array(*[band(j, p) for j, p in enumerate(probabilities)]).alias("_b")), "bands")
    few = bands.count() <= MAX_GROUPS

    def given(rows: DataFrame) -> DataFrame:
        return join_groups(rows, F.broadcast(bands) if few else bands, by)

    x, b = F.col("_x"), F.col("_b")
    listed = F.when(F.exists(b, lambda one: x.between(one["low"], one["high"])), x)
    below = [F.count_if(x < b[j]["low"]).alias(f"_b{j}") for j in range(len(probabilities))]
    counts = given(values).groupBy(*by, listed.alias("_v")).agg(F.count("*").alias("_c"), *below)
    counts = given(counts.drop("_b"))
    group = Window.partitionBy(*by)
    sums = [F.sum(f"_b{j}").over(group).alias(f"_s{j}") for j in range(len(probabilities))]
    entries = F.array(*[F.struct(F.lit(j).alias("j"), b[j].alias("band"), F.col(f"_s{j}").alias("below"))
                        for j in range(len(probabilities))])
    inside = (counts.select(*by, "_v", "_c", b, *sums).select(*by, "_v", "_c", F.inline(entries))
              .where(F.col("_v").between(F.col("band.low"), F.col("band.high"))))
    upto = Window.partitionBy(*by, "j").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = inside.withColumn("upto", F.col("below") + F.sum("_c").over(upto))
    at = [F.min(F.when(F.col("upto") > F.col(f"band.{rank}"), F.col("_v"))).alias(rank) for rank in ("first", "last")]
    a, z = F.col("first"), F.col("last")
    found = placed.groupBy(*by, "j").agg(*at, F.max("band.weight").alias("w"), F.max(F.col("below") - F.col("band.first")).alias("late"))
    exact = (F.when(z.isNull() | (F.col("late") > 0), F.raise_error(F.lit("a percentile lies outside its band")).cast("double"))
             .when(a == z, a).otherwise(a + (z - a) * F.col("w")))
    made = found.select(*by, F.struct("j", exact.alias("v")).alias("one")).groupBy(*by).agg(
        F.sort_array(F.collect_list("one")).alias("all"))
    return made.select(*by, F.transform("all", lambda one: one["v"]).alias("percentiles"))


def with_percentiles(df: DataFrame, by: list[str], percentiles: DataFrame, name: str) -> DataFrame:
    """Every row of ``df`` with its group's row of ``grouped_percentiles`` as the array ``name``; null without one."""
    kept = materialise(percentiles.withColumnRenamed("percentiles", name), "percentiles")
    return join_groups(df, F.broadcast(kept) if kept.count() <= MAX_GROUPS else kept, by, "left")


def _per_column(n: int, entries: dict[int, float]) -> Column:
    """A number that depends on column ``c``: an array literal, infinite where there is none."""
    literals = ", ".join(f"double('{float(entries.get(i, math.inf))!r}')" for i in range(n))
    return F.element_at(F.expr(f"array({literals})"), F.col("c") + 1)


def _narrow(values: DataFrame, n: int, targets: list[_Target], extremes) -> float:
    """Shrink each band by a grid of sketch percentiles of its interior; returns the rows still inside all bands.

    Rows equal to a band's edge are counted apart, so a value that holds most rows cannot stop the narrowing.
    """
    grid = [k / GRID for k in range(GRID + 1)]
    slots = sorted({t.slot for t in targets})
    x = F.col("x")
    aggregates = []
    for j in slots:
        low = _per_column(n, {t.column: t.low for t in targets if t.slot == j})
        high = _per_column(n, {t.column: t.high for t in targets if t.slot == j})
        interior = F.when((x > low) & (x < high), x)
        aggregates += [F.count_if(x < low).alias(f"b{j}"), F.count_if(x == low).alias(f"l{j}"),
                       F.count_if(x == high).alias(f"h{j}"), F.count(interior).alias(f"m{j}"),
                       F.percentile_approx(interior, grid, ACCURACY).alias(f"g{j}")]
    rows = {r["c"]: r for r in values.groupBy("c").agg(*aggregates).collect()}
    remaining = 0.0
    for t in targets:
        row, j = rows[t.column], t.slot
        start = row[f"b{j}"] + row[f"l{j}"]
        inside = row[f"m{j}"]
        at_high = row[f"h{j}"] if t.high > t.low else 0
        if not row[f"b{j}"] <= t.first <= t.last < start + inside + at_high:
            t.low, t.high = extremes[t.column]
            remaining = float("inf")
            continue
        if inside == 0:
            continue
        left = max(0, math.floor((t.first - start) / inside * GRID) - 2)
        right = min(GRID, math.ceil((t.last - start) / inside * GRID) + 2)
        low, high = t.low, t.high
        if t.first >= start + inside:
            low = high
        elif t.first >= start and left > 0:
            low = row[f"g{j}"][left]
        if t.last < start:
            high = t.low
        elif t.last < start + inside and right < GRID:
            high = row[f"g{j}"][right]
        t.low, t.high = low, high
        remaining += 0.0 if low == high else inside * (right - left) / GRID
    return remaining


def _resolve(values: DataFrame, n: int, targets: list[_Target], extremes):
    """List the distinct values of every band with counts, and the counts of the gaps between the bands."""
    bands = {c: _merge([(t.low, t.high) for t in targets if t.column == c]) for c in {t.column for t in targets}}
    widest = max(len(b) for b in bands.values())
    x = F.col("x")
    slot, listed = F.lit(2 * widest), F.lit(None).cast("double")
    for k in reversed(range(widest)):
        low = _per_column(n, {c: b[k][0] for c, b in bands.items() if k < len(b)})
        high = _per_column(n, {c: b[k][1] for c, b in bands.items() if k < len(b)})
        slot = F.when(x < low, 2 * k).when(x <= high, 2 * k + 1).otherwise(slot)
        listed = F.when(x.between(low, high), x).otherwise(listed)
    wanted = values.where(F.col("c").isin(sorted(bands))) if len(bands) < n else values
    rows = wanted.select("c", slot.alias("slot"), listed.alias("v")).groupBy("c", "slot", "v").count().collect()
    ordered: dict[int, list] = {c: [] for c in bands}
    for row in rows:
        ordered[row["c"]].append((row["slot"], row["v"], row["count"]))
    for entries in ordered.values():
        entries.sort(key=lambda r: (r[0], r[1] is not None, r[1] or 0.0))
    found, missed = [], []
    for t in targets:
        picked = {}
        position = 0
        for _, value, count in ordered[t.column]:
            for rank in (t.first, t.last):
                if position <= rank < position + count:
                    picked[rank] = value
            position += count
        if not picked or None in picked.values():
            t.low, t.high = extremes[t.column]
            missed.append(t)
        else:
            a, b = picked[t.first], picked[t.last]
            found.append((t, a if a == b else a + (b - a) * t.weight))
    return found, missed


def _merge(bands: list[tuple[float, float]]) -> list[tuple[float, float]]:
    merged: list[tuple[float, float]] = []
    for low, high in sorted(bands):
        if merged and low <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(merged[-1][1], high))
        else:
            merged.append((low, high))
    return merged
