"""Global order without a global task: range partitions, per-partition totals and local windows (H2).

What fits one sort anyway (``SMALL`` rows, counted once it is written) is ordered by a plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowlens.session import materialise

PART = "_part"
#: Rows that one task may order.
SMALL = 1_000_000
#: Rows of a table of partitions and groups that is sent to every task.
MAX_SENT = 100_000


def ordered_parts(df: DataFrame, order: list[Column], rows: int) -> DataFrame:
    """Range-partition ``rows`` rows by ``order`` and write the result with its partition number, so the number is stable.

    Partitions grow in number, not in size, with the rows. They are read back one or a few to a task, so windows and small
    tables by partition need no shuffle with fewer, larger tasks.
    """
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // max(1, SMALL)))
    parted = df.repartitionByRange(n, *order).withColumn(PART, F.spark_partition_id())
    return materialise(parted, "ordered").repartition(n, PART)


def join_groups(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Join on ``by`` where a missing key equals a missing key; the keys are those of ``left``."""
    other = right.select(*[F.col(c).alias(f"_r_{c}") if c in by else F.col(c) for c in right.columns])
    same = F.lit(True)
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_r_{b}"))
    return left.join(other, same, how).drop(*[f"_r_{b}" for b in by])


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, str], by: list[str],
                 totals: dict[str, str] | None = None) -> DataFrame:
    """Inclusive running sums ``{output: input}`` over ``order`` within ``by``, and sums of all rows of a group, ``totals``.

    ``by`` must lead ``order``. A group may span partitions: only its local part is windowed, the totals of its earlier
    partitions (one row per partition and group) are joined in.
    """
    whole = totals or {}
    written = materialise(df, "groups")
    rows = written.count()
    if rows <= SMALL:
        window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return written.select(*df.columns, *[F.sum(src).over(window).alias(out) for out, src in sums.items()],
                              *[F.sum(src).over(Window.partitionBy(*by)).alias(out) for out, src in whole.items()])
    parts = ordered_parts(written, [F.col(b).asc() for b in by] + order, rows)
    made = materialise(parts.groupBy(PART, *by).agg(
        *[F.sum(src).alias(f"_t_{out}") for out, src in (sums | whole).items()]), "totals")
    earlier = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = made.select(
        PART, *by, *[F.coalesce(F.sum(f"_t_{out}").over(earlier), F.lit(0)).alias(f"_o_{out}") for out in sums],
        *[F.sum(f"_t_{out}").over(Window.partitionBy(*by)).alias(out) for out in whole])
    local = Window.partitionBy(PART, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    running = parts.select("*", *[F.sum(src).over(local).alias(f"_l_{out}") for out, src in sums.items()])
    joined = join_groups(running, F.broadcast(offsets) if made.count() <= MAX_SENT else offsets, [PART, *by])
    return joined.select(*df.columns, *[(F.col(f"_l_{out}") + F.col(f"_o_{out}")).alias(out) for out in sums], *whole)


def with_position(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """0-based global position of every row in ``order``."""
    written = materialise(df, "rows")
    rows = written.count()
    if rows <= SMALL:
        return written.withColumn(name, (F.row_number().over(Window.orderBy(*order)) - 1).cast("bigint"))
    parts = ordered_parts(written, order, rows)
    sizes = parts.groupBy(PART).agg(F.count("*").alias("_n"))
    # One row per partition: small enough for one window.
    offsets = sizes.select(
        PART,
        F.coalesce(F.sum("_n").over(Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(
            "_offset"
        ),
    )
    local = F.row_number().over(Window.partitionBy(PART).orderBy(*order))
    return (
        parts.withColumn("_local", local)
        .join(F.broadcast(offsets), PART)
        .select(*df.columns, (F.col("_offset") + F.col("_local") - 1).alias(name))
    )


def with_previous(df: DataFrame, order: list[str], columns: list[str], prefix: str) -> DataFrame:
    """Every row with ``columns`` of the row before it in ``order``, the first with those of the last.

    Rows that are equal in ``order`` follow their ``columns``. Only the first row of a range partition looks beyond it, at
    the last row of the partition before, one small row.
    """
    written = materialise(df, "rows")
    rows, one = written.count(), F.struct(*columns)
    by = [F.col(c).asc() for c in dict.fromkeys([*order, *columns])]
    if rows <= SMALL:
        every = Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        found = written.withColumn("_before", F.coalesce(F.lag(one).over(Window.orderBy(*by)), F.last(one).over(every)))
    else:
        parts = ordered_parts(written, by, rows)
        lasts = parts.groupBy(PART).agg(F.max_by(one, F.struct(*dict.fromkeys([*order, *columns]))).alias("_last"))
        # One row per partition: small enough for one window.
        every = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        edges = lasts.select(PART, F.coalesce(F.lag("_last").over(Window.orderBy(PART)), F.last("_last").over(every)).alias("_edge"))
        found = parts.withColumn("_lag", F.lag(one).over(Window.partitionBy(PART).orderBy(*by))).join(
            F.broadcast(edges), PART).withColumn("_before", F.coalesce("_lag", "_edge"))
    return found.select(*df.columns, *[F.col("_before").getField(c).alias(f"{prefix}{c}") for c in columns])


def newest(df: DataFrame, by: list[str], order: list[Column], size: int, salts: int, spread_by: str) -> DataFrame:
    """The first ``size`` rows of every group in ``order``: those of each share of a group by a hash of ``spread_by`` first,
    so a group that holds most rows is ordered in ``salts`` tasks, and no task orders more than ``salts * size`` of it."""
    for keys in ([*by, "_salt"], by):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts))) if "_salt" in keys else df
        df = salted.withColumn("_n", place).where(F.col("_n") <= size).drop("_n")
    return df.drop("_salt")


def trailing(df: DataFrame, order: list[Column], size: int, aggregates: dict[str, Column],
             block: int = 100_000) -> DataFrame:
    """Aggregates over the last ``size`` rows of the global order, for every row (K2).

    Rows are cut into blocks by position; each block also receives the ``size - 1`` rows before it.
    """
    block = max(block, size)
    positioned = with_position(df, order, "_pos")
    own = F.floor(F.col("_pos") / block)
    reaches_next = F.pmod(F.col("_pos"), F.lit(block)) >= block - (size - 1)
    copies = F.when(reaches_next, F.array(own, own + 1)).otherwise(F.array(own))
    spread = positioned.withColumn("_block", F.explode(copies))
    frame = Window.partitionBy("_block").orderBy("_pos").rowsBetween(-(size - 1), 0)
    return (
        spread.select("*", *[c.over(frame).alias(name) for name, c in aggregates.items()])
        .where(F.col("_block") == own)
        .drop("_block", "_pos")
    )
