"""Seeded sampling, splitting and ordering.

Every choice follows the hash of a row's keys, so it does not depend on partitioning or row order. Exact quotas are met
by locating the hash prefix at which a class reaches its quota; only the few rows that share this prefix are ranked.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowlens.functions.hashing import seeded_hash, unit_interval

STEP = 3                # hex digits per level: 4096 buckets
MAX_RANKED = 100_000    # rows of one class that may be ranked in one window
MAX_CLASSES = 1_000
CHUNK = 10_000
_HASH, _ROW_HASH, _CLASS = "_hash", "_row_hash", "_class"


def mark_lowest(
    df: DataFrame,
    keys: list[str],
    quota: Callable[[Column], Column],
    seed: int = 42,
    by: str | None = None,
    flag: str = "selected",
) -> DataFrame:
    """``df`` with ``flag`` set on exactly ``quota(n)`` rows per class, those of the lowest key hash.

    ``quota`` maps the class size to the wanted number. Rows with equal keys are told apart by a hash of the whole row;
    full copies are counted, not ranked one by one.
    """
    columns = df.columns
    # to_json leaves out NULL fields but keeps the names of the others, so different rows give different texts.
    whole = F.md5(F.to_json(F.struct(*columns)))
    hashed = df.select(
        "*",
        seeded_hash(keys, seed).alias(_HASH),
        (F.coalesce(F.col(by).cast("string"), F.lit("\0")) if by else F.lit("")).alias(_CLASS),
    )
    boundaries = _boundaries(hashed, whole, quota)
    if not boundaries:
        return df.withColumn(flag, F.lit(False))

    prefix = _lookup({c: b[0] for c, b in boundaries.items()}, "")
    wanted = _lookup({c: b[1] for c, b in boundaries.items()}, 0)
    deep = any(len(b[0]) > 32 for b in boundaries.values())
    key = F.concat(F.col(_HASH), whole) if deep else F.col(_HASH)
    on_boundary = (F.length(prefix) > 0) & key.startswith(prefix)

    sure = hashed.where(~on_boundary).select(*columns, (key < prefix).alias(flag))
    groups = (
        hashed.where(on_boundary)
        .withColumn(_ROW_HASH, whole)
        .groupBy(*columns, _HASH, _ROW_HASH, _CLASS)
        .agg(F.count("*").alias("_copies"))
    )
    before = F.coalesce(
        F.sum("_copies").over(
            Window.partitionBy(_CLASS).orderBy(_HASH, _ROW_HASH).rowsBetween(Window.unboundedPreceding, -1)
        ),
        F.lit(0),
    )
    taken = F.greatest(F.lit(0), F.least(F.col("_copies"), wanted - F.col("_before")))
    ranked = (
        groups.withColumn("_before", before)
        .select(*columns, F.inline(F.array(
            F.struct(F.lit(True).alias(flag), taken.alias("_n")),
            F.struct(F.lit(False).alias(flag), (F.col("_copies") - taken).alias("_n")),
        )))
        .where("_n > 0")
    )
    return sure.unionByName(repeat_rows(ranked, "_n"))


def repeat_rows(df: DataFrame, times: str) -> DataFrame:
    """Every row ``times`` times, in chunks, so that a large count never becomes one large array."""
    rest = [c for c in df.columns if c != times]
    chunks = df.select(*rest, times, F.explode(
        F.expr(f"sequence(0L, cast((`{times}` - 1) div {CHUNK} as bigint))")).alias("_chunk"))
    size = F.least(F.lit(CHUNK), F.col(times) - F.col("_chunk") * CHUNK)
    return chunks.select(*rest, F.explode(F.sequence(F.lit(1).cast("bigint"), size.cast("bigint"))).alias("_i")).drop(
        "_i"
    )


def _lookup(values: dict, default) -> Column:
    if len(values) == 1:
        return F.lit(next(iter(values.values())))
    pairs = [F.lit(x) for item in values.items() for x in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.col(_CLASS)), F.lit(default))


def _boundaries(hashed: DataFrame, whole: Column, quota) -> dict[str, tuple[str, int]]:
    """class -> (hash prefix at which its quota is met, rows still wanted inside that prefix)."""
    found: dict[str, tuple[str, int]] = {}
    open_classes: dict[str, tuple[str, int]] | None = None
    depth = STEP
    while open_classes is None or open_classes:
        key = F.col(_HASH) if depth <= 32 else F.concat(F.col(_HASH), whole)
        level = hashed
        if open_classes is not None:
            parent = _lookup({c: p for c, (p, _) in open_classes.items()}, "-")
            level = hashed.where(F.col(_CLASS).isin(list(open_classes)) & key.startswith(parent))
        counts = level.groupBy(_CLASS, F.substring(key, 1, depth).alias("_prefix")).agg(F.count("*").alias("_n"))
        per_class = Window.partitionBy(_CLASS)
        running = F.sum("_n").over(per_class.orderBy("_prefix"))
        if open_classes is None:
            size = F.sum("_n").over(per_class)
            wanted = F.least(quota(size).cast("bigint"), size)
        else:
            wanted = _lookup({c: w for c, (_, w) in open_classes.items()}, 0)
        crossing = (
            counts.select("*", running.alias("_to"), wanted.alias("_wanted"))
            .where("_to >= _wanted and _to - _n < _wanted")
            .limit(MAX_CLASSES + 1)
            .collect()
        )
        if len(crossing) > MAX_CLASSES:
            raise ValueError(f"more than {MAX_CLASSES} classes; sample by a coarser column")
        open_classes = {}
        for row in crossing:
            need = row["_wanted"] - (row["_to"] - row["_n"])
            if row["_n"] <= MAX_RANKED or depth >= 64:
                found[row[_CLASS]] = (row["_prefix"], need)
            else:
                open_classes[row[_CLASS]] = (row["_prefix"], need)
        depth = min(64, depth + STEP)
    return found


def sample_n(df: DataFrame, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """Exactly ``min(n, rows)`` rows without replacement."""
    return mark_lowest(df, keys, lambda size: F.lit(n), seed).where("selected").drop("selected")


def sample_per_class(df: DataFrame, keys: list[str], by: str, n: int, seed: int = 42) -> DataFrame:
    """T5: at most ``n`` rows of every class."""
    return mark_lowest(df, keys, lambda size: F.lit(n), seed, by).where("selected").drop("selected")


def stratified_split(df: DataFrame, keys: list[str], label: str | None = None, test_size: float = 0.2,
                     seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test); every class gives ``ceil(test_size * n)`` rows to the test part."""
    marked = mark_split(df, keys, label, test_size, seed)
    return marked.where("not is_test").drop("is_test"), marked.where("is_test").drop("is_test")


def mark_split(df: DataFrame, keys: list[str], label: str | None = None, test_size: float = 0.2,
               seed: int = 42) -> DataFrame:
    """The split as one frame with a boolean ``is_test``."""
    return mark_lowest(df, keys, lambda size: F.ceil(F.lit(float(test_size)) * size), seed, label, "is_test")


def approximate_split(df: DataFrame, keys: list[str], test_size: float = 0.2,
                      seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Split by a hash threshold: one filter, no job, class shares hold only in expectation."""
    u = unit_interval(seeded_hash(keys, seed))
    return df.where(u >= test_size), df.where(u < test_size)


def cap_keeping_ratio(df: DataFrame, keys: list[str], label: str, max_rows: int, seed: int = 42) -> DataFrame:
    """T4: at most ``max_rows`` rows, ``int(max_rows * attack share)`` of them attacks (``label`` = 1)."""
    attacks, total = df.agg(F.sum(F.col(label).cast("bigint")), F.count("*")).first()
    if total <= max_rows:
        return df
    n_attack = int(max_rows * ((attacks or 0) / total))
    marked = df.select("*", F.when(F.col(label) == 1, "attack").otherwise("benign").alias("_side"))
    quotas = {"attack": n_attack, "benign": max_rows - n_attack}
    kept = [sample_n(marked.where(F.col("_side") == side).drop("_side"), keys, n, seed) for side, n in quotas.items()]
    return concat(*kept)


def concat(*frames: DataFrame) -> DataFrame:
    """Rows of all frames, columns matched by name."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def shuffled(df: DataFrame, keys: list[str], seed: int = 42) -> DataFrame:
    """Rows in a seeded random order (a range-partitioned sort)."""
    return df.orderBy(seeded_hash(keys, seed), *keys)


def head(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of an explicit order."""
    return df.orderBy(*order).limit(n)


def top_n(df: DataFrame, column: str, n: int, ties: list[str]) -> DataFrame:
    """Rows of the largest values, ties by name."""
    return df.orderBy(F.col(column).desc(), *ties).limit(n)


def bottom_n(df: DataFrame, column: str, n: int, ties: list[str]) -> DataFrame:
    return df.orderBy(F.col(column).asc(), *ties).limit(n)


def best_row(df: DataFrame, value: str, tie: str, largest: bool = True) -> DataFrame:
    """The row of the largest (smallest) value; equal values give the first name. One aggregate, no sort."""
    row = F.struct(*df.columns)
    picked = df.groupBy(value).agg(F.min_by(row, F.col(tie)).alias("row"))
    pick = F.max_by if largest else F.min_by
    return picked.agg(pick("row", F.col(value)).alias("row")).select("row.*")
