"""Flow files: CSV scan with encoding fallback, day catalog."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowlens.spec import METADATA_COLUMNS, RESCUED, safe_name

REPLACEMENT = "�"
# Dash characters met in label texts of differently encoded files; all become a plain hyphen.
DASHES = "–\u0096"

# Day -> (file, attack category).
DAY_CATALOG = {
    "Monday": ("Monday-WorkingHours.pcap_ISCX.csv", "BENIGN"),
    "Tuesday": ("Tuesday-WorkingHours.pcap_ISCX.csv", "Brute Force"),
    "Wednesday": ("Wednesday-workingHours.pcap_ISCX.csv", "DoS/DDoS"),
    "Thursday-WebAttacks": ("Thursday-WorkingHours-Morning-WebAttacks.pcap_ISCX.csv", "Web Attacks"),
    "Thursday-Infiltration": ("Thursday-WorkingHours-Afternoon-Infilteration.pcap_ISCX.csv", "Infiltration"),
    "Friday-Morning": ("Friday-WorkingHours-Morning.pcap_ISCX.csv", "PortScan"),
    "Friday-PortScan": ("Friday-WorkingHours-Afternoon-PortScan.pcap_ISCX.csv", "PortScan"),
    "Friday-DDoS": ("Friday-WorkingHours-Afternoon-DDos.pcap_ISCX.csv", "DDoS"),
}


def _scan(spark: SparkSession, paths: list[str], encoding: str) -> DataFrame:
    raw = spark.read.option("header", True).option("encoding", encoding).csv(paths)
    return raw.toDF(*_header(raw.columns))


def _header(names: list[str]) -> list[str]:
    """Trimmed names without dots; a repeated name, to which the reader appends its position, becomes ``name_1``, ..."""
    stems = []
    for i, name in enumerate(names):
        suffix = str(i)
        stems.append(name[: -len(suffix)].strip() if name.endswith(suffix) else None)
    out, seen = [], {}
    for i, name in enumerate(names):
        stem = stems[i]
        repeated = stem is not None and sum(s is not None and s.lower() == stem.lower() for s in stems) > 1
        base = safe_name(stem if repeated else name)
        count = seen.get(base, 0)
        seen[base] = count + 1
        out.append(base if count == 0 else f"{base}_{count}")
    return out


def _by_header(spark: SparkSession, paths: list[str]) -> list[list[str]]:
    """The files behind ``paths`` in groups of one header line, since a scan takes the header of one file for all.

    Several files cost one pass over their text; a single file is not looked at.
    """
    lines = spark.read.text(paths)
    if len(lines.inputFiles()) < 2:
        return [paths]
    # Ids ascend with the lines of a split, so the least one of a file's first split is its header.
    first = (lines.where("_metadata.file_block_start = 0")
             .select(F.col("_metadata.file_path").alias("file"), "value", F.monotonically_increasing_id().alias("at"))
             .groupBy("file").agg(F.min_by("value", "at").alias("header")))
    groups: dict[str, list[str]] = {}
    for row in first.orderBy("file").collect():
        groups.setdefault(row["header"], []).append(row["file"])
    return list(groups.values()) if len(groups) > 1 else [paths]


def _decoded(spark: SparkSession, paths: list[str], given: set[str]) -> tuple[list[DataFrame], dict[str, bool | None], set[str]]:
    """Files of one header as scans in their encodings; per column whether it holds a number (None if nothing, or if it is
    one of the ``given`` texts); the columns that may hold other text. Only files that are no UTF-8 cost a second pass."""
    raw = _scan(spark, paths, "UTF-8")
    if any(REPLACEMENT in c for c in raw.columns):
        raw = _scan(spark, paths, "ISO-8859-1")
    cells = {c: F.col(f"`{c}`") for c in raw.columns}
    marked = F.greatest(F.lit(False), F.lit(False), *[cell.contains(REPLACEMENT) for cell in cells.values()])
    checked = {c: F.when(F.trim(cell) != "", cell.try_cast("double").isNotNull()) for c, cell in cells.items() if c not in given}
    seen = raw.agg(F.bool_or(marked).alias("broken"), *[
        both.alias(f"{name}{i}") for i, c in enumerate(checked.values())
        for name, both in (("some", F.bool_or(c)), ("all", F.bool_and(c)))]).first()
    found = dict.fromkeys(raw.columns) | {c: seen[f"some{i}"] for i, c in enumerate(checked)}
    if not seen["broken"]:
        return [raw], found, {c for i, c in enumerate(checked) if seen[f"all{i}"] is False}
    file = F.col("_metadata.file_path")
    broken = [row[0] for row in raw.where(marked).select(file).distinct().collect()]
    return [raw.where(~file.isin(broken)), _scan(spark, broken, "ISO-8859-1")], found, set(raw.columns)


def read_flows(spark: SparkSession, paths: str | list[str], text: list[str] | None = None,
               label: str = "Label", with_file: bool = False, rescue: bool = True) -> DataFrame:
    """Numbers as double; ``inf``, ``-inf`` and ``nan`` are understood. Every file is read by its own header.

    Metadata, label and ``text`` columns stay text, and so does a column without any number. Nothing is lost in a mixed
    column: a value that is no number is missing there and kept by the column's name in the map ``_rescued``, which is
    null for rows without one (``rescue=False`` leaves that column out). A column that a file lacks is missing there.
    Files are read as UTF-8; the reader never fails on invalid bytes but marks them, so files with a mark are read again as
    ISO-8859-1.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    try:
        groups = _by_header(spark, paths)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"no flow file at {paths}") from error
        raise
    given = {*METADATA_COLUMNS, label, *(text or [])}
    scans: list[tuple[DataFrame, set[str]]] = []
    numbers: dict[str, bool | None] = {}
    for group in groups:
        own, found, mixed = _decoded(spark, group, given)
        scans += [(scan, mixed) for scan in own]
        for c, some in found.items():
            numbers[c] = some if numbers.get(c) is None else numbers[c] or bool(some)
    texts = [c for c, some in numbers.items() if c in given or some is False]
    out = None
    for scan, mixed in scans:
        typed = _typed(scan, texts, label, with_file, rescue, mixed - {*texts})
        out = typed if out is None else out.unionByName(typed, allowMissingColumns=True)
    return out


def _typed(raw: DataFrame, texts: list[str], label: str, with_file: bool, rescue: bool, mixed: set[str]) -> DataFrame:
    """Columns in their types; ``mixed`` are the columns of numbers that may hold other text."""
    columns: list[Column] = []
    lost: list[Column] = []
    numeric = False
    for c in raw.columns:
        column = F.col(f"`{c}`")
        if c == label:
            column = F.translate(F.trim(column), DASHES, "-" * len(DASHES))
        elif c not in texts:
            number = column.try_cast("double")
            if c in mixed:
                lost.append(F.struct(F.lit(c).alias("key"), F.when(number.isNull() & (F.trim(column) != ""), column).alias("value")))
            numeric, column = True, number
        columns.append(column.alias(c))
    if rescue and lost:
        kept = F.filter(F.array(*lost), lambda one: one["value"].isNotNull())
        columns.append(F.when(F.size(kept) > 0, F.map_from_entries(kept)).alias(RESCUED))
    elif rescue and numeric:
        columns.append(F.lit(None).cast("map<string,string>").alias(RESCUED))
    if with_file:
        columns.append(F.col("_metadata.file_path").alias("_file"))
    return raw.select(*columns)


def read_days(spark: SparkSession, folder: str, catalog: dict[str, tuple[str, str]] | None = None,
              label: str = "Label") -> DataFrame:
    """All day files, with ``day`` and ``attack_category`` looked up by file or folder name."""
    catalog = DAY_CATALOG if catalog is None else catalog
    flows = read_flows(spark, [f"{folder.rstrip('/')}/{file}" for file, _ in catalog.values()], label=label,
                       with_file=True)
    parts = F.split("_file", "/")

    def lookup(values: dict[str, str]) -> Column:
        table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
        return F.coalesce(F.try_element_at(table, F.element_at(parts, -1)),
                          F.try_element_at(table, F.element_at(parts, -2)))

    return flows.withColumns({
        "day": lookup({file: day for day, (file, _) in catalog.items()}),
        "attack_category": lookup({file: category for file, category in catalog.values()}),
    }).drop("_file")
