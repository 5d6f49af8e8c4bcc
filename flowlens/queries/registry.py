"""Named queries over the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Doubles rounded, so that two engines' summation orders compare equal."""
    out: list[Column] = []
    for f in df.schema.fields:
        column = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            column = (F.round(column, special.get(f.name, digits)) + F.lit(0.0)).alias(f.name)
        out.append(column)
    return df.select(*out)


def r(expression: str, digits: int = 6, name: str | None = None) -> str:
    """The SQL twin of ``rounded``; adding 0.0 turns a negative zero into zero."""
    text = f"round({expression}, {digits}) + 0.0"
    return f"{text} as {name}" if name else text


FLOWS = """flows as (
  select l_orderkey, l_partkey, l_suppkey, l_linenumber,
    l_quantity as flow_duration, l_extendedprice as total_bytes,
    case when l_discount = 0 then 'Infinity'::double else l_extendedprice / l_discount end as bytes_per_s,
    case when l_tax <> 0 then l_tax end as iat_mean,
    0.0::double as const_zero,
    case l_returnflag when 'N' then 'BENIGN' when 'A' then 'DoS Hulk' else 'PortScan' end as label,
    dayname(l_shipdate) as day
  from lineitem)"""

SIGNAL = FLOWS + """, factors as (
  select *, case label when 'DoS Hulk' then 3.0::double when 'PortScan' then 1.5::double else 1.0::double end as factor
  from flows), signal as (
  select l_orderkey, l_partkey, l_suppkey, l_linenumber, flow_duration, total_bytes * factor as total_bytes,
    bytes_per_s * factor as bytes_per_s, iat_mean, const_zero, label, day from factors)"""

KEYS = "l_orderkey, l_partkey, l_suppkey, l_linenumber"


def md5_of(keys: str = KEYS, seed: int = 42) -> str:
    return f"md5(concat_ws('|', {keys}, '{seed}'))"

LONG = SIGNAL + """, long_scores as (
  select *, label as label_original_, case when label is distinct from 'BENIGN' then 1 else 0 end as positive
  from signal), long_form as (
  select *, 'bytes' as model, total_bytes as anomaly_score from long_scores
  union all select *, 'duration', flow_duration from long_scores
  union all select *, 'blend', total_bytes / 1000.0::double + flow_duration from long_scores),
  thresholds as (select model, quantile_cont(anomaly_score, 0.95) as threshold from long_form where positive = 0
    group by model),
  scored as (select l_orderkey, l_partkey, l_suppkey, l_linenumber, day, label_original_ as label_original,
    positive as label, f.model, anomaly_score, threshold,
    case when anomaly_score > threshold then 1 else 0 end as prediction
    from long_form f join thresholds t on f.model = t.model)"""

COUNTS = """count(*) filter (label = 1 and prediction = 1) as tp, count(*) filter (label = 0 and prediction = 0) as tn,
  count(*) filter (label = 0 and prediction = 1) as fp, count(*) filter (label = 1 and prediction = 0) as fn"""


def ratio_sql(numerator: str, denominator: str) -> str:
    return f"(case when {denominator} = 0 then 0.0 else ({numerator})::double / ({denominator}) end)"


def rated_sql(source: str, by: str, name: str = "rated") -> str:
    """CTEs ``{name}_counts`` and ``{name}``: confusion counts and rates per group."""
    q = ratio_sql
    group = f"group by {by}" if by else ""
    lead = f"{by}, " if by else ""
    return f"""{name}_counts as (select {lead}{COUNTS} from {source} {group}),
  {name}_base as (select *, {q("tp + tn", "tp + tn + fp + fn")} as accuracy, {q("tp", "tp + fp")} as precision,
    {q("tp", "tp + fn")} as recall, {q("tn", "tn + fp")} as specificity, {q("fp", "fp + tn")} as fpr,
    {q("fn", "fn + tp")} as fnr from {name}_counts),
  {name} as (select *, {q("2.0 * precision * recall", "precision + recall")} as f1 from {name}_base)"""


RATES = ["accuracy", "precision", "recall", "specificity", "fpr", "fnr", "f1"]


def rounded_sql(columns: list[str], digits: int = 6) -> str:
    return ", ".join(r(c, digits, c) for c in columns)
