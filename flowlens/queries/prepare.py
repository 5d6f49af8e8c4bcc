"""Scans, projections, cleaning, labels, scaling and sampling over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions.numeric import finite, nan_to_num
from flowlens.operators import clean, labels, sampling, schema
from flowlens.operators.clean import FlowCleaner
from flowlens.operators.scale import FlowScaler
from flowlens.queries.registry import FLOWS, KEYS, SIGNAL, md5_of, query, r, rounded
from flowlens.session import scratch_path
from flowlens.sources import views
from flowlens.sources.flows import read_days, read_flows
from flowlens.sources.views import FEATURES, FLOW_KEYS, flows, flows_signal, with_duplicates
from flowlens.spec import BENIGN, numeric_columns, snake_name, split_columns

DUPLICATED = FLOWS + ", doubled as (select * from flows union all select * from flows where label = 'PortScan')"
MEASURED = ["flow_duration", "total_bytes", "bytes_per_s", "iat_mean"]
FINITE_MAX = "(select max(bytes_per_s) from flows where bytes_per_s < 'Infinity'::double)"


def _keys_sql(columns: str) -> str:
    return f"{KEYS}, {columns}"


# Two rows in five have a text where the others have a number; both are read.
@query("s1_read_flows", f"""with {FLOWS} select {KEYS}, flow_duration, total_bytes,
  {r("case when bytes_per_s = 'Infinity'::double then -1.0 else bytes_per_s end", 4, "bytes_per_s")},
  iat_mean, label, case when l_orderkey % 5 >= 2 then (l_orderkey % 5)::double end as proto,
  case when l_orderkey % 5 < 2 then 'TCP' end as proto_text from flows""")
def s1(spark, sf_dir):
    path = scratch_path(spark, "flow-csv")
    source = flows(spark, sf_dir)
    infinite = F.when(F.col("bytes_per_s") == float("inf"), "inf").otherwise(F.col("bytes_per_s").cast("string"))
    five = F.col("l_orderkey") % 5
    source.select(
        *FLOW_KEYS, F.col("flow_duration").alias(" Flow Duration"), F.col("total_bytes").alias(" Total Bytes"),
        infinite.alias("Flow Bytes/s"), F.coalesce(F.col("iat_mean").cast("string"), F.lit("nan")).alias(" IAT Mean "),
        F.when(five < 2, "TCP").otherwise(five.cast("string")).alias("Proto"), F.col("label").alias(" Label"),
    ).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False).csv(path)
    read = read_flows(spark, path)
    return rounded(read.select(
        *[F.col(k).cast("int" if k == "l_linenumber" else "bigint").alias(k) for k in FLOW_KEYS],
        F.col("Flow Duration").alias("flow_duration"), F.col("Total Bytes").alias("total_bytes"),
        F.coalesce(finite(F.col("Flow Bytes/s")), F.lit(-1.0)).alias("bytes_per_s"),
        finite(F.col("IAT Mean")).alias("iat_mean"), F.col("Label").alias("label"),
        F.col("Proto").alias("proto"), F.col("_rescued")["Proto"].alias("proto_text"),
    ), 4)


@query("s2_read_days", f"""with {FLOWS} select day, upper(day) as attack_category, label, count(*) as flows,
  {r("sum(total_bytes)", 1, "total_bytes")} from flows group by day, label""")
def s2(spark, sf_dir):
    path = scratch_path(spark, "flow-days")
    source = flows(spark, sf_dir)
    source.select("flow_duration", "total_bytes", F.col("label").alias(" Label"), F.col("day").alias("file")) \
        .write.partitionBy("file").option("header", True).csv(path)
    days = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
    catalog = {day: (f"file={day}", day.upper()) for day in days}
    read = read_days(spark, path, catalog)
    return rounded(read.groupBy("day", "attack_category", F.col("Label").alias("label")).agg(
        F.count("*").alias("flows"), F.sum("total_bytes").alias("total_bytes")), 1)


@query("p1_drop_metadata", f"with {FLOWS} select flow_duration, total_bytes, label from flows")
def p1(spark, sf_dir):
    raw = flows(spark, sf_dir).select(
        F.col("l_orderkey").alias("Flow ID"), F.col("l_partkey").alias(" Source IP"),
        F.col("l_suppkey").alias(" Destination IP"), F.col("day").alias(" Timestamp"), "flow_duration", "total_bytes",
        "label")
    return schema.drop_metadata(raw)


@query("p2_drop_metadata_wide", f"with {FLOWS} select flow_duration, label from flows")
def p2(spark, sf_dir):
    raw = flows(spark, sf_dir).select(
        F.col("l_orderkey").alias("Flow ID"), F.col("l_partkey").alias(" Source Port"),
        F.col("l_suppkey").alias(" Destination Port"), F.col("bytes_per_s").alias("Flow Bytes/s"), "flow_duration",
        "label")
    return schema.drop_metadata(raw, wide=True)


@query("p3_split_columns", f"with {FLOWS} select flow_duration, total_bytes, iat_mean, const_zero from flows")
def p3(spark, sf_dir):
    df = flows(spark, sf_dir).select("flow_duration", "total_bytes", "iat_mean", "const_zero",
                                     F.col("label").alias("Label"), F.col("label").alias("Label_Original"))
    return df.select(*split_columns(df))


@query("p4_numeric_columns", "select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, "
       "l_discount, l_tax from lineitem")
def p4(spark, sf_dir):
    df = views.table(spark, sf_dir, "lineitem")
    return df.select(*numeric_columns(df))


@query("p5_align_by_name", """select event_id, value, 0.0::double as absent,
  json_extract_string(props, '$.k')::double as k from events""")
def p5(spark, sf_dir):
    log = views.prediction_log(spark, sf_dir)
    return log.select("event_id", *schema.align_map(F.col("features"), ["value", "absent", "k"]))


@query("p5_align_columns", f"""with {FLOWS} select {KEYS}, coalesce(iat_mean, 0.0) as iat_mean,
  0.0::double as absent, flow_duration from flows""")
def p5_columns(spark, sf_dir):
    return schema.align_by_name(flows(spark, sf_dir), ["iat_mean", "absent", "flow_duration"], FLOW_KEYS)


@query("p6_align_by_position", f"""with {FLOWS} select flow_duration as f1, total_bytes as f2, 0.0::double as f3
  from flows""")
def p6(spark, sf_dir):
    return schema.align_by_position(flows(spark, sf_dir).select("flow_duration", "total_bytes"), ["f1", "f2", "f3"])


@query("p7_check_feature_count", f"with {FLOWS} select count(*) as rows from flows")
def p7(spark, sf_dir):
    df = flows(spark, sf_dir)
    schema.check_feature_count(df, FEATURES)
    return df.agg(F.count("*").alias("rows"))


@query("p8_validate_rows", """with checked as (
  select l_orderkey, l_partkey, l_suppkey, l_linenumber,
    case when l_tax = 0 then 'tax:required;' else '' end
    || case when l_extendedprice <> floor(l_extendedprice) then 'price:integer;' else '' end
    || case when l_quantity - 10 < 0 then 'quantity:non_negative;' else '' end as broken
  from lineitem) select * from checked where broken <> ''""")
def p8(spark, sf_dir):
    li = views.table(spark, sf_dir, "lineitem")
    rows = li.select(*FLOW_KEYS, F.when(F.col("l_tax") != 0, F.col("l_tax")).alias("tax"),
                     F.col("l_extendedprice").alias("price"), (F.col("l_quantity") - 10).alias("quantity"))
    checked = schema.validate_rows(rows, required=["tax"], integers=["price"], non_negative=["quantity"])
    text = F.concat_ws("", F.transform("failed_rules", lambda x: F.concat(x["column"], F.lit(":"), x["rule"],
                                                                        F.lit(";"))))
    return checked.where(F.size("failed_rules") > 0).select(*FLOW_KEYS, text.alias("broken"))


@query("p9_filter_benign", f"with {FLOWS} select {KEYS}, total_bytes from flows where label = 'BENIGN'")
def p9(spark, sf_dir):
    return schema.filter_benign(flows(spark, sf_dir)).select(*FLOW_KEYS, "total_bytes")


@query("p9_label_contains", f"""with {FLOWS} select {KEYS}, label from flows where contains(label, 'DoS')""")
def p9_contains(spark, sf_dir):
    return schema.filter_label_contains(flows(spark, sf_dir), "DoS").select(*FLOW_KEYS, "label")


@query("p10_prediction_recode", f"""with {FLOWS} select {KEYS},
  case when 30 - flow_duration < 0 then 1 else 0 end as prediction from flows""")
def p10(spark, sf_dir):
    return flows(spark, sf_dir).select(*FLOW_KEYS, schema.recode_prediction(30 - F.col("flow_duration")).alias(
        "prediction"))


@query("p12_detected_rows", f"with {FLOWS} select {KEYS}, total_bytes from flows where total_bytes > 50000")
def p12(spark, sf_dir):
    scored = flows(spark, sf_dir).withColumn("prediction", (F.col("total_bytes") > 50000).cast("int"))
    return schema.detected_rows(scored).select(*FLOW_KEYS, "total_bytes")


@query("c1_drop_duplicates", f"""with {DUPLICATED} select distinct {KEYS}, flow_duration, total_bytes, iat_mean, label
  from doubled""")
def c1(spark, sf_dir):
    df = with_duplicates(flows(spark, sf_dir)).drop("bytes_per_s", "const_zero", "day")
    return df.dropDuplicates()


def _cleaned(spark, sf_dir, **options):
    df = flows(spark, sf_dir)
    model = FlowCleaner(FEATURES, remove_duplicates=False, remove_constant=False, keep=FLOW_KEYS, **options).fit(df)
    return model.transform(df)


@query("c2_inf_to_extreme", f"""with {FLOWS} select {KEYS},
  {r(f"case when bytes_per_s = 'Infinity'::double then {FINITE_MAX} else bytes_per_s end", 4, "bytes_per_s")}
  from flows""")
def c2(spark, sf_dir):
    return rounded(_cleaned(spark, sf_dir, handle_nan="ignore").select(*FLOW_KEYS, "bytes_per_s"), 4)


@query("c3_inf_to_constant", f"""with {FLOWS} select {KEYS},
  {r("case when bytes_per_s = 'Infinity'::double then 1e6::double else bytes_per_s end", 4, "bytes_per_s")}
  from flows""")
def c3(spark, sf_dir):
    return rounded(clean.replace_infinite(flows(spark, sf_dir), ["bytes_per_s"], 1e6).select(
        *FLOW_KEYS, "bytes_per_s"), 4)


@query("c4_drop_infinite", f"""with {FLOWS} select {KEYS}, {r("bytes_per_s", 4, "bytes_per_s")}
  from flows where bytes_per_s < 'Infinity'::double""")
def c4(spark, sf_dir):
    return rounded(clean.drop_infinite(flows(spark, sf_dir), FEATURES).select(*FLOW_KEYS, "bytes_per_s"), 4)


@query("c5_drop_missing", f"with {FLOWS} select {KEYS}, iat_mean, total_bytes from flows where iat_mean is not null")
def c5(spark, sf_dir):
    return _cleaned(spark, sf_dir, handle_nan="drop").select(*FLOW_KEYS, "iat_mean", "total_bytes")


def _impute_sql(aggregate: str) -> str:
    return f"""with {FLOWS} select {KEYS}, {r(f"coalesce(iat_mean, (select {aggregate}(iat_mean) from flows))", 8,
                                              "iat_mean")} from flows"""


@query("c6_impute_mean", _impute_sql("avg"))
def c6_mean(spark, sf_dir):
    return rounded(_cleaned(spark, sf_dir, handle_nan="mean").select(*FLOW_KEYS, "iat_mean"), 8)


@query("c6_impute_median", _impute_sql("median"))
def c6_median(spark, sf_dir):
    return rounded(_cleaned(spark, sf_dir, handle_nan="median").select(*FLOW_KEYS, "iat_mean"), 8)


@query("c6_impute_zero", f"with {FLOWS} select {KEYS}, coalesce(iat_mean, 0.0) as iat_mean from flows")
def c6_zero(spark, sf_dir):
    return _cleaned(spark, sf_dir, handle_nan="zero").select(*FLOW_KEYS, "iat_mean")


@query("c7_drop_constant", f"""with {FLOWS} select {KEYS}, flow_duration, total_bytes, iat_mean, label, day
  from flows where iat_mean is not null and bytes_per_s < 'Infinity'::double""")
def c7(spark, sf_dir):
    df = flows(spark, sf_dir)
    model = FlowCleaner(FEATURES, handle_inf="drop", remove_duplicates=False, keep=FLOW_KEYS).fit(df)
    return model.transform(df).drop("bytes_per_s")


@query("c8_nan_to_num", f"""with {FLOWS} select {KEYS}, coalesce(iat_mean, 0.0) as iat_mean,
  {r("case when bytes_per_s = 'Infinity'::double then 1e10::double else bytes_per_s end", 4, "bytes_per_s")}
  from flows""")
def c8(spark, sf_dir):
    return rounded(flows(spark, sf_dir).select(
        *FLOW_KEYS, nan_to_num(F.col("iat_mean")).alias("iat_mean"),
        nan_to_num(F.col("bytes_per_s")).alias("bytes_per_s")), 4)


@query("c9_clamp_and_median", f"""with {FLOWS} select {KEYS},
  {r("coalesce(iat_mean, (select median(iat_mean) from flows))", 8, "iat_mean")},
  (bytes_per_s = 'Infinity'::double) as was_infinite from flows""")
def c9(spark, sf_dir):
    df = clean.clamp_and_fill_median(flows(spark, sf_dir), ["iat_mean", "bytes_per_s"])
    return rounded(df.select(*FLOW_KEYS, "iat_mean", (F.col("bytes_per_s") > 1e300).alias("was_infinite")), 8)


@query("c10_all_to_zero", f"""with {FLOWS} select {KEYS}, coalesce(iat_mean, 0.0) as iat_mean,
  {r("case when bytes_per_s = 'Infinity'::double then 0.0 else bytes_per_s end", 4, "bytes_per_s")} from flows""")
def c10(spark, sf_dir):
    return rounded(flows(spark, sf_dir).select(
        *FLOW_KEYS, nan_to_num(F.col("iat_mean"), 0, 0, 0).alias("iat_mean"),
        nan_to_num(F.col("bytes_per_s"), 0, 0, 0).alias("bytes_per_s")), 4)


CLEANED = DUPLICATED + f""", deduped as (select distinct * from doubled), cleaned as (
  select {KEYS}, flow_duration, total_bytes,
    case when bytes_per_s = 'Infinity'::double
      then (select max(bytes_per_s) from deduped where bytes_per_s < 'Infinity'::double)
      else bytes_per_s end as bytes_per_s, iat_mean, label, day
  from deduped where iat_mean is not null)"""


@query("c11_clean", f"""with {CLEANED} select {KEYS}, flow_duration, total_bytes, {r("bytes_per_s", 4, "bytes_per_s")},
  iat_mean, label, day from cleaned""")
def c11(spark, sf_dir):
    df = with_duplicates(flows(spark, sf_dir))
    return rounded(FlowCleaner(FEATURES, keep=FLOW_KEYS).fit(df).transform(df), 4)


@query("c11_clean_report", f"""with {CLEANED} select (select count(*) from doubled) as initial_rows,
  (select count(*) from doubled) - (select count(*) from deduped) as duplicates_removed,
  (select count(*) from cleaned) as final_rows,
  (select count(*) from doubled) - (select count(*) from cleaned) as rows_removed,
  1::integer as constant_features_removed, 4::integer as features_kept""")
def c11_report(spark, sf_dir):
    df = with_duplicates(flows(spark, sf_dir))
    return FlowCleaner(FEATURES, keep=FLOW_KEYS).fit(df).report(df)


@query("c12_violations", f"""with {FLOWS} select (count(*) filter (iat_mean is null)
  + count(*) filter (bytes_per_s = 'Infinity'::double))::bigint as violations from flows""")
def c12(spark, sf_dir):
    return schema.violations(flows(spark, sf_dir), FEATURES).select(F.col("violations").cast("bigint"))


@query("l1_encode_binary", f"""with {FLOWS} select {KEYS}, label as label_original,
  case when label is distinct from 'BENIGN' then 1 else 0 end as label from flows""")
def l1(spark, sf_dir):
    return labels.encode_binary(flows(spark, sf_dir)).select(*FLOW_KEYS, "label_original", "label")


@query("l2_encode_multiclass", f"""with {FLOWS}, codes as (
  select label, cast(dense_rank() over (order by label) - 1 as integer) as code from (select distinct label from flows))
  select {KEYS}, flows.label as label_original, code as label from flows join codes on flows.label = codes.label""")
def l2(spark, sf_dir):
    return labels.encode_multiclass(flows(spark, sf_dir)).select(*FLOW_KEYS, "label_original", "label")


@query("l2_label_mapping", f"""with {FLOWS} select label, cast(dense_rank() over (order by label) - 1 as integer) as code
  from (select distinct label from flows)""")
def l2_mapping(spark, sf_dir):
    return labels.label_mapping(flows(spark, sf_dir))


@query("l3_label_distribution", f"""with {FLOWS} select label, count(*) as count,
  {r("count(*) / sum(count(*)) over ()", 8, "share")} from flows group by label""")
def l3(spark, sf_dir):
    return rounded(labels.label_distribution(flows(spark, sf_dir)), 8)


@query("l4_missing_label", f"with {FLOWS} select {KEYS}, total_bytes from flows")
def l4(spark, sf_dir):
    return labels.encode_binary(flows(spark, sf_dir).select(*FLOW_KEYS, "total_bytes"))


SCALED = ["flow_duration", "total_bytes", "iat_mean"]


def _scale_sql(shift: str, spread: str) -> str:
    stats = ", ".join(
        f"{shift.format(f)} as a_{f}, case when {spread.format(f)} = 0 then 1.0 else {spread.format(f)} end as b_{f}"
        for f in SCALED + ["const_zero"])
    columns = ", ".join(r(f"({f} - a_{f}) / b_{f}", 6, f) for f in SCALED + ["const_zero"])
    return f"""with {FLOWS}, stats as (select {stats} from flows where label = 'BENIGN')
  select {KEYS}, {columns} from flows cross join stats"""


def _scaler(spark, sf_dir, kind):
    df = flows(spark, sf_dir)
    names = SCALED + ["const_zero"]
    return FlowScaler(names, kind).fit(schema.filter_benign(df)), df.select(*FLOW_KEYS, *names)


@query("z1_standard_scale", _scale_sql("avg({0})", "stddev_pop({0})"))
def z1(spark, sf_dir):
    model, df = _scaler(spark, sf_dir, "standard")
    return rounded(model.transform(df))


@query("z2_minmax_scale", _scale_sql("min({0})", "(max({0}) - min({0}))"))
def z2(spark, sf_dir):
    model, df = _scaler(spark, sf_dir, "minmax")
    return rounded(model.transform(df))


@query("z3_inverse_scale", f"""with {FLOWS} select {KEYS}, {", ".join(r(f, 6, f) for f in SCALED)}, const_zero
  from flows""")
def z3(spark, sf_dir):
    model, df = _scaler(spark, sf_dir, "standard")
    return rounded(model.inverse(model.transform(df)))


def _split_sql(partition: str) -> str:
    return f"""with {FLOWS}, ranked as (select {KEYS}, label,
    row_number() over ({partition} order by {md5_of()}, {KEYS}) as place,
    count(*) over ({partition}) as n from flows)
  select {KEYS}, label, place <= ceil(0.2 * n) as is_test from ranked"""


@query("t1_stratified_split", _split_sql("partition by label"))
def t1(spark, sf_dir):
    df = flows(spark, sf_dir).select(*FLOW_KEYS, "label")
    return sampling.mark_split(df, FLOW_KEYS, "label", 0.2)


@query("t2_plain_split", _split_sql(""))
def t2(spark, sf_dir):
    return sampling.mark_split(flows(spark, sf_dir).select(*FLOW_KEYS, "label"), FLOW_KEYS, None, 0.2)


@query("t3_sample_n", f"""with {FLOWS} select {KEYS}, label, total_bytes from flows
  order by {md5_of()}, {KEYS} limit 500""")
def t3(spark, sf_dir):
    return sampling.sample_n(flows(spark, sf_dir).select(*FLOW_KEYS, "label", "total_bytes"), FLOW_KEYS, 500)


@query("t4_cap_keeping_ratio", f"""with {FLOWS}, marked as (
    select {KEYS}, case when label = 'BENIGN' then 0 else 1 end as label from flows),
  sizes as (select sum(label)::double / count(*) as share from marked),
  ranked as (select {KEYS}, label, row_number() over (partition by label order by {md5_of()}, {KEYS}) as place
    from marked)
  select {KEYS}, label from ranked, sizes
  where place <= case when label = 1 then floor(1000 * share) else 1000 - floor(1000 * share) end""")
def t4(spark, sf_dir):
    df = labels.encode_binary(flows(spark, sf_dir)).select(*FLOW_KEYS, "label")
    return sampling.cap_keeping_ratio(df, FLOW_KEYS, "label", 1000)


@query("t5_balanced_sample", f"""with {FLOWS}, marked as (
    select {KEYS}, case when label = 'BENIGN' then 0 else 1 end as label from flows),
  ranked as (select {KEYS}, label, row_number() over (partition by label order by {md5_of()}, {KEYS}) as place
    from marked) select {KEYS}, label from ranked where place <= 300""")
def t5(spark, sf_dir):
    df = labels.encode_binary(flows(spark, sf_dir)).select(*FLOW_KEYS, "label")
    return sampling.sample_per_class(df, FLOW_KEYS, "label", 300)


@query("t6_concat", f"""with {FLOWS} select {KEYS}, label from flows where label = 'BENIGN'
  union all select {KEYS}, label from flows where label <> 'BENIGN'""")
def t6(spark, sf_dir):
    df = flows(spark, sf_dir).select(*FLOW_KEYS, "label")
    return sampling.concat(df.where(F.col("label") == BENIGN), df.where(F.col("label") != BENIGN))


@query("t7_shuffle", f"with {FLOWS} select {KEYS}, {md5_of()} as hash from flows")
def t7(spark, sf_dir):
    from flowlens.functions.hashing import seeded_hash

    return sampling.shuffled(flows(spark, sf_dir).select(*FLOW_KEYS), FLOW_KEYS).withColumn(
        "hash", seeded_hash(FLOW_KEYS, 42))


@query("t8_head", f"with {FLOWS} select {KEYS}, total_bytes from flows order by {KEYS} limit 10")
def t8(spark, sf_dir):
    return sampling.head(flows(spark, sf_dir).select(*FLOW_KEYS, "total_bytes"), FLOW_KEYS, 10)


@query("t9_background_sample", f"""with {FLOWS} select {KEYS}, flow_duration, total_bytes from flows
  where label = 'BENIGN' order by {md5_of()}, {KEYS} limit 100""")
def t9(spark, sf_dir):
    df = schema.filter_benign(flows(spark, sf_dir)).select(*FLOW_KEYS, "flow_duration", "total_bytes")
    return sampling.sample_n(df, FLOW_KEYS, 100)


@query("t10_top_n", f"""with {SIGNAL} select {KEYS}, total_bytes from signal order by total_bytes desc, {KEYS} limit 20""")
def t10(spark, sf_dir):
    return sampling.top_n(flows_signal(spark, sf_dir).select(*FLOW_KEYS, "total_bytes"), "total_bytes", 20, FLOW_KEYS)


@query("t10_bottom_n", f"""with {SIGNAL} select {KEYS}, total_bytes from signal order by total_bytes, {KEYS} limit 20""")
def t10_bottom(spark, sf_dir):
    return sampling.bottom_n(flows_signal(spark, sf_dir).select(*FLOW_KEYS, "total_bytes"), "total_bytes", 20,
                             FLOW_KEYS)


@query("t11_best_row", f"""with {FLOWS}, by_day as (select day, sum(flow_duration) as duration from flows group by day)
  (select 'max' as kind, day, duration from by_day order by duration desc, day limit 1)
  union all (select 'min' as kind, day, duration from by_day order by duration, day limit 1)""")
def t11(spark, sf_dir):
    by_day = flows(spark, sf_dir).groupBy("day").agg(F.sum("flow_duration").alias("duration"))
    best = sampling.best_row(by_day, "duration", "day").select(F.lit("max").alias("kind"), "day", "duration")
    return best.unionByName(sampling.best_row(by_day, "duration", "day", largest=False).select(
        F.lit("min").alias("kind"), "day", "duration"))


@query("snake_case_aliases", "select l_quantity as flow_duration, l_extendedprice as flow_bytes_per_sec from lineitem")
def aliases(spark, sf_dir):
    li = views.table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_quantity").alias(snake_name(" Flow Duration")),
                     F.col("l_extendedprice").alias(snake_name("Flow Bytes/s")))
