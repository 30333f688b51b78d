"""Queries on labels, filters, cleaning and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions import labels as L
from flowlens.operators import cleaning as C
from flowlens.sources.testdata import FLOWS_SQL, events, flows, indexed_flows, table

from .registry import register

W = f"WITH {FLOWS_SQL} "
#: Benign as SQL sees it on the flows' labels.
_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

#: Label forms a loader must survive, as a table for the label functions.
_FORMS = ["BENIGN", "benign", " 2017|BENIGN ", "2026|BENIGN|dns", "2026|BENIGN|", "2019|DrDoS_DNS", "1999|BENIGN", "", "Portscan", "2017|DoS Hulk"]
_FORMS_SQL = "forms(label) AS (VALUES " + ", ".join(f"('{x}')" for x in _FORMS) + ")"


def _forms(spark):
    return spark.createDataFrame([(x,) for x in _FORMS], "label string")


register(
    "lb_label_algebra",
    lambda s, d: table(s, d, "region").limit(1).crossJoin(_forms(s)).select(
        "label", L.label_year(F.col("label")).alias("year"), L.base_label(F.col("label")).alias("base"), L.normal_label(F.col("label")).alias("normal"),
        *[f(F.col("label")).cast("int").alias(n) for n, f in (("benign", L.is_benign), ("benign_a", L.is_benign_second_token), ("benign_b",
            L.is_benign_exact), ("benign_c", L.is_benign_lower), ("benign_d", L.is_benign_suffix))],
    ),
    f"""WITH {_FORMS_SQL}, s AS (SELECT label, trim(label) AS t, regexp_matches(trim(label), '^20[0-9][0-9]\\|') AS y FROM forms),
    r AS (SELECT *, CASE WHEN y THEN left(t, 4) END AS year, upper(trim(CASE WHEN y THEN t[6:] ELSE t END)) AS rest FROM s),
    u AS (SELECT *, CASE WHEN starts_with(rest, 'BENIGN|') THEN CASE WHEN trim(rest[8:]) = '' THEN 'BENIGN' ELSE concat('BENIGN|', trim(rest[8:])) END
        ELSE rest END AS txt,
      CASE WHEN rest = 'BENIGN' OR starts_with(rest, 'BENIGN|') THEN 'BENIGN' ELSE rest END AS base FROM r)
    SELECT label, year, base, CASE WHEN year IS NULL THEN txt ELSE concat(year, '|', txt) END AS normal, CAST(base = 'BENIGN' AS INT) AS benign,
      CAST(upper(trim(split_part(label, '|', 2))) = 'BENIGN' AS INT) AS benign_a, CAST(upper(t) = 'BENIGN' AS INT) AS benign_b,
      CAST(lower(label) = 'benign' AS INT) AS benign_c, CAST(suffix(label, '|BENIGN') AS INT) AS benign_d FROM u""",
)


def _count(df, *by):
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


register("pf1_year_tagging", lambda s, d: _count(table(s, d, "events").select(L.with_year_tag(F.col("event_type"),
    F.year("ts").cast("string")).alias("label")), "label"),
         "SELECT concat(year(ts), '|', event_type) AS label, count(*) AS n FROM events GROUP BY 1")
register("pf2_timestamp_parse", lambda s, d: table(s, d, "orders").select(
    F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "dd/MM/yyyy HH:mm:ss")).when(F.col("o_orderkey") % 3 == 1,
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).otherwise("no time").alias("t"))
    .select(F.coalesce(F.try_to_timestamp("t", F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp("t", F.lit("dd/MM/yyyy "
        "HH:mm:ss"))).alias("ts")).where("ts is not null")
    .groupBy(F.year("ts").cast("long").alias("y"), F.month("ts").cast("long").alias("m")).agg(F.count(F.lit(1)).alias("n")),
    "SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n FROM orders WHERE o_orderkey % 3 < 2 GROUP BY 1, 2")
register("pf3_year_include", lambda s, d: _count(C.keep_years(flows(s, d), ["2017", "2026"]), "label"),
         W + "SELECT label, count(*) AS n FROM base WHERE year_tag IN ('2017', '2026') GROUP BY label")
register("pf4_year_benign_exclude", lambda s, d: _count(C.drop_benign_of_years(flows(s, d), ["2019"]), "label"),
         W + "SELECT label, count(*) AS n FROM base WHERE NOT (year_tag = '2019' AND benign = 1) GROUP BY label")
register("pf5_attack_include", lambda s, d: _count(C.keep_attacks(flows(s, d), ["portscan"]), "label"),
         W + "SELECT label, count(*) AS n FROM base WHERE base_label IN ('PORTSCAN', 'BENIGN') GROUP BY label")
register("pf6_attack_exclude", lambda s, d: _count(C.drop_attacks(flows(s, d), ["DoS Hulk", "2017|Portscan"]), "label"),
         W + "SELECT label, count(*) AS n FROM base WHERE NOT (base_label = 'DOS HULK' OR (base_label = 'PORTSCAN' AND year_tag = '2017')) GROUP BY label")
register("pf7_protocol_include", lambda s, d: _count(C.keep_protocols(flows(s, d), ["udp", "other", "bogus"]), "protocol"),
         W + "SELECT protocol, count(*) AS n FROM base WHERE protocol = 17 OR protocol NOT IN (6, 17) GROUP BY protocol")
register("pf8_missing_values", lambda s, d: C.repair_missing(
    flows(s, d).select("protocol", F.when(F.col("bwd") == 0, -1.0).otherwise(F.col("bwd")).alias("win"), F.when(F.col("fwd") == 50,
        float("inf")).when(F.col("fwd") == 1, float("nan")).otherwise(F.col("fwd")).alias("rate")),
    ["win"], ["rate"], "protocol").agg(F.sum("win").alias("win"), F.sum("rate").alias("rate"),
        *[F.sum(F.col(c).cast("long")).alias(c) for c in ("win_missing_flag", "rate_missing_flag", "is_non_tcp")]),
    W + """SELECT sum(bwd) AS win, sum(CASE WHEN fwd IN (1, 50) THEN 0 ELSE fwd END) AS rate, CAST(sum((bwd = 0)::INT) AS BIGINT) AS win_missing_flag,
      CAST(sum((fwd IN (1, 50))::INT) AS BIGINT) AS rate_missing_flag, CAST(sum((protocol <> 6)::INT) AS BIGINT) AS is_non_tcp FROM base""")
register("pf9_all_zero_rules", lambda s, d: _count(C.drop_all_zero(flows(s, d), [C.ZeroRule(("bwd", "l_discount"), 0.02), C.ZeroRule(("bwd",
    "l_tax")), C.ZeroRule(("nowhere",))]), "learner"),
         W + "SELECT learner, count(*) AS n FROM base WHERE NOT (abs(bwd) <= 0.02 AND abs(l_discount) <= 0.02) AND NOT (bwd = 0 AND l_tax = 0) GROUP "
             "BY learner")
register("pf10_row_cap", lambda s, d: indexed_flows(s, d).where("row_index < 1000").agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("k"),
    F.max("ts").alias("last")),
         W + "SELECT count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS k, max(ts) AS last FROM base WHERE row_index < 1000")
register("pf13_numeric_coercion", lambda s, d: table(s, d, "customer").select(F.split_part("c_name", F.lit("#"), F.lit(2)).alias("t"),
    F.col("c_mktsegment").alias("u"))
         .agg(F.sum(F.col("t").try_cast("double")).alias("total"), F.count(F.col("u").try_cast("double")).alias("numeric_u"), F.count(F.lit(1)).alias("n")),
         "SELECT sum(try_cast(split_part(c_name, '#', 2) AS DOUBLE)) AS total, count(try_cast(c_mktsegment AS DOUBLE)) AS numeric_u, count(*) AS n "
             "FROM customer")
register("pf14_nonzero_count", lambda s, d: flows(s, d).groupBy(C.nonzero_count(["bwd", "l_discount",
    "l_tax"]).cast("long").alias("nonzero")).agg(F.count(F.lit(1)).alias("n")),
         W + "SELECT CAST((bwd <> 0)::INT + (l_discount <> 0)::INT + (l_tax <> 0)::INT AS BIGINT) AS nonzero, count(*) AS n FROM base GROUP BY 1")
register("pf15_quantile_clip", lambda s, d: C.quantile_band(table(s, d, "orders"), "o_totalprice", 0.01, 0.99).agg(F.count(F.lit(1)).alias("n"),
    F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high")),
         "SELECT count(*) AS n, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders WHERE o_totalprice BETWEEN (SELECT "
             "quantile_cont(o_totalprice, 0.01) FROM orders) AND (SELECT quantile_cont(o_totalprice, 0.99) FROM orders)")
register("pf16_iqr_outliers", lambda s, d: C.iqr_outlier(table(s, d, "events"),
    "value").groupBy("event_type").agg(F.sum(F.col("outlier").cast("long")).alias("outliers"), F.count(F.lit(1)).alias("n")),
         """WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
         SELECT event_type, CAST(sum((value < a - 1.5*(b-a) OR value > b + 1.5*(b-a))::INT) AS BIGINT) AS outliers, count(*) AS n FROM events, q
             GROUP BY event_type""")
register("pf17_median_fill", lambda s, d: C.fill_median(events(s, d).select("label", F.when(F.col("row_index") % 7 == 0,
    None).otherwise(F.col("value")).alias("value")), ["value"]).groupBy("label").agg(F.round(F.sum("value"), 4).alias("total")),
         """WITH v AS (SELECT event_type AS label, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events),
             m AS (SELECT quantile_cont(value, 0.5) AS med FROM v)
         SELECT label, round(sum(coalesce(value, med)), 4) AS total FROM v, m GROUP BY label""")
register("pf18_near_constant", lambda s, d: flows(s, d).select(*_NUM,
    F.lit(3.0).alias("fixed")).select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("x")) for c in [*_NUM, "fixed"]])).alias("p"))
         .groupBy("p.feature").agg(F.stddev_pop("p.x").alias("sd")).where("sd >= 1e-10").select("feature"),
         "SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS feature")
register("pf21_label_mapping", lambda s, d: _count(flows(s, d).select(F.when(F.startswith("label", F.lit("2026")), F.concat(F.lit("2026|BENIGN|"),
    F.lower("l_linestatus"))).when(L.is_benign(F.col("label")), F.col("label")).otherwise(F.replace("label", F.lit(" "),
        F.lit("_"))).alias("mapped")), "mapped"),
         W + "SELECT CASE WHEN year_tag = '2026' THEN concat('2026|BENIGN|', lower(l_linestatus)) WHEN benign = 1 THEN label ELSE replace(label, ' ', "
             "'_') END AS mapped, count(*) AS n FROM base GROUP BY 1")
register("pf22_tag_filter", lambda s, d: _count(table(s, d, "part").where(C.has_all_tags(["ECONOMY", "brand"], ["p_type", "p_brand"])), "p_brand"),
         "SELECT p_brand, count(*) AS n FROM part WHERE contains(lower(concat_ws(' ', p_type, p_brand)), 'economy') AND contains(lower(concat_ws(' ', "
             "p_type, p_brand)), 'brand') GROUP BY p_brand")
register("pf27_display_name", lambda s, d: flows(s,
    d).groupBy("learner").agg(F.avg((F.col("dst_port") == 80).cast("double")).alias("p")).select("learner", F.format_string("%s_http(%.1f%%)",
        "learner", F.round(F.col("p") * 100, 6)).alias("name")),
         W + "SELECT learner, printf('%s_http(%.1f%%)', learner, round(avg((dst_port = 80)::INT) * 100, 6)) AS name FROM base GROUP BY learner")
register("wn1_row_index", lambda s, d: indexed_flows(s, d).agg(F.count(F.lit(1)).alias("n"),
    F.sum((F.col("row_index") % 97) * F.col("l_orderkey")).cast("long").alias("mix"), F.max("row_index").cast("long").alias("last")),
         W + "SELECT count(*) AS n, CAST(sum((row_index % 97) * l_orderkey) AS BIGINT) AS mix, max(row_index) AS last FROM base")
register("wn4_first_per_label", lambda s, d: _count(C.first_per_group(indexed_flows(s, d), ["label"], ["row_index"], 500), "label", "learner"),
         W + "SELECT label, learner, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY row_index) AS r FROM base) WHERE r "
             "<= 500 GROUP BY 1, 2")
register("wn5_seeded_sample", lambda s, d: C.sample_per_group(indexed_flows(s, d), ["label"], "row_index", 100,
    7).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("row_index").cast("long").alias("rows")),
         W + "SELECT label, count(*) AS n, CAST(sum(row_index) AS BIGINT) AS rows FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY "
             "md5(concat('7|', row_index)), row_index) AS r FROM base) WHERE r <= 100 GROUP BY 1")
register("wn6_stratified", lambda s, d: C.stratified(events(s, d), "label", "row_index", 0.1, 1500,
    3).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("row_index").alias("rows")),
         """WITH r AS (SELECT event_type AS label, event_id, row_number() OVER (PARTITION BY event_type ORDER BY md5(concat('3|', event_id)),
             event_id) AS r, least(count(*) OVER (PARTITION BY event_type), 1500) AS n FROM events)
         SELECT label, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS rows FROM r WHERE n > 1 AND r <= greatest(1, floor(n * 0.1)) GROUP BY label""")
register("wn7_oversample", lambda s, d: _count(C.oversample(flows(s, d), L.is_benign(F.col("label")), 3), "label"),
         W + "SELECT label, count(*) * CASE WHEN max(benign) = 1 THEN 3 ELSE 1 END AS n FROM base GROUP BY label")
register("wn24_folds", lambda s, d: _count(C.folds(events(s, d), "label", "row_index", 5, 1).withColumn("fold", F.col("fold").cast("long")), "label", "fold"),
         "SELECT event_type AS label, (row_number() OVER (PARTITION BY event_type ORDER BY md5(concat('1|', event_id)), event_id) - 1) % 5 AS fold, 0 "
             "AS z FROM events".join(["SELECT label, fold, count(*) AS n FROM (", ") GROUP BY 1, 2"]))
