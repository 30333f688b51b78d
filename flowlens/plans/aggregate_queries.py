"""Queries on profiles, distributions, correlations and evaluation of flows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from flowlens.functions.labels import base_label, is_benign, label_year
from flowlens.operators import aggregates as A
from flowlens.operators import evaluation as V
from flowlens.operators.quantiles import exact_quantiles
from flowlens.sources.testdata import FLOWS_SQL, LOSSES_SQL, events, flows, indexed_flows, losses, table

from .registry import register

W = f"WITH {FLOWS_SQL} "
#: Times over 256 bins of the whole table's span, and ports, of each learner.
TEMPORAL_SQL = """, tg AS (SELECT epoch_us(min(ts)) AS w0, epoch_us(max(ts)) AS w1 FROM base), tc AS (SELECT learner, least(255,
    floor((epoch_us(ts) - w0) * 256 / (w1 - w0))) AS bin, count(*) AS c FROM base, tg GROUP BY 1, 2),
  te AS (SELECT learner, count(*) AS n, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS span_s FROM base GROUP BY 1), tm AS (SELECT learner,
      c / n AS mass FROM tc JOIN te USING (learner)),
  th AS (SELECT learner, sum(mass * mass) AS hhi, CASE WHEN count(*) <= 1 THEN 0 ELSE -sum(mass * ln(mass + 1e-15)) / ln(count(*)) END AS entropy
      FROM tm GROUP BY 1),
  temporal AS (SELECT learner, n, span_s, span_s / ((w1 - w0) / 1e6) AS span_ratio, hhi, entropy, 1 - entropy AS concentration,
      0.5 * (1 - least(span_s / ((w1 - w0) / 1e6), 1)) + 0.5 * hhi AS burst FROM te JOIN th USING (learner), tg)"""
PORT_SQL = """, dc AS (SELECT learner, dst_port AS port, count(*) AS c FROM base GROUP BY 1, 2), dm AS (SELECT *,
    c / sum(c) OVER (PARTITION BY learner) AS mass FROM dc),
  ds AS (SELECT learner, CAST(sum(c) AS BIGINT) AS n, count(*) AS ports, CASE WHEN count(*) > 1 THEN -sum(mass * ln(mass + 1e-15)) / ln(count(*))
      ELSE 0 END AS entropy, sum(mass * mass) AS hhi, CAST(first(port ORDER BY c DESC, port) AS BIGINT) AS top_port, max(mass) AS top_share FROM dm GROUP BY 1),
  sc AS (SELECT learner, src_port AS port, count(*) AS c FROM base GROUP BY 1, 2), sm AS (SELECT *, c / sum(c) OVER (PARTITION BY learner) AS mass
      FROM sc), ss AS (SELECT learner, CASE WHEN count(*) > 1 THEN -sum(mass * ln(mass + 1e-15)) / ln(count(*)) ELSE 0 END AS source_entropy,
          count(*) AS source_ports FROM sm GROUP BY 1),
  ports AS (SELECT * FROM ds JOIN ss USING (learner))"""
PROFILE_SQL = """, pc AS (SELECT learner, label, max(benign) AS b, count(*) AS c FROM base GROUP BY 1, 2), profile AS (SELECT learner,
    sum(c) AS total, sum(c * b) AS benign, sum(c * (1 - b)) AS attack, sum(c * (1 - b)) / sum(c) AS attack_ratio, first(label ORDER BY c DESC,
        label) AS dominant_label FROM pc GROUP BY 1)"""


def _n():
    """Rows, as an aggregate; made when it is used, as columns need a session."""
    return F.count(F.lit(1))


def rounded(df, places=6, keep=()):
    """Doubles rounded, integers as long, for comparison by value."""
    out = []
    for c, kind in df.dtypes:
        out.append(F.round(F.col(c), places).alias(c) if kind == "double" and c not in keep else F.col(c).cast("long").alias(c) if kind == "int" else F.col(c))
    return df.select(*out)


def benign_flows(s, d, source=flows):
    return source(s, d).withColumn("benign", is_benign(F.col("label")).cast("int"))


register("ag1_label_distribution", lambda s, d: rounded(A.label_distribution(flows(s, d))), W + "SELECT label, count(*) AS n, round(count(*) / "
    "(SELECT count(*) FROM base), 6) AS ratio FROM base GROUP BY label")
register("ag2_dataset_labels", lambda s, d: rounded(A.label_distribution(flows(s, d)).select("label", "n", "ratio",
    is_benign(F.col("label")).alias("is_benign"), F.coalesce(label_year(F.col("label")), F.lit("None")).alias("year_tag"),
        base_label(F.col("label")).alias("base_label"))),
         W + "SELECT label, count(*) AS n, round(count(*) / (SELECT count(*) FROM base), 6) AS ratio, max(benign) = 1 AS is_benign, max(year_tag) AS "
             "year_tag, max(base_label) AS base_label FROM base GROUP BY label")
register("ag3_feature_profile_by_label", lambda s, d: rounded(A.feature_profile(flows(s, d), ["label"], ["l_quantity", "l_tax"]), 4),
         W + "SELECT label, " + ", ".join(f"round(avg({c}), 4) AS {c}__mean, round(coalesce(stddev_samp({c}), 0), 4) AS {c}__std, round(CASE WHEN "
             f"avg({c}) = 0 THEN 0 ELSE abs(coalesce(stddev_samp({c}), 0) / avg({c})) END, 4) AS {c}__cv" for c in ("l_quantity", "l_tax")) + " FROM "
                 "base GROUP BY label")
register("ag4_feature_profile_by_learner", lambda s, d: rounded(A.feature_profile(flows(s, d), ["learner"], ["l_extendedprice"]), 3),
         W + "SELECT learner, round(avg(l_extendedprice), 3) AS l_extendedprice__mean, round(stddev_samp(l_extendedprice), 3) AS "
             "l_extendedprice__std, round(abs(stddev_samp(l_extendedprice) / avg(l_extendedprice)), 3) AS l_extendedprice__cv FROM base GROUP BY learner")
register("ag5_protocol_mix", lambda s, d: rounded(A.protocol_mix(flows(s, d), "learner")), W + """, m AS (SELECT learner, count(*) AS n,
    avg((protocol = 6)::INT) AS tcp, avg((protocol = 17)::INT) AS udp FROM base GROUP BY learner)
    SELECT learner, n, round(tcp, 6) AS tcp, round(udp, 6) AS udp, round(round(1 - tcp - udp, 12), 6) AS other, round(greatest(tcp, udp), 6) AS concentration,
      CASE WHEN tcp >= 0.8 THEN 'TCP_CLUSTER' WHEN udp >= 0.8 THEN 'UDP_CLUSTER' WHEN round(1 - tcp - udp, 12) >= 0.6 THEN 'OTHER_CLUSTER'
          ELSE 'MIXED_CLUSTER' END AS kind FROM m""")
register("ag6_temporal_stats", lambda s, d: rounded(A.temporal_stats(flows(s, d), "learner")), W + TEMPORAL_SQL + """ SELECT learner, n, round(span_s,
    6) AS span_s, round(span_ratio, 6) AS span_ratio, round(hhi, 6) AS hhi, round(entropy, 6) AS entropy, round(concentration, 6) AS concentration,
        round(burst, 6) AS burst,
    CASE WHEN span_ratio < 1e-3 AND hhi >= 0.5 THEN 'SHORT_BURST' WHEN span_ratio >= 0.01 THEN 'LONG_SPAN' ELSE 'MEDIUM_SPAN' END AS kind FROM temporal""")
register("ag7_port_stats", lambda s, d: rounded(A.port_stats(flows(s, d), "learner")), W + PORT_SQL + """ SELECT learner, n, ports, round(entropy,
    6) AS entropy, round(1 - entropy, 6) AS concentration, round(hhi, 6) AS hhi, top_port, round(top_share, 6) AS top_share, round(source_entropy,
        6) AS source_entropy, source_ports,
    CASE WHEN ports <= 0 THEN 'UNKNOWN' WHEN top_share < 0.15 AND ports >= 200 THEN 'PORT_SCAN_LIKE' WHEN top_share > 0.9
        AND ports <= 3 THEN 'SINGLE_PORT' ELSE 'SERVICE_LIKE' END AS kind FROM ports""")
register("ag8_learner_profile", lambda s, d: rounded(A.group_profile(flows(s, d), "learner")), W + """, c AS (SELECT learner, label, max(benign) AS b,
    count(*) AS n FROM base GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY learner ORDER BY n DESC, label) AS r FROM c)
    SELECT learner, CAST(sum(n) AS BIGINT) AS total, CAST(sum(n*b) AS BIGINT) AS benign, CAST(sum(n) - sum(n*b) AS BIGINT) AS attack,
        round((sum(n) - sum(n*b)) / sum(n), 6) AS attack_ratio, max(CASE WHEN r = 1 THEN label END) AS dominant_label, max(n) AS dominant_n,
      round(max(n) / sum(n), 6) AS dominant_ratio, concat('{', string_agg(concat('"', label, '":', n), ',' ORDER BY r), '}') AS labels_json FROM r
          GROUP BY learner""")
register("ag9_train_batches", lambda s, d: rounded(A.group_profile(indexed_flows(s, d).withColumn("batch", F.concat("learner", F.lit("@"),
    F.floor(F.col("row_index") / 2000).cast("string"))), "batch").select("batch", "total", "attack_ratio", "dominant_label")),
         W + """, c AS (SELECT concat(learner, '@', CAST(floor(row_index / 2000) AS BIGINT)) AS batch, label, max(benign) AS b, count(*) AS n
             FROM base GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY n DESC, label) AS r FROM c)
    SELECT batch, CAST(sum(n) AS BIGINT) AS total, round((sum(n) - sum(n*b)) / sum(n), 6) AS attack_ratio, max(CASE
        WHEN r = 1 THEN label END) AS dominant_label FROM r GROUP BY batch""")
register("ag11_correlations", lambda s, d: rounded(A.correlations(benign_flows(s, d), ["l_quantity", "l_discount", "bwd", "l_linenumber"], "benign"),
    5), W + """, u AS (SELECT benign AS y, unnest(['l_quantity', 'l_discount', 'bwd', 'l_linenumber']) AS feature, unnest([l_quantity, l_discount,
        bwd, l_linenumber]) AS x FROM base),
    r AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2 AS rx,
        rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2 AS ry FROM u)
    SELECT feature, round(corr(x, y), 5) AS pearson, round(corr(rx, ry), 5) AS spearman FROM r GROUP BY feature""")
register("ag12_assignment_risk", lambda s, d: rounded(V.assignment_risk(flows(s, d))), W + PROFILE_SQL + """,
    r AS (SELECT sum(benign) AS actual_benign, sum(attack) AS actual_attack, sum(CASE WHEN learner = 'UNKNOWN' THEN benign
        ELSE 0 END) AS unknown_benign, sum(CASE WHEN learner = 'UNKNOWN' THEN attack ELSE 0 END) AS unknown_attack,
      sum(CASE WHEN learner <> 'UNKNOWN' AND dominant_label LIKE '%BENIGN' THEN attack ELSE 0 END) AS lost, sum(CASE WHEN learner <> 'UNKNOWN'
          AND dominant_label NOT LIKE '%BENIGN' THEN benign ELSE 0 END) AS fp FROM profile)
    SELECT CAST(fp AS BIGINT) AS fp, CAST(actual_benign - unknown_benign AS BIGINT) AS benign, CAST(lost + unknown_attack AS BIGINT) AS miss,
        CAST(actual_attack AS BIGINT) AS attack, round(fp / (actual_benign - unknown_benign), 6) AS fpr,
            round((lost + unknown_attack) / actual_attack, 6) AS fnr FROM r""")
register("ag13_binary_rates", lambda s, d: rounded(A.binary_rates(benign_flows(s, d), F.col("benign") == 0, F.col("bwd") < 20, ["learner"])), W + """,
    c AS (SELECT learner, CAST(sum((benign = 0 AND bwd < 20)::INT) AS BIGINT) AS tp, CAST(sum((benign = 1 AND bwd < 20)::INT) AS BIGINT) AS fp,
        CAST(sum((benign = 1 AND bwd >= 20)::INT) AS BIGINT) AS tn, CAST(sum((benign = 0 AND bwd >= 20)::INT) AS BIGINT) AS fn FROM base GROUP BY learner)
    SELECT *, round(fp/(fp+tn), 6) AS fpr, round(fn/(fn+tp), 6) AS fnr, round(tp/(fn+tp), 6) AS tpr, round(tn/(fp+tn), 6) AS tnr,
        round((tp+tn)/(tp+fp+tn+fn), 6) AS accuracy FROM c""")
register("ag19_gini", lambda s, d: rounded(A.gini(flows(s, d), "learner", "l_quantity")), W + """, r AS (SELECT learner, l_quantity AS v,
    row_number() OVER (PARTITION BY learner ORDER BY l_quantity) AS i, count(*) OVER (PARTITION BY learner) AS n FROM base)
    SELECT learner, round(2 * sum(i*v) / (max(n) * sum(v)) - (max(n) + 1) / max(n), 6) AS gini FROM r GROUP BY learner""")
register("ag20_column_stats", lambda s, d: rounded(A.column_stats(flows(s, d).select("l_quantity", "bwd", F.when(F.col("l_linenumber") == 3,
    None).otherwise(F.col("l_tax")).alias("tax")), ["l_quantity", "bwd", "tax"]), 5), W + """, u AS (SELECT unnest(['l_quantity', 'bwd',
        'tax']) AS feature, unnest([l_quantity, bwd, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_tax END]) AS x FROM base)
    SELECT feature, count(x) AS n, round(avg(x), 5) AS mean, round(stddev_pop(x), 5) AS std, round(min(x), 5) AS low, round(max(x), 5) AS high,
        round(avg((x = 0)::INT), 5) AS zero_ratio, CAST(sum((x IS NULL)::INT) AS BIGINT) AS missing FROM u GROUP BY feature""")
register("ag22_histogram", lambda s, d: rounded(table(s, d,
    "lineitem").groupBy("l_orderkey").agg(_n().alias("lines")).groupBy("lines").agg(_n().alias("orders"))), "SELECT lines, count(*) AS orders FROM "
        "(SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY 1) GROUP BY 1")
register("ag23_exact_quantiles", lambda s, d: rounded(exact_quantiles(events(s, d), ["label"], "value", [0.05, 0.5, 0.95]).select("label",
    *[F.col("q")[k].alias(f"q{p}") for k, p in enumerate((5, 50, 95))])),
         "SELECT event_type AS label, round(quantile_cont(value, 0.05), 6) AS q5, round(quantile_cont(value, 0.5), 6) AS q50, "
             "round(quantile_cont(value, 0.95), 6) AS q95 FROM events GROUP BY 1")
register("ag24_grouping_sets", lambda s, d: rounded(flows(s, d).select(base_label(F.col("label")).alias("base"),
    label_year(F.col("label")).alias("year"), "bwd").groupingSets([["base"], ["year"], ["base", "year"]], "base", "year").agg(_n().alias("n"),
        F.avg("bwd").alias("mean"))),
         W + "SELECT base_label AS base, year_tag AS year, count(*) AS n, round(avg(bwd), 6) AS mean FROM base GROUP BY GROUPING SETS ((base_label), "
             "(year_tag), (base_label, year_tag))")
register("ag25_crosstab", lambda s, d: flows(s, d).groupBy("learner").pivot("l_returnflag", ["A", "N", "R"]).agg(_n()).na.fill(0), W + "SELECT "
    "learner, count(*) FILTER (l_returnflag = 'A') AS A, count(*) FILTER (l_returnflag = 'N') AS N, count(*) FILTER (l_returnflag = 'R') AS R FROM "
        "base GROUP BY learner")
register("ag26_attack_ratio_by_day", lambda s, d: rounded(events(s, d).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(_n().alias("n"),
    F.sum((F.col("label") == "error").cast("long")).alias("attacks"), F.avg((F.col("label") == "error").cast("double")).alias("ratio"))),
         "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, CAST(sum((event_type = 'error')::INT) AS BIGINT) AS attacks, round(avg((event_type = "
             "'error')::INT), 6) AS ratio FROM events GROUP BY 1")
register("ag27_hourly_traffic", lambda s, d: events(s, d).groupBy(F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH").alias("hour"),
    "label").agg(_n().alias("n")), "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type AS label, count(*) AS n FROM events "
        "GROUP BY 1, 2")
register("ag28_feature_drift", lambda s, d: rounded(flows(s,
    d).groupBy(label_year(F.col("label")).alias("year")).agg(F.avg("l_quantity").alias("m")).join(F.broadcast(flows(s,
        d).agg(F.avg("l_quantity").alias("g"), F.stddev_samp("l_quantity").alias("sd"))), how="cross").select("year", F.when(F.col("sd") == 0,
            0.0).otherwise((F.col("m") - F.col("g")) / F.col("sd")).alias("z"))),
         W + "SELECT year_tag AS year, round((avg(l_quantity) - (SELECT avg(l_quantity) FROM base)) / (SELECT stddev_samp(l_quantity) FROM base), 6) "
             "AS z FROM base GROUP BY 1")
register("ag29_top_variance", lambda s, d: rounded(A.column_stats(flows(s, d), ["l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "bwd"]).orderBy(F.col("std").desc(), "feature").limit(2).select("feature", "std"), 3),
         W + "SELECT feature, round(std, 3) AS std FROM (SELECT feature, stddev_pop(x) AS std FROM (SELECT unnest(['l_quantity', 'l_extendedprice', "
             "'l_discount', 'l_tax', 'bwd']) AS feature, unnest([l_quantity, l_extendedprice, l_discount, l_tax, bwd]) AS x FROM base) GROUP BY 1) "
                 "ORDER BY 2 DESC LIMIT 2")
register("ag30_correlation_matrix", lambda s, d: rounded(flows(s, d).agg(*[F.corr(a, b).alias(f"{a}__{b}") for a, b in (("l_quantity",
    "l_extendedprice"), ("l_quantity", "bwd"), ("l_discount", "bwd"))]), 5),
         W + "SELECT round(corr(l_quantity, l_extendedprice), 5) AS l_quantity__l_extendedprice, round(corr(l_quantity, bwd), 5) AS l_quantity__bwd, "
             "round(corr(l_discount, bwd), 5) AS l_discount__bwd FROM base")
def _six_stats(rows):
    q = exact_quantiles(rows, ["learner"], "l_extendedprice", [0.1, 0.25, 0.5, 0.75, 0.9]).select("learner", *[F.col("q")[k].alias(c) for k,
        c in enumerate(("p10", "_a", "median", "_b", "p90"))])
    means = rows.groupBy("learner").agg(F.avg("l_extendedprice").alias("mean"), F.stddev_pop("l_extendedprice").alias("std"))
    return means.join(q, "learner").withColumn("iqr", F.col("_b") - F.col("_a")).drop("_a", "_b")


register("ag31_six_stats", lambda s, d: rounded(_six_stats(flows(s, d)), 3),
         W + "SELECT learner, round(avg(l_extendedprice), 3) AS mean, round(stddev_pop(l_extendedprice), 3) AS std, "
             "round(quantile_cont(l_extendedprice, 0.1), 3) AS p10, round(quantile_cont(l_extendedprice, 0.5), 3) AS median, "
                 "round(quantile_cont(l_extendedprice, 0.9), 3) AS p90, round(quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, "
                     "0.25), 3) AS iqr FROM base GROUP BY learner")
register("ag33_weighted_mean", lambda s, d: rounded(flows(s,
    d).groupBy(base_label(F.col("label")).alias("base")).agg((F.sum(F.col("l_tax") * F.col("l_quantity")) / F.sum("l_quantity")).alias("tax"),
        F.expr("mode() within group (order by l_linenumber)").alias("usual_line"))),
         W + ", m AS (SELECT base_label, l_linenumber, count(*) AS n FROM base GROUP BY 1, 2), k AS (SELECT base_label, l_linenumber, row_number() "
             "OVER (PARTITION BY base_label ORDER BY n DESC, l_linenumber) AS r FROM m) SELECT b.base_label AS base, round(sum(l_tax * l_quantity) / "
                 "sum(l_quantity), 6) AS tax, CAST(max(k.l_linenumber) AS BIGINT) AS usual_line FROM base b JOIN k ON k.base_label = b.base_label AND "
                     "k.r = 1 GROUP BY 1")


def stability_sql(rows: str, size: int) -> str:
    """CTE stable(learner, stability) over rows(learner, row_index)."""
    return f""", vn AS (SELECT learner, CAST(floor(row_index / {size}) AS BIGINT) AS w, count(*) AS n FROM {rows} WHERE row_index >= 0 GROUP BY 1, 2),
        vw AS (SELECT unnest(range((SELECT max(w) + 1 FROM vn))) AS w),
  vv AS (SELECT l.learner, vw.w, coalesce(vn.n, 0) AS n FROM (SELECT DISTINCT learner FROM vn) l CROSS JOIN vw LEFT JOIN vn ON vn.learner = l.learner
      AND vn.w = vw.w),
  vs AS (SELECT learner, avg(n) AS m, stddev_pop(n) AS sd, quantile_cont(n, 0.95) AS p FROM vv GROUP BY 1),
  stable AS (SELECT learner, least(1, greatest(0, 0.6 * (1 - exp(-greatest(sd / (m + 1e-9), 0))) + 0.4 * (1 - exp(-greatest(p / (m + 1e-9) - 1,
      0))))) AS stability FROM vs)"""


register("ag34_stability", lambda s, d: rounded(A.stability(indexed_flows(s, d), "learner", "row_index", 5000)), W + stability_sql("base", 5000) + " "
    "SELECT learner, round(stability, 6) AS stability FROM stable")
register("ag40_drift_score", lambda s, d: rounded(_drift(s, d)), W + """, h AS (SELECT learner, row_index < 3000 AS old, unnest(['l_quantity',
    'l_tax']) AS f, unnest([l_quantity, l_tax]) AS x FROM base), m AS (SELECT learner, f, avg(x) FILTER (old) AS m0, stddev_pop(x) FILTER (old) AS s0,
        avg(x) FILTER (NOT old) AS m1, stddev_pop(x) FILTER (NOT old) AS s1 FROM h GROUP BY 1, 2)
    SELECT learner, round(0.7*avg(abs(m1-m0)/(s0+1e-6)) + 0.3*avg(abs(s1-s0)/(s0+1e-6)), 6) AS drift FROM m GROUP BY learner""")


def _drift(s, d):
    rows = indexed_flows(s, d).select("learner", (F.col("row_index") < 3000).alias("old"), F.explode(F.array(*[F.struct(F.lit(c).alias("f"),
        F.col(c).alias("x")) for c in ("l_quantity", "l_tax")])).alias("p"))
    of = lambda f, old: f(F.when(F.col("old") == old, F.col("p.x")))
    m = rows.groupBy("learner", "p.f").agg(of(F.avg, True).alias("m0"), of(F.stddev_pop, True).alias("s0"), of(F.avg, False).alias("m1"),
        of(F.stddev_pop, False).alias("s1"))
    far = lambda a, b: F.avg(F.abs(F.col(b) - F.col(a)) / (F.col("s0") + 1e-6))
    return m.groupBy("learner").agg((0.7 * far("m0", "m1") + 0.3 * far("s0", "s1")).alias("drift"))


register("ag41_class_report", lambda s, d: rounded(V.class_report(benign_flows(s, d).select(base_label(F.col("label")).alias("t"),
    F.when(F.col("bwd") > 25, "BENIGN").when(F.col("bwd") > 5, "PORTSCAN").otherwise("DOS HULK").alias("g")), "t", "g")), W + """,
        c AS (SELECT base_label AS t, CASE WHEN bwd > 25 THEN 'BENIGN' WHEN bwd > 5 THEN 'PORTSCAN' ELSE 'DOS HULK' END AS g FROM base),
    k AS (SELECT t AS class FROM c UNION SELECT g FROM c), s AS (SELECT class, (SELECT count(*) FROM c WHERE t = class) AS support, (SELECT count(*)
        FROM c WHERE g = class) AS guessed, (SELECT count(*) FROM c WHERE t = class AND g = class) AS hit FROM k)
    SELECT class, round(CASE WHEN guessed > 0 THEN hit/guessed ELSE 0 END, 6) AS "precision", round(CASE WHEN support > 0 THEN hit/support ELSE 0 END,
        6) AS recall, round(CASE WHEN hit > 0 THEN 2*hit/(guessed+support) ELSE 0 END, 6) AS f1, support FROM s""")
register("ag42_separability", lambda s, d: rounded(V.auc(benign_flows(s, d).select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"),
    F.col(c).alias("x"), (1 - F.col("benign")).alias("y")) for c in ("l_quantity", "bwd", "l_tax")])).alias("p")).select("p.*"), ["feature"], "x",
        "y")), W + """, u AS (SELECT 1 - benign AS y, unnest(['l_quantity', 'bwd', 'l_tax']) AS feature, unnest([l_quantity, bwd, l_tax]) AS x FROM base),
    r AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2 AS rk FROM u),
        a AS (SELECT feature, (sum(rk*y) - sum(y)*(sum(y)+1)/2) / (sum(y)*sum(1-y)) AS auc FROM r GROUP BY 1) SELECT feature, round(auc, 6) AS auc,
            round(greatest(auc, 1-auc), 6) AS oriented_auc FROM a""")
register("ag44_retrain_count", lambda s, d: indexed_flows(s, d).withColumn("stage", F.when(F.col("row_index") % 4 == 0,
    "increment").otherwise("init")).where("stage = 'increment'").groupBy("learner").agg(_n().alias("retrains")), W + "SELECT learner, count(*) AS "
        "retrains FROM base WHERE row_index % 4 = 0 GROUP BY learner")
register("ag46_totals_by_year", lambda s, d: flows(s, d).select(F.coalesce(label_year(F.col("label")), F.lit("unknown")).alias("year"),
    is_benign(F.col("label")).alias("b")).rollup("year").agg(F.sum(F.col("b").cast("long")).alias("benign"),
        F.sum((~F.col("b")).cast("long")).alias("attack")), W + "SELECT year_tag AS year, CAST(sum(benign) AS BIGINT) AS benign, CAST(sum(1 - benign) "
            "AS BIGINT) AS attack FROM base GROUP BY ROLLUP (year_tag)")
register("ag50_distinct_counts", lambda s, d: flows(s, d).groupBy("label").agg(*[F.count_distinct(c).alias(c) for c in ("src_ip", "dst_ip",
    "dst_port")]), W + "SELECT label, count(DISTINCT src_ip) AS src_ip, count(DISTINCT dst_ip) AS dst_ip, count(DISTINCT dst_port) AS dst_port FROM "
        "base GROUP BY label")
register("wn2_count_windows", lambda s, d: rounded(benign_flows(s, d,
    indexed_flows).groupBy(F.floor(F.col("row_index") / 5000).alias("window_id")).agg(_n().alias("n"), F.min("row_index").alias("left"),
        (F.max("row_index") + 1).alias("right"), F.sum(1 - F.col("benign")).alias("attacks"))),
         W + "SELECT CAST(floor(row_index / 5000) AS BIGINT) AS window_id, count(*) AS n, min(row_index) AS left, max(row_index) + 1 AS right, "
             "CAST(sum(1 - benign) AS BIGINT) AS attacks FROM base GROUP BY 1".replace("AS left", 'AS "left"').replace("AS right", 'AS "right"'))
register("wn8_previews", lambda s, d: rounded(indexed_flows(s, d).withColumn("r",
    F.row_number().over(Window.partitionBy("learner").orderBy("row_index"))).where("r <= 10").select("learner", "row_index", "src_ip", "dst_ip",
        "dst_port", "label")), W + "SELECT learner, row_index, src_ip, dst_ip, CAST(dst_port AS BIGINT) AS dst_port, label FROM (SELECT *, "
            "row_number() OVER (PARTITION BY learner ORDER BY row_index) AS r FROM base) WHERE r <= 10")
register("wn13_fifo_buffer", lambda s, d: indexed_flows(s, d).where("learner = 'UNKNOWN'").withColumn("r",
    F.row_number().over(Window.partitionBy("label").orderBy(F.col("row_index").desc()))).groupBy("label",
        (F.col("r") <= 50).alias("kept")).agg(_n().alias("n"), F.min("row_index").cast("long").alias("first")), W + "SELECT label, r <= 50 AS kept, "
            "count(*) AS n, min(row_index) AS first FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY row_index DESC) AS r FROM base "
                "WHERE learner = 'UNKNOWN') GROUP BY 1, 2")
register("wn15_quantile_bands", lambda s, d: table(s, d, "supplier").join(F.broadcast(table(s, d, "supplier").agg(F.expr("percentile(s_acctbal, "
    "array(0.5D, 0.8D))").alias("q"))), how="cross").select("s_suppkey", F.when(F.col("s_acctbal") >= F.col("q")[1],
        "HIGH").when(F.col("s_acctbal") >= F.col("q")[0], "MEDIUM").otherwise("LOW").alias("band")),
         "SELECT s_suppkey, CASE WHEN s_acctbal >= (SELECT quantile_cont(s_acctbal, 0.8) FROM supplier) THEN 'HIGH' WHEN s_acctbal >= (SELECT "
             "quantile_cont(s_acctbal, 0.5) FROM supplier) THEN 'MEDIUM' ELSE 'LOW' END AS band FROM supplier")
register("wn22_low_loss_keep", lambda s, d: losses(s, d).join(exact_quantiles(losses(s, d), ["learner"], "loss", [0.25]), "learner").where("loss <= "
    "q[0]").groupBy("learner").agg(_n().alias("n")), f"WITH {LOSSES_SQL}, q AS (SELECT learner, quantile_cont(loss, 0.25) AS q FROM losses GROUP BY "
        f"1) SELECT learner, count(*) AS n FROM losses JOIN q USING (learner) WHERE loss <= q GROUP BY 1")
register("ml31_roc_curve", lambda s, d: rounded(V.curve(events(s, d).select(F.round("value", 1).alias("score"),
    (F.col("label") == "error").cast("int").alias("y")), "score", "y")), """WITH e AS (SELECT round(value, 1) AS threshold,
        (event_type = 'error')::INT AS y FROM events), c AS (SELECT threshold, sum(y) AS p, sum(1-y) AS q FROM e GROUP BY 1), k AS (SELECT threshold,
            sum(p) OVER (ORDER BY threshold DESC) AS tp, sum(q) OVER (ORDER BY threshold DESC) AS fp FROM c)
    SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(tp / (SELECT sum(y) FROM e), 6) AS tpr, round(fp / (SELECT sum(1-y)
        FROM e), 6) AS fpr, round(tp/(tp+fp), 6) AS "precision" FROM k""")
register("ml26_fpr_thresholds", lambda s, d: rounded(V.threshold_for_fpr(V.curve(events(s, d).select("value",
    (F.col("label") == "error").cast("int").alias("y")), "value", "y"), [0.01, 0.05, 0.1])), """WITH e AS (SELECT value AS threshold,
        (event_type = 'error')::INT AS y FROM events), c AS (SELECT threshold, sum(y) AS p, sum(1-y) AS q FROM e GROUP BY 1), k AS (SELECT threshold,
            sum(p) OVER (ORDER BY threshold DESC) AS tp, sum(q) OVER (ORDER BY threshold DESC) AS fp FROM c),
    t AS (SELECT unnest([0.01, 0.05, 0.1])::DOUBLE AS target), j AS (SELECT target, threshold, tp,
        row_number() OVER (PARTITION BY target ORDER BY tp DESC, fp, threshold DESC) AS r FROM t JOIN k ON fp / (SELECT sum(1-y)
            FROM e) <= target) SELECT target, round(threshold, 6) AS threshold, CAST(tp AS BIGINT) AS tp FROM j WHERE r = 1""")
