"""Queries on decision trees, attributions, fusion, comparisons of one-class models, and communities by modularity."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions.labels import is_benign, label_year
from flowlens.operators import communities as G
from flowlens.operators import comparisons as C
from flowlens.operators import trees as T
from flowlens.sources.testdata import FLOWS_SQL, events, flows, indexed_flows, table

from .aggregate_queries import rounded
from .registry import register

W = f"WITH {FLOWS_SQL} "


def _n():
    """Rows, as an aggregate; made when it is used, as columns need a session."""
    return F.count(F.lit(1))


def _kinds(s, d):
    """Flows with the way they behave as a label."""
    g = F.col("l_suppkey") % 6
    kind = F.when(g >= 4, "BENIGN").when(g == 1, "SCAN").when(g == 2, "ONEWAY").otherwise("SERVICE")
    return indexed_flows(s, d).select(
        "row_index", kind.alias("kind"), F.when(F.col("l_linenumber") != 3, F.col("bwd") / F.col("l_quantity")).alias("ratio"), "src_port",
            "dst_port", F.when(F.col("l_linenumber") != 5, F.col("l_linestatus")).alias("status"), "protocol"
    )


# assembly and trees


def _assembled(s, d):
    made, names = T.assemble(_kinds(s, d), ["ratio", "dst_port"], ["status"])
    return rounded(made.select(F.posexplode("x").alias("place",
        "v")).groupBy("place").agg(F.sum("v").alias("total")).select(F.element_at(F.array(*map(F.lit, names)), F.col("place") + 1).alias("feature"),
            "total"), 4)


register(
    "ml24_assembly",
    _assembled,
    W + """, k AS (SELECT CASE WHEN l_linenumber <> 3 THEN bwd / l_quantity END AS ratio, dst_port, CASE
        WHEN l_linenumber <> 5 THEN l_linestatus END AS status FROM base), m AS (SELECT quantile_cont(ratio, 0.5) AS r FROM k),
  u AS (SELECT status AS u FROM k WHERE status IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), f AS (SELECT coalesce(ratio, r) AS ratio,
      dst_port, coalesce(status, u) AS status FROM k, m, u)
  SELECT 'ratio' AS feature, round(sum(ratio), 4) AS total FROM f UNION ALL SELECT 'dst_port', sum(dst_port)::DOUBLE FROM f
      UNION ALL SELECT 'status_F', sum((status = 'F')::INT)::DOUBLE FROM f UNION ALL SELECT 'status_O', sum((status = 'O')::INT)::DOUBLE FROM f""",
)


def _tree_report(s, d):
    """A tree's report as rows: figures, classes, importances, confusion and rule lines."""
    r = T.tree_report(_kinds(s, d), "kind", "row_index", ["ratio", "src_port", "dst_port"], ["status"], depth=4, least=20)
    rows = [("figure", k, float(v)) for k, v in r.items() if isinstance(v, (int, float))]
    rows += [("class", k, float(v)) for k, v in r["classes"].items()] + [("importance", k, v) for k, v in r["importances"]]
    rows += [("confusion", f"{a} as {b}", float(n)) for a, b, n in r["confusion"]] + [("rule", line, float(k)) for k,
        line in enumerate(r["rules"].splitlines())]
    return rounded(s.createDataFrame(rows, "what string, name string, value double"))


register("ml23_tree_report", _tree_report)
register("ml25_forest_explanations", lambda s, d: T.forest_explanations(_kinds(s, d).withColumn("learner", F.concat("kind", F.lit("_"),
    F.col("protocol").cast("string"))), "learner", "row_index", ["ratio", "src_port", "dst_port"], least=1000, trees=5, depth=4,
        top=2).select("learner", "positives", "negatives", "reason", F.round("auc", 6).alias("auc"), F.col("features")[0]["feature"].alias("first")))
register("ml27_attributions", lambda s, d: rounded(T.class_attributions(_kinds(s, d), "kind", ["ratio", "src_port", "dst_port"], top=3, trees=5, depth=3)))


def _fusion(s, d):
    """Days' profiles told apart by whether errors are frequent; the thresholds of the cross-validated scores."""
    rows = events(s, d).groupBy((F.col("user_id") % 300).alias("id")).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.max("value").alias("top"), F.avg((F.col("label") == "error").cast("double")).alias("share"))
    scored, weights = T.fusion_scores(rows.withColumn("attack", (F.col("share") > 0.2).cast("int")), "attack", "id", ["mean", "std", "top"], folds_=3)
    out = T.threshold_table(scored.withColumn("score", F.round("score", 9)), "score", "y", [0.05, 0.2]).select("note", "target", "threshold", "tp",
        "fp", "fn", "tn")
    return rounded(out.withColumn("strongest", F.lit(max(weights, key=lambda k: (abs(weights[k]), k)))))


register("ml26_fusion", _fusion)
_ROC = """WITH e AS (SELECT round(value, 1) AS t, (event_type = 'error')::INT AS y FROM events), c AS (SELECT t, sum(y) AS a, sum(1 - y) AS b FROM e
    GROUP BY 1), tot AS (SELECT sum(a) AS p, sum(b) AS q FROM c),
  k AS (SELECT t, sum(a) OVER (ORDER BY t DESC) AS tp, sum(b) OVER (ORDER BY t DESC) AS fp, p, q FROM c, tot)"""
register(
    "ml26_threshold_table",
    lambda s, d: rounded(T.threshold_table(events(s, d).select(F.round("value", 1).alias("score"),
        (F.col("label") == "error").cast("int").alias("y")), "score", "y", [0.01, 0.02, 0.05, 0.1, 0.2])),
    _ROC + """, g AS (SELECT unnest([0.01, 0.02, 0.05, 0.1, 0.2])::DOUBLE AS target), n AS (SELECT '' AS note, target, k.*,
        row_number() OVER (PARTITION BY target ORDER BY round(abs(fp / q - target), 12), t DESC) AS r FROM g, k
  UNION ALL SELECT 'best_youden', NULL, k.*, row_number() OVER (ORDER BY round(fp / q - tp / p, 12), t DESC) FROM k)
  SELECT note, target, round(t, 6) AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(p - tp AS BIGINT) AS fn,
      CAST(q - fp AS BIGINT) AS tn, round(tp / p, 6) AS tpr, round(fp / q, 6) AS fpr, round(1 - tp / p, 6) AS fnr, round(tp / (tp + fp),
          6) AS "precision" FROM n WHERE r = 1""",
)

# one-class models


def _alarms(s, d):
    return events(s, d).select("value", (F.col("label") == "error").cast("int").alias("y"))


register(
    "ml28_fixed_fpr",
    lambda s, d: rounded(C.fixed_fpr_rates(_alarms(s, d), "value", "y", [0.001, 0.01, 0.05]), 5),
    """WITH e AS (SELECT value AS s, (event_type = 'error')::INT AS y FROM events), q AS (SELECT unnest([0.001, 0.01, 0.05])::DOUBLE AS target,
        unnest([quantile_cont(s, 0.999), quantile_cont(s, 0.99), quantile_cont(s, 0.95)]) AS t FROM e WHERE y = 0),
  c AS (SELECT target, t, sum((y = 1 AND s >= t)::INT) AS tp, sum((y = 0 AND s >= t)::INT) AS fp, sum((y = 0 AND s < t)::INT) AS tn, sum((y = 1
      AND s < t)::INT) AS fn FROM e, q GROUP BY 1, 2)
  SELECT target, round(t, 5) AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(tn AS BIGINT) AS tn, CAST(fn AS BIGINT) AS fn,
      round(fp / greatest(1, fp + tn), 5) AS fpr, round(tp / greatest(1, tp + fn), 5) AS tpr, round(fn / greatest(1, tp + fn), 5) AS fnr,
          round(tp / greatest(1, tp + fp), 5) AS "precision" FROM c""",
)
register(
    "ml28_best_f1",
    lambda s, d: rounded(C.best_f1(_alarms(s, d).withColumn("value", F.round("value", 1)), "value", "y")),
    _ROC + " SELECT round(t, 6) AS threshold, round(2 * tp / (tp + fp + p), 6) AS f1 FROM k ORDER BY round(2 * tp / (tp + fp + p), 12) DESC, t DESC LIMIT 1",
)


def _cross_year(s, d):
    """Benign flows of 2017 train; all of 2019 tests, with port scans of one source as the attack."""
    year = label_year(F.col("label"))
    rows = indexed_flows(s, d).select("row_index", "label", (F.col("bwd") / F.col("l_quantity")).alias("ratio"),
        F.log1p(F.col("dst_port").cast("double")).alias("port"), F.log1p(F.col("src_port").cast("double")).alias("source"), (F.col("l_suppkey") % 6).alias("g"))
    attack = F.col("g").isin(1, 2)
    scored = C.one_class_rows(rows, (year == "2017") & (F.col("g") >= 4), (year == "2019") & (is_benign(F.col("label")) | attack), attack,
        "row_index", ["ratio", "port", "source"], ["iforest", "ae", "ocsvm"], most_rows=2000)
    return rounded(C.cross_tests(scored), 5)


register("ml29_cross_year", _cross_year)


def _residuals(s, d):
    """Squared distances of each vector to its label's mean, axis by axis, as three scores."""
    v = table(s, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("axis", "x"))
    c = v.groupBy("label", "axis").agg(F.avg(F.col("x").cast("double")).alias("m"))
    e = v.join(c, ["label", "axis"]).groupBy("vec_id",
        "label").agg(F.collect_list((F.col("x").cast("double") - F.col("m")) ** 2).alias("e"))  # a row for each axis
    return rounded(e.groupBy("label").agg(*[F.avg(x).alias(k) for k, x in C.residual_scores(F.col("e")).items()]), 5)


register(
    "ml30_residual_scores",
    _residuals,
    """WITH v AS (SELECT vec_id, label, unnest(range(64)) AS axis, unnest(embedding)::DOUBLE AS x FROM embeddings), c AS (SELECT label, axis,
        avg(x) AS m FROM v GROUP BY 1, 2), e AS (SELECT vec_id, v.label, (x - m) ** 2 AS e FROM v JOIN c ON v.label = c.label AND v.axis = c.axis),
  r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY e DESC) AS r FROM e), s AS (SELECT vec_id, label, avg(e) AS a,
      avg(e) FILTER (r <= 6) AS b, quantile_cont(e, 0.9) AS c FROM r GROUP BY 1, 2)
  SELECT label::BIGINT AS label, round(avg(a), 5) AS mean_mse, round(avg(b), 5) AS topk_mse, round(avg(c), 5) AS p90_error FROM s GROUP BY 1""",
)

# communities


def _communities(s, d):
    """Hosts that talk to each other more than chance would have it, weighted by flows."""
    edge = flows(s, d).groupBy(F.col("src_ip").alias("a"), F.col("dst_ip").alias("b")).agg(_n().cast("double").alias("weight"))
    found = G.modularity_communities(edge)
    return found.groupBy("community").agg(_n().alias("hosts"))


register("gr21_modularity", _communities)
