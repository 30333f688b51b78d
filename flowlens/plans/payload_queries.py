"""Queries behind a run's tables and payloads: feature profiles, joins of assignments, learner topology, audits, traces, sinks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from flowlens.functions.labels import base_label, is_benign
from flowlens.operators import aggregates as A
from flowlens.operators import evaluation as V
from flowlens.operators import features as P
from flowlens.operators import overlap as O
from flowlens.operators import qualification as Q
from flowlens.operators import topology as T
from flowlens.session import keep
from flowlens.sources import sinks as K
from flowlens.sources.testdata import FLOWS_SQL, LOSSES_SQL, events, flows, indexed_flows, losses, table

from .aggregate_queries import PROFILE_SQL, benign_flows, rounded
from .graph_queries import _JAC, _QUAL, WR, endpoint_graph_sql
from .lifecycle_queries import _windows as loss_windows
from .model_queries import work_folder
from .registry import register

W, X = f"WITH {FLOWS_SQL} ", f"WITH {LOSSES_SQL} "


def _n():
    """Rows, as an aggregate; made when it is used, as columns need a session."""
    return F.count(F.lit(1))


def _totals(df):
    """feature, total of each numeric column."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"),
        F.col(f"`{c}`").cast("double").alias("x")) for c in df.columns])).alias("p")).groupBy("p.feature").agg(F.sum("p.x").alias("total"))


def _totals_sql(columns: str) -> str:
    names = columns.split()
    return f"SELECT feature, round(sum(x), 4) AS total FROM (SELECT unnest({names}) AS feature, unnest([{', '.join(f'{c}::DOUBLE' for c in names)}]) AS x FROM base) GROUP BY 1"


# feature profiles

_ENV = ["l_orderkey", "l_partkey", "l_suppkey", "src_port", "dst_port", "protocol"]
_SETS = {"stable_stats_no_env": ["l_tax", "l_quantity", "nowhere"], "compact_stats_no_env": ["nowhere"]}


def _profile(name, env=None):
    return lambda s, d: rounded(_totals(P.project(f := flows(s, d), P.profile_columns(f, name, env or _ENV, _SETS))), 4)


def _catalog(profile):
    """Each metric column of a profile: its kind, and its least and greatest value over the groups."""
    found = [(name, kind) for name, kind, _ in P.metric_catalog(profile) if kind != "text"]
    long = profile.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(k).alias("kind"), F.col(n).alias("x")) for n,
        k in found])).alias("p")).select("p.*")
    return long.groupBy("name", "kind").agg(F.min("x").alias("low"), F.max("x").alias("high"))


def _catalog_sql() -> str:
    found = [("attack_ratio", "ratio", "1 - avg(benign)")]
    for c in ("l_tax", "bwd"):
        std = f"coalesce(stddev_samp({c}), 0)"
        found += [(f"{c}__mean", "mean", f"avg({c})"), (f"{c}__std", "std", std), (f"{c}__cv", "cv", f"CASE WHEN avg({c}) = 0 THEN 0 ELSE abs({std} / "
            f"avg({c})) END")]
    each = " UNION ALL ".join(f"SELECT '{n}' AS name, '{k}' AS kind, {x} AS x FROM base GROUP BY learner" for n, k, x in found)
    return f"SELECT name, kind, round(min(x), 4) AS low, round(max(x), 4) AS high FROM ({each}) GROUP BY 1, 2"


register("pf11_all_numeric", _profile("all_numeric_no_env"), W + _totals_sql("l_linenumber l_quantity l_extendedprice l_discount l_tax fwd bwd"))
register("pf11_curated", _profile("stable_stats_no_env"), W + _totals_sql("l_tax l_quantity"))
register("pf11_empty_set_falls_back", _profile("compact_stats_no_env"), W + _totals_sql("l_linenumber l_quantity l_extendedprice l_discount l_tax fwd bwd"))
register("pf12_ports_kept", _profile("all_numeric_no_env", ["l_orderkey", "l_partkey", "l_suppkey", "protocol", "l_extendedprice"]), W +
    _totals_sql("l_linenumber l_quantity l_discount l_tax src_port dst_port fwd bwd"))
def _allowed_totals(s, d):
    """Totals of the numeric columns that may be learned from; three more columns have names that may not."""
    rows = indexed_flows(s, d).withColumns({"Index_x": F.col("row_index"), "attack_ratio": F.col("l_tax"), "unphased": F.col("bwd")})
    kept = rows.select(*P.allowed(rows.columns))
    return _totals(kept.select(*P.numeric_columns(kept, [])))


register(
    "pf19_excluded_names",
    lambda s, d: rounded(_allowed_totals(s, d), 4),
    W + _totals_sql("l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax protocol src_port dst_port fwd bwd"),
)
register("pf20_reindex", lambda s, d: rounded(_totals(P.reindex(flows(s, d).select("bwd", F.when(F.col("l_linenumber") > 3,
    F.col("l_tax")).alias("l_tax"), "fwd"), ["l_tax", "nowhere", "bwd"])), 4),
         W + "SELECT 'l_tax' AS feature, round(sum(CASE WHEN l_linenumber > 3 THEN l_tax ELSE 0 END), 4) AS total FROM base UNION ALL SELECT "
             "'nowhere', 0.0 UNION ALL SELECT 'bwd', round(sum(bwd), 4) FROM base")
register("pf23_run_search", lambda s, d: table(s, d, "customer").select(F.concat(F.lit("run_"), F.lower("c_mktsegment"), F.lit("_"),
    F.col("c_custkey").cast("string")).alias("run")).where(F.contains("run", F.lit("build"))).groupBy().agg(_n().alias("n"), F.min("run").alias("first")),
         "SELECT count(*) AS n, min(run) AS \"first\" FROM (SELECT concat('run_', lower(c_mktsegment), '_', c_custkey) AS run FROM customer) WHERE "
             "contains(run, 'build')")
register("pf28_metric_catalog", lambda s, d: rounded(_catalog(A.feature_profile(flows(s, d), ["learner"], ["l_tax",
    "bwd"]).join(A.group_profile(flows(s, d), "learner").select("learner", "attack_ratio"), "learner")), 4), W + _catalog_sql())
register("tk8_top_groups", lambda s, d: rounded(P.top_groups(flows(s, d), base_label(F.col("label")), {"outlier": F.col("bwd") > 45,
    "zero": F.col("bwd") == 0}, "outlier", 2)),
         W + "SELECT base_label AS \"group\", count(*) AS rows, CAST(sum((bwd > 45)::INT) AS BIGINT) AS outlier_rows, CAST(sum((bwd = 0)::INT) AS "
             "BIGINT) AS zero_rows, round(avg((bwd > 45)::INT), 6) AS outlier_ratio, round(avg((bwd = 0)::INT), 6) AS zero_ratio FROM base GROUP BY 1 "
                 "ORDER BY outlier_ratio DESC, rows DESC, 1 LIMIT 2")

# joins on the row number


def _assigned(s, d):
    return indexed_flows(s, d).where("row_index % 3 > 0").select("row_index", "learner")


register("jn1_assigned_flows", lambda s, d: rounded(indexed_flows(s, d).select("row_index", "label", "bwd").join(_assigned(s, d),
    "row_index").groupBy("learner", "label").agg(_n().alias("n"), F.avg("bwd").alias("mean")), 4), W + "SELECT learner, label, count(*) AS n, "
        "round(avg(bwd), 4) AS mean FROM base WHERE row_index % 3 > 0 GROUP BY 1, 2")
register("jn2_flow_columns", lambda s, d: _assigned(s, d).join(indexed_flows(s, d).where("bwd > 10").select("row_index", "dst_port"), "row_index",
    "left").groupBy("learner").agg(_n().alias("n"), F.count("dst_port").alias("with_port")), W + "SELECT learner, count(*) AS n, count(CASE WHEN bwd "
        "> 10 THEN 1 END) AS with_port FROM base WHERE row_index % 3 > 0 GROUP BY 1")
register("jn4_new_columns", lambda s, d: rounded(_extra(s, d)), W + PROFILE_SQL + ", r AS (SELECT learner, avg(l_tax) AS risk FROM base WHERE learner "
    "<> 'NEW_3' GROUP BY 1) SELECT learner, CAST(total AS BIGINT) AS total, round(attack_ratio, 6) AS attack_ratio, round(risk, 6) AS risk FROM "
        "profile LEFT JOIN r USING (learner)")


def _extra(s, d):
    """A profile with those columns of another table that it lacks."""
    profile = A.group_profile(flows(s, d), "learner").select("learner", "total", "attack_ratio")
    risks = flows(s, d).where("learner <> 'NEW_3'").groupBy("learner").agg(_n().alias("total"), F.avg("l_tax").alias("risk"))
    new = [c for c in risks.columns if c not in profile.columns]
    return profile.join(risks.select("learner", *new), "learner", "left")


register("jn16_index_lookup", lambda s, d: _assigned(s, d).join(F.broadcast(s.range(0, 300, 7).select(F.col("id").alias("row_index"))),
    "row_index").groupBy("learner").agg(_n().alias("n")), W + "SELECT learner, count(*) AS n FROM base WHERE row_index % 3 > 0 AND row_index IN "
        "(SELECT unnest(range(0, 300, 7))) GROUP BY 1")  # 43 rows are broadcast
register("jn18_stats_chain", lambda s, d: rounded(A.port_stats(flows(s, d), "learner").select("learner", "ports").join(A.temporal_stats(flows(s,
    d).where("learner <> 'UNKNOWN'"), "learner").select("learner", "n"), "learner").join(A.protocol_mix(flows(s, d), "learner").select("learner",
        "tcp"), "learner")),
         W + "SELECT learner, count(DISTINCT dst_port) AS ports, count(*) AS n, round(avg((protocol = 6)::INT), 6) AS tcp FROM base WHERE learner <> "
             "'UNKNOWN' GROUP BY 1")
register("jn20_size_fallback", lambda s, d: rounded(_sizes(s, d)), "WITH own AS (SELECT s_nationkey AS learner, count(*) AS n FROM supplier WHERE "
    "s_nationkey % 3 > 0 GROUP BY 1), g AS (SELECT n_regionkey AS region, count(*) AS members FROM nation GROUP BY 1), t AS (SELECT n_regionkey AS "
        "region, count(*) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) SELECT n_nationkey::BIGINT AS learner, "
            "round(coalesce(own.n, total / members), 6) AS size FROM nation LEFT JOIN own ON own.learner = n_nationkey LEFT JOIN g ON g.region = "
                "n_regionkey LEFT JOIN t ON t.region = n_regionkey")


def _sizes(s, d):
    """A learner's own size, else its group's total over the group's members, which come as a JSON list."""
    nation = table(s, d, "nation")
    own = table(s, d, "supplier").where("s_nationkey % 3 > 0").groupBy(F.col("s_nationkey").alias("learner")).agg(_n().alias("n"))
    members = nation.groupBy(F.col("n_regionkey").alias("region")).agg(F.to_json(F.collect_list("n_nationkey")).alias("members_json"))
    total = table(s, d, "customer").join(nation,
        F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("region")).agg(_n().alias("total"))
    each = members.join(total, "region", "left").select(F.from_json("members_json", "array<int>").alias("m"), "total")
    share = each.select(F.explode("m").alias("learner"), (F.col("total") / F.size("m")).alias("share"))
    return share.join(own, "learner", "left").select("learner", F.coalesce(F.col("n").cast("double"), "share").alias("size"))


register("wn3_two_window_ids", lambda s, d: rounded(indexed_flows(s, d).where("row_index >= "
    "700").select(F.floor((F.col("row_index") - 700) / 500).alias("stream_window"),
        F.floor(F.col("row_index") / 500).alias("stability_window")).groupBy("stream_window", "stability_window").agg(_n().alias("n"))),
         W + "SELECT CAST(floor((row_index - 700) / 500) AS BIGINT) AS stream_window, CAST(floor(row_index / 500) AS BIGINT) AS stability_window, "
             "count(*) AS n FROM base WHERE row_index >= 700 GROUP BY 1, 2")
register("tk4_profile_order", lambda s, d: rounded(A.group_profile(flows(s, d), "learner").select("learner", "total",
    "attack_ratio").withColumn("place", F.row_number().over(Window.orderBy(F.col("attack_ratio").desc(), F.col("total").desc(), "learner")))),
        # a row for each learner
         W + PROFILE_SQL + " SELECT learner, CAST(total AS BIGINT) AS total, round(attack_ratio, 6) AS attack_ratio, row_number() OVER (ORDER BY "
             "attack_ratio DESC, total DESC, learner) AS place FROM profile")
register("ag42_class_means", lambda s, d: rounded(V.separability(benign_flows(s, d).withColumn("attack", 1 - F.col("benign")), ["l_quantity", "bwd",
    "l_tax"], "attack"), 5), W + """, u AS (SELECT 1 - benign AS y, unnest(['l_quantity', 'bwd', 'l_tax']) AS feature, unnest([l_quantity, bwd,
        l_tax]) AS x FROM base), r AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature,
            x) - 1) / 2 AS rk FROM u),
    a AS (SELECT feature, (sum(rk*y) - sum(y)*(sum(y)+1)/2) / (sum(y)*sum(1-y)) AS auc, avg(x) FILTER (y = 1) AS mean_positive,
        avg(x) FILTER (y = 0) AS mean_negative, quantile_cont(x, 0.5) FILTER (y = 1) AS median_positive, quantile_cont(x,
            0.5) FILTER (y = 0) AS median_negative FROM r GROUP BY 1)
    SELECT feature, round(auc, 5) AS auc, round(greatest(auc, 1 - auc), 5) AS oriented_auc, round(mean_positive, 5) AS mean_positive,
        round(mean_negative, 5) AS mean_negative, round(median_positive, 5) AS median_positive, round(median_negative, 5) AS median_negative FROM a""")

# traces and figures of runs


def _epochs(s, d):
    """The values of a user's events as the losses of a fit; those of purchases as its validation."""
    of = lambda t: F.transform(F.array_sort(F.filter(F.collect_list(F.struct("row_index", "label", F.when(F.col("value") < 2,
        float("nan")).otherwise(F.col("value")).alias("v"))), t)), lambda x: x["v"])
    e = events(s, d).withColumn("learner", F.col("user_id") % 20)
    return e.groupBy("learner").agg(of(lambda x: x["label"] != "purchase").alias("epoch_losses"),
        of(lambda x: x["label"] == "purchase").alias("epoch_val_losses"))


_EP = """WITH e AS (SELECT user_id % 20 AS learner, event_id, CASE WHEN event_type = 'purchase' THEN 'v' ELSE 't' END AS side, value, value >= 2 AS ok
    FROM events),
  g AS (SELECT learner, side, count(*) AS n, first(value ORDER BY event_id) FILTER (ok) AS a, last(value ORDER BY event_id) FILTER (ok) AS b,
      min(value) FILTER (ok) AS lo, max(value) FILTER (ok) AS hi FROM e GROUP BY 1, 2)
  SELECT l.learner, coalesce(t.n, 0) AS epoch_count, round(t.a, 6) AS epoch_loss_first, round(t.b, 6) AS epoch_loss_last, round(t.lo,
      6) AS epoch_loss_min, round(t.hi, 6) AS epoch_loss_max, coalesce(v.n, 0) AS epoch_val_count, round(v.a, 6) AS epoch_val_loss_first, round(v.b,
          6) AS epoch_val_loss_last, round(v.lo, 6) AS epoch_val_loss_min, round(v.hi, 6) AS epoch_val_loss_max, round(v.b - t.b, 6) AS overfit_gap_last
  FROM (SELECT DISTINCT learner FROM e) l LEFT JOIN g t ON t.learner = l.learner AND t.side = 't' LEFT JOIN g v ON v.learner = l.learner AND v.side = 'v'"""
register("ag49_fit_trace", lambda s, d: rounded(V.fit_trace(_epochs(s, d)).drop("epoch_losses", "epoch_val_losses")), _EP)
register("ag49_increment_trace", lambda s, d: rounded(V.increment_trace_stats(losses(s, d).select("learner", F.col("loss").alias("before"),
    (F.col("loss") * 0.5 + 0.1).alias("after")), ["learner"]), 5),
         X + "SELECT learner, count(*) AS n, round(avg(loss), 5) AS before_loss_mean, round(quantile_cont(loss, 0.5), 5) AS before_loss_median, "
             "round(quantile_cont(loss, 0.95), 5) AS before_loss_p95, round(avg(loss * 0.5 + 0.1), 5) AS after_loss_mean, round(quantile_cont(loss * "
                 "0.5 + 0.1, 0.5), 5) AS after_loss_median, round(quantile_cont(loss * 0.5 + 0.1, 0.95), 5) AS after_loss_p95, round(avg(loss * 0.5 + "
                     "0.1) - avg(loss), 5) AS mean_change, round(quantile_cont(loss * 0.5 + 0.1, 0.95) - quantile_cont(loss, 0.95), 5) AS p95_change "
                         "FROM losses GROUP BY 1")
register("ag52_robustness", lambda s, d: rounded(V.robustness(table(s, d, "supplier").select((F.col("s_suppkey") % 7).alias("feature"), (0.5 +
    F.abs("s_acctbal") / 25000).alias("auc")), ["feature"]), 7),
         "WITH r AS (SELECT s_suppkey % 7 AS feature, 0.5 + abs(s_acctbal) / 25000 AS auc FROM supplier) SELECT feature, count(*) AS run_count, "
             "round(avg(auc), 7) AS auc_mean, round(quantile_cont(auc, 0.5), 7) AS auc_median, round(stddev_pop(auc), 7) AS auc_std, round(min(auc), "
                 "7) AS auc_min, round(max(auc), 7) AS auc_max, round(avg((auc >= 0.80)::INT), 7) AS share_80, round(avg((auc >= 0.90)::INT), 7) AS "
                     "share_90, round(avg((auc >= 0.95)::INT), 7) AS share_95 FROM r GROUP BY 1")
register("ag55_run_rows", lambda s, d: rounded(V.run_row(table(s, d, "customer").select(F.col("c_custkey").alias("run"),
    ((F.col("c_custkey") % 89) / 100).alias("fpr"), ((F.col("c_custkey") % 97) / 100).alias("fnr"), (F.col("c_custkey") % 5).alias("windows"),
        ((F.col("c_custkey") % 4) / 2).alias("seconds"), (F.col("c_custkey") * 10).alias("rows")))),
         "SELECT c_custkey AS run, round((c_custkey % 89) / 100, 6) AS fpr, round((c_custkey % 97) / 100, 6) AS fnr, round(1 - (c_custkey % 97) / "
             "100, 6) AS tpr, c_custkey % 5 AS windows, round(CASE WHEN c_custkey % 5 > 0 THEN (c_custkey % 4) / 2 / (c_custkey % 5) ELSE 0 END, 6) "
                 "AS avg_window_s, round(CASE WHEN c_custkey % 5 > 0 THEN c_custkey * 10 / (c_custkey % 5) ELSE 0 END, 6) AS avg_window_rows, "
                     "round(CASE WHEN c_custkey % 4 > 0 THEN c_custkey * 10 / ((c_custkey % 4) / 2) END, 6) AS flows_per_s FROM customer")

# learner graphs


def _jaccards(s, d):
    return O.jaccard(O.accepted(losses(s, d)))


register("tk3_overlap_edges", lambda s, d: rounded(O.overlap_edges(_jaccards(s, d), 0.3, 12, 9).select("learner_a", "learner_b", "jaccard")), X +
    _JAC + " SELECT learner_a, learner_b, round(jaccard, 6) AS jaccard FROM jx WHERE jaccard >= 0.3 ORDER BY jx.jaccard DESC, learner_a, learner_b LIMIT 9")
register("pf24_edge_threshold", lambda s, d: rounded(_scaled(s, d)), X + _JAC + ", k AS (SELECT * FROM jx WHERE jaccard >= 0.35) SELECT learner_a, "
    "learner_b, round((jaccard - (SELECT min(jaccard) FROM k)) / (SELECT max(jaccard) - min(jaccard) FROM k), 6) AS width FROM k")


def _scaled(s, d):
    """Edges at or above a threshold, with their place between the least and the greatest of them."""
    kept = _jaccards(s, d).where("jaccard >= 0.35")
    ends = kept.agg(F.min("jaccard").alias("a"), F.max("jaccard").alias("b"))
    return kept.join(F.broadcast(ends), how="cross").select("learner_a", "learner_b", F.when(F.col("b") > F.col("a"),
        (F.col("jaccard") - F.col("a")) / (F.col("b") - F.col("a"))).otherwise(0.0).alias("width"))


register("pf25_valid_rows", lambda s, d: indexed_flows(s, d).select("row_index", F.when(F.col("l_tax") > 0.02,
    F.col("learner")).alias("owner")).where((F.col("row_index") >= 100) & (F.col("row_index") < 4000) & F.col("owner").isNotNull()).groupBy("owner").agg(_n().alias("n")), W + "SELECT learner AS owner, count(*) AS n FROM base WHERE row_index >= 100 AND row_index < 4000 AND l_tax > 0.02 GROUP BY 1")
register("pf26_overlap_candidates", lambda s, d: O.overlap_candidates(_candidates(s, d), 0.2, 0.9, 0.01).select("learner_a", "learner_b"), W + """,
    c AS (SELECT learner, label, count(*) AS n FROM base WHERE learner <> 'UNKNOWN' GROUP BY ALL), g AS (SELECT learner, label, coalesce(n,
        0) / sum(coalesce(n, 0)) OVER (PARTITION BY learner) AS p FROM (SELECT DISTINCT learner FROM c) CROSS JOIN (SELECT DISTINCT label FROM c) LEFT
            JOIN c USING (learner, label)),
  q AS (SELECT a.learner AS learner_a, b.learner AS learner_b, sum(least(a.p, b.p)) AS shared, 1 - (0.5*sum(greatest(a.p, 1e-12)*ln(greatest(a.p,
      1e-12)/((greatest(a.p, 1e-12)+greatest(b.p, 1e-12))/2))) + 0.5*sum(greatest(b.p, 1e-12)*ln(greatest(b.p, 1e-12)/((greatest(a.p,
          1e-12)+greatest(b.p, 1e-12))/2)))) AS js FROM g a JOIN g b ON a.label = b.label AND a.learner < b.learner GROUP BY ALL),
  l AS (SELECT learner, lag(learner) OVER (ORDER BY row_index) AS prev FROM base), t AS (SELECT learner, count(*) AS n FROM base GROUP BY 1),
      h AS (SELECT least(prev, learner) AS learner_a, greatest(prev, learner) AS learner_b, count(*) AS n FROM l WHERE prev <> learner GROUP BY ALL)
  SELECT q.learner_a, q.learner_b FROM q LEFT JOIN h USING (learner_a, learner_b) JOIN t a ON a.learner = q.learner_a JOIN t b
      ON b.learner = q.learner_b WHERE q.shared >= 0.2 AND js >= 0.9 AND coalesce(h.n, 0) / least(a.n, b.n) >= 0.01""")


def _candidates(s, d):
    """Learners without UNKNOWN: shared label mass as the score, similarity of labels, rate of handoffs."""
    rows = indexed_flows(s, d).select("row_index", "learner", "label")
    alike = O.label_similarity(rows.where("learner <> 'UNKNOWN'").groupBy("learner", "label").agg(_n().alias("n")))
    return alike.withColumnRenamed("shared", "jaccard").join(O.handoffs(rows, block=1000), ["learner_a", "learner_b"], "left")


_MUTUAL = X.replace("WITH ", "WITH RECURSIVE ", 1) + _JAC + """, b2 AS (SELECT learner_a AS x, learner_b AS y, jaccard AS s FROM jx
    UNION ALL SELECT learner_b, learner_a, jaccard FROM jx), k2 AS (SELECT x, y FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY s DESC,
        y) AS r FROM b2) WHERE r <= 2), m2 AS (SELECT a.x, a.y FROM k2 a JOIN k2 b ON a.x = b.y AND a.y = b.x),
  rc(x, y) AS (SELECT DISTINCT learner, learner FROM losses UNION SELECT rc.x, m2.y FROM rc JOIN m2 ON rc.y = m2.x) SELECT x AS learner,
      min(y) AS owner FROM rc GROUP BY 1"""
register("gr20_mutual_components", lambda s, d: O.mutual_components(_jaccards(s, d), 2), _MUTUAL)
register("gr23_viewer_graph", lambda s, d: rounded(_viewer(s, d)), X + _JAC + ", d2 AS (SELECT learner_a AS learner, jaccard AS s FROM jx UNION ALL "
    "SELECT learner_b, jaccard FROM jx), g2 AS (SELECT learner, sum(s) AS weight FROM d2 GROUP BY 1), r2 AS (SELECT concat('NEW_', label) AS learner, "
        "avg((vec_id % 4 = 0)::INT) AS attack FROM embeddings GROUP BY 1) SELECT learner, round(weight, 6) AS weight, CASE WHEN attack < 0.3 THEN "
            "'benign' WHEN attack > 0.7 THEN 'attack' ELSE 'mixed' END AS polarity FROM g2 LEFT JOIN r2 USING (learner)")


def _viewer(s, d):
    """Nodes of the learner graph: the sum of their overlaps and the class of their attack ratio, cut at 0.3 and 0.7."""
    ends = _jaccards(s, d).select(F.explode(F.array("learner_a", "learner_b")).alias("learner"),
        "jaccard").groupBy("learner").agg(F.sum("jaccard").alias("weight"))
    ratio = table(s, d, "embeddings").groupBy(F.concat(F.lit("NEW_"),
        F.col("label").cast("string")).alias("learner")).agg(F.avg((F.col("vec_id") % 4 == 0).cast("double")).alias("attack"))
    return ends.join(ratio, "learner", "left").select("learner", "weight", F.when(F.col("attack") < 0.3, "benign").when(F.col("attack") > 0.7,
        "attack").otherwise("mixed").alias("polarity"))


def _internal(s, d):
    edge = keep(T.edges(flows(s, d), ["learner"], T.endpoint(F.col("src_ip"), F.col("src_port")), T.endpoint(F.col("dst_ip"), F.col("dst_port"))), "edges")
    return rounded(T.internal_topology(edge, "learner"), 5)


_GINI = "CASE WHEN sum({x}) = 0 THEN 0 ELSE 2 * sum(i * {x}) / (max(n) * sum({x})) - (max(n) + 1) / max(n) END"
register("gr18_internal_topology", _internal, WR + endpoint_graph_sql("learner") + """, od AS (SELECT k, src AS node, count(*) AS o, sum(n) AS so
    FROM e GROUP BY 1, 2), idg AS (SELECT k, dst AS node, count(*) AS i, sum(n) AS si FROM e GROUP BY 1, 2),
  ud AS (SELECT k, node, count(DISTINCT other) + max((other = node)::INT) AS deg FROM (SELECT k, src AS node, dst AS other FROM e UNION SELECT k, dst,
      src FROM e) GROUP BY 1, 2),
  h1 AS (SELECT k, sum(e.n) AS samples, max(e.n) AS top1, ln(sum(e.n)) - sum(e.n * ln(e.n)) / sum(e.n) AS edge_w_entropy FROM e GROUP BY 1),
      h2 AS (SELECT k, sum(n) AS top5 FROM (SELECT k, n, row_number() OVER (PARTITION BY k ORDER BY n DESC) AS r FROM e) WHERE r <= 5 GROUP BY 1),
  ho AS (SELECT k, count(*) AS us, max(so) AS mso, ln(sum(o)) - sum(o * ln(o)) / sum(o) AS out_deg_entropy FROM od GROUP BY 1), hi AS (SELECT k,
      count(*) AS ut, max(si) AS msi, ln(sum(i)) - sum(i * ln(i)) / sum(i) AS in_deg_entropy FROM idg GROUP BY 1),
  go AS (SELECT k, """ + _GINI.format(x="o") + """ AS out_deg_gini FROM (SELECT k, o, row_number() OVER (PARTITION BY k ORDER BY o) AS i,
      count(*) OVER (PARTITION BY k) AS n FROM od) GROUP BY 1), gi AS (SELECT k, """ + _GINI.format(x="d") + """ AS in_deg_gini FROM (SELECT k,
          i AS d, row_number() OVER (PARTITION BY k ORDER BY idg.i) AS i, count(*) OVER (PARTITION BY k) AS n FROM idg) GROUP BY 1),
  hl AS (SELECT k, avg((deg <= 1)::INT) AS leaf_ratio, avg((deg >= 10)::INT) AS high_deg_tail_ratio FROM ud GROUP BY 1), hw AS (SELECT a.k, sum(CASE
      WHEN b.n IS NOT NULL THEN least(a.n, b.n) ELSE 0 END) AS both FROM e a LEFT JOIN e b ON a.k = b.k AND a.src = b.dst AND a.dst = b.src GROUP BY 1)
  SELECT k AS learner, CAST(samples AS BIGINT) AS samples, nodes, edges, round(edges / (nodes * (nodes - 1)), 5) AS density,
      components AS components_weak, round(largest / nodes, 5) AS largest_component_ratio, round(opposite_other / edges, 5) AS reciprocity,
          max_out AS max_out_degree, max_in AS max_in_degree, round(max_out / greatest(1, nodes - 1), 5) AS hub_out_ratio, round(max_in / greatest(1,
              nodes - 1), 5) AS hub_in_ratio,
    CAST(mso AS BIGINT) AS max_out_strength, CAST(msi AS BIGINT) AS max_in_strength, round(mso / samples, 5) AS hub_out_strength_ratio,
        round(msi / samples, 5) AS hub_in_strength_ratio, round("both" / samples, 5) AS weighted_reciprocity, round(top1 / samples,
            5) AS top1_edge_share, round(top5 / samples, 5) AS top5_edge_share, round(out_deg_entropy, 5) AS out_deg_entropy, round(in_deg_entropy,
                5) AS in_deg_entropy, round(edge_w_entropy, 5) AS edge_w_entropy,
    round(out_deg_gini, 5) AS out_deg_gini, round(in_deg_gini, 5) AS in_deg_gini, round(samples / edges, 5) AS edge_reuse_ratio, round(edges / nodes,
        5) AS edge_per_node, round(us / nodes, 5) AS src_endpoint_ratio, round(ut / nodes, 5) AS dst_endpoint_ratio, round(abs(us - ut) / nodes,
            5) AS src_dst_asymmetry, round(leaf_ratio, 5) AS leaf_ratio, round(high_deg_tail_ratio, 5) AS high_deg_tail_ratio
  FROM gs JOIN h1 USING (k) JOIN h2 USING (k) JOIN ho USING (k) JOIN hi USING (k) JOIN go USING (k) JOIN gi USING (k) JOIN hl USING (k)
      JOIN hw USING (k)""".replace("AS both", 'AS "both"'))

# audits

_CATALOG_SQL = ", cat(metric, axis, lo, hi) AS (VALUES " + ", ".join(f"('{m}', '{a}', '{low}', '{high}')" for m, a, low, high in Q.CATALOG) + ")"
_LONG_SQL = ", ql AS (SELECT learner, unnest([" + ", ".join(f"'{m}'" for m in Q.METRICS) + "]) AS metric, unnest([" + ", ".join(f"{m}__score" for m in Q.METRICS) + "]) AS score FROM qw)"
register("qa2_semantic_tags", lambda s, d: Q.semantic_tags(Q.long_metrics(Q.metrics(flows(s, d)))).select("learner", "metric", "axis", "score", "tag"),
         _QUAL + _LONG_SQL + _CATALOG_SQL + " SELECT learner, ql.metric, axis, score, CASE WHEN score >= 80 THEN hi WHEN score >= 50 THEN CASE WHEN "
             "starts_with(hi, '偏') THEN hi ELSE concat('偏', hi) END WHEN score >= 20 THEN CASE WHEN starts_with(lo, '偏') THEN lo ELSE concat('偏', lo) "
                 "END ELSE lo END AS tag FROM ql JOIN cat USING (metric) WHERE score IS NOT NULL")
register("qa3_metric_catalog", lambda s, d: rounded(Q.long_metrics(Q.metrics(flows(s, d))).join(F.broadcast(Q.catalog(s)),
    "metric").groupBy("axis").agg(F.count_distinct("metric").alias("metrics"), F.min("score").alias("low"), F.max("score").alias("high"))),  # 22 rows
         _QUAL + _LONG_SQL + _CATALOG_SQL + " SELECT axis, count(DISTINCT ql.metric) AS metrics, round(min(score), 6) AS low, round(max(score), 6) AS "
             "high FROM ql JOIN cat USING (metric) WHERE score IS NOT NULL GROUP BY 1")


def _audit(s, d):
    """Flows assigned to learners; two profiles have no assigned flow, and small learners are skipped."""
    rows = keep(indexed_flows(s, d).select("row_index", "learner", "label", "src_ip", "dst_ip", "src_port", "dst_port", "ts", "fwd", "bwd"), "flows")
    assigned = rows.where("learner <> 'NEW_1' and (learner <> 'NEW_2' or row_index % 50 = 0)").select("row_index", "learner")
    profiles = A.group_profile(rows, "learner").select("learner", "total", "attack_ratio", "dominant_label", "dominant_ratio")
    return rounded(Q.audit(rows.drop("learner", "label"), assigned, profiles, 100, 4).select("learner", "place", "reason", "flow_count", "total",
        "attack_ratio", "dominant_label", F.col("dst_port_entropy__score").alias("score")))


register("qp1_audit_payload", _audit, W + PROFILE_SQL + """, fc AS (SELECT learner, count(*) AS c FROM base WHERE learner <> 'NEW_1'
    AND (learner <> 'NEW_2' OR row_index % 50 = 0) GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY c DESC, learner) AS place,
        sum((c >= 100)::INT) OVER (ORDER BY c DESC, learner) AS taken FROM fc), kept AS (SELECT * FROM o WHERE taken < 4 OR (taken = 4 AND c >= 100)),
  pe AS (SELECT learner, CASE WHEN count(*) <= 1 THEN 0 ELSE -sum(p * ln(p)) / ln(count(*)) END AS h FROM (SELECT learner,
      count(*) / sum(count(*)) OVER (PARTITION BY learner) AS p FROM base WHERE learner <> 'NEW_1' AND (learner <> 'NEW_2' OR row_index % 50 = 0)
          GROUP BY learner, dst_port) GROUP BY 1)
  SELECT learner, place, CASE WHEN c < 100 THEN 'flows_below_min_samples(100)' END AS reason, c AS flow_count, CAST(total AS BIGINT) AS total,
      round(attack_ratio, 6) AS attack_ratio, dominant_label, CASE WHEN c >= 100 THEN round(100 * h, 2) END AS score FROM kept
          JOIN profile USING (learner) JOIN pe USING (learner)
  UNION ALL SELECT learner, NULL, 'no_stream_assignment_join', 0, CAST(total AS BIGINT), round(attack_ratio, 6), dominant_label, NULL FROM profile
      WHERE learner NOT IN (SELECT learner FROM fc)""")

# sinks


def _tables(s, d):
    """A run's tables, written as Parquet and CSV and read again: name, rows of each."""
    root = work_folder(s)
    rows = flows(s, d)
    tables = {
        "dataset_label_distribution": A.label_distribution(rows),
        "learner_label_distribution": A.group_profile(rows, "learner"),
        "learner_risk_scores": loss_windows(s, d).groupBy("learner").agg(F.avg("loss").alias("risk")),
        "debug_true_overlap_pairs": _jaccards(s, d),
        "sample_learner_assignments": indexed_flows(s, d).select("row_index", F.col("learner").alias("assigned_learner"),
            F.lit("stream").alias("phase"), F.col("ts").cast("string").alias("timestamp")),
    }
    names = K.write_run(s, root, tables, {"rows": rows.count(), "tables": len(tables)})
    K.append(s.read.parquet(f"{root}/learner_risk_scores.parquet").select("risk", "learner"), f"{root}/learner_risk_scores.csv")
    K.write_json(s.read.parquet(f"{root}/learner_label_distribution.parquet").select("learner", F.from_json("labels_json",
        "map<string,bigint>").alias("labels")), f"{root}/labels.json")
    found = [(n, s.read.option("header", True).csv(f"{root}/{n}.csv").count()) for n in names[:-1]]
    found += [("labels.json", s.read.json(f"{root}/labels.json").count()), ("run_summary", s.read.text(f"{root}/run_summary").count())]
    return s.createDataFrame(found, "name string, rows long")


register("sk1_run_tables", _tables, W + ", " + LOSSES_SQL + """ SELECT 'dataset_label_distribution' AS name, count(DISTINCT label) AS rows FROM base
    UNION ALL SELECT 'learner_label_distribution', count(DISTINCT learner) FROM base UNION ALL SELECT 'learner_risk_scores',
        2 * count(DISTINCT learner) FROM losses WHERE loss <= threshold * 1.5
  UNION ALL SELECT 'debug_true_overlap_pairs', (SELECT count(DISTINCT learner) * (count(DISTINCT learner) - 1) // 2 FROM losses
      WHERE loss <= threshold) UNION ALL SELECT 'sample_learner_assignments', count(*) FROM base UNION ALL SELECT 'labels.json',
          count(DISTINCT learner) FROM base UNION ALL SELECT 'run_summary', 2""")
