"""Queries on a run as a whole: options, performance, registered functions, views of learners, three-way alignment, all tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions.labels import is_benign
from flowlens.functions.registered import register_functions
from flowlens.operators import aggregates as A
from flowlens.operators import cleaning as C
from flowlens.operators import evaluation as V
from flowlens.operators import overlap as O
from flowlens.operators import qualification as Q
from flowlens.operators import topology as T
from flowlens.session import keep
from flowlens.sources import flow_files as S
from flowlens.sources import sinks as K
from flowlens.sources.options import Options
from flowlens.sources.testdata import FLOWS_SQL, LOSSES_SQL, events, flows, indexed_flows, losses, table
from flowlens.streaming import performance as P

from .aggregate_queries import PROFILE_SQL, benign_flows, rounded
from .graph_queries import _JAC, _QUAL
from .model_queries import work_folder
from .open_set_queries import _loop
from .registry import register

W, X = f"WITH {FLOWS_SQL} ", f"WITH {LOSSES_SQL} "


def _n():
    """Rows, as an aggregate; made when it is used, as columns need a session."""
    return F.count(F.lit(1))


# options

_YAML = """
paths: {data_dir: in, output_dir: out}
runtime: {cpu_only: true, max_rows: 0, seed: 42, year_include: ['2017', '2019'], attack_type_exclude: [portscan], protocol_include: [tcp, udp],
    year_benign_exclude: ['2019']}
stream: {init_known_mode: benign_only, init_ratio: 0.01, window_size: 10000}
tsieve: {batch_size: 256, increment_epochs: 1, increment_min_samples: 100, init_epochs: 5, lr: 0.001, max_increment_samples: 1000,
    max_train_per_class: 20000, min_class_samples: 300, new_class_epochs: 4}
tmagnifier: {cluster_trigger_size: 120, dbscan_eps: 1.3, dbscan_min_samples: 10, max_unknown_buffer: 30000, new_class_min_size: 500}
"""


def _configured(s, d):
    """The flows that a configuration lets through, counted by label and protocol."""
    o = Options(_YAML)
    of = lambda name: o.get("runtime", name) or []
    rows = C.keep_years(flows(s, d), of("year_include"))
    rows = C.drop_benign_of_years(rows, of("year_benign_exclude"))
    rows = C.keep_protocols(C.drop_attacks(rows, of("attack_type_exclude")), of("protocol_include"))
    return rounded(rows.groupBy("label", "protocol").agg(_n().alias("n")))


register("sc14_configured_flows", _configured, W + "SELECT label, CAST(protocol AS BIGINT) AS protocol, count(*) AS n FROM base WHERE year_tag IN "
    "('2017', '2019') AND NOT (benign = 1 AND year_tag = '2019') AND base_label <> 'PORTSCAN' AND protocol IN (6, 17) GROUP BY 1, 2")

# performance

_LOG = ["detect", "cluster", "create", "retrain", "window"]


def _averages(s, d):
    """Events as the log of a run: a window for every 50 of them; windows of odd number took no time."""
    e = events(s, d).groupBy(F.floor(F.col("row_index") / 50).alias("w")).agg(_n().alias("rows"), F.sum("value").alias("v"))
    return rounded(P.window_averages(e.select("rows", *[(F.when(F.col("w") % 2 == 0, F.col("v")).otherwise(0.0) * k).alias(f"{name}_seconds") for k,
        name in enumerate(_LOG)])), 2)


_SUMS = ", ".join(f"round(sum(v) * {k}, 2) AS {n}_seconds_total, round(sum(v) * {k} / count(*), 2) AS avg_{n}_seconds" for k, n in enumerate(_LOG))
register(
    "ag56_performance",
    _averages,
    f"WITH e AS (SELECT event_id // 50 AS w, count(*) AS n, CASE WHEN event_id // 50 % 2 = 0 THEN sum(value) ELSE 0 END AS v FROM events GROUP BY 1) "
        f"SELECT count(*) AS windows, CAST(sum(n) AS BIGINT) AS rows, {_SUMS}, CAST(NULL AS DOUBLE) AS rows_per_s_detect, round(sum(n) / (sum(v) * "
            f"4), 2) AS rows_per_s_window FROM e",
)


def _profiled(s, d):
    """The audit with its stages timed: stage, rows and whether it took time; seconds themselves differ from run to run."""
    root, timers = work_folder(s), P.Timers()
    rows = flows(s, d)
    with timers.stage("metrics"):
        Q.metrics(rows).write.parquet(f"{root}/metrics")
    found = s.read.parquet(f"{root}/metrics")
    timers.count("metrics", found.count())
    with timers.stage("rules"):
        judged = found.withColumns({"hints": F.size(Q.matched(Q.hints())), "rules": F.size(Q.matched(Q.rules()))})
        judged.write.parquet(f"{root}/rules")
    timers.count("rules", s.read.parquet(f"{root}/rules").where("rules > 0").count())
    with timers.stage("tags"):
        timers.count("tags", Q.semantic_tags(Q.long_metrics(found)).count())
    return timers.table(s).select("stage", "rows", (F.col("seconds") > 0).alias("timed"))


register("qp3_profiled_audit", _profiled, _QUAL + ", l AS (SELECT unnest([" + ", ".join(f"{m}__score" for m in Q.METRICS) + "]) AS score FROM qw)"
         + " SELECT 'metrics' AS stage, count(*) AS rows, true AS timed FROM qw UNION ALL SELECT 'tags', count(*), true FROM l WHERE score IS NOT "
             "NULL UNION ALL SELECT 'rules', (SELECT count(*) FROM qw WHERE "
         + "1 = 0 OR " + " OR ".join("(" + " AND ".join(f"{m}__score >= {a if a is not None else -1} AND {m}__score "
             f"<= {b if b is not None else 101}" for m, a, b in needed) + (" AND (" + " OR ".join(f"({m}__score "
                 f">= {a if a is not None else -1} AND {m}__score <= {b if b is not None else 101})" for m, a, b in support) +
                     ")" if support else "") + ")" for _, _, needed, support in Q.RULES)
         + "), true")

# functions by name


def _registered(s, d):
    register_functions(s)
    flows(s, d).select("label", "learner", "fwd", "bwd").createOrReplaceTempView("flowlens_flows")
    counted = s.sql("SELECT learner, is_benign_label(label) AS benign, label_year_tag(label) AS year, safe_div(sum(bwd), sum(fwd)) AS ratio, "
        "soft_probability(avg(bwd) / 50, 4D) AS p FROM flowlens_flows GROUP BY ALL")
    entropy = s.sql("SELECT learner, norm_entropy(collect_list(CAST(n AS DOUBLE))) AS h FROM (SELECT learner, label, count(*) AS n FROM "
        "flowlens_flows GROUP BY ALL) GROUP BY learner")
    return rounded(counted.join(entropy, "learner"), 5)


register(
    "fn_registered",
    _registered,
    W + """, h AS (SELECT learner, -sum(p * ln(p)) / ln(count(*)) AS h FROM (SELECT learner, count(*) / sum(count(*)) OVER (PARTITION BY learner) AS p
        FROM base GROUP BY learner, label) GROUP BY 1)
  SELECT b.learner, b.benign = 1 AS benign, year_tag AS year, round(sum(bwd) / sum(fwd), 5) AS ratio, round(1 / (1 + exp(-4 * avg(bwd) / 50)),
      5) AS p, round(max(h), 5) AS h FROM base b JOIN h USING (learner) GROUP BY 1, 2, 3""",
)


def _table_function(s, d):
    register_functions(s)
    O.accepted(losses(s, d)).groupBy("row_index").agg(F.collect_list("learner").alias("names")).createOrReplaceTempView("flowlens_accepted")
    return s.sql("SELECT p.learner_a, p.learner_b, count(*) AS both FROM flowlens_accepted, LATERAL accepted_pairs(names) p GROUP BY ALL")


register("fn_accepted_pairs", _table_function, X + _JAC + ' SELECT learner_a, learner_b, "both" FROM jx WHERE "both" > 0')

# views


def _view_links(s, d):
    """The compact graph of hosts of each learner that has a view."""
    rows = flows(s, d)
    names = T.learner_views(rows, least=900, most=4).select("learner")
    return T.compact(T.edges(rows.join(F.broadcast(names), "learner", "left_semi"), ["learner"], F.col("src_ip"), F.col("dst_ip")), "learner", 60,
        80)[0]  # at most four names


register("gr7_learner_views", lambda s, d: rounded(T.learner_views(flows(s, d), least=900, most=4)),
         W + PROFILE_SQL + ", t AS (SELECT * FROM profile WHERE learner <> 'UNKNOWN' AND total >= 900 ORDER BY total DESC, learner LIMIT 4), m AS "
             "(SELECT learner, max(c) AS top FROM pc GROUP BY 1) SELECT learner, row_number() OVER (ORDER BY attack_ratio DESC, total DESC, learner) "
                 "AS place, CAST(total AS BIGINT) AS total, round(attack_ratio, 6) AS attack_ratio, dominant_label, round(top / total, 6) AS "
                     "dominant_ratio FROM t JOIN m USING (learner)")
register("gr7_view_links", _view_links, W + PROFILE_SQL + """, v AS (SELECT learner FROM profile WHERE learner <> 'UNKNOWN'
    AND total >= 900 ORDER BY total DESC, learner LIMIT 4), e AS (SELECT learner, src_ip AS src, dst_ip AS dst, count(*) AS n FROM base
        WHERE learner IN (SELECT learner FROM v) GROUP BY ALL),
  t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY learner ORDER BY n DESC, src, dst) AS r FROM e) WHERE r <= 60), k AS (SELECT *
      FROM (SELECT learner, node, row_number() OVER (PARTITION BY learner ORDER BY sum(n) DESC, node) AS r FROM (SELECT learner, src AS node, n FROM t
          UNION ALL SELECT learner, dst, n FROM t) GROUP BY learner, node) WHERE r <= 80)
  SELECT learner, src, dst, n FROM t WHERE (learner, src) IN (SELECT learner, node FROM k) AND (learner, dst) IN (SELECT learner, node FROM k)""")  # fmt: skip
register("tk6_top_pairs", lambda s, d: rounded(O.jaccard(O.accepted(losses(s, d))).orderBy(F.col("jaccard").desc(), F.col("both").desc(), "learner_a",
    "learner_b").limit(20).select("learner_a", "learner_b", "both", "jaccard")),
         X + _JAC + ' SELECT learner_a, learner_b, "both", round(jaccard, 6) AS jaccard FROM jx ORDER BY jx.jaccard DESC, "both" DESC, learner_a, '
             'learner_b LIMIT 20')
register("tk6_top_correlations", lambda s, d: rounded(A.correlations(benign_flows(s, d), ["l_quantity", "l_discount", "bwd", "l_linenumber", "l_tax"],
    "benign").orderBy(F.abs("pearson").desc(), "feature").limit(3).select("feature", "pearson"), 5),
         W + "SELECT feature, round(p, 5) AS pearson FROM (SELECT feature, corr(x, benign) AS p FROM (SELECT benign, unnest(['l_quantity', "
             "'l_discount', 'bwd', 'l_linenumber', 'l_tax']) AS feature, unnest([l_quantity, l_discount, bwd, l_linenumber, l_tax]) AS x FROM base) "
                 "GROUP BY 1) ORDER BY abs(p) DESC, 1 LIMIT 3")


def _three(s, d):
    """Customers, suppliers and nations under one set of column names, in order."""
    of = lambda t: S.trim_names(table(s, d, t).withColumnRenamed(f"{t[0]}_name", f" {t[0]}_name "), {f"{t[0]}_name": "name",
        f"{t[0]}_nationkey": "nation", f"{t[0]}_comment": "note"})
    a, b, c = S.align([of("customer"), of("supplier"), of("nation")], ["name", "nation"])
    return rounded(S.in_order([a, b, c]).groupBy("file_no", "nation").agg(_n().alias("n"), F.min("name").alias("first")))


register("sc5_three_way", _three, """SELECT 0::BIGINT AS file_no, c_nationkey::BIGINT AS nation, count(*) AS n, min(c_name) AS "first" FROM customer
    GROUP BY 2 UNION ALL SELECT 1, s_nationkey, count(*), min(s_name) FROM supplier GROUP BY 2 UNION ALL SELECT 2, n_nationkey, count(*), min(n_name)
        FROM nation GROUP BY 2""")

# every table of a run


def _all_tables(s, d):
    """A run of the open-set loop over the flows with everything that it leaves, each table written and counted when read again."""
    root = work_folder(s)
    run, stream = _loop(s, d, 40_000)
    owners, rows = keep(run.run(stream), "owners"), keep(indexed_flows(s, d), "flows")  # most tables read them
    assigned = rows.drop("learner").join(owners.withColumnRenamed("assigned_learner", "learner"), "row_index")
    assigned.write.parquet(f"{root}/assigned")
    assigned = s.read.parquet(f"{root}/assigned")
    known = run.learners().drop("params", "guard")
    creations = owners.where("phase = 'creation'")
    profile = A.group_profile(assigned, "learner")
    pairs = O.jaccard_from_counts(run.accept_counts(), run.pair_counts())
    tables = {
        "dataset_label_distribution": A.label_distribution(rows),
        "dataset_label_feature_attack_correlation": A.correlations(benign_flows(s, d), ["l_quantity", "bwd"], "benign"),
        "dataset_network_topology": T.graph_stats(T.edges(rows, ["label"], F.col("src_ip"), F.col("dst_ip")), ["label"]),
        "learner_count_over_time": run.window_log(),
        "learner_creation_distribution": creations.join(rows.select("row_index", "label"), "row_index").groupBy("assigned_learner",
            "label").agg(_n().alias("n")),
        "learner_train_batch_label_distribution": run.label_counts(),
        "learner_label_distribution": profile,
        "learner_creation_flow_previews": C.first_per_group(creations.join(rows, "row_index").select("row_index", "assigned_learner", "src_ip",
            "dst_ip", "dst_port", "label"), ["assigned_learner"], ["row_index"], 10),
        "learner_feature_attack_ratio_correlation": A.feature_profile(assigned, ["learner"], ["l_quantity", "bwd"]),
        "learner_registry": known,
        "metrics": V.assignment_risk(assigned),
        "debug_true_overlap_pairs": pairs,
        "performance_metrics": P.window_averages(run.window_log()),
        "sample_learner_assignments": owners.join(rows.select("row_index", F.col("ts").cast("string").alias("timestamp")), "row_index"),
        "learner_creation_row_indices": creations.groupBy("assigned_learner").agg(_n().alias("n"), F.min("row_index").alias("first")),
        "learner_network_topology": T.learner_views(assigned),
        "learner_topology_metric_audit": Q.qualify(assigned),
        "learner_protocol_mix": A.protocol_mix(assigned, "learner"),
        "learner_temporal_stats": A.temporal_stats(assigned, "learner"),
        "learner_port_stats": A.port_stats(assigned, "learner"),
    }
    K.write_run(s, f"{root}/out", tables, {"rows": rows.count(), "learners": known.count(), "benign": rows.where(is_benign(F.col("label"))).count()})
    P.write_report(P.window_averages(run.window_log()), "performance", f"{root}/out/benchmark")
    found = [(n, s.read.parquet(f"{root}/out/{n}.parquet").count(), s.read.option("header", True).csv(f"{root}/out/{n}.csv").count()) for n in tables]
    return s.createDataFrame(found, "name string, rows long, csv_rows long")


register("sk4_all_run_tables", _all_tables)
