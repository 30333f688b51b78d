"""Queries on topology, qualification, overlap, joins, sets and ordering."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from flowlens.functions.labels import base_label, is_benign
from flowlens.functions.stats import concentration, log_score, normal_entropy, richness
from flowlens.operators import aggregates as A
from flowlens.operators import claims as K
from flowlens.operators import evaluation as V
from flowlens.operators import overlap as O
from flowlens.operators import qualification as Q
from flowlens.operators import topology as T
from flowlens.session import keep
from flowlens.sources.testdata import FLOWS_SQL, LOSSES_SQL, flows, indexed_flows, losses, table

from .aggregate_queries import benign_flows, rounded, stability_sql
from .registry import register

W, X, WR = f"WITH {FLOWS_SQL} ", f"WITH {LOSSES_SQL} ", f"WITH RECURSIVE {FLOWS_SQL} "


def _n():
    """Rows, as an aggregate; made when it is used, as columns need a session."""
    return F.count(F.lit(1))


def _hosts(s, d, key="learner"):
    return T.edges(flows(s, d), [key], F.col("src_ip"), F.col("dst_ip"))


_E = ", e AS (SELECT learner, src_ip AS src, dst_ip AS dst, count(*) AS n FROM base GROUP BY ALL)"
_DEG = _E + """, nd AS (SELECT learner, src AS node FROM e UNION SELECT learner, dst FROM e),
  od AS (SELECT learner, src AS node, count(*) AS o, sum(n) AS so FROM e GROUP BY ALL), idg AS (SELECT learner, dst AS node, count(*) AS i,
      sum(n) AS si FROM e GROUP BY ALL),
  dg AS (SELECT learner, node, CAST(coalesce(o, 0) AS BIGINT) AS out_degree, CAST(coalesce(i, 0) AS BIGINT) AS in_degree, CAST(coalesce(so,
      0) AS BIGINT) AS out_flows, CAST(coalesce(si, 0) AS BIGINT) AS in_flows FROM nd LEFT JOIN od USING (learner, node) LEFT JOIN idg USING (learner, node)),
  nb AS (SELECT learner, node, count(DISTINCT other) AS neighbours FROM (SELECT learner, src AS node, dst AS other FROM e UNION ALL SELECT learner,
      dst, src FROM e) GROUP BY ALL)"""
_STATS = _DEG + """, rv AS (SELECT a.*, coalesce(b.n, 0) AS back FROM e a LEFT JOIN e b ON a.learner = b.learner AND a.src = b.dst AND a.dst = b.src),
  s1 AS (SELECT learner, count(*) AS nodes, max(out_degree) AS o, max(in_degree) AS i, sum((neighbours <= 1)::INT) AS leaf FROM dg
      JOIN nb USING (learner, node) GROUP BY learner),
  s2 AS (SELECT learner, count(*) AS edges, sum((back > 0 AND src <> dst)::INT) AS two, sum(CASE WHEN back > 0 THEN least(n, back) ELSE 0 END) AS mn,
      sum(CASE WHEN back > 0 THEN n ELSE 0 END) AS sm FROM rv GROUP BY learner),
  st AS (SELECT learner, nodes, edges, CASE WHEN nodes > 1 THEN edges / (nodes*(nodes-1)) ELSE 0 END AS density, o / greatest(1,
      nodes-1) AS max_out_ratio, i / greatest(1, nodes-1) AS max_in_ratio, leaf / nodes AS leaf_ratio, edges / nodes AS edge_per_node,
          two / edges AS reciprocity, CASE WHEN sm > 0 THEN mn / sm ELSE 0 END AS weighted_reciprocity FROM s1 JOIN s2 USING (learner))"""
_STAT_COLS = "learner, nodes, edges, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("density", "max_out_ratio", "max_in_ratio", "leaf_ratio",
    "edge_per_node", "reciprocity", "weighted_reciprocity"))

register("gr1_endpoint_keys", lambda s, d: flows(s, d).groupBy(T.endpoint(F.col("dst_ip"),
    F.col("dst_port")).alias("endpoint")).agg(_n().alias("n")).where("n >= 5"), W + "SELECT concat(trim(dst_ip), ':', dst_port) AS endpoint, count(*) "
        "AS n FROM base GROUP BY 1 HAVING count(*) >= 5")
register("gr2_edges", lambda s, d: _hosts(s, d).where("n > 1"), W + _E + " SELECT * FROM e WHERE n > 1")
register("gr3_compact_links", lambda s, d: T.compact(_hosts(s, d), "learner", 40, 20)[0], W + _E + """, t AS (SELECT * FROM (SELECT *,
    row_number() OVER (PARTITION BY learner ORDER BY n DESC, src, dst) AS r FROM e) WHERE r <= 40),
  k AS (SELECT * FROM (SELECT learner, node, row_number() OVER (PARTITION BY learner ORDER BY sum(n) DESC, node) AS r FROM (SELECT learner,
      src AS node, n FROM t UNION ALL SELECT learner, dst, n FROM t) GROUP BY learner, node) WHERE r <= 20)
  SELECT learner, src, dst, n FROM t WHERE (learner, src) IN (SELECT learner, node FROM k) AND (learner, dst) IN (SELECT learner, node FROM k)""")
register("gr3_compact_nodes", lambda s, d: T.compact(_hosts(s, d), "learner", 0, 15)[1], W + _E + " SELECT learner, node, CAST(f AS BIGINT) AS flows "
    "FROM (SELECT learner, node, sum(n) AS f, row_number() OVER (PARTITION BY learner ORDER BY sum(n) DESC, node) AS r FROM (SELECT learner, src AS "
        "node, n FROM e UNION ALL SELECT learner, dst, n FROM e) GROUP BY learner, node) WHERE r <= 15")
register("gr4_private_addresses", lambda s, d: flows(s, d).groupBy(T.is_private(F.col("src_ip")).alias("src"),
    T.is_private(F.col("dst_ip")).alias("dst")).agg(_n().alias("n")), W + "SELECT true AS src, dst_ip LIKE '10.%' AS dst, count(*) AS n FROM base GROUP BY 2")
register("gr5_endpoint_stats", lambda s, d: rounded(flows(s, d).groupBy("learner").agg(F.count_distinct("src_ip").alias("sources"),
    F.count_distinct("dst_ip").alias("targets"), F.count_distinct("dst_port").alias("ports"),
        F.avg(T.is_private(F.col("dst_ip")).cast("double")).alias("internal"))), W + "SELECT learner, count(DISTINCT src_ip) AS sources, "
            "count(DISTINCT dst_ip) AS targets, count(DISTINCT dst_port) AS ports, round(avg((dst_ip LIKE '10.%')::INT), 6) AS internal FROM base GROUP BY 1")
register("gr6_label_views", lambda s, d: _views(s, d), W + """, v AS (SELECT label AS view, src_ip, dst_ip FROM base UNION ALL SELECT CASE
    WHEN benign = 1 THEN '__benign__' ELSE '__attack__' END, src_ip, dst_ip FROM base UNION ALL SELECT '__combined__', src_ip, dst_ip FROM base),
  e AS (SELECT view, src_ip AS src, dst_ip AS dst, count(*) AS n FROM v GROUP BY ALL) SELECT view, src, dst, n FROM (SELECT *,
      row_number() OVER (PARTITION BY view ORDER BY n DESC, src, dst) AS r FROM e) WHERE r <= 10""")


def _views(s, d):
    tags = F.array("label", F.when(is_benign(F.col("label")), "__benign__").otherwise("__attack__"), F.lit("__combined__"))
    rows = flows(s, d).select(F.explode(tags).alias("view"), "src_ip", "dst_ip")
    return T.compact(T.edges(rows, ["view"], F.col("src_ip"), F.col("dst_ip")), "view", 10, 0)[0]


register("gr8_degrees", lambda s, d: T.degrees(_hosts(s, d), ["learner"]), W + _DEG + " SELECT * FROM dg")
register("gr9_neighbours", lambda s, d: T.neighbours(_hosts(s, d), ["learner"]), W + _DEG + " SELECT * FROM nb")
register("gr13_graph_stats", lambda s, d: rounded(T.graph_stats(_hosts(s, d), ["learner"])), W + _STATS + f" SELECT {_STAT_COLS} FROM st")


def _trade(s, d):
    """Customers and priorities of every order: a sparse graph with many components, keyed by the order's day."""
    name = F.concat(F.lit("p"), F.left("o_orderpriority", F.lit(1)), F.lit("-"), (F.col("o_orderkey") % 7).cast("string"))
    rows = table(s, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.concat(F.lit("c"), "o_custkey").alias("src"), name.alias("dst"))
    return rows.groupBy("day", "src", "dst").agg(_n().alias("n"))


_CC = """WITH RECURSIVE e AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS day, concat('c', o_custkey) AS src,
    concat('p', left(o_orderpriority, 1), '-', o_orderkey % 7) AS dst FROM orders),
  b AS (SELECT day, src AS x, dst AS y FROM e UNION SELECT day, dst, src FROM e), r(day, x, y) AS (SELECT day, x, x FROM b
    UNION SELECT r.day, r.x, b.y FROM r JOIN b ON r.day = b.day AND r.y = b.x),
  c AS (SELECT day, x AS node, min(y) AS component FROM r GROUP BY ALL)"""
register("gr10_components", lambda s, d: T.components(_trade(s, d), "day"), _CC + " SELECT * FROM c")
register("gr10_component_stats", lambda s, d: rounded(T.component_stats(T.components(_trade(s, d), "day"), "day")), _CC + ", n AS (SELECT day, "
    "component, count(*) AS n FROM c GROUP BY ALL) SELECT day, count(*) AS components, round(max(n) / sum(n), 6) AS largest_ratio, round(1 - max(n) / "
        "sum(n), 6) AS fragment_ratio FROM n GROUP BY day")


def endpoint_graph_sql(key: str, where: str = "true") -> str:
    """CTE gs (of a WITH RECURSIVE): of the graph of ip:port endpoints for each value k of key, its counts, degrees, opposite edges
    and weak components. A component's label is the smallest node; it spreads for as long as any label changes."""
    out = f""", e AS MATERIALIZED (SELECT {key} AS k, concat(src_ip, ':', src_port) AS src, concat(dst_ip, ':', dst_port) AS dst, count(*) AS n,
        sum(1 - benign) AS attacks FROM base WHERE {where} GROUP BY ALL),
  bw AS MATERIALIZED (SELECT k, src AS x, dst AS y FROM e UNION SELECT k, dst, src FROM e UNION SELECT k, src, src FROM e UNION SELECT k, dst, dst FROM e),
  cl(k, node, c) USING KEY (k, node) AS (SELECT k, x, min(y) FROM bw GROUP BY 1, 2
    UNION SELECT b.k, b.x, min(l.c) FROM cl l JOIN bw b ON b.k = l.k AND b.y = l.node JOIN recurring.cl now ON now.k = b.k AND now.node = b.x
        WHERE l.c < now.c GROUP BY 1, 2)"""
    return out + f""", g1 AS (SELECT k, count(*) AS nodes FROM cl GROUP BY 1), g2 AS (SELECT k, count(*) AS edges, sum(n) AS rows,
        sum(attacks) AS attacks FROM e GROUP BY 1), g3 AS (SELECT k, max(o) AS max_out FROM (SELECT k, src, count(*) AS o FROM e GROUP BY 1, 2) GROUP BY 1),
  g4 AS (SELECT k, max(i) AS max_in FROM (SELECT k, dst, count(*) AS i FROM e GROUP BY 1, 2) GROUP BY 1), g5 AS (SELECT a.k,
      sum((b.src IS NOT NULL)::INT) AS opposite, sum((b.src IS NOT NULL AND a.src <> a.dst)::INT) AS opposite_other FROM e a LEFT JOIN e b
          ON a.k = b.k AND a.src = b.dst AND a.dst = b.src GROUP BY 1),
  g6 AS (SELECT k, count(*) AS components, max(c) AS largest FROM (SELECT k, c AS name, count(*) AS c FROM cl GROUP BY 1, 2) GROUP BY 1),
  gs AS (SELECT * FROM g1 JOIN g2 USING (k) JOIN g3 USING (k) JOIN g4 USING (k) JOIN g5 USING (k) JOIN g6 USING (k))"""


def _attack_graphs(s, d):
    """The attack flows of each base label as a graph of endpoints."""
    rows = flows(s, d).where(~is_benign(F.col("label"))).withColumn("base", base_label(F.col("label")))
    edge = keep(T.edges(rows, ["base"], T.endpoint(F.col("src_ip"), F.col("src_port")), T.endpoint(F.col("dst_ip"), F.col("dst_port"))), "edges")
    stats = T.anomaly_flags(T.graph_metrics(edge, "base"))
    return rounded(stats.select("base", "nodes", "edges", "density", "components", "largest_ratio", "reciprocity", "max_out_ratio", "max_in_ratio", "flags"))


register("gr14_anomaly_flags", _attack_graphs, WR + endpoint_graph_sql("base_label", "benign = 0") + """, x AS (SELECT k AS base, nodes, edges,
    edges / (nodes * (nodes - 1)) AS density, components, largest / nodes AS largest_ratio, opposite_other / edges AS reciprocity,
        max_out / greatest(1, nodes - 1) AS max_out_ratio, max_in / greatest(1, nodes - 1) AS max_in_ratio FROM gs),
  f AS (SELECT base, concat_ws('|', CASE WHEN max_out_ratio >= 0.25 THEN 'STRONG_SOURCE_HUB' END, CASE
      WHEN max_in_ratio >= 0.25 THEN 'STRONG_SINK_HUB' END, CASE WHEN reciprocity <= 0.01 THEN 'VERY_LOW_RECIPROCITY' END, CASE
          WHEN components >= greatest(8, floor(0.1 * nodes)) THEN 'HIGH_FRAGMENTATION' END,
    CASE WHEN largest_ratio <= 0.35 THEN 'SMALL_GIANT_COMPONENT' END, CASE WHEN density >= 0.02 AND nodes > 200 THEN 'UNUSUALLY_DENSE' END) AS flags FROM x)
  SELECT base, nodes, edges, round(density, 6) AS density, components, round(largest_ratio, 6) AS largest_ratio, round(reciprocity, 6) AS reciprocity,
      round(max_out_ratio, 6) AS max_out_ratio, round(max_in_ratio, 6) AS max_in_ratio, CASE WHEN flags = '' THEN 'NO_STRONG_TOPO_ANOMALY'
          ELSE flags END AS flags FROM x JOIN f USING (base)""")


def _edge_rule_rates(s, d, hub=0.01):
    """The rules of flows, worked out on edges, each of which stands for its flows. No endpoint of these flows reaches the
    default share of 0.25, so the query asks for a hundredth."""
    rows = benign_flows(s, d).select(T.endpoint(F.col("src_ip"), F.col("src_port")).alias("src"), T.endpoint(F.col("dst_ip"),
        F.col("dst_port")).alias("dst"), "benign")
    edge = keep(rows.groupBy("src", "dst").agg(_n().alias("n"), F.sum("benign").alias("benign"), F.sum(1 - F.col("benign")).alias("attacks")), "edges")
    return rounded(T.rule_rates(T.edge_rules(edge, hub), T.FLOW_RULES))


def rates_sql(rows: str, rules) -> str:
    """The rates of each rule over rows(benign, <rule>...)."""
    each = " UNION ALL ".join(f"SELECT '{r}' AS rule, sum((benign = 0 AND {r})::INT) AS tp, sum((benign = 1 AND NOT {r})::INT) AS tn, sum((benign = 1 "
        f"AND {r})::INT) AS fp, sum((benign = 0 AND NOT {r})::INT) AS fn FROM {rows}" for r in rules)
    return f", rr AS ({each}) SELECT rule, CAST(tp AS BIGINT) AS tp, CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(fp / greatest(1, fp + tn), 6) AS fpr, round(fn / greatest(1, fn + tp), 6) AS fnr, round(tp / greatest(1, fn + tp), 6) AS tpr, round(tp / greatest(1, tp + fp), 6) AS \"precision\", CAST(tp + fp AS BIGINT) AS flagged FROM rr"


register("gr15_flow_rules", _edge_rule_rates, W + """, p AS (SELECT DISTINCT concat(src_ip, ':', src_port) AS src, concat(dst_ip, ':',
    dst_port) AS dst FROM base), nn AS (SELECT greatest(1, count(*) - 1) AS denom FROM (SELECT src FROM p UNION SELECT dst FROM p)),
        od AS (SELECT src, count(DISTINCT dst) / (SELECT denom FROM nn) AS o FROM p GROUP BY 1), idg AS (SELECT dst,
            count(DISTINCT src) / (SELECT denom FROM nn) AS i FROM p GROUP BY 1),
  fl AS (SELECT b.benign, o >= 0.01 AS a, i >= 0.01 AS k, r.src IS NULL AS l FROM base b JOIN od ON od.src = concat(b.src_ip, ':', b.src_port)
      JOIN idg ON idg.dst = concat(b.dst_ip, ':', b.dst_port) LEFT JOIN p r ON r.src = concat(b.dst_ip, ':', b.dst_port) AND r.dst = concat(b.src_ip,
          ':', b.src_port)),
  rl AS (SELECT benign, a AS rule_source_hub, k AS rule_sink_hub, l AS rule_low_reciprocity, k OR l AS rule_sink_or_low_recip, a OR k
      OR l AS rule_src_or_sink_or_low_recip FROM fl)""" + rates_sql("rl", T.FLOW_RULES))

#: Windows of 2000 flows; of these flows' windows none is nearly free of attacks, so those with at most 0.7 count as quiet.
_WIN = WR + endpoint_graph_sql("CAST(floor(row_index / 2000) AS BIGINT)") + """, wn AS (SELECT k AS window_id, CAST(rows AS BIGINT) AS rows,
    attacks / rows AS attack_ratio, CAST(attacks > 0 AS BIGINT) AS is_attack_window, nodes, edges, opposite / edges AS reciprocity,
        max_out / greatest(1, nodes - 1) AS hub_out_ratio, max_in / greatest(1, nodes - 1) AS hub_in_ratio, components / nodes AS frag_ratio,
            largest / nodes AS largest_cc_ratio FROM gs)"""
_WIN_RULES = """, q AS (SELECT quantile_cont(reciprocity, 0.10) AS recip_low, quantile_cont(hub_in_ratio, 0.95) AS in_high,
    quantile_cont(hub_out_ratio, 0.95) AS out_high, quantile_cont(frag_ratio, 0.95) AS frag_high, quantile_cont(largest_cc_ratio, 0.05) AS lcc_low
        FROM wn WHERE attack_ratio <= 0.7),
  wr AS (SELECT window_id, hub_in_ratio >= in_high AND reciprocity <= recip_low AS rule_win_sink_lowrecip, hub_out_ratio >= out_high
      AND reciprocity <= recip_low AS rule_win_src_lowrecip, frag_ratio >= frag_high AND largest_cc_ratio <= lcc_low AS rule_win_frag_lcc FROM wn, q),
  wq AS (SELECT *, rule_win_sink_lowrecip OR rule_win_src_lowrecip OR rule_win_frag_lcc AS rule_win_combo FROM wr)"""


def window_graphs(s, d):
    return T.window_graphs(benign_flows(s, d, indexed_flows), 2000)


register("gr16_window_graphs", lambda s, d: rounded(window_graphs(s, d)), _WIN + " SELECT window_id, rows, round(attack_ratio, 6) AS attack_ratio, "
    "is_attack_window, nodes, edges, round(reciprocity, 6) AS reciprocity, round(hub_out_ratio, 6) AS hub_out_ratio, round(hub_in_ratio, 6) AS "
        "hub_in_ratio, round(frag_ratio, 6) AS frag_ratio, round(largest_cc_ratio, 6) AS largest_cc_ratio FROM wn")
register("gr17_window_rules", lambda s, d: T.window_rules(window_graphs(s, d), quiet=0.7).select("window_id", *T.WINDOW_RULES), _WIN + _WIN_RULES + " "
    "SELECT * FROM wq")


# qualification: the counts behind the metrics, then all of it

_KEYS = """, k AS (SELECT learner, unnest(['dst_port', 'src_port', 'endpoint_edge', 'host_edge', 'dst_host', 'src_endpoint', 'dst_endpoint']) AS kind,
  unnest([dst_port::VARCHAR, src_port::VARCHAR, concat(src_ip, ':', src_port, ' -> ', dst_ip, ':', dst_port), concat(src_ip, ' -> ', dst_ip), dst_ip,
      concat(src_ip, ':', src_port), concat(dst_ip, ':', dst_port)]) AS key FROM base),
  kc AS (SELECT learner, kind, key, count(*) AS n FROM k GROUP BY ALL), kp AS (SELECT *, n / sum(n) OVER (PARTITION BY learner, kind) AS p FROM kc),
  ks AS (SELECT learner, kind, CASE WHEN count(*) <= 1 THEN 0 ELSE greatest(0, least(1, -sum(p*ln(p)) / ln(count(*)))) END AS h, max(p) AS top,
      count(*) AS u, sum(p*p) AS hhi, CAST(sum(n) AS BIGINT) AS flows FROM kp GROUP BY ALL)"""
register("qm_key_statistics", lambda s, d: rounded(_key_stats(s, d)), W + _KEYS + " SELECT learner, kind, round(h, 6) AS h, round(top, 6) AS top, u, "
    "round(hhi, 6) AS hhi, flows FROM ks")


def _key_stats(s, d):
    c = Q.key_counts(flows(s, d), "learner").withColumn("total", F.sum("n").over(Window.partitionBy("learner", "kind")))
    return c.groupBy("learner", "kind").agg(normal_entropy(F.col("n"), F.col("total")).alias("h"), F.max(F.col("n") / F.col("total")).alias("top"),
        _n().alias("u"), concentration(F.col("n"), F.col("total")).alias("hhi"), F.max("total").alias("flows"))


register("qm2_richness", lambda s, d: rounded(flows(s, d).groupBy("learner").agg(richness(F.count_distinct("dst_port"), _n(),
    65536).alias("richness"))), W + "SELECT learner, round(least(100, 100 * ln(1 + count(DISTINCT dst_port)) / ln(1 + least(count(*), 65536))), 6) AS "
        "richness FROM base GROUP BY 1")
register("qm7_edge_reuse", lambda s, d: rounded(_key_stats(s, d).where("kind = 'endpoint_edge'").select("learner",
    (F.col("flows") / F.col("u")).alias("raw"), log_score(F.col("flows") / F.col("u"), 100).alias("score"))), W + _KEYS + " SELECT learner, "
        "round(flows/u, 6) AS raw, round(least(100, 100 * ln(1 + flows/u) / ln(101)), 6) AS score FROM ks WHERE kind = 'endpoint_edge'")
register("qm19_low_reciprocity", lambda s, d: rounded(flows(s, d).groupBy("learner").agg((1 - F.sum(F.least("fwd", "bwd")) / F.sum(F.col("fwd") +
    F.col("bwd"))).alias("low_reciprocity"))), W + "SELECT learner, round(1 - sum(least(fwd, bwd)) / sum(fwd + bwd), 6) AS low_reciprocity FROM base "
        "GROUP BY 1")
_TEMP = """, te AS (SELECT learner, epoch_us(min(ts)) AS low, epoch_us(max(ts)) AS high FROM base GROUP BY 1), tw AS (SELECT min(low) AS w0,
    max(high) AS w1, greatest(128, least(2048, floor((max(high)-min(low))/1e6/3600))) AS nb FROM te),
  tb AS (SELECT b.learner, CASE WHEN high = low THEN 0 ELSE least(99, floor((epoch_us(ts)-low)*100/(high-low))) END AS own, CASE WHEN w1 = w0 THEN 0
      ELSE least(nb-1, floor((epoch_us(ts)-w0)*nb/(w1-w0))) END AS whole FROM base b JOIN te USING (learner), tw),
  tn AS (SELECT learner, 'own' AS kind, own AS bin, count(*) AS n FROM tb GROUP BY ALL UNION ALL SELECT learner, 'whole', whole, count(*) FROM tb
      GROUP BY ALL), tp AS (SELECT *, n / sum(n) OVER (PARTITION BY learner, kind) AS p FROM tn),
  ts_ AS (SELECT learner, kind, sum(p*p) AS hhi, CASE WHEN count(*) <= 1 THEN 0 ELSE greatest(0, least(1, -sum(p*ln(p))/ln(count(*)))) END AS h
      FROM tp GROUP BY ALL),
  tm AS (SELECT o.learner, 0.5*o.hhi + 0.5*(1 - CASE WHEN w1 = w0 THEN 1 ELSE least(1, (high-low)/(w1-w0)) END) AS temporal_burst,
      o.h AS temporal_intra_uniformity, w.h AS temporal_global_spread FROM ts_ o JOIN ts_ w ON o.learner = w.learner AND o.kind = 'own'
          AND w.kind = 'whole' JOIN te ON te.learner = o.learner, tw)"""
register("qm20_temporal_metrics", lambda s, d: rounded(Q.temporal_metrics(flows(s, d), "learner")), W + _TEMP + " SELECT learner, "
    "round(temporal_burst, 6) AS temporal_burst, round(temporal_intra_uniformity, 6) AS temporal_intra_uniformity, round(temporal_global_spread, 6) "
        "AS temporal_global_spread FROM tm")

_EP = _STATS.replace("SELECT learner, src_ip AS src, dst_ip AS dst, count(*) AS n FROM base", "SELECT learner, concat(src_ip, ':', src_port) AS src, "
    "concat(dst_ip, ':', dst_port) AS dst, count(*) AS n FROM base")
_HOST = """, he AS (SELECT DISTINCT learner, src_ip AS src, dst_ip AS dst FROM base), hn AS (SELECT learner, count(*) AS nodes FROM (SELECT learner,
    src AS x FROM he UNION SELECT learner, dst FROM he) GROUP BY 1),
  hh AS (SELECT learner, (SELECT max(c) FROM (SELECT count(*) AS c FROM he a WHERE a.learner = hn.learner GROUP BY dst)) / greatest(1,
      nodes-1) AS hin, (SELECT max(c) FROM (SELECT count(*) AS c FROM he a WHERE a.learner = hn.learner GROUP BY src)) / greatest(1, nodes-1) AS hout
          FROM hn)"""
_PIV = ", pv AS (SELECT learner, max(flows) AS flows, " + ", ".join(f"max(CASE WHEN kind = '{k}' THEN {v} END) AS {k}_{v}" for k in ("dst_port",
    "src_port", "endpoint_edge", "host_edge", "dst_host", "src_endpoint", "dst_endpoint") for v in ("h", "top",
        "u")) + " FROM ks GROUP BY 1), pk AS (SELECT learner, sum(least(fwd, bwd)) AS mn, sum(fwd + bwd) AS sm FROM base GROUP BY 1)"
_METRIC_SQL = {
    "dst_port_entropy": ("dst_port_h", None), "dst_port_richness": ("dst_port_u::DOUBLE", "least(100, 100 * ln(1 + dst_port_u) / ln(1 + least(flows, "
        "65536)))"), "src_port_entropy": ("src_port_h", None), "dst_port_top1_concentration": ("dst_port_top", None),
    "endpoint_edge_entropy": ("endpoint_edge_h", None), "top1_endpoint_edge_share": ("endpoint_edge_top", None), "edge_reuse_ratio": ("flows / "
        "endpoint_edge_u", "least(100, 100 * ln(1 + flows / endpoint_edge_u) / ln(101))"), "host_edge_entropy": ("host_edge_h", None),
    "dst_host_concentration": ("dst_host_top", None), "host_max_in_degree_ratio": ("hin", None), "host_max_out_degree_ratio": ("hout", None),
        "src_dst_endpoint_asymmetry": ("abs(src_endpoint_u - dst_endpoint_u) / nodes", None),
    "src_endpoint_concentration": ("src_endpoint_top", None), "dst_endpoint_concentration": ("dst_endpoint_top", None),
        "max_in_degree_ratio": ("max_in_ratio", None), "max_out_degree_ratio": ("max_out_ratio", None), "leaf_ratio": ("leaf_ratio", None),
    "edge_per_node": ("edge_per_node", "least(100, 100 * ln(1 + edge_per_node) / ln(11))"), "low_reciprocity": ("CASE WHEN sm > 0 THEN 1 - mn/sm END",
        None), "temporal_burst": ("temporal_burst", None), "temporal_global_spread": ("temporal_global_spread", None),
            "temporal_intra_uniformity": ("temporal_intra_uniformity", None),
}
_QUAL = W + _EP + _KEYS + _HOST + _TEMP + _PIV + ", qw AS (SELECT learner, pv.flows AS flows, " + ", ".join(f"round({a}, 6) AS {m}, "
    f"round({b or f'100 * ({a})'}, 2) AS {m}__score" for m, (a,
        b) in _METRIC_SQL.items()) + " FROM pv JOIN st USING (learner) JOIN hh USING (learner) JOIN tm USING (learner) JOIN pk USING (learner))"


def _rule_sql(needed, support) -> str:
    one = lambda m, a, b: f"({m}__score >= {a if a is not None else -1} AND {m}__score <= {b if b is not None else 101})"
    text = " AND ".join(one(*x) for x in needed)
    return f"({text})" + (" AND (" + " OR ".join(one(*x) for x in support) + ")" if support else "")


_HINT_SQL = """concat_ws('|', CASE WHEN (top1_endpoint_edge_share__score >= 80 OR dst_endpoint_concentration__score >= 80)
    AND temporal_burst__score >= 50 THEN 'Flood-like' END,
  CASE WHEN dst_port_entropy__score >= 80 AND max_out_degree_ratio__score >= 50 AND coalesce(low_reciprocity__score, 0) >= 70
      AND edge_reuse_ratio__score <= 55 THEN 'Scan-like' END,
  CASE WHEN dst_port_top1_concentration__score >= 80 AND (top1_endpoint_edge_share__score >= 60
      OR endpoint_edge_entropy__score <= 35) THEN 'Single-service-like' END,
  CASE WHEN endpoint_edge_entropy__score >= 60 AND top1_endpoint_edge_share__score <= 30 AND coalesce(low_reciprocity__score, 0) <= 60
      AND temporal_burst__score <= 50 AND temporal_global_spread__score >= 35 THEN 'Benign-like' END)"""
_RULE_SQL = "concat_ws('|', " + ", ".join(f"CASE WHEN {_rule_sql(n, sup)} THEN '{k}' END" for k, _, n, sup in Q.RULES) + ")"


def qualification_report(s, d):
    """The 22 metrics with scores, the hints and the rules of every learner."""
    return Q.qualify(flows(s, d))


register("qr_qualification_report", qualification_report, _QUAL + f" SELECT *, {_HINT_SQL} AS hints, {_RULE_SQL} AS rules FROM qw")
register("qa1_strength_bands", lambda s, d: Q.long_metrics(Q.metrics(flows(s,
    d))).groupBy(Q.strength(F.col("score")).alias("band")).agg(_n().alias("n")), _QUAL + ", l AS (SELECT unnest([" +
        ", ".join(f"{m}__score" for m in Q.METRICS) + "]) AS score FROM qw) SELECT CASE WHEN score < 20 THEN 'very_low' WHEN score < 40 THEN 'low' "
            "WHEN score < 60 THEN 'medium' WHEN score < 80 THEN 'high' ELSE 'very_high' END AS band, count(*) AS n FROM l WHERE score IS NOT NULL GROUP BY 1")

# overlap and routing

_ACC = ", acc AS (SELECT * FROM losses WHERE loss <= threshold)"
_JAC = _ACC + """, an AS (SELECT learner, count(*) AS n FROM acc GROUP BY 1), pb AS (SELECT a.learner AS learner_a, b.learner AS learner_b,
    count(*) AS n FROM acc a JOIN acc b ON a.row_index = b.row_index AND a.learner < b.learner GROUP BY ALL),
  jc AS (SELECT a.learner AS learner_a, b.learner AS learner_b, a.n AS count_a, b.n AS count_b, coalesce(p.n, 0) AS both FROM an a JOIN an b
      ON a.learner < b.learner LEFT JOIN pb p ON p.learner_a = a.learner AND p.learner_b = b.learner),
  jx AS (SELECT learner_a, learner_b, count_a, count_b, "both", count_a + count_b - "both" AS either, CASE
      WHEN count_a + count_b - "both" > 0 THEN "both" / (count_a + count_b - "both") ELSE 0 END AS jaccard FROM jc)""".replace("AS both", 'AS "both"')
register("ml5_routing", lambda s, d: O.route(losses(s, d)).groupBy("assigned_learner").agg(_n().alias("n"), F.sum("n_accepted").alias("accepted")),
    X + _ACC + ", w AS (SELECT row_index, learner, row_number() OVER (PARTITION BY row_index ORDER BY is_benign, loss, learner) AS r, count(*) OVER "
        "(PARTITION BY row_index) AS k FROM acc), a AS (SELECT v.vec_id, coalesce(w.learner, 'UNKNOWN') AS assigned_learner, coalesce(k, 0) AS k FROM "
            "embeddings v LEFT JOIN w ON w.row_index = v.vec_id AND r = 1) SELECT assigned_learner, count(*) AS n, CAST(sum(k) AS BIGINT) AS accepted "
                "FROM a GROUP BY 1")
register("ag35_acceptance_counts", lambda s, d: O.accepted(losses(s, d), 0.8).groupBy("learner").agg(_n().alias("n")), X + "SELECT learner, count(*) "
    "AS n FROM losses WHERE loss <= threshold * CASE WHEN is_benign THEN 0.8 ELSE 1 END GROUP BY 1")
register("ag36_jaccard", lambda s, d: rounded(O.jaccard(O.accepted(losses(s, d)))), X + _JAC + ' SELECT learner_a, learner_b, count_a, count_b, '
    '"both", either, round(jaccard, 6) AS jaccard, round("both"/count_a, 6) AS a_to_b, round("both"/count_b, 6) AS b_to_a FROM jx')
register("ag37_overlap_risk", lambda s, d: rounded(O.overlap_risk(O.jaccard(O.accepted(losses(s, d))))), X + _JAC + ", b AS (SELECT learner_a AS "
    "learner, learner_b AS other, jaccard FROM jx WHERE jaccard > 0 UNION ALL SELECT learner_b, learner_a, jaccard FROM jx WHERE jaccard > 0), r AS "
        "(SELECT *, row_number() OVER (PARTITION BY learner ORDER BY jaccard DESC, other) AS r FROM b) SELECT learner, round(0.7 * avg(jaccard) "
            "FILTER (r <= 3) + 0.3 * avg((jaccard >= 0.1)::INT), 6) AS overlap_risk FROM r GROUP BY 1")
register("ag38_label_similarity", lambda s, d: rounded(O.label_similarity(flows(s, d).groupBy("learner", "label").agg(_n().alias("n")))), W + """,
    c AS (SELECT learner, label, count(*) AS n FROM base GROUP BY ALL), g AS (SELECT learner, label, coalesce(n, 0) / sum(coalesce(n,
        0)) OVER (PARTITION BY learner) AS p FROM (SELECT DISTINCT learner FROM c) CROSS JOIN (SELECT DISTINCT label FROM c) LEFT
            JOIN c USING (learner, label)),
  q AS (SELECT a.learner AS learner_a, b.learner AS learner_b, a.p AS p0, b.p AS q0, greatest(a.p, 1e-12) AS p, greatest(b.p, 1e-12) AS q FROM g a
      JOIN g b ON a.label = b.label AND a.learner < b.learner)
  SELECT learner_a, learner_b, round(1 - (0.5*sum(p*ln(p/((p+q)/2))) + 0.5*sum(q*ln(q/((p+q)/2)))), 6) AS js_similarity,
      round(sum(p0*q0)/sqrt(sum(p0*p0)*sum(q0*q0)), 6) AS cosine, round(sum(least(p0, q0)), 6) AS shared FROM q GROUP BY ALL""")
register("wn9_handoffs", lambda s, d: rounded(O.handoffs(indexed_flows(s, d), block=1000)), W + ", l AS (SELECT learner, lag(learner) OVER (ORDER BY "
    "row_index) AS prev FROM base), t AS (SELECT learner, count(*) AS n FROM base GROUP BY 1), h AS (SELECT least(prev, learner) AS learner_a, "
        "greatest(prev, learner) AS learner_b, count(*) AS handoffs FROM l WHERE prev <> learner GROUP BY ALL) SELECT learner_a, learner_b, handoffs, "
            "round(handoffs / least(a.n, b.n), 6) AS rate FROM h JOIN t a ON a.learner = learner_a JOIN t b ON b.learner = learner_b")
register("wn18_mutual_top", lambda s, d: rounded(O.mutual_top(O.jaccard(O.accepted(losses(s, d))), 3)), X + _JAC + ", b AS (SELECT learner_a AS x, "
    "learner_b AS y, jaccard AS s FROM jx UNION ALL SELECT learner_b, learner_a, jaccard FROM jx), k AS (SELECT x, y, s FROM (SELECT *, row_number() "
        "OVER (PARTITION BY x ORDER BY s DESC, y) AS r FROM b) WHERE r <= 3) SELECT a.x AS learner_a, a.y AS learner_b, round(a.s, 6) AS jaccard FROM "
            "k a JOIN k b ON a.x = b.y AND a.y = b.x WHERE a.x < a.y")
_ASSIGNED = ", asg AS (SELECT v.vec_id AS row_index, coalesce(w.learner, 'UNKNOWN') AS learner FROM embeddings v LEFT JOIN (SELECT row_index, learner, row_number() OVER (PARTITION BY row_index ORDER BY is_benign, loss, learner) AS r FROM losses WHERE loss <= threshold) w ON w.row_index = v.vec_id AND w.r = 1)"
register("ml13_route_confidence", lambda s, d: rounded(O.confidence_by_learner(O.route_confidence(losses(s, d), O.route(losses(s, d)))), 5), X +
    _ASSIGNED + """, mg AS (SELECT row_index, learner, (threshold - loss) / (abs(threshold) + 1e-12) AS m FROM losses), own AS (SELECT a.row_index,
        a.learner, o.m AS own_margin, o.m - (SELECT max(m) FROM mg WHERE mg.row_index = a.row_index AND mg.learner <> a.learner) AS gap FROM asg a
            LEFT JOIN mg o ON o.row_index = a.row_index AND o.learner = a.learner)
  SELECT learner, count(*) AS n, CAST(sum(CASE WHEN gap IS NULL OR (own_margin >= 0.02 AND gap >= 0.03) THEN 1 ELSE 0 END) AS BIGINT) AS kept,
      round(avg(CASE WHEN gap IS NOT NULL THEN (own_margin >= 0.02 AND gap >= 0.03)::INT END), 5) AS confident_ratio, round(quantile_cont(own_margin,
          0.1), 5) AS own_margin_p10, round(quantile_cont(gap, 0.1), 5) AS gap_p10 FROM own GROUP BY 1""")


def learner_risks(s, d):
    """The rows of the vector table routed to its one-class learners; windows of 50 rows."""
    table_ = keep(losses(s, d), "losses")
    assigned = keep(O.route(table_), "assigned")
    stable = A.stability(assigned.withColumnRenamed("assigned_learner", "learner"), "learner", "row_index", 50)
    risks = V.learner_risk(table_, assigned, O.overlap_risk(O.jaccard(keep(O.accepted(table_).select("row_index", "learner"), "accepted"))), stable)
    return rounded(risks.withColumn("own_loss_median", F.round("own_loss_median", 7)), 5, keep=("own_loss_median",))  # the mean of two losses of 6 places


_BAND = lambda c: f"CASE WHEN {c} >= 0.75 THEN 'HIGH' WHEN {c} >= 0.45 THEN 'MEDIUM' ELSE 'LOW' END"
_RISK = X + _JAC + _ASSIGNED + stability_sql("asg", 50) + """, oj AS (SELECT learner_a AS learner, jaccard FROM jx WHERE "both" > 0
    UNION ALL SELECT learner_b, jaccard FROM jx WHERE "both" > 0), orr AS (SELECT *,
        row_number() OVER (PARTITION BY learner ORDER BY jaccard DESC) AS r FROM oj), ov AS (SELECT learner,
            0.7 * avg(jaccard) FILTER (r <= 3) + 0.3 * avg((jaccard >= 0.1)::INT) AS overlap FROM orr GROUP BY 1),
  ow AS (SELECT a.learner, max(threshold) AS own_threshold, avg(loss) AS own_loss_mean, avg((loss > threshold)::INT) AS own_exceed_rate,
      quantile_cont(loss, 0.5) AS p50, quantile_cont(loss, 0.9) AS p90, quantile_cont(loss, 0.95) AS p95, quantile_cont(loss, 0.99) AS p99 FROM asg a
          JOIN losses l ON l.row_index = a.row_index AND l.learner = a.learner GROUP BY 1),
  bm AS (SELECT row_index, max((threshold - loss) / (abs(threshold) + 1e-12)) AS m, bool_or(loss <= threshold) AS taken,
      max(1 / (1 + exp(-4 * (threshold - loss) / (abs(threshold) + 1e-12)))) AS prob FROM losses WHERE is_benign GROUP BY 1),
  bn AS (SELECT learner, avg(taken::INT) AS benign_accept_rate, avg(prob) AS benign_prob_mean, quantile_cont(prob, 0.1) AS benign_prob_p10,
      quantile_cont(m, 0.5) AS benign_margin_median, quantile_cont(m, 0.1) AS benign_margin_p10 FROM asg JOIN bm USING (row_index) GROUP BY 1),
  sz AS (SELECT learner, count(*) AS n, count(*) / (SELECT count(*) FROM asg) AS assignment_share FROM asg GROUP BY 1),
  r1 AS (SELECT *, p50 AS own_loss_median, p95 AS own_loss_p95, (p99 - p90) / (abs(p90 - p50) + 1e-12) AS tail_heaviness, coalesce(own_exceed_rate,
      1) AS ex, 1 / (1 + exp(4 * benign_margin_median)) AS mr, 1 - exp(-n / 5000) AS size_confidence, coalesce(overlap, 0) AS risk_overlap_v3,
          coalesce(stability, 0) AS risk_stability_v3 FROM sz LEFT JOIN ow USING (learner) LEFT JOIN bn USING (learner) LEFT JOIN ov USING (learner)
              LEFT JOIN stable USING (learner)),
  r2 AS (SELECT *, 0.55 * (1 - benign_accept_rate) + 0.30 * ex + 0.15 * mr AS risk_score,
      0.70 * (1 - benign_prob_mean) + 0.20 * ex + 0.10 * mr AS risk_score_v2,
          0.65 * (1 - benign_prob_mean) + 0.35 * (1 - benign_prob_p10) AS risk_benign_v3,
              0.60 * ex + 0.40 * coalesce(1 / (1 + exp(-1.5 * (tail_heaviness - 2.0))), 0.5) AS risk_self_v3, 1 - size_confidence AS risk_size_v3 FROM r1),
  r3 AS (SELECT *,
      0.35 * risk_benign_v3 + 0.25 * risk_self_v3 + 0.20 * risk_overlap_v3 + 0.15 * risk_stability_v3 + 0.05 * risk_size_v3 AS risk_score_v3_raw
          FROM r2), r4 AS (SELECT *, 0.5 + size_confidence * (risk_score_v3_raw - 0.5) AS risk_score_v3 FROM r3)"""
_RISK_COLS = "assignment_share own_threshold own_loss_mean own_loss_median own_loss_p95 own_exceed_rate benign_accept_rate benign_prob_mean benign_prob_p10 benign_margin_median benign_margin_p10 risk_score risk_score_v2 risk_benign_v3 risk_self_v3 risk_overlap_v3 risk_stability_v3 risk_size_v3 tail_heaviness size_confidence risk_score_v3_raw risk_score_v3".split()
register("ml20_learner_risk", learner_risks, _RISK + " SELECT learner, n, " + ", ".join(f"round({c}, {7 if c == 'own_loss_median' else 5}) "
    f"AS {c}" for c in _RISK_COLS) +
        f""", {_BAND("risk_score")} AS risk_band, {_BAND("risk_score_v2")} AS risk_band_v2, {_BAND("risk_score_v3")} AS risk_band_v3,
  CASE WHEN risk_score_v3 >= (SELECT quantile_cont(risk_score_v3, 0.8) FROM r4) THEN 'HIGH' WHEN risk_score_v3 >= (SELECT quantile_cont(risk_score_v3,
      0.5) FROM r4) THEN 'MEDIUM' ELSE 'LOW' END AS risk_band_v3_quantile FROM r4""")

# joins, sets, order

register("jn3_profile_star", lambda s, d: rounded(A.group_profile(flows(s, d), "learner").select("learner", "total").join(A.port_stats(flows(s,
    d).where("dst_port > 1000"), "learner").select("learner", "ports"), "learner", "left").na.fill(0, ["ports"])), W + "SELECT learner, count(*) AS "
        "total, count(DISTINCT CASE WHEN dst_port > 1000 THEN dst_port END) AS ports FROM base GROUP BY 1")
register("jn5_pair_membership", lambda s, d: flows(s, d).join(_hosts(s, d).groupBy("src", "dst").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(),
    "src", "dst").limit(5).select(F.col("src").alias("src_ip"), F.col("dst").alias("dst_ip")), ["src_ip", "dst_ip"],
        "left_semi").groupBy("label").agg(_n().alias("n")), W + ", t AS (SELECT src_ip, dst_ip FROM base GROUP BY ALL ORDER BY count(*) DESC, src_ip, "
            "dst_ip LIMIT 5) SELECT label, count(*) AS n FROM base SEMI JOIN t USING (src_ip, dst_ip) GROUP BY 1")
register("jn7_skipped", lambda s, d: table(s, d, "customer").join(table(s, d, "orders").where("o_orderpriority = "
    "'1-URGENT'").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left_anti").select("c_custkey"), "SELECT c_custkey FROM customer WHERE "
        "c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
register("jn10_reverse_edges", lambda s, d: T.with_reverse(_pairs(s, d), []).where("back > 0"), "WITH p AS (SELECT l_suppkey % 40 AS src, l_partkey % "
    "40 AS dst, count(*) AS n FROM lineitem GROUP BY ALL) SELECT a.src, a.dst, a.n, b.n AS back FROM p a JOIN p b ON a.src = b.dst AND a.dst = b.src")


def _pairs(s, d):
    return table(s, d, "lineitem").groupBy((F.col("l_suppkey") % 40).alias("src"), (F.col("l_partkey") % 40).alias("dst")).agg(_n().alias("n"))


register("gr11_reciprocity", lambda s, d: rounded(T.graph_stats(_pairs(s, d).withColumn("g", F.lit("all")), ["g"]).select("g", "reciprocity",
    "weighted_reciprocity")), "WITH p AS (SELECT l_suppkey % 40 AS src, l_partkey % 40 AS dst, count(*) AS n FROM lineitem GROUP BY ALL), r AS "
        "(SELECT a.*, coalesce(b.n, 0) AS back FROM p a LEFT JOIN p b ON a.src = b.dst AND a.dst = b.src) SELECT 'all' AS g, round(sum((back > 0 AND "
            "src <> dst)::INT) / count(*), 6) AS reciprocity, round(sum(CASE WHEN back > 0 THEN least(n, back) ELSE 0 END) / sum(CASE WHEN back > 0 "
                "THEN n ELSE 0 END), 6) AS weighted_reciprocity FROM r")
register("jn14_reconcile", lambda s, d: rounded(_reconcile(s, d)), W + ", a AS (SELECT learner, count(*) AS x FROM base WHERE row_index % 2 = 0 AND "
    "learner <> 'NEW_1' GROUP BY 1), b AS (SELECT learner, count(*) AS y FROM base WHERE row_index % 3 = 0 AND learner <> 'NEW_2' GROUP BY 1) SELECT "
        "learner, coalesce(x, 0) AS x, coalesce(y, 0) AS y, coalesce(x, 0) - coalesce(y, 0) AS diff FROM a FULL JOIN b USING (learner)")


def _reconcile(s, d):
    f = indexed_flows(s, d).select("learner", "row_index")
    a = f.where("row_index % 2 = 0 and learner <> 'NEW_1'").groupBy("learner").agg(_n().alias("x"))
    b = f.where("row_index % 3 = 0 and learner <> 'NEW_2'").groupBy("learner").agg(_n().alias("y"))
    return a.join(b, "learner", "full").na.fill(0, ["x", "y"]).withColumn("diff", F.col("x") - F.col("y"))


register("jn15_owner_precedence", lambda s, d: _owners(s, d).groupBy("owner").agg(_n().alias("n")), W + ", a AS (SELECT row_index, learner FROM base "
    "WHERE row_index % 4 <> 0), b AS (SELECT row_index, concat('C_', l_linenumber) AS learner FROM base WHERE row_index % 3 = 0) SELECT "
        "coalesce(nullif(a.learner, 'UNKNOWN'), b.learner, a.learner) AS owner, count(*) AS n FROM a FULL JOIN b USING (row_index) GROUP BY 1")


def _owners(s, d):
    f = indexed_flows(s, d).select("row_index", "learner", "l_linenumber")
    a, b = f.where("row_index % 4 <> 0").select("row_index", "learner"), f.where("row_index % 3 = 0").select("row_index", F.concat(F.lit("C_"),
        "l_linenumber").alias("made"))
    return a.join(b, "row_index", "full").select(F.coalesce(F.nullif("learner", F.lit("UNKNOWN")), "made", "learner").alias("owner"))


register("jn19_quota_claims", lambda s, d: _claims(s, d).groupBy("claimer", "label").agg(_n().alias("n"),
    F.min("row_index").cast("long").alias("first")), W + """, u AS (SELECT row_index, label,
        row_number() OVER (PARTITION BY label ORDER BY row_index) AS r FROM base WHERE learner = 'UNKNOWN'), q AS (SELECT learner, label,
            CAST(ceil(count(*) / 20) AS BIGINT) AS quota FROM base WHERE learner <> 'UNKNOWN' GROUP BY ALL),
  o AS (SELECT learner, min(row_index) AS born FROM base WHERE learner <> 'UNKNOWN' GROUP BY 1), c AS (SELECT q.*,
      sum(quota) OVER (PARTITION BY label ORDER BY born) AS hi FROM q JOIN o USING (learner))
  SELECT c.learner AS claimer, u.label, count(*) AS n, min(row_index) AS first FROM u JOIN c ON u.label = c.label AND u.r > hi - quota AND u.r <= hi
      GROUP BY ALL""".replace("AS first", 'AS "first"'))


def _claims(s, d):
    """Learners in the order of their first flow claim UNKNOWN flows of each label up to a twentieth of their own."""
    f = indexed_flows(s, d)
    created = f.where("learner <> 'UNKNOWN'").groupBy("learner", "label").agg(F.ceil(_n() / 20).alias("need"), F.min("row_index").alias("born"))
    return K.claim_rows(f.where("learner = 'UNKNOWN'"), K.births_of(created))


register("st4_set_operations", lambda s, d: _sets(s, d), "WITH a AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 9000), b AS "
    "(SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000) SELECT 'both' AS what, k FROM (SELECT k FROM a INTERSECT SELECT k FROM "
        "b) UNION ALL SELECT 'first', k FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'either', k FROM (SELECT k FROM a UNION SELECT "
            "k FROM b)")


def _sets(s, d):
    a = table(s, d, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")).distinct()
    b = table(s, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k")).distinct()
    named = lambda df, name: df.select(F.lit(name).alias("what"), "k")
    return named(a.intersect(b), "both").unionByName(named(a.exceptAll(b), "first")).unionByName(named(a.union(b).distinct(), "either"))


register("tk2_top_labels", lambda s, d: flows(s, d).groupBy("label").agg(_n().alias("n")).where("n >= 100").orderBy(F.col("n").desc(),
    "label").limit(5), W + "SELECT label, count(*) AS n FROM base GROUP BY 1 HAVING count(*) >= 100 ORDER BY 2 DESC, 1 LIMIT 5")
register("tk5_learner_order", lambda s, d: _ordered(s, d), W + ", l AS (SELECT DISTINCT learner FROM base UNION ALL SELECT 'BENIGN' UNION ALL SELECT "
    "'NEW_10' UNION ALL SELECT 'zeta') SELECT learner, row_number() OVER (ORDER BY CASE WHEN learner LIKE '%BENIGN%' THEN 0 WHEN "
        "regexp_matches(learner, '^NEW_[0-9]+$') THEN 1 WHEN learner = 'UNKNOWN' THEN 3 ELSE 2 END, try_cast(substr(learner, 5) AS BIGINT) NULLS "
            "FIRST, learner) AS place FROM l")


def _ordered(s, d):
    names = flows(s, d).select("learner").distinct().unionByName(s.createDataFrame([("BENIGN",), ("NEW_10",), ("zeta",)], "learner string"))
    kind = F.when(F.contains("learner", F.lit("BENIGN")), 0).when(F.col("learner").rlike(r"^NEW_\d+$"), 1).when(F.col("learner") == "UNKNOWN", 3).otherwise(2)
    number = F.substring("learner", 5, 100).try_cast("bigint")
    w = Window.orderBy(kind, number.asc_nulls_first(), "learner")  # a row for each learner
    return names.select("learner", F.row_number().over(w).cast("long").alias("place"))
