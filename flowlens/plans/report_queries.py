"""Queries behind reports and the viewer: components of learners, picks along an order, rollups, rankings, quality tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from flowlens.functions.labels import base_label, is_benign, label_year
from flowlens.operators import overlap as O
from flowlens.operators import topology as T
from flowlens.operators import evaluation as V
from flowlens.operators.aggregates import group_profile, port_stats, protocol_mix, temporal_stats
from flowlens.sources.testdata import FLOWS_SQL, LOSSES_SQL, events, flows, indexed_flows, losses, table

from .aggregate_queries import PORT_SQL, PROFILE_SQL, TEMPORAL_SQL, benign_flows, rounded
from .graph_queries import _JAC
from .registry import register

W, X = f"WITH {FLOWS_SQL} ", f"WITH {LOSSES_SQL} "


def _n():
    """Rows, as an aggregate; made when it is used, as columns need a session."""
    return F.count(F.lit(1))


def _pairs(s, d):
    return O.jaccard(O.accepted(losses(s, d)))


def _groups(s, d, least=0.44):
    """Learners joined by overlaps of at least `least`; a learner without one is its own group."""
    pairs = _pairs(s, d)
    alone = pairs.select(F.explode(F.array("learner_a", "learner_b")).alias("x")).distinct()
    edge = pairs.where(F.col("jaccard") >= least).select("learner_a", "learner_b").unionAll(alone.select("x", "x"))
    return T.components(edge.select(F.lit("all").alias("g"), F.col("learner_a").alias("src"), F.col("learner_b").alias("dst")),
        "g").select(F.col("node").alias("learner"), F.col("component").alias("owner"))


_CC = X.replace("WITH ", "WITH RECURSIVE ", 1) + _JAC + """, ed AS (SELECT learner_a AS x, learner_b AS y FROM jx
    WHERE jaccard >= 0.44 UNION SELECT learner_b, learner_a FROM jx WHERE jaccard >= 0.44),
  rc(x, y) AS (SELECT DISTINCT learner, learner FROM losses UNION SELECT rc.x, ed.y FROM rc JOIN ed ON rc.y = ed.x), cc AS (SELECT x AS learner,
      min(y) AS owner FROM rc GROUP BY 1)"""
register("gr19_overlap_groups", _groups, _CC + " SELECT learner, owner FROM cc")
register("gr22_group_rollup", lambda s, d: rounded(_rollup(s, d)), _CC + ", n AS (SELECT concat('NEW_', label) AS learner, count(*) AS n FROM "
    "embeddings GROUP BY 1), i AS (SELECT c.owner, avg(jaccard) AS inner_jaccard FROM jx JOIN cc c ON c.learner = learner_a JOIN cc e ON e.learner = "
        "learner_b AND e.owner = c.owner GROUP BY 1), g AS (SELECT owner, count(*) AS learners, CAST(sum(n) AS BIGINT) AS total FROM cc JOIN n USING "
            "(learner) GROUP BY 1) SELECT owner, learners, total, round(coalesce(inner_jaccard, 0), 6) AS inner_jaccard, concat('AGG_', "
                "lpad((row_number() OVER (ORDER BY total DESC, owner))::VARCHAR, 3, '0')) AS name FROM g LEFT JOIN i USING (owner)")


def _rollup(s, d):
    groups = _groups(s, d)
    n = table(s, d, "embeddings").groupBy(F.concat(F.lit("NEW_"), F.col("label").cast("string")).alias("learner")).agg(_n().alias("n"))
    side = lambda c: groups.select(F.col("learner").alias(f"learner_{c}"), F.col("owner").alias(f"owner_{c}"))
    inner = _pairs(s, d).join(side("a"), "learner_a").join(side("b"), "learner_b").where("owner_a = "
        "owner_b").groupBy(F.col("owner_a").alias("owner")).agg(F.avg("jaccard").alias("inner_jaccard"))
    g = groups.join(n, "learner").groupBy("owner").agg(_n().alias("learners"), F.sum("n").alias("total")).join(inner, "owner", "left").na.fill(0.0,
        ["inner_jaccard"])
    place = F.row_number().over(Window.orderBy(F.col("total").desc(), "owner"))  # a row for each group
    return g.withColumn("name", F.concat(F.lit("AGG_"), F.lpad(place.cast("string"), 3, "0")))


register("wn10_time_bins", lambda s, d: rounded(_bins(s, d)), "WITH e AS (SELECT *, min(ts) OVER () AS a, max(ts) OVER () AS b FROM events) SELECT "
    "CAST(least(99, floor((epoch_us(ts) - epoch_us(a)) * 100 / (epoch_us(b) - epoch_us(a)))) AS BIGINT) AS bin, count(*) AS n FROM e GROUP BY 1")


def _bins(s, d):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = events(s, d)
    ends = e.agg(F.min(us).alias("a"), F.max(us).alias("b"))
    return e.join(F.broadcast(ends), how="cross").groupBy(F.least(F.lit(99),
        F.floor((us - F.col("a")) * 100 / (F.col("b") - F.col("a")))).alias("bin")).agg(_n().alias("n"))


_PICKS = 7
register("wn14_even_picks", lambda s, d: rounded(_picks(s, d)), f"WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type "
    f"ORDER BY value, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events), p AS (SELECT DISTINCT event_type, CAST(floor(k * "
        f"(n - 1) / {_PICKS - 1}) AS BIGINT) AS i FROM r, (SELECT unnest(range({_PICKS})) AS k)) SELECT event_type, event_id FROM r JOIN p USING "
            f"(event_type, i)")


def _picks(s, d):
    """Rows evenly spread along the order of value: positions int(linspace(0, n - 1, k))."""
    w = Window.partitionBy("event_type")
    r = table(s, d, "events").select("event_type", "event_id", (F.row_number().over(w.orderBy("value", "event_id")) - 1).alias("i"), _n().over(w).alias("n"))
    return r.where(F.exists(F.sequence(F.lit(0), F.lit(_PICKS - 1)),
        lambda k: F.floor(k * (F.col("n") - 1) / (_PICKS - 1)) == F.col("i"))).select("event_type", "event_id")


register("wn16_ecdf", lambda s, d: rounded(table(s, d, "supplier").select("s_suppkey",
    (F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_acctbal",
        "s_suppkey")) / _n().over(Window.partitionBy("s_nationkey"))).alias("p"))), "SELECT s_suppkey, round(row_number() OVER (PARTITION BY "
            "s_nationkey ORDER BY s_acctbal, s_suppkey) / count(*) OVER (PARTITION BY s_nationkey), 6) AS p FROM supplier")
register("wn17_keep_last", lambda s, d: indexed_flows(s, d).withColumn("r",
    F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.col("row_index").desc()))).where("r = 1").groupBy("label").agg(_n().alias("n"),
        F.sum("row_index").cast("long").alias("rows")), W + "SELECT label, count(*) AS n, CAST(sum(row_index) AS BIGINT) AS rows FROM (SELECT *, "
            "row_number() OVER (PARTITION BY l_orderkey ORDER BY row_index DESC) AS r FROM base) WHERE r = 1 GROUP BY 1")
register("wn19_strongest", lambda s, d: _strongest(s, d), X + _JAC + ", b AS (SELECT learner_a AS x, learner_b AS y, jaccard AS s FROM jx UNION ALL "
    "SELECT learner_b, learner_a, jaccard FROM jx) SELECT x AS learner, y AS strongest FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY s "
        "DESC, y) AS r FROM b) WHERE r = 1")


def _strongest(s, d):
    p = _pairs(s, d).select(F.explode(F.array(F.struct(F.col("learner_a").alias("x"), F.col("learner_b").alias("y"), "jaccard"),
        F.struct(F.col("learner_b").alias("x"), F.col("learner_a").alias("y"), "jaccard"))).alias("p")).select("p.*")
    return p.withColumn("r", F.row_number().over(Window.partitionBy("x").orderBy(F.col("jaccard").desc(), "y"))).where("r = "
        "1").select(F.col("x").alias("learner"), F.col("y").alias("strongest"))


register("wn20_recent_sample", lambda s, d: events(s, d).withColumn("u", (F.conv(F.substring(F.md5(F.concat(F.lit("5|"),
    F.col("row_index").cast("string"))), 1, 12), 16, 10).cast("double") + 1) / (2.0**48 + 1)).withColumn("key",
        F.ln(-F.ln("u")) - F.col("row_index") / 300.0).orderBy("key", "row_index").limit(50).select("row_index"),
         "SELECT event_id AS row_index FROM events ORDER BY ln(-ln((concat('0x', substr(md5(concat('5|', event_id)), 1, 12))::BIGINT + 1) / "
             "(281474976710656.0::DOUBLE + 1))) - event_id / 300.0::DOUBLE, event_id LIMIT 50")
register("wn21_loss_thirds", lambda s, d: rounded(_thirds(s, d)), "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type "
    "ORDER BY value, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, CASE WHEN i < n // 3 THEN 'low' "
        "WHEN i < 2 * n // 3 THEN 'mid' ELSE 'high' END AS third, count(*) AS n, round(avg(value), 6) AS mean FROM r GROUP BY 1, 2")


def _thirds(s, d):
    w = Window.partitionBy("event_type")
    r = table(s, d, "events").select("event_type", "value", (F.row_number().over(w.orderBy("value", "event_id")) - 1).alias("i"), _n().over(w).alias("n"))
    third = F.when(F.col("i") < F.floor(F.col("n") / 3), "low").when(F.col("i") < F.floor(2 * F.col("n") / 3), "mid").otherwise("high")
    return r.groupBy("event_type", third.alias("third")).agg(_n().alias("n"), F.avg("value").alias("mean"))


register("wn23_cooldown_gaps", lambda s, d: rounded(_gaps(s, d)), W + ", t AS (SELECT DISTINCT learner, CAST(floor(row_index / 1000) AS BIGINT) AS w "
    "FROM base WHERE bwd >= 40), g AS (SELECT learner, w, w - lag(w) OVER (PARTITION BY learner ORDER BY w) AS gap FROM t) SELECT learner, count(*) "
        "AS windows, CAST(max(coalesce(gap, 0)) AS BIGINT) AS longest_gap, CAST(sum((gap > 1)::INT) AS BIGINT) AS after_cooldown FROM g GROUP BY 1")


def _gaps(s, d):
    t = indexed_flows(s, d).where("bwd >= 40").select("learner", F.floor(F.col("row_index") / 1000).alias("w")).distinct()
    g = t.withColumn("gap", F.col("w") - F.lag("w").over(Window.partitionBy("learner").orderBy("w")))
    return g.groupBy("learner").agg(_n().alias("windows"), F.max(F.coalesce("gap", F.lit(0))).alias("longest_gap"),
        F.sum((F.col("gap") > 1).cast("long")).alias("after_cooldown"))


register("ag10_protocol_clusters", lambda s, d: rounded(_clusters(s, d)), W + """, m AS (SELECT learner, count(*) AS n,
    avg((protocol = 6)::INT) AS tcp, avg((protocol = 17)::INT) AS udp FROM base GROUP BY learner), k AS (SELECT n, CASE
        WHEN tcp >= 0.8 THEN 'TCP_CLUSTER' WHEN udp >= 0.8 THEN 'UDP_CLUSTER' WHEN round(1 - tcp - udp, 12) >= 0.6 THEN 'OTHER_CLUSTER'
            ELSE 'MIXED_CLUSTER' END AS kind FROM m)
  SELECT kind, round(count(*) / (SELECT count(*) FROM k), 6) AS learner_ratio, round(sum(n) / (SELECT sum(n) FROM k), 6) AS sample_ratio FROM k GROUP BY 1""")


def _clusters(s, d):
    k = protocol_mix(flows(s, d), "learner").groupBy("kind").agg(_n().alias("c"), F.sum("n").alias("n"))
    every = Window.partitionBy()  # four kinds at most
    return k.select("kind", (F.col("c") / F.sum("c").over(every)).alias("learner_ratio"), (F.col("n") / F.sum("n").over(every)).alias("sample_ratio"))


register("ag14_benign_confusion", lambda s, d: rounded(_benign(s, d)), W + ", c AS (SELECT sum((benign = 1 AND bwd > 20)::INT) AS tp, sum((benign = 0 "
    "AND bwd > 20)::INT) AS fp, sum((benign = 0 AND bwd <= 20)::INT) AS tn, sum((benign = 1 AND bwd <= 20)::INT) AS fn FROM base) SELECT "
        "round(tp/(tp+fp), 6) AS \"precision\", round(tp/(tp+fn), 6) AS recall, round(tn/(tn+fp), 6) AS specificity, round(2*tp/(2*tp+fp+fn), 6) AS f1 FROM c")


def _benign(s, d):
    n = lambda b, far: F.sum(((F.col("benign") == b) & ((F.col("bwd") > 20) == far)).cast("long"))
    c = benign_flows(s, d).agg(n(1, True).alias("tp"), n(0, True).alias("fp"), n(0, False).alias("tn"), n(1, False).alias("fn"))
    r = lambda a, b: F.when(a + b > 0, a / (a + b)).otherwise(0.0)
    return c.select(r(F.col("tp"), F.col("fp")).alias("precision"), r(F.col("tp"), F.col("fn")).alias("recall"), r(F.col("tn"),
        F.col("fp")).alias("specificity"), r(2 * F.col("tp"), F.col("fp") + F.col("fn")).alias("f1"))


register("ag21_missing_top", lambda s, d: flows(s, d).select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.when(F.col(c) == v,
    None).otherwise(F.col(c).cast("double")).alias("x")) for c, v in (("bwd", 0.0), ("l_discount", 0.05), ("l_tax",
        0.0))])).alias("p")).groupBy("p.feature").agg(F.sum(F.col("p.x").isNull().cast("long")).alias("missing")).orderBy(F.col("missing").desc(),
            "feature").limit(2), W + "SELECT feature, CAST(missing AS BIGINT) AS missing FROM (SELECT 'bwd' AS feature, sum((bwd = 0)::INT) AS "
                "missing FROM base UNION ALL SELECT 'l_discount', sum((l_discount = 0.05)::INT) FROM base UNION ALL SELECT 'l_tax', sum((l_tax = "
                    "0)::INT) FROM base) ORDER BY 2 DESC, 1 LIMIT 2")
register("ag39_shared_labels", lambda s, d: rounded(O.label_similarity(table(s, d,
    "events").groupBy((F.col("user_id") % 4).cast("string").alias("learner"),
        F.col("event_type").alias("label")).agg(_n().alias("n"))).select("learner_a", "learner_b", "shared")), "WITH c AS (SELECT (user_id % "
            "4)::VARCHAR AS learner, event_type AS label, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY "
                "learner) AS p FROM c) SELECT a.learner AS learner_a, b.learner AS learner_b, round(sum(least(a.p, b.p)), 6) AS shared FROM p a JOIN "
                    "p b ON a.label = b.label AND a.learner < b.learner GROUP BY ALL")
register("ag45_footer_stats", lambda s, d: rounded(table(s, d, "customer").agg(F.sum("c_acctbal").alias("total"), F.avg("c_acctbal").alias("mean"),
    F.max("c_acctbal").alias("high"), F.min("c_acctbal").alias("low"), F.stddev_pop("c_acctbal").alias("std")), 2), "SELECT round(sum(c_acctbal), 2) "
        "AS total, round(avg(c_acctbal), 2) AS mean, round(max(c_acctbal), 2) AS high, round(min(c_acctbal), 2) AS low, round(stddev_pop(c_acctbal), "
            "2) AS std FROM customer")
register("ag48_purity", lambda s, d: rounded(_purity(s, d)), W + ", c AS (SELECT learner, label, count(*) AS n FROM base GROUP BY ALL), p AS (SELECT "
    "learner, max(n) / sum(n) AS r FROM c GROUP BY 1) SELECT count(*) FILTER (r < 0.8) AS impure, round(avg(r), 6) AS mean_dominance FROM p")


def _purity(s, d):
    p = flows(s, d).groupBy("learner", "label").agg(_n().alias("n")).groupBy("learner").agg((F.max("n") / F.sum("n")).alias("r"))
    return p.agg(F.sum((F.col("r") < 0.8).cast("long")).alias("impure"), F.avg("r").alias("mean_dominance"))


register("ag53_dataset_ratios", lambda s, d: rounded(_ratios(s, d)), W + ", c AS (SELECT year_tag, label, max(benign) AS b, count(*) AS n FROM base "
    "GROUP BY ALL) SELECT year_tag AS year, round(max(n) / sum(n), 6) AS top_share, round(sum(n * b) / sum(n), 6) AS benign_share FROM c GROUP BY 1")


def _ratios(s, d):
    c = flows(s, d).groupBy(label_year(F.col("label")).alias("year"), "label").agg(_n().alias("n"))
    return c.groupBy("year").agg((F.max("n") / F.sum("n")).alias("top_share"), (F.sum(F.when(is_benign(F.col("label")),
        F.col("n")).otherwise(0)) / F.sum("n")).alias("benign_share"))


register("ag54_label_detail", lambda s, d: rounded(_detail(s, d)), W + "SELECT learner, label, n FROM (SELECT learner, label, count(*) AS n, "
    "row_number() OVER (PARTITION BY learner ORDER BY count(*) DESC, label) AS r FROM base GROUP BY 1, 2) WHERE r <= 3")


def _detail(s, d):
    """From the JSON text of a profile back to its largest labels."""
    text = flows(s, d).groupBy("learner",
        "label").agg(_n().alias("n")).groupBy("learner").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("label", "n")))).alias("j"))
    rows = text.select("learner", F.explode(F.from_json("j", "map<string,bigint>")).alias("label", "n"))
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("learner").orderBy(F.col("n").desc(), "label"))).where("r <= "
        "3").select("learner", "label", "n")


def _behaviour(s, d):
    """Behaviour rules held against what the labels of a learner say."""
    rows = flows(s, d)
    profile = group_profile(rows, "learner").select("learner", "attack_ratio").join(port_stats(rows, "learner").select("learner", "ports", "entropy",
        "top_share"), "learner").join(temporal_stats(rows, "learner").select("learner", "burst"), "learner")
    return V.rule_table(profile, V.behaviour_rules())


_QB = W + PROFILE_SQL + PORT_SQL + TEMPORAL_SQL + """, b AS (SELECT learner, attack_ratio, burst >= 0.5 AS t, top_share < 0.15 AND ports >= 200 AS sc,
    top_share > 0.9 AND ports <= 3 AS fl, (top_share < 0.15 AND ports >= 200) OR (top_share > 0.9 AND ports <= 3) OR p.entropy > 0.85 AS pt
        FROM profile JOIN ports p USING (learner) JOIN temporal USING (learner)), c AS (
  SELECT learner, attack_ratio, unnest(['temporal_burst_score>=0.5', 'port_scan_like', 'port_single_port', 'port_scan_or_flood_or_high_entropy',
      'temporal_burst OR port_attack']) AS rule, unnest([t, sc, fl, pt, t OR pt]) AS hit FROM b),
  k AS (SELECT rule, sum((hit AND attack_ratio >= 0.5)::INT) AS tp, sum((hit AND attack_ratio < 0.1)::INT) AS fp, sum((NOT hit
      AND attack_ratio >= 0.5)::INT) AS fn, sum((NOT hit AND attack_ratio < 0.1)::INT) AS tn, coalesce(string_agg(CASE WHEN hit
          AND attack_ratio < 0.1 THEN learner END, ',' ORDER BY learner), '') AS false_positives, coalesce(string_agg(CASE WHEN NOT hit
              AND attack_ratio >= 0.5 THEN learner END, ',' ORDER BY learner), '') AS false_negatives FROM c GROUP BY 1)
  SELECT rule, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, false_positives,
      false_negatives, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS "precision", round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn)
          ELSE 0 END, 6) AS recall FROM k"""
register("qb1_behaviour_rules", lambda s, d: rounded(_behaviour(s, d)), _QB)

register("tk7_missing_last", lambda s, d: rounded(_missing_last(s, d)), W + "SELECT place, learner FROM (SELECT learner, row_number() OVER (ORDER BY "
    "CASE WHEN learner = 'UNKNOWN' THEN NULL ELSE sum(benign) END DESC NULLS LAST, count(*) DESC, learner) AS place FROM base GROUP BY learner)")


def _missing_last(s, d):
    n = benign_flows(s, d).groupBy("learner").agg(F.when(F.col("learner") == "UNKNOWN", None).otherwise(F.sum("benign")).alias("b"), _n().alias("n"))
    return n.select(F.row_number().over(Window.orderBy(F.col("b").desc_nulls_last(), F.col("n").desc(), "learner")).alias("place"),
        "learner")  # a row for each learner


register("gr24_topology_by_label", lambda s, d: rounded(T.graph_stats(T.edges(flows(s, d).withColumn("base", base_label(F.col("label"))), ["base"],
    F.col("src_ip"), F.col("dst_ip")), ["base"]).select("base", "nodes", "edges", "density", "edge_per_node")), W + ", e AS (SELECT DISTINCT "
        "base_label AS base, src_ip AS a, dst_ip AS b FROM base), n AS (SELECT base, count(*) AS nodes FROM (SELECT base, a FROM e UNION SELECT base, "
            "b FROM e) GROUP BY 1), m AS (SELECT base, count(*) AS edges FROM e GROUP BY 1) SELECT base, nodes, edges, round(edges / (nodes * (nodes "
                "- 1)), 6) AS density, round(edges / nodes, 6) AS edge_per_node FROM n JOIN m USING (base)")
