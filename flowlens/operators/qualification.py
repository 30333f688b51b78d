"""Qualification of learners: 22 metrics of the flows assigned to each, hints, and reference rules.

All count-based metrics come from one table (learner, kind of key, key, n): every flow is unpivoted into its port, edge,
host and endpoint keys, counted with partial sums in one shuffle, and reduced per learner and kind.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlens.functions.stats import concentration, log_score, normal_entropy, richness

from flowlens.session import keep

from .topology import degrees, endpoint, graph_stats

#: Kinds of keys that are counted.
_KINDS = ("dst_port", "src_port", "endpoint_edge", "host_edge", "dst_host", "src_endpoint", "dst_endpoint")


def key_counts(df: DataFrame, group: str) -> DataFrame:
    """group, kind, key, n for df with src_ip, dst_ip, src_port, dst_port."""
    src, dst = endpoint(F.col("src_ip"), F.col("src_port")), endpoint(F.col("dst_ip"), F.col("dst_port"))
    keys = {
        "dst_port": F.col("dst_port").cast("string"), "src_port": F.col("src_port").cast("string"), "endpoint_edge": F.concat(src, F.lit(" -> "), dst),
        "host_edge": F.concat("src_ip", F.lit(" -> "), "dst_ip"), "dst_host": F.col("dst_ip"), "src_endpoint": src, "dst_endpoint": dst,
    }
    rows = df.select(group, F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), keys[k].alias("key")) for k in _KINDS])).alias("p"))
    return rows.groupBy(group, "p.kind", "p.key").agg(F.count(F.lit(1)).alias("n"))


def temporal_metrics(df: DataFrame, group: str, time: str = "ts", local_bins: int = 100, ends: DataFrame | None = None) -> DataFrame:
    """burst: concentration over bins of the group's own span and how little of the whole span it fills. spread: entropy over
    occupied bins of the whole span. uniformity: entropy over occupied own bins. ends: group, _low, _high if they are known."""
    us = F.unix_micros(F.col(time).cast("timestamp"))
    ends = df.groupBy(group).agg(F.min(us).alias("_low"), F.max(us).alias("_high")) if ends is None else ends
    whole = ends.agg(F.min("_low").alias("_w0"), F.max("_high").alias("_w1"))
    # bins of the whole span: an hour each, 128 to 2048 of them
    bins = F.greatest(F.lit(128), F.least(F.lit(2048), F.floor((F.col("_w1") - F.col("_w0")) / 1e6 / 3600)))
    rows = df.select(group, us.alias("_t")).join(ends, group).join(F.broadcast(whole), how="cross")
    at = lambda low, high, n: F.when(high == low, 0).otherwise(F.least(n - 1, F.floor((F.col("_t") - low) * n / (high - low))))
    rows = rows.select(group, at(F.col("_low"), F.col("_high"), F.lit(local_bins)).cast("long").alias("own"), at(F.col("_w0"), F.col("_w1"),
        bins).cast("long").alias("whole"), (F.col("_high") - F.col("_low")).alias("_span"), (F.col("_w1") - F.col("_w0")).alias("_all"))
    n = rows.select(group, "_span", "_all", F.explode(F.array(F.struct(F.lit("own").alias("kind"), F.col("own").alias("bin")),
        F.struct(F.lit("whole").alias("kind"), F.col("whole").alias("bin")))).alias("p"))
    n = n.groupBy(group, "p.kind", "p.bin", "_span", "_all").agg(F.count(F.lit(1)).alias("n"))
    n = n.withColumn("total", F.sum("n").over(Window.partitionBy(group, "kind")))
    by = n.groupBy(group, "kind").agg(concentration(F.col("n"), F.col("total")).alias("hhi"), normal_entropy(F.col("n"),
        F.col("total")).alias("entropy"), F.max("_span").alias("_span"), F.max("_all").alias("_all"))
    own, all_ = by.where("kind = 'own'"), by.where("kind = 'whole'").select(group, F.col("entropy").alias("temporal_global_spread"))
    fill = F.when(F.col("_all") == 0, 1.0).otherwise(F.least(F.lit(1.0), F.col("_span") / F.col("_all")))
    return own.select(group, (0.5 * F.col("hhi") + 0.5 * (1 - fill)).alias("temporal_burst"),
        F.col("entropy").alias("temporal_intra_uniformity")).join(all_, group)


def metrics(df: DataFrame, group: str = "learner") -> DataFrame:
    """One row per group: flows, then each metric raw (6 decimals) and as a score of 0 to 100 (2 decimals).

    df has src_ip, dst_ip, src_port, dst_port, ts, fwd, bwd. low_reciprocity is null where a group has no packets.
    """
    held = keep(key_counts(df, group), "key-counts")  # edges and degrees come from it as well
    counts = held.withColumn("total", F.sum("n").over(Window.partitionBy(group, "kind")))
    by = counts.groupBy(group, "kind").agg(
        normal_entropy(F.col("n"), F.col("total")).alias("h"), F.max(F.col("n") / F.col("total")).alias("top"), F.count(F.lit(1)).alias("u"),
            F.max("total").alias("flows")
    )
    of = lambda kind, value: F.max(F.when(F.col("kind") == kind, F.col(value)))
    flat = by.groupBy(group).agg(F.max("flows").alias("flows"), *[of(k, v).alias(f"_{k}_{v}") for k in _KINDS for v in ("h", "top", "u")])
    ends = F.split("key", " -> ")
    edge = lambda kind: held.where(F.col("kind") == kind).select(group, ends[0].alias("src"), ends[1].alias("dst"), "n")
    endpoint_edges = edge("endpoint_edge")
    hosts = degrees(edge("host_edge"), [group]).groupBy(group).agg(
        (F.max("in_degree") / F.greatest(F.lit(1), F.count(F.lit(1)) - 1)).alias("host_max_in_degree_ratio"),
            (F.max("out_degree") / F.greatest(F.lit(1), F.count(F.lit(1)) - 1)).alias("host_max_out_degree_ratio")
    )
    points = graph_stats(endpoint_edges, [group]).select(
        group, "leaf_ratio", F.col("nodes").alias("_nodes"), "edge_per_node", F.col("max_in_ratio").alias("max_in_degree_ratio"),
            F.col("max_out_ratio").alias("max_out_degree_ratio")
    )
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    sums = keep(df.groupBy(group).agg(F.sum(F.least("fwd", "bwd")).alias("_min"), F.sum(F.col("fwd") + F.col("bwd")).alias("_sum"),
        F.min(us).alias("_low"), F.max(us).alias("_high")), "sums")
    times = temporal_metrics(df, group, ends=sums.select(group, "_low", "_high"))
    wide = flat.join(hosts, group).join(points, group).join(sums.select(group, "_min", "_sum"), group).join(times, group)
    col = lambda k, v: F.col(f"_{k}_{v}")
    reuse = F.col("flows") / col("endpoint_edge", "u")
    raw: dict[str, tuple[Column, Column | None]] = {
        "dst_port_entropy": (col("dst_port", "h"), None),
        "dst_port_richness": (col("dst_port", "u").cast("double"), richness(col("dst_port", "u"), F.col("flows"), 65536)),
        "src_port_entropy": (col("src_port", "h"), None),
        "dst_port_top1_concentration": (col("dst_port", "top"), None),
        "endpoint_edge_entropy": (col("endpoint_edge", "h"), None),
        "top1_endpoint_edge_share": (col("endpoint_edge", "top"), None),
        "edge_reuse_ratio": (reuse, log_score(reuse, 100)),
        "host_edge_entropy": (col("host_edge", "h"), None),
        "dst_host_concentration": (col("dst_host", "top"), None),
        "host_max_in_degree_ratio": (F.col("host_max_in_degree_ratio"), None),
        "host_max_out_degree_ratio": (F.col("host_max_out_degree_ratio"), None),
        "src_dst_endpoint_asymmetry": (F.abs(col("src_endpoint", "u") - col("dst_endpoint", "u")) / F.col("_nodes"), None),
        "src_endpoint_concentration": (col("src_endpoint", "top"), None),
        "dst_endpoint_concentration": (col("dst_endpoint", "top"), None),
        "max_in_degree_ratio": (F.col("max_in_degree_ratio"), None),
        "max_out_degree_ratio": (F.col("max_out_degree_ratio"), None),
        "leaf_ratio": (F.col("leaf_ratio"), None),
        "edge_per_node": (F.col("edge_per_node"), log_score(F.col("edge_per_node"), 10)),
        "low_reciprocity": (F.when(F.col("_sum") > 0, 1 - F.col("_min") / F.col("_sum")), None),
        "temporal_burst": (F.col("temporal_burst"), None),
        "temporal_global_spread": (F.col("temporal_global_spread"), None),
        "temporal_intra_uniformity": (F.col("temporal_intra_uniformity"), None),
    }
    out = [group, "flows"]
    for name, (value, score) in raw.items():
        out += [F.round(value, 6).alias(name), F.round(100 * value if score is None else score, 2).alias(f"{name}__score")]
    return wide.select(*out)


METRICS = (
    "dst_port_entropy dst_port_richness src_port_entropy dst_port_top1_concentration endpoint_edge_entropy top1_endpoint_edge_share edge_reuse_ratio "
        "host_edge_entropy dst_host_concentration "
    "host_max_in_degree_ratio host_max_out_degree_ratio src_dst_endpoint_asymmetry src_endpoint_concentration dst_endpoint_concentration "
        "max_in_degree_ratio max_out_degree_ratio leaf_ratio "
    "edge_per_node low_reciprocity temporal_burst temporal_global_spread temporal_intra_uniformity"
).split()


def long_metrics(wide: DataFrame, group: str = "learner") -> DataFrame:
    """group, metric, raw, score; metrics that are missing have no row."""
    parts = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("raw"), F.col(f"{m}__score").alias("score")) for m in METRICS]
    return wide.select(group, F.explode(F.array(*parts)).alias("p")).select(group, "p.*").where("raw is not null")


#: Each metric's axis, and its tags for a low and a high score.
CATALOG: list[tuple[str, str, str, str]] = [
    ("dst_port_entropy", "dispersion", "目的端口集中", "目的端口分散"),
    ("dst_port_richness", "richness", "目的端口种类少", "目的端口种类丰富"),
    ("src_port_entropy", "dispersion", "源端口模板化", "源端口分散"),
    ("dst_port_top1_concentration", "concentration", "目的端口分散", "目的端口高度集中"),
    ("endpoint_edge_entropy", "dispersion", "边高度复用/模板化", "边分布分散"),
    ("top1_endpoint_edge_share", "concentration", "无边主导", "单条边主导流量"),
    ("edge_reuse_ratio", "reuse", "边几乎不复用", "边复用率高"),
    ("host_edge_entropy", "dispersion", "主机边模板化", "主机边分布分散"),
    ("dst_host_concentration", "concentration", "目的主机分散", "目的主机高度集中"),
    ("host_max_in_degree_ratio", "hub_in", "主机入度分散", "主机入向 hub 明显"),
    ("host_max_out_degree_ratio", "hub_out", "主机出度分散", "主机出向 hub 明显"),
    ("max_in_degree_ratio", "hub_in", "入度分散", "入向 hub 明显"),
    ("max_out_degree_ratio", "hub_out", "出度分散", "出向 hub 明显"),
    ("src_dst_endpoint_asymmetry", "asymmetry", "源目规模均衡", "源/目的规模不对称"),
    ("src_endpoint_concentration", "concentration", "源端分散", "源端高度集中"),
    ("dst_endpoint_concentration", "concentration", "目的端分散", "目的端高度集中"),
    ("leaf_ratio", "structure", "非叶子节点多", "叶子节点占比高"),
    ("edge_per_node", "density", "连接稀疏", "边/节点比高"),
    ("low_reciprocity", "unidirectional", "流内双向包较均衡", "流内单向性强"),
    ("temporal_burst", "burst", "时间跨度大/突发弱", "时间突发明显"),
    ("temporal_global_spread", "time_global", "全局时间轴上集中", "全局时间轴上分散"),
    ("temporal_intra_uniformity", "time_uniformity", "活跃窗内时段集中", "活跃窗内时段均匀"),
]
#: The axes' names, the mark of a weaker tag, and metrics that former versions had.
AXES = {
    "dispersion": "分散度", "concentration": "集中度", "reuse": "复用度", "richness": "丰富度", "hub_in": "入向连接", "hub_out": "出向连接", "asymmetry": "不对称",
    "structure": "拓扑形态", "density": "连接密度", "unidirectional": "单向性", "burst": "时间突发", "time_global": "全局时间分散", "time_uniformity": "窗内时间均匀",
}
WEAKER = "偏"
REMOVED = ["port_pair_entropy", "dst_port_hhi_concentration", "endpoint_edge_regular", "top5_endpoint_edge_share", "hub_in_strength",
    "hub_out_strength", "temporal_regular", "temporal_entropy"]


def catalog(spark: SparkSession) -> DataFrame:
    """metric, axis, axis_name, tag_low, tag_high: a row for each of the 22 metrics."""
    return spark.createDataFrame([(m, axis, AXES[axis], low, high) for m, axis, low, high in CATALOG], "metric string, axis string, axis_name string, "
        "tag_low string, tag_high string")


def semantic_tags(long: DataFrame) -> DataFrame:
    """long_metrics with axis and tag: the high tag from a score of 80, its weaker form from 50, the weaker low tag from 20, else the
    low tag. A tag is not marked as weaker twice. Scores count within 0 to 100."""
    s = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("score")))
    weaker = lambda c: F.when(F.startswith(c, F.lit(WEAKER)), F.col(c)).otherwise(F.concat(F.lit(WEAKER), c))
    tag = F.when(s >= 80, F.col("tag_high")).when(s >= 50, weaker("tag_high")).when(s >= 20, weaker("tag_low")).otherwise(F.col("tag_low"))
    return long.join(F.broadcast(catalog(long.sparkSession)), "metric").withColumn("tag", tag).drop("tag_low", "tag_high")  # 22 rows


def audit(df: DataFrame, assigned: DataFrame, profiles: DataFrame, least: int = 30, most: int = 0) -> DataFrame:
    """The qualification of assigned flows by learner, with what was left out.

    df: row_index and the flow columns of metrics. assigned: row_index, learner. profiles: learner, total, attack_ratio,
    dominant_label, dominant_ratio. Learners come by their joined flows, the largest first (ties: by name), to `most` of them (0: no
    limit), after which smaller ones aren't looked at; before that a learner under `least` flows is skipped with that reason. A
    profile without joined flows is skipped as well. Columns: learner, place, reason (null for an audited one), flow_count,
    attack_ratio, dominant_label, dominant_ratio, total, and the metrics, hints and rules of qualify.
    """
    joined = keep(df.join(assigned, "row_index"), "assigned-flows")  # the counts and the metrics read it several times
    n = joined.groupBy("learner").agg(F.count(F.lit(1)).alias("flow_count"))
    order = Window.orderBy(F.col("flow_count").desc(), "learner")  # a row for each learner
    ok = F.col("flow_count") >= least
    n = n.withColumns({"place": F.row_number().over(order), "_taken": F.sum(ok.cast("int")).over(order)})
    if most:
        n = n.where((F.col("_taken") < most) | (ok & (F.col("_taken") == most)))
    n = n.withColumn("reason", F.when(~ok, f"flows_below_min_samples({least})")).drop("_taken")
    found = qualify(joined.join(F.broadcast(n.where("reason is null").select("learner")), "learner", "left_semi")).drop("flows")
    listed = n.join(profiles, "learner", "left")
    gone = profiles.join(joined.select("learner").distinct(), "learner", "left_anti")
    gone = gone.select("learner", F.lit(0).cast("long").alias("flow_count"), F.lit(None).cast("int").alias("place"),
        F.lit("no_stream_assignment_join").alias("reason"), "total", "attack_ratio", "dominant_label", "dominant_ratio")
    return listed.unionByName(gone).join(found, "learner", "left")


def strength(score: Column) -> Column:
    """very_low, low, medium, high, very_high by fifths."""
    return F.when(score < 20, "very_low").when(score < 40, "low").when(score < 60, "medium").when(score < 80, "high").otherwise("very_high")


def score_of(metric: str) -> Column:
    return F.col(f"{metric}__score")


def at_least(metric: str, x: float) -> Column:
    """A rule's atom; a missing metric makes it false."""
    return F.coalesce(score_of(metric) >= x, F.lit(False))


def at_most(metric: str, x: float) -> Column:
    return F.coalesce(score_of(metric) <= x, F.lit(False))


def between(metric: str, low: float, high: float) -> Column:
    return at_least(metric, low) & at_most(metric, high)


def all_of(*tests: Column) -> Column:
    return reduce(Column.__and__, tests)


def any_of(*tests: Column) -> Column:
    return reduce(Column.__or__, tests)


def hints() -> dict[str, Column]:
    """Hints read a missing metric as 0. Their limits are fixed values."""
    s = lambda m: F.coalesce(score_of(m), F.lit(0.0))
    return {
        "Flood-like": ((s("top1_endpoint_edge_share") >= 80) | (s("dst_endpoint_concentration") >= 80)) & (s("temporal_burst") >= 50),
        "Scan-like": (s("dst_port_entropy") >= 80) & (s("max_out_degree_ratio") >= 50) & (s("low_reciprocity") >= 70) & (s("edge_reuse_ratio") <= 55),
        "Single-service-like": (s("dst_port_top1_concentration") >= 80) & ((s("top1_endpoint_edge_share") >= 60) | (s("endpoint_edge_entropy") <= 35)),
        "Benign-like": (s("endpoint_edge_entropy") >= 60) & (s("top1_endpoint_edge_share") <= 30) & (s("low_reciprocity") <= 60) & (s("temporal_burst") <= 50) & (s("temporal_global_spread") >= 35),
    }


def matched(tests: dict[str, Column]) -> Column:
    """The names of the tests that hold, in their order, as an array."""
    return F.array_compact(F.array(*[F.when(test, name) for name, test in tests.items()]))


#: The reference rules' keys, tones and atoms (metric, least, most) over scores. All atoms must hold.
_FIXED_SERVICE = [
    ("dst_port_entropy", None, 12), ("dst_port_richness", None, 30), ("dst_port_top1_concentration", 95, None),
    ("endpoint_edge_entropy", 80, None), ("src_port_entropy", 80, None),
]
#: One of these must hold as well.
_FIXED_SERVICE_SUPPORT = [("dst_host_concentration", 65, None), ("max_in_degree_ratio", 75, None), ("host_max_in_degree_ratio", 75, None)]
_DIFFUSE = [
    ("dst_port_entropy", 90, None), ("dst_port_richness", 90, None), ("dst_port_top1_concentration", None, 10),
    ("endpoint_edge_entropy", 95, None), ("edge_reuse_ratio", None, 25), ("low_reciprocity", 85, None),
]
RULES: list[tuple[str, str, list[tuple[str, float | None, float | None]], list[tuple[str, float | None, float | None]]]] = [
    ("benign-natural-dispersion", "benign", [
        ("endpoint_edge_entropy", 82, None), ("top1_endpoint_edge_share", None, 8), ("edge_reuse_ratio", 35, 65), ("dst_port_entropy", None, 45),
        ("dst_port_richness", None, 75), ("dst_port_top1_concentration", 20, 85), ("low_reciprocity", None, 70), ("max_out_degree_ratio", None, 15)], []),
    ("fixed-service-dos-ddos-family", "attack", _FIXED_SERVICE, _FIXED_SERVICE_SUPPORT),
    ("slow-dos-fixed-service", "attack", [*_FIXED_SERVICE, ("low_reciprocity", 68, None)], _FIXED_SERVICE_SUPPORT),
    ("portscan-wide-target", "attack", [
        ("dst_port_entropy", 90, None), ("dst_port_richness", 70, None), ("dst_port_top1_concentration", None, 15),
        ("dst_endpoint_concentration", None, 15), ("endpoint_edge_entropy", 90, None), ("low_reciprocity", None, 75)], []),
    ("heartbleed-like-small-sample", "caution", [
        ("endpoint_edge_entropy", None, 20), ("top1_endpoint_edge_share", 80, None), ("dst_port_top1_concentration", 95, None), ("src_port_entropy",
            None, 25)], []),
    ("diffuse-one-way-drdos-udp-syn-family", "attack", _DIFFUSE, []),
    ("drdos-dns-ldap-ntp-like", "attack", [*_DIFFUSE, ("src_port_entropy", 65, 85)], []),
    ("drdos-snmp-ssdp-tftp-like", "attack", [*_DIFFUSE, ("src_port_entropy", 85, 98)], []),
    ("drdos-udp-syn-udp-lag-like", "attack", [*_DIFFUSE, ("src_port_entropy", 98, None)], []),
    ("web-ddos-bidirectional-hub-like", "caution", [
        ("dst_port_entropy", 35, 65), ("dst_port_top1_concentration", 50, 85), ("max_in_degree_ratio", 80, None), ("max_out_degree_ratio", 80, None),
        ("endpoint_edge_entropy", 90, None)], []),
]


def atom(metric: str, least: float | None, most: float | None) -> Column:
    tests = ([at_least(metric, least)] if least is not None else []) + ([at_most(metric, most)] if most is not None else [])
    return all_of(*tests)


def rules() -> dict[str, Column]:
    """The rules as conditions, by key, in their order."""
    out = {}
    for key, _, needed, support in RULES:
        test = all_of(*[atom(*a) for a in needed])
        out[key] = test & any_of(*[atom(*a) for a in support]) if support else test
    return out


def qualify(df: DataFrame, group: str = "learner") -> DataFrame:
    """metrics with hints and rules, as names joined by |."""
    return metrics(df, group).withColumns({"hints": F.concat_ws("|", matched(hints())), "rules": F.concat_ws("|", matched(rules()))})
