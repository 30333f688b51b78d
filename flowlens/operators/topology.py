"""Graphs of endpoints: edges, degrees, compact views, components, per-flow and per-window rules.

A graph table always has a key column (a learner, a label, a window or a constant), so all groups are worked on at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.session import discard, keep

from .aggregates import group_profile


def endpoint(ip: Column, port: Column) -> Column:
    """ip:port; a port that is no number is 0."""
    return F.concat(F.trim(ip), F.lit(":"), F.coalesce(port.try_cast("int"), F.lit(0)).cast("string"))


#: Fixed: the address blocks that count as private: first address and prefix length.
PRIVATE_BLOCKS = [
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 29), ("192.0.0.170", 31),
    ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("240.0.0.0", 4), ("255.255.255.255", 32),
]


def ip_number(ip: Column) -> Column:
    """A dotted IPv4 address as a number; null for anything else."""
    text = F.trim(ip)
    ok = text.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$")
    return F.when(ok, F.aggregate(F.split(text, r"\."), F.lit(0).cast("long"), lambda sum_, octet: sum_ * 256 + octet.cast("long")))


def is_private(ip: Column) -> Column:
    """By the blocks above; what is no address counts if it starts like a private one."""
    spans = []
    for first, bits in PRIVATE_BLOCKS:
        low = sum(int(x) << (8 * (3 - k)) for k, x in enumerate(first.split(".")))
        spans.append(F.struct(F.lit(low).cast("long").alias("low"), F.lit(low + 2 ** (32 - bits) - 1).cast("long").alias("high")))
    hit = F.exists(F.array(ip_number(ip)), lambda n: F.exists(F.array(*spans), lambda s: n.between(s["low"], s["high"])))  # the number is worked out once
    like = F.startswith(F.trim(ip), F.lit("192.168.")) | F.startswith(F.trim(ip), F.lit("10."))
    return F.coalesce(hit, like, F.lit(False))


def edges(df: DataFrame, key: list[str], source: Column, target: Column) -> DataFrame:
    """key, src, dst, n: flows of each directed edge."""
    return df.select(*key, source.alias("src"), target.alias("dst")).groupBy(*key, "src", "dst").agg(F.count(F.lit(1)).alias("n"))


def compact(edge: DataFrame, key: str, most_edges: int, most_nodes: int) -> tuple[DataFrame, DataFrame]:
    """The most frequent edges of each key, then the nodes with most flows on them, then the edges between those nodes.
    0 is no limit. Returns (links, nodes); ties go to the smaller names."""
    if most_edges > 0:
        w = Window.partitionBy(key).orderBy(F.col("n").desc(), "src", "dst")
        edge = edge.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most_edges).drop("_r")
    ends = edge.select(key, F.explode(F.array("src", "dst")).alias("node"), "n")
    nodes = ends.groupBy(key, "node").agg(F.sum("n").alias("flows"))
    if most_nodes > 0:
        w = Window.partitionBy(key).orderBy(F.col("flows").desc(), "node")
        nodes = nodes.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most_nodes).drop("_r")
    names = nodes.select(key, "node")
    links = edge.join(names.withColumnRenamed("node", "src"), [key, "src"], "left_semi").join(names.withColumnRenamed("node", "dst"), [key, "dst"], "left_semi")
    return links, nodes


def degrees(edge: DataFrame, key: list[str]) -> DataFrame:
    """Per node: distinct successors, distinct predecessors, flows out and in."""
    out = edge.select(*key, F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"), F.col("n").alias("so"), F.lit(0).alias("si"))
    into = edge.select(*key, F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"), F.lit(0).alias("so"), F.col("n").alias("si"))
    return out.unionByName(into).groupBy(*key, "node").agg(
        F.sum("o").cast("long").alias("out_degree"), F.sum("i").cast("long").alias("in_degree"), F.sum("so").alias("out_flows"), F.sum("si").alias("in_flows")
    )


def neighbours(edge: DataFrame, key: list[str]) -> DataFrame:
    """Per node: distinct neighbours in either direction; a self-loop makes a node its own neighbour."""
    both = edge.select(*key, F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node"),
        F.col("src").alias("other")))).alias("p"))
    return both.select(*key, "p.node", "p.other").distinct().groupBy(*key, "node").agg(F.count(F.lit(1)).alias("neighbours"))


def learner_views(rows: DataFrame, label: str = "label", learner: str = "learner", least: int = 300, most: int = 50, unknown: tuple[str, ...] = ("",
    "UNKNOWN")) -> DataFrame:
    """learner, place, total, attack_ratio, dominant_label, dominant_ratio of the `most` learners with most flows that have `least` flows
    and a name; in the order of their attack ratio, then of flows and name."""
    views = group_profile(rows, learner, label).where((F.col("total") >= least) & ~F.col(learner).isin(*unknown))
    views = views.orderBy(F.col("total").desc(), learner).limit(most)
    order = Window.orderBy(F.col("attack_ratio").desc(), F.col("total").desc(), learner)  # at most `most` rows
    return views.select(learner, F.row_number().over(order).cast("long").alias("place"), "total", "attack_ratio", "dominant_label", "dominant_ratio")


def with_reverse(edge: DataFrame, key: list[str]) -> DataFrame:
    """Adds back: the flows of the opposite edge, 0 without one."""
    other = edge.select(*key, F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("n").alias("_b"))
    return edge.join(other, [*key, "src", "dst"], "left").withColumn("back", F.coalesce("_b", F.lit(0))).drop("_b")


def graph_stats(edge: DataFrame, key: list[str]) -> DataFrame:
    """Nodes, edges, density, largest degree shares, leaf share, edges per node, reciprocity by edges and by flows."""
    deg = degrees(edge, key).join(neighbours(edge, key), [*key, "node"])
    nodes = deg.groupBy(*key).agg(
        F.count(F.lit(1)).alias("nodes"), F.max("out_degree").alias("_o"), F.max("in_degree").alias("_i"),
            F.sum((F.col("neighbours") <= 1).cast("long")).alias("_leaf")
    )
    both = F.col("back") > 0
    flows = with_reverse(edge, key).groupBy(*key).agg(
        F.count(F.lit(1)).alias("edges"),
        F.sum((both & (F.col("src") != F.col("dst"))).cast("long")).alias("_two"),
        F.sum(F.when(both, F.least("n", "back")).otherwise(0)).alias("_min"),
        F.sum(F.when(both, F.col("n")).otherwise(0)).alias("_sum"),
    )
    rest = F.greatest(F.lit(1), F.col("nodes") - 1)
    return nodes.join(flows, key).select(
        *key,
        "nodes",
        "edges",
        F.when(F.col("nodes") > 1, F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(0.0).alias("density"),
        (F.col("_o") / rest).alias("max_out_ratio"),
        (F.col("_i") / rest).alias("max_in_ratio"),
        (F.col("_leaf") / F.col("nodes")).alias("leaf_ratio"),
        (F.col("edges") / F.col("nodes")).alias("edge_per_node"),
        (F.col("_two") / F.col("edges")).alias("reciprocity"),
        F.when(F.col("_sum") > 0, F.col("_min") / F.col("_sum")).otherwise(0.0).alias("weighted_reciprocity"),
    )


#: Edges, of all keys together, that a task may join on its own.
LAST_EDGES = 20_000


def _joined(edges: pd.DataFrame) -> pd.DataFrame:
    """The key, node and a node that all nodes of its component share, of the few edges (a, b) of one key."""
    up: dict = {}

    def top(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in zip(edges["a"], edges["b"], strict=True):
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return pd.DataFrame({edges.columns[0]: edges.iloc[0, 0], "node": list(up), "to": [top(x) for x in up]})


def components(edge: DataFrame, key: str) -> DataFrame:
    """key, node, component: the smallest node that edges reach in either direction, per key.

    In a round every node points to the neighbour (or itself) that comes first in an order by hash, another one each round, and edges
    become edges between what their ends point to. That at least halves the nodes that still have edges, on average, so all rounds
    together move a few times the edges, whatever the width of a component. Once at most LAST_EDGES edges are left, a task for each key
    joins their ends. Then the pointers are followed from the last round to the first. Each round is a table in the shared folder, deleted
    when it isn't read any more.
    """
    whole = edge.select(key, F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where(F.col(key).isNotNull() & F.col("src").isNotNull() &
        F.col("dst").isNotNull())
    left, rounds = keep(whole.distinct(), "edges"), []
    while left.count() > LAST_EDGES:
        place = lambda c, n=len(rounds): F.struct(F.xxhash64(F.lit(n), F.col(c)).alias("h"), F.col(c).alias("to"))
        ends = left.select(key, F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"),
            F.col("a").alias("other")))).alias("p")).select(key, "p.*")
        first = ends.groupBy(key, "node").agg(F.min(place("other")).alias("_first"))
        rounds.append(keep(first.select(key, "node", F.least("_first", place("node"))["to"].alias("to")), "pointers"))
        of = lambda c: rounds[-1].select(key, F.col("node").alias(c), F.col("to").alias(f"{c}_to"))
        moved = left.where("a <> b").join(of("a"), [key, "a"]).join(of("b"), [key, "b"]).where("a_to <> b_to")
        after = keep(moved.select(key, F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), "edges")
        discard(left)
        left = after
    kinds = dict(left.dtypes)
    roots = keep(left.groupBy(key).applyInPandas(_joined, f"`{key}` {kinds[key]}, node {kinds['a']}, to {kinds['a']}"), "roots")
    for pointers in rounds[::-1]:
        further = roots.select(key, F.col("node").alias("to"), F.col("to").alias("_far"))
        found = keep(pointers.join(further, [key, "to"], "left").select(key, "node", F.coalesce("_far", "to").alias("to")), "roots")
        discard(pointers, roots)
        roots = found
    smallest = roots.groupBy(key, "to").agg(F.min("node").alias("component"))
    out = keep(roots.join(smallest, [key, "to"]).select(key, "node", "component"), "labels")
    discard(left, roots)
    return out


def component_stats(labels: DataFrame, key: str) -> DataFrame:
    """components, share of the largest, share of nodes outside it."""
    n = labels.groupBy(key, "component").agg(F.count(F.lit(1)).alias("n"))
    out = n.groupBy(key).agg(F.count(F.lit(1)).alias("components"), (F.max("n") / F.sum("n")).alias("largest_ratio"))
    return out.withColumn("fragment_ratio", 1 - F.col("largest_ratio"))


def graph_metrics(edge: DataFrame, key: str) -> DataFrame:
    """graph_stats with the number of weak components, the largest one's share of nodes and components per node. The edges
    are read several times, so save them first if they are costly to make."""
    parts = components(edge, key).groupBy(key, "component").agg(F.count(F.lit(1)).alias("_n")).groupBy(key).agg(F.count(F.lit(1)).alias("components"),
        F.max("_n").alias("_largest"))
    out = graph_stats(edge, [key]).join(parts, key)
    return out.withColumns({"largest_ratio": F.col("_largest") / F.col("nodes"), "component_ratio": F.col("components") / F.col("nodes")}).drop("_largest")


def anomaly_flags(stats: DataFrame) -> DataFrame:
    """Adds flags: names of what stands out in a graph of graph_metrics, joined by |."""
    tests = [
        ("STRONG_SOURCE_HUB", F.col("max_out_ratio") >= 0.25),
        ("STRONG_SINK_HUB", F.col("max_in_ratio") >= 0.25),
        ("VERY_LOW_RECIPROCITY", F.col("reciprocity") <= 0.01),
        ("HIGH_FRAGMENTATION", F.col("components") >= F.greatest(F.lit(8), F.floor(0.1 * F.col("nodes")))),
        ("SMALL_GIANT_COMPONENT", F.col("largest_ratio") <= 0.35),
        ("UNUSUALLY_DENSE", (F.col("density") >= 0.02) & (F.col("nodes") > 200)),
    ]
    found = F.concat_ws("|", *[F.when(test, name) for name, test in tests])
    return stats.withColumn("flags", F.when(found == "", "NO_STRONG_TOPO_ANOMALY").otherwise(found))


def edge_rules(edge: DataFrame, hub: float = 0.25) -> DataFrame:
    """The rules of each edge (src, dst): its source's successors, or its target's predecessors, are `hub` or more of the other
    nodes; there is no opposite edge; and their unions. All flows of an edge share its rules, so flows are never joined to
    degrees. Hubs are few (each is tied to at least that share of the nodes)."""
    deg = degrees(edge, [])
    rest = deg.agg(F.greatest(F.lit(1), F.count(F.lit(1)) - 1).alias("_rest"))
    hubs = deg.join(F.broadcast(rest), how="cross").select("node", (F.col("out_degree") / F.col("_rest") >= hub).alias("_s"),
        (F.col("in_degree") / F.col("_rest") >= hub).alias("_k")).where("_s or _k")
    end = lambda c, flag, name: hubs.where(flag).select(F.col("node").alias(c), F.lit(True).alias(name))
    out = with_reverse(edge, []).join(end("src", "_s", "_src"), "src", "left").join(end("dst", "_k", "_sink"), "dst", "left")
    source, sink, low = F.coalesce("_src", F.lit(False)), F.coalesce("_sink", F.lit(False)), F.col("back") == 0
    return out.withColumns(
        {"rule_source_hub": source, "rule_sink_hub": sink, "rule_low_reciprocity": low, "rule_sink_or_low_recip": sink | low,
            "rule_src_or_sink_or_low_recip": source | sink | low}
    ).drop("_src", "_sink", "back")


FLOW_RULES = ("rule_source_hub", "rule_sink_hub", "rule_low_reciprocity", "rule_sink_or_low_recip", "rule_src_or_sink_or_low_recip")
WINDOW_RULES = ("rule_win_sink_lowrecip", "rule_win_src_lowrecip", "rule_win_frag_lcc", "rule_win_combo")


def flow_rules(df: DataFrame, hub: float = 0.25) -> DataFrame:
    """df (src_ip, src_port, dst_ip, dst_port) with the rules of each flow's edge between ip:port endpoints."""
    src, dst = endpoint(F.col("src_ip"), F.col("src_port")), endpoint(F.col("dst_ip"), F.col("dst_port"))
    rules = edge_rules(edges(df, [], src, dst), hub).select("src", "dst", *FLOW_RULES)
    return df.withColumns({"src": src, "dst": dst}).join(rules, ["src", "dst"]).drop("src", "dst")


def rule_rates(rows: DataFrame, rules: tuple[str, ...], attacks: str = "attacks", benign: str = "benign") -> DataFrame:
    """A row for each rule: tp, tn, fp, fn, fpr, fnr, tpr, precision, flagged. rows: rule columns (null counts as false) and how
    many attack and benign flows each row stands for. A rate without a base is 0."""
    parts = rows.select(attacks, benign, F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.coalesce(F.col(r),
        F.lit(False)).alias("hit")) for r in rules])).alias("p"))
    n = lambda c, hit: F.sum(F.when(F.col("p.hit") == hit, F.col(c)).otherwise(0))
    out = parts.groupBy("p.rule").agg(n(attacks, True).alias("tp"), n(benign, False).alias("tn"), n(benign, True).alias("fp"), n(attacks, False).alias("fn"))
    rate = lambda a, b: F.col(a) / F.greatest(F.lit(1), F.col(a) + F.col(b))
    return out.withColumns({"fpr": rate("fp", "tn"), "fnr": rate("fn", "tp"), "tpr": rate("tp", "fn"), "precision": rate("tp", "fp"),
        "flagged": F.col("tp") + F.col("fp")})


def _window_graph(group: pa.Table) -> pa.Table:
    """The figures of one window's graph. Its rows are bounded by the window's size."""
    ends = pa.concat_arrays([group.column("src").combine_chunks(), group.column("dst").combine_chunks()]).dictionary_encode().indices.to_numpy()
    rows, nodes = group.num_rows, int(ends.max()) + 1
    edge = np.unique(ends[:rows].astype(np.int64) * nodes + ends[rows:])
    src, dst = edge // nodes, edge % nodes
    label = np.arange(nodes)
    while True:  # the smaller label of an edge's ends, then the label's label
        after = label.copy()
        low = np.minimum(label[src], label[dst])
        np.minimum.at(after, src, low)
        np.minimum.at(after, dst, low)
        after = after[after]
        if (after == label).all():
            break
        label = after
    sizes = np.bincount(label)
    attacks = rows - int(pc.sum(group.column("benign")).as_py())
    rest = max(1, nodes - 1)
    return pa.table(
        {
            "window_id": group.column("window_id")[:1], "rows": [rows], "attack_ratio": [attacks / rows],
                "is_attack_window": pa.array([int(attacks > 0)], pa.int32()), "nodes": [nodes], "edges": [len(edge)],
            "reciprocity": [float(np.isin(dst * nodes + src, edge).mean())], "hub_out_ratio": [np.bincount(src).max() / rest],
                "hub_in_ratio": [np.bincount(dst).max() / rest],
            "frag_ratio": [np.count_nonzero(sizes) / nodes], "largest_cc_ratio": [sizes.max() / nodes],
        }
    )


def window_graphs(df: DataFrame, size: int, index: str = "row_index") -> DataFrame:
    """Each block of `size` rows as a graph of ip:port endpoints: rows, attack_ratio, is_attack_window, nodes, edges, reciprocity
    (edges with an opposite one; a self-loop is its own), hub_out_ratio, hub_in_ratio, frag_ratio (components per node),
    largest_cc_ratio. df has benign as 0/1. A window is one group of at most `size` rows, so its graph fits one task; windows are
    dealt over all tasks in one shuffle."""
    src, dst = endpoint(F.col("src_ip"), F.col("src_port")), endpoint(F.col("dst_ip"), F.col("dst_port"))
    blocks = df.select(F.floor(F.col(index) / size).alias("window_id"), src.alias("src"), dst.alias("dst"), F.col("benign").cast("int").alias("benign"))
    shape = "window_id long, rows long, attack_ratio double, is_attack_window int, nodes long, edges long, reciprocity double, hub_out_ratio double, hub_in_ratio double, frag_ratio double, largest_cc_ratio double"
    return blocks.groupBy("window_id").applyInArrow(_window_graph, shape)


def window_rules(windows: DataFrame, quiet: float = 0.001) -> DataFrame:
    """Adds the window rules, whose limits are quantiles of the windows with an attack_ratio of at most `quiet`. Without such a
    window no rule holds. Windows are kept, as both the limits and the rules read them."""
    windows = keep(windows, "windows")
    calm = windows.where(F.col("attack_ratio") <= quiet)
    limits = {"_r": ("reciprocity", 0.10), "_i": ("hub_in_ratio", 0.95), "_o": ("hub_out_ratio", 0.95), "_f": ("frag_ratio", 0.95),
        "_l": ("largest_cc_ratio", 0.05)}
    q = calm.agg(*[F.expr(f"percentile({c}, {at}D)").alias(k) for k, (c, at) in limits.items()])  # a row for each window
    low = F.col("reciprocity") <= F.col("_r")
    tests = {
        "rule_win_sink_lowrecip": (F.col("hub_in_ratio") >= F.col("_i")) & low,
        "rule_win_src_lowrecip": (F.col("hub_out_ratio") >= F.col("_o")) & low,
        "rule_win_frag_lcc": (F.col("frag_ratio") >= F.col("_f")) & (F.col("largest_cc_ratio") <= F.col("_l")),
    }
    out = windows.join(F.broadcast(q), how="cross").withColumns({k: F.coalesce(t, F.lit(False)) for k, t in tests.items()})
    return out.withColumn("rule_win_combo", F.col("rule_win_sink_lowrecip") | F.col("rule_win_src_lowrecip") | F.col("rule_win_frag_lcc")).drop(*limits)


def internal_topology(edge: DataFrame, key: str) -> DataFrame:
    """The graph of each key in 30 numbers: size, density, components, reciprocity by edges and by flows, largest degrees and
    strengths with their shares, shares of the strongest edges, entropies (natural logarithm) and Gini coefficients of degrees
    and entropy of edge weights, reuse, and shares of sources, targets, leaves and nodes of degree 10 or more. A self-loop counts
    twice in an undirected degree. edge (key, src, dst, n) is read several times; save it first."""
    deg = degrees(edge, [key]).join(neighbours(edge, [key]), [key, "node"])
    loops = edge.where("src = dst").select(key, F.col("src").alias("node"), F.lit(1).alias("_loop"))
    deg = deg.join(loops, [key, "node"], "left").withColumn("_deg", F.col("neighbours") + F.coalesce("_loop", F.lit(0)))
    spread = lambda x: F.when(F.sum(x) > 0, F.ln(F.sum(x)) - F.sum(F.when(x > 0, x * F.ln(x)).otherwise(0.0)) / F.sum(x)).otherwise(0.0)
    share = lambda t: F.avg(t.cast("double"))
    nodes = deg.groupBy(key).agg(
        F.count(F.lit(1)).alias("nodes"), F.max("out_degree").alias("max_out_degree"), F.max("in_degree").alias("max_in_degree"),
            F.max("out_flows").alias("max_out_strength"), F.max("in_flows").alias("max_in_strength"),
        spread(F.col("out_degree")).alias("out_deg_entropy"), spread(F.col("in_degree")).alias("in_deg_entropy"),
            share(F.col("out_degree") > 0).alias("src_endpoint_ratio"), share(F.col("in_degree") > 0).alias("dst_endpoint_ratio"),
        share(F.col("_deg") <= 1).alias("leaf_ratio"), share(F.col("_deg") >= 10).alias("high_deg_tail_ratio"),
    )
    one_sided = deg.select(key, F.explode(F.array(F.struct(F.lit("out").alias("side"), F.col("out_degree").alias("v")),
        F.struct(F.lit("in").alias("side"), F.col("in_degree").alias("v")))).alias("p")).select(key, "p.*").where("v > 0")
    equal = one_sided.groupBy(key, "side", "v").agg(F.count(F.lit(1)).alias("n"))  # distinct degrees only
    before = F.coalesce(F.sum("n").over(Window.partitionBy(key, "side").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    equal = equal.withColumn("_w", F.col("v") * F.col("n") * (2 * before + F.col("n") + 1))
    gini = equal.groupBy(key, "side").agg((F.sum("_w") / (F.sum("n") * F.sum(F.col("v") * F.col("n"))) - (F.sum("n") + 1) / F.sum("n")).alias("g"))
    gini = gini.groupBy(key).agg(F.max(F.when(F.col("side") == "out", F.col("g"))).alias("out_deg_gini"), F.max(F.when(F.col("side") == "in",
        F.col("g"))).alias("in_deg_gini"))
    n = F.col("n")
    weights = edge.groupBy(key).agg(F.count(F.lit(1)).alias("edges"), F.sum(n).alias("samples"), F.max(n).alias("_top"), spread(n).alias("edge_w_entropy"))
    ranked = edge.groupBy(key, "n").agg(F.count(F.lit(1)).alias("c"))  # distinct weights only
    above = F.coalesce(F.sum("c").over(Window.partitionBy(key).orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    five = ranked.withColumn("_t", F.greatest(F.lit(0), F.least(F.col("c"), 5 - above)) * n).groupBy(key).agg(F.sum("_t").alias("_five"))
    both = F.col("back") > 0
    back = with_reverse(edge, [key]).groupBy(key).agg(share(both & (F.col("src") != F.col("dst"))).alias("reciprocity"), (F.sum(F.when(both,
        F.least("n", "back")).otherwise(0)) / F.sum("n")).alias("weighted_reciprocity"))
    parts = components(edge, key).groupBy(key,
        "component").agg(F.count(F.lit(1)).alias("_n")).groupBy(key).agg(F.count(F.lit(1)).alias("components_weak"), F.max("_n").alias("_largest"))
    out = nodes.join(weights, key).join(five, key).join(gini, key).join(back, key).join(parts, key)
    c, rest = F.col, F.greatest(F.lit(1), F.col("nodes") - 1)
    return out.select(
        key, "samples", "nodes", "edges", F.when(c("nodes") > 1, c("edges") / (c("nodes") * (c("nodes") - 1))).otherwise(0.0).alias("density"),
            "components_weak", (c("_largest") / c("nodes")).alias("largest_component_ratio"), "reciprocity",
        "max_out_degree", "max_in_degree", (c("max_out_degree") / rest).alias("hub_out_ratio"), (c("max_in_degree") / rest).alias("hub_in_ratio"),
            "max_out_strength", "max_in_strength",
        (c("max_out_strength") / c("samples")).alias("hub_out_strength_ratio"), (c("max_in_strength") / c("samples")).alias("hub_in_strength_ratio"),
            "weighted_reciprocity",
        (c("_top") / c("samples")).alias("top1_edge_share"), (c("_five") / c("samples")).alias("top5_edge_share"), "out_deg_entropy",
            "in_deg_entropy", "edge_w_entropy", "out_deg_gini", "in_deg_gini",
        (c("samples") / c("edges")).alias("edge_reuse_ratio"), (c("edges") / c("nodes")).alias("edge_per_node"), "src_endpoint_ratio", "dst_endpoint_ratio",
        F.abs(c("src_endpoint_ratio") - c("dst_endpoint_ratio")).alias("src_dst_asymmetry"), "leaf_ratio", "high_deg_tail_ratio",
    )
