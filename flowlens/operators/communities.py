"""Communities of a weighted graph by modularity.

Nodes move to the community around them that gains most modularity, in rounds over all nodes at once; then communities become nodes and
the rounds go on; at last the nodes themselves move once more, and all of it again, for as long as modularity grows. In a round a node
moves only if it gains more than each neighbour that would move as well, so that neighbours don't swap places. Moves of one round can
still get in each other's way by the sizes of communities; a round that gains nothing is taken back, and the node of largest gain moves
alone. Everything is joins and aggregations; the driver sees a few numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.session import discard, keep


def _both_ways(edges: DataFrame) -> DataFrame:
    """a, b, weight of undirected edges in both directions; parallel ones are added up; a self-loop is one row of twice its weight."""
    there = edges.select("a", "b", F.col("weight").cast("double").alias("weight"))
    back = there.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")
    return there.unionAll(back).groupBy("a", "b").agg(F.sum("weight").alias("weight"))


def modularity(edges: DataFrame, labels: DataFrame) -> float:
    """Of labels (node, community) over undirected edges (a, b, weight): the share of weight inside communities less what chance gives."""
    return _quality(_both_ways(edges), labels)


def _quality(both: DataFrame, labels: DataFrame) -> float:
    one, two = labels.select(F.col("node").alias("a"), F.col("community").alias("ca")), labels.select(F.col("node").alias("b"), F.col("community").alias("cb"))
    by = both.join(one, "a").join(two, "b").groupBy(F.col("ca").alias("c")).agg(F.sum("weight").alias("all"), F.sum(F.when(F.col("ca") == F.col("cb"),
        F.col("weight")).otherwise(0.0)).alias("inside"))
    got = by.groupBy().agg(F.sum("all").alias("m"), F.sum("inside").alias("inside"), F.sum(F.col("all") * F.col("all")).alias("squares")).first()
    return 0.0 if not got["m"] else got["inside"] / got["m"] - got["squares"] / got["m"] ** 2


def _wanted(both: DataFrame, labels: DataFrame, total: float) -> DataFrame:
    """node, community, to, gain of the nodes that would gain by moving; ties go to the smaller name."""
    degree = both.groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("k"))
    held = labels.join(degree, "node")
    size = held.groupBy("community").agg(F.sum("k").alias("size"))
    near = both.where("a <> b").join(labels.select(F.col("node").alias("b"), "community"), "b").groupBy(F.col("a").alias("node"),
        "community").agg(F.sum("weight").alias("w"))
    own = held.select("node", "community", F.lit(0.0).alias("w"))
    choices = near.unionByName(own).groupBy("node", "community").agg(F.sum("w").alias("w")).join(size, "community").join(held.select("node",
        F.col("community").alias("now"), "k"), "node")
    stays = F.col("community") == F.col("now")
    value = F.round(F.col("w") - F.col("k") * (F.col("size") - F.when(stays, F.col("k")).otherwise(0.0)) / total, 12)
    best = choices.groupBy("node").agg(F.min(F.struct((-value).alias("less"), "community")).alias("best"), F.first("now").alias("community"),
        F.max(F.when(stays, value)).alias("now_value"))
    gain = -F.col("best.less") - F.col("now_value")
    return best.select("node", "community", F.col("best.community").alias("to"), gain.alias("gain")).where(F.col("gain") > 1e-9)


def _settled(both: DataFrame, labels: DataFrame, total: float, best: float, rounds: int) -> tuple[DataFrame, float]:
    """labels after rounds of moves, and their modularity."""
    labels = keep(labels, "labels")
    for _ in range(rounds):
        wanted = keep(_wanted(both, labels, total), "wanted")
        rank = lambda c: F.struct(F.col("gain"), F.xxhash64(c), F.col(c))
        around = both.where("a <> b").join(wanted.select(F.col("node").alias("b"), "gain"),
            "b").groupBy(F.col("a").alias("node")).agg(F.max(rank("b")).alias("rival"))
        first = wanted.join(around, "node", "left").where(F.col("rival").isNull() | (F.struct(F.col("gain"), F.xxhash64("node"),
            F.col("node").alias("b")) > F.col("rival")))
        for movers in (first.select("node", "to"), wanted.orderBy(F.col("gain").desc(), "node").limit(1).select("node", "to")):
            after = keep(labels.join(movers, "node", "left").select("node", F.coalesce("to", "community").alias("community")), "labels")
            quality = _quality(both, after)
            if quality > best + 1e-9:
                break
            discard(after)
        discard(wanted)
        if quality <= best + 1e-9:
            break
        discard(labels)
        labels, best = after, quality
    return labels, best


def modularity_communities(edges: DataFrame, nodes: DataFrame | None = None, rounds: int = 60) -> DataFrame:
    """node, community of undirected edges (a, b, weight > 0); community is the smallest node in it. nodes (node) may hold ones without an
    edge, which are their own community. rounds: at most so many at a level."""
    both = keep(_both_ways(edges), "both-ways")
    own = both.select(F.col("a").alias("node")).distinct()
    all_nodes = own if nodes is None else own.union(nodes.select("node")).distinct()
    total = both.agg(F.sum("weight")).first()[0]
    labels = keep(own.select("node", F.col("node").alias("community")), "labels")
    best = _quality(both, labels) if total else 0.0
    while total:
        before = best
        labels, best = _settled(both, labels, total, best, rounds)
        while True:  # communities become nodes
            start = best
            one, two = labels.select(F.col("node").alias("a"), F.col("community").alias("ca")), labels.select(F.col("node").alias("b"),
                F.col("community").alias("cb"))
            level = keep(both.join(one, "a").join(two, "b").groupBy(F.col("ca").alias("a"),
                F.col("cb").alias("b")).agg(F.sum("weight").alias("weight")), "contracted")
            upper, best = _settled(level, level.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("community")), total,
                best, rounds)
            if best <= start + 1e-9:
                break
            labels = keep(labels.withColumnRenamed("community", "_c").join(upper.select(F.col("node").alias("_c"), "community"), "_c").select("node",
                "community"), "labels")
        if best <= before + 1e-9:
            break
    name = labels.groupBy("community").agg(F.min("node").alias("_name"))
    named = labels.join(name, "community").select("node", F.col("_name").alias("community"))
    return all_nodes.join(named, "node", "left").select("node", F.coalesce("community", "node").alias("community"))
