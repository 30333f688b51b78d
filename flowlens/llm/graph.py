"""Connected components of an edge table, without ever holding it in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, save


def components(edges: DataFrame) -> DataFrame:
    """(node, component): component is the smallest node reachable over the undirected edges (a, b).

    Every round each node takes the smallest label among its neighbours and then its label's label, so the rounds grow
    with the logarithm of a component's width. Every round is a written table. Nodes without an edge don't appear;
    rows with a null end are ignored; repeated edges and self-edges are harmless; no edges give an empty table.
    """
    pairs = edges.select("a", "b").where("a is not null and b is not null")
    both = save(pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "both-ways")
    labels = save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("next")), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("next").alias("next"))
        )
        hooked = labels.join(near, "node").select("node", F.least("label", "next").alias("new"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("far"))
        done = hooked.join(jump, "new", "left").select("node", F.least("new", F.coalesce("far", "new")).alias("label"), "old")
        after = save(done, "labels")
        changed = after.where("label <> old").limit(1).count()
        drop(labels)
        labels = after.select("node", "label")
        if not changed:
            drop(both)
            return labels.select("node", F.col("label").alias("component"))


def star_components(edges: DataFrame) -> DataFrame:
    """components() of edges where each a has few b's, whereas many a's may share a b.

    Nodes that are nobody's b are leaves: their b's are tied to one of them, and only those ties go through the rounds.
    A leaf then has the component of its first b. The lists of b's are held whole, so they must be bounded.
    """
    pairs = edges.select("a", "b").where("a is not null and b is not null")
    lists = pairs.groupBy("a").agg(F.min_by("b", F.xxhash64("b")).alias("first"), F.collect_set("b").alias("all"))
    inner = pairs.select(F.col("b").alias("told")).distinct()
    lists = save(lists.join(inner, lists["a"] == inner["told"], "left").select("a", "first", "all", F.col("told").isNull().alias("leaf")), "stars")
    ends = F.when(F.col("leaf"), F.col("all")).otherwise(F.concat("all", F.array("a")))
    core = components(lists.select(F.col("first").alias("a"), F.explode(ends).alias("b")).distinct())
    least = lists.where("leaf").groupBy(F.col("first").alias("node")).agg(F.min("a").alias("low"))
    named = core.join(least, "node", "left").groupBy("component").agg(F.least(F.min("component"), F.min("low")).alias("named"))
    core = save(core.join(named, "component").select("node", F.col("named").alias("component")), "core")
    leaves = lists.where("leaf").join(core.withColumnRenamed("node", "first"), "first").select(F.col("a").alias("node"), "component")
    return core.unionByName(leaves)
