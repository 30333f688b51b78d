"""Density clusters (DBSCAN) of tables of any size.

Features are scaled to mean 0 and deviation 1. Rows with equal features are one spot with a weight. Spots lie in cells so small that
all spots of a cell are within eps of each other; a cell of `least` rows or more is dense, and its spots are core. Other spots are core
by the rows within eps, found in the cells near theirs. Core spots of one cell belong together; two near cells belong together if any
two of their core spots are within eps: first their outermost spots are tried, and only what these leave open is compared spot by
spot, as far as a spot reaches the other cell's box. Clusters are the components over cells. A spot that isn't core goes to the
cluster, of those with a core spot within eps, that has the smallest key; without one it is noise.

Nothing is held in one task: a cell that a third of all rows lie in is one row with a weight if its rows are equal, and otherwise joined
by keys that adaptive execution splits. Near cells are found by a grid over the (at most three) dimensions of the widest range.
"""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.stats import clean
from flowlens.session import discard, keep

from .topology import components

_GRID = 3


def _scaled(rows: DataFrame, key: str, features: list[str]) -> tuple[DataFrame, list[int]]:
    """key and x, the array of scaled features (null, NaN and infinite count as 0; a constant one is 0), and the numbers of the
    features with the widest range."""
    names = [f"_f{k}" for k in range(len(features))]
    plain = rows.select(F.col(key).alias("_key"), *[clean(F.col(f"`{c}`").cast("double")).alias(n) for c, n in zip(features, names, strict=True)])
    stats = plain.agg(*[F.struct(F.avg(n).alias("mean"), F.stddev_pop(n).alias("std"), F.min(n).alias("low"),
        F.max(n).alias("high")).alias(n) for n in names]).first()
    scale = [(stats[n]["mean"] or 0.0, stats[n]["std"] or 1.0) for n in names]
    width = [((stats[n]["high"] or 0.0) - (stats[n]["low"] or 0.0)) / s for n, (_, s) in zip(names, scale, strict=True)]
    widest = sorted(range(len(names)), key=lambda k: (-width[k], k))[:_GRID]
    x = F.array(*[(F.col(n) - F.lit(m)) / F.lit(s) + F.lit(0.0) for n, (m, s) in zip(names, scale, strict=True)])
    return plain.select("_key", x.alias("_x")), sorted(widest)


def _squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)


def _to_box(x: Column, low: Column, high: Column) -> Column:
    """Squared distance of a spot to a box."""
    out = F.zip_with(F.zip_with(x, low, lambda p, q: q - p), F.zip_with(x, high, lambda p, q: p - q), lambda p, q: F.greatest(p, q, F.lit(0.0)))
    return F.aggregate(out, F.lit(0.0), lambda s, v: s + v * v)


def density_clusters(rows: DataFrame, key: str, features: list[str], eps: float, least: int) -> DataFrame:
    """key, cluster, core for the rows that belong to a cluster; cluster is the smallest key of the cluster's core rows. Rows with
    `least` rows within eps, themselves included, are core. Keys must be distinct. An empty table gives an empty one."""
    d = len(features)
    scaled, widest = _scaled(rows, key, features)
    side, reach = eps / math.sqrt(d), math.ceil(math.sqrt(d))  # a coarse cell is `reach` cells wide, at least eps
    spots = scaled.groupBy("_x").agg(F.count(F.lit(1)).alias("w"), F.min("_key").alias("id"))
    cell = F.transform("_x", lambda v: F.floor(v / side).cast("long"))
    spots = keep(spots.select("id", F.col("_x").alias("x"), "w", cell.alias("cell")), "spots")
    weights = spots.groupBy("cell").agg(F.sum("w").alias("cell_w"))
    cells = keep(weights.withColumn("coarse", F.array(*[F.floor(F.col("cell")[k] / reach) for k in widest])), "cells")
    offsets = F.array(*[F.array(*[F.lit(o).cast("long") for o in offset]) for offset in product((-1, 0, 1), repeat=len(widest))])
    near = F.explode(F.transform(offsets, lambda o: F.zip_with("coarse", o, lambda p, q: p + q)))
    apart = F.aggregate(F.zip_with("a", "b", lambda p, q: F.greatest(F.abs(p - q) - 1, F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, v: s + v * v)
    a = cells.select(F.col("cell").alias("a"), F.col("cell_w").alias("a_w"), near.alias("coarse"))
    b = cells.select(F.col("cell").alias("b"), "coarse")
    pairs = keep(a.join(b, "coarse").where("a <> b").where(apart <= d).select("a", "a_w", "b"), "near-cells")  # at most eps apart

    # core spots
    limit = eps * eps
    own = spots.join(weights, "cell")
    sparse = own.where(F.col("cell_w") < least)
    other = spots.select(F.col("cell").alias("b"), F.col("x").alias("y"), F.col("w").alias("y_w"))
    counted = sparse.join(pairs.where(F.col("a_w") < least).select(F.col("a").alias("cell"), "b"), "cell").join(other, "b").where(_squared(F.col("x"),
        F.col("y")) <= limit)
    extra = counted.groupBy("id").agg(F.sum("y_w").alias("more"))
    marked = own.join(extra, "id", "left").withColumn("core", F.col("cell_w") + F.coalesce("more", F.lit(0)) >= least)
    marked = keep(marked.select("id", "x", "w", "cell", "core"), "marked")
    core = marked.where("core")

    # cells that belong together
    ends = [f(F.struct(F.col("x")[k].alias("v"), "id", "x")).getField("x").alias(f"_e{k}_{n}") for k in range(d) for n, f in (("a", F.min), ("b", F.max))]
    box = core.groupBy("cell").agg(F.count(F.lit(1)).alias("spots"), *ends)
    tips = F.array(*[F.col(f"_e{k}_{n}") for k in range(d) for n in ("a", "b")])
    low, high = (F.array(*[F.col(f"_e{k}_{n}")[k] for k in range(d)]) for n in ("a", "b"))
    box = keep(box.select("cell", "spots", tips.alias("tips"), low.alias("low"), high.alias("high")), "boxes")
    of = lambda side_: box.select(F.col("cell").alias(side_), *[F.col(c).alias(f"{side_}_{c}") for c in ("spots", "tips", "low", "high")])
    touching = pairs.where("a < b").select("a", "b").join(of("a"), "a").join(of("b"), "b")
    meets = F.exists("a_tips", lambda p: F.exists("b_tips", lambda q: _squared(p, q) <= limit))
    touching = keep(touching.withColumn("meets", meets), "touching")
    # up to 2 d spots may all be tips; a pair of boxes further apart than eps is settled as well
    gap = F.aggregate(F.zip_with(F.zip_with("a_low", "b_high", lambda p, q: p - q), F.zip_with("b_low", "a_high", lambda p, q: p - q), lambda p,
        q: F.greatest(p, q, F.lit(0.0))), F.lit(0.0), lambda s, v: s + v * v)
    open_ = touching.where(~F.col("meets") & ((F.col("a_spots") > 2) | (F.col("b_spots") > 2)) & (gap <= limit))
    left = open_.join(core.select(F.col("cell").alias("a"), F.col("x").alias("p")), "a").where(_to_box(F.col("p"), F.col("b_low"), F.col("b_high")) <= limit)
    both = left.join(core.select(F.col("cell").alias("b"), F.col("x").alias("q")), "b").where((_to_box(F.col("q"), F.col("a_low"),
        F.col("a_high")) <= limit) & (_squared(F.col("p"), F.col("q")) <= limit))
    edges = touching.where("meets").select("a", "b").unionAll(both.select("a", "b").distinct())
    named = lambda c: F.concat_ws(",", F.col(c))
    alone = box.select(named("cell").alias("src"), named("cell").alias("dst"))
    parts = components(edges.select(named("a").alias("src"), named("b").alias("dst")).unionAll(alone).withColumn("g", F.lit(0)), "g")
    cored = core.withColumn("node", named("cell")).join(parts.select("node", "component"), "node")
    smallest = cored.groupBy("component").agg(F.min("id").alias("cluster"))
    cored = keep(cored.join(smallest, "component").select("id", "x", "cell", "cluster"), "core-spots")

    # the others: core spots of their own cell are all within eps
    border = marked.where("not core").select("id", "x", "cell")
    inside = border.join(cored.select("cell", "cluster").distinct(), "cell").select("id", "cluster")
    beside = border.join(pairs.select(F.col("a").alias("cell"), "b"), "cell").join(cored.select(F.col("cell").alias("b"), F.col("x").alias("y"),
        "cluster"), "b").where(_squared(F.col("x"), F.col("y")) <= limit)
    taken = inside.unionAll(beside.select("id", "cluster")).groupBy("id").agg(F.min("cluster").alias("cluster"))
    found = cored.select("id", "cluster", F.lit(True).alias("core")).unionAll(taken.select("id", "cluster", F.lit(False)))
    found = found.join(spots.select("id", F.col("x").alias("_x")), "id")
    out = keep(scaled.join(found, "_x").select(F.col("_key").alias(key), "cluster", "core"), "clusters")
    discard(spots, cells, pairs, marked, box, touching, cored)
    return out


def new_classes(buffer: DataFrame, key: str, features: list[str], eps: float, least: int, least_class: int) -> DataFrame:
    """key, cluster for rows of the unknown buffer that form a new class: clusters of `least_class` rows or more, numbered from 0 in
    the order of their smallest core keys. All rows are clustered."""
    found = density_clusters(buffer, key, features, eps, least)
    large = found.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_class)
    numbered = large.select("cluster", (F.row_number().over(Window.orderBy("cluster")) - 1).cast("long").alias("_no"))  # a row for each class
    return found.join(numbered, "cluster").select(key, F.col("_no").alias("cluster"))
