"""Whether a cluster of unknown rows may become a learner: not too benign, not two groups in one, not torn between learners.

All clusters are judged together, from aggregates over all their rows; a cluster that holds most rows costs no task more than its
partial sums. The split in two is Lloyd's algorithm for all clusters at once, each round one aggregation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions.stats import clean
from flowlens.session import discard, keep

from .quantiles import exact_quantiles


@dataclass(frozen=True)
class PurityGate:
    """Limits of the gate; the defaults let every cluster pass. structure and routes are looked at if switched on and the cluster has
    structure_rows (route_rows) rows."""

    most_accept: float = 1.0
    most_prob: float = 1.0
    most_p90: float = 1.0
    soft_k: float = 4.0
    mixed: bool = False
    mixed_low: float = 0.2
    mixed_high: float = 0.8
    structure: bool = False
    structure_rows: int = 600
    least_child: float = 0.2
    least_silhouette: float = 0.18
    least_gain: float = 0.45
    rounds: int = 10
    routes: bool = False
    route_rows: int = 500
    least_multi: float = 0.3
    most_top1: float = 0.7


#: The reasons, in the order in which they are given.
REASONS = ["benign_accept_rate_exceed", "benign_prob_mean_exceed", "benign_prob_p90_exceed", "mixed_benign_prob_band", "mixed_structure_splitable",
    "mixed_route_inconsistent"]


def benign_figures(rows: DataFrame, losses: DataFrame, soft_k: float) -> DataFrame:
    """cluster, benign_accept_rate, benign_prob_mean, benign_prob_p10, benign_prob_p90: how the benign learners take a cluster's rows, by
    each row's best benign probability, 1 / (1 + exp(-k * margin)). rows: row_index, cluster; losses with scaled thresholds."""
    margin = (F.col("threshold") - F.col("loss")) / (F.abs("threshold") + 1e-12)
    best = losses.where("is_benign").groupBy("row_index").agg(F.max(margin).alias("m"), F.max((F.col("loss") <= F.col("threshold")).cast("int")).alias("taken"))
    p = keep(rows.select("row_index", "cluster").join(best, "row_index").select("cluster", "taken", (1 / (1 +
        F.exp(-soft_k * F.col("m")))).alias("p")), "probabilities")
    q = exact_quantiles(p, ["cluster"], "p", [0.1, 0.9])
    sums = p.groupBy("cluster").agg(F.avg("taken").alias("benign_accept_rate"), F.avg("p").alias("benign_prob_mean"))
    return sums.join(q, "cluster").select("cluster", "benign_accept_rate", "benign_prob_mean", F.col("q")[0].alias("benign_prob_p10"),
        F.col("q")[1].alias("benign_prob_p90"))


def route_figures(rows: DataFrame, losses: DataFrame) -> DataFrame:
    """cluster, route_multi_accept_ratio (rows that two learners or more take), route_top1_share (of the learner with most rows, a row
    going to the largest margin, ties to the smaller name)."""
    margin = (F.col("threshold") - F.col("loss")) / (F.abs("threshold") + 1e-12)
    each = losses.select("row_index", "learner", margin.alias("m")).groupBy("row_index").agg(F.sum((F.col("m") >= 0).cast("long")).alias("taken"),
        F.min(F.struct((-F.col("m")).alias("down"), "learner")).alias("won"))
    won = rows.select("row_index", "cluster").join(each, "row_index").groupBy("cluster",
        F.col("won.learner").alias("learner")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("taken") >= 2).cast("long")).alias("multi"))
    return won.groupBy("cluster").agg((F.sum("multi") / F.sum("n")).alias("route_multi_accept_ratio"), (F.max("n") / F.sum("n")).alias("route_top1_share"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def _mean_vectors(rows: DataFrame, group: list[str], width: int) -> DataFrame:
    """group, n, centre, square (the mean squared length)."""
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(F.col("z")[k]) for k in range(width)]).alias("centre"),
        F.avg(_dot(F.col("z"), F.col("z"))).alias("square"))


def split_figures(rows: DataFrame, features: list[str], rounds: int = 10) -> DataFrame:
    """cluster, n, structure_child_ratio (the smaller part's share), structure_split_gain (1 - inertia of two parts over that of one),
    structure_silhouette, of each cluster cut in two. rows: row_index, cluster, features.

    Features are scaled within a cluster (deviation + 1e-6). The first cut is at 0 of the feature of largest variance before scaling
    (ties: the first); then `rounds` rounds of nearest centres. The silhouette is on squared distances, whose means over a part
    follow from its centre and mean square, so all rows count and no pairs are formed. A cluster that stays whole has gain and
    silhouette 0."""
    width = len(features)
    x = F.array(*[clean(F.col(f"`{c}`").cast("double")) for c in features])
    held = rows.select("row_index", "cluster", x.alias("x"))
    stats = held.groupBy("cluster").agg(F.array(*[F.avg(F.col("x")[k]) for k in range(width)]).alias("mean"),
        F.array(*[F.stddev_pop(F.col("x")[k]) for k in range(width)]).alias("std"))
    stats = stats.withColumn("widest", F.array_position("std", F.array_max("std")).cast("int"))
    z = F.zip_with(F.zip_with("x", "mean", lambda a, b: a - b), "std", lambda a, s: a / (s + 1e-6))
    scaled = keep(held.join(F.broadcast(stats), "cluster").select("row_index", "cluster", z.alias("z"), "widest"), "scaled")  # a row for each cluster
    parts = scaled.withColumn("child", (F.element_at("z", F.col("widest")) > 0).cast("int"))
    for step in range(rounds + 1):
        centres = keep(_mean_vectors(parts, ["cluster", "child"], width), "centres")
        two = centres.groupBy("cluster").agg(*[F.max(F.when(F.col("child") == c, F.struct("centre", "n", "square"))).alias(f"c{c}") for c in (0, 1)])
        parts = scaled.join(F.broadcast(two), "cluster")
        far = [F.when(F.col(f"c{c}").isNull(), float("inf")).otherwise(_dot(F.col("z"), F.col("z")) - 2 * _dot(F.col("z"), F.col(f"c{c}.centre")) +
            _dot(F.col(f"c{c}.centre"), F.col(f"c{c}.centre"))) for c in (0, 1)]
        if step < rounds:
            parts = parts.withColumn("child", (far[1] < far[0]).cast("int")).select("row_index", "cluster", "z", "widest", "child")
    parts = parts.withColumns({"child": (far[1] < far[0]).cast("int"), "near": F.least(*far)})
    # mean squared distance to a part: |z|^2 - 2 z.centre + mean square
    to = [_dot(F.col("z"), F.col("z")) - 2 * _dot(F.col("z"), F.col(f"c{c}.centre")) + F.col(f"c{c}.square") for c in (0, 1)]
    own_n = F.when(F.col("child") == 0, F.col("c0.n")).otherwise(F.col("c1.n"))
    own = F.when(F.col("child") == 0, to[0]).otherwise(to[1]) * own_n / F.greatest(own_n - 1, F.lit(1))
    other = F.when(F.col("child") == 0, to[1]).otherwise(to[0])
    s = F.when((own_n <= 1) | (F.greatest(own, other) <= 0), 0.0).otherwise((other - own) / F.greatest(own, other))
    out = parts.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.least(F.sum("child"), F.sum(1 - F.col("child"))).alias("_small"), F.sum("near").alias("_two"),
            F.sum(_dot(F.col("z"), F.col("z"))).alias("_one"), F.avg(s).alias("_s"),
    )
    split = (F.col("_small") > 0) & (F.col("_one") > 1e-9)
    return out.select(
        "cluster", "n", (F.col("_small") / F.col("n")).alias("structure_child_ratio"), F.when(split,
            1 - F.col("_two") / F.col("_one")).otherwise(0.0).alias("structure_split_gain"),
        F.when(split & (F.col("_small") > 1), F.col("_s")).otherwise(0.0).alias("structure_silhouette"),
    )


def judge_clusters(rows: DataFrame, losses: DataFrame, features: list[str], gate: PurityGate, benign_scale: float = 1.0) -> DataFrame:
    """cluster, n, the figures (null where they aren't looked at), reasons (an array in the order of REASONS) and passed.

    rows: row_index, cluster, features; losses: row_index, learner, loss, threshold, is_benign of all known learners for these rows.
    Without a benign learner every cluster passes, with the reason no_benign_anchor_skip. Routes need two learners."""
    rows = keep(rows, "clusters")
    scaled = keep(losses.withColumn("threshold", F.col("threshold") * F.when(F.col("is_benign"), benign_scale).otherwise(1.0)), "cluster-losses")
    n = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    anchors = scaled.groupBy().agg(F.count_distinct("learner").alias("learners"), F.coalesce(F.max(F.col("is_benign").cast("int")),
        F.lit(0)).alias("anchored")).first()
    if not anchors["anchored"]:
        out = n.withColumns({c: F.lit(None).cast("double") for c in FIGURES})
        return out.select("cluster", "n", *FIGURES, F.array(F.lit("no_benign_anchor_skip")).alias("reasons"), F.lit(True).alias("passed"))
    out = n.join(benign_figures(rows, scaled, gate.soft_k), "cluster", "left")
    large = lambda least: rows.join(F.broadcast(n.where(F.col("n") >= least).select("cluster")), "cluster", "left_semi")  # noqa: E731  a row for each cluster
    none = [F.lit(None).cast("double").alias(c) for c in FIGURES]
    if gate.structure:
        out = out.join(split_figures(large(gate.structure_rows), features, gate.rounds).drop("n"), "cluster", "left")
    else:
        out = out.select("*", *none[4:7])
    if gate.routes and anchors["learners"] >= 2:
        out = out.join(route_figures(large(gate.route_rows), scaled), "cluster", "left")
    else:
        out = out.select("*", *none[7:])
    c = F.col
    tests = [
        c("benign_accept_rate") > gate.most_accept, c("benign_prob_mean") > gate.most_prob, c("benign_prob_p90") > gate.most_p90,
        F.lit(gate.mixed) & (c("benign_prob_p10") < gate.mixed_low) & (c("benign_prob_p90") > gate.mixed_high),
        (c("structure_child_ratio") >= gate.least_child) & (c("structure_silhouette") >= gate.least_silhouette) & (c("structure_split_gain") >= gate.least_gain),
        (c("route_multi_accept_ratio") >= gate.least_multi) & (c("route_top1_share") <= gate.most_top1),
    ]
    reasons = F.array_compact(F.array(*[F.when(t, name) for t, name in zip(tests, REASONS, strict=True)]))
    out = keep(out.withColumn("reasons", reasons).select("cluster", "n", *FIGURES, "reasons", (F.size("reasons") == 0).alias("passed")), "judged")
    discard(rows, scaled)
    return out


FIGURES = ["benign_accept_rate", "benign_prob_mean", "benign_prob_p10", "benign_prob_p90", "structure_child_ratio", "structure_split_gain",
    "structure_silhouette", "route_multi_accept_ratio", "route_top1_share"]
