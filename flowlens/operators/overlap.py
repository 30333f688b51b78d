"""Acceptance, routing and overlap of learners, from a table of losses: row_index, learner, loss, threshold, is_benign."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .topology import components


def accepted(losses: DataFrame, benign_scale: float = 1.0) -> DataFrame:
    """Rows of losses that the learner accepts; a benign learner's threshold is scaled by benign_scale within 0 to 1."""
    scale = F.when(F.col("is_benign"), max(0.0, min(1.0, benign_scale))).otherwise(1.0)
    return losses.where(F.col("loss") <= F.col("threshold") * scale)


def route(losses: DataFrame, benign_scale: float = 1.0, uniform: bool = False) -> DataFrame:
    """row_index, assigned_learner, n_accepted: learners that aren't benign first, the least loss among them; else the benign
    one of least loss; else UNKNOWN. uniform: the least loss of all that accept. Ties go to the smaller name."""
    rank = F.struct(F.lit(False) if uniform else F.col("is_benign"), "loss", "learner")
    won = accepted(losses, benign_scale).groupBy("row_index").agg(F.min(rank).alias("_w"), F.count(F.lit(1)).alias("n_accepted"))
    rows = losses.select("row_index").distinct()
    return rows.join(won, "row_index", "left").select("row_index", F.coalesce("_w.learner", F.lit("UNKNOWN")).alias("assigned_learner"),
        F.coalesce("n_accepted", F.lit(0)).alias("n_accepted"))


def pair_counts(acc: DataFrame) -> DataFrame:
    """learner_a < learner_b and how many rows both accept; pairs are formed within a row's few accepting learners."""
    names = acc.groupBy("row_index").agg(F.array_sort(F.collect_set("learner")).alias("_l")).where(F.size("_l") > 1)
    pairs = names.select(F.posexplode("_l").alias("_i", "learner_a"), "_l").select("learner_a", F.explode(F.expr("slice(_l, _i + 2, "
        "size(_l))")).alias("learner_b"))
    return pairs.groupBy("learner_a", "learner_b").agg(F.count(F.lit(1)).alias("both"))


def jaccard(acc: DataFrame) -> DataFrame:
    """All pairs of learners with counts, intersection, union, Jaccard and both acceptance rates."""
    return jaccard_from_counts(acc.groupBy("learner").agg(F.count_distinct("row_index").alias("n")), pair_counts(acc))


def jaccard_from_counts(n: DataFrame, both: DataFrame) -> DataFrame:
    """jaccard() from counters: learner, n and learner_a, learner_b, both."""
    a, b = n.select(F.col("learner").alias("learner_a"), F.col("n").alias("count_a")), n.select(F.col("learner").alias("learner_b"),
        F.col("n").alias("count_b"))
    out = a.join(b, F.col("learner_a") < F.col("learner_b")).join(both, ["learner_a", "learner_b"], "left").withColumn("both", F.coalesce("both", F.lit(0)))
    union = F.col("count_a") + F.col("count_b") - F.col("both")
    return out.withColumns({"either": union, "jaccard": F.when(union > 0, F.col("both") / union).otherwise(0.0),
        "a_to_b": F.col("both") / F.col("count_a"), "b_to_a": F.col("both") / F.col("count_b")})


def overlap_risk(pairs: DataFrame, limit: float = 0.1) -> DataFrame:
    """Per learner 0.7 of the mean of its three largest Jaccards and 0.3 of the share of those at the limit or more; pairs
    without overlap don't count."""
    both = pairs.where("jaccard > 0").select(F.explode(F.array(F.struct(F.col("learner_a").alias("learner"), F.col("learner_b").alias("other"),
        "jaccard"), F.struct(F.col("learner_b").alias("learner"), F.col("learner_a").alias("other"), "jaccard"))).alias("p")).select("p.*")
    ranked = both.withColumn("_r", F.row_number().over(Window.partitionBy("learner").orderBy(F.col("jaccard").desc(), "other")))
    return ranked.groupBy("learner").agg((0.7 * F.avg(F.when(F.col("_r") <= 3, F.col("jaccard"))) +
        0.3 * F.avg((F.col("jaccard") >= limit).cast("double"))).alias("overlap_risk"))


def label_similarity(counts: DataFrame, eps: float = 1e-12) -> DataFrame:
    """From learner, label, n: Jensen-Shannon similarity, cosine and shared mass of each pair's label distributions."""
    p = counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("learner")))
    names, labels = p.select("learner").distinct(), p.select("label").distinct()
    grid = names.crossJoin(labels).join(p, ["learner", "label"], "left").select("learner", "label", F.coalesce("p",
        F.lit(0.0)).alias("p"))  # learners x labels, no rows of data
    a, b = grid.select(F.col("learner").alias("learner_a"), "label", F.col("p").alias("p")), grid.select(F.col("learner").alias("learner_b"), "label",
        F.col("p").alias("q"))
    pair = a.join(b, "label").where("learner_a < learner_b")
    floor = lambda c: F.greatest(F.col(c), F.lit(eps))
    m = (floor("p") + floor("q")) / 2
    jsd = 0.5 * F.sum(floor("p") * F.ln(floor("p") / m)) + 0.5 * F.sum(floor("q") * F.ln(floor("q") / m))
    cosine = F.sum(F.col("p") * F.col("q")) / F.sqrt(F.sum(F.col("p") * F.col("p")) * F.sum(F.col("q") * F.col("q")))
    return pair.groupBy("learner_a", "learner_b").agg((1 - jsd).alias("js_similarity"), cosine.alias("cosine"), F.sum(F.least("p", "q")).alias("shared"))


def handoffs(assigned: DataFrame, order: str = "row_index", block: int = 100_000) -> DataFrame:
    """How often consecutive rows change between two learners, either way, and that over the smaller learner's rows.

    Rows are taken in blocks of consecutive index; a block's first row meets the last row of the block before, so the whole
    order is never in one task. The index must be gapless."""
    w = Window.partitionBy("_block").orderBy(order)
    rows = assigned.select(order, "learner").withColumn("_block", F.floor(F.col(order) / block))
    inner = rows.withColumn("_prev", F.lag("learner").over(w)).where(F.col("_prev").isNotNull()).select("_prev", "learner")
    firsts, lasts = rows.where(F.col(order) % block == 0), rows.where(F.col(order) % block == block - 1)
    seam = firsts.join(lasts.select((F.col(order) + 1).alias(order), F.col("learner").alias("_prev")), order).select("_prev", "learner")
    moved = inner.unionByName(seam).where("_prev <> learner")
    n = moved.groupBy(F.least("_prev", "learner").alias("learner_a"), F.greatest("_prev",
        "learner").alias("learner_b")).agg(F.count(F.lit(1)).alias("handoffs"))
    total = rows.groupBy("learner").agg(F.count(F.lit(1)).alias("n"))
    a, b = total.select(F.col("learner").alias("learner_a"), F.col("n").alias("_a")), total.select(F.col("learner").alias("learner_b"), F.col("n").alias("_b"))
    return n.join(a, "learner_a").join(b, "learner_b").select("learner_a", "learner_b", "handoffs", (F.col("handoffs") / F.least("_a", "_b")).alias("rate"))


def mutual_top(pairs: DataFrame, k: int, score: str = "jaccard") -> DataFrame:
    """Pairs in which each is among the other's k best; ties go to the smaller name."""
    both = pairs.select(F.explode(F.array(F.struct(F.col("learner_a").alias("x"), F.col("learner_b").alias("y"), F.col(score).alias("s")),
        F.struct(F.col("learner_b").alias("x"), F.col("learner_a").alias("y"), F.col(score).alias("s")))).alias("p")).select("p.*")
    best = both.withColumn("_r", F.row_number().over(Window.partitionBy("x").orderBy(F.col("s").desc(), "y"))).where(F.col("_r") <= k)
    back = best.select(F.col("y").alias("x"), F.col("x").alias("y"))
    return best.join(back, ["x", "y"]).where("x < y").select(F.col("x").alias("learner_a"), F.col("y").alias("learner_b"), F.col("s").alias(score))


def route_confidence(losses: DataFrame, assigned: DataFrame, benign_scale: float = 1.0, least_margin: float = 0.02, least_gap: float = 0.03) -> DataFrame:
    """Rows of assigned (row_index, assigned_learner) with own_margin, (threshold - loss) / |threshold| of their learner, gap, how
    far it is ahead of the best other learner's, and keep: both reach their limits. Where the learner has no losses, or there
    is no other, margin and gap are null and the row is kept."""
    scaled = F.col("threshold") * F.when(F.col("is_benign"), benign_scale).otherwise(1.0)
    margin = (scaled - F.col("loss")) / (F.abs(scaled) + 1e-12)
    all_ = assigned.join(losses.select("row_index", "learner", margin.alias("m")), "row_index", "left")
    own = F.col("learner") == F.col("assigned_learner")
    out = all_.groupBy("row_index", "assigned_learner").agg(F.max(F.when(own, F.col("m"))).alias("own_margin"), F.max(F.when(~own, F.col("m"))).alias("_other"))
    gap = F.col("own_margin") - F.col("_other")
    keep = F.coalesce((F.col("own_margin") >= least_margin) & (gap >= least_gap), F.lit(True))
    return out.select("row_index", F.col("assigned_learner").alias("learner"), F.when(gap.isNotNull(), F.col("own_margin")).alias("own_margin"),
        gap.alias("gap"), F.when(gap.isNull(), True).otherwise(keep).alias("keep"))


def confidence_by_learner(rows: DataFrame) -> DataFrame:
    """Of route_confidence per learner: n, kept, confident_ratio, and the 0.1 quantiles of margin and gap; null where there are none."""
    valid = F.col("gap").isNotNull()
    return rows.groupBy("learner").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("keep").cast("long")).alias("kept"), F.avg(F.when(valid,
            F.col("keep").cast("double"))).alias("confident_ratio"),
        F.expr("percentile(own_margin, 0.1D)").alias("own_margin_p10"), F.expr("percentile(gap, 0.1D)").alias("gap_p10"),
    )


def overlap_edges(pairs: DataFrame, least: float, top_k: int = 0, most: int = 0) -> DataFrame:
    """Pairs with a Jaccard above 0 and of at least `least`, the largest first, ties by name; top_k and then most of them, 0 is no
    limit."""
    kept = pairs.where((F.col("jaccard") > 0) & (F.col("jaccard") >= least))
    limits = [k for k in (top_k, most) if k > 0]
    return kept.orderBy(F.col("jaccard").desc(), "learner_a", "learner_b").limit(min(limits)) if limits else kept


def overlap_candidates(pairs: DataFrame, score: float, similarity: float, handoff: float) -> DataFrame:
    """Pairs that could be one learner: jaccard, js_similarity and rate (of handoffs) all reach their limits; a missing rate is 0."""
    return pairs.where((F.col("jaccard") >= score) & (F.col("js_similarity") >= similarity) & (F.coalesce("rate", F.lit(0.0)) >= handoff))


def mutual_components(pairs: DataFrame, k: int) -> DataFrame:
    """learner, owner: components over the pairs in which each is among the other's k best; a learner without one is its own. The
    owner is the smallest name."""
    names = pairs.select(F.explode(F.array("learner_a", "learner_b")).alias("x")).distinct()
    edge = mutual_top(pairs, k).select("learner_a", "learner_b").unionAll(names.select("x", "x"))
    found = components(edge.select(F.lit("all").alias("g"), F.col("learner_a").alias("src"), F.col("learner_b").alias("dst")), "g")
    return found.select(F.col("node").alias("learner"), F.col("component").alias("owner"))
