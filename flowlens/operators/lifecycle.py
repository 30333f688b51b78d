"""What decides how learners grow: gates before an increment, pools of past rows, refreshed thresholds, small learners,
communities. Gates are one ordered condition, so every row carries the reason it was left out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.labels import is_benign, label_year
from flowlens.functions.stats import clean
from flowlens.session import keep

from .quantiles import exact_quantiles, running_counts


@dataclass(frozen=True)
class Gate:
    """Limits of an increment. None, False or 0 switches a test off."""

    benign_confidence: float | None = 0.6
    freeze_benign: bool = False
    cooldown_windows: int = 0
    least_rows: int = 300
    by_gap: bool = False
    most_retrains: int = 0
    least_drift: float | None = None
    least_benign_prob: float | None = None
    most_exceed: float | None = None
    route_rows: int | None = None
    route_confident: float = 0.55


def batch_reason(gate: Gate) -> Column:
    """Why a learner's whole window trains nothing, without the cap on retrains; null if it trains. Reads of the batch: learner,
    is_benign, window_id, birth_window, kept (rows that pass the confidence test), and, for the tests that are on, latest and
    last_trained (row numbers), drift, benign_prob, exceed, confident_ratio and route_kept."""
    new = F.startswith("learner", F.lit("NEW_"))
    tests: list[tuple[str, Column]] = [("benign_conf_filter", F.col("kept") == 0)]
    if gate.freeze_benign:
        tests.append(("freeze_benign_incremental", F.col("is_benign")))
    if gate.cooldown_windows:
        tests.append(("new_learner_cooldown", new & (F.col("window_id") - F.col("birth_window") < gate.cooldown_windows)))
    if gate.by_gap:
        since = F.coalesce("last_trained", F.greatest(F.lit(0), F.col("latest") - gate.least_rows))
        tests.append(("increment_gap_not_met", F.col("latest") - since < gate.least_rows))
    else:
        tests.append(("increment_min_samples", F.col("kept") < gate.least_rows))
    if gate.most_retrains:
        tests.append(("max_retrain_per_learner", F.lit(False)))  # its place; gate_batches puts the test in
    if gate.least_drift is not None:
        tests.append(("increment_no_feature_drift", F.col("drift") < gate.least_drift))
    if gate.least_benign_prob is not None and gate.most_exceed is not None:
        tests.append(("increment_quality_gate", (F.col("benign_prob") < gate.least_benign_prob) & (F.col("exceed") > gate.most_exceed)))
    if gate.route_rows is not None:
        asked = new & (F.col("kept") >= gate.route_rows) & F.col("confident_ratio").isNotNull()
        tests.append(("increment_route_gate_batch_reject", asked & (F.col("confident_ratio") < gate.route_confident)))
        tests.append(("increment_route_gate_min_samples", asked & (F.col("route_kept") < gate.least_rows)))
    out = F.lit(None).cast("string")
    for name, test in reversed(tests):
        out = F.when(test, name).otherwise(out)
    return out


#: The batch tests that come before the cap on retrains.
BEFORE_CAP = ("benign_conf_filter", "freeze_benign_incremental", "new_learner_cooldown", "increment_gap_not_met", "increment_min_samples")


def gate_batches(batches: DataFrame, gate: Gate) -> DataFrame:
    """batches (a row for each learner and window) with reason, null for those that train. A learner's retrains before a window
    are its earlier windows that pass all other tests, so the cap needs only a running count."""
    out = batches.withColumn("reason", batch_reason(gate))
    if not gate.most_retrains:
        return out
    before = Window.partitionBy("learner").orderBy("window_id").rowsBetween(Window.unboundedPreceding, -1)
    done = F.coalesce(F.sum(F.col("reason").isNull().cast("long")).over(before), F.lit(0)) >= gate.most_retrains
    early = F.coalesce(F.col("reason").isin(*BEFORE_CAP), F.lit(False))
    return out.withColumn("_done", done).withColumn("reason", F.when(early, F.col("reason")).when(F.col("_done"),
        "max_retrain_per_learner").otherwise(F.col("reason"))).drop("_done")


def increment_trace(rows: DataFrame, gate: Gate) -> DataFrame:
    """learner, row_index, window_id, passed_confidence, reason ('' for rows that train). rows: learner, row_index, window_id,
    loss, threshold, is_benign, and of the first benign learner benign_loss and benign_threshold; benign_prob. A window's
    reason holds for all its rows; in a window that trains, a benign learner's rows above the confidence limit are left out."""
    sure = F.lit(True) if gate.benign_confidence is None else F.coalesce(~F.col("is_benign") | (F.col("benign_loss") <= F.col("benign_threshold") * gate.benign_confidence), F.lit(True))
    rows = rows.withColumn("passed_confidence", sure)
    of = lambda c: F.when(F.col("passed_confidence"), c)
    batches = rows.groupBy("learner", "window_id").agg(
        F.max("is_benign").alias("is_benign"), F.sum(F.col("passed_confidence").cast("long")).alias("kept"), F.max("row_index").alias("latest"),
        F.avg(of((F.col("loss") > F.col("threshold")).cast("double"))).alias("exceed"), F.avg(of(F.col("benign_prob"))).alias("benign_prob"),
    )
    batches = batches.withColumn("birth_window", F.min("window_id").over(Window.partitionBy("learner")))
    gated = gate_batches(batches, gate).select("learner", "window_id", "reason")
    out = rows.join(gated, ["learner", "window_id"])
    return out.select("learner", "row_index", "window_id", "passed_confidence", F.coalesce("reason", F.when(~F.col("passed_confidence"),
        "benign_conf_filter").otherwise("")).alias("reason"))


def drift_scores(pool: DataFrame, rows: DataFrame, features: list[str], least: int) -> DataFrame:
    """learner, drift: how far new rows lie from the pool: 0.7 of the mean |change of mean| and 0.3 of the mean |change of deviation|, each
    over the pool's deviation + 1e-6. Learners with fewer than `least` pooled rows, or without new ones, have none."""
    of = lambda df, side: df.select("learner", F.lit(side).alias("_side"), *[clean(F.col(f"`{c}`").cast("double")).alias(f"_f{k}") for k,
        c in enumerate(features)])
    both, wide = of(pool, "old").unionByName(of(rows, "new")), range(len(features))
    stat = lambda f, side, k: f(F.when(F.col("_side") == side, F.col(f"_f{k}"))).alias(f"_{f.__name__}_{side}_{k}")
    n = both.groupBy("learner").agg(F.count(F.when(F.col("_side") == "old", 1)).alias("_old"), F.count(F.when(F.col("_side") == "new",
        1)).alias("_new"), *[stat(f, side, k) for f in (F.avg, F.stddev_pop) for side in ("old", "new") for k in wide])
    shift = lambda f: sum((F.abs(F.col(f"_{f}_new_{k}") - F.col(f"_{f}_old_{k}")) / (F.col(f"_stddev_pop_old_{k}") + 1e-6) for k in wide),
        F.lit(0.0)) / len(features)
    return n.where((F.col("_old") >= least) & (F.col("_new") > 0)).select("learner", (0.7 * shift("avg") + 0.3 * shift("stddev_pop")).alias("drift"))


def newest(rows: DataFrame, group: str, order: str, cap: int) -> DataFrame:
    """A pool of the newest `cap` rows of each group; order tells the rows of a group apart. No task orders a group."""
    placed = running_counts(rows.withColumn("_one", F.lit(1).cast("long")), [group], order, ["_one"])
    n = placed.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    return placed.join(n, group).where(F.col("_one_before") >= F.col("_n") - cap).drop("_one", "_one_before", "_n")


def refreshed_threshold(new: DataFrame, pool: DataFrame, group: str, loss: str, quantile: float) -> DataFrame:
    """The quantile of a group's new and pooled losses together."""
    both = new.select(group, loss).unionByName(pool.select(group, loss))
    q = exact_quantiles(both, [group], loss, [quantile]).select(group, F.col("q")[0].alias("threshold"))
    return q.join(both.groupBy(group).agg(F.count(F.lit(1)).alias("n")), group)


def small_learners(assigned: DataFrame, least: int, trigger: int) -> DataFrame:
    """New learners under `least` rows, if there are more than `trigger` of them; their rows go back to the unknown."""
    n = assigned.where(F.startswith("learner", F.lit("NEW_"))).groupBy("learner").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < least)
    many = n.agg((F.count(F.lit(1)) > trigger).alias("_many"))
    return n.join(F.broadcast(many), how="cross").where("_many").drop("_many")  # one row


def label_communities(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """node, community by label propagation over a, b, weight: each round a node takes the label of most weight around it, its
    own counting as the smallest edge; ties go to the smaller label. Every round is a table."""
    both = edges.select("a", "b", "weight").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")).where("a <> b")
    both = keep(both, "both-ways")
    labels = both.select(F.col("a").alias("node")).distinct().withColumn("community", F.col("node"))
    for _ in range(rounds):
        votes = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"), "community").agg(F.round(F.sum("weight"), 9).alias("w"))
        best = votes.groupBy("node").agg(F.min_by("community", F.struct(-F.col("w"), F.col("community"))).alias("community"))
        labels = keep(best, "communities")
    return labels


def initial_rows(rows: DataFrame, ratio: float, least: int = 5000, benign_only: bool = True, year: str = "", count: int = 0, least_class: int = 1) -> DataFrame:
    """The rows (row_index from 0 without gaps, label and more) that the first learners are made of.

    The first max(floor(n * ratio), least) rows, but not the last row; with `count` benign rows wanted, as far as the count-th of them.
    benign_only leaves benign rows, of one year if named, and the first `count` of them. Labels with fewer than least_class rows go."""
    n = rows.count()
    end = min(max(int(n * ratio), least), max(0, n - 1))
    wanted = is_benign(F.col("label")) & (label_year(F.col("label")) == year if year else F.lit(True))
    if benign_only and count > 0:
        able = rows.where(wanted).select("row_index", F.lit(0).alias("_g"), F.lit(1).cast("long").alias("_one"))
        last = running_counts(able, ["_g"], "row_index",
            ["_one"]).where(F.col("_one_before") < count).agg(F.max("row_index")).first()[0]  # of the first `count`
        if last is not None:
            end = min(max(end, last + 1), n - 1)
            wanted = wanted & (F.col("row_index") <= last)
    first = rows.where(F.col("row_index") < end)
    first = first.where(wanted) if benign_only else first
    large = first.groupBy("label").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least_class).select("label")
    return first.join(F.broadcast(large), "label", "left_semi")  # a row for each label
