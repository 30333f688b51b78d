"""Detection quality: risk of assignments, ROC and precision-recall curves, AUC by ranks, class reports, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions.labels import is_benign
from flowlens.functions.stats import share
from flowlens.session import keep

from .aggregates import group_profile
from .quantiles import exact_quantiles, running_counts


def assignment_risk(assigned: DataFrame, label: str = "label", unknown: str = "UNKNOWN") -> DataFrame:
    """fp, benign, miss, attack, fpr, fnr: a learner is benign or attack by its most frequent label (ties: the smallest).
    Benign rows in attack learners are false positives, of the benign rows outside UNKNOWN; attacks in benign learners or in
    UNKNOWN are misses. A rate without a base is 0."""
    n = group_profile(assigned, "learner", label)
    known, benign = F.col("learner") != unknown, is_benign(F.col("dominant_label"))
    zero = lambda test, c: F.coalesce(F.sum(F.when(test, F.col(c)).otherwise(0)), F.lit(0))
    sums = n.agg(zero(known & ~benign, "benign").alias("fp"), zero(known, "benign").alias("benign"), zero(~known | benign, "attack").alias("miss"),
        F.coalesce(F.sum("attack"), F.lit(0)).alias("attack"))
    return sums.select("fp", "benign", "miss", "attack", share(F.col("fp"), F.col("benign")).alias("fpr"), share(F.col("miss"), F.col("attack")).alias("fnr"))


def auc(scored: DataFrame, group: list[str], score: str, positive: str, rows: str | None = None) -> DataFrame:
    """AUC from average ranks per group, computed on counts of equal scores; and the larger of it and 1 - it. Groups without
    both classes are left out. rows: a column that says how many rows a row stands for."""
    w = F.lit(1).cast("long") if rows is None else F.col(rows)
    n = scored.groupBy(*group, F.col(score).alias("s")).agg(F.sum(F.col(positive).cast("long") * w).alias("p"), F.sum((1 - F.col(positive).cast("long")) *
        w).alias("q"))
    n = running_counts(n, group, "s", ["q"]).withColumn("_won", F.col("p") * (F.col("q_before") + F.col("q") / 2))
    out = n.groupBy(*group).agg(F.sum("_won").alias("_w"), F.sum("p").alias("_p"), F.sum("q").alias("_q")).where("_p > 0 and _q > 0")
    value = F.col("_w") / (F.col("_p") * F.col("_q"))
    return out.select(*group, value.alias("auc"), F.greatest(value, 1 - value).alias("oriented_auc"))


def curve(scored: DataFrame, score: str, positive: str) -> DataFrame:
    """threshold, tp, fp, tpr, fpr, precision at every distinct score. Scores are first counted; running counts come by ranges, so
    no task orders all scores."""
    n = scored.groupBy(F.col(score).alias("threshold")).agg(F.sum(F.col(positive).cast("long")).alias("p"), F.sum(1 - F.col(positive).cast("long")).alias("q"))
    n = running_counts(n, [], "threshold", ["p", "q"])
    total = n.agg(F.sum("p").alias("_tp"), F.sum("q").alias("_tq"))
    out = n.join(F.broadcast(total), how="cross")  # one row
    tp, fp = F.col("_tp") - F.col("p_before"), F.col("_tq") - F.col("q_before")
    return out.select("threshold", tp.alias("tp"), fp.alias("fp"), (tp / F.col("_tp")).alias("tpr"), (fp / F.col("_tq")).alias("fpr"), (tp / (tp +
        fp)).alias("precision"))


def threshold_for_fpr(points: DataFrame, targets: list[float]) -> DataFrame:
    """For each target the threshold with the most tp whose fpr is within it."""
    t = points.sparkSession.createDataFrame([(x,) for x in targets], "target double")
    ok = points.join(F.broadcast(t), F.col("fpr") <= F.col("target"))
    return ok.groupBy("target").agg(F.min_by("threshold", F.struct(-F.col("tp"), F.col("fp"), -F.col("threshold"))).alias("threshold"), F.max("tp").alias("tp"))


def class_report(rows: DataFrame, truth: str, guess: str, count: str | None = None) -> DataFrame:
    """precision, recall, f1, support of each class. count: a column that says how many rows a row stands for."""
    n = rows.groupBy(F.col(truth).alias("t"), F.col(guess).alias("g")).agg((F.count(F.lit(1)) if count is None else F.sum(count)).alias("n"))
    t = n.groupBy(F.col("t").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("t") == F.col("g"), F.col("n")).otherwise(0)).alias("hit"))
    g = n.groupBy(F.col("g").alias("class")).agg(F.sum("n").alias("guessed"))
    out = t.join(g, "class", "full").na.fill(0, ["support", "hit", "guessed"])
    p, r = F.when(F.col("guessed") > 0, F.col("hit") / F.col("guessed")).otherwise(0.0), F.when(F.col("support") > 0,
        F.col("hit") / F.col("support")).otherwise(0.0)
    return out.select("class", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"), "support")


def risk_band(score: Column) -> Column:
    return F.when(score.isNull() | F.isnan(score), "UNKNOWN").when(score >= 0.75, "HIGH").when(score >= 0.45, "MEDIUM").otherwise("LOW")


def learner_risk(losses: DataFrame, assigned: DataFrame, overlap: DataFrame, stable: DataFrame, benign_scale: float = 1.0, k: float = 4.0,
    size_scale: float = 5000.0) -> DataFrame:
    """Risk of each learner from how the rows assigned to it are taken, without labels, in three versions with bands.

    losses: row_index, learner, loss, threshold, is_benign. assigned: row_index, assigned_learner. overlap: learner,
    overlap_risk. stable: learner, stability. A benign learner's threshold is scaled. What can't be measured is null and counts
    as 0.5 (as 1 for the share over the own threshold), learners without overlap or stability as 0.
    """
    threshold = F.col("threshold") * F.when(F.col("is_benign"), benign_scale).otherwise(1.0)
    margin = (threshold - F.col("loss")) / (F.abs(threshold) + 1e-12)
    of = assigned.select("row_index", F.col("assigned_learner").alias("_to"))
    mine = F.col("learner") == F.col("_to")
    rows = of.join(losses.select("row_index", "learner", "loss", threshold.alias("_t"), F.when(F.col("is_benign"), margin).alias("_b")), "row_index", "left")
    rows = rows.groupBy("row_index", F.col("_to").alias("learner")).agg(F.max(F.when(mine, F.col("loss"))).alias("loss"), F.max(F.when(mine,
        F.col("_t"))).alias("_t"), F.max("_b").alias("_m"))
    rows = keep(rows.withColumn("_p", 1 / (1 + F.exp(-k * F.col("_m")))), "risk-rows")  # a row for each assigned row; all below reads it
    sums = rows.groupBy("learner").agg(
        F.count(F.lit(1)).alias("n"), F.max("_t").alias("own_threshold"), F.avg("loss").alias("own_loss_mean"),
            F.avg((F.col("loss") > F.col("_t")).cast("double")).alias("own_exceed_rate"),
        F.avg((F.col("_m") >= 0).cast("double")).alias("benign_accept_rate"), F.avg("_p").alias("benign_prob_mean"),
    )
    long = rows.select("learner", F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).alias("x")) for c in ("loss", "_p",
        "_m")])).alias("v")).select("learner", "v.*")
    at = exact_quantiles(long, ["learner", "what"], "x", [0.1, 0.5, 0.9, 0.95, 0.99]).groupBy("learner").agg(*[F.max(F.when(F.col("what") == c,
        F.col("q"))).alias(f"_q{c}") for c in ("loss", "_p", "_m")])
    whole = sums.agg(F.sum("n").alias("_all"))
    out = sums.join(F.broadcast(whole), how="cross").join(at, "learner", "left").join(overlap, "learner", "left").join(stable, "learner", "left")
    out = out.withColumns({"benign_prob_p10": F.col("_q_p")[0], "benign_margin_median": F.col("_q_m")[1], "benign_margin_p10": F.col("_q_m")[0],
        "_q": F.slice("_qloss", 2, 4)}).drop("_q_p", "_q_m", "_qloss")
    q = lambda i: F.col("_q")[i]
    less = lambda c, unknown: F.coalesce(1 - F.col(c), F.lit(unknown))
    out = out.withColumns({"assignment_share": F.col("n") / F.col("_all"), "own_loss_median": q(0), "own_loss_p95": q(2),
        "tail_heaviness": (q(3) - q(1)) / (F.abs(q(1) - q(0)) + 1e-12)})
    exceed = F.coalesce("own_exceed_rate", F.lit(1.0))
    margin_risk = F.coalesce(1 / (1 + F.exp(4 * F.col("benign_margin_median"))), F.lit(0.5))
    tail = F.coalesce(1 / (1 + F.exp(-1.5 * (F.col("tail_heaviness") - 2))), F.lit(0.5))
    out = out.withColumns({
        "risk_score": 0.55 * less("benign_accept_rate", 0.5) + 0.3 * exceed + 0.15 * margin_risk,
        "risk_score_v2": 0.7 * less("benign_prob_mean", 0.5) + 0.2 * exceed + 0.1 * margin_risk,
        "risk_benign_v3": 0.65 * less("benign_prob_mean", 0.5) + 0.35 * less("benign_prob_p10", 0.5),
        "risk_self_v3": 0.6 * exceed + 0.4 * tail,
        "risk_overlap_v3": F.coalesce("overlap_risk", F.lit(0.0)),
        "risk_stability_v3": F.coalesce("stability", F.lit(0.0)),
        "size_confidence": 1 - F.exp(-F.col("n") / size_scale),
    })
    out = out.withColumn("risk_size_v3", 1 - F.col("size_confidence"))
    out = out.withColumn("risk_score_v3_raw", 0.35 * F.col("risk_benign_v3") + 0.25 * F.col("risk_self_v3") + 0.2 * F.col("risk_overlap_v3") +
        0.15 * F.col("risk_stability_v3") + 0.05 * F.col("risk_size_v3"))
    out = out.withColumn("risk_score_v3", 0.5 + F.col("size_confidence") * (F.col("risk_score_v3_raw") - 0.5))  # small learners are drawn to 0.5
    out = keep(out, "risks")  # a row for each learner
    cuts = out.agg(F.expr("percentile(risk_score_v3, array(0.5D, 0.8D))").alias("_c"))  # a row for each learner
    out = out.join(F.broadcast(cuts), how="cross")
    out = out.withColumns({
        "risk_band": risk_band(F.col("risk_score")), "risk_band_v2": risk_band(F.col("risk_score_v2")), "risk_band_v3": risk_band(F.col("risk_score_v3")),
        "risk_band_v3_quantile": F.when(F.col("risk_score_v3") >= F.col("_c")[1], "HIGH").when(F.col("risk_score_v3") >= F.col("_c")[0],
            "MEDIUM").otherwise("LOW"),
    })
    return out.drop("_q", "_c", "_all", "overlap_risk", "stability")


#: Fixed: the behaviour rules' limits, on what port_stats and temporal_stats find.
BURST, SCAN_SHARE, SCAN_PORTS, FLOOD_SHARE, FLOOD_PORTS, WIDE_ENTROPY = 0.5, 0.15, 200, 0.9, 3, 0.85


def behaviour_rules() -> dict[str, Column]:
    """Rules over a learner's burst, top_share, ports and entropy, by name."""
    burst = F.col("burst") >= BURST
    scan, flood = (F.col("top_share") < SCAN_SHARE) & (F.col("ports") >= SCAN_PORTS), (F.col("top_share") > FLOOD_SHARE) & (F.col("ports") <= FLOOD_PORTS)
    port = scan | flood | (F.col("entropy") > WIDE_ENTROPY)
    return {"temporal_burst_score>=0.5": burst, "port_scan_like": scan, "port_single_port": flood, "port_scan_or_flood_or_high_entropy": port,
        "temporal_burst OR port_attack": burst | port}


def rule_table(profiles: DataFrame, tests: dict[str, Column], name: str = "learner") -> DataFrame:
    """A row for each test: counts, precision and recall against learners of attack_ratio 0.5 or more (attack) and under 0.1
    (benign); those between count for neither. Names of the wrong ones in order, joined by a comma; without a base a rate is 0."""
    attack, benign = F.col("attack_ratio") >= 0.5, F.col("attack_ratio") < 0.1
    rows = profiles.select(name, attack.alias("_a"), benign.alias("_b"), F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.coalesce(t,
        F.lit(False)).alias("hit")) for k, t in tests.items()])).alias("p")).select(name, "_a", "_b", "p.*")
    n = lambda t: F.sum(t.cast("long"))
    names = lambda t: F.concat_ws(",", F.array_sort(F.collect_list(F.when(t, F.col(name)))))
    hit = F.col("hit")
    out = rows.groupBy("rule").agg(
        n(hit & F.col("_a")).alias("tp"), n(hit & F.col("_b")).alias("fp"), n(~hit & F.col("_a")).alias("fn"), n(~hit & F.col("_b")).alias("tn"),
        names(hit & F.col("_b")).alias("false_positives"), names(~hit & F.col("_a")).alias("false_negatives"),
    )
    return out.withColumns({"precision": share(F.col("tp"), F.col("tp") + F.col("fp")), "recall": share(F.col("tp"), F.col("tp") + F.col("fn"))})


def separability(rows: DataFrame, features: list[str], positive: str) -> DataFrame:
    """For each feature the AUC of the positive class (and the larger of it and 1 - it), and the mean and median of each class."""
    parts = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in features])
    long = rows.select(F.col(positive).cast("int").alias("y"), F.explode(parts).alias("p")).select("y", "p.*").where("x is not null and not isnan(x)")
    median = exact_quantiles(long, ["feature", "y"], "x", [0.5])
    means = long.groupBy("feature", "y").agg(F.avg("x").alias("mean")).join(median, ["feature", "y"])
    side = lambda y, c: F.max(F.when(F.col("y") == y, c))
    sides = means.groupBy("feature").agg(*[side(y, c).alias(f"{name}_{of}") for y, of in ((1, "positive"), (0, "negative")) for name, c in (("mean",
        F.col("mean")), ("median", F.col("q")[0]))])
    return auc(long, ["feature"], "x", "y").join(sides, "feature")


def robustness(results: DataFrame, keys: list[str], score: str = "auc") -> DataFrame:
    """How a feature does over runs: run_count, mean, median, population deviation, least and greatest score, and the shares of runs
    with at least 0.80, 0.90 and 0.95."""
    x = F.col(score)
    shares = [F.avg((x >= t).cast("double")).alias(f"share_{int(100 * t)}") for t in (0.80, 0.90, 0.95)]
    return results.groupBy(*keys).agg(F.count(F.lit(1)).alias("run_count"), F.avg(x).alias("auc_mean"), F.expr(f"percentile({score}, "
        f"0.5D)").alias("auc_median"), F.stddev_pop(x).alias("auc_std"), F.min(x).alias("auc_min"), F.max(x).alias("auc_max"), *shares)


def fit_trace(fits: DataFrame, train: str = "epoch_losses", validation: str = "epoch_val_losses") -> DataFrame:
    """fits with the number of epochs, first, last, least and greatest finite loss of training and validation, and the gap of the
    last ones; what there is none of is null. The losses are arrays of doubles."""
    out = {}
    for name, c in (("epoch", train), ("epoch_val", validation)):
        sound = F.filter(F.coalesce(F.col(c), F.array().cast("array<double>")), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        at = lambda i, a=sound: F.try_element_at(a, F.lit(i))
        out |= {f"{name}_count": F.coalesce(F.size(c), F.lit(0)), f"{name}_loss_first": at(1), f"{name}_loss_last": at(-1),
            f"{name}_loss_min": F.array_min(sound), f"{name}_loss_max": F.array_max(sound)}
    return fits.withColumns(out).withColumn("overfit_gap_last", F.col("epoch_val_loss_last") - F.col("epoch_loss_last"))


def increment_trace_stats(losses: DataFrame, keys: list[str], before: str = "before", after: str = "after") -> DataFrame:
    """Mean, median and 0.95 quantile of the losses before and after an increment, and the changes of mean and quantile."""
    out = losses.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"{c}_loss_mean") for c in (before, after)])
    long = losses.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("_side"), F.col(c).alias("_x")) for c in (before,
        after)])).alias("_v")).select(*keys, "_v.*")
    q = exact_quantiles(long, [*keys, "_side"], "_x", [0.5, 0.95])
    of = lambda c, k: F.max(F.when(F.col("_side") == c, F.col("q")[k]))
    out = out.join(q.groupBy(*keys).agg(*[of(c, k).alias(f"{c}_loss_{name}") for c in (before, after) for k, name in enumerate(("median", "p95"))]), keys)
    return out.withColumns({f"{name}_change": F.col(f"{after}_loss_{name}") - F.col(f"{before}_loss_{name}") for name in ("mean", "p95")})


def run_row(metrics: DataFrame) -> DataFrame:
    """A run's indicators for the comparison page: fpr, fnr, tpr = 1 - fnr, and averages per window (0 without windows)."""
    per = lambda c: F.when(F.col("windows") > 0, F.col(c) / F.col("windows")).otherwise(0.0)
    rate = F.when(F.col("seconds") > 0, F.col("rows") / F.col("seconds"))
    return metrics.select("run", "fpr", "fnr", (1 - F.col("fnr")).alias("tpr"), "windows", per("seconds").alias("avg_window_s"),
        per("rows").alias("avg_window_rows"), rate.alias("flows_per_s"))
