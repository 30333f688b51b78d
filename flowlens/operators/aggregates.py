"""Profiles of groups of flows: labels, protocols, ports, times, features. Each is one or two aggregations with partial
sums, so a group that holds most rows costs its task no more than its distinct keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.labels import is_benign
from flowlens.functions.stats import share

from .quantiles import running_counts


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """label, n, ratio."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("_t"))
    return n.join(F.broadcast(total), how="cross").select(label, "n", (F.col("n") / F.col("_t")).alias("ratio"))


def feature_profile(df: DataFrame, group: list[str], features: list[str]) -> DataFrame:
    """mean, sample deviation and |deviation / mean| of each feature; undefined ones are 0."""
    out = []
    for c in features:
        mean, std = F.avg(c), F.coalesce(F.stddev_samp(c), F.lit(0.0))
        cv = F.when(F.coalesce(mean, F.lit(0.0)) == 0, 0.0).otherwise(F.abs(std / mean))
        out += [F.coalesce(mean, F.lit(0.0)).alias(f"{c}__mean"), std.alias(f"{c}__std"), cv.alias(f"{c}__cv")]
    return df.groupBy(*group).agg(*out)


def protocol_mix(df: DataFrame, group: str, protocol: str = "protocol") -> DataFrame:
    """Shares of TCP, UDP and the rest, the larger of the first two, and the class."""
    n = F.count(F.lit(1))
    of = lambda test: F.sum(F.coalesce(test, F.lit(False)).cast("long"))
    mix = df.groupBy(group).agg(n.alias("n"), share(of(F.col(protocol) == 6), n).alias("tcp"), share(of(F.col(protocol) == 17), n).alias("udp"))
    mix = mix.withColumn("other", F.round(1 - F.col("tcp") - F.col("udp"), 12)).withColumn("concentration", F.greatest("tcp", "udp"))
    kind = F.when(F.col("tcp") >= 0.8, "TCP_CLUSTER").when(F.col("udp") >= 0.8, "UDP_CLUSTER").when(F.col("other") >= 0.6,
        "OTHER_CLUSTER").otherwise("MIXED_CLUSTER")
    return mix.withColumn("kind", kind)


def _counts_entropy(n: Column) -> Column:
    """Aggregate: entropy of counts over ln of how many there are, from sums alone; 0 for one count or none."""
    kinds, total = F.count(n), F.sum(n)
    return F.when(kinds > 1, (F.ln(total) - F.sum(n * F.ln(n)) / total) / F.ln(F.greatest(kinds, F.lit(2)))).otherwise(0.0)


def port_stats(df: DataFrame, group: str, target: str = "dst_port", source: str = "src_port") -> DataFrame:
    """Of the target ports their number of rows, distinct ones, normal entropy, concentration (1 - entropy), sum of squared
    shares, and the top port (ties: the smallest; 0 without ports) with its share; of the source ports entropy and distinct
    ones; and the class of the group. Ports that are null don't count."""
    parts = F.array(F.struct(F.lit("t").alias("side"), F.col(target).cast("long").alias("port")), F.struct(F.lit("s").alias("side"),
        F.col(source).cast("long").alias("port")))
    n = df.select(group, F.explode(parts).alias("p")).groupBy(group, "p.side", "p.port").agg(F.count(F.lit(1)).alias("n"))
    n = n.withColumn("n", F.when(F.col("port").isNotNull(), F.col("n")))
    of = lambda side: F.when(F.col("side") == side, F.col("n"))
    t = of("t")
    out = n.groupBy(group).agg(
        F.coalesce(F.sum(t), F.lit(0)).alias("n"), F.count(t).alias("ports"), _counts_entropy(t).alias("entropy"),
            F.coalesce(F.sum(t * t) / (F.sum(t) * F.sum(t)), F.lit(0.0)).alias("hhi"),
        F.max(F.struct(t.alias("n"), (-F.col("port")).alias("port"))).alias("_top"), F.coalesce(F.max(t) / F.sum(t), F.lit(0.0)).alias("top_share"),
        _counts_entropy(of("s")).alias("source_entropy"), F.count(of("s")).alias("source_ports"),
    )
    kind = F.when(F.col("ports") <= 0, "UNKNOWN").when((F.col("top_share") < 0.15) & (F.col("ports") >= 200),
        "PORT_SCAN_LIKE").when((F.col("top_share") > 0.9) & (F.col("ports") <= 3), "SINGLE_PORT").otherwise("SERVICE_LIKE")
    top = F.when(F.col("_top.n").isNotNull(), -F.col("_top.port")).otherwise(F.lit(0)).cast("long")
    return out.select(group, "n", "ports", "entropy", F.when(F.col("n") > 0, 1 - F.col("entropy")).otherwise(0.0).alias("concentration"), "hhi",
        top.alias("top_port"), "top_share", "source_entropy", "source_ports", kind.alias("kind"))


def temporal_stats(df: DataFrame, group: str, time: str = "ts", bins: int = 256) -> DataFrame:
    """Rows with a time, their span and its share of the whole table's span; over `bins` equal bins of the whole span the sum
    of squared shares, the entropy over the occupied ones and 1 less it; the burst score and the class. Rows without a time
    don't count; a group of only such rows is EMPTY with zeros. Without any time there are no rows."""
    us = F.unix_micros(F.col(time).cast("timestamp"))
    whole = df.agg(F.min(us).alias("_w0"), F.max(us).alias("_w1")).where("_w0 is not null")
    rows = df.select(group, us.alias("_t")).join(F.broadcast(whole), how="cross")  # one row
    at = F.when(F.col("_w1") == F.col("_w0"), bins - 1).otherwise(F.least(F.lit(bins - 1),
        F.floor((F.col("_t") - F.col("_w0")) * bins / (F.col("_w1") - F.col("_w0")))))
    n = rows.groupBy(group, F.when(F.col("_t").isNotNull(), at).alias("_bin")).agg(F.count("_t").alias("_n"), F.min("_t").alias("_low"),
        F.max("_t").alias("_high"), F.first("_w0").alias("_w0"), F.first("_w1").alias("_w1"))
    c = F.when(F.col("_bin").isNotNull(), F.col("_n"))
    out = n.groupBy(group).agg(
        F.sum("_n").alias("n"), ((F.max("_high") - F.min("_low")) / 1e6).alias("_span"), ((F.first("_w1") - F.first("_w0")) / 1e6).alias("_all"),
        F.coalesce(F.sum(c * c) / (F.sum(c) * F.sum(c)), F.lit(0.0)).alias("hhi"), _counts_entropy(c).alias("entropy"),
    )
    span = F.coalesce("_span", F.lit(0.0))
    part = F.when(F.col("_all") > 0, span / F.col("_all")).otherwise(0.0)
    full = F.col("n") > 0
    kind = F.when(~full, "EMPTY").when((part < 1e-3) & (F.col("hhi") >= 0.5), "SHORT_BURST").when(part >= 0.01, "LONG_SPAN").otherwise("MEDIUM_SPAN")
    of = lambda x: F.when(full, x).otherwise(0.0)
    return out.select(
        group, "n", span.alias("span_s"), of(part).alias("span_ratio"), "hhi", "entropy", of(1 - F.col("entropy")).alias("concentration"),
        of(0.5 * (1 - F.least(part, F.lit(1.0))) + 0.5 * F.col("hhi")).alias("burst"), kind.alias("kind"),
    )


def stability(df: DataFrame, group: str, index: str, size: int) -> DataFrame:
    """How unevenly a group's rows lie over windows of `size` rows, 0 to 1: of the counts in all windows, zeros included, the
    deviation over the mean (0.6) and the 0.95 quantile over the mean (0.4), each as 1 - exp(-x). Rows with an index below 0
    don't count."""
    n = df.where(F.col(index) >= 0).groupBy(group, F.floor(F.col(index) / size).alias("_w")).agg(F.count(F.lit(1)).alias("_n"))
    windows = n.agg((F.max("_w") + 1).alias("_all"))
    n = n.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy("_n")))  # a row for each window
    per = n.groupBy(group).agg(F.count(F.lit(1)).alias("_k"), F.sum("_n").alias("_s"), F.sum(F.col("_n") * F.col("_n")).alias("_q"),
        F.map_from_entries(F.collect_list(F.struct("_rank", "_n"))).alias("_at"))
    per = per.join(F.broadcast(windows), how="cross")
    place = 0.95 * (F.col("_all") - 1)
    value = lambda i: F.coalesce(F.try_element_at("_at", (i - (F.col("_all") - F.col("_k")) + 1).cast("int")), F.lit(0))
    high = value(F.floor(place)) + (place - F.floor(place)) * (value(F.ceil(place)) - value(F.floor(place)))
    mean = F.col("_s") / F.col("_all")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("_q") / F.col("_all") - mean * mean))
    risk = lambda x: 1 - F.exp(-F.greatest(x, F.lit(0.0)))
    out = 0.6 * risk(spread / (mean + 1e-9)) + 0.4 * risk(high / (mean + 1e-9) - 1)
    return per.select(group, F.least(F.lit(1.0), F.greatest(F.lit(0.0), out)).alias("stability"))


def group_profile(df: DataFrame, group: str, label: str = "label") -> DataFrame:
    """total, benign, attack, attack_ratio, the dominant label (ties: the smallest) and the labels as JSON, largest first."""
    n = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))
    n = n.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.col("n").desc(), label)))
    out = n.groupBy(group).agg(
        F.sum("n").alias("total"),
        F.sum(F.when(is_benign(F.col(label)), F.col("n")).otherwise(0)).alias("benign"),
        F.max(F.when(F.col("rank") == 1, F.col(label))).alias("dominant_label"),
        F.max("n").alias("dominant_n"),
        F.array_sort(F.collect_list(F.struct("rank", F.col(label).alias("label"), "n"))).alias("_all"),
    )
    pairs = F.map_from_entries(F.transform("_all", lambda x: F.struct(x["label"], x["n"])))
    attack = F.col("total") - F.col("benign")
    return out.select(
        group, "total", "benign", attack.alias("attack"), (attack / F.col("total")).alias("attack_ratio"), "dominant_label", "dominant_n",
        (F.col("dominant_n") / F.col("total")).alias("dominant_ratio"), F.to_json(pairs).alias("labels_json"),
    )


def correlations(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Pearson and Spearman (on average ranks) of each feature with the target; constant columns and those with fewer than
    two values are left out."""
    rows = df.select(F.col(target).cast("double").alias("y"), F.explode(F.array(*[F.struct(F.lit(c).alias("feature"),
        F.col(c).cast("double").alias("x")) for c in features])).alias("p"))
    rows = rows.select("y", "p.feature", "p.x").where("x is not null and y is not null and not isnan(x)")

    def ranked(value: str) -> DataFrame:  # average ranks from counts of equal values, so no task sorts all rows of a feature
        n = rows.groupBy("feature", value).agg(F.count(F.lit(1)).alias("n"))
        return running_counts(n, ["feature"], value, ["n"]).select("feature", value, (F.col("n_before") + (F.col("n") + 1) / 2).alias(f"rank_{value}"))

    both = rows.join(ranked("x"), ["feature", "x"]).join(ranked("y"), ["feature", "y"])
    out = both.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"),
        *[F.expr(f"{f}({a}, {b})").alias(f"{k}_{f}") for k, a, b in (("p", "x", "y"), ("s", "rank_x", "rank_y")) for f in ("covar_pop",)],
        *[F.stddev_pop(c).alias(f"sd_{c}") for c in ("x", "y", "rank_x", "rank_y")],
    ).where("n >= 2 and x0 < x1 and y0 < y1")
    return out.select("feature", (F.col("p_covar_pop") / (F.col("sd_x") * F.col("sd_y"))).alias("pearson"),
        (F.col("s_covar_pop") / (F.col("sd_rank_x") * F.col("sd_rank_y"))).alias("spearman"))


def gini(df: DataFrame, group: str, value: str) -> DataFrame:
    """Gini coefficient of a value's distribution in each group, from counts of equal values."""
    n = df.groupBy(group, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    n = running_counts(n, [group], "v", ["n"])
    weighted = F.sum(F.col("v") * F.col("n") * (2 * F.col("n_before") + F.col("n") + 1))
    total, rows = F.sum(F.col("v") * F.col("n")), F.sum("n")
    return n.groupBy(group).agg(F.when(total == 0, 0.0).otherwise(weighted / (rows * total) - (rows + 1) / rows).alias("gini"))


def column_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: count, mean, population deviation, min, max, share of zeros, missing. One pass over the data."""
    parts = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns]
    rows = df.select(F.explode(F.array(*parts)).alias("p")).select("p.feature", F.when(F.isnan("p.x"), None).otherwise(F.col("p.x")).alias("x"))
    return rows.groupBy("feature").agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("low"), F.max("x").alias("high"),
        F.avg((F.col("x") == 0).cast("double")).alias("zero_ratio"), F.sum(F.col("x").isNull().cast("long")).alias("missing"),
    )


def binary_rates(df: DataFrame, attack: Column, flagged: Column, group: list[str] | None = None) -> DataFrame:
    """tp, fp, tn, fn and the rates; a rate without a base is null."""
    n = lambda test: F.sum(test.cast("long"))
    out = df.groupBy(*(group or [])).agg(n(attack & flagged).alias("tp"), n(~attack & flagged).alias("fp"), n(~attack & ~flagged).alias("tn"),
        n(attack & ~flagged).alias("fn"))
    rate = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b)))
    total = reduce(Column.__add__, [F.col(c) for c in ("tp", "fp", "tn", "fn")])
    return out.withColumns({"fpr": rate("fp", "tn"), "fnr": rate("fn", "tp"), "tpr": rate("tp", "fn"), "tnr": rate("tn", "fp"),
        "accuracy": F.when(total > 0, (F.col("tp") + F.col("tn")) / total)})
