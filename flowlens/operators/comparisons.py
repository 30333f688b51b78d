"""Comparisons of one-class models: scores of residuals, thresholds from benign quantiles, training on one year and testing on another."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.session import keep

from .evaluation import auc, curve
from .models import fit_learners, score_learners
from .quantiles import exact_quantiles


def residual_scores(errors: Column, top_share: float = 0.1) -> dict[str, Column]:
    """Of an array of squared errors their mean, the mean of the largest share (at least one), and the 0.9 quantile."""
    n = F.size(errors)
    k = F.greatest(F.lit(1), F.floor(n * max(min(top_share, 1.0), 1e-6)).cast("int"))
    down, up = F.sort_array(errors, False), F.sort_array(errors)
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)
    place = 0.9 * (n - 1)
    low = F.element_at(up, (F.floor(place) + 1).cast("int"))
    high = F.element_at(up, (F.ceil(place) + 1).cast("int"))
    return {"mean_mse": mean(errors), "topk_mse": mean(F.slice(down, 1, k)), "p90_error": low + (high - low) * (place - F.floor(place))}


def fixed_fpr_rates(scored: DataFrame, score: str, positive: str, targets: list[float], benign: DataFrame | None = None) -> DataFrame:
    """target, threshold, tp, fp, tn, fn, fpr, tpr, fnr, precision: the threshold is the quantile 1 - target of the benign scores (of
    `benign` if given, else of scored); a row counts as an attack from the threshold on. A rate without a base is 0."""
    calm = (scored.where(F.col(positive) == 0) if benign is None else benign).select(F.col(score).alias("_s"))
    q = exact_quantiles(calm, [], "_s", [1 - t for t in targets], "_q").select(F.explode(F.arrays_zip(F.array(*map(F.lit, targets)).alias("target"),
        F.col("_q").alias("threshold"))).alias("z")).select("z.target", "z.threshold")
    rows = scored.select(F.col(score).alias("_s"), F.col(positive).cast("int").alias("_y")).join(F.broadcast(q), how="cross")  # a row for each target
    n = lambda y, hit: F.sum(((F.col("_y") == y) & ((F.col("_s") >= F.col("threshold")) == hit)).cast("long"))
    out = rows.groupBy("target", "threshold").agg(n(1, True).alias("tp"), n(0, True).alias("fp"), n(0, False).alias("tn"), n(1, False).alias("fn"))
    rate = lambda a, b: F.col(a) / F.greatest(F.lit(1), F.col(a) + F.col(b))
    return out.withColumns({"fpr": rate("fp", "tn"), "tpr": rate("tp", "fn"), "fnr": rate("fn", "tp"), "precision": rate("tp", "fp")})


def best_f1(scored: DataFrame, score: str, positive: str) -> DataFrame:
    """One row: the threshold of the largest F1 (ties: the highest) and that F1."""
    points = curve(scored, score, positive)
    total = points.agg(F.max("tp").alias("p"))
    f1 = F.round(2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("p")), 12)
    ranked = points.join(F.broadcast(total), how="cross").withColumn("f1", f1)
    return ranked.agg(F.max(F.struct("f1", "threshold")).alias("b")).select("b.threshold", "b.f1")


def one_class_rows(rows: DataFrame, train: Column, test: Column, attack: Column, key: str, features: list[str], backends: list[str],
    most_rows: int = 5000, seed: int = 1) -> DataFrame:
    """backend, key, part (train or test), is_attack (0 or 1), loss, threshold: each model is fitted on the benign training rows (scales
    and threshold from all of them, the model on a sample) and scores training and test rows."""
    learn = keep(rows.where(train & ~attack).select(key, F.lit("benign").alias("_one"), *features), "one-class-train")
    seen = rows.select(key, *features, F.when(test, "test").when(train & ~attack, "train").alias("part"),
        attack.cast("int").alias("is_attack")).where("part is not null")
    seen = keep(seen, "one-class-rows")
    parts = []
    for name in backends:
        params = fit_learners(learn, "_one", key, features, name, most_rows, seed=seed).collect()  # one row
        parts.append(score_learners(seen, key, features, params, ["part", "is_attack"]).select(F.lit(name).alias("backend"), key, "loss", "threshold",
            "part", "is_attack"))
    return keep(reduce(DataFrame.unionByName, parts), "one-class-scores")


def cross_tests(scored: DataFrame) -> DataFrame:
    """backend, accuracy, precision, recall, f1, auc, p95, over: of the test rows, an attack being a loss above the 0.95 quantile of the
    training losses (p95); over is the share of test rows above the model's own threshold."""
    p95 = exact_quantiles(scored.where("part = 'train'"), ["backend"], "loss", [0.95]).select("backend", F.col("q")[0].alias("p95"))
    test = scored.where("part = 'test'").join(F.broadcast(p95), "backend")  # a row for each model
    hit, y = F.col("loss") > F.col("p95"), F.col("is_attack") == 1
    n = lambda t: F.sum(t.cast("long"))
    c = test.groupBy("backend", "p95").agg(n(hit & y).alias("tp"), n(hit & ~y).alias("fp"), n(~hit & y).alias("fn"), F.count(F.lit(1)).alias("n"),
        F.avg((F.col("loss") > F.col("threshold")).cast("double")).alias("over"))
    rate = lambda a, b: F.col(a) / F.greatest(F.lit(1), F.col(a) + F.col(b))
    area = auc(test.select("backend", F.round("loss", 12).alias("s"), "is_attack"), ["backend"], "s", "is_attack").select("backend", "auc")
    out = c.join(area, "backend", "left")
    return out.select(
        "backend", ((F.col("n") - F.col("fp") - F.col("fn")) / F.col("n")).alias("accuracy"), rate("tp", "fp").alias("precision"), rate("tp",
            "fn").alias("recall"),
        (2 * F.col("tp") / F.greatest(F.lit(1), 2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("f1"), "auc", "p95", "over",
    )
