"""How a learner grows with new rows: guards, history pools, subsamples, and training that goes on from the parameters it has.

Every step is a table: rows (learner, row_index, features) go in, rows with a reason or new parameters come out. What a model is
trained on is bounded by options (`most_new`, `pool_rows`, `most_rows`); thresholds and counts of a whole window come from all its rows.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.session import keep

from .cleaning import sample_per_group
from .models import Forest, matrix, tail_threshold
from .quantiles import exact_quantiles, running_counts

#: Why a row trains nothing although its window trains.
GUARD_FILTERED, ROUTE_FILTERED, SUBSAMPLED = "increment_iforest_guard_filtered", "increment_route_gate_filtered", "max_increment_samples_subsampled"
#: Fixed value: why a whole window trains nothing after the guard.
GUARD_LEFT_FEW = "increment_iforest_guard_min_samples"


@dataclass(frozen=True)
class Guard:
    """A forest of a learner's first rows; new rows must look like the `keep` share of them. rows: a window's least size."""

    rows: int = 200
    keep: float = 0.9
    most_rows: int = 5000
    trees: int = 200
    new_only: bool = False

    @property
    def quantile(self) -> float:
        """Of the seed's scores; what scores lower goes."""
        return float(np.clip(1 - self.keep, 0.01, 0.5))


def fit_guards(rows: DataFrame, features: list[str], guard: Guard, seed: int = 0) -> DataFrame:
    """learner, seed_count, cutoff, guard for learners with at least half of guard.rows rows (32 at least). rows: learner, row_index and
    features; a forest sees guard.most_rows of them at most. The cutoff is on the loss, which is the score with its sign turned."""
    least = max(32, guard.rows // 2)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = matrix(pdf, features)
        if len(x) < least:
            return pd.DataFrame({"learner": [], "seed_count": [], "cutoff": [], "guard": []})
        model = Forest(x, guard.trees, 256, seed)
        return pd.DataFrame({"learner": [pdf["learner"].iloc[0]], "seed_count": [len(x)], "cutoff": [float(np.quantile(model.loss(x),
            1 - guard.quantile))], "guard": [pickle.dumps(model)]})

    capped = sample_per_group(rows.select("learner", "row_index", *features), ["learner"], "row_index", guard.most_rows, seed)
    return capped.groupBy("learner").applyInPandas(fit, "learner string, seed_count long, cutoff double, guard binary")


def guarded(rows: DataFrame, features: list[str], guards: list) -> DataFrame:
    """rows (learner, row_index, features) as learner, row_index, guard_keep; rows of a learner without a guard are kept. guards:
    collected rows of fit_guards, one for each learner."""
    packed = {r["learner"]: (float(r["cutoff"]), bytes(r["guard"])) for r in guards}

    def run(batches):
        models = {name: (cutoff, pickle.loads(raw)) for name, (cutoff, raw) in packed.items()}
        for pdf in batches:
            for name, part in pdf.groupby("learner"):
                ok = models[name][1].loss(matrix(part, features)) <= models[name][0] if name in models else True
                yield pd.DataFrame({"learner": name, "row_index": part["row_index"], "guard_keep": ok})

    return rows.select("learner", "row_index", *features).mapInPandas(run, "learner string, row_index long, guard_keep boolean")


def loss_ranks(rows: DataFrame, group: str = "learner", loss: str = "loss", key: str = "row_index") -> DataFrame:
    """rows with _i, the place from 0 in the order of loss and key, and _n, the number of the group's rows. No task orders a group."""
    with_order = rows.withColumn("_order", F.struct(F.col(loss), F.col(key))).withColumn("_one", F.lit(1).cast("long"))
    placed = running_counts(with_order, [group], "_order", ["_one"]).withColumnRenamed("_one_before", "_i").drop("_order", "_one")
    n = placed.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    return placed.join(n, group)


def _even(i: Column, n: Column, k: Column) -> Column:
    """Whether place i of n is one of k even places, the first and the last included: floor(j * (n - 1) / (k - 1))."""
    k = F.greatest(k, F.lit(1))
    j = F.ceil(i * (k - 1) / F.greatest(n - 1, F.lit(1)))
    return F.when(n <= k, True).when(k == 1, i == 0).otherwise((j < k) & (F.floor(j * (n - 1) / (k - 1)) == i))


def spread_by_loss(rows: DataFrame, k: Column | int, group: str = "learner", loss: str = "loss", key: str = "row_index") -> DataFrame:
    """k rows of each group at even places of its losses, ends included; all rows of a group of up to k."""
    ranked = loss_ranks(rows, group, loss, key)
    return ranked.where(_even(F.col("_i"), F.col("_n"), k if isinstance(k, Column) else F.lit(k))).drop("_i", "_n")


def thirds_by_loss(rows: DataFrame, most: int, group: str = "learner", loss: str = "loss", key: str = "row_index") -> DataFrame:
    """Of each third of a group's losses (n // 3, 2n // 3) max(1, most // 3) rows at even places; the first `most` of them in the order
    of thirds and places. Groups of up to `most` rows are whole."""
    ranked = loss_ranks(rows, group, loss, key)
    i, n = F.col("_i"), F.col("_n")
    a, b = F.floor(n / 3), F.floor(2 * n / 3)
    start, end = F.when(i < a, 0).when(i < b, a).otherwise(b), F.when(i < a, a).when(i < b, b).otherwise(n)
    per = max(1, most // 3)
    picked = ranked.where((n <= most) | _even(i - start, end - start, F.least(end - start, F.lit(per))))
    first = F.row_number().over(Window.partitionBy(group).orderBy("_i"))  # at most 3 * per rows of a group
    small, large = picked.where(n <= most), picked.where(n > most).withColumn("_k", first).where(F.col("_k") <= most).drop("_k")
    return small.unionByName(large).drop("_i", "_n")


def low_losses(rows: DataFrame, share: float, group: str = "learner", loss: str = "loss") -> DataFrame:
    """Rows up to the quantile `share` (0.05 to 1) of their group's losses; at 1 all."""
    share = min(1.0, max(0.05, share))
    if share >= 1:
        return rows
    q = exact_quantiles(rows, [group], loss, [share], "_q").select(F.col(group).alias("_g"), F.col("_q")[0].alias("_q"))
    return rows.join(F.broadcast(q), F.col(group) == F.col("_g")).where(F.col(loss) <= F.col("_q")).drop("_g", "_q")  # a row for each group


def subsample(rows: DataFrame, most: int, share: float = 1.0, stratified: bool = True, seed: int = 0) -> DataFrame:
    """The rows (learner, row_index, loss) that train: low losses only, then at most `most` of each learner, by thirds of loss or a
    seeded sample."""
    low = low_losses(rows, share)
    return thirds_by_loss(low, most) if stratified else sample_per_group(low, ["learner"], "row_index", most, seed)


def history_sample(pool: DataFrame, rate: float, most: int, decay: float = 0.0, seed: int = 0) -> DataFrame:
    """Of each learner's pool max(1, floor(n * rate)) rows, `most` at most: at even places of loss; with decay newer rows likelier, each
    by its smallest -ln(u) / exp(-decay * age), u from its md5: sampling without replacement by weight."""
    n = pool.groupBy("learner").agg(F.least(F.lit(most), F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * rate))).cast("long").alias("_k"))
    if decay <= 0:
        return spread_by_loss(pool.join(F.broadcast(n), "learner"), F.col("_k")).drop("_k")  # a row for each learner
    age = running_counts(pool.withColumn("_old", -F.col("row_index")).withColumn("_one", F.lit(1).cast("long")), ["learner"], "_old", ["_one"])
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("row_index").cast("string"))), 1, 12), 16, 10).cast("double") + 0.5) / 2**48
    keyed = age.withColumn("_rank", -F.ln(u) * F.exp(decay * F.col("_one_before"))).drop("_old", "_one", "_one_before")
    ranked = loss_ranks(keyed, "learner", "_rank").join(F.broadcast(n), "learner")
    return ranked.where(F.col("_i") < F.col("_k")).drop("_rank", "_i", "_n", "_k")


def grow(update: DataFrame, features: list[str], params: list, epochs: int = 5, quantile: float = 0.95, risk: float = 1e-3,
    anchor_share: float | None = None, seed: int = 0) -> DataFrame:
    """learner, threshold, params, rows, and the mean, median and 0.95 quantile of the losses before and after, of learners trained on
    from what they are. update: learner, row_index, features, is_new; bounded for each learner by subsample and history_sample.

    A network keeps its scales and goes on from its weights; a forest is scaled and grown anew. The threshold comes from all update
    rows, or with anchor_share from the old ones and that share of the new ones at even places of their new losses."""
    packed = {r["learner"]: bytes(r["params"]) for r in params}

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf["learner"].iloc[0]
        mean, std, model = pickle.loads(packed[name])
        pdf = pdf.sort_values("row_index")
        x = matrix(pdf, features)
        before = model.loss((x - mean) / std)
        if isinstance(model, Forest):
            mean, std = x.mean(axis=0), x.std(axis=0)
            std[std == 0] = 1
        model = model.more((x - mean) / std, epochs, seed=seed)
        after = model.loss((x - mean) / std)
        of = after
        if anchor_share is not None:
            new = np.flatnonzero(pdf["is_new"].to_numpy())
            order = new[np.argsort(after[new], kind="stable")]
            k = min(len(order), max(1, round(len(order) * anchor_share))) if len(order) else 0
            picked = order[np.unique(np.linspace(0, max(0, len(order) - 1), num=max(1, k), dtype=int))] if k else order
            of = np.concatenate([after[~pdf["is_new"].to_numpy()], after[picked]])
        stats = {f"{side}_loss_{what}": [float(f(v))] for side, v in (("before", before), ("after", after)) for what, f in (("mean", np.mean),
            ("median", np.median), ("p95", lambda v: np.quantile(v, 0.95)))}
        return pd.DataFrame({"learner": [name], "threshold": [tail_threshold(of, quantile, risk)], "params": [pickle.dumps((mean, std, model))],
            "rows": [len(x)], **stats})

    shape = "learner string, threshold double, params binary, rows long, " + ", ".join(f"{s}_loss_{w} double" for s in ("before",
        "after") for w in ("mean", "median", "p95"))
    known = update.where(F.col("learner").isin(list(packed)))
    return keep(known.groupBy("learner").applyInPandas(fit, shape), "grown")
