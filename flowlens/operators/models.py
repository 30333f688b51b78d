"""One-class models of learners: scaling, isolation forest, autoencoder, tail thresholds.

A learner's scales and threshold come from all its rows; its model is fitted on a sample (`most_rows`, a parameter) inside
applyInPandas, so learners are fitted side by side on executors. Its parameters are a row of a table. Scoring sends that table to the
tasks and emits a loss for every row and learner; the table has a row for each learner, some 100 kB each, so learners must number
hundreds, not millions.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions.stats import clean
from flowlens.session import keep

from .cleaning import sample_per_group
from .quantiles import counted_quantiles


def scale_stats(df: DataFrame, features: list[str]) -> DataFrame:
    """feature, mean, std (population; 0 becomes 1): one pass."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in features])).alias("p"))
    return rows.groupBy("p.feature").agg(F.avg("p.x").alias("mean"), F.stddev_pop("p.x").alias("std")).withColumn("std", F.when(F.col("std") == 0,
        1.0).otherwise(F.col("std")))


def tail_threshold(losses: np.ndarray, quantile: float = 0.95, risk: float = 1e-3, fallback: float = 0.995) -> float:
    """Peaks over a quantile follow a generalised Pareto law; the threshold is exceeded with probability `risk`, and is at
    least the 99 % quantile. Under 100 losses, or 30 peaks, or without a fit, a quantile is taken. No losses: 1."""
    x = np.asarray(losses, float)
    x = x[np.isfinite(x)]
    if not len(x):
        return 1.0
    if len(x) < 100:
        return float(np.quantile(x, min(0.99, quantile)))
    at = float(np.quantile(x, quantile))
    peaks = x[x > at] - at
    if len(peaks) < 30:
        return float(np.quantile(x, fallback))
    shape, scale = fit_pareto(peaks)
    return pareto_limit(at, shape, scale, len(peaks) / (risk * len(x)), float(np.quantile(x, 0.99)), float(np.quantile(x, fallback)))


def pareto_limit(at: float, shape: float, scale: float, ratio: float, least: float, fallback: float) -> float:
    """What is exceeded with the wanted probability, `ratio` times rarer than `at`; at least `least`, `fallback` without a sound fit."""
    if not np.isfinite(scale) or scale <= 0:
        return float(fallback)
    found = at + (scale * np.log(ratio) if abs(shape) < 1e-9 else scale / shape * (ratio**shape - 1))
    return float(max(found, least)) if np.isfinite(found) else float(fallback)


def fit_pareto(peaks: np.ndarray, grid: int = 400) -> tuple[float, float]:
    """Shape and scale by maximum likelihood: along t = shape / scale the best shape is mean(log(1 + t x)), so one number is
    searched, on a grid and then more closely around its best point."""
    x = peaks / peaks.mean()

    def fit(t: np.ndarray) -> np.ndarray:
        shape = np.log1p(np.outer(t, x)).mean(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            value = -np.log(shape / t) - shape - 1
        return np.where(np.abs(t) < 1e-7, -2.0, value)

    low, high = -1 / x.max() * 0.999, 20.0
    for _ in range(4):
        t = np.linspace(low, high, grid)
        best = t[np.nanargmax(fit(t))]
        step = (high - low) / grid
        low, high = max(best - 2 * step, -1 / x.max() * 0.999), best + 2 * step
    if abs(best) < 1e-7:
        return 0.0, float(peaks.mean())
    shape = float(np.log1p(best * x).mean())
    return shape, shape / best * float(peaks.mean())


class Forest:
    """Isolation forest; the loss of a row is 2^(-depth / expected depth), near 1 for rows that are alone. Trees are arrays of
    nodes (feature, cut, children; a leaf has its depth), so that rows go down all trees together."""

    def __init__(self, x: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.n = min(sample, len(x))
        most = int(np.ceil(np.log2(max(2, self.n))))
        grown: list[list[tuple]] = []
        for _ in range(trees):
            nodes: list[tuple] = []
            self._grow(x[rng.choice(len(x), self.n, False)], 0, most, rng, nodes)
            grown.append(nodes)
        width = max(map(len, grown), default=1)
        empty = (0, np.inf, 0, 0, 0.0)
        table = np.array([nodes + [empty] * (width - len(nodes)) for nodes in grown], np.float64).reshape(len(grown), width, 5)
        table[:, :, 2:4] += np.arange(len(grown))[:, None, None] * width  # nodes are numbered over all trees
        self.feature, self.low, self.high = (table[:, :, k].ravel().astype(np.int32) for k in (0, 2, 3))
        self.cut, self.depth, self.steps, self.width = table[:, :, 1].ravel(), table[:, :, 4].ravel(), most, width

    def _grow(self, x, depth, most, rng, nodes) -> int:
        me = len(nodes)
        nodes.append((0, np.inf, me, me, depth + self._expected(len(x))))  # a leaf leads to itself
        wide = np.flatnonzero(x.max(axis=0) > x.min(axis=0)) if len(x) else []
        if depth < most and len(x) > 1 and len(wide):
            f = int(rng.choice(wide))
            cut = float(rng.uniform(x[:, f].min(), x[:, f].max()))
            left = x[:, f] < cut
            low = self._grow(x[left], depth + 1, most, rng, nodes)
            nodes[me] = (f, cut, low, self._grow(x[~left], depth + 1, most, rng, nodes), 0.0)
        return me

    @staticmethod
    def _expected(n: int) -> float:
        return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0

    def loss(self, x: np.ndarray, block: int = 512) -> np.ndarray:
        roots = np.arange(0, len(self.feature), self.width, dtype=np.int32)[:, None]
        out = np.empty(len(x))
        for at in range(0, len(x), block):
            rows = x[at : at + block]
            flat, line, node = rows.ravel(), np.arange(len(rows), dtype=np.int32) * x.shape[1], np.repeat(roots, len(rows), axis=1)
            for _ in range(self.steps):
                down = flat.take(self.feature.take(node) + line) < self.cut.take(node)
                node = np.where(down, self.low.take(node), self.high.take(node))
            out[at : at + block] = self.depth.take(node).mean(axis=0)
        return 2 ** (-out / max(1e-9, self._expected(self.n)))

    def more(self, x: np.ndarray, epochs: int, seed: int = 0) -> Forest:
        """A forest has no steps to go on from: it is grown anew."""
        return Forest(x, len(self.feature) // self.width, 256, seed)


class Autoencoder:
    """A small network with one narrow layer, trained by Adam; the loss is the mean squared error of a row."""

    def __init__(self, x: np.ndarray, narrow: int = 4, wide: int = 16, epochs: int = 60, rate: float = 0.01, seed: int = 0):
        rng = np.random.default_rng(seed)
        sizes = [x.shape[1], wide, narrow, wide, x.shape[1]]
        self.w = [rng.normal(0, np.sqrt(2 / a), (a, b)) for a, b in zip(sizes, sizes[1:], strict=False)]
        self.b = [np.zeros(b) for b in sizes[1:]]
        self._train(x, epochs, rate, rng)

    def more(self, x: np.ndarray, epochs: int, rate: float = 0.01, seed: int = 0) -> Autoencoder:
        """The same network, trained on from its weights."""
        self._train(x, epochs, rate, np.random.default_rng(seed))
        return self

    def _train(self, x, epochs, rate, rng):
        m = [np.zeros_like(p) for p in self.w + self.b]
        v = [np.zeros_like(p) for p in self.w + self.b]
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), 128):
                rows = x[order[at : at + 128]]
                acts = self._forward(rows)
                grad = 2 * (acts[-1] - rows) / rows.size
                gw, gb = [None] * 4, [None] * 4
                for k in range(3, -1, -1):
                    gw[k], gb[k] = acts[k].T @ grad, grad.sum(axis=0)
                    if k:
                        grad = (grad @ self.w[k].T) * (acts[k] > 0)
                t += 1
                for i, (p, g) in enumerate(zip(self.w + self.b, gw + gb, strict=True)):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    p -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)

    def _forward(self, x):
        acts = [x]
        for k in range(4):
            z = acts[-1] @ self.w[k] + self.b[k]
            acts.append(np.maximum(z, 0) if k < 3 else z)
        return acts

    def loss(self, x: np.ndarray) -> np.ndarray:
        return ((self._forward(x)[-1] - x) ** 2).mean(axis=1)


class OneClassSvm:
    """A half space that holds most rows, in random Fourier features of a Gaussian kernel; the loss is how far a row lies outside of it.
    Trained by averaged stochastic steps on |w|^2 / 2 - rho + mean(max(0, rho - w.phi)) / nu."""

    def __init__(self, x: np.ndarray, nu: float = 0.05, width: int = 256, gamma: float | None = None, epochs: int = 20, seed: int = 0):
        rng = np.random.default_rng(seed)
        gamma = gamma or 1.0 / max(1e-9, x.shape[1] * max(float(x.var()), 1e-9))  # the usual scale
        self.turn, self.shift = rng.normal(0, np.sqrt(2 * gamma), (x.shape[1], width)), rng.uniform(0, 2 * np.pi, width)
        self.w, self.rho = np.zeros(width), 0.0
        self._train(x, nu, epochs, rng)

    def _features(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(2 / len(self.shift)) * np.cos(x @ self.turn + self.shift)

    def _train(self, x, nu, epochs, rng):
        w, rho, step = self.w.copy(), self.rho, 0
        w_sum, rho_sum, kept = np.zeros_like(w), 0.0, 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), 64):
                phi = self._features(x[order[at : at + 64]])
                step += 1
                rate = 1.0 / (10 + step)
                out = (phi @ w < rho).astype(float) / (nu * len(phi))
                w -= rate * (w - out @ phi)
                rho -= rate * (out.sum() - 1)
                if 2 * epoch >= epochs:
                    w_sum, rho_sum, kept = w_sum + w, rho_sum + rho, kept + 1
        if kept:
            self.w, self.rho = w_sum / kept, rho_sum / kept

    def loss(self, x: np.ndarray) -> np.ndarray:
        return self.rho - self._features(x) @ self.w

    def more(self, x: np.ndarray, epochs: int, seed: int = 0) -> OneClassSvm:
        self._train(x, 0.05, epochs, np.random.default_rng(seed))
        return self


BACKENDS = {"iforest": Forest, "ae": Autoencoder, "ocsvm": OneClassSvm}
PARAMS = "learner string, n long, threshold double, params binary"


def matrix(pdf: pd.DataFrame, features: list[str]) -> np.ndarray:
    return np.nan_to_num(pdf[features].to_numpy(float), nan=0.0, posinf=0.0, neginf=0.0)


def group_scales(df: DataFrame, group: str, features: list[str]) -> DataFrame:
    """learner, n, mean, std (arrays, population; a deviation of 0 is 1) over all rows of each group; what is no number counts as 0."""
    of = [clean(F.col(f"`{c}`").cast("double")) for c in features]
    out = df.groupBy(F.col(group).cast("string").alias("learner")).agg(F.count(F.lit(1)).alias("n"), F.array(*map(F.avg, of)).alias("mean"),
        F.array(*map(F.stddev_pop, of)).alias("std"))
    return out.withColumn("std", F.transform("std", lambda v: F.when(v == 0, 1.0).otherwise(v)))


def fit_learners(df: DataFrame, group: str, key: str, features: list[str], backend: str = "iforest", most_rows: int = 5000, quantile: float = 0.95,
    risk: float = 1e-3, seed: int = 0) -> DataFrame:
    """One row of parameters for each value of `group`. Scales and thresholds come from all its rows; only the model is fitted on a
    sample, `most_rows` rows at most."""
    kind = BACKENDS[backend]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        mean, std = np.array(pdf["_mean"].iloc[0]), np.array(pdf["_std"].iloc[0])
        model = kind((matrix(pdf, features) - mean) / std, seed=seed)
        return pd.DataFrame({"learner": [str(pdf["_learner"].iloc[0])], "n": [int(pdf["_n"].iloc[0])], "threshold": [float("nan")],
            "params": [pickle.dumps((mean, std, model))]})

    rows = df.select(F.col(group).cast("string").alias("_learner"), key, *features)
    scales = group_scales(rows, "_learner", features).select(F.col("learner").alias("_learner"), F.col("n").alias("_n"), F.col("mean").alias("_mean"),
        F.col("std").alias("_std"))
    capped = sample_per_group(rows, ["_learner"], key, most_rows, seed).join(F.broadcast(scales), "_learner")  # a row for each learner
    params = keep(capped.groupBy("_learner").applyInPandas(fit, PARAMS), "fitted")
    # equal rows have equal losses
    equal = rows.groupBy("_learner", *features).agg(F.count(F.lit(1)).alias("n"))
    limits = tail_thresholds(own_losses(equal, "_learner", features, params.collect()), "learner", "loss", quantile, risk, rows="n")
    return params.drop("threshold").join(F.broadcast(limits), "learner").select("learner", "n", "threshold", "params")


def own_losses(df: DataFrame, group: str, features: list[str], params: list) -> DataFrame:
    """learner, loss, n of each row at its own group's model; n is the number of rows that a row of df stands for."""
    packed = {r["learner"]: bytes(r["params"]) for r in params}

    def score(batches):
        models = {name: pickle.loads(raw) for name, raw in packed.items()}
        for pdf in batches:
            for name, part in pdf.groupby(group):
                if name in models:
                    mean, std, model = models[name]
                    yield pd.DataFrame({"learner": name, "loss": model.loss((matrix(part, features) - mean) / std), "n": part["n"].to_numpy()})

    return df.select(group, *features, "n").mapInPandas(score, "learner string, loss double, n long")


def with_own_loss(df: DataFrame, features: list[str], params: list) -> DataFrame:
    """df (learner, features and more) with loss at the learner's own model; rows of learners without a model are left out."""
    packed = {r["learner"]: bytes(r["params"]) for r in params}

    def score(batches):
        models = {name: pickle.loads(raw) for name, raw in packed.items()}
        for pdf in batches:
            for name, part in pdf.groupby("learner"):
                if name in models:
                    mean, std, model = models[name]
                    yield part.assign(loss=model.loss((matrix(part, features) - mean) / std))

    plain = df.drop("loss")
    return plain.mapInPandas(score, ", ".join(f"`{c}` {t}" for c, t in plain.dtypes) + ", loss double")


def tail_thresholds(losses: DataFrame, group: str, loss: str, quantile: float = 0.95, risk: float = 1e-3, fallback: float = 0.995, grid: int = 64,
    rounds: int = 5, rows: str | None = None) -> DataFrame:
    """learner, threshold: tail_threshold() of each group's losses, of any number. Equal losses are counted once; quantiles come by ranges;
    the law's likelihood is a sum over peaks, which tasks work out for a grid of points, refined `rounds` times around the best one. The
    driver holds a grid for each group. rows: a column that says how many rows a row stands for."""
    n = F.count(F.lit(1)) if rows is None else F.sum(rows)
    sound = losses.where(F.col(loss).isNotNull() & ~F.isnan(loss) & (F.abs(loss) < float("inf")))
    sound = keep(sound.groupBy(F.col(group).alias("_g"), F.col(loss).cast("double").alias("_v")).agg(n.alias("_n")), "losses")
    probs = [min(0.99, quantile), quantile, 0.99, fallback]
    at = keep(counted_quantiles(sound, ["_g"], probs, "_q").join(sound.groupBy("_g").agg(F.sum("_n").alias("_n")), "_g"), "limits")
    peaks = sound.join(F.broadcast(at.select("_g", F.col("_q")[1].alias("_at"))), "_g").where("_v > _at").select("_g", (F.col("_v") - F.col("_at")).alias("_x"),
        "_n")
    peaks = keep(peaks, "peaks")
    found = at.join(peaks.groupBy("_g").agg(F.sum("_n").alias("k"), (F.sum(F.col("_x") * F.col("_n")) / F.sum("_n")).alias("mean"),
        F.max("_x").alias("top")), "_g", "left").collect()  # a row for each learner
    groups = {r["_g"]: r for r in found}
    fitted = {g: r for g, r in groups.items() if r["_n"] >= 100 and (r["k"] or 0) >= 30}
    span = {g: (-r["mean"] / r["top"] * 0.999, 20.0) for g, r in fitted.items()}
    best: dict[str, float] = {}

    def sums(points: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """Of each group and point t the sum of log(1 + t * peak / mean peak)."""
        scaled = {g: t / fitted[g]["mean"] for g, t in points.items()}

        def run(batches):
            total = {g: np.zeros(len(t)) for g, t in scaled.items()}
            for pdf in batches:
                for g, part in pdf.groupby("_g"):
                    for low in range(0, len(part) if g in scaled else 0, 8192):
                        x, n = (part[c].to_numpy()[low : low + 8192] for c in ("_x", "_n"))
                        total[g] += np.log1p(np.outer(scaled[g], x)) @ n
            yield pd.DataFrame({"_g": [g for g in total for _ in total[g]], "k": [k for t in total.values() for k in range(len(t))],
                "s": [v for t in total.values() for v in t]})

        found = peaks.mapInPandas(run, "_g string, k int, s double").groupBy("_g", "k").agg(F.sum("s").alias("s")).collect()
        out = {g: np.zeros(len(t)) for g, t in points.items()}
        for r in found:
            out[r["_g"]][r["k"]] = r["s"]
        return out

    for _ in range(rounds if fitted else 0):
        points = {g: np.linspace(low, high, grid) for g, (low, high) in span.items()}
        for g, s in sums(points).items():
            t, shape = points[g], s / fitted[g]["k"]
            with np.errstate(divide="ignore", invalid="ignore"):
                value = np.where(np.abs(t) < 1e-7, -2.0, -np.log(shape / t) - shape - 1)
            best[g] = float(t[np.nanargmax(value)])
            step = (span[g][1] - span[g][0]) / grid
            span[g] = (max(best[g] - 2 * step, -fitted[g]["mean"] / fitted[g]["top"] * 0.999), best[g] + 2 * step)
    last = sums({g: np.array([t]) for g, t in best.items()}) if best else {}
    limits = []
    for g, r in groups.items():
        if r["_n"] < 100:
            limit = r["_q"][0]
        elif g not in fitted:
            limit = r["_q"][3]
        else:
            shape = 0.0 if abs(best[g]) < 1e-7 else float(last[g][0] / r["k"])
            scale = r["mean"] if shape == 0 else shape / best[g] * r["mean"]
            limit = pareto_limit(r["_q"][1], shape, scale, r["k"] / (risk * r["_n"]), r["_q"][2], r["_q"][3])
        limits.append((g, float(limit)))
    return losses.sparkSession.createDataFrame(limits, "learner string, threshold double")


def score_learners(df: DataFrame, key: str, features: list[str], params: list, more: list[str] | None = None) -> DataFrame:
    """key, learner, loss, threshold, and columns `more` of df, for every row and learner. params: collected rows of fit_learners, a few
    per learner."""
    more = more or []
    packed = [(r["learner"], float(r["threshold"]), bytes(r["params"])) for r in params]

    def score(batches):
        models = [(name, limit, *pickle.loads(raw)) for name, limit, raw in packed]
        for pdf in batches:
            x = matrix(pdf, features)
            for name, limit, mean, std, model in models:
                yield pd.DataFrame({key: pdf[key], "learner": name, "loss": model.loss((x - mean) / std), "threshold": limit} | {c: pdf[c] for c in more})

    kinds = dict(df.dtypes)
    rows = df.select(*dict.fromkeys([key, *features, *more]))
    return rows.mapInPandas(score, f"{key} {kinds[key]}, learner string, loss double, threshold double" + "".join(f", {c} {kinds[c]}" for c in more))


def dbscan(x: np.ndarray, eps: float, least: int) -> np.ndarray:
    """Cluster numbers of a few rows, -1 for noise; the plain form that clusters.density_clusters is held against."""
    n = len(x)
    near: list[np.ndarray] = []
    for at in range(0, n, 512):
        d = ((x[at : at + 512, None, :] - x[None, :, :]) ** 2).sum(axis=2)
        near += [np.flatnonzero(row <= eps * eps) for row in d]
    core = np.array([len(r) >= least for r in near], bool)
    label, found = np.full(n, -1), 0
    for start in range(n):
        if label[start] >= 0 or not core[start]:
            continue
        label[start], todo = found, [start]
        while todo:
            i = todo.pop()
            if core[i]:
                for j in near[i]:
                    if label[j] < 0:
                        label[j] = found
                        todo.append(j)
        found += 1
    return label
