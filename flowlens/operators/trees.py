"""Decision trees, forests and boosted trees over flows and learners: assembly of features, reports, rule texts, attributions, fusion.

Models are MLlib's, trained by Spark on all rows. Forests see only the bin of a value (up to `most` a feature), so rows
are counted by bins first, each with its number of draws for each tree: bagging is by row, training and scoring are on the counts. What a report says of a tree is read from the model's saved node table; a tree has at
most 2^depth leaves, so that fits the driver. Scores, folds, curves and attributions stay tables.
"""

from __future__ import annotations

import uuid
from functools import reduce
from math import exp, factorial
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Bucketizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions.stats import clean
from flowlens.session import keep, shared_folder

from .cleaning import fill_median, folds
from .evaluation import auc, curve
from .quantiles import running_counts


def assemble(df: DataFrame, numeric: list[str], categorical: list[str] | None = None, most_categories: int = 1000) -> tuple[DataFrame, list[str]]:
    """df with x, an array of doubles, and the names of its places: numbers with the median for what is missing, then for each category
    `<column>_<value>` as 0 or 1, with the most frequent value (ties: the smallest) for null. A column without a value is 0."""
    out, names, parts = (fill_median(df, numeric) if numeric else df), list(numeric), [F.col(f"`{c}`").cast("double") for c in numeric]
    for c in categorical or []:
        n = df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("v")).agg(F.count(F.lit(1)).alias("n")).orderBy("v").limit(most_categories + 1).collect()
        if len(n) > most_categories:
            raise ValueError(f"{c} has more than {most_categories} values")
        usual = min(n, key=lambda r: (-r["n"], r["v"]))["v"] if n else None
        value = F.coalesce(F.col(c).cast("string"), F.lit(usual))
        names += [f"{c}_{r['v']}" for r in n]
        parts += [F.coalesce((value == r["v"]).cast("double"), F.lit(0.0)) for r in n]
    return out.withColumn("x", F.array(*parts) if parts else F.array().cast("array<double>")), names


def _indexed(df: DataFrame, label: str) -> tuple[DataFrame, list[str], dict[str, int]]:
    """df with y (the label's place among the sorted labels), w (rows over labels over the label's rows) and features."""
    counts = {str(r["l"]): r["n"] for r in df.groupBy(F.col(label).cast("string").alias("l")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each label
    names = sorted(counts)
    total = sum(counts.values())
    of = lambda f: F.create_map(*[v for k, x in enumerate(names) for v in (F.lit(x), F.lit(f(k, x)))])[F.col(label).cast("string")]
    out = df.withColumns({"y": of(lambda k, x: float(k)), "w": of(lambda k, x: total / len(names) / counts[x])}).withColumn("features", array_to_vector("x"))
    return out, names, counts


def nodes(model) -> list[dict[int, dict]]:
    """The trees of a model by node number: feature, cut, left, right (None for a leaf), value (its prediction), n; cut is of the form
    x <= cut. Read from the model's saved table."""
    session = SparkSession.active()
    path = f"{shared_folder(session)}/model-{uuid.uuid4().hex}"
    model.write().save(path)
    table = session.read.parquet(f"{path}/data")
    if "nodeData" in table.columns:
        table = table.select("treeID", "nodeData.*")
    else:
        table = table.select(F.lit(0).alias("treeID"), "*")
    trees: dict[int, dict[int, dict]] = {}
    for r in table.collect():
        leaf = r["leftChild"] < 0
        trees.setdefault(r["treeID"], {})[r["id"]] = {
            "feature": None if leaf else r["split"]["featureIndex"], "cut": None if leaf else r["split"]["leftCategoriesOrThreshold"][0],
            "left": None if leaf else r["leftChild"], "right": None if leaf else r["rightChild"], "value": r["prediction"], "n": int(r["rawCount"]),
        }
    return [trees[k] for k in sorted(trees)]


def rule_text(tree: dict[int, dict], names: list[str], classes: list[str], node: int = 0, depth: int = 0) -> str:
    """A tree as indented conditions, leaves as classes."""
    me, bar = tree[node], "|   " * depth + "|--- "
    if me["left"] is None:
        return f"{bar}class: {classes[int(me['value'])]}\n"
    name, cut = names[me["feature"]], f"{me['cut']:.2f}"
    return f"{bar}{name} <= {cut}\n{rule_text(tree, names, classes, me['left'], depth + 1)}{bar}{name} >  {cut}\n{rule_text(tree, names, classes, me['right'], depth + 1)}"


def _macro_f1(rows: DataFrame) -> tuple[float, float]:
    """Accuracy and mean F1 over classes, of rows with y and prediction."""
    n = rows.groupBy("y", "prediction").agg(F.count(F.lit(1)).alias("n")).collect()
    classes = {r["y"] for r in n} | {r["prediction"] for r in n}
    hit = {c: sum(r["n"] for r in n if r["y"] == c == r["prediction"]) for c in classes}
    said, true = ({c: sum(r["n"] for r in n if r[k] == c) for c in classes} for k in ("prediction", "y"))
    return sum(hit.values()) / max(1, sum(true.values())), float(np.mean([2 * hit[c] / (said[c] + true[c]) for c in classes]))


def tree_report(df: DataFrame, label: str, key: str, numeric: list[str], categorical: list[str] | None = None, depth: int = 6, least: int = 2,
    seed: int = 42, top: int = 30) -> dict:
    """What a balanced decision tree makes of a table: classes, cross-validated accuracy and F1 (mean and population deviation over up to 5
    stratified folds), AUC if there are two classes, training accuracy and F1, the `top` importances, the rules as text, and confusion
    (class, guess, n of the folds). Fewer than 2 rows in a class, or one class, leave the folds out."""
    made, names = assemble(df, numeric, categorical)
    rows, classes, counts = _indexed(made, label)
    rows = keep(rows.select(F.col(key).alias("_key"), "y", "w", "features"), "tree-rows")
    kind = DecisionTreeClassifier(labelCol="y", weightCol="w", maxDepth=depth, minInstancesPerNode=least, seed=seed)
    n_folds = min(5, min(counts.values())) if len(counts) > 1 else 0
    report = {"n": sum(counts.values()), "classes": counts, "folds": n_folds if n_folds >= 2 else 0, "confusion": [], "auc": None}
    if n_folds >= 2:
        cut = keep(folds(rows, "y", "_key", n_folds, seed), "folds")
        parts = [kind.fit(cut.where(F.col("fold") != k)).transform(cut.where(F.col("fold") == k)).select("fold", "y", "prediction",
            vector_to_array("probability").alias("p")) for k in range(n_folds)]
        out = keep(reduce(DataFrame.unionByName, parts), "fold-scores")
        scores = [_macro_f1(out.where(F.col("fold") == k)) for k in range(n_folds)]
        for name, values in zip(("accuracy", "f1"), zip(*scores, strict=True), strict=True):
            report |= {f"cv_{name}_mean": float(np.mean(values)), f"cv_{name}_std": float(np.std(values))}
        report["confusion"] = sorted((classes[int(r["y"])], classes[int(r["prediction"])], r["n"]) for r in out.groupBy("y",
            "prediction").agg(F.count(F.lit(1)).alias("n")).collect())
        if len(classes) == 2:
            report["auc"] = auc(out.select(F.lit(0).alias("g"), F.col("p")[1].alias("s"), F.col("y").cast("int").alias("y")), ["g"], "s", "y").first()["auc"]
    model = kind.fit(rows)
    accuracy, f1 = _macro_f1(model.transform(rows).select("y", "prediction"))
    weights = model.featureImportances.toArray() if names else []
    report |= {"train_accuracy": accuracy, "train_f1": f1, "importances": [(names[k], float(weights[k])) for k in sorted(range(len(weights)),
        key=lambda k: (-weights[k], names[k])) if weights[k] > 1e-9][:top]}
    return report | {"rules": rule_text(nodes(model)[0], names, classes)}


def bin_cuts(rows: DataFrame, features: int, most: int = 32) -> list[list[float]]:
    """For each place of x, an array of doubles, the cuts between at most `most` bins by MLlib's rule, but over all rows instead of a sample:
    midway between neighbouring values, all of them if there are no more values than bins. Otherwise the k-th cut is before the first value
    whose middle row is beyond k shares of the rows, and always after the cut before it."""
    long = rows.select(F.posexplode("x").alias("place", "_v")).where("not isnan(_v)")
    counted = keep(long.groupBy("place", "_v").agg(F.count(F.lit(1)).alias("_n")).withColumn("_one", F.lit(1)), "counted")
    placed = running_counts(counted, ["place"], "_v", ["_n", "_one"], kept=True)
    total = counted.groupBy("place").agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_values"))  # a row for each feature
    middle = (F.col("_n_before") + F.col("_n") / 2) * most
    first = [F.min(F.when((F.col("_one_before") > 0) & (middle > k * F.col("_all")), F.col("_one_before"))) for k in range(1, most)]
    wanted = {}  # of each feature the numbers of the values after a cut
    for r in placed.join(F.broadcast(total), "place").groupBy("place", "_values").agg(F.array(*first).alias("first")).collect():
        if r["_values"] <= most:
            wanted[r["place"]] = list(range(1, r["_values"]))
            continue
        at = wanted.setdefault(r["place"], [])
        for k in r["first"]:
            after = None if k is None else max(k, at[-1] + 1 if at else 1)
            if after is not None and after < r["_values"]:
                at.append(after)
    near = [(k, i) for k, at in wanted.items() for i in {i for j in at for i in (j - 1, j)}]
    ends = rows.sparkSession.createDataFrame(near, "place int, _one_before long")
    value = {(r["place"], r["_one_before"]): r["_v"] for r in placed.join(F.broadcast(ends), ["place", "_one_before"]).collect()}  # two for each cut
    return [sorted({(value[k, i - 1] + value[k, i]) / 2 for i in wanted.get(k, [])}) for k in range(features)]


def _uniform(key: list[str], tree: int, seed: int) -> Column:
    """A number from 0 to 1 by a hash of the row's key, so the same whatever the partitions."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(tree), *[F.col(f"`{c}`") for c in key]), 11) / F.lit(2.0**53)


#: Where a uniform number makes the Poisson variable of mean 1 one larger.
_POISSON = [sum(exp(-1) / factorial(j) for j in range(k + 1)) for k in range(16)]


def bin_counts(rows: DataFrame, by: list[str], cuts: list[list[float]], sums: dict[str, Column], key: list[str], trees: int, seed: int,
    drawn: Column | None = None) -> DataFrame:
    """A kept table with a row for each of `by` and bins of x: features (a vector of the bins' numbers), sums over its rows, and
    `drawn_<tree>`, how often the tree draws its rows: each row Poisson of mean 1, or not at all where `drawn` is false."""
    inner = {f"_x{k}": [float(np.nextafter(c, np.inf)) for c in at if np.isfinite(c)] for k, at in enumerate(cuts)}  # a value equal to a cut is left of it
    inner |= {f"_u{t}": _POISSON for t in range(trees)}
    cut = [c for c, at in inner.items() if at]
    flat = rows.select(*by, *[F.col("x")[k].alias(f"_x{k}") for k in range(len(cuts))], *[v.alias(k) for k, v in sums.items()],
        *[_uniform(key, t, seed).alias(f"_u{t}") for t in range(trees)], (F.lit(True) if drawn is None else drawn).alias("_drawn"))
    if cut:
        flat = Bucketizer(splitsArray=[[-np.inf, *inner[c], np.inf] for c in cut], inputCols=cut, outputCols=[f"_in{c}" for c in cut]).transform(flat)
    names = [f"_in_x{k}" for k in range(len(cuts))]
    flat = flat.withColumns({c: F.lit(0.0) for c in names if c[3:] not in cut})
    counted = flat.groupBy(*by, *names).agg(*[F.sum(F.col(k).cast("long")).alias(k) for k in sums], *[F.sum(F.when(F.col("_drawn"),
        F.col(f"_in_u{t}")).otherwise(0.0)).cast("long").alias(f"drawn_{t}") for t in range(trees)])
    return keep(counted.select(*by, array_to_vector(F.array(*names)).alias("features"), *sums, *[f"drawn_{t}" for t in range(trees)]), "bins")


#: Says that a 0/1 column is a class of two, so that no fit has to look for the largest.
_TWO = {"ml_attr": {"type": "nominal", "vals": ["0", "1"]}}
#: More than any feature has bins: fits then find the cuts between bins from up to the square of this many rows, not 10,000.
_MOST_BINS = 1024


def bagged_trees(counts: DataFrame, positive: Column, weight: Column, trees: int, depth: int, seed: int) -> list:
    """A forest of two classes as models of one tree each, from bin counts with `drawn_<tree>`."""
    rows = counts.select("features", positive.cast("double").alias("y", metadata=_TWO), weight.alias("_w"), *[f"drawn_{t}" for t in range(trees)])
    return [RandomForestClassifier(labelCol="y", weightCol="w", numTrees=1, bootstrap=False, featureSubsetStrategy="sqrt", maxDepth=depth, maxBins=_MOST_BINS,
        seed=seed + t).fit(rows.where(F.col(f"drawn_{t}") > 0).select("features", "y", (F.col("_w") * F.col(f"drawn_{t}")).alias("w"))) for t in range(trees)]


def counted_tree(counts: DataFrame, label: str, n: str, depth: int, least: int, seed: int):
    """A tree from bin counts: n is how many rows a row stands for, and a leaf has at least `least` of them."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    if total < 2 * least:
        depth = 0
    share = (least - 0.5) / total if depth else 0.0  # of rows; a fit's own minimum is of the table's rows, which are bins
    return DecisionTreeClassifier(labelCol=label, weightCol="_n", maxDepth=depth, minWeightFractionPerNode=share, maxBins=_MOST_BINS,
        seed=seed).fit(counts.withColumn("_n", F.col(n).cast("double")))


def forest_importances(models: list) -> np.ndarray:
    """The mean importances of the trees that split; they sum to 1, or are all 0."""
    total = np.sum([m.featureImportances.toArray() for m in models], axis=0)
    return total / (total.sum() or 1.0)


def forest_score(rows: DataFrame, models: list, name: str) -> DataFrame:
    """rows with the mean of the trees' probabilities of class 1."""
    out = rows
    for t, m in enumerate(models):
        out = m.copy({m.probabilityCol: f"_p{t}", m.rawPredictionCol: "", m.predictionCol: ""}).transform(out)
    mean = reduce(Column.__add__, [vector_to_array(f"_p{t}")[1] for t in range(len(models))]) / len(models)
    return out.withColumn(name, mean).drop(*[f"_p{t}" for t in range(len(models))])


def forest_explanations(df: DataFrame, group: str, key: str, features: list[str], least: int = 50, test: float = 0.3, trees: int = 20, depth: int = 5,
    top: int = 5, seed: int = 1) -> DataFrame:
    """learner, positives, negatives, reason, auc (of the rows held out), features (the `top` names and importances): each group against all
    others by a forest; groups with fewer than `least` rows on a side are named with a reason. Rows are read to find the bins and to count
    them; the forests, one a group (for hundreds), are trained and scored on the counts, four at a time."""
    made, names = assemble(df, features)
    held = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("double") < test * 2**32
    rows = keep(made.select(F.col(group).cast("string").alias("learner"), F.col(key).alias("_key"), held.alias("held"), "x"), "explained")
    cells = bin_counts(rows, ["learner"], bin_cuts(rows.where("not held"), len(names)), {"n": F.lit(1), "n_held": F.col("held").cast("int")}, ["_key"], trees,
        seed, ~F.col("held"))
    counts = {r["learner"]: r["n"] for r in cells.groupBy("learner").agg(F.sum("n").alias("n")).collect()}  # a row for each learner
    total = sum(counts.values())

    def one(learner: str):
        n, is_mine = counts[learner], F.col("learner") == learner
        models = bagged_trees(cells, is_mine, F.when(is_mine, total / 2 / n).otherwise(total / 2 / (total - n)), trees, depth, seed)
        scored = forest_score(cells.where("n_held > 0").select("features", is_mine.cast("int").alias("y"), "n_held"), models, "s")
        return forest_importances(models), scored.select(F.lit(learner).alias("learner"), F.round("s", 9).alias("s"), "y", "n_held")

    fit = [k for k, n in sorted(counts.items()) if min(n, total - n) >= least]
    with ThreadPool(4) as pool:
        forests = dict(zip(fit, pool.map(inheritable_thread_target(df.sparkSession)(one), fit), strict=True))
    areas = {}
    if fit:
        scored = reduce(DataFrame.unionByName, [s for _, s in forests.values()])
        areas = {r["learner"]: r["auc"] for r in auc(scored, ["learner"], "s", "y", "n_held").collect()}
    out = []
    for learner, n in sorted(counts.items()):
        if learner not in forests:
            out.append((learner, n, total - n, "insufficient_samples", None, None))
            continue
        weight = forests[learner][0]
        best = sorted(range(len(names)), key=lambda k: (-weight[k], names[k]))[:top]
        out.append((learner, n, total - n, None, areas.get(learner), [(names[k], float(weight[k])) for k in best]))
    return df.sparkSession.createDataFrame(out, "learner string, positives long, negatives long, reason string, auc double, features "
        "array<struct<feature string, importance double>>")


# boosted trees


class Paths:
    """Trees as arrays, for walking many rows down all of them. credit() gives each split's change of the node's value to the split's
    feature; with the roots' values the credits of a row sum to the model's value for it."""

    def __init__(self, trees: list[dict[int, dict]], weights: list[float], features: int):
        self.weights, self.features, self.trees = weights, features, []
        for tree in trees:
            ids = {k: i for i, k in enumerate(sorted(tree))}
            at = [tree[k] for k in sorted(tree)]
            self.trees.append((
                np.array([0 if x["left"] is None else x["feature"] for x in at]), np.array([np.inf if x["left"] is None else x["cut"] for x in at]),
                np.array([i if x["left"] is None else ids[x["left"]] for i, x in enumerate(at)]),
                    np.array([i if x["left"] is None else ids[x["right"]] for i, x in enumerate(at)]), np.array([x["value"] for x in at], float),
            ))
        self.base = sum(w * t[4][0] for w, t in zip(weights, self.trees, strict=True))

    def credit(self, x: np.ndarray) -> np.ndarray:
        out, line = np.zeros((len(x), self.features)), np.arange(len(x))
        for weight, (feature, cut, left, right, value) in zip(self.weights, self.trees, strict=True):
            node = np.zeros(len(x), np.int64)
            while True:
                f = feature[node]
                after = np.where(x[line, f] <= cut[node], left[node], right[node])
                if (after == node).all():
                    break
                np.add.at(out, (line, f), weight * (value[after] - value[node]))
                node = after
        return out


def boosted(rows: DataFrame, positive: str, features: list[str], trees: int = 20, depth: int = 4, rate: float = 0.1,
    seed: int = 1) -> tuple[GBTClassifier, Paths]:
    """Boosted trees on a 0/1 column, and their paths. The value that paths explain is the model's margin."""
    x = array_to_vector(F.array(*[clean(F.col(f"`{c}`").cast("double")) for c in features]))
    model = GBTClassifier(labelCol="_y", maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=0.85,
        seed=seed).fit(rows.select(F.col(positive).cast("double").alias("_y"), x.alias("features")))
    return model, Paths(nodes(model), list(model.treeWeights), len(features))


def mean_credits(rows: DataFrame, group: str, features: list[str], paths: Paths) -> DataFrame:
    """group, feature, n, mean_abs, mean: the credits of each feature over each group's rows. Tasks add up their rows."""

    def run(batches):
        sums: dict[str, list] = {}
        for pdf in batches:
            x = np.nan_to_num(pdf[features].to_numpy(float), nan=0.0, posinf=0.0, neginf=0.0)
            credit = paths.credit(x)
            for name, at in pdf.groupby(group).indices.items():
                held = sums.setdefault(name, [0, 0.0, 0.0])
                held[0], held[1], held[2] = held[0] + len(at), held[1] + np.abs(credit[at]).sum(axis=0), held[2] + credit[at].sum(axis=0)
        for name, (n, absolute, plain) in sums.items():
            yield pd.DataFrame({"g": name, "feature": features, "n": n, "a": absolute, "s": plain})

    out = rows.select(F.col(group).cast("string").alias(group), *features).mapInPandas(run, "g string, feature string, n long, a double, s double")
    return out.groupBy(F.col("g").alias(group), "feature").agg(F.sum("n").alias("n"), (F.sum("a") / F.sum("n")).alias("mean_abs"),
        (F.sum("s") / F.sum("n")).alias("mean"))


def class_attributions(rows: DataFrame, label: str, features: list[str], top: int = 20, **options) -> DataFrame:
    """class, feature, mean_abs, place: boosted trees of each class against all others, and what they credit their own class's rows to;
    the `top` features of each class. One model a class: for tens. Every model reads rows several times, so they are kept once."""
    rows = keep(rows.select(F.col(label).cast("string").alias(label), *[F.col(f"`{c}`") for c in features]), "attributed")
    names = sorted(r["l"] for r in rows.select(F.col(label).cast("string").alias("l")).distinct().collect())  # a row for each class
    parts = []
    for name in names:
        mine = rows.withColumn("_of", (F.col(label).cast("string") == name).cast("int"))
        _, paths = boosted(mine, "_of", features, **options)
        parts.append(mean_credits(rows.where(F.col(label).cast("string") == name), label, features, paths).withColumnRenamed(label, "class"))
    all_ = reduce(DataFrame.unionByName, parts).select("class", "feature", "mean_abs")
    order = F.array_sort(F.collect_list(F.struct((-F.col("mean_abs")).alias("down"), "feature")))  # a row for each feature
    ranked = all_.groupBy("class").agg(F.slice(order, 1, top).alias("best")).select("class", F.posexplode("best").alias("place", "b"))
    return ranked.select("class", "b.feature", (-F.col("b.down")).alias("mean_abs"), (F.col("place") + 1).cast("long").alias("place"))


# fusion of features by logistic regression


def fusion_scores(df: DataFrame, positive: str, key: str, features: list[str], folds_: int = 5, seed: int = 42) -> tuple[DataFrame, dict[str, float]]:
    """key, y, score (of the model that didn't see the row), and the coefficients of the model of all rows: scaled features, balanced
    classes, as many stratified folds as the smaller class has rows, five at most."""
    made, names = assemble(df, features)
    rows, _, counts = _indexed(made.withColumn("_label", F.col(positive).cast("int")), "_label")
    stats = rows.agg(*[F.struct(F.avg(F.col("x")[k]).alias("m"), F.stddev_pop(F.col("x")[k]).alias("s")).alias(f"f{k}") for k in range(len(names))]).first()
    scaled = F.array(*[(F.col("x")[k] - stats[f"f{k}"]["m"]) / (stats[f"f{k}"]["s"] or 1.0) for k in range(len(names))])
    rows = keep(rows.select(F.col(key).alias(key), "y", "w", array_to_vector(scaled).alias("features")), "fusion")
    kind = LogisticRegression(labelCol="y", weightCol="w", regParam=0.01, maxIter=50, standardization=False)
    n = max(2, min(folds_, *counts.values()))
    cut = keep(folds(rows, "y", key, n, seed), "folds")
    parts = [kind.fit(cut.where(F.col("fold") != k)).transform(cut.where(F.col("fold") == k)).select(key, F.col("y").cast("int").alias("y"),
        vector_to_array("probability")[1].alias("score")) for k in range(n)]
    return reduce(DataFrame.unionByName, parts), dict(zip(names, map(float, kind.fit(rows).coefficients), strict=True))


def threshold_table(scored: DataFrame, score: str, positive: str, targets: list[float]) -> DataFrame:
    """note, target, threshold, tp, fp, fn, tn, tpr, fpr, fnr, precision: of the scores' ROC the threshold whose fpr is nearest to each target
    (ties: the highest threshold), and the one of the largest tpr - fpr (note best_youden, target null)."""
    points = curve(scored, score, positive)
    total = points.agg(F.max("tp").alias("p"), F.max("fp").alias("q"))
    points = keep(points.join(F.broadcast(total), how="cross"), "roc")  # one row
    near = [points.agg(F.min_by(F.struct("threshold", "tp", "fp", "tpr", "fpr", "precision", "p", "q"), F.struct(F.round(F.abs(F.col("fpr") - t), 12),
        -F.col("threshold"))).alias("b")).select(F.lit("").alias("note"), F.lit(t).alias("target"), "b.*") for t in targets]
    best = points.agg(F.min_by(F.struct("threshold", "tp", "fp", "tpr", "fpr", "precision", "p", "q"), F.struct(F.round(F.col("fpr") - F.col("tpr"),
        12), -F.col("threshold"))).alias("b"))
    out = reduce(DataFrame.unionByName, [*near, best.select(F.lit("best_youden").alias("note"), F.lit(None).cast("double").alias("target"), "b.*")])
    return out.select("note", "target", "threshold", "tp", "fp", (F.col("p") - F.col("tp")).alias("fn"), (F.col("q") - F.col("fp")).alias("tn"),
        "tpr", "fpr", (1 - F.col("tpr")).alias("fnr"), "precision")
