"""Trees, attributions, fusion, comparisons, communities, expressions as text."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from flowlens.operators import communities, comparisons, evaluation, trees
from flowlens.operators import expressions as E
from flowlens.plans import registry


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    rows = []
    for k in range(600):
        a, b = float(rng.random()), float(rng.integers(0, 9))
        rows.append((k, a if k % 10 else None, b, ["u", "v", None][k % 3], "attack" if a > 0.6 and b > 3 else "benign", int(a > 0.6 and b > 3)))
    return spark.createDataFrame(rows, "id long, a double, `b c` double, kind string, label string, y int").repartition(4).cache()


def test_assembly(spark, table):
    made, names = trees.assemble(table, ["a", "b c"], ["kind"])
    assert names == ["a", "b c", "kind_u", "kind_v"]
    values = [r["a"] for r in table.collect() if r["a"] is not None]
    for r in made.collect():
        want = [r["a"] if r["a"] is not None else np.median(values), r["b c"], float(r["kind"] in ("u", None)), float(r["kind"] == "v")]
        assert r["x"] == pytest.approx(want)
    with pytest.raises(ValueError):
        trees.assemble(table, [], ["kind"], most_categories=1)
    nothing, names = trees.assemble(table.where("false"), ["a"], ["kind"])
    assert nothing.count() == 0 and names == ["a"]


def walk(rules, row):
    """The class that rule text gives a row."""
    lines, depth, k = rules.splitlines(), 0, 0
    while True:
        text = lines[k].replace("|   ", "").removeprefix("|--- ")
        if text.startswith("class: "):
            return text.removeprefix("class: ")
        name, _, cut = text.rpartition(" <= ") if " <= " in text else text.rpartition(" >  ")
        if row[name] <= float(cut):
            k, depth = k + 1, depth + 1
        else:
            bar = "|   " * depth + f"|--- {name} >  "
            k = next(i for i in range(k + 1, len(lines)) if lines[i].startswith(bar)) + 1
            depth += 1


def test_tree_report(spark, table):
    clean = table.where("a is not null").withColumn("a", F.floor(F.col("a") * 10) / 10)
    report = trees.tree_report(clean, "label", "id", ["a", "b c"], depth=4)
    assert report["n"] == 540 and report["folds"] == 5 and report["train_accuracy"] == pytest.approx(1.0) and report["auc"] > 0.98
    assert sum(n for *_, n in report["confusion"]) == 540 and {n for n, _ in report["importances"]} == {"a", "b c"}
    wrong = sum(n for a, b, n in report["confusion"] if a != b)
    assert report["cv_accuracy_mean"] == pytest.approx(1 - wrong / 540, abs=0.01)
    assert all(walk(report["rules"], r.asDict()) == r["label"] for r in clean.collect())
    one = trees.tree_report(clean.where("label = 'benign'"), "label", "id", ["a"])
    assert one["folds"] == 0 and one["rules"] == "|--- class: benign\n"


def test_credits_add_up_to_the_margin(spark, table):
    names = ["a", "b c"]
    model, paths = trees.boosted(table, "y", names, trees=6, depth=3)
    x = array_to_vector(F.array(*[F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) for c in names]))
    rows = model.transform(table.withColumn("features", x)).select("id", "a", "`b c`", "label", vector_to_array("rawPrediction")[1].alias("margin")).collect()
    matrix = np.array([[r["a"] or 0.0, r["b c"]] for r in rows])
    credit = paths.credit(matrix)
    margins = np.array([r["margin"] for r in rows])
    total = paths.base + credit.sum(axis=1)
    assert np.allclose(total, margins) or np.allclose(2 * total, margins)
    got = {(r["label"], r["feature"]): r for r in trees.mean_credits(table, "label", names, paths).collect()}
    for label in ("attack", "benign"):
        at = [k for k, r in enumerate(rows) if r["label"] == label]
        for j, c in enumerate(names):
            assert got[label, c]["mean_abs"] == pytest.approx(np.abs(credit[at, j]).mean()) and got[label, c]["mean"] == pytest.approx(credit[at, j].mean()) and got[label, c]["n"] == len(at)


def test_forests_skip_small_groups(spark, table):
    got = {r["learner"]: r for r in trees.forest_explanations(table.where("a is not null"), "label", "id", ["a", "b c"], least=200, trees=3).collect()}
    assert got["attack"]["reason"] == "insufficient_samples" and got["attack"]["auc"] is None
    both = {r["learner"]: r for r in trees.forest_explanations(table.where("a is not null"), "label", "id", ["a", "b c"], least=20, trees=5, top=1).collect()}
    assert both["attack"]["auc"] > 0.95 and len(both["attack"]["features"]) == 1


def _mllib_cuts(x, most=32):
    """MLlib's walk over a feature's values, without its sample."""
    values, counts = np.unique(x, return_counts=True)
    n, aim, cuts = counts[0], len(x) / most, []
    for k in range(1, len(values)):
        gap, n = abs(n - aim), n + counts[k]
        if gap < abs(n - aim):
            cuts.append((values[k - 1] + values[k]) / 2)
            aim += len(x) / most
    return cuts


def test_bins_and_draws_are_of_all_rows(spark):
    """A forest trains on counts of bins: cuts are exact over all rows, rows are drawn one by one, the same for any partitions."""
    rng = np.random.default_rng(3)
    values = [(k, [float(k % 7), float(rng.normal())], k % 2) for k in range(30_000)] + [(30_000, [99.0, 0.0], 1)]  # 99 occurs once
    rows = spark.createDataFrame(values, "id long, x array<double>, y int")
    few, many = trees.bin_cuts(rows, 2)
    assert few == [0.5, 1.5, 2.5, 3.5, 4.5, 5.5, 52.5]
    assert many == _mllib_cuts([v[1][1] for v in values]) and len(many) == 31
    # a frequent value takes the room of several bins; the cuts that it leaves are between the next values
    skewed = [float(k if k >= 600 else 5) for k in range(1000)]
    assert trees.bin_cuts(spark.createDataFrame([([v, 0.0],) for v in skewed], "x array<double>"), 2) == [_mllib_cuts(skewed), []]
    got, again = (sorted((r["y"], tuple(r["features"]), r["n"], r["drawn_0"], r["drawn_1"]) for r in trees.bin_counts(x, ["y"], [few, many], {"n": F.lit(1)},
        ["id"], 2, 1).collect()) for x in (rows.repartition(3), rows.repartition(11)))
    assert got == again and sum(r[2] for r in got) == len(values) and len(got) < 2 * 8 * 32
    each = trees.bin_counts(rows, ["id"], [[], few], {"n": F.lit(1)}, ["id"], 2, 1)  # a row for each row
    draws = each.agg(F.avg("drawn_0"), F.var_pop("drawn_0"), F.corr("drawn_0", "drawn_1")).first()
    assert draws[0] == pytest.approx(1, abs=0.03) and draws[1] == pytest.approx(1, abs=0.05) and abs(draws[2]) < 0.03
    want = dict.fromkeys(((v[2], sum(v[1][0] > c for c in few), sum(v[1][1] > c for c in many)) for v in values), 0)
    for v in values:
        want[v[2], sum(v[1][0] > c for c in few), sum(v[1][1] > c for c in many)] += 1
    assert {(r[0], *map(int, r[1])): r[2] for r in got} == want


def test_a_tree_of_counts_is_the_tree_of_rows(spark):
    """Leaves have as many rows as asked for, and rows predict what MLlib's tree of the rows predicts."""
    rng = np.random.default_rng(5)
    made = [(float(a), float(b), float((a > 4) ^ (b > 2) if rng.random() < 0.9 else rng.random() < 0.5)) for a, b in zip(rng.integers(0, 9, 4000),
        rng.integers(0, 5, 4000), strict=True)]
    rows = spark.createDataFrame(made, "a double, b double, y double").withColumn("x", F.array("a", "b"))
    counts = trees.bin_counts(rows, ["a", "b", "y"], trees.bin_cuts(rows, 2), {"n": F.lit(1)}, ["a"], 0, 1)
    said = {(r["a"], r["b"]): r["prediction"] for r in trees.counted_tree(counts, "y", "n", 3, 300, 1).transform(counts).collect()}
    plain = DecisionTreeClassifier(labelCol="y", maxDepth=3, minInstancesPerNode=300, seed=1).fit(rows.withColumn("features", array_to_vector("x")))
    assert said == {(r["a"], r["b"]): r["prediction"] for r in plain.transform(rows.withColumn("features", array_to_vector("x"))).collect()}
    assert trees.counted_tree(counts, "y", "n", 3, 2001, 1).numNodes == 1
    report = {r["class"]: r["support"] for r in evaluation.class_report(counts.select("y", "n"), "y", "y", "n").collect()}
    assert report == {c: sum(v[2] == c for v in made) for c in (0.0, 1.0)}


def test_forest_importance_reads_no_rows_in_its_fits(spark, sf_dir, monkeypatch):
    """The forest is fit on counts, and its importances are of all features."""
    sizes = []
    whole = trees.bagged_trees
    monkeypatch.setattr(trees, "bagged_trees", lambda counts, *a, **k: sizes.append(counts.agg(F.count("*"), F.sum("n")).first()) or whole(counts, *a, **k))
    rows = {r["feature"]: r["importance"] for r in registry.queries()["ml25_forest_importance"](spark, sf_dir).collect()}
    assert list(rows) == ["l_quantity", "l_discount", "bwd", "l_linenumber", "dst_port"] and sum(rows.values()) == pytest.approx(1)
    assert len(sizes) == 1 and sizes[0][1] == spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() > sizes[0][0]


def test_explanations_read_rows_a_bounded_number_of_times(spark, table, monkeypatch):
    """However many groups there are, forests are fit on counts of bins, not on rows; and they don't depend on the partitions."""
    sizes = []
    whole = trees.bagged_trees
    monkeypatch.setattr(trees, "bagged_trees", lambda counts, *a: sizes.append(counts.count()) or whole(counts, *a))
    many = table.where("a is not null").select(F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k"), "*").select((F.col("id") * 10 + F.col("k")).alias("id"), F.round("a", 1).alias("a"), "`b c`", "label")
    got, again = (trees.forest_explanations(x, "label", "id", ["a", "b c"], least=20, trees=3).collect() for x in (many, many.repartition(7)))
    assert got == again and len(sizes) == 4 and max(sizes) < 250
    assert all(r["auc"] > 0.95 for r in got) and sum(r["positives"] for r in got) == 5400


def test_fusion_scores_every_row_once(spark, table):
    scored, weights = trees.fusion_scores(table, "y", "id", ["a", "b c"])
    rows = scored.collect()
    assert sorted(r["id"] for r in rows) == list(range(600)) and weights["a"] > 0 and weights["b c"] > 0
    mean = lambda y: np.mean([r["score"] for r in rows if r["y"] == y])
    assert mean(1) > mean(0) + 0.3


def test_threshold_table(spark):
    scored = [(0.9, 1), (0.8, 1), (0.7, 0), (0.6, 1), (0.4, 0), (0.3, 0), (0.2, 0)]
    got = {(r["note"], r["target"]): (r["threshold"], r["tp"], r["fp"], r["fn"], r["tn"]) for r in trees.threshold_table(spark.createDataFrame(scored, "s double, y int"), "s", "y", [0.2, 0.9]).collect()}
    assert got == {("", 0.2): (0.7, 2, 1, 1, 3), ("", 0.9): (0.2, 3, 4, 0, 0), ("best_youden", None): (0.6, 3, 1, 0, 3)}


def test_residual_scores(spark):
    rng = np.random.default_rng(1)
    errors = [list(map(float, rng.random(n))) for n in (1, 2, 10, 33)]
    df = spark.createDataFrame([(k, e) for k, e in enumerate(errors)], "k int, e array<double>")
    got = df.select("k", *[x.alias(c) for c, x in comparisons.residual_scores(F.col("e"), 0.25).items()]).collect()
    for r in got:
        e = np.array(errors[r["k"]])
        assert r["mean_mse"] == pytest.approx(e.mean()) and r["p90_error"] == pytest.approx(np.quantile(e, 0.9)) and r["topk_mse"] == pytest.approx(np.sort(e)[::-1][: max(1, len(e) // 4)].mean())


def test_one_class_models_across_years(spark):
    rng = np.random.default_rng(2)
    rows = [(k, 2017, 0, *map(float, rng.normal(0, 1, 2))) for k in range(400)] + [(400 + k, 2019, 0, *map(float, rng.normal(0, 1, 2))) for k in range(200)] + [(600 + k, 2019, 1, *map(float, rng.normal(6, 0.5, 2))) for k in range(100)]
    df = spark.createDataFrame(rows, "id long, year int, attack int, x double, y double").repartition(3)
    scored = comparisons.one_class_rows(df, F.col("year") == 2017, F.col("year") == 2019, F.col("attack") == 1, "id", ["x", "y"], ["iforest", "ae", "ocsvm"])
    found = scored.collect()
    got = {r["backend"]: r for r in comparisons.cross_tests(scored).collect()}
    for name in ("iforest", "ae", "ocsvm"):
        train = [r["loss"] for r in found if r["backend"] == name and r["part"] == "train"]
        test = [(r["loss"], r["is_attack"]) for r in found if r["backend"] == name and r["part"] == "test"]
        limit = np.quantile(train, 0.95)
        assert len(train) == 400 and len(test) == 300 and got[name]["p95"] == pytest.approx(limit)
        assert got[name]["accuracy"] == pytest.approx(np.mean([(v > limit) == y for v, y in test]))
        assert got[name]["recall"] > 0.95 and (got[name]["auc"] > 0.95 or name == "ae")


def plain_communities(edges):
    """Louvain, one node after the other."""
    near = defaultdict(lambda: defaultdict(float))
    for a, b, w in edges:
        near[a][b] += w
        near[b][a] += w
    total = sum(sum(x.values()) for x in near.values())
    member = {x: x for x in near}
    while True:
        own, degree = {x: x for x in near}, {x: sum(near[x].values()) for x in near}
        size, moved = dict(degree), False
        again = True
        while again:
            again = False
            for x in sorted(near):
                size[own[x]] -= degree[x]
                weight = defaultdict(float, {own[x]: 0.0})
                for y, w in near[x].items():
                    if y != x:
                        weight[own[y]] += w
                best = max(sorted(weight), key=lambda c: weight[c] - degree[x] * size[c] / total + (1e-12 if c == own[x] else 0))
                size[best] += degree[x]
                if best != own[x]:
                    own[x], again, moved = best, True, True
        if not moved:
            return member
        member = {x: own[c] for x, c in member.items()}
        up = defaultdict(lambda: defaultdict(float))
        for x in near:
            for y, w in near[x].items():
                up[own[x]][own[y]] += w
        near = up


def test_communities_are_as_good_as_plain_ones(spark):
    rng = random.Random(1)
    edges = [(f"n{i:02d}", f"n{j:02d}", round(rng.random() + 0.5, 2)) for i in range(60) for j in range(i + 1, 60) if rng.random() < (0.5 if i % 3 == j % 3 else 0.1)]
    df = spark.createDataFrame(edges, "a string, b string, weight double")
    found = communities.modularity_communities(df, spark.createDataFrame([("alone",), ("n00",)], "node string"))
    rows = {r["node"]: r["community"] for r in found.collect()}
    assert rows["alone"] == "alone" and len(rows) == 61 and all(min(x for x in rows if rows[x] == c) == c for c in rows.values())
    plain = spark.createDataFrame(list(plain_communities(edges).items()), "node string, community string")
    assert communities.modularity(df, found) >= 0.99 * communities.modularity(df, plain)
    assert communities.modularity_communities(df.where("false")).count() == 0


def test_expressions_are_read_as_they_are_written():
    names = ["Flow Bytes/s", "Flow IAT Mean", "a", "Act Max", "b-c", "x (y)"]
    rng = random.Random(3)
    for dialect in (E.OPERATORS, E.WORDS):
        for _ in range(300):
            tree = E.grow(rng, names, 4, dialect)
            text = E.text(tree, dialect)
            assert E.text(E.parse(text, names, dialect), dialect) == text
    assert E.parse("a - b-c - a", names) == E.apply("-", "a", E.apply("-", "b-c", "a"))
    assert E.parse("a * Act Max + a", names) == E.apply("+", E.apply("*", "a", "Act Max"), "a")
    assert E.parse("  ((Flow IAT Mean / -1.5e2)) ", names) == E.apply("/", "Flow IAT Mean", -150.0)
    assert E.parse("-a", names) == E.parse("(-a)", names) == E.apply("neg", "a")
    for wrong in ("", "(a + b-c", "a +", "nowhere + a", "a b-c", "abs(a", "a + + a", "1.2.3"):
        with pytest.raises(ValueError):
            E.parse(wrong, names)


def test_second_dialect(spark):
    df = spark.createDataFrame([(1, 2.0, 0.0, 0), (2, -3.0, 1e-9, 1)], "id long, a double, b double, y int")
    got = [r["x"] for r in df.select(E.column(E.parse("(sqrt(a) div b)", ["a", "b"], E.WORDS), E.WORDS).alias("x")).collect()]
    assert got == pytest.approx([2**0.5 / 1e-8, 3**0.5 / 1e-8])
    rng = np.random.default_rng(0)
    rows = [(k, float(v), float(rng.random()), int(v > 0)) for k, v in enumerate(rng.normal(size=400))]
    best = E.search_split(spark.createDataFrame(rows, "id long, a double, b double, y int"), ["a", "b"], "y", "id", population=8, generations=2)
    assert best == sorted(best, key=lambda r: (-r[4], -r[2], r[0])) and best[0][4] > 0.9 and all(0 <= v <= 1 for r in best for v in r[1:])
