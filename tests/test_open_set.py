"""The open-set loop and what it is made of: increments, guards, counters, purity, learners that are put back."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.operators import clusters, increments, lifecycle, models, overlap, purity
from flowlens.streaming.open_set import OpenSet

FEATURES = ["x", "y"]


def blob(rng, centre, n, label, start):
    return [(start + k, label, *map(float, rng.normal(centre, 0.3, 2))) for k in range(n)]


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """Benign and one attack are known; a second attack comes with the stream, in two far places."""
    rng = np.random.default_rng(4)
    known = blob(rng, (0, 0), 400, "BENIGN", 0) + blob(rng, (6, 0), 300, "DOS", 400)
    later = []
    for k in range(3):
        start = 1000 + 600 * k
        rows = blob(rng, (0, 0), 250, "BENIGN", 0) + blob(rng, (6, 0), 150, "DOS", 0) + blob(rng, (0, 9), 120, "SCAN", 0) + blob(rng, (9, 9), 80, "SCAN", 0)
        rng.shuffle(rows)
        later += [(start + i, str(r[1]), float(r[2]), float(r[3])) for i, r in enumerate(rows)]
    shape = "row_index long, label string, x double, y double"
    folder = str(tmp_path_factory.mktemp("world"))
    stream = spark.createDataFrame(later, shape)
    for part in range(3):
        stream.where((F.col("row_index") - 1000 >= 600 * part) & (F.col("row_index") - 1000 < 600 * (part + 1))).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.createDataFrame(known, shape), later, f"{folder}/in", shape


def loop(spark, tmp_path, **options):
    return OpenSet(spark, str(tmp_path), FEATURES, **{"backend": "iforest", "eps": 0.2, "least": 5, "least_class": 40, "trigger": 100, "risk": 1e-2, **options})


def source(spark, world, files=1):
    return spark.readStream.schema(world[3]).option("maxFilesPerTrigger", files).parquet(world[2])


def test_new_classes_are_born_and_taken(spark, world, tmp_path):
    run = loop(spark, tmp_path, gate=lifecycle.Gate(least_rows=50, benign_confidence=1.0), guard=increments.Guard(rows=60, keep=0.95), most_new=80, history_rows=100, pool_rows=300)
    run.start(world[0], "label")
    owners = {r["row_index"]: (r["assigned_learner"], r["phase"]) for r in run.run(source(spark, world)).collect()}
    truth = {i: (label, y, x) for i, label, x, y in world[1]}
    assert set(owners) == set(truth)
    names = {n for n, _ in owners.values()}
    assert {"BENIGN", "DOS", "NEW_1", "NEW_2"} <= names
    for name, phase in set(owners.values()):
        rows = [truth[i] for i, o in owners.items() if o == (name, phase)]
        if name.startswith("NEW_") and phase == "creation":
            assert np.mean([t[0] == "SCAN" for t in rows]) > 0.9 and len({t[2] > 4.5 for t in rows if t[0] == "SCAN"}) == 1
    # counters are those of a recount
    labels = {}
    for i, (name, _) in owners.items():
        labels[name, truth[i][0]] = labels.get((name, truth[i][0]), 0) + 1
    assert {(r["learner"], r["label"]): r["n"] for r in run.label_counts().collect()} == labels
    log = run.window_log().orderBy("window_id").collect()
    assert [(r["window_left"], r["window_right"], r["rows"]) for r in log] == [(1000 + 600 * k, 1600 + 600 * k, 600) for k in range(3)]
    assert log[-1]["next_id"] == 1 + sum(r["learner"].startswith("NEW_") for r in run.learners().select("learner").collect())
    assert all(r["window_seconds"] >= r["detect_seconds"] > 0 for r in log)
    # the trace has each accepted row of a known learner once, and its reasons add up
    trace = run.trace().collect()
    assert len(trace) == len({(r["row_index"]) for r in trace})
    reasons = {r["reason"] for r in trace}
    assert {"", increments.GUARD_FILTERED, increments.SUBSAMPLED} <= reasons
    assert all(r["used"] == (r["reason"] == "") for r in trace)
    per = {}
    for r in trace:
        per.setdefault((r["learner"], r["window_left"]), []).append(r["used"])
    grown = {(r["learner"], 1000 + 600 * r["window_id"]) for r in run.increment_losses().collect()}
    assert grown == {k for k, used in per.items() if any(used)} and all(sum(used) <= 80 for used in per.values())
    held = {r["learner"]: r for r in run.learners().collect()}
    for name in ("BENIGN", "DOS"):
        assert held[name]["retrains"] == sum(k[0] == name for k in grown) > 0
        assert held[name]["last_trained"] == max(r["row_index"] for r in trace if r["learner"] == name and (name, r["window_left"]) in grown)
        assert held[name]["guard"] is not None and held[name]["seed_count"] > 0
    assert all(r["n"] <= 300 for r in run.pools().groupBy("learner").agg(F.count("*").alias("n")).where("learner not like 'NEW_%'").collect())


@pytest.mark.parametrize("files", [1, 2, 3])
def test_counters_don_t_depend_on_blocks(spark, world, tmp_path, files):
    run = loop(spark, tmp_path, trigger=10**9)
    run.start(world[0], "label")
    run.run(source(spark, world, files))
    stream = spark.read.schema(world[3]).parquet(world[2])
    losses = models.score_learners(stream, "row_index", FEATURES, run.learners().collect()).withColumn("is_benign", F.contains("learner", F.lit("BENIGN")))
    taken = overlap.accepted(losses)
    assert {r["learner"]: r["n"] for r in run.accept_counts().collect()} == {r["learner"]: r["n"] for r in taken.groupBy("learner").agg(F.count("*").alias("n")).collect()}
    assert sorted(map(tuple, run.pair_counts().collect())) == sorted(map(tuple, overlap.pair_counts(taken).collect()))
    batch = {r["row_index"]: r["assigned_learner"] for r in overlap.route(losses).collect()}
    assert {r["row_index"]: r["assigned_learner"] for r in run.owners().collect()} == batch
    joined = stream.join(overlap.route(losses), "row_index").groupBy("assigned_learner", "label").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, run.label_counts().collect())) == sorted(map(tuple, joined.collect()))


def test_a_batch_run_again_counts_once(spark, world, tmp_path):
    run = loop(spark, tmp_path, trigger=10**9)
    run.start(world[0], "label")
    rows = spark.read.schema(world[3]).parquet(world[2])
    run.batch(rows, 0)
    before = sorted(map(tuple, run.accept_counts().collect())), sorted(map(tuple, run.label_counts().collect()))
    run.batch(rows, 0)
    assert before == (sorted(map(tuple, run.accept_counts().collect())), sorted(map(tuple, run.label_counts().collect())))


def test_a_full_buffer_counts_what_falls_out(spark, world, tmp_path):
    run = loop(spark, tmp_path, trigger=10**9, most_buffer=50)
    run.start(world[0], "label")
    owners = run.run(source(spark, world)).where("assigned_learner = 'UNKNOWN'").collect()
    kept = {r["row_index"] for r in spark.read.parquet(f"{tmp_path}/buffer/batch=2").collect()}
    assert kept == set(sorted(r["row_index"] for r in owners)[-50:])
    assert run.label_counts().where("learner = 'UNKNOWN'").agg(F.sum("n")).first()[0] == len(owners)


def test_small_learners_are_put_back(spark, world, tmp_path):
    """A class under the limit in its block is put back and clusters again, with a new number."""
    run = loop(spark, tmp_path, small_rows=200, small_trigger=0)
    run.start(world[0], "label")
    owners = {r["row_index"]: r["assigned_learner"] for r in run.run(source(spark, world)).collect()}
    log = run.window_log().orderBy("window_id").collect()
    destroyed, standing = sum(r["destroyed"] for r in log), sum(r["learner"].startswith("NEW_") for r in run.learners().collect())
    assert destroyed >= 1 and standing >= 1 and log[-1]["next_id"] == 1 + destroyed + standing  # numbers are never used again
    gone = {r["learner"] for r in spark.read.parquet(f"{tmp_path}/destroyed").collect()}
    assert not gone & set(owners.values()) and not gone & {r["learner"] for r in run.learners().collect()}
    assert len(owners) == 1800
    truth = {i: label for i, label, _, _ in world[1]}
    labels = {}
    for i, name in owners.items():
        labels[name, truth[i]] = labels.get((name, truth[i]), 0) + 1
    assert {(r["learner"], r["label"]): r["n"] for r in run.label_counts().collect()} == labels


def test_benign_clusters_are_rejected(spark, world, tmp_path):
    """With a tight threshold benign rows are unknown; the gate sends their cluster back, or drops it."""
    for reinject in (True, False):
        run = loop(spark, tmp_path / str(reinject), benign_scale=0.75, purity=purity.PurityGate(most_prob=0.3), reinject=reinject)
        run.start(world[0], "label")
        owners = run.run(source(spark, world, 3)).collect()
        (log,) = run.window_log().collect()
        assert log["checked"] == log["passed"] + log["rejected"] and log["rejected"] >= 1
        lost = log["reinjected"] if reinject else log["dropped"]
        assert lost > 0 and run.label_counts().where("learner = 'UNKNOWN'").agg(F.sum("n")).first()[0] == sum(r["assigned_learner"] == "UNKNOWN" for r in owners)
        assert (log["buffered"] >= lost) == reinject


def test_density_clusters_are_those_of_the_plain_form(spark):
    rng = np.random.default_rng(0)
    for d, n, eps, least, places in ((2, 1500, 0.1, 6, 2), (1, 300, 0.01, 4, 2), (3, 800, 0.3, 5, 1), (2, 600, 0.4, 700, 3)):
        x = np.vstack([rng.normal(c, rng.uniform(0.05, 0.6), (n // 6, d)) for c in range(4)] + [rng.uniform(-3, 6, (n - 4 * (n // 6), d))])
        x = np.round(x, places)
        rng.shuffle(x)
        names = [f"f {k}" for k in range(d)]
        df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "k long, " + ", ".join(f"`{c}` double" for c in names)).repartition(5)
        z = (x - x.mean(axis=0)) / x.std(axis=0)
        want, first = models.dbscan(z, eps, least), {}
        for i in range(len(z)):
            if (((z - z[i]) ** 2).sum(axis=1) <= eps * eps).sum() >= least:
                first.setdefault(want[i], i)
        got = {r["k"]: r["cluster"] for r in clusters.density_clusters(df, "k", names, eps, least).collect()}
        assert got == {i: first[c] for i, c in enumerate(want) if c >= 0}


def test_clusters_of_nothing_and_of_one_place(spark):
    shape = "k long, a double, b double"
    assert clusters.density_clusters(spark.createDataFrame([], shape), "k", ["a", "b"], 0.5, 3).count() == 0
    same = [(k, 1.0, None) for k in range(5)] + [(9, float("nan"), 50.0)]
    got = {r["k"]: (r["cluster"], r["core"]) for r in clusters.density_clusters(spark.createDataFrame(same, shape), "k", ["a", "b"], 0.5, 3).collect()}
    assert got == {k: (0, True) for k in range(5)}
    classes = clusters.new_classes(spark.createDataFrame([(k, float(k // 10), 0.0) for k in range(25)], shape), "k", ["a", "b"], 0.1, 3, 6).collect()
    assert {r["k"]: r["cluster"] for r in classes} == {k: k // 10 for k in range(20)}


def test_thresholds_of_any_number_of_losses(spark):
    rng = np.random.default_rng(0)
    groups = {"exp": rng.exponential(1, 6000), "heavy": rng.pareto(3, 4000), "flat": rng.random(3000), "few": rng.random(50), "mid": rng.random(300)}
    df = spark.createDataFrame([(k, float(v)) for k, x in groups.items() for v in x] + [("exp", float("nan")), ("few", None)], "learner string, loss double").repartition(6)
    got = {r["learner"]: r["threshold"] for r in models.tail_thresholds(df, "learner", "loss").collect()}
    assert got == pytest.approx({k: models.tail_threshold(x) for k, x in groups.items()}, rel=1e-4)
    assert models.tail_thresholds(df.where("false"), "learner", "loss").count() == 0


def plain_thirds(losses, most):
    """Even picks of each third of the order of losses."""
    order = sorted(losses, key=lambda k: (losses[k], k))
    n = len(order)
    if n <= most:
        return set(order)
    per, out = max(1, most // 3), []
    for part in (order[: n // 3], order[n // 3 : 2 * n // 3], order[2 * n // 3 :]):
        k = min(len(part), per)
        out += [part[j * (len(part) - 1) // (k - 1)] if k > 1 else part[0] for j in range(k)]
    return set(out[:most])


@pytest.mark.parametrize("most", [1, 2, 3, 7, 20, 90])
def test_samples_by_loss(spark, most):
    rng = np.random.default_rng(most)
    rows = [(g, k, float(np.round(rng.random(), 2))) for g, n in (("a", 61), ("b", 5), ("c", 1)) for k in range(n)]
    df = spark.createDataFrame(rows, "learner string, row_index long, loss double").repartition(3)
    got = {(r["learner"], r["row_index"]) for r in increments.thirds_by_loss(df, most).collect()}
    even = {(r["learner"], r["row_index"]) for r in increments.spread_by_loss(df, most).collect()}
    for g in "abc":
        losses = {k: v for a, k, v in rows if a == g}
        assert {k for a, k in got if a == g} == plain_thirds(losses, most)
        order = sorted(losses, key=lambda k: (losses[k], k))
        n = len(order)
        assert {k for a, k in even if a == g} == (set(order) if n <= most else {order[j * (n - 1) // (most - 1)] for j in range(most)} if most > 1 else {order[0]})


def test_history_samples(spark):
    rng = np.random.default_rng(1)
    rows = [("a", k, float(rng.random())) for k in range(400)] + [("b", k, float(rng.random())) for k in range(3)]
    df = spark.createDataFrame(rows, "learner string, row_index long, loss double").repartition(3)
    for decay in (0.0, 0.02):
        got = increments.history_sample(df, 0.25, 60, decay).collect()
        assert sum(r["learner"] == "a" for r in got) == 60 and sum(r["learner"] == "b" for r in got) == 1
        if decay:
            assert np.mean([r["row_index"] for r in got if r["learner"] == "a"]) > 300  # newer rows are likelier


def test_growth_goes_on_from_the_parameters(spark):
    rng = np.random.default_rng(2)
    rows = [("ae", k, *map(float, rng.normal(0, 1, 2)), False) for k in range(300)]
    df = spark.createDataFrame(rows, "learner string, row_index long, x double, y double, is_new boolean")
    params = models.fit_learners(df.drop("is_new"), "learner", "row_index", FEATURES, "ae").collect()
    shifted = df.withColumns({"x": F.col("x") * 0.2 + 3, "is_new": F.lit(True)}).unionByName(df.limit(50))
    (grown,) = increments.grow(shifted, FEATURES, params, epochs=20).collect()
    assert grown["after_loss_mean"] < 0.5 * grown["before_loss_mean"] and grown["rows"] == 350
    import pickle

    (mean0, std0, old), (mean1, std1, new) = pickle.loads(params[0]["params"]), pickle.loads(grown["params"])
    assert np.array_equal(mean0, mean1) and np.array_equal(std0, std1) and old.w[0].shape == new.w[0].shape and not np.allclose(old.w[0], new.w[0])
    z = (np.array([[r["x"], r["y"]] for r in shifted.collect()]) - mean1) / std1
    assert grown["after_loss_median"] == pytest.approx(np.median(new.loss(z)), rel=1e-6)


def test_drift(spark):
    pool = spark.createDataFrame([("a", float(k % 5), 1.0) for k in range(50)] + [("b", 1.0, 1.0)] * 5, "learner string, x double, y double")
    rows = spark.createDataFrame([("a", float(k % 3) + 4, 2.0) for k in range(9)] + [("b", 1.0, 1.0)], "learner string, x double, y double")
    old, new = np.array([[k % 5, 1.0] for k in range(50)]), np.array([[k % 3 + 4, 2.0] for k in range(9)])
    want = 0.7 * np.mean(np.abs(new.mean(0) - old.mean(0)) / (old.std(0) + 1e-6)) + 0.3 * np.mean(np.abs(new.std(0) - old.std(0)) / (old.std(0) + 1e-6))
    assert {r["learner"]: r["drift"] for r in lifecycle.drift_scores(pool, rows, FEATURES, 10).collect()} == {"a": pytest.approx(want)}


def test_a_cluster_of_two_groups_is_split(spark):
    rng = np.random.default_rng(3)
    one, two = rng.normal(0, 1, (200, 2)), np.vstack([rng.normal(0, 0.2, (120, 2)), rng.normal(4, 0.2, (80, 2))])
    rows = [(k, 0, *map(float, r)) for k, r in enumerate(one)] + [(1000 + k, 1, *map(float, r)) for k, r in enumerate(two)] + [(5000, 2, 1.0, 1.0), (5001, 2, 1.0, 1.0)]
    got = {r["cluster"]: r for r in purity.split_figures(spark.createDataFrame(rows, "row_index long, cluster long, x double, y double").repartition(3), FEATURES).collect()}
    z = (two - two.mean(0)) / (two.std(0) + 1e-6)
    a, b = z[:120], z[120:]
    gain = 1 - (((a - a.mean(0)) ** 2).sum() + ((b - b.mean(0)) ** 2).sum()) / (z**2).sum()
    d = ((z[:, None] - z[None]) ** 2).sum(2)
    s = [((d[i, 120:].mean() if i < 120 else d[i, :120].mean()) - (own := (d[i, :120].sum() / 119 if i < 120 else d[i, 120:].sum() / 79))) / max(own, d[i, 120:].mean() if i < 120 else d[i, :120].mean()) for i in range(200)]
    assert got[1]["structure_child_ratio"] == pytest.approx(0.4) and got[1]["structure_split_gain"] == pytest.approx(gain) and got[1]["structure_silhouette"] == pytest.approx(np.mean(s))
    assert got[0]["structure_silhouette"] < got[1]["structure_silhouette"] and got[2]["structure_split_gain"] == 0


def test_purity_reasons(spark):
    rows = spark.createDataFrame([(k, k // 10, float(k), 0.0) for k in range(30)], "row_index long, cluster long, x double, y double")
    losses = []
    for k in range(30):
        benign = {0: 0.2, 1: 5.0, 2: 0.2 if k % 2 else 5.0}[k // 10]
        losses += [(k, "BENIGN", benign, 1.0, True), (k, "NEW_1", 0.5 if k // 10 else 9.0, 1.0, False), (k, "NEW_2", 0.4 if k % 2 else 0.6, 1.0, False)]
    table = spark.createDataFrame(losses, "row_index long, learner string, loss double, threshold double, is_benign boolean")
    gate = purity.PurityGate(most_accept=0.6, most_prob=0.6, mixed=True, mixed_low=0.2, mixed_high=0.8, routes=True, route_rows=5, least_multi=0.9, most_top1=0.55)
    got = {r["cluster"]: r for r in purity.judge_clusters(rows, table, FEATURES, gate).collect()}
    assert got[0]["reasons"] == purity.REASONS[:2] and got[1]["reasons"] == purity.REASONS[5:] and got[2]["reasons"] == [purity.REASONS[3], purity.REASONS[5]]
    assert not any(r["passed"] for r in got.values())
    assert got[1]["route_multi_accept_ratio"] == 1.0 and got[1]["route_top1_share"] == 0.5
    none = purity.judge_clusters(rows, table.where("not is_benign"), FEATURES, gate).collect()
    assert all(r["passed"] and r["reasons"] == ["no_benign_anchor_skip"] for r in none)
