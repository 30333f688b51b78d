"""Blocks of the open-set loop in the driver: the same results as tables, few jobs, and either way after the other."""

from itertools import product

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowlens.operators import clusters, in_place, increments, lifecycle
from flowlens.streaming.open_set import OpenSet


def plain(keys, x, eps, least):
    """Density clusters by all pairs."""
    mean, std = in_place.scales(x)
    z = (x - mean) / std
    near = ((z[:, None] - z[None]) ** 2).sum(axis=2) <= eps * eps
    core = near.sum(axis=1) >= least
    out = np.full(len(x), in_place.NOISE)
    for i in np.argsort(keys):
        todo = [i] if core[i] and out[i] == in_place.NOISE else []
        while todo:
            j = todo.pop()
            if out[j] == in_place.NOISE:
                out[j] = keys[i]
                todo += list(np.flatnonzero(near[j] & core))
    border = out.copy()
    for i in np.flatnonzero(~core):
        border[i] = min(out[near[i] & core], default=in_place.NOISE)
    return border


def test_clusters_by_all_pairs():
    for t in range(60):
        rng = np.random.default_rng(t)
        d, n = rng.integers(1, 6), rng.integers(1, 300)
        x = rng.normal(size=(n, d)) * rng.uniform(0.1, 3, d) + rng.integers(0, 3, (n, 1)) * rng.uniform(0, 4, d)
        x = np.round(x, 1) if t % 3 == 0 else x
        keys, eps, least = rng.permutation(n) * 3 - 50, rng.uniform(0.05, 0.9), int(rng.integers(1, 12))
        assert (in_place.density_clusters(keys, x, eps, least) == plain(keys, x, eps, least)).all()


def test_classes_and_samples_are_those_of_tables(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(np.concatenate([rng.normal(c, 0.2, (150, 2)) for c in (0, 3, 6)] + [rng.uniform(-3, 9, (60, 2))]), columns=["x", "y"])
    pdf = pdf.assign(row_index=rng.permutation(len(pdf)), learner=rng.choice(["a", "b"], len(pdf)), loss=np.round(rng.random(len(pdf)), 2))
    df = spark.createDataFrame(pdf)
    of = clusters.new_classes(df, "row_index", ["x", "y"], 0.15, 5, 30).toPandas().set_index("row_index")["cluster"]
    found = in_place.new_classes(pdf, ["x", "y"], 0.15, 5, 30)
    assert len(set(found)) > 2 and (pdf["row_index"].map(of).fillna(-1).to_numpy() == found).all()
    for most, share, stratified in product((7, 40, 10**6), (0.3, 1.0), (True, False)):
        rows = {r["row_index"] for r in increments.subsample(df, most, share, stratified).collect()}
        mine = [part.iloc[in_place.subsample(part["loss"].to_numpy(), part["row_index"].to_numpy(), most, share, stratified)] for _, part in pdf.groupby("learner")]
        assert set(pd.concat(mine)["row_index"]) == rows


def test_reasons_are_those_of_tables(spark):
    rng = np.random.default_rng(1)
    rows = [(str(rng.choice(["NEW_1", "BENIGN", "DOS"])), bool(rng.random() < 0.3), int(rng.integers(0, 4)), int(rng.integers(0, 3)), int(rng.choice([0, 5, 40])), int(rng.integers(90, 200)),
             None if rng.random() < 0.3 else int(rng.integers(0, 150)), float(rng.random()), float(rng.random())) for _ in range(200)]
    shape = "learner string, is_benign boolean, window_id long, birth_window long, kept long, latest long, last_trained long, benign_prob double, exceed double"
    df = spark.createDataFrame(rows, shape).coalesce(1)
    for gate in (lifecycle.Gate(least_rows=20), lifecycle.Gate(freeze_benign=True, cooldown_windows=2, by_gap=True, least_rows=50), lifecycle.Gate(least_rows=3, least_benign_prob=0.5, most_exceed=0.4)):
        found = df.withColumn("reason", lifecycle.batch_reason(gate)).collect()
        assert [r["reason"] for r in found] == [in_place.batch_reason(gate, {**r.asDict(), "retrains": 0}) for r in found]
    assert in_place.batch_reason(lifecycle.Gate(least_rows=1, most_retrains=2), found[0].asDict() | {"kept": 9, "retrains": 2}) == "max_retrain_per_learner"


@pytest.fixture(scope="module")
def blocks(spark):
    """Seeds, and two blocks in which a new class comes up."""
    rng = np.random.default_rng(8)

    def made(start, *parts):
        rows = [(label, *map(float, rng.normal(at, 0.3, 2))) for label, at, n in parts for _ in range(n)]
        return spark.createDataFrame([(start + i, *rows[i]) for i in rng.permutation(len(rows)).tolist()], "row_index long, label string, x double, y double")

    known = (("BENIGN", (0, 0), 300), ("DOS", (6, 0), 300))
    return made(0, *known), [made(1000 * k, *known, ("SCAN", (3, 20), 150)) for k in (1, 2)]


def loop(spark, root, **options):
    return OpenSet(spark, str(root), ["x", "y"], **{"eps": 0.3, "least": 5, "least_class": 40, "trigger": 100, "risk": 1e-2, **options})


def test_a_block_takes_few_jobs(spark, blocks, tmp_path):
    """Blocks of few rows come one after the other: jobs, not rows, are what they take time for."""
    run = loop(spark, tmp_path, gate=lifecycle.Gate(least_rows=50, benign_confidence=1.0), guard=increments.Guard(rows=60, trees=20), most_new=80, history_rows=100, pool_rows=300)
    run.start(blocks[0], "label")
    run.batch(blocks[1][0], 0)
    spark.sparkContext.setJobGroup("second block", "")
    try:
        run.batch(blocks[1][1], 1)
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert 0 < len(spark.sparkContext.statusTracker().getJobIdsForGroup("second block")) <= 25
    assert run.label_counts().agg(F.sum("n")).first()[0] == 1500 and {"NEW_1"} <= {r["learner"] for r in run.learners().collect()}


@pytest.mark.parametrize("first, second", [(0, 250_000), (250_000, 0)])
def test_either_way_after_the_other(spark, blocks, tmp_path, first, second):
    run = loop(spark, tmp_path, small_rows=10, small_trigger=0)
    run.start(blocks[0], "label")
    for number, most in enumerate((first, second)):
        run.driver_rows = most
        run.batch(blocks[1][number], number)
        assert (run._held is not None) == (most > 0)
    owners = {r["row_index"]: r["assigned_learner"] for r in run.owners().collect()}
    truth = {r["row_index"]: r["label"] for b in blocks[1] for r in b.collect()}
    assert set(owners) == set(truth)
    scans = [owners[i] for i in truth if truth[i] == "SCAN"]
    assert np.mean([name == "NEW_1" for name in scans]) > 0.9
    assert {(r["learner"], r["label"]): r["n"] for r in run.label_counts().collect()} == pd.Series([(owners[i], truth[i]) for i in truth]).value_counts().to_dict()
    log = run.window_log().orderBy("window_id").collect()
    assert [(r["rows"], r["next_id"]) for r in log] == [(750, 2), (750, 2)]
