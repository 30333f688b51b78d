"""Rows that are equal are worked on once: searches, thresholds, samples; and the short ways of small tables."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import functions as F

from flowlens.operators import comparisons as C
from flowlens.operators import expressions as E
from flowlens.operators import models, quantiles, topology
from flowlens.operators import qualification as Q
from flowlens.operators import trees as T
from flowlens.operators.aggregates import group_profile
from flowlens.operators.cleaning import sample_per_group
from flowlens.operators.evaluation import auc
from flowlens.sources.testdata import indexed_flows


def _rows(spark, n=400):
    rng = np.random.default_rng(5)
    rows = [(i, float(a), float(b), int(y)) for i, (a, b, y) in enumerate(zip(rng.integers(0, 4, n), rng.integers(0, 3, n), rng.integers(0, 2, n), strict=True))]
    return spark.createDataFrame(rows, "row_index long, a double, b double, y int")


def test_auc_of_counted_rows(spark):
    df = _rows(spark)
    plain = auc(df.withColumn("g", F.lit(1)), ["g"], "a", "y").first()
    counted = df.groupBy(F.lit(1).alias("g"), "a", "y").agg(F.count(F.lit(1)).alias("n"))
    assert tuple(auc(counted, ["g"], "a", "y", "n").first()) == tuple(plain)


def test_a_search_reads_equal_rows_once(spark, monkeypatch):
    df, seen = _rows(spark), []
    tree = E.apply("-", "a", "b")
    counted = E.equal_rows(df, ["a", "b"], F.col("y"))
    assert counted.count() <= 24 and counted.agg(F.sum("rows")).first()[0] == 400
    assert E.score_trees(counted, [tree, "a"], "y", True) == E.score_trees(df, [tree, "a"], "y")
    whole = E.split_scores

    def spy(table, *args, **options):
        seen.append(table.count())
        return whole(table, *args, **options)

    monkeypatch.setattr(E, "split_scores", spy)
    best = E.search_split(df, ["a", "b"], "y", "row_index", population=6, generations=2)
    assert seen and max(seen) <= 48  # values of a, b, y and the part, not the 400 rows
    name, *figures = best[0]
    again = whole(df, [E.parse(name, ["a", "b"], E.WORDS)], "y", "row_index", dialect=E.WORDS)
    assert np.allclose(next(iter(again.values())), figures)


def _names(monkeypatch, module):
    """The names of the tables that a module keeps."""
    made, whole = [], module.keep
    monkeypatch.setattr(module, "keep", lambda df, name: made.append(name) or whole(df, name))
    return made


def test_an_audit_joins_its_flows_once(spark, sf_dir, monkeypatch):
    made = _names(monkeypatch, Q)
    rows = indexed_flows(spark, sf_dir)
    profiles = group_profile(rows, "learner").select("learner", "total", "attack_ratio", "dominant_label", "dominant_ratio")
    Q.audit(rows.drop("learner"), rows.select("row_index", "learner"), profiles, 100, 4)
    assert made.count("assigned-flows") == 1


def test_attributions_read_rows_once(spark, monkeypatch):
    made = _names(monkeypatch, T)
    df = _rows(spark).withColumn("kind", F.when(F.col("a") > 1, "far").otherwise("near"))
    out = T.class_attributions(df, "kind", ["a", "b"], top=1, trees=2, depth=2).collect()
    assert made.count("attributed") == 1 and {r["feature"] for r in out} == {"a"}


def test_thresholds_of_counted_losses(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.exponential(1, 4000), 2)
    df = spark.createDataFrame([("one", float(v)) for v in x], "learner string, loss double")
    counted = df.groupBy("learner", "loss").agg(F.count(F.lit(1)).alias("n"))
    got = [models.tail_thresholds(t, "learner", "loss", rows=n).first()["threshold"] for t, n in ((df, None), (counted, "n"))]
    assert np.isclose(*got) and np.isclose(got[0], models.tail_threshold(x), rtol=1e-3)


def test_a_sample_is_cut_by_shares_first(spark):
    df = spark.range(3000).select((F.col("id") % 2).alias("g"), "id")
    cut = sample_per_group(df, ["g"], "id", 40, 7)
    assert "_share" in cut._jdf.queryExecution().analyzed().toString()
    rank = {i: hashlib.md5(f"7|{i}".encode()).hexdigest() for i in range(3000)}
    for g in (0, 1):
        assert {r["id"] for r in cut.where(F.col("g") == g).collect()} == set(sorted(range(g, 3000, 2), key=lambda i: rank[i])[:40])


def test_scores_carry_columns(spark, monkeypatch):
    made = _names(monkeypatch, C)
    out = C.one_class_rows(_rows(spark), F.col("row_index") < 300, F.col("row_index") >= 300, F.col("y") == 1, "row_index", ["a", "b"], ["iforest"], 50)
    assert made.count("one-class-scores") == 1
    assert out.columns == ["backend", "row_index", "loss", "threshold", "part", "is_attack"] and out.where("part = 'test'").count() == 100


def test_small_tables_are_not_dealt_out(spark, monkeypatch):
    df = spark.createDataFrame([(i % 3, float(i), 1) for i in range(90)], "g int, v double, n int")
    made = _names(monkeypatch, quantiles)
    short = sorted(map(tuple, quantiles.running_counts(df, ["g"], "v", ["n"]).collect()))
    assert "ranged" not in made
    monkeypatch.setattr(quantiles, "RANGE_ROWS", 10)
    assert sorted(map(tuple, quantiles.running_counts(df, ["g"], "v", ["n"]).collect())) == short and "ranged" in made


def test_the_last_edges_are_joined_by_a_task(spark, monkeypatch):
    rng = np.random.default_rng(1)
    pairs = [(int(k), f"n{a}", f"n{b}") for k, a, b in zip(rng.integers(0, 3, 150), rng.integers(0, 90, 150), rng.integers(0, 90, 150), strict=True)]
    edge = spark.createDataFrame(pairs, "g int, src string, dst string")
    made = _names(monkeypatch, topology)
    short = sorted(map(tuple, topology.components(edge, "g").collect()))
    assert "pointers" not in made
    monkeypatch.setattr(topology, "LAST_EDGES", 0)
    assert sorted(map(tuple, topology.components(edge, "g").collect())) == short and "pointers" in made
