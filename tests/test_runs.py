"""Options, performance, claims, first rows, views of learners."""

import random

import pytest
from pyspark.sql import functions as F

from flowlens.functions.registered import register_functions
from flowlens.operators import claims, lifecycle, overlap, topology
from flowlens.sources.options import Options
from flowlens.streaming import performance
from flowlens.streaming.open_set import OpenSet

NEEDED = {
    "paths": {"data_dir": "a", "output_dir": "b"}, "runtime": {"cpu_only": True, "max_rows": 0, "seed": 1}, "stream": {"init_known_mode": "benign_only", "init_ratio": 0.1, "window_size": 100},
    "tsieve": {"batch_size": 1, "increment_epochs": 2, "increment_min_samples": 70, "init_epochs": 1, "lr": 0.1, "max_increment_samples": 9, "max_train_per_class": 8, "min_class_samples": 7, "new_class_epochs": 1},
    "tmagnifier": {"cluster_trigger_size": 5, "dbscan_eps": 1.5, "dbscan_min_samples": 3, "max_unknown_buffer": 50, "new_class_min_size": 4},
}


def test_options_are_checked_and_copied(spark, tmp_path):
    o = Options(NEEDED)
    assert o.get("tsieve", "historical_sample_rate") == 0.5 and o.get("tscissors", "evt_quantile") == 0.95
    listed = o.changed(runtime={"year_include": ["2017"]})
    listed.get("runtime", "year_include").append("2019")
    assert listed.get("runtime", "year_include") == ["2017"] and o.get("runtime", "year_include") is None
    NEEDED["tsieve"]["lr"] = 0.1
    for change, said in (({"tsieve": {"classifier_backend": "svm"}}, "classifier_backend"), ({"runtime": {"benign_accept_scale": "x"}}, "benign_accept_scale"), ({"tsieve": {"increment_gate_enabled": 1}}, "increment_gate_enabled")):
        with pytest.raises(ValueError, match=said):
            o.changed(**change)
    with pytest.raises(ValueError, match="paths.data_dir is missing.*tmagnifier.dbscan_eps is missing"):
        Options("paths: {output_dir: x}")
    o.snapshot(spark, str(tmp_path / "config"))
    assert Options("\n".join(r["value"] for r in spark.read.text(str(tmp_path / "config")).collect())).values == o.values
    assert Options({**NEEDED, "title": "t"}).values["title"] == "t"


def test_options_make_the_loop(spark, tmp_path):
    o = Options(NEEDED)
    loop = OpenSet(spark, str(tmp_path), ["x"], **o.open_set())
    assert (loop.eps, loop.least, loop.least_class, loop.most_buffer, loop.backend, loop.guard, loop.purity, loop.small_rows) == (1.5, 3, 4, 50, "ae", None, None, 1000)
    assert loop.gate == lifecycle.Gate(benign_confidence=0.6, least_rows=70)
    tight = o.changed(tsieve={"increment_iforest_guard_enabled": True, "increment_drift_gate_enabled": True, "increment_gate_enabled": True, "increment_route_gate_enabled": True}, tmagnifier={"cluster_purity_gate_enabled": True, "cluster_gate_max_benign_prob_mean": 0.3})
    made = tight.open_set()
    assert made["guard"].rows == 300 and made["guard"].new_only and made["purity"].most_prob == 0.3
    assert (made["gate"].least_drift, made["gate"].least_benign_prob, made["gate"].most_exceed, made["gate"].route_rows) == (0.12, 0.02, 0.9, 300)


def test_timers_and_rates(spark, tmp_path):
    t = performance.Timers()
    for _ in range(2):
        with t.stage("stream_inference"):
            spark.range(10).count()
    t.count("stream_inference", 20)
    t.count("idle", 5)
    got = {r["stage"]: r for r in t.table(spark).collect()}
    assert got["stream_inference"]["rows_per_s"] == pytest.approx(20 / t.seconds["stream_inference"]) and got["idle"]["rows_per_s"] is None
    report = {r["name"]: r["flows_per_s"] for r in performance.benchmark(spark, t, 100, 20).collect()}
    assert report["end_to_end"] is None and report["qualification"] is None and report["inference"] == pytest.approx(20 / t.seconds["stream_inference"])
    performance.write_report(t.table(spark), "stages", str(tmp_path / "report"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "report")).collect()]
    assert lines[0] == "# stages" and lines[2] == "| stage | seconds | rows | rows_per_s |" and lines[4].startswith("| idle | 0.000 | 5 |  |")


def test_averages_of_a_log(spark):
    shape = "rows long, " + ", ".join(f"{s}_seconds double" for s in performance.STAGES)
    log = spark.createDataFrame([(10, 1.0, 0.0, 2.0, 0.0, 4.0), (30, 3.0, 0.0, 0.0, 0.0, 4.0)], shape)
    r = performance.window_averages(log).first()
    assert (r["windows"], r["rows"], r["avg_detect_seconds"], r["avg_create_seconds"], r["rows_per_s_detect"], r["rows_per_s_window"]) == (2, 40, 2.0, 1.0, 10.0, 5.0)
    none = performance.window_averages(log.where("false")).first()
    assert none["windows"] == 0 and none["avg_window_seconds"] == 0.0 and none["rows_per_s_window"] is None


def test_progress_of_a_stream(spark, tmp_path):
    heard = performance.Progress()
    spark.streams.addListener(heard)
    try:
        spark.range(25).repartition(2).write.parquet(str(tmp_path / "in"))
        query = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()
        for _ in range(100):
            if sum(b[2] for b in heard.batches) == 25:
                break
            import time

            time.sleep(0.1)
    finally:
        spark.streams.removeListener(heard)
    rows = heard.table(spark).collect()
    assert sum(r["rows"] for r in rows) == 25 and all(r["rows_per_s"] is None or r["rows_per_s"] > 0 for r in rows)


def plain_claims(rows, births):
    """One learner and one row after the other."""
    left, out = sorted(rows), {}
    for learner, samples, needs in births:
        got = 0
        for label, need in sorted(needs.items(), key=lambda x: -x[1]):
            for row in [r for r in left if r[1] == label][: min(need, samples - got)]:
                out[row[0]] = learner
                left.remove(row)
                got += 1
            if got >= samples:
                break
    return out


def test_claims_in_birth_order(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice("abc")) for k in range(120)]
    for _ in range(4):
        births = [(f"NEW_{k}", rng.randint(5, 40), {x: rng.randint(0, 25) for x in "abcd"}) for k in range(6)]
        got = claims.claim_rows(spark.createDataFrame(rows, "row_index long, label string").repartition(3), births).collect()
        assert {r["row_index"]: r["claimer"] for r in got} == plain_claims(rows, births)
    created = spark.createDataFrame([("x", "a", 3, 9), ("x", "b", 5, 4), ("y", "a", 2, 1)], "learner string, label string, need long, born long")
    assert claims.births_of(created) == [("y", 2, {"a": 2}), ("x", 8, {"b": 5, "a": 3})]


def test_first_rows(spark):
    labels = ["2017|BENIGN" if k % 3 == 0 else "2019|BENIGN" if k % 3 == 1 else "2019|DOS" for k in range(100)]
    df = spark.createDataFrame(list(enumerate(labels)), "row_index long, label string").repartition(3)
    rows = lambda **k: sorted(r["row_index"] for r in lifecycle.initial_rows(df, **k).collect())
    assert rows(ratio=0.2, least=5, benign_only=False) == list(range(20))
    assert rows(ratio=0.2, least=50, benign_only=True) == [k for k in range(50) if k % 3 < 2]
    assert rows(ratio=0.1, least=5, year="2017", count=10) == list(range(0, 30, 3))  # the tenth lies beyond the tenth part
    assert rows(ratio=0.9, least=5, year="2017", count=4) == [0, 3, 6, 9]
    assert rows(ratio=1.0, least=5, benign_only=False) == list(range(99))  # the last row is left for the stream
    assert rows(ratio=0.2, least=5, benign_only=False, least_class=7) == [k for k in range(20) if k % 3 < 2]
    assert rows(ratio=0.2, least=5, year="1999", count=3) == []
    assert lifecycle.initial_rows(df.where("false"), 0.5).count() == 0


def test_views_of_learners(spark):
    rows = [("a", "BENIGN")] * 5 + [("b", "X")] * 4 + [("c", "X")] * 3 + [("c", "BENIGN")] * 3 + [("UNKNOWN", "X")] * 9 + [("", "X")] * 9 + [("d", "X")]
    got = topology.learner_views(spark.createDataFrame(rows, "learner string, label string"), least=3, most=2).orderBy("place").collect()
    assert [(r["learner"], r["attack_ratio"], r["dominant_label"], r["dominant_ratio"]) for r in got] == [("c", 0.5, "BENIGN", 0.5), ("a", 0.0, "BENIGN", 1.0)]


def test_functions_by_name(spark):
    assert "accepted_pairs" in register_functions(spark)
    row = spark.sql("SELECT is_benign_label(' 2017|benign|dns ') a, is_benign_label('2017|DoS') b, label_year_tag('2026|x') c, label_year_tag('x') d, norm_entropy(array(1D, 1D)) e, norm_entropy(array(5D)) f, safe_div(1D, 0D) g, evt_threshold(array(1D, 2D, 3D)) h, soft_probability(0D, 4D) i").first()
    assert (row["a"], row["b"], row["c"], row["d"], row["f"], row["g"], row["i"]) == (True, False, "2026", None, 0.0, 0.0, 0.5) and row["e"] == pytest.approx(1.0) and row["h"] == pytest.approx(2.9)
    pairs = spark.sql("SELECT * FROM accepted_pairs(array('b', 'a', 'c', 'a', NULL))").collect()
    assert [tuple(r) for r in pairs] == [("a", "b"), ("a", "c"), ("b", "c")]


def test_jaccard_from_counters(spark):
    acc = spark.createDataFrame([(k, x) for k in range(6) for x in "abc" if (k + ord(x)) % 2], "row_index long, learner string")
    n = acc.groupBy("learner").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, overlap.jaccard(acc).collect())) == sorted(map(tuple, overlap.jaccard_from_counts(n, overlap.pair_counts(acc)).collect()))
