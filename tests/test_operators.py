"""Hand-computed values, invariants, and streams against batches."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.functions.stats import concentration, normal_entropy, richness
from flowlens.operators import aggregates, cleaning, evaluation, lifecycle, models, overlap, qualification, topology
from flowlens.operators import expressions as E
from flowlens.sources import flow_files
from flowlens.sources.run_store import RunStore, grid, leaderboard, load_config
from flowlens.sources.testdata import indexed_flows, losses
from flowlens.streaming import event_windows
from flowlens.streaming.blocks import BlockStream, block_log


def reduce_counts(spark, counts, aggregate):
    df = spark.createDataFrame([(c,) for c in counts], "n long").withColumn("total", F.lit(sum(counts)))
    return df.agg(aggregate(F.col("n"), F.col("total")).alias("x")).first()["x"]


@pytest.mark.parametrize(("counts", "h", "hhi"), [([1, 1], 1.0, 0.5), ([5], 0.0, 1.0), ([3, 1], 0.811278, 0.625)])
def test_entropy(spark, counts, h, hhi):
    assert reduce_counts(spark, counts, normal_entropy) == pytest.approx(h, abs=1e-6)
    assert reduce_counts(spark, counts, concentration) == pytest.approx(hhi)


def test_richness(spark):
    assert spark.range(1).select(richness(F.lit(3), F.lit(3), 65536).alias("x")).first()["x"] == pytest.approx(100)


def edge_table(spark, pairs):
    return spark.createDataFrame([("k", a, b, 1) for a, b in pairs], "key string, src string, dst string, n long")


def test_star(spark):
    got = topology.graph_stats(edge_table(spark, [("a", "b"), ("a", "c"), ("a", "d")]), ["key"]).first()
    assert (got["max_out_ratio"], got["max_in_ratio"], got["leaf_ratio"], got["edge_per_node"]) == pytest.approx((1.0, 1 / 3, 0.75, 0.75))


def test_components_and_reciprocity(spark):
    e = edge_table(spark, [("a", "b"), ("b", "a"), ("c", "d")])
    assert topology.component_stats(topology.components(e, "key"), "key").first()[1:3] == (2, 0.5)
    assert topology.graph_stats(e, ["key"]).first()["reciprocity"] == pytest.approx(2 / 3)
    chain = edge_table(spark, [(f"{i:03d}", f"{i + 1:03d}") for i in range(60)])
    assert {r["component"] for r in topology.components(chain, "key").collect()} == {"000"}
    assert topology.components(e.limit(0), "key").count() == 0


def test_private(spark):
    ips = {"10.1.2.3": True, "8.8.8.8": False, "172.31.0.1": True, "172.32.0.1": False, "127.0.0.1": True, "192.168.9.9": True, "198.19.0.1": True, "300.1.1.1": False, "10.host": True, "": False}
    got = spark.createDataFrame([(x,) for x in ips], "ip string").select("ip", topology.is_private(F.col("ip")).alias("p")).collect()
    assert {r["ip"]: r["p"] for r in got} == ips


def test_jaccard(spark):
    rows = [(i, "A") for i in range(4)] + [(i, "B") for i in range(2, 5)]
    got = overlap.jaccard(spark.createDataFrame(rows, "row_index long, learner string")).first()
    assert (got["both"], got["jaccard"], got["a_to_b"]) == (2, pytest.approx(0.4), 0.5) and got["b_to_a"] == pytest.approx(0.666667, abs=1e-6)


def test_protocol_class(spark):
    df = spark.createDataFrame([("x", 6)] * 8 + [("x", 17)] * 2 + [("y", 17), ("y", None)], "g string, protocol int")
    assert {r["g"]: r["kind"] for r in aggregates.protocol_mix(df, "g").collect()} == {"x": "TCP_CLUSTER", "y": "MIXED_CLUSTER"}


def test_filters(spark):
    df = spark.createDataFrame([("2017|BENIGN", 6.4), ("BENIGN", 17.0), ("2019|DoS", None), ("2026|BENIGN|dns", 1.0)], "label string, protocol double")
    assert cleaning.keep_years(df, ["2017", "2026"]).count() == 2
    assert cleaning.keep_protocols(df, ["tcp"]).count() == 1 and cleaning.keep_protocols(df, ["other"]).count() == 1 and cleaning.keep_protocols(df, ["nothing"]).count() == 4
    assert cleaning.keep_attacks(df, ["benign"]).count() == 3 and cleaning.keep_attacks(df, ["x"]).count() == 3 and cleaning.drop_attacks(df, ["dos"]).count() == 3


def test_missing_values(spark):
    df = spark.createDataFrame([(-1.0, float("inf"), None), (None, float("nan"), 6), (3.0, 2.0, 17)], "w double, r double, p int")
    got = [tuple(r) for r in cleaning.repair_missing(df, ["w"], ["r"], "p").select("w", "w_missing_flag", "r", "r_missing_flag", "is_non_tcp").collect()]
    assert got == [(0.0, 1, 0.0, 1, 1), (0.0, 1, 0.0, 1, 0), (3.0, 0, 2.0, 0, 1)]


def test_thresholds():
    rng = np.random.default_rng(0)
    assert models.tail_threshold(np.array([])) == 1.0
    few = rng.random(50)
    assert models.tail_threshold(few, 0.95) == pytest.approx(np.quantile(few, 0.95))
    x = rng.exponential(1.0, 20_000)
    assert models.tail_threshold(x, 0.95, 1e-3) == pytest.approx(-math.log(1e-3), rel=0.15)
    shape, scale = models.fit_pareto(rng.pareto(4.0, 50_000))
    assert shape == pytest.approx(0.25, abs=0.05) and scale == pytest.approx(0.25, abs=0.03)


def test_models_tell_outliers():
    rng = np.random.default_rng(1)
    x, far = rng.normal(0, 1, (800, 5)), rng.normal(6, 1, (100, 5))
    for kind in models.BACKENDS.values():
        model = kind(x)
        assert np.median(model.loss(far)) > np.quantile(model.loss(x), 0.95)
    label = models.dbscan(np.vstack([rng.normal(0, 0.1, (50, 2)), rng.normal(5, 0.1, (60, 2)), [[20, 20]]]), 0.5, 5)
    assert set(label[:50]) == {0} and set(label[50:110]) == {1} and label[110] == -1


def test_routing(spark):
    rows = [(1, "NEW_1", 0.5, 1.0, False), (1, "BENIGN", 0.1, 1.0, True), (2, "NEW_1", 2.0, 1.0, False), (2, "BENIGN", 0.9, 1.0, True), (3, "NEW_1", 2.0, 1.0, False), (3, "BENIGN", 1.5, 1.0, True)]
    df = spark.createDataFrame(rows, "row_index long, learner string, loss double, threshold double, is_benign boolean")
    said = lambda **k: {r["row_index"]: r["assigned_learner"] for r in overlap.route(df, **k).collect()}
    assert said() == {1: "NEW_1", 2: "BENIGN", 3: "UNKNOWN"}
    assert said(uniform=True)[1] == "BENIGN" and said(benign_scale=0.5)[2] == "UNKNOWN"


def test_invariants(spark, sf_dir):
    df = indexed_flows(spark, sf_dir)
    n = df.count()
    assert df.select("row_index").distinct().count() == n and df.agg(F.max("row_index")).first()[0] == n - 1
    wide = qualification.qualify(df).collect()
    for r in wide:
        assert all(r[f"{m}__score"] is None or 0 <= r[f"{m}__score"] <= 100 for m in qualification.METRICS)
        said = r["rules"].split("|")
        assert not any(x.startswith("drdos-") for x in said) or "diffuse-one-way-drdos-udp-syn-family" in said
        assert "slow-dos-fixed-service" not in said or "fixed-service-dos-ddos-family" in said
    fired = {r["learner"]: r["rules"] for r in wide}
    assert "fixed-service" in fired["NEW_0"] and "portscan" in fired["NEW_1"] and "heartbleed" in fired["NEW_3"]
    assert aggregates.label_distribution(df).agg(F.sum("ratio")).first()[0] == pytest.approx(1)
    all_losses = losses(spark, sf_dir)
    accepted = {r["row_index"] for r in overlap.accepted(all_losses).select("row_index").collect()}
    for r in overlap.route(all_losses).collect():
        assert (r["assigned_learner"] == "UNKNOWN") == (r["row_index"] not in accepted)


def test_curve_and_auc_agree(spark):
    rows = [(float(i % 17), int(i % 3 == 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "x double, y int")
    points = sorted((r["fpr"], r["tpr"]) for r in evaluation.curve(df, "x", "y").collect())
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip([(0, 0), *points], points, strict=False))
    assert evaluation.auc(df.withColumn("g", F.lit(1)), ["g"], "x", "y").first()["auc"] == pytest.approx(area)


def test_expressions(spark):
    tree = E.apply("/", E.apply("neg", "a b"), E.apply("max", 0.0, E.apply("log1p_abs", "c")))
    got = spark.createDataFrame([(2.0, 0.0)], "`a b` double, c double").select(E.column(tree).alias("x")).first()["x"]
    assert got == pytest.approx(-2 / 1e-6) and E.text(tree) == "((-a b) / (0 max log1p_abs(c)))"
    assert len(E.subtrees(tree)) == 7 and E.text(E.replaced(tree, (1, 1), "d")) == "((-a b) / (0 max d))"
    with pytest.raises(ValueError):
        E.apply("abs", "a", "b")
    df = spark.createDataFrame([(float(k), float(k % 5), int(k > 20)) for k in range(40)], "a double, b double, y int")
    best = E.search(df, ["a", "b"], "y", population=4, generations=1)
    assert best[0] == ("a", 1.0) and all(x >= y for (_, x), (_, y) in zip(best, best[1:], strict=False))


def test_temporal_and_port_stats(spark):
    """Four rows of x in one of 256 bins of the whole span and one row of y at its end; ports 3 to 1."""
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    rows = [("x", at(0), 80, 1), ("x", at(0.1), 80, 2), ("x", at(0.2), 80, 3), ("x", at(0.25), 443, 3), ("y", at(1000), None, None), ("z", None, None, 7)]
    df = spark.createDataFrame(rows, "g string, ts timestamp_ntz, dst_port int, src_port int")
    t = {r["g"]: r for r in aggregates.temporal_stats(df, "g").collect()}
    assert (t["x"]["n"], t["x"]["hhi"], t["x"]["entropy"], t["x"]["concentration"], t["x"]["kind"]) == (4, 1.0, 0.0, 1.0, "SHORT_BURST")
    assert t["x"]["span_ratio"] == pytest.approx(0.00025) and t["x"]["burst"] == pytest.approx(0.5 * (1 - 0.00025) + 0.5)
    assert (t["z"]["n"], t["z"]["burst"], t["z"]["kind"]) == (0, 0.0, "EMPTY") and t["y"]["kind"] == "SHORT_BURST"
    p = {r["g"]: r for r in aggregates.port_stats(df, "g").collect()}
    assert (p["x"]["n"], p["x"]["ports"], p["x"]["top_port"], p["x"]["top_share"], p["x"]["hhi"]) == (4, 2, 80, 0.75, 0.625)
    assert p["x"]["entropy"] == pytest.approx(0.811278, abs=1e-6) and p["x"]["source_ports"] == 3 and p["x"]["kind"] == "SERVICE_LIKE"
    assert (p["y"]["kind"], p["y"]["top_port"], p["y"]["entropy"], p["z"]["source_ports"]) == ("UNKNOWN", 0, 0.0, 1)


def test_stability(spark):
    """Counts 4, 0, 0, 0 over four windows: mean 1, deviation sqrt(3), 0.95 quantile 3.4."""
    df = spark.createDataFrame([("a", k) for k in range(4)] + [("b", 15), ("b", -1)], "g string, i long")
    got = {r["g"]: r["stability"] for r in aggregates.stability(df, "g", "i", 4).collect()}
    assert got["a"] == pytest.approx(0.6 * (1 - math.exp(-(3**0.5))) + 0.4 * (1 - math.exp(-2.4)), abs=1e-6)
    assert got["b"] == pytest.approx(0.6 * (1 - math.exp(-(3**0.5))) + 0.4 * (1 - math.exp(-2.4)), abs=1e-6)


def test_assignment_risk(spark):
    """A learner goes by its most frequent label: two years of BENIGN are two labels, so the first learner is an attack one."""
    rows = [("NEW_0", "2017|BENIGN", 3), ("NEW_0", "2019|BENIGN", 3), ("NEW_0", "2017|DoS", 4), ("NEW_1", "BENIGN", 8), ("NEW_1", "DoS", 2), ("UNKNOWN", "BENIGN", 5), ("UNKNOWN", "DoS", 1)]
    df = spark.createDataFrame([(a, b) for a, b, n in rows for _ in range(n)], "learner string, label string")
    r = evaluation.assignment_risk(df).first()
    assert (r["fp"], r["benign"], r["miss"], r["attack"]) == (6, 14, 3, 7) and (r["fpr"], r["fnr"]) == pytest.approx((6 / 14, 3 / 7))


def test_graph_flags_and_rules(spark):
    edge = spark.createDataFrame([("g", "a", f"n{k}", 1) for k in range(9)] + [("h", "a", "b", 1), ("h", "b", "a", 2), ("h", "c", "d", 1)], "g string, src string, dst string, n long")
    got = {r["g"]: r for r in topology.anomaly_flags(topology.graph_metrics(edge, "g")).collect()}
    assert got["g"]["flags"] == "STRONG_SOURCE_HUB|VERY_LOW_RECIPROCITY" and got["h"]["flags"] == "STRONG_SOURCE_HUB|STRONG_SINK_HUB"
    assert (got["h"]["components"], got["h"]["largest_ratio"]) == (2, 0.5) and got["h"]["reciprocity"] == pytest.approx(2 / 3)
    rules = {(r["src"], r["dst"]): r for r in topology.edge_rules(edge.where("g = 'g'").drop("g")).collect()}
    assert all(r["rule_source_hub"] and not r["rule_sink_hub"] and r["rule_low_reciprocity"] for r in rules.values()) and len(rules) == 9
    rates = {r["rule"]: r for r in topology.rule_rates(spark.createDataFrame([(True, 3, 1), (None, 1, 5)], "x boolean, attacks long, benign long"), ("x",)).collect()}["x"]
    assert (rates["tp"], rates["fp"], rates["tn"], rates["fn"], rates["fpr"], rates["precision"]) == (3, 1, 5, 1, 1 / 6, 0.75)


def test_window_rules(spark):
    """Two quiet windows set the limits; the third one has a larger hub and less reciprocity, the fourth more fragments."""
    rows = [(0, 0.0, 0.5, 0.1, 0.1, 0.1, 0.9), (1, 0.0, 0.5, 0.1, 0.1, 0.1, 0.9), (2, 0.9, 0.1, 0.1, 0.8, 0.1, 0.95), (3, 0.9, 0.6, 0.0, 0.0, 0.7, 0.2)]
    df = spark.createDataFrame(rows, "window_id int, attack_ratio double, reciprocity double, hub_out_ratio double, hub_in_ratio double, frag_ratio double, largest_cc_ratio double")
    got = {r["window_id"]: tuple(r[c] for c in topology.WINDOW_RULES) for r in topology.window_rules(df).collect()}
    assert got[2] == (True, True, False, True) and got[3] == (False, False, True, True)
    assert all(not any(r[c] for c in topology.WINDOW_RULES) for r in topology.window_rules(df.where("attack_ratio > 0")).collect())


def test_rule_table(spark):
    df = spark.createDataFrame([("a", 0.9, 0.6), ("b", 0.05, 0.7), ("c", 0.3, 0.9), ("d", 0.5, 0.1), ("e", 0.0, 0.2)], "learner string, attack_ratio double, burst double")
    r = evaluation.rule_table(df, {"late": F.col("burst") >= 0.5}).first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"], r["false_positives"], r["false_negatives"], r["precision"], r["recall"]) == (1, 1, 1, 1, "b", "d", 0.5, 0.5)


def test_gate_chain(spark):
    """The order of reasons, and retrains that count only the windows that trained."""
    gate = lifecycle.Gate(cooldown_windows=1, least_rows=3, most_retrains=2, least_benign_prob=0.5, most_exceed=0.5)
    rows = [("NEW_1", w, False, n, 0, p, x) for w, n, p, x in ((0, 9, 0.9, 0.0), (1, 2, 0.9, 0.0), (2, 9, 0.1, 0.9), (3, 9, 0.9, 0.9), (4, 9, 0.1, 0.1), (5, 9, 0.9, 0.0))] + [("BENIGN", 0, True, 0, 0, 0.9, 0.0)]
    df = spark.createDataFrame(rows, "learner string, window_id long, is_benign boolean, kept long, birth_window long, benign_prob double, exceed double")
    got = {(r["learner"], r["window_id"]): r["reason"] for r in lifecycle.gate_batches(df, gate).collect()}
    assert [got["NEW_1", w] for w in range(6)] == ["new_learner_cooldown", "increment_min_samples", "increment_quality_gate", None, None, "max_retrain_per_learner"]
    assert got["BENIGN", 0] == "benign_conf_filter"


def test_route_confidence(spark):
    losses = spark.createDataFrame([(1, "a", 0.5, 1.0, False), (1, "b", 0.9, 1.0, False), (2, "a", 0.99, 1.0, False), (2, "b", 2.0, 1.0, False)], "row_index long, learner string, loss double, threshold double, is_benign boolean")
    assigned = spark.createDataFrame([(1, "a"), (2, "a"), (3, "UNKNOWN")], "row_index long, assigned_learner string")
    got = {r["row_index"]: r for r in overlap.route_confidence(losses, assigned).collect()}
    assert got[1]["own_margin"] == pytest.approx(0.5) and got[1]["gap"] == pytest.approx(0.4) and got[1]["keep"]
    assert got[2]["own_margin"] == pytest.approx(0.01) and not got[2]["keep"] and got[3]["gap"] is None and got[3]["keep"]
    by = {r["learner"]: r for r in overlap.confidence_by_learner(overlap.route_confidence(losses, assigned)).collect()}
    assert by["a"]["confident_ratio"] == 0.5 and by["a"]["own_margin_p10"] == pytest.approx(0.01 + 0.1 * 0.49) and by["UNKNOWN"]["confident_ratio"] is None


def test_learner_risk(spark):
    """One learner beside a benign one: every part by hand."""
    losses = spark.createDataFrame([(k, n, x, 1.0, n == "BENIGN") for k in range(4) for n, x in (("NEW_1", (0.5, 0.5, 0.5, 1.5)[k]), ("BENIGN", 2.0))], "row_index long, learner string, loss double, threshold double, is_benign boolean")
    assigned = spark.createDataFrame([(k, "NEW_1") for k in range(4)], "row_index long, assigned_learner string")
    nothing = lambda c: spark.createDataFrame([], f"learner string, {c} double")
    r = evaluation.learner_risk(losses, assigned, nothing("overlap_risk"), nothing("stability")).first()
    prob, margin = 1 / (1 + math.exp(4)), 1 / (1 + math.exp(-4))
    assert (r["own_exceed_rate"], r["benign_accept_rate"], r["benign_margin_median"]) == (0.25, 0.0, pytest.approx(-1.0))
    assert r["risk_score"] == pytest.approx(0.55 + 0.3 * 0.25 + 0.15 * margin) and r["risk_band"] == "HIGH"
    assert r["risk_score_v2"] == pytest.approx(0.7 * (1 - prob) + 0.2 * 0.25 + 0.1 * margin)
    p50, p90, p99 = 0.5, 0.5 + 0.7 * 1.0, 0.5 + 0.97 * 1.0
    tail = 1 / (1 + math.exp(-1.5 * ((p99 - p90) / (p90 - p50) - 2)))
    confidence = 1 - math.exp(-4 / 5000)
    raw = 0.35 * (1 - prob) + 0.25 * (0.6 * 0.25 + 0.4 * tail) + 0.05 * (1 - confidence)
    assert r["risk_score_v3_raw"] == pytest.approx(raw) and r["risk_score_v3"] == pytest.approx(0.5 + confidence * (raw - 0.5)) and r["risk_band_v3"] == "MEDIUM"
    assert evaluation.risk_band(F.lit(0.75)) is not None


def test_flow_files(spark, tmp_path):
    (tmp_path / "2017_a.csv").write_text(" Src IP , Label,Bytes\n1.1.1.1,BENIGN,5\nbroken line,only,two,many\n2.2.2.2,2019|DoS,6\n")
    df = flow_files.read_flow_csv(spark, [str(tmp_path / "2017_a.csv")], "`Src IP` string, Label string, Bytes int", {"Src IP": "src_ip"})
    assert {(r["src_ip"], r["Label"]) for r in df.collect()} == {("1.1.1.1", "2017|BENIGN"), ("2.2.2.2", "2019|DoS")}
    assert flow_files.resolve([" Dst Port ", "x"], "dst port") == " Dst Port " and flow_files.resolve(["x"], "y", needed=False) is None
    assert flow_files.common_columns([["b", "a", "b", "c"], ["c", "b"]]) == ["b", "c"]
    with pytest.raises(KeyError):
        flow_files.common_columns([["a"], ["b"]], ["a"])


def test_run_store(spark, tmp_path):
    for run, fpr in (("20240101_000000_a", 0.1), ("20240102_000000_b", 0.2)):
        (tmp_path / run).mkdir()
        (tmp_path / run / "metrics.json").write_text(f'{{"fpr": {fpr}, "fnr": 0.1}}')
    store = RunStore(spark, str(tmp_path))
    assert [r["run"] for r in store.catalog().collect()] == ["20240102_000000_b", "20240101_000000_a"]
    assert [r["run"] for r in leaderboard(store.metrics()).orderBy("place").collect()] == ["20240101_000000_a", "20240102_000000_b"]
    assert store.read("20240101_000000_a", "metrics.json").first()["fpr"] == 0.1
    with pytest.raises(PermissionError):
        store.path("20240101_000000_a", "secrets.txt")
    with pytest.raises(ValueError):
        store.path("../x", "metrics.json")
    assert len(grid({"a": [1, 2], "b": [3, 4, 5]})) == 6 and load_config("a: {b: 1}") == {"a": {"b": 1}}


def test_block_stream_equals_batch(spark, sf_dir, tmp_path):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("row_index"), "ts", (F.col("event_type") == "error").cast("int").alias("attack"))
    for k in range(4):
        rows.where(f"row_index >= {k * 263} and row_index < {(k + 1) * 263 if k < 3 else 10**9}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = event_windows.event_stream(spark, str(tmp_path / "in"), rows.schema)
    got = BlockStream(spark, str(tmp_path / "out"), 100).run(stream)
    batch = block_log(rows.withColumn("_b", F.floor(F.col("row_index") / 100)), "_b").drop("_b")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def test_late_rows_are_dropped(spark, tmp_path):
    for k, times in enumerate((["2024-01-01 10:00:00", "2024-01-01 12:00:00"], ["2024-01-01 12:30:00"], ["2024-01-01 10:10:00", "2024-01-01 12:40:00"])):
        spark.createDataFrame([(t, 1.0) for t in times], "t string, value double").select(F.to_timestamp("t").alias("ts"), "value").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/f{k}"))
    stream = spark.readStream.schema("ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    out = event_windows.windowed(stream, event_windows.tumbling("1 hour"), "30 minutes", [], "value")
    got = event_windows.run_to_table(out, str(tmp_path / "out"), "append")
    assert [(r["start"].hour, r["n"]) for r in got.collect()] == [(10, 1)]
