"""Ranks, quantiles and window graphs against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.operators import evaluation, quantiles, topology


def test_quantiles_of_skewed_groups(spark):
    rng = np.random.default_rng(0)
    rows = [("hot" if k % 3 else f"g{k % 5}", float(np.round(v, 2)) if k % 11 else None) for k, v in enumerate(rng.normal(size=3000))]
    rows += [(None, 4.0), ("one", 2.5), ("empty", None), ("empty", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    probs = [0.0, 0.1, 0.5, 0.95, 1.0]
    got = {r["g"]: r["q"] for r in quantiles.exact_quantiles(df, ["g"], "v", probs).collect()}
    values = {g: [v for a, v in rows if a == g and v is not None and v == v] for g in {a for a, _ in rows}}
    assert set(got) == {g for g, x in values.items() if x}
    for g, q in got.items():
        assert q == pytest.approx(np.quantile(values[g], probs))
    whole = quantiles.exact_quantiles(df, [], "v", [0.25]).first()["q"]
    assert whole == pytest.approx([np.quantile(sum(values.values(), []), 0.25)])
    assert quantiles.exact_quantiles(df.where("false"), [], "v", [0.5]).count() == 0


def test_running_counts(spark):
    rng = random.Random(1)
    rows = [(g, v, rng.randint(1, 9), rng.randint(0, 3)) for g in ("a", "b", None) for v in range(40)]
    got = quantiles.running_counts(spark.createDataFrame(rows, "g string, v long, p long, q long").repartition(5), ["g"], "v", ["p", "q"]).collect()
    assert len(got) == len(rows)
    for r in got:
        earlier = [x for x in rows if x[0] == r["g"] and x[1] < r["v"]]
        assert (r["p_before"], r["q_before"]) == (sum(x[2] for x in earlier), sum(x[3] for x in earlier))


def test_curve_of_ties(spark):
    scored = [(0.5, 1), (0.5, 0), (0.9, 1), (0.1, 0), (0.7, 0)]
    got = {r["threshold"]: (r["tp"], r["fp"]) for r in evaluation.curve(spark.createDataFrame(scored, "s double, y int"), "s", "y").collect()}
    assert got == {0.9: (1, 0), 0.7: (1, 1), 0.5: (2, 2), 0.1: (2, 3)}
    one = evaluation.auc(spark.createDataFrame([("x", s, y) for s, y in scored], "g string, s double, y int"), ["g"], "s", "y").first()
    assert one["auc"] == pytest.approx((3 + 1.5) / 6)  # 0.9 beats all three; 0.5 beats one and ties with one


def plain_window(flows):
    edges = {(a, b) for a, b, _ in flows}
    nodes = {x for e in edges for x in e}
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    sizes = [sum(find(x) == r for x in nodes) for r in {find(x) for x in nodes}]
    rest = max(1, len(nodes) - 1)
    return (
        len(flows), sum(1 - y for *_, y in flows) / len(flows), len(nodes), len(edges), sum((b, a) in edges for a, b in edges) / len(edges),
        max(len({b for a, b in edges if a == x}) for x in nodes) / rest, max(len({a for a, b in edges if b == x}) for x in nodes) / rest, len(sizes) / len(nodes), max(sizes) / len(nodes),
    )


def test_window_graphs(spark):
    rng = random.Random(2)
    rows = [(k, f"10.0.0.{rng.randint(1, 9)}", f"10.0.0.{rng.randint(1, 9)}", rng.randint(0, 1)) for k in range(90)] + [(k, "10.0.0.1", "10.0.0.1", 1) for k in range(90, 95)]
    df = spark.createDataFrame([(k, a, 80, b, 80, y) for k, a, b, y in rows], "row_index long, src_ip string, src_port int, dst_ip string, dst_port int, benign int").repartition(4)
    for size in (7, 30):
        got = {r["window_id"]: tuple(r[c] for c in ("rows", "attack_ratio", "nodes", "edges", "reciprocity", "hub_out_ratio", "hub_in_ratio", "frag_ratio", "largest_cc_ratio")) for r in topology.window_graphs(df, size).collect()}
        want = {w: plain_window([(a, b, y) for k, a, b, y in rows if k // size == w]) for w in {k // size for k, *_ in rows}}
        assert set(got) == set(want)
        for w in want:
            assert got[w] == pytest.approx(want[w])


def test_rules_fire_at_their_default_limits(spark):
    """A star with a quarter of the nodes, and windows of which most are calm."""
    star = [("hub", f"n{k}", 1) for k in range(6)] + [(f"a{k}", f"b{k}", 1) for k in range(4)] + [(f"b{k}", f"a{k}", 1) for k in range(4)]
    edge = spark.createDataFrame(star, "src string, dst string, n long")
    rules = {(r["src"], r["dst"]): r for r in topology.edge_rules(edge).collect()}
    assert all(rules["hub", f"n{k}"]["rule_source_hub"] and rules["hub", f"n{k}"]["rule_low_reciprocity"] for k in range(6))
    assert not any(rules[f"a{k}", f"b{k}"]["rule_source_hub"] or rules[f"a{k}", f"b{k}"]["rule_low_reciprocity"] for k in range(4))
    windows = [(w, 0.0, 0.5, 0.1, 0.1, 0.2, 0.9) for w in range(40)] + [(98, 0.6, 0.05, 0.9, 0.05, 0.9, 0.1), (99, 0.6, 0.9, 0.9, 0.05, 0.1, 0.95)]
    df = spark.createDataFrame(windows, "window_id long, attack_ratio double, reciprocity double, hub_out_ratio double, hub_in_ratio double, frag_ratio double, largest_cc_ratio double")
    got = {r["window_id"]: r for r in topology.window_rules(df).collect()}
    assert got[98]["rule_win_src_lowrecip"] and got[98]["rule_win_frag_lcc"] and got[98]["rule_win_combo"] and not got[98]["rule_win_sink_lowrecip"]
    assert not got[99]["rule_win_combo"]
    noisy = topology.window_rules(df.withColumn("attack_ratio", F.lit(0.5)))
    assert not any(r["rule_win_combo"] for r in noisy.collect())


def test_window_rules_make_each_window_once(spark):
    """The limits and the rules read the same windows, whose graphs are the costly part."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    shape = "window_id long, attack_ratio double, reciprocity double, hub_out_ratio double, hub_in_ratio double, frag_ratio double, largest_cc_ratio double"
    df = spark.createDataFrame([(w, 0.0, 0.5, 0.1, 0.1, 0.2, 0.9) for w in range(40)], shape).mapInArrow(count, shape)
    assert len(topology.window_rules(df).collect()) == 40 and made.value == 40


def test_components_move_a_few_times_the_edges(spark, monkeypatch):
    """A chain of 3,000 nodes in mixed order and a random graph against a plain search; what the rounds keep is bounded by the edges."""
    import random

    from flowlens.operators import topology

    rng, kept, keep = random.Random(5), [], topology.keep

    def counted(df, name):
        out = keep(df, name)
        kept.append(out.count())
        return out

    names = [f"n{k:04d}" for k in range(3000)]
    rng.shuffle(names)
    rows = [("chain", a, b) for a, b in zip(names, names[1:])] + [("random", f"r{rng.randrange(400)}", f"r{rng.randrange(400)}") for _ in range(250)]
    monkeypatch.setattr(topology, "keep", counted)
    got = {(r["g"], r["node"]): r["component"] for r in topology.components(spark.createDataFrame(rows, "g string, src string, dst string"), "g").collect()}
    near = {}
    for g, a, b in rows:
        near.setdefault((g, a), set()).add(b)
        near.setdefault((g, b), set()).add(a)
    expected = {}
    for g, start in sorted(near):
        todo = [] if (g, start) in expected else [start]
        while todo:
            node = todo.pop()
            if (g, node) not in expected:
                expected[g, node] = start
                todo += near[g, node]
    assert got == expected
    assert sum(kept) < 9 * len(rows)


def test_folds_order_no_label_in_one_task(spark):
    """The folds are those of a plain sort by md5 of each label's keys; a window over labels has a row for each range only."""
    import hashlib
    import re

    from flowlens.operators.cleaning import folds

    rows = [("a" if k % 10 else "b", k) for k in range(2000)]
    out = folds(spark.createDataFrame(rows, "label string, id long"), "label", "id", 5, 42)
    plain = {k: i % 5 for label in "ab" for i, k in enumerate(sorted((k for x, k in rows if x == label), key=lambda k: (hashlib.md5(f"42|{k}".encode()).hexdigest(), k)))}
    assert {r["id"]: r["fold"] for r in out.collect()} == plain
    assert not re.search(r"windowspecdefinition\(label#\d+, (?!_part#)", out._jdf.queryExecution().toString())
