"""Queries on sources, models, synthesised features and streams."""

from __future__ import annotations

import uuid

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowlens.functions.labels import base_label
from flowlens.operators import evaluation as V
from flowlens.operators import expressions as E
from flowlens.operators import models as M
from flowlens.operators import trees as T
from flowlens.session import keep, shared_folder
from flowlens.sources import flow_files as S
from flowlens.sources import run_store as R
from flowlens.sources.testdata import FLOWS_SQL, TIES, events, flows, indexed_flows, table
from flowlens.streaming import event_windows as EW
from flowlens.streaming.blocks import BlockStream

from .aggregate_queries import benign_flows, rounded
from .registry import register

W = f"WITH {FLOWS_SQL} "


def _n():
    """Rows, as an aggregate; made when it is used, as columns need a session."""
    return F.count(F.lit(1))


def work_folder(spark) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


# sources

_RENAMES = {"c_name": "name", "s_name": "name", "c_nationkey": "nation", "s_nationkey": "nation", "c_acctbal": "balance", "s_acctbal": "balance"}


def _parties(s, d):
    return [S.trim_names(table(s, d, t).withColumnRenamed(f"{t[0]}_name", f" {t[0]}_name "), _RENAMES) for t in ("customer", "supplier")]


register("sc1_ordered_union", lambda s, d: rounded(S.in_order(_parties(s, d)).groupBy("file_no", "nation").agg(_n().alias("n"),
    F.count("c_mktsegment").alias("segments"))), "SELECT 0::BIGINT AS file_no, c_nationkey::BIGINT AS nation, count(*) AS n, count(c_mktsegment) AS "
        "segments FROM customer GROUP BY 2 UNION ALL SELECT 1, s_nationkey, count(*), 0 FROM supplier GROUP BY 2")
register("sc4_aligned_union", lambda s, d: rounded(_aligned(s, d)), "SELECT nation::BIGINT AS nation, count(*) AS n, round(sum(balance), 2) AS "
    "balance FROM (SELECT c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier) GROUP BY 1")


def _aligned(s, d):
    a, b = S.align(_parties(s, d), ["nation"])
    return a.unionByName(b).groupBy("nation").agg(_n().alias("n"), F.round(F.sum("balance"), 2).alias("balance"))


register("sc12_without_ports", lambda s, d: S.without_ports(flows(s, d)).groupBy("learner", "src_port").agg(_n().alias("n")), W + "SELECT "
    "concat('SRC_', replace(src_ip, '.', '_')) AS learner, '0' AS src_port, count(*) AS n FROM base GROUP BY 1")
register("sc13_counter_rates", lambda s, d: rounded(S.interface_rates(events(s, d).select((F.col("row_index") % 3).cast("string").alias("host"), "ts",
    (F.col("row_index") * 10).alias("bytes")), "ts", ["bytes"]).groupBy("host").agg(_n().alias("n"), F.avg("bytes_rate").alias("mean")), 4),
         "WITH r AS (SELECT (event_id % 3)::VARCHAR AS host, (event_id*10 - lag(event_id*10) OVER w) / ((epoch_us(ts) - lag(epoch_us(ts)) OVER w) / "
             "1e6) AS rate, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS gap FROM events WINDOW w AS (PARTITION BY event_id % 3 ORDER BY ts)) SELECT "
                 "host, count(*) AS n, round(avg(rate), 4) AS mean FROM r WHERE gap > 0 GROUP BY 1")
register("ag47_leaderboard", lambda s, d: rounded(R.leaderboard(_runs(s, d), 5)), "WITH r AS (SELECT concat('20240101_', lpad(c_custkey::VARCHAR, 6, "
    "'0')) AS run, round(abs(c_acctbal) / 10000, 6) AS fpr, (c_custkey % 97) / 100 AS fnr FROM customer) SELECT run, fpr, fnr, round(1 - fnr, 6) AS "
        "tpr, place FROM (SELECT *, row_number() OVER (ORDER BY fpr + fnr, fnr, run) AS place FROM r) WHERE place <= 5")


def _runs(s, d):
    return table(s, d, "customer").select(F.concat(F.lit("20240101_"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("run"),
        F.round(F.abs("c_acctbal") / 10000, 6).alias("fpr"), ((F.col("c_custkey") % 97) / 100).alias("fnr"))


# synthesised features

_TREE = E.apply("/", E.apply("-", "l_quantity", "bwd"), E.apply("max", "l_linenumber", 2.0))
_NAME = E.text(_TREE)
register("ex_expression_auc", lambda s, d: rounded(V.auc(benign_flows(s, d).select(F.lit(_NAME).alias("tree"), F.round(E.column(_TREE), 9).alias("x"),
    (1 - F.col("benign")).alias("y")), ["tree"], "x", "y")), W + f""", u AS (SELECT 1 - benign AS y,
        round((l_quantity - bwd) / (abs(greatest(l_linenumber, 2.0::DOUBLE)) + 1e-6), 9) AS x FROM base), r AS (SELECT *,
            rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rk FROM u),
  a AS (SELECT (sum(rk*y) - sum(y)*(sum(y)+1)/2) / (sum(y)*sum(1-y)) AS auc FROM r) SELECT '{_NAME}' AS tree, round(auc, 6) AS auc,
      round(greatest(auc, 1-auc), 6) AS oriented_auc FROM a""")
#: Expressions as text; two column names hold spaces, and signs that are operators elsewhere.
_WRITTEN = {
    "ratio": "((Flow Bytes/s - bwd) / (log1p_abs(bwd) + 1))", "loose": "Flow Bytes/s max bwd - Tax Rate - 2 * bwd", "roots": "(sqrt_abs(bwd) min "
        "(-Tax Rate))", "plain": "abs((bwd - 25.5))",
}


def _parsed(s, d):
    """Sums of expressions that are read from text."""
    rows = flows(s, d).select(F.col("l_quantity").alias("Flow Bytes/s"), F.col("l_tax").alias("Tax Rate"), "bwd")
    trees = {k: E.parse(t, rows.columns) for k, t in _WRITTEN.items()}
    each = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(E.text(t)).alias("expression"), E.column(t).alias("x")) for k, t in trees.items()])
    return rounded(rows.select(F.explode(each).alias("p")).select("p.*").groupBy("name", "expression").agg(F.sum("x").alias("total")), 3)


register("ex_parsed_expressions", _parsed, W + """, x AS (SELECT (l_quantity - bwd) / (abs(ln(1 + abs(bwd)) + 1) + 1e-6) AS a, greatest(l_quantity,
    bwd - (l_tax - 2 * bwd)) AS b, least(sqrt(abs(bwd) + 1e-12), -l_tax) AS c, abs(bwd - 25.5) AS d FROM base)
  SELECT unnest(['ratio', 'loose', 'roots', 'plain']) AS name, unnest(['((Flow Bytes/s - bwd) / (log1p_abs(bwd) + 1))',
      '(Flow Bytes/s max (bwd - (Tax Rate - (2 * bwd))))', '(sqrt_abs(bwd) min (-Tax Rate))', 'abs((bwd - 25.5))']) AS expression,
          unnest([round(sum(a), 3), round(sum(b), 3), round(sum(c), 3), round(sum(d), 3)]) AS total FROM x""")
register("ml33_feature_search", lambda s, d: s.createDataFrame([(t, *[round(v, 6) for v in figures]) for t, *figures in E.search_split(benign_flows(s,
    d, indexed_flows).withColumn("attack", 1 - F.col("benign")), ["l_quantity", "bwd", "l_tax"], "attack", "row_index", population=10,
        generations=2)], "expression string, auc_train double, auc_abs_train double, auc_test double, auc_abs_test double"))
register("ml32_feature_search", lambda s, d: s.createDataFrame([(E.text(t), len(E.subtrees(t)), round(v, 6)) for t, v in E.search(benign_flows(s,
    d).withColumn("attack", 1 - F.col("benign")), ["l_quantity", "bwd", "l_tax"], "attack")[:5]], "expression string, nodes int, fitness double"))

# models

register("ml1_scaler", lambda s, d: rounded(M.scale_stats(flows(s, d).withColumn("fixed", F.lit(2.0)), ["l_quantity", "bwd", "fixed"]), 5), W + ", u "
    "AS (SELECT unnest(['l_quantity', 'bwd', 'fixed']) AS feature, unnest([l_quantity, bwd, 2.0]) AS x FROM base) SELECT feature, round(avg(x), 5) AS "
        "mean, round(CASE WHEN stddev_pop(x) = 0 THEN 1 ELSE stddev_pop(x) END, 5) AS std FROM u GROUP BY 1")
_FEATURES = ["l_quantity", "l_discount", "bwd"]


def _scored(s, d, backend):
    """How many rows each learner accepts. Rows with equal features have equal losses and are scored once."""
    df = keep(indexed_flows(s, d).select("row_index", "learner", *_FEATURES).where("learner <> 'UNKNOWN'"), "flows")
    params = M.fit_learners(df, "learner", "row_index", _FEATURES, backend, most_rows=500).collect()  # a row for each learner
    equal = df.groupBy(*_FEATURES).agg(_n().alias("n"), F.min("row_index").alias("row_index"))
    out = M.score_learners(equal, "row_index", _FEATURES, params, ["n"])
    return out.groupBy("learner").agg(F.sum("n").alias("rows"), (F.sum(F.when(F.col("loss") <= F.col("threshold"),
        F.col("n")).otherwise(0)) / F.sum("n")).alias("accepted"), F.max("threshold").alias("threshold"))


register("ml3_isolation_forest", lambda s, d: _scored(s, d, "iforest"))
register("ml2_autoencoder", lambda s, d: _scored(s, d, "ae"))


def _assembled(s, d):
    df = flows(s, d).withColumn("y", (base_label(F.col("label")) != "BENIGN").cast("double"))
    return VectorAssembler(inputCols=[*_FEATURES, "l_linenumber", "dst_port"], outputCol="features").transform(df)


def _counted(s, d, trees=0):
    """Rows of _assembled() counted by class and bins, as trees see no more of them."""
    rows = _assembled(s, d).select(vector_to_array("features").alias("x"), "y", *TIES)
    cuts = T.bin_cuts(rows, len(_FEATURES) + 2)
    return T.bin_counts(rows, ["y"], cuts, {"n": F.lit(1)}, TIES, trees, 1)


def _tree(s, d):
    df = _counted(s, d)
    model = T.counted_tree(df, "y", "n", depth=4, least=20, seed=1)
    return rounded(V.class_report(model.transform(df).select(F.col("y").cast("int").alias("t"), F.col("prediction").cast("int").alias("g"), "n"), "t", "g", "n"))


def _forest_importance(s, d):
    models = T.bagged_trees(_counted(s, d, 10), F.col("y"), F.lit(1.0), trees=10, depth=4, seed=1)
    weights = zip([*_FEATURES, "l_linenumber", "dst_port"], map(float, T.forest_importances(models)), strict=True)
    return s.createDataFrame([*weights], "feature string, importance double")


register("ml23_decision_tree", _tree)
register("ml25_forest_importance", _forest_importance)
register("ml26_logistic_fusion", lambda s, d: rounded(V.auc(LogisticRegression(labelCol="y", regParam=0.01, maxIter=20).fit(_assembled(s,
    d)).transform(_assembled(s, d)).select(F.lit("fusion").alias("model"), F.round(vector_to_array("probability")[1], 8).alias("x"),
        F.col("y").cast("int").alias("y")), ["model"], "x", "y")))
register("ml22_pca", lambda s, d: PCA(k=2, inputCol="v", outputCol="pc").fit(_vectors(s, d)).transform(_vectors(s,
    d)).groupBy("label").agg(*[F.round(F.avg(vector_to_array("pc")[k]), 6).alias(f"pc{k + 1}") for k in (0, 1)]))


def _vectors(s, d):
    return table(s, d, "embeddings").select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))


def _purity(s, d):
    df = _vectors(s, d).withColumnRenamed("v", "features")
    made = KMeans(k=2, seed=1).fit(df).transform(df)
    apart = ClusteringEvaluator().evaluate(made)
    return made.groupBy("prediction").agg(_n().alias("n")).withColumn("silhouette", F.lit(round(apart, 6)))


register("ml17_purity_split", _purity)

# streams

_EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _event_stream(s, d):
    return EW.event_stream(s, d, _EVENTS, "events.parquet")


def _windowed(window, keys):
    def run(s, d):
        found = EW.run_to_table(EW.windowed(_event_stream(s, d), window(), "1 hour", keys, "value"), work_folder(s), "append")
        return found.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.date_format("end", "yyyy-MM-dd HH:mm:ss").alias("end"),
            *keys, "n", F.round("total", 4).alias("total"))

    return run


_FMT = "'%Y-%m-%d %H:%M:%S'"
#: Append mode gives a window once the watermark, an hour behind the newest event, has passed its end; its state then goes.
_CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"
register("st9_tumbling", _windowed(lambda: EW.tumbling("6 hours"), ["event_type"]), f"WITH e AS (SELECT *, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP "
    f"'1970-01-01') AS b FROM events) SELECT strftime(b, {_FMT}) AS start, strftime(b + INTERVAL 6 HOUR, {_FMT}) AS \"end\", event_type, count(*) AS "
        f"n, round(sum(value), 4) AS total FROM e GROUP BY b, event_type HAVING b + INTERVAL 6 HOUR <= {_CLOSED}")
register("st9_sliding", _windowed(lambda: EW.sliding("12 hours", "6 hours"), []), f"WITH e AS (SELECT *, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP "
    f"'1970-01-01') - k * INTERVAL 6 HOUR AS b FROM events, (SELECT unnest([0, 1]) AS k)) SELECT strftime(b, {_FMT}) AS start, strftime(b + INTERVAL "
        f"12 HOUR, {_FMT}) AS \"end\", count(*) AS n, round(sum(value), 4) AS total FROM e GROUP BY b HAVING b + INTERVAL 12 HOUR <= {_CLOSED}")
register("st9_session", _windowed(lambda: EW.session("30 minutes"), ["user_id"]), f"""WITH e AS (SELECT *, CASE
    WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE > ts THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *,
        sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM e)
  SELECT strftime(min(ts), {_FMT}) AS start, strftime(max(ts) + INTERVAL 30 MINUTE, {_FMT}) AS "end", user_id, count(*) AS n, round(sum(value),
      4) AS total FROM g GROUP BY user_id, g HAVING max(ts) + INTERVAL 30 MINUTE <= {_CLOSED}""")
register("st1_block_windows", lambda s, d: BlockStream(s, work_folder(s), 300).run(_event_stream(s, d).select(F.col("event_id").alias("row_index"),
    "ts", (F.col("event_type") == "error").cast("int").alias("attack"))).withColumn("window_end_time", F.date_format("window_end_time", "yyyy-MM-dd HH:mm:ss")),
         f"SELECT min(event_id) AS window_left, max(event_id) + 1 AS window_right, strftime(max(ts), {_FMT}) AS window_end_time, count(*) AS rows, "
             f"CAST(sum((event_type = 'error')::INT) AS BIGINT) AS attacks FROM events GROUP BY floor(event_id / 300)")
register("st5_running_state", lambda s, d: EW.RunningMean(s, work_folder(s), "event_type", "value", ["ts",
    "event_id"]).run(_event_stream(s, d)).withColumn("mean", F.round("mean", 6)),
         "SELECT event_type, count(*) AS n, round(list_reduce(list(value ORDER BY ts), lambda m, x: 0.8 * m + 0.2 * x), 6) AS mean FROM events GROUP BY 1")
