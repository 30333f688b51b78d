"""Queries on how learners grow and how window rules bear on flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.operators import increments as I
from flowlens.operators import lifecycle as L
from flowlens.operators import overlap as O
from flowlens.operators import topology as T
from flowlens.sources.testdata import FLOWS_SQL, LOSSES_SQL, flows, losses

from .aggregate_queries import rounded
from .graph_queries import _JAC, _WIN, _WIN_RULES, rates_sql, window_graphs
from .registry import register

W, X = f"WITH {FLOWS_SQL} ", f"WITH {LOSSES_SQL} "


def _windows(s, d):
    """Rows of the vector table that a learner would take at 1.5 of its threshold, in windows of 100, with the first benign
    learner's loss and the likeliest benign learner's probability."""
    table = losses(s, d)
    margin = (F.col("threshold") - F.col("loss")) / (F.abs("threshold") + 1e-12)
    first = table.where("learner = 'NEW_0'").select("row_index", F.col("loss").alias("benign_loss"), F.col("threshold").alias("benign_threshold"))
    prob = table.where("is_benign").groupBy("row_index").agg(F.max(1 / (1 + F.exp(-4 * margin))).alias("benign_prob"))
    return table.where("loss <= threshold * 1.5").withColumn("window_id", F.floor(F.col("row_index") / 100)).join(first, "row_index").join(prob, "row_index")


_GATE = L.Gate(benign_confidence=1.0, cooldown_windows=1, least_rows=30, most_retrains=2, least_benign_prob=0.55, most_exceed=0.35)
_TRACE = X + """, r0 AS (SELECT l.*, CAST(floor(l.row_index / 100) AS BIGINT) AS window_id, f.loss AS bl, f.threshold AS bt,
    (SELECT max(1 / (1 + exp(-4 * (threshold - loss) / (abs(threshold) + 1e-12)))) FROM losses b WHERE b.is_benign
        AND b.row_index = l.row_index) AS prob FROM losses l JOIN losses f ON f.row_index = l.row_index AND f.learner = 'NEW_0'
            WHERE l.loss <= l.threshold * 1.5),
  r1 AS (SELECT *, NOT is_benign OR bl <= bt * 1.0 AS sure FROM r0), b0 AS (SELECT learner, window_id, sum(sure::INT) AS kept,
      avg((loss > threshold)::INT) FILTER (sure) AS exceed, avg(prob) FILTER (sure) AS prob, min(window_id) OVER (PARTITION BY learner) AS birth
          FROM r1 GROUP BY 1, 2),
  b1 AS (SELECT *, CASE WHEN kept = 0 THEN 'benign_conf_filter' WHEN window_id - birth < 1 THEN 'new_learner_cooldown'
      WHEN kept < 30 THEN 'increment_min_samples' END AS early, prob < 0.55 AND exceed > 0.35 AS late FROM b0),
  b2 AS (SELECT *, coalesce(sum((early IS NULL AND NOT late)::INT) OVER (PARTITION BY learner ORDER BY window_id ROWS BETWEEN UNBOUNDED PRECEDING
      AND 1 PRECEDING), 0) AS retrains FROM b1), b3 AS (SELECT learner, window_id, coalesce(early, CASE
          WHEN retrains >= 2 THEN 'max_retrain_per_learner' WHEN late THEN 'increment_quality_gate' END) AS reason FROM b2)"""
register(
    "ml11_gate_chain",
    lambda s, d: L.increment_trace(_windows(s, d), _GATE).groupBy("learner", "reason").agg(F.count(F.lit(1)).alias("n")),
    _TRACE + " SELECT learner, coalesce(reason, CASE WHEN NOT sure THEN 'benign_conf_filter' ELSE '' END) AS reason, count(*) AS n FROM r1 JOIN b3 "
        "USING (learner, window_id) GROUP BY ALL",
)
register(
    "ml12_confidence_mask",
    lambda s, d: L.increment_trace(_windows(s, d), _GATE).groupBy("learner", "passed_confidence").agg(F.count(F.lit(1)).alias("n"),
        F.min("row_index").alias("first")),
    _TRACE + ' SELECT learner, sure AS passed_confidence, count(*) AS n, min(row_index) AS "first" FROM r1 GROUP BY ALL',
)
register(
    "ml15_history_pool",
    lambda s, d: I.spread_by_loss(L.newest(losses(s, d), "learner", "row_index", 120), 10).select("learner", "row_index"),
    X + ", p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY learner ORDER BY row_index DESC) AS r FROM losses) WHERE r <= 120), k AS "
        "(SELECT learner, row_index, row_number() OVER (PARTITION BY learner ORDER BY loss, row_index) - 1 AS i, count(*) OVER (PARTITION BY learner) "
            "AS n FROM p) SELECT learner, row_index FROM k WHERE n <= 10 OR i IN (SELECT CAST(floor(j * (n - 1) / 9) AS BIGINT) FROM (SELECT "
                "unnest(range(10)) AS j))",
)
register(
    "ml16_threshold_refresh",
    lambda s, d: rounded(L.refreshed_threshold(losses(s, d).where("row_index % 5 = 0"), L.newest(losses(s, d).where("row_index % 5 > 0"), "learner",
        "row_index", 50), "learner", "loss", 0.95), 5),
    X + ", p AS (SELECT learner, loss FROM losses WHERE row_index % 5 = 0 UNION ALL SELECT learner, loss FROM (SELECT *, row_number() OVER (PARTITION "
        "BY learner ORDER BY row_index DESC) AS r FROM losses WHERE row_index % 5 > 0) WHERE r <= 50) SELECT learner, round(quantile_cont(loss, "
            "0.95), 5) AS threshold, count(*) AS n FROM p GROUP BY 1",
)
register("ml19_small_learners", lambda s, d: L.small_learners(flows(s, d).withColumn("learner", F.concat("learner", F.lit("_"),
    F.col("l_linenumber").cast("string"))), 1500, 3), W + ", n AS (SELECT concat(learner, '_', l_linenumber) AS learner, count(*) AS n FROM base "
        "WHERE learner LIKE 'NEW_%' GROUP BY 1 HAVING count(*) < 1500) SELECT learner, n FROM n WHERE (SELECT count(*) FROM n) > 3")


def _communities(s, d):
    return L.label_communities(O.jaccard(O.accepted(losses(s, d))).where("both > 0").select(F.col("learner_a").alias("a"),
        F.col("learner_b").alias("b"), F.round("jaccard", 6).alias("weight")))


def _communities_sql(rounds: int = 5) -> str:
    out = X + _JAC + """, b0 AS (SELECT learner_a AS a, learner_b AS b, round(jaccard, 6) AS w FROM jx WHERE "both" > 0 UNION ALL SELECT learner_b,
        learner_a, round(jaccard, 6) FROM jx WHERE "both" > 0), c0 AS (SELECT DISTINCT a AS node, a AS community FROM b0)"""
    for r in range(1, rounds + 1):
        out += f", v{r} AS (SELECT a AS node, community, round(sum(w), 9) AS w FROM b0 JOIN c{r - 1} c ON c.node = b0.b GROUP BY 1, 2), c{r} AS (SELECT node, first(community ORDER BY w DESC, community) AS community FROM v{r} GROUP BY 1)"
    return out + f" SELECT node, community FROM c{rounds}"


register("gr21_label_propagation", _communities, _communities_sql())
def _rates(s, d):
    """Window rules mapped back to the flows: every window stands for its flows."""
    rows = T.window_rules(window_graphs(s, d), quiet=0.7).withColumn("attacks", F.round(F.col("attack_ratio") * F.col("rows")).cast("long"))
    return T.rule_rates(rows.withColumn("benign", F.col("rows") - F.col("attacks")), T.WINDOW_RULES)


register(
    "jn17_window_rule_rates",
    lambda s, d: rounded(_rates(s, d)),
    _WIN + _WIN_RULES + ", wf AS (SELECT b.benign, wq.* FROM base b LEFT JOIN wq ON wq.window_id = CAST(floor(b.row_index / 2000) AS BIGINT))" +
        rates_sql("wf", T.WINDOW_RULES),
)
