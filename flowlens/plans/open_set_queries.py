"""Queries on the open-set stream: clusters, counters, increments, gates, reservoirs, first learners."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.operators import clusters as D
from flowlens.operators import increments as I
from flowlens.operators import lifecycle as L
from flowlens.operators import models as M
from flowlens.operators import purity as P
from flowlens.session import keep
from flowlens.sources.testdata import FLOWS_SQL, LOSSES_SQL, flows, indexed_flows, losses, table
from flowlens.streaming.event_windows import in_order
from flowlens.streaming.open_set import OpenSet
from flowlens.streaming.reservoir import Reservoir

from .aggregate_queries import rounded
from .graph_queries import _JAC
from .model_queries import work_folder
from .registry import register

W, X, WR = f"WITH {FLOWS_SQL} ", f"WITH {LOSSES_SQL} ", f"WITH RECURSIVE {FLOWS_SQL} "


def _n():
    """Rows, as an aggregate; made when it is used, as columns need a session."""
    return F.count(F.lit(1))


# clusters of all unknown flows

_PORTS, _EPS, _LEAST, _CLASS = ["src_port", "dst_port", "protocol"], 0.05, 12, 40


def _classes(s, d):
    found = D.new_classes(indexed_flows(s, d).where("learner = 'UNKNOWN'"), "row_index", _PORTS, _EPS, _LEAST, _CLASS)
    return found.groupBy("cluster").agg(_n().alias("n"), F.min("row_index").cast("long").alias("first"), F.sum("row_index").cast("long").alias("sum"))


register(
    "ml7_new_classes",
    _classes,
    WR
    + f""", u AS (SELECT row_index, src_port, dst_port, protocol FROM base WHERE learner = 'UNKNOWN'),
  st AS (SELECT avg(src_port) AS ma, stddev_pop(src_port) AS sa, avg(dst_port) AS mb, stddev_pop(dst_port) AS sb, avg(protocol) AS mc,
      stddev_pop(protocol) AS sc FROM u),
  z AS (SELECT row_index, src_port, dst_port, protocol, (src_port - ma) / sa AS x, (dst_port - mb) / sb AS y, (protocol - mc) / sc AS p FROM u, st),
  sp AS MATERIALIZED (SELECT src_port, dst_port, protocol, any_value(x) AS x, any_value(y) AS y, any_value(p) AS p, count(*) AS w,
      min(row_index) AS id FROM z GROUP BY 1, 2, 3),
  nb AS MATERIALIZED (SELECT a.id, b.id AS other, b.w FROM sp a JOIN sp b ON a.protocol = b.protocol AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= {_EPS**2}),
  core AS MATERIALIZED (SELECT id FROM nb GROUP BY id HAVING sum(w) >= {_LEAST}),
  ce AS MATERIALIZED (SELECT nb.id AS a, nb.other AS b FROM nb JOIN core c ON nb.id = c.id JOIN core e ON nb.other = e.id),
  cl(node, c) USING KEY (node) AS (SELECT a, min(b) FROM ce GROUP BY 1
    UNION SELECT e.a, min(l.c) FROM cl l JOIN ce e ON e.b = l.node JOIN recurring.cl now ON now.node = e.a WHERE l.c < now.c GROUP BY 1),
  lab AS (SELECT node AS id, c FROM cl UNION ALL SELECT nb.id, min(cl.c) FROM nb JOIN cl ON cl.node = nb.other WHERE nb.id NOT IN (SELECT id
      FROM core) GROUP BY 1),
  r AS (SELECT lab.c, count(*) AS n, min(z.row_index) AS lo, sum(z.row_index) AS total FROM z JOIN sp USING (src_port, dst_port, protocol) JOIN lab
      ON lab.id = sp.id GROUP BY 1 HAVING count(*) >= {_CLASS})
  SELECT row_number() OVER (ORDER BY c) - 1 AS cluster, n, lo AS "first", CAST(total AS BIGINT) AS "sum" FROM r""",
)
register("ml4_tail_thresholds", lambda s, d: rounded(M.tail_thresholds(flows(s, d).select("learner",
    (F.col("l_extendedprice") / F.col("l_quantity")).alias("loss")), "learner", "loss"), 4))

# the first learners' rows

register(
    "ml8_initial_rows",
    lambda s, d: L.initial_rows(indexed_flows(s, d).select("row_index", "label", "l_tax"), 0.05, 2000, True, "2019", 1500,
        100).groupBy("label").agg(_n().alias("n"), F.max("row_index").cast("long").alias("last")),
    W + """, n AS (SELECT count(*) AS n FROM base), e AS (SELECT row_index, label, row_number() OVER (ORDER BY row_index) AS k FROM base
        WHERE benign = 1 AND year_tag = '2019'),
  k AS (SELECT max(row_index) AS last FROM e WHERE k <= 1500), c AS (SELECT least(greatest(CAST(floor(n * 0.05) AS BIGINT), 2000, last + 1),
      n - 1) AS stop FROM n, k)
  SELECT label, count(*) AS n, max(row_index) AS "last" FROM e, c WHERE k <= 1500 AND row_index < stop GROUP BY label HAVING count(*) >= 100""",
)
register(
    "ml8_all_labels",
    lambda s, d: L.initial_rows(indexed_flows(s, d).select("row_index", "label"), 0.1, 500, benign_only=False,
        least_class=60).groupBy("label").agg(_n().alias("n")),
    W + ", c AS (SELECT least(greatest(CAST(floor(count(*) * 0.1) AS BIGINT), 500), count(*) - 1) AS stop FROM base) SELECT label, count(*) AS n FROM "
        "base, c WHERE row_index < stop GROUP BY 1 HAVING count(*) >= 60",
)

# counters of a stream whose losses are those of the vector table


#: Rows of a micro-batch whose blocks don't depend on each other.
_TOGETHER = 100_000


def _blocks(s, df, root, size):
    """df (row_index) as a folder with a file for each `size` rows, read as a stream of a file at a time, the first rows first."""
    cut = df.withColumn("part", F.floor(F.col("row_index") / size))
    cut.repartition("part").write.partitionBy("part").parquet(f"{root}/in")
    in_order(s, f"{root}/in", "part")
    return s.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in/*")


def _kept_losses(s, d):
    """The losses, worked out once and in ranges of row_index; and the part of them that a block's rows may have."""
    known = keep(losses(s, d).drop("label").repartitionByRange("row_index").sortWithinPartitions("row_index"), "losses")

    def of(block):
        low, high = block.agg(F.min("row_index"), F.max("row_index")).first()
        return known.where(F.col("row_index").between(low, high)).join(block.select("row_index"), "row_index")

    return of


def _vector_loop(s, d, size=300):
    root = work_folder(s)
    rows = table(s, d, "embeddings").select(F.col("vec_id").alias("row_index"), F.col("label").cast("string").alias("label"))
    run = OpenSet(s, f"{root}/state", [], trigger=None, scorer=_kept_losses(s, d), block=size)
    run.run(_blocks(s, rows, root, _TOGETHER // size * size))
    return run


register("st3_accept_counts", lambda s, d: _vector_loop(s, d).accept_counts(), X + "SELECT learner, count(*) AS n FROM losses WHERE loss <= threshold "
    "GROUP BY 1")
register("st4_pair_counts", lambda s, d: _vector_loop(s, d, 450).pair_counts(), X + _JAC + ' SELECT learner_a, learner_b, "both" FROM jx WHERE "both" > 0')
register(
    "st7_label_counts",
    lambda s, d: _vector_loop(s, d, 700).label_counts(),
    X + """, w AS (SELECT row_index, learner, row_number() OVER (PARTITION BY row_index ORDER BY is_benign, loss, learner) AS r FROM losses
        WHERE loss <= threshold)
  SELECT coalesce(w.learner, 'UNKNOWN') AS learner, v.label::VARCHAR AS label, count(*) AS n FROM embeddings v LEFT JOIN w ON w.row_index = v.vec_id
      AND r = 1 GROUP BY 1, 2""",
)
register(
    "st8_window_log",
    lambda s, d: _vector_loop(s, d).window_log().select("window_left", "window_right", "rows", "buffered"),
    X + """, w AS (SELECT v.vec_id, max((l.loss <= l.threshold)::INT) AS known FROM embeddings v JOIN losses l ON l.row_index = v.vec_id GROUP BY 1),
        b AS (SELECT vec_id // 300 AS k, count(*) AS n, min(vec_id) AS a, max(vec_id) + 1 AS z, sum(1 - known) AS u FROM w GROUP BY 1)
  SELECT a AS window_left, z AS window_right, n AS rows, CAST(sum(u) OVER (ORDER BY a) AS BIGINT) AS buffered FROM b""",
)


def _reservoir(s, d):
    """The newest 120 rows of each learner over the stream, then ten of them at even places of loss."""
    root = work_folder(s)
    known = _kept_losses(s, d)
    pool = Reservoir(s, f"{root}/state", "learner", "row_index", 120, lambda block: known(block).select("learner", "row_index", "loss"))
    rows = table(s, d, "embeddings").select(F.col("vec_id").alias("row_index"))
    return I.spread_by_loss(pool.run(_blocks(s, rows, root, _TOGETHER // 260 * 260)), 10).select("learner", "row_index")


register(
    "st5_reservoir",
    _reservoir,
    X + """, p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY learner ORDER BY row_index DESC) AS r FROM losses) WHERE r <= 120),
        k AS (SELECT learner, row_index, row_number() OVER (PARTITION BY learner ORDER BY loss, row_index) - 1 AS i,
            count(*) OVER (PARTITION BY learner) AS n FROM p)
  SELECT learner, row_index FROM k WHERE n <= 10 OR i IN (SELECT CAST(floor(j * (n - 1) / 9) AS BIGINT) FROM (SELECT unnest(range(10)) AS j))""",
)

# samples of increments

register(
    "wn21_loss_samples",
    lambda s, d: I.subsample(losses(s, d).select("learner", "row_index", "loss"), 40, 0.8),
    X + """, q AS (SELECT learner, quantile_cont(loss, 0.8) AS q FROM losses GROUP BY 1), o AS (SELECT l.learner, row_index, loss,
        row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY l.learner) AS n FROM losses l JOIN q ON q.learner = l.learner
            AND loss <= q WINDOW w AS (PARTITION BY l.learner ORDER BY loss, row_index)),
  g AS (SELECT *, CASE WHEN i < n // 3 THEN 0 WHEN i < 2 * n // 3 THEN n // 3 ELSE 2 * n // 3 END AS a, CASE WHEN i < n // 3 THEN n // 3
      WHEN i < 2 * n // 3 THEN 2 * n // 3 ELSE n END AS b FROM o),
  p AS (SELECT *, least(b - a, 13) AS k FROM g), h AS (SELECT *, row_number() OVER (PARTITION BY learner ORDER BY i) AS place FROM p WHERE n <= 40
      OR EXISTS (SELECT 1 FROM (SELECT unnest(range(13)) AS j) WHERE j < k AND floor(j * (b - a - 1) / greatest(1, k - 1)) = i - a))
  SELECT learner, row_index, loss FROM h WHERE place <= 40""",
)

# gates of new classes

_GATE = P.PurityGate(most_accept=0.5, most_prob=0.45, most_p90=0.7, mixed=True, mixed_low=0.2, mixed_high=0.6, routes=True, route_rows=50,
    least_multi=0.2, most_top1=0.6)


def _purity_gate(s, d):
    """The labels of the vector table as clusters, judged against its one-class learners."""
    rows = table(s, d, "embeddings").select(F.col("vec_id").alias("row_index"), F.col("label").alias("cluster"))
    out = P.judge_clusters(rows, losses(s, d).drop("label"), [], _GATE)
    kept = ["cluster", "n", "benign_accept_rate", "benign_prob_mean", "benign_prob_p10", "benign_prob_p90", "route_multi_accept_ratio", "route_top1_share"]
    return rounded(out.select(*kept, F.concat_ws("|", "reasons").alias("reasons"), "passed"), 5)


register(
    "ml17_purity_gate",
    _purity_gate,
    X + """, m AS (SELECT row_index, label, learner, is_benign, loss <= threshold AS taken, (threshold - loss) / (abs(threshold) + 1e-12) AS m FROM losses),
  b AS (SELECT row_index, label, max(taken::INT) AS taken, 1 / (1 + exp(-4 * max(m))) AS p FROM m WHERE is_benign GROUP BY 1, 2),
  f AS (SELECT label, count(*) AS n, avg(taken) AS acc, avg(p) AS mean, quantile_cont(p, 0.1) AS p10, quantile_cont(p, 0.9) AS p90 FROM b GROUP BY 1),
  w AS (SELECT row_index, label, first(learner ORDER BY m DESC, learner) AS won, sum((m >= 0)::INT) AS many FROM m GROUP BY 1, 2), v AS (SELECT label,
      won, count(*) AS c, sum((many >= 2)::INT) AS two FROM w GROUP BY 1, 2),
  g AS (SELECT label, sum(two) / sum(c) AS multi, max(c) / sum(c) AS top1 FROM v GROUP BY 1),
  j AS (SELECT f.label AS cluster, n, acc, mean, p10, p90, CASE WHEN n >= 50 THEN multi END AS multi, CASE WHEN n >= 50 THEN top1 END AS top1 FROM f
      JOIN g USING (label)),
  r AS (SELECT *, concat_ws('|', CASE WHEN acc > 0.5 THEN 'benign_accept_rate_exceed' END, CASE WHEN mean > 0.45 THEN 'benign_prob_mean_exceed' END,
      CASE WHEN p90 > 0.7 THEN 'benign_prob_p90_exceed' END,
    CASE WHEN p10 < 0.2 AND p90 > 0.6 THEN 'mixed_benign_prob_band' END, CASE WHEN multi >= 0.2
        AND top1 <= 0.6 THEN 'mixed_route_inconsistent' END) AS reasons FROM j)
  SELECT cluster::BIGINT AS cluster, n, round(acc, 5) AS benign_accept_rate, round(mean, 5) AS benign_prob_mean, round(p10, 5) AS benign_prob_p10,
      round(p90, 5) AS benign_prob_p90, round(multi, 5) AS route_multi_accept_ratio, round(top1, 5) AS route_top1_share, reasons,
          reasons = '' AS passed FROM r""",
)
register(
    "ml17_structure_split",
    lambda s, d: rounded(P.split_figures(flows(s, d).where("learner <> 'UNKNOWN'").select(F.monotonically_increasing_id().alias("row_index"),
        (F.col("l_suppkey") % 6).alias("cluster"), "src_port", "dst_port"), ["src_port", "dst_port"], rounds=4), 4),
)

# the loop over the flows

_FEATURES = ["ratio", "port", "source"]


def _loop(s, d, size, seed_share=0.05, **options):
    """Blocks of `size` flows, labelled by how they behave; the first learners are made of the first share of the flows, without those
    that get no answer (ONEWAY), which are new to them."""
    root = work_folder(s)
    g = F.col("l_suppkey") % 6
    kind = F.when(g >= 4, "BENIGN").when(g == 1, "SCAN").when(g == 2, "ONEWAY").otherwise("SERVICE")
    rows = indexed_flows(s, d).select("row_index", kind.alias("label"), (F.col("bwd") / F.col("l_quantity")).alias("ratio"),
        F.log1p(F.col("dst_port").cast("double")).alias("port"), F.log1p(F.col("src_port").cast("double")).alias("source"))
    stream = _blocks(s, rows, root, size)
    seen = s.read.schema(rows.schema).parquet(f"{root}/in/*").where("label <> 'ONEWAY'")
    run = OpenSet(s, f"{root}/state", _FEATURES, **{"trigger": 300, "least_class": 100, "eps": 0.35, "least": 10, "most_rows": 1000, "risk": 0.01, **options})
    run.start(L.initial_rows(seen, seed_share, 1500, benign_only=False, least_class=50), "label")
    return run, stream


def _open_set(s, d):
    run, stream = _loop(s, d, 100_000, trigger=2000)
    return run.run(stream).groupBy("assigned_learner", "phase").agg(_n().alias("n"))


register("ml18_open_set_stream", _open_set)


def _increments(s, d):
    """Why each accepted flow does or doesn't train, over blocks of 30,000 flows."""
    run, stream = _loop(s, d, 30_000, gate=L.Gate(least_rows=200, benign_confidence=1.0, most_retrains=3), guard=I.Guard(rows=200, trees=50),
        most_new=500, history_rows=300, pool_rows=1000)
    run.run(stream)
    return run.trace().groupBy("learner", "reason").agg(_n().alias("n"), F.sum(F.col("used").cast("long")).alias("used"))


register("ml10_increments", _increments)


def _recluster(s, d):
    run, stream = _loop(s, d, 30_000, least_class=60, small_rows=100_000, small_trigger=0)
    run.run(stream)
    return run.window_log().select("window_left", "rows", "learners", "buffered", "destroyed", "next_id")


register("ml19_recluster", _recluster)
