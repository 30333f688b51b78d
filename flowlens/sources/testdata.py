"""The generic test tables seen as the domain's tables: flows, scored streams, losses, acceptances.

Each view has a twin in DuckDB SQL, so that a query and its SQL start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Fixed: what breaks ties of equal times among flows.
TIES = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def with_row_index(df: DataFrame, time: str, ties: list[str], name: str = "row_index") -> DataFrame:
    """Numbers rows from 0 in the order of time and ties. A day's rows are numbered on their own and then moved by the
    rows of earlier days, so only the table of days is ordered as a whole."""
    day = df.withColumn("_day", F.to_date(time))
    base = day.groupBy("_day").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)  # a row for each day
    base = base.select(F.col("_day").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = F.row_number().over(Window.partitionBy("_day").orderBy(time, *ties)) - 1
    return day.withColumn("_own", own).join(base, F.col("_day").eqNullSafe(F.col("_of"))).withColumn(name, F.col("_base") +
        F.col("_own")).drop("_day", "_of", "_base", "_own")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as network flows: six groups of rows behave like six kinds of traffic."""
    h = F.col("l_orderkey") * 7 + F.col("l_partkey") * 13 + F.col("l_linenumber")
    g = F.col("l_suppkey") % 6
    last = lambda base, n: F.concat(F.lit(base), (h % n).cast("string"))
    wide_port, any_port = 1024 + (h * 31) % 60000, 1 + (h * 17) % 60000
    service = F.when(F.col("l_linenumber") <= 5, 80).when(F.col("l_linenumber") == 6, 443).otherwise(1000 + h % 20)
    year = F.year("l_shipdate") % 3
    df = table(spark, sf_dir, "lineitem").select(
        "*",
        F.expr("timestampadd(SECOND, cast(l_orderkey % 86400 as int), l_shipdate)").alias("ts"),
        F.concat(
            F.when(year == 0, "2017").when(year == 1, "2019").otherwise("2026"),
            F.lit("|"),
            F.when(F.col("l_returnflag") == "N", "BENIGN").when(F.col("l_returnflag") == "A", "DoS Hulk").otherwise("Portscan"),
        ).alias("label"),
        F.when(F.col("l_linenumber") <= 4, 6).when(F.col("l_linenumber") <= 6, 17).otherwise(1).alias("protocol"),
        F.when(g == 3, "192.168.1.1").otherwise(last("192.168.1.", 40)).alias("src_ip"),
        F.when(g.isin(0, 3), "10.1.0.1").when(g.isin(1, 2), last("8.8.4.", 200)).otherwise(last("10.1.0.", 8)).alias("dst_ip"),
        F.when(g == 3, 40000).when(g.isin(0, 1, 2), wide_port).otherwise(1024 + h % 50).cast("int").alias("src_port"),
        F.when(g == 0, 80).when(g.isin(1, 2), any_port).when(g == 3, 443).otherwise(service).cast("int").alias("dst_port"),
        F.col("l_quantity").alias("fwd"),
        F.when(g == 2, 0.0).otherwise(F.floor(F.col("l_quantity") * (1 - F.col("l_discount") * 5)).cast("double")).alias("bwd"),
        F.when(F.col("l_partkey") % 11 == 0, "UNKNOWN").otherwise(F.concat(F.lit("NEW_"), g.cast("string"))).alias("learner"),
    )
    return df


def indexed_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """flows with row_index, their place in time; only for what needs the order."""
    return with_row_index(flows(spark, sf_dir), "ts", TIES)


FLOWS_SQL = """flows_raw AS (
  SELECT *, l_orderkey*7 + l_partkey*13 + l_linenumber AS h, l_suppkey % 6 AS g, l_shipdate + to_seconds(l_orderkey % 86400) AS ts FROM lineitem),
flows AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate, ts,
    concat(CASE year(l_shipdate) % 3 WHEN 0 THEN '2017' WHEN 1 THEN '2019' ELSE '2026' END, '|',
           CASE l_returnflag WHEN 'N' THEN 'BENIGN' WHEN 'A' THEN 'DoS Hulk' ELSE 'Portscan' END) AS label,
    CASE WHEN l_linenumber <= 4 THEN 6 WHEN l_linenumber <= 6 THEN 17 ELSE 1 END AS protocol,
    CASE WHEN g = 3 THEN '192.168.1.1' ELSE concat('192.168.1.', h % 40) END AS src_ip,
    CASE WHEN g IN (0, 3) THEN '10.1.0.1' WHEN g IN (1, 2) THEN concat('8.8.4.', h % 200) ELSE concat('10.1.0.', h % 8) END AS dst_ip,
    CAST(CASE WHEN g = 3 THEN 40000 WHEN g IN (0, 1, 2) THEN 1024 + (h*31) % 60000 ELSE 1024 + h % 50 END AS INT) AS src_port,
    CAST(CASE WHEN g = 0 THEN 80 WHEN g IN (1, 2) THEN 1 + (h*17) % 60000 WHEN g = 3 THEN 443
              ELSE CASE WHEN l_linenumber <= 5 THEN 80 WHEN l_linenumber = 6 THEN 443 ELSE 1000 + h % 20 END END AS INT) AS dst_port,
    l_quantity AS fwd,
    CASE WHEN g = 2 THEN 0.0::DOUBLE ELSE floor(l_quantity * (1 - l_discount*5)) END AS bwd,
    CASE WHEN l_partkey % 11 = 0 THEN 'UNKNOWN' ELSE concat('NEW_', g) END AS learner,
    row_number() OVER (ORDER BY ts, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS row_index
  FROM flows_raw),
base AS (SELECT *, upper(regexp_replace(label, '^20[0-9][0-9]\\|', '')) AS base_label, left(label, 4) AS year_tag,
  CASE WHEN label LIKE '%|BENIGN' THEN 1 ELSE 0 END AS benign FROM flows)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a scored stream: row_index, ts, label (error is the attack), value, k from the JSON text."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("row_index"), "ts", "user_id", F.col("event_type").alias("label"), "value", F.get_json_object("props",
            "$.k").cast("int").alias("k")
    )


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """learner, axis, centre: mean vector of each embedding label, as a one-class model of that label."""
    v = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("axis", "x"))
    return v.groupBy(F.concat(F.lit("NEW_"), F.col("label").cast("string")).alias("learner"), "axis").agg(F.avg(F.col("x").cast("double")).alias("centre"))


def losses(spark: SparkSession, sf_dir: str, quantile: float = 0.9) -> DataFrame:
    """row_index, label, learner, loss, threshold, is_benign: squared distance of each vector to each label's centroid,
    and the quantile of a learner's own rows as its threshold. Learners 0 and 1 count as benign."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("axis", "x"))
    c = centroids(spark, sf_dir)
    loss = v.join(c, "axis").groupBy(F.col("vec_id").alias("row_index"), "label",
        "learner").agg(F.round(F.sum((F.col("x").cast("double") - F.col("centre")) ** 2), 6).alias("loss"))
    own = loss.where(F.concat(F.lit("NEW_"),
        F.col("label").cast("string")) == F.col("learner")).groupBy("learner").agg(F.round(F.expr(f"percentile(loss, {quantile}D)"), 6).alias("threshold"))
    return loss.join(own, "learner").withColumn("is_benign", F.col("learner").isin("NEW_0", "NEW_1"))


LOSSES_SQL = """vecs AS (SELECT vec_id, label, unnest(range(64)) AS axis, unnest(embedding)::DOUBLE AS x FROM embeddings),
centroids AS (SELECT concat('NEW_', label) AS learner, axis, avg(x) AS centre FROM vecs GROUP BY ALL),
loss0 AS (SELECT v.vec_id AS row_index, v.label, c.learner, round(sum((v.x - c.centre) ** 2), 6) AS loss FROM vecs v JOIN centroids c USING (axis)
    GROUP BY ALL),
thr AS (SELECT learner, round(quantile_cont(loss, 0.9), 6) AS threshold FROM loss0 WHERE concat('NEW_', label) = learner GROUP BY learner),
losses AS (SELECT l.*, t.threshold, l.learner IN ('NEW_0', 'NEW_1') AS is_benign FROM loss0 l JOIN thr t USING (learner))"""
