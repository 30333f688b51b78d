"""Streams whose results must not depend on how rows are cut into files, frames and micro-batches."""

from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from flowlens.streaming.event_windows import RunningMean


def test_running_mean_of_keys_larger_than_a_frame(spark, tmp_path):
    """25,000 rows of a key in mixed order: Arrow hands a task frames of 10,000 rows."""
    rng = np.random.default_rng(3)
    start, rows = datetime(2024, 1, 1), []
    for part in range(2):
        made = [(k, start + timedelta(seconds=(part * 25_000 + k) // 2), "a", float(rng.exponential(50))) for k in range(part * 25_000, (part + 1) * 25_000)]
        made += [(10**6 + part, start + timedelta(days=part), "b", None if part else 3.0)]
        rows += made
        mixed = [made[k] for k in rng.permutation(len(made))]
        spark.createDataFrame(mixed, "id long, ts timestamp_ntz, key string, value double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    expected = None
    for _, _, key, value in sorted(r for r in rows if r[2] == "a"):
        expected = value if expected is None else 0.8 * expected + 0.2 * value
    files = sorted(spark.read.parquet(f"{tmp_path}/in").withColumn("f", F.input_file_name()).groupBy("f").agg(F.max("id").alias("m")).collect(), key=lambda r: r["m"])
    for k, file in enumerate(files):  # the earlier rows come first
        spark.read.parquet(file["f"]).coalesce(1).write.parquet(f"{tmp_path}/ordered/{k}")
    stream = spark.readStream.schema("id long, ts timestamp_ntz, key string, value double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/ordered/*")
    got = {r["key"]: (r["n"], r["mean"]) for r in RunningMean(spark, f"{tmp_path}/state", "key", "value", ["ts", "id"]).run(stream).collect()}
    assert got["a"][0] == 50_000 and abs(got["a"][1] - expected) < 1e-9
    assert got["b"] == (2, None)


def test_blocks_that_learn_nothing_go_together(spark, sf_dir, tmp_path):
    """Counters and log lines are the same for a micro-batch a block and for one micro-batch of all blocks."""
    from flowlens.plans.open_set_queries import _blocks, _kept_losses
    from flowlens.streaming.open_set import OpenSet

    rows = spark.range(500).select(F.col("id").alias("row_index"), (F.col("id") % 3).cast("string").alias("label"))
    of, found = _kept_losses(spark, sf_dir), []
    for name, file, block in (("one", 200, 0), ("all", 400, 200)):
        run = OpenSet(spark, f"{tmp_path}/{name}/state", [], trigger=None, scorer=of, block=block)
        run.run(_blocks(spark, rows, f"{tmp_path}/{name}", file))
        assert run._last() + 1 == (3 if name == "one" else 2)
        log = run.window_log().select("window_left", "window_right", "rows", "buffered")
        found.append([sorted(map(tuple, t.collect())) for t in (log, run.accept_counts(), run.pair_counts(), run.label_counts())])
    assert found[0] == found[1] and len(found[0][0]) == 3 and found[0][0][2][3] > found[0][0][0][3]


def test_files_come_in_the_order_of_their_part(spark, tmp_path):
    import os

    from flowlens.streaming.event_windows import in_order

    spark.range(60).select("id", (11 - F.col("id") % 12).alias("part")).repartition(4, "part").write.partitionBy("part").parquet(f"{tmp_path}/in")
    in_order(spark, f"{tmp_path}/in", "part")
    at = {k: {os.stat(f"{tmp_path}/in/part={k}/{f}").st_mtime for f in os.listdir(f"{tmp_path}/in/part={k}") if f.endswith(".parquet")} for k in range(12)}
    assert all(max(at[k]) < min(at[k + 1]) for k in range(11))
