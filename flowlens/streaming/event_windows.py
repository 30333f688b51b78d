"""Event-time windows over a stream, with watermarks for late rows; and a running state per key.

Results go to a table in a folder that the caller names, not to driver memory.
"""

from __future__ import annotations

import re
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.operators.quantiles import running_counts
from flowlens.session import discard, keep


def event_stream(spark: SparkSession, folder: str, schema, files: str = "*.parquet", per_batch: int = 1) -> DataFrame:
    """Parquet files as they come, a few per micro-batch."""
    return spark.readStream.schema(schema).option("pathGlobFilter", files).option("maxFilesPerTrigger", per_batch).parquet(folder)


def in_order(spark: SparkSession, folder: str, part: str) -> None:
    """Gives the files of a table that is partitioned by a number times in the order of that number: a stream of files takes them in the
    order of their times, and tasks write side by side. A row for each file."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    files = sorted((int(re.search(rf"/{part}=(-?\d+)/", f)[1]), f) for f in spark.read.parquet(folder).inputFiles())
    now = int(time.time() * 1000) - 1000 * len(files)
    for k, (_, name) in enumerate(files):
        path = hadoop.Path(name)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).setTimes(path, now + 1000 * k, -1)


def windowed(stream: DataFrame, window: Column, late: str, keys: list[str], value: str, time: str = "ts") -> DataFrame:
    """start, end, keys, n, total of each window; rows later than `late` behind the newest are dropped."""
    out = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(window.alias("w"),
        *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def tumbling(size: str, time: str = "ts") -> Column:
    return F.window(F.col(time), size)


def sliding(size: str, step: str, time: str = "ts") -> Column:
    return F.window(F.col(time), size, step)


def session(gap: str, time: str = "ts") -> Column:
    return F.session_window(F.col(time), gap)


def run_to_table(stream: DataFrame, root: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there now. complete: the last result; append or update: the rows of each batch."""
    spark = stream.sparkSession

    def put(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{root}/result" if mode == "complete" else f"{root}/result/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.read.parquet(f"{root}/result")
    return found.drop("batch") if mode != "complete" else found


class RunningMean:
    """Per key the rows so far and an exponentially weighted mean of `value` in the order of `order`. A micro-batch's rows are numbered by
    ranges, so no task orders or holds a key; the mean is then a weighted sum. The state is a table under the batch's number, so a batch
    that is run again overwrites what it wrote. A null makes its key's mean null."""

    def __init__(self, spark: SparkSession, root: str, key: str, value: str, order: list[str], alpha: float = 0.2):
        self.spark, self.root, self.key, self.value, self.order, self.alpha = spark, root.rstrip("/"), key, value, order, alpha

    def batch(self, rows: DataFrame, number: int) -> None:
        key, fade = F.col(self.key), F.lit(1 - self.alpha)
        ordered = rows.select(key, F.col(self.value).cast("double").alias("_x"), F.struct(*self.order).alias("_order"), F.lit(1).cast("long").alias("_one"))
        placed = keep(running_counts(ordered, [self.key], "_order", ["_one"]), "placed")
        n = placed.groupBy(key.alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
        weight = F.lit(self.alpha) * F.pow(fade, F.col("_n") - 1 - F.col("_one_before"))
        new = placed.join(n, key.eqNullSafe(F.col("_key"))).groupBy(self.key).agg(F.count(F.lit(1)).alias("_n"), F.count("_x").alias("_sound"),
            F.min_by("_x", "_order").alias("_first"), F.sum(weight * F.col("_x")).alias("_sum"))
        shape = f"{self.key} {rows.schema[self.key].dataType.simpleString()}, n long, mean double"
        old = self.spark.read.schema(shape).parquet(f"{self.root}/mean/batch={number - 1}") if number else self.spark.createDataFrame([], shape)
        both = old.select(key.alias("_key"), "n", "mean").join(new, F.col("_key").eqNullSafe(key), "full")
        # a key's first value stands for the mean before it
        before = F.when(F.col("n").isNull(), F.col("_first")).otherwise(F.col("mean"))
        mean = F.when(F.col("_sound") == F.col("_n"), F.pow(fade, F.col("_n")) * before + F.col("_sum"))
        zero = F.lit(0).cast("long")
        out = both.select(F.coalesce(self.key, "_key").alias(self.key), (F.coalesce("n", zero) + F.coalesce("_n", zero)).alias("n"),
            F.when(F.col("_n").isNull(), F.col("mean")).otherwise(mean).alias("mean"))
        out.write.mode("overwrite").parquet(f"{self.root}/mean/batch={number}")
        discard(placed)

    def run(self, stream: DataFrame) -> DataFrame:
        """key, n, mean after all rows that the stream has now."""
        query = stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        return self.spark.read.parquet(f"{self.root}/mean/batch={query.lastProgress['batchId']}")
