"""Count-based windows over a stream: blocks of a fixed number of rows, cut across micro-batches.

Rows carry a gapless index. A micro-batch's complete blocks are summed and appended to the log; rows of a block that isn't
complete wait in a state table of at most block - 1 rows. Both are written under the batch's number, so a batch that is
run again after a failure overwrites what it wrote: each block is counted once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Summary = Callable[[DataFrame, str], DataFrame]


def block_log(rows: DataFrame, block: str) -> DataFrame:
    """window_left, window_right, window_end_time, rows, attacks of each block; rows has row_index, ts, attack (0/1)."""
    return rows.groupBy(block).agg(
        F.min("row_index").alias("window_left"), (F.max("row_index") + 1).alias("window_right"), F.max("ts").alias("window_end_time"),
            F.count(F.lit(1)).alias("rows"), F.sum("attack").cast("long").alias("attacks")
    )


class BlockStream:
    """Writes `summary` of each block of `size` rows to root/log/batch=N, keeping root/rest/batch=N."""

    def __init__(self, spark: SparkSession, root: str, size: int, index: str = "row_index", summary: Summary = block_log):
        self.spark, self.root, self.size, self.index, self.summary = spark, root.rstrip("/"), size, index, summary

    def _rest(self, batch: int, schema) -> DataFrame:
        if batch == 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/rest/batch={batch - 1}")

    def batch(self, rows: DataFrame, number: int) -> None:
        all_ = rows.unionByName(self._rest(number, rows.schema)).withColumn("_block", F.floor(F.col(self.index) / self.size)).persist()
        whole = all_.groupBy("_block").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == self.size).select("_block")
        self.summary(all_.join(whole, "_block", "left_semi"), "_block").drop("_block").write.mode("overwrite").parquet(f"{self.root}/log/batch={number}")
        all_.join(whole, "_block", "left_anti").drop("_block").write.mode("overwrite").parquet(f"{self.root}/rest/batch={number}")
        all_.unpersist()

    def run(self, stream: DataFrame) -> DataFrame:
        """Consumes what the stream has now; returns the log so far, with the open last block."""
        query = stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        last = query.lastProgress["batchId"] if query.lastProgress else None
        log = self.spark.read.parquet(f"{self.root}/log").drop("batch")
        if last is None:
            return log
        open_ = self._rest(last + 1, stream.schema).withColumn("_block", F.floor(F.col(self.index) / self.size))
        return log.unionByName(self.summary(open_, "_block").drop("_block"))
