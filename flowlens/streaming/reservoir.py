"""A pool of each key's newest rows over a stream, however it is cut into micro-batches.

The pool after a batch is the newest `cap` rows of the pool before it and the batch's rows; it is a table under the batch's number, so a
batch that is run again overwrites what it wrote. The newest rows of a union are those of its parts' newest rows, so the pool doesn't
depend on the cuts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flowlens.operators.lifecycle import newest


class Reservoir:
    """make turns a micro-batch into rows with `key` and `order`, which tells a key's rows apart."""

    def __init__(self, spark: SparkSession, root: str, key: str, order: str, cap: int, make: Callable[[DataFrame], DataFrame]):
        self.spark, self.root, self.key, self.order, self.cap, self.make = spark, root.rstrip("/"), key, order, cap, make

    def batch(self, rows: DataFrame, number: int) -> None:
        new = self.make(rows)
        if number:
            new = new.unionByName(self.spark.read.schema(new.schema).parquet(f"{self.root}/pool/batch={number - 1}"))
        newest(new, self.key, self.order, self.cap).write.mode("overwrite").parquet(f"{self.root}/pool/batch={number}")

    def run(self, stream: DataFrame) -> DataFrame:
        """The pool after all rows that the stream has now."""
        query = stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        return self.spark.read.parquet(f"{self.root}/pool/batch={query.lastProgress['batchId']}")
