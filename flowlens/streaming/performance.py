"""How long a run's stages take: timers around actions, a listener for streams, and the table and report made of them."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from flowlens.sources.sinks import write_text

#: The stages of the loop whose seconds a run adds up.
STAGES = ["detect", "cluster", "create", "retrain", "window"]
#: The stages that make up the core of a run.
CORE = ["io_load_total", "init_learners", "stream_inference", "stream_cluster", "stream_create_learner", "stream_retrain", "qualification_total"]


class Timers:
    """Seconds and rows by stage; a stage that runs again is added to. Only actions take time, so a stage must end with one."""

    def __init__(self) -> None:
        self.seconds: dict[str, float] = {}
        self.rows: dict[str, int] = {}

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began

    def count(self, name: str, rows: int) -> None:
        self.rows[name] = self.rows.get(name, 0) + rows

    def table(self, spark: SparkSession) -> DataFrame:
        """stage, seconds, rows, rows_per_s (null without seconds or rows)."""
        names = sorted({*self.seconds, *self.rows})
        df = spark.createDataFrame([(n, self.seconds.get(n, 0.0), self.rows.get(n)) for n in names], "stage string, seconds double, rows long")
        return df.withColumn("rows_per_s", rate(F.col("rows"), F.col("seconds")))


class Progress(StreamingQueryListener):
    """Collects each micro-batch's number, rows and milliseconds by step; add it with spark.streams.addListener."""

    def __init__(self) -> None:
        self.batches: list[tuple[str, int, int, int, dict[str, int]]] = []

    def onQueryStarted(self, event) -> None:
        """Nothing is known yet."""

    def onQueryProgress(self, event) -> None:
        p = event.progress
        took = dict(p.durationMs)
        self.batches.append((str(p.runId), p.batchId, p.numInputRows, int(took.get("triggerExecution", 0)), {k: int(v) for k, v in took.items()}))

    def onQueryIdle(self, event) -> None:
        """An idle query makes no batch."""

    def onQueryTerminated(self, event) -> None:
        """Its batches stay."""

    def table(self, spark: SparkSession) -> DataFrame:
        """run, batch, rows, ms, steps, rows_per_s."""
        df = spark.createDataFrame(self.batches, "run string, batch long, rows long, ms long, steps map<string, long>")
        return df.withColumn("rows_per_s", rate(F.col("rows"), F.col("ms") / 1000))


def rate(rows, seconds):
    """rows over seconds; null on 0 seconds or without either."""
    return F.when(seconds > 0, rows / seconds)


def window_averages(log: DataFrame) -> DataFrame:
    """One row: windows, rows, <stage>_seconds_total and avg_<stage>_seconds (0 without windows) of a log with a row for each window, and
    rows_per_s of the first stage and of whole windows (null on 0 seconds)."""
    n = F.count(F.lit(1))
    out = log.agg(n.alias("windows"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), *[F.coalesce(F.sum(f"{s}_seconds"),
        F.lit(0.0)).alias(f"{s}_seconds_total") for s in STAGES])
    out = out.withColumns({f"avg_{s}_seconds": F.when(F.col("windows") > 0, F.col(f"{s}_seconds_total") / F.col("windows")).otherwise(0.0) for s in STAGES})
    return out.withColumns({"rows_per_s_detect": rate(F.col("rows"), F.col("detect_seconds_total")), "rows_per_s_window": rate(F.col("rows"),
        F.col("window_seconds_total"))})


def benchmark(spark: SparkSession, timers: Timers, flows: int, stream_flows: int) -> DataFrame:
    """name, rows, seconds, flows_per_s: inference, end to end, qualification, and the core of the pipeline (the sum of its stages)."""
    s = timers.seconds
    rows = [
        ("inference", stream_flows, s.get("stream_inference", 0.0)), ("end_to_end", flows, s.get("wall_clock_total", 0.0)),
        ("qualification", timers.rows.get("qualification_total", 0), s.get("qualification_total", 0.0)), ("pipeline_core", flows, sum(s.get(k,
            0.0) for k in CORE)),
    ]
    df = spark.createDataFrame(rows, "name string, rows long, seconds double")
    return df.withColumn("flows_per_s", F.when(F.col("rows") > 0, rate(F.col("rows"), F.col("seconds"))))


def write_report(table: DataFrame, title: str, path: str) -> None:
    """A small table (a row for each stage) as a Markdown report."""
    cell = lambda v: "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    rows = [f"| {' | '.join(cell(v) for v in r)} |" for r in table.collect()]
    write_text(table.sparkSession, [f"# {title}", "", f"| {' | '.join(table.columns)} |", "|" + "---|" * len(table.columns), *rows], path)
