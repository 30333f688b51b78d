"""Runs as folders of artifacts: catalog, reading by whitelisted name, key figures, leaderboards.

Listing goes through Spark's file readers, so runs may be in any store that Spark reads.
"""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed: artifact names that may be read by name.
ARTIFACTS = frozenset(
    "metrics.json metric_catalog.json performance_metrics.json run_summary.txt config.yaml dataset_label_distribution.csv "
        "dataset_label_feature_attack_correlation.csv dataset_network_topology.json "
    "learner_count_over_time.csv learner_label_distribution.csv learner_feature_attack_ratio_correlation.csv learner_risk_scores.csv "
        "learner_network_topology.json learner_topology_metric_audit.json "
    "learner_aggregated_distribution.csv debug_true_overlap_pairs.csv learner_train_batch_label_distribution.csv learner_creation_flow_previews.json "
        "sample_learner_assignments.csv".split()
)
_RUN_ID = re.compile(r"^[A-Za-z0-9][A-Za-z0-9_.-]*$")


class RunStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, run: str, artifact: str) -> str:
        """Refuses names that aren't on the list and run ids that could leave the root."""
        if artifact not in ARTIFACTS:
            raise PermissionError(f"{artifact} is no artifact")
        if not _RUN_ID.match(run) or ".." in run:
            raise ValueError(f"{run} is no run id")
        return f"{self.root}/{run}/{artifact}"

    def read(self, run: str, artifact: str) -> DataFrame:
        path = self.path(run, artifact)
        if artifact.endswith(".csv"):
            return self.spark.read.csv(path, header=True, mode="FAILFAST")
        if artifact.endswith(".json"):
            return self.spark.read.json(path, multiLine=True)
        return self.spark.read.text(path, wholetext=True)

    def catalog(self) -> DataFrame:
        """run, started, complete (it has metrics), newest first by the time in its name."""
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*").load(f"{self.root}/*/*").select("path", "length")
        run = files.select(F.split_part("path", F.lit("/"), F.lit(-2)).alias("run"), F.split_part("path", F.lit("/"), F.lit(-1)).alias("file"))
        return run.groupBy("run").agg(F.max((F.col("file") == "metrics.json").cast("int")).cast("boolean").alias("complete")).withColumn("started",
            run_time(F.col("run"))).orderBy(F.col("started").desc_nulls_last(), "run")

    def metrics(self) -> DataFrame:
        """Key figures of all runs that have metrics."""
        df = self.spark.read.json(f"{self.root}/*/metrics.json", multiLine=True).withColumn("run", F.split_part(F.col("_metadata.file_path"),
            F.lit("/"), F.lit(-2)))
        return df


def run_time(run):
    """The time in a run id like 20240131_235959_name, or null."""
    return F.try_to_timestamp(F.concat_ws(" ", F.regexp_extract(run, r"(\d{8})_(\d{6})", 1), F.regexp_extract(run, r"(\d{8})_(\d{6})", 2)),
        F.lit("yyyyMMdd HHmmss"))


def leaderboard(runs: DataFrame, k: int = 10) -> DataFrame:
    """The k best runs by fpr + fnr, with tpr and a place; ties by fnr, then the run."""
    w = Window.orderBy(F.col("fpr") + F.col("fnr"), "fnr", "run")  # a row for each run
    return runs.withColumn("tpr", 1 - F.col("fnr")).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def grid(options: dict[str, list]) -> list[dict]:
    """All combinations of options, the last varying fastest."""
    return [dict(zip(options, values, strict=True)) for values in product(*options.values())]


def load_config(text: str) -> dict:
    """A two-level YAML configuration."""
    import yaml

    found = yaml.safe_load(text) or {}
    if not isinstance(found, dict):
        raise ValueError("a configuration is a mapping")
    return found
