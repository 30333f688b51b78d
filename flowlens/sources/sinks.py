"""Where results go: tables as Parquet and CSV, nested documents as JSON lines, tables that grow, small text reports."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = logging.getLogger("flowlens")


def start_log(level: int = logging.INFO, path: str | None = None) -> logging.Logger:
    """Messages of the driver, to the error stream and, if named, to a file."""
    form = logging.Formatter("flowlens %(levelname)s (%(relativeCreated).0f ms): %(message)s")
    for handler in [logging.StreamHandler(), *([logging.FileHandler(path)] if path else [])]:
        handler.setFormatter(form)
        LOG.addHandler(handler)
    LOG.setLevel(level)
    return LOG


def flat(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text, which CSV can hold."""
    nested = {c: F.to_json(F.col(f"`{c}`")).alias(c) for c, kind in df.dtypes if kind.split("<")[0] in ("array", "map", "struct")}
    return df.select(*[nested.get(c, F.col(f"`{c}`")) for c in df.columns])


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet, for reading again."""
    df.write.mode(mode).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header in each file; nulls are empty."""
    flat(df).write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A JSON document on each line; nulls are written."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def append(df: DataFrame, path: str) -> None:
    """Adds rows to a CSV table; its columns must be those of the table, in any order."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(hadoop):
        names = spark.read.option("header", True).csv(path).columns
        if sorted(names) != sorted(df.columns):
            raise ValueError(f"columns {df.columns} aren't those of the table, {names}")
        df = df.select(*[f"`{c}`" for c in names])
    write_csv(df, path, "append")


def write_text(spark: SparkSession, lines: list[str], path: str) -> None:
    """A small report of the driver's, as one text file in the folder."""
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_run(spark: SparkSession, root: str, tables: dict[str, DataFrame], summary: dict[str, object]) -> list[str]:
    """A run's folder: each table as Parquet and CSV under its name, and run_summary with `name: value` lines. Gives the names."""
    for name, df in tables.items():
        write_table(df, f"{root}/{name}.parquet")
        write_csv(spark.read.parquet(f"{root}/{name}.parquet"), f"{root}/{name}.csv")
        LOG.info("wrote %s", name)
    write_text(spark, [f"{k}: {v}" for k, v in summary.items()], f"{root}/run_summary")
    return [*tables, "run_summary"]
