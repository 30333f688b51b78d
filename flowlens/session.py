"""Session settings used by the tests and the bench; on a cluster the caller's own session is used as it is."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[8]", shuffle_partitions: int = 8, driver_memory: str = "8g") -> SparkSession:
    """A local session: UTC, adaptive execution, ANSI arithmetic as Spark 4 has it by default."""
    return (
        SparkSession.builder.master(master)
        .appName("flowlens")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; a local session without it gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="flowlens-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


#: Lets Spark delete an execution's shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def keep(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: worked out once, its lineage ends, a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*kept: DataFrame) -> None:
    """Deletes tables of keep() that nothing reads any more."""
    for df in kept:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def ship_package(spark: SparkSession) -> None:
    """Sends this package's source to the executors, once for each application, so their Python workers can import it
    wherever the driver runs."""
    sc, home = spark.sparkContext, Path(__file__).resolve().parent
    files = sorted(home.rglob("*.py"))
    name = "flowlens-" + hashlib.sha256(b"".join(str(f).encode() + f.read_bytes() for f in files)).hexdigest()[:12] + ".zip"
    if any(x.endswith(name) for x in sc.listFiles):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="flowlens-"), name)
    with zipfile.ZipFile(path, "w") as z:
        for f in files:
            z.write(f, f.relative_to(home.parent))
    sc.addPyFile(path)
