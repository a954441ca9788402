"""Session helpers: tables, the shared folder, and cutting lineage."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "stemline", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark."""
    return importable(
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("STEMLINE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def importable(spark: SparkSession) -> SparkSession:
    """Lets Python workers find this package where the driver was started from another folder; a cluster needs it on a shared path or as a Python file."""
    root, env = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), spark.sparkContext.environment
    there = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in there:
        env["PYTHONPATH"] = os.pathsep.join([*there, root])
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, a local session (tests, one machine) gets a temporary one that goes with its process; a cluster must name one that all its machines share."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="stemline-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        at = "file://" + folder
        spark.sparkContext.setCheckpointDir(at)
    return at


def cleared(spark: SparkSession) -> int:
    """Removes the tables that this process has written to the shared folder, once no query needs them any more; how many they were."""
    n = 0
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        n += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def written(df: DataFrame) -> str:
    """Write ``df`` to a new folder of the shared folder and tell which."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/stemline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and lost executors lose nothing."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df))


def partitions_for(spark: SparkSession, rows: int, per_partition: int) -> int:
    """Enough partitions to hold ``rows`` at ``per_partition`` each, and no fewer than the cluster's cores can use."""
    least = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(1, rows // 1000))
    return max(1, least, -(-rows // per_partition))


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where the files give fewer tasks than there are cores; larger inputs stay as they are read.

    For steps that spend far more on a row than moving it costs.
    """
    if df._jdf.queryExecution().executedPlan().toString().startswith("AdaptiveSparkPlan"):
        return df  # it has a shuffle already, which to ask for its tasks would run
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
