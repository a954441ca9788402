"""Writers: tables replaced only by checked ones, reports, and the row of facts about a build."""

from __future__ import annotations

from collections.abc import Callable

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession, Window


def surrogate(df: DataFrame, key: list[str], out: str) -> DataFrame:
    """An id that depends on the natural key alone, whatever the partitioning."""
    return df.withColumn(out, F.xxhash64(*key))


def first_by_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row a key, the first in order: insert-or-ignore."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def insert_missing(target: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``target`` and the rows of ``new`` whose keys it lacks."""
    return target.unionByName(new.join(target, key, "left_anti"), allowMissingColumns=True)


def _put_in_place(spark: SparkSession, made: str, path: str) -> None:
    """``made`` becomes ``path``. What stood there is set aside first and comes back if its successor cannot take its place; what an earlier run left aside is looked to before anything else."""
    jvm = spark._jvm
    new, old, aside = (jvm.org.apache.hadoop.fs.Path(p) for p in (made, path, path + ".old"))
    fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(aside):
        if fs.exists(old):
            fs.delete(aside, True)
        else:
            fs.rename(aside, old)
    had = fs.exists(old)
    if had and not fs.rename(old, aside):
        raise OSError(f"could not set {path} aside")
    try:
        done = fs.rename(new, old)
    except Exception:
        done = False
    if not done:
        if had:
            fs.rename(aside, old)
        raise OSError(f"could not put {made} in place; {path} is as it was")
    if had:
        fs.delete(aside, True)


def replace_checked(df: DataFrame, path: str, checks: list[Callable[[DataFrame], str | None]] = ()) -> int:
    """Write beside ``path``, look at what was written, and only then put it in place; an empty build or a failed check leaves the old one."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(path + ".new")
    made = spark.read.parquet(path + ".new")
    rows = made.count()
    if not rows:
        raise ValueError("refusing an empty build")
    for check in checks:
        fault = check(made)
        if fault:
            raise ValueError(fault)
    _put_in_place(spark, path + ".new", path)
    return rows


def no_duplicates(key: list[str]) -> Callable[[DataFrame], str | None]:
    return lambda df: "keys repeat" if df.groupBy(*key).count().where("count > 1").take(1) else None


def references(column: str, other: DataFrame, key: str) -> Callable[[DataFrame], str | None]:
    """Every value of ``column`` exists as ``key`` of the other table."""
    there = other.select(F.col(key).alias("__there"))
    return lambda df: f"{column} dangles" if df.where(F.col(column).isNotNull()).join(there, F.col(column) == F.col("__there"), "left_anti").take(1) else None


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def build_meta(spark: SparkSession, **facts: str) -> DataFrame:
    return spark.createDataFrame([tuple(map(str, facts.values()))], ", ".join(f"{k} string" for k in facts)).withColumn("built_at", F.current_timestamp())
