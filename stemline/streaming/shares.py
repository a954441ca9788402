"""Origin shares of a stream of documents: the vote is a sum, so its windows are kept up by built-in state alone.

An addition of this engine: the batch form is ``operators.shares``.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from stemline.functions import text


def votes(documents: DataFrame, lexicon: DataFrame, time_col: str = "published_at", late: str = "30 days", size: str = "30 days") -> DataFrame:
    """``start, bucket, votes`` by windows of publication; windows further than ``late`` behind the newest document are closed, and what comes for them later is dropped.

    ``lexicon`` (one row a ``form``) is a static side; its tokens are joined before the aggregation.
    """
    d = documents.where(F.col(time_col).isNotNull()).withColumn("at", F.col(time_col).cast("timestamp")).withWatermark("at", late)
    t = d.select("at", F.explode(text.tokens(F.col("text"))).alias("token"))
    r = t.join(lexicon, t["token"] == lexicon["form"], "left").withColumn("bucket", F.coalesce("bucket", F.lit("Unknown")))
    return r.groupBy(F.window("at", size).alias("w"), "bucket").agg(F.count(F.lit(1)).alias("votes")).select(F.col("w.start").alias("start"), "bucket", "votes")


def read_documents(spark: SparkSession, path: str, schema) -> DataFrame:
    """Parquet files as they arrive."""
    return spark.readStream.schema(schema).parquet(path)


def write_votes(result: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """The windows that a batch of files changed, with their new votes, under ``out/batch=N``.

    A batch that is run again writes the same folder again, so each counts once; windows behind the watermark leave the
    state. ``current_votes`` reads what stands now.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")

    return result.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()


def current_votes(spark: SparkSession, out: str) -> DataFrame:
    """``start, bucket, votes``: of each window and bucket the votes of its latest batch."""
    rows = spark.read.parquet(out)
    return rows.groupBy("start", "bucket").agg(F.max_by("votes", "batch").alias("votes"))
