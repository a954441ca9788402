import pyspark.sql.functions as F

from stemline.operators import shares
from stemline.streaming import shares as streamed


def test_stream_gives_the_totals_of_the_batch(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the table", "2024-01-02 00:00:00"), (2, "justice", "2024-03-05 00:00:00"), (3, "the", None)], "doc_id int, text string, published_at string")
    docs = docs.withColumn("published_at", F.col("published_at").cast("timestamp_ntz"))
    docs.repartition(2).write.parquet(str(tmp_path / "in"))
    lex = spark.createDataFrame([("table", "French"), ("the", "Germanic")], "form string, bucket string")
    d = streamed.read_documents(spark, str(tmp_path / "in"), docs.schema)
    q = streamed.write_votes(streamed.votes(d, lex), str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination()
    got = {r.bucket: r.votes for r in streamed.current_votes(spark, str(tmp_path / "out")).groupBy("bucket").agg(F.sum("votes").alias("votes")).collect()}
    batch = shares.shares(shares.resolved_tokens(shares.token_counts(docs.where("published_at IS NOT NULL"), []), lex), [])
    assert got == {r.bucket: r.votes for r in batch.collect()}
