"""Structured Streaming ingest of new session logs: redaction as records arrive, episodes when a trace is complete.

Redaction is stateless and runs on the stream. Episodes need a trace's messages together: each micro-batch analyses the
traces that its messages belong to, from the redacted messages stored so far.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracewright.operators.episodes import episodes
from tracewright.operators.redaction import redact

#: Parts of the store.
BUCKETS = 64

SCHEMA = "trace_id string, msg_index long, role string, text string, timestamp string, source string"


def arriving(spark: SparkSession, path: str, files_a_batch: int = 1000) -> DataFrame:
    """Messages as JSON lines under a folder, as a stream."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_a_batch).json(path)


def late_counts(messages: DataFrame, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Redactions by window of the messages' own time; messages later than `delay` are left out."""
    timed = redact(messages).withColumn("at", F.to_timestamp("timestamp")).withWatermark("at", delay)
    return timed.groupBy(F.window("at", width)).agg(F.count("*").alias("n_messages"), F.sum("redaction_count").alias("redaction_count"))


def ingest(messages: DataFrame, store: str, out: str, checkpoint: str, once: bool = True, buckets: int = BUCKETS) -> StreamingQuery:
    """Store redacted messages under `store`, and under `out`, for each batch, the episodes of the traces that it touched (a later batch replaces a trace's earlier episodes).

    The store is parted by a hash of the trace, so a batch reads only the parts of the traces that it touches. A message that comes again counts as the newest batch has it.
    """
    overwrite = lambda df, path, *parts: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)

    def take(batch: DataFrame, number: int) -> None:
        spark, bucket = batch.sparkSession, F.pmod(F.xxhash64("trace_id"), F.lit(buckets)).cast("int")
        redacted = redact(batch).drop("redactions").withColumns({"bucket": bucket, "batch": F.lit(number)})
        overwrite(redacted.repartition("bucket"), store, "bucket", "batch")
        held = spark.read.parquet(store)
        own = held.where(F.col("batch") == number)
        parts = [r["bucket"] for r in own.select("bucket").distinct().collect()]  # `buckets` at most
        touched = own.select("trace_id").distinct()
        known = held.where(F.col("bucket").isin(parts) & (F.col("batch") <= number)).join(touched, "trace_id", "left_semi")
        rest = [c for c in known.columns if c not in ("trace_id", "msg_index", "bucket", "batch")]
        newest = known.groupBy("trace_id", "msg_index").agg(F.max_by(F.struct(*rest), F.struct("batch", "text")).alias("m")).select("trace_id", "msg_index", "m.*")
        overwrite(episodes(newest).withColumn("batch", F.lit(number)), out, "batch")

    writer = messages.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest(spark: SparkSession, out: str) -> DataFrame:
    """The newest episodes of each trace."""
    all_of = spark.read.parquet(out)
    newest = all_of.groupBy("trace_id").agg(F.max("batch").alias("batch"))
    return all_of.join(newest, ["trace_id", "batch"], "left_semi")
