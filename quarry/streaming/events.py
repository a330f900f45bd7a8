"""Structured Streaming forms of batch operators; batch and stream give equal results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import review


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of the files of a folder, or of one file."""
    return spark.readStream.schema(schema).parquet(path)


def hourly(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Jobs and failures by hour of event time (ts); an hour closes when the watermark passes its end."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = timed.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("jobs"), F.count_if(F.col("event_type") == "error").alias("failed"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "jobs", "failed", F.round(F.col("failed") / F.col("jobs"), 6).alias("failure_rate"))


def latest(events: DataFrame) -> DataFrame:
    """Last review event of each subject so far: a running maximum, so state is one row for each subject."""
    order = F.struct("review_rev", F.col("created_at").isNotNull().alias("timed"), "created_at", "event_id")
    return events.groupBy("subject").agg(F.max_by(F.struct("event_id", "effect", "weight_keys", "review_rev", "created_at"), order).alias("last")).select("subject", "last.*")


def drain(stream: DataFrame, folder: str, mode: str) -> DataFrame:
    """Run a stream over what is there now and return its table.

    Each batch is written under its own number, so that a batch that is run again replaces itself. In complete mode
    the last batch is the table; in append mode all are.
    """
    spark = stream.sparkSession
    at = f"{folder}/stream-{uuid.uuid4().hex}"
    numbers: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/batch={number}")
        numbers.append(number)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}-state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    paths = [f"{at}/batch={n}" for n in (numbers[-1:] if mode == "complete" else sorted(set(numbers)))]
    return spark.read.parquet(*paths) if paths else spark.createDataFrame([], stream.schema)


def ledger(last: DataFrame) -> DataFrame:
    """Weights from a table of last events."""
    return review.ledger(last, "subject")


def outbox(events: DataFrame, now: str, retries: int = 5) -> DataFrame:
    """Outbox rows (event_id, attempts, last_try, acked): what to send now, waiting 2^attempts seconds after a failure."""
    due = F.col("last_try").isNull() | (F.timestamp_seconds(F.unix_timestamp("last_try") + F.pow(F.lit(2.0), F.col("attempts")).cast("long")) <= F.lit(now).cast("timestamp"))
    state = F.when(F.col("acked"), "done").when(F.col("attempts") >= retries, "dead").when(due, "send").otherwise("wait")
    return events.withColumn("state", state)
