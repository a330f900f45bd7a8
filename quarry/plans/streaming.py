"""Queries that run as streams over the events there are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.operators.lineage import shared
from quarry.plans import ranking, review
from quarry.registry import ORACLE_SQL, query
from quarry.sources import concepts as c
from quarry.streaming import events as op

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@query(ORACLE_SQL[ranking.hourly_throughput.__name__])
def stream_hourly_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly throughput, computed as a stream with a watermark."""
    return op.drain(op.hourly(op.read(spark, f"{sf_dir}/events.parque[t]", SCHEMA)), shared(spark), "complete")


@query(ORACLE_SQL[review.review_vote_ledger.__name__])
def stream_vote_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vote ledger over last events that a stream keeps."""
    rows = op.read(spark, f"{sf_dir}/events.parque[t]", SCHEMA)
    return op.ledger(op.drain(op.latest(c.as_reviews(rows)), shared(spark), "complete"))
