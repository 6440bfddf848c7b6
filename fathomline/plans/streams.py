"""Streaming queries; a batch statement gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.plans.ordered import ALLOWED
from fathomline.plans.registry import ORACLES, query
from fathomline.streaming import statelog


@query(ORACLES["state_transitions"])
def stream_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State transitions over a stream, with keyed state."""
    found, where = statelog.bad_steps(statelog.events(spark, f"{sf_dir}/events.parque[t]"), ALLOWED), statelog.folder(spark)
    return statelog.run(found, where).drop("batch").unionByName(statelog.waiting_steps(spark, where, ALLOWED))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts over a stream with a watermark; the last update of each window."""
    counts = statelog.run(statelog.hourly(statelog.events(spark, f"{sf_dir}/events.parque[t]")), statelog.folder(spark), "update")
    last = counts.groupBy("hour", "event_type").agg(F.max_by("n", "batch").alias("n"))
    return last.withColumn("hour", F.col("hour").cast("timestamp_ntz"))
