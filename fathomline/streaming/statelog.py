"""State over streams of events: transition checks with keyed state, and windowed counts with a watermark.

Both run over whatever has arrived (``availableNow``) and keep their progress and output below one folder, so a later
run goes on where the last one ended.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fathomline.functions.storage import shared_root

#: State of a user: the last compared type, and the rows that wait, as JSON.
HELD = "last string, held string"
STEPS = "event_id bigint, user_id bigint, before string, event_type string"


def folder(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"


def events(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the event files at ``path`` (a file, a folder or a pattern)."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(path)


def bad_steps(stream: DataFrame, allowed: dict[str, list[str]], late: str = "2 hours") -> DataFrame:
    """Steps that the table of allowed ones lacks, in the order of (ts, event_id) in whatever order files arrive.

    A user's rows wait as keyed state until the watermark, ``late`` behind the newest row of all, has passed them; then they
    are compared in order and the last type is kept. What still waits when the input ends is compared by ``waiting_steps``.
    Rows that come later than the watermark are left out, as in every stream with one (Spark counts them in its progress),
    and so are rows without a user or a time.
    """

    def check(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, held = state.get if state.exists else (None, "[]")
        rows = [tuple(x) for x in json.loads(held)]
        for part in parts if not state.hasTimedOut else ():  # without rows only the watermark has moved
            rows += zip(*(part[c].tolist() for c in ("micros", "event_id", "event_type")), strict=True)
        border = state.getCurrentWatermarkMs() * 1000
        rows.sort()
        ready = [r for r in rows if r[0] <= border]
        rest = rows[len(ready) :]
        out = _compared(key[0], last, ready, allowed)
        state.update((ready[-1][2] if ready else last, json.dumps(rest)))
        if rest:
            state.setTimeoutTimestamp(max(rest[0][0] // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["event_id", "user_id", "before", "event_type"])

    stamped = stream.select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts")).filter("user_id IS NOT NULL AND ts IS NOT NULL").withColumn("micros", F.unix_micros("ts")).withWatermark("ts", late)
    return stamped.groupBy("user_id").applyInPandasWithState(check, STEPS, HELD, "append", GroupStateTimeout.EventTimeTimeout)


def _compared(user: int, last: str | None, rows: list[tuple], allowed: dict[str, list[str]]) -> list[tuple]:
    kinds = [r[2] for r in rows]
    return [(event_id, user, old, new) for (_, event_id, _), old, new in zip(rows, [last, *kinds[:-1]], kinds, strict=False) if old is not None and new not in allowed.get(old, ())]


def waiting_steps(spark: SparkSession, where: str, allowed: dict[str, list[str]]) -> DataFrame:
    """What ``bad_steps`` would find among the rows that still wait in the state below ``where``, once the input has ended. The state stays."""
    held = spark.read.format("statestore").load(f"{where}/progress").select("key.user_id", "value.*")
    inner = held if "held" in held.columns else held.select("user_id", f"{held.columns[1]}.*")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [x for user, last, rows in zip(batch["user_id"].tolist(), batch["last"].tolist(), batch["held"].tolist(), strict=True) for x in _compared(user, last, sorted(tuple(r) for r in json.loads(rows or "[]")), allowed)]
            yield pd.DataFrame(out, columns=["event_id", "user_id", "before", "event_type"])

    return inner.select("user_id", "last", "held").mapInPandas(check, STEPS)


def hourly(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    """Counts by hour and type; rows later than ``late`` behind the newest are left out."""
    stamped = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return stamped.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")


def run(stream: DataFrame, where: str, mode: str = "append") -> DataFrame:
    """Process what has arrived; in update mode the newest row of each micro-batch number wins (column ``batch``)."""
    spark = stream.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{where}/out/number={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{where}/progress").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.parquet(f"{where}/out").drop("number")
