"""Structured Streaming versions of the windowed statistics, over an events stream (ts, user_id, event_type, value).

Each function takes a streaming or a batch DataFrame and gives the same relation. State
is bounded by the watermark; rows later than it are dropped, which is the streaming
form of reading only what lies before the cutoff.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LATE = "2 days"


def _timed(events: DataFrame, late: str) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def last_event(events: DataFrame) -> DataFrame:
    """The running end of the data."""
    return events.agg(F.max("ts").alias("last_ts"), F.count("*").alias("n"))


def weekly_counts(events: DataFrame, late: str = LATE) -> DataFrame:
    """Events per type and tumbling week."""
    return _timed(events, late).groupBy(F.window("ts", "7 days"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("week"), "event_type", "n", "total")


def sliding_popularity(events: DataFrame, span: str = "28 days", step: str = "1 day", half_life_days: float = 7.0, late: str = LATE) -> DataFrame:
    """Half-life weighted popularity per type in sliding windows."""
    age = (F.unix_timestamp(F.col("window.end")) - F.unix_timestamp("ts")) / 86400.0
    spread = _timed(events, late).withColumn("window", F.window("ts", span, step))
    return spread.groupBy("window", "event_type").agg(F.sum(F.pow(F.lit(2.0), -age / half_life_days)).alias("popularity")).select(F.col("window.end").alias("day"), "event_type", "popularity")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    """Sessions of users by gap."""
    return _timed(events, late).groupBy(F.session_window("ts", gap).alias("session"), "user_id").agg(F.count("*").alias("events"), F.sum("value").alias("total")).select("user_id", F.col("session.start").alias("start"), F.col("session.end").alias("end"), "events", "total")


def deduplicated(events: DataFrame, late: str = LATE) -> DataFrame:
    """Events once per id within the watermark."""
    return _timed(events, late).dropDuplicatesWithinWatermark(["event_id"])


def last_items(events: DataFrame, k: int = 5) -> DataFrame:
    """The last k event types of each user as state: one small row a user."""
    import pandas as pd

    def update(key, frames, state):
        kept = list(zip(*state.get, strict=True)) if state.exists else []
        for frame in frames:
            kept += list(zip(frame["ts"].astype("int64").tolist(), frame["event_type"].tolist(), strict=True))
        kept = sorted(set(kept), key=lambda x: (-x[0], x[1]))[:k]
        state.update(([t for t, _ in kept], [x for _, x in kept]))
        yield pd.DataFrame({"user_id": [key[0]], "items": [",".join(x for _, x in kept)]})

    return events.withColumn("ts", F.col("ts").cast("timestamp")).groupBy("user_id").applyInPandasWithState(update, "user_id long, items string", "ts array<long>, items array<string>", "update", "NoTimeout")


def append_scored(stream: DataFrame, score, path: str, checkpoint: str):
    """Resumable batch inference: every micro-batch is scored and appended once; the checkpoint remembers which."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, number: score(batch).withColumn("batch", F.lit(number)).write.mode("append").parquet(path)).start()
