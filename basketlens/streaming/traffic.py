"""Daily traffic from an event stream (the daily export, incrementally).

The batch source ``sources.tables.daily_traffic`` counts distinct users per
day over a stored event table.  Here the same table is kept up to date from
a stream of events with Structured Streaming: each (day, user) pair is kept
once (deduplication state bounded by the watermark), then counted per day
window.  In ``append`` mode a day is emitted once, final, when the
watermark has passed its end; in ``update`` mode counts are re-emitted as
they grow.  Checkpointed state makes the query restartable after executor
or driver loss.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_traffic_stream(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Streaming ``(day, users)`` from a streaming frame with ``ts, user_id``.

    Events later than ``lateness`` behind the newest event are dropped.  The
    deduplication key is (day window, user); the window carries the event
    time, so a key's state is dropped once the watermark passes the end of
    its day: state holds at most the users of the open days.
    """
    zone = events.sparkSession.conf.get("spark.sql.session.timeZone")
    day_window = F.window("ts", "1 day")
    keyed = (
        events.where(F.col("user_id").isNotNull())
        # Watermarks need a zoned timestamp.  The stored wall-clock time is
        # read as UTC, so one-day windows (aligned to UTC) are the stored
        # calendar days whatever the session zone (identity in UTC).
        .withColumn("ts", F.from_utc_timestamp(F.col("ts").cast("timestamp"), zone))
        .withWatermark("ts", lateness)
        .select(day_window.alias("w"), "user_id", "ts")
    )
    firsts = keyed.dropDuplicates(["w", "user_id"])
    return (
        firsts.groupBy("w")
        .agg(F.count(F.lit(1)).alias("users"))
        .select(F.to_utc_timestamp(F.col("w.start"), zone).cast("date").alias("day"), "users")
    )


def start_daily_traffic(
    events: DataFrame,
    sink_path: str,
    checkpoint_path: str | None = None,
    lateness: str = "1 day",
    trigger_available_now: bool = False,
):
    """Run :func:`daily_traffic_stream` into a Parquet table (append mode:
    one final row per day).  Returns the ``StreamingQuery``.

    The checkpoint (offsets and state) defaults to a folder under the
    shared ``spark.checkpoint.dir``, so a restarted query resumes where it
    stopped, on any machine.  Without that setting the path must be given: a
    restarted query would not find the state in a scratch folder.

    The days still open under the watermark are not in the table yet, and
    events later than ``lateness`` are not counted; Spark counts those in
    ``StreamingQuery.lastProgress`` (``numRowsDroppedByWatermark``).
    """
    if checkpoint_path is None:
        shared = events.sparkSession.sparkContext.getConf().get("spark.checkpoint.dir", None)
        if not shared:
            raise ValueError("give checkpoint_path or set spark.checkpoint.dir to a shared folder")
        checkpoint_path = f"{shared.rstrip('/')}/streams/daily_traffic"
    writer = (
        daily_traffic_stream(events, lateness)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", sink_path)
        .option("checkpointLocation", checkpoint_path)
    )
    if trigger_available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
