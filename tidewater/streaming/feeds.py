"""Reports that are kept fresh: streaming counterparts of polling, sessions, accumulators and notifications.

Each takes and returns a streaming DataFrame; triggers, sinks and checkpoints are the caller's. Event columns: series,
kind, ts (timestamp), value (double), event_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, series long, kind string, ts timestamp, value double"


def landed(spark: SparkSession, folder: str, schema: str = EVENTS, files: int = 100) -> DataFrame:
    """Files as they land in a folder, so many per trigger: what polling an interface every few seconds becomes."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def bucketed(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums per kind and tumbling bucket; events later than `late` no longer count."""
    by = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("bucket"), "kind")
    return by.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("bucket.start").alias("start"), "kind", "n", "total")


def sliding(events: DataFrame, width: str = "24 hours", step: str = "1 hour", late: str = "1 hour") -> DataFrame:
    by = events.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("bucket"), "series")
    return by.agg(F.sum("value").alias("total")).select(F.col("bucket.end").alias("end"), "series", "total")


def sessions(events: DataFrame, idle: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Gains per session: the last value less the first."""
    by = events.withWatermark("ts", late).groupBy("series", F.session_window("ts", idle).alias("s"))
    gain = F.max_by("value", "ts") - F.min_by("value", "ts")
    return by.agg(F.count(F.lit(1)).alias("n"), gain.alias("gain")).select("series", F.col("s.start").alias("opened"), F.col("s.end").alias("closed"), "n", "gain")


def notifications(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event id once, forgotten after the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def accumulate_step(millis: int):
    """The state of a series is (time, rate, total); each row adds rate times the time it held."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        at, rate, total = state.get if state.exists else (rows["ts"].iloc[0].timestamp(), 0.0, 0.0)
        for ts, value in zip(rows["ts"], rows["value"]):
            now = max(at, ts.timestamp())
            total += rate * (now - at)
            at, rate = now, float(value)
        state.update((at, rate, total))
        state.setTimeoutTimestamp(max(int(at * 1000) + millis, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"series": [key[0]], "ts": [rows["ts"].iloc[-1]], "total": [total]})

    return step


def accumulated(rates: DataFrame, keep: str = "24 hours", late: str = "1 hour") -> DataFrame:
    """series, ts, total: each series' rate (value a second) times the time it held, summed up. Rows of a series must
    come in order of time from one batch to the next; a series that is silent for `keep` (by the times of the events,
    so that a feed that ends can be run to its end) is forgotten."""
    step = accumulate_step(int(pd.Timedelta(keep).total_seconds() * 1000))
    by = rates.withWatermark("ts", late).groupBy("series")
    return by.applyInPandasWithState(step, "series long, ts timestamp, total double", "at double, rate double, total double", "update", GroupStateTimeout.EventTimeTimeout)


def cooldown_step(seconds: float):
    """The state of a series and kind is the time of the last message shown; it goes when the cooldown is over."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else float("-inf")
        shown = []
        for ts in pd.concat(list(batches))["ts"].sort_values():
            if ts.timestamp() - last >= seconds:
                last = ts.timestamp()
                shown.append(ts)
        state.update((last,))
        state.setTimeoutTimestamp(max(int((last + seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"series": [key[0]] * len(shown), "kind": [key[1]] * len(shown), "ts": shown})

    return step


def cooled(messages: DataFrame, seconds: float = 300.0, late: str = "1 hour") -> DataFrame:
    """series, kind, ts of messages that aren't repeated: of each series and kind, one per `seconds` of event time. A
    key whose cooldown is over by the watermark is forgotten, so the state holds no more than what is cooling down;
    messages that come later than `late` are dropped by the watermark."""
    by = messages.withWatermark("ts", late).groupBy("series", "kind")
    return by.applyInPandasWithState(cooldown_step(seconds), "series long, kind string, ts timestamp", "last double", "append", GroupStateTimeout.EventTimeTimeout)
