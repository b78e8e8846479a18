"""The request-log operators on a stream.

Windows close once the watermark passes them; append mode emits a window then,
and only then. Lateness is a setting of this library (default 10 minutes).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from catalith import fixed
from catalith.operators import traffic

LATENESS = "10 minutes"
# Groups of users that are judged together: one call of Python per group and window, not per user.
USER_GROUPS = 512


def stream_events(
    spark: SparkSession, path: str, schema, glob: str | None = None, per_trigger: int | None = None
) -> DataFrame:
    """A stream over the Parquet files of a folder, as they arrive."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path)


def watermarked(requests: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """A watermark needs a zoned timestamp; the event table has none."""
    return requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)


def request_rate(
    requests: DataFrame,
    window: str = fixed.RATE_WINDOW,
    slide: str = "1 minute",
    lateness: str = LATENESS,
) -> DataFrame:
    return traffic.request_rate(watermarked(requests, lateness), window, slide)


def error_rate(
    requests: DataFrame,
    window: str = fixed.RATE_WINDOW,
    slide: str = "1 minute",
    lateness: str = LATENESS,
) -> DataFrame:
    return traffic.error_rate(watermarked(requests, lateness), window, slide)


def latency_quantiles(
    requests: DataFrame,
    window: str = fixed.RATE_WINDOW,
    slide: str | None = None,
    by=(),
    lateness: str = LATENESS,
) -> DataFrame:
    return traffic.latency_quantiles(watermarked(requests, lateness), window, slide, by)


def latency_sketches(
    requests: DataFrame,
    pane: str = "1 minute",
    by: Sequence[str] = ("tool",),
    lateness: str = LATENESS,
) -> DataFrame:
    """Sketches of closed panes, to be stored and merged to any longer window later."""
    return traffic.latency_sketches(watermarked(requests, lateness), pane, by)


def quota_counts(
    requests: DataFrame,
    limit: int = fixed.QUOTA_PER_MINUTE,
    window: str = "1 minute",
    lateness: str = LATENESS,
) -> DataFrame:
    return traffic.quota_counts(watermarked(requests, lateness), limit, window)


def quota_rejections(
    requests: DataFrame,
    limit: int = fixed.QUOTA_PER_MINUTE,
    window: str = "1 minute",
    lateness: str = LATENESS,
) -> DataFrame:
    """The requests beyond the first ``limit`` of their user's window, as they arrive.

    The answer does not wait for the window to close: of a micro-batch, the first by time and id are
    let through while there is room. A request that arrives in a later micro-batch than one after it
    is judged when it comes. The state of a user's window is one number, which goes when the
    watermark passes the window's end; requests later than that are not answered. Users are
    judged in ``USER_GROUPS`` groups per window. However many requests a window has, a task
    holds ``limit`` of each user of a group and one Arrow batch.
    """
    given = requests.schema
    columns = ["request_id", "user_id", "ts"]
    opened = F.window("ts", window)
    # As text that is never null, so that no id is rounded where others are missing.
    user = F.coalesce(F.concat(F.lit("="), F.col("user_id").cast("string")), F.lit(""))
    placed = watermarked(requests, lateness).select(
        "request_id",
        "ts",
        user.alias("_user"),
        F.pmod(F.xxhash64("user_id"), F.lit(USER_GROUPS)).alias("_group"),
        F.unix_micros("ts").alias("_at"),
        F.unix_micros(opened["start"]).alias("_start"),
        F.unix_micros(opened["end"]).alias("_end"),
    )

    def judge(
        key: tuple, parts: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        admitted = dict(zip(*state.get)) if state.exists else {}
        end = 0
        waiting: pd.DataFrame | None = None
        for part in parts:
            end = int(part["_end"].iloc[0]) // 1000
            if end <= state.getCurrentWatermarkMs():
                continue  # the window is closed
            some = part if waiting is None else pd.concat([waiting, part])
            some = some.sort_values(["_at", "request_id"])
            place = some.groupby("_user", sort=False).cumcount()
            passes = place < limit - some["_user"].map(admitted).fillna(0)
            waiting = some[passes]
            refused = some[~passes]
            if len(refused):
                yield refused[["request_id", "_user", "_at", "_start"]]
        if waiting is not None:
            for name, count in waiting["_user"].value_counts().items():
                admitted[name] = admitted.get(name, 0) + int(count)
            state.update((list(admitted), list(admitted.values())))
            state.setTimeoutTimestamp(end)

    kinds = {name: given[name].dataType.simpleString() for name in columns}
    refused = placed.groupBy("_group", "_start").applyInPandasWithState(
        judge,
        f"request_id {kinds['request_id']}, _user string, _at long, _start long",
        "users array<string>, admitted array<int>",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
    times = {"ts": "_at", "window_start": "_start"}
    return refused.select(
        "request_id",
        F.when(F.col("_user") != "", F.substring("_user", 2, 2**31 - 1)).cast(kinds["user_id"]).alias("user_id"),
        *(F.timestamp_micros(micros).cast(kinds["ts"]).alias(name) for name, micros in times.items()),
    )


def _on_periods(
    requests: DataFrame,
    period: str,
    evaluated: int,
    needed: int,
    alarms: Sequence[tuple[str, str, float]],
    lateness: str,
) -> DataFrame:
    measured = watermarked(requests, lateness).groupBy(F.window("ts", period).alias("_period"))
    measured = measured.agg(*traffic.measures()).withColumn("ts", F.window_time("_period"))
    seconds = traffic.seconds_in(period)
    # A period in breach lies in the windows of the periods that look back on it, with requests or without.
    looking_back = F.window("ts", f"{evaluated * seconds} seconds", f"{seconds} seconds")
    return (
        traffic.breaches(measured, "ts", alarms)
        .groupBy("alarm", looking_back.alias("_window"))
        .agg(F.count(F.lit(1)).alias("breaches"))
        .where(F.col("breaches") >= needed)
    )


def alerts(
    requests: DataFrame,
    period: str = "1 minute",
    evaluated: int = 5,
    needed: int = 3,
    alarms: Sequence[tuple[str, str, float]] = traffic.ALARMS,
    lateness: str = LATENESS,
) -> DataFrame:
    """``alarm, period_start, breaches`` of each period that an alarm is on, once it is closed.

    Two windows in a row: periods are measured, and windows of ``evaluated`` periods count
    those in breach. Both close by the one watermark.
    """
    length = F.make_dt_interval(secs=F.lit(traffic.seconds_in(period)))
    on = _on_periods(requests, period, evaluated, needed, alarms, lateness)
    return on.select("alarm", (F.col("_window.end") - length).alias("period_start"), "breaches")


def alarm_changes(
    requests: DataFrame,
    period: str = "1 minute",
    evaluated: int = 5,
    needed: int = 3,
    alarms: Sequence[tuple[str, str, float]] = traffic.ALARMS,
    lateness: str = LATENESS,
) -> DataFrame:
    """``alarm, at, state``: an alarm goes on, or off, once the period that says so is closed.

    A third window looks at two periods, so what is kept is still a number per alarm and window.
    """
    on = _on_periods(requests, period, evaluated, needed, alarms, lateness)
    return traffic.changes(on.withColumn("ts", F.window_time("_window")), "ts", period)


def run_available(df: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there, append closed windows to ``path``, and stop."""
    (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
