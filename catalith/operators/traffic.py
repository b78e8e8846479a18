"""Request-log analytics.

A request log has ``request_id, ts, user_id, tool, seconds, failed``. All but the
row-level operators work on batch and streaming frames alike, and hold a fixed
number of counters per group, whatever a group's share of the log.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalith import fixed
from catalith.operators.quantiles import group_quantiles
from catalith.operators.reports import count_where

_COUNTERS = tuple(f"_le{i}" for i in range(len(fixed.LATENCY_BOUNDS)))

#: Tasks over which the requests of one busy window are dealt.
SALTS = 32


def requests_of(events: DataFrame) -> DataFrame:
    """The event table read as a request log: value is milliseconds, error a failure."""
    return events.select(
        F.col("event_id").alias("request_id"),
        "ts",
        "user_id",
        F.col("event_type").alias("tool"),
        (F.col("value") / 1000).alias("seconds"),
        (F.col("event_type") == "error").alias("failed"),
    )


def seconds_in(length: str) -> int:
    """Seconds of a window length such as ``5 minutes``."""
    count, unit = length.split()
    sizes = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}
    return int(count) * sizes[unit.rstrip("s")]


def measures() -> list[Column]:
    """Everything the windows report, as sums of counters."""
    return [
        F.count(F.lit(1)).alias("requests"),
        count_where(F.col("failed")).alias("errors"),
        *[
            count_where(F.col("seconds") <= bound).alias(name)
            for name, bound in zip(_COUNTERS, fixed.LATENCY_BOUNDS)
        ],
    ]


def window_measures(
    requests: DataFrame,
    window: str = fixed.RATE_WINDOW,
    slide: str | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """``window_start, *by`` and the counters of every window.

    A batch with sliding windows is first summed to panes as long as the slide.
    So a request is shuffled as part of one pane, not once per window it is in.
    """
    slide = slide or window
    panes = requests
    counters = measures()
    if not requests.isStreaming and slide != window and not seconds_in(window) % seconds_in(slide):
        panes = (
            requests.groupBy(F.window("ts", slide).alias("_pane"), *by)
            .agg(*counters)
            .withColumn("ts", F.col("_pane.start"))
        )
        names = ("requests", "errors", *_COUNTERS)
        counters = [F.sum(name).alias(name) for name in names]
    return (
        panes.groupBy(F.window("ts", window, slide).alias("_window"), *by)
        .agg(*counters)
        .withColumn("window_start", F.col("_window.start"))
        .drop("_window")
    )


def histogram_quantile(p: float) -> Column:
    """Quantile from cumulative counters, linear inside the bucket it falls in.

    Above the last bound the answer is that bound.
    """
    rank = F.col("requests") * F.lit(float(p))
    answer = F
    low, below = 0.0, F.lit(0)
    for name, bound in zip(_COUNTERS, fixed.LATENCY_BOUNDS):
        share = F.try_divide(rank - below, F.col(name) - below)
        inside = F.lit(low) + (F.lit(float(bound)) - F.lit(low)) * share
        answer = answer.when(F.col(name) >= rank, inside)
        low, below = float(bound), F.col(name)
    return answer.otherwise(F.lit(low))


def request_rate(
    requests: DataFrame, window: str = fixed.RATE_WINDOW, slide: str = "1 minute"
) -> DataFrame:
    """Requests per second over the window, at every slide."""
    per_second = F.col("requests") / F.lit(seconds_in(window))
    return window_measures(requests, window, slide).select(
        "window_start", "requests", per_second.alias("per_second")
    )


def error_rate(
    requests: DataFrame, window: str = fixed.RATE_WINDOW, slide: str = "1 minute"
) -> DataFrame:
    """Failed requests per second over the window, at every slide."""
    per_second = F.col("errors") / F.lit(seconds_in(window))
    return window_measures(requests, window, slide).select(
        "window_start", "requests", "errors", per_second.alias("errors_per_second")
    )


def latency_quantiles(
    requests: DataFrame,
    window: str = fixed.RATE_WINDOW,
    slide: str | None = None,
    by: Sequence[str] = (),
    probabilities: Sequence[float] = (0.5, 0.95, 0.99),
) -> DataFrame:
    """Latency quantiles per window, and per group if asked, from the histogram."""
    return window_measures(requests, window, slide, by).select(
        "window_start",
        *by,
        "requests",
        *[histogram_quantile(p).alias(f"p{p * 100:g}") for p in probabilities],
    )


def tool_p95(
    requests: DataFrame, window: str = fixed.RATE_WINDOW, slide: str | None = None
) -> DataFrame:
    return latency_quantiles(requests, window, slide, by=("tool",), probabilities=(0.95,))


def latency_histogram(requests: DataFrame, by: Sequence[str] = ("tool",)) -> DataFrame:
    """``*by, le, n``: requests no slower than each bound; the last one is all."""
    counted = requests.groupBy(*by).agg(*measures())
    labels = [f"{bound:g}" for bound in fixed.LATENCY_BOUNDS] + ["+Inf"]
    columns = [*_COUNTERS, "requests"]
    return counted.select(
        *by,
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(label).alias("le"), F.col(column).alias("n"))
                    for label, column in zip(labels, columns)
                ]
            )
        ),
    )


def exact_quantiles(
    requests: DataFrame,
    by: Sequence[str] = ("tool",),
    probabilities: Sequence[float] = (0.5, 0.95, 0.99),
) -> DataFrame:
    """Latency quantiles from the values themselves."""
    return group_quantiles(requests, by, "seconds", probabilities)


#: Size of a latency sketch: a rank is off by half a percent at most, almost always.
SKETCH_K = 800


def latency_sketches(
    requests: DataFrame, pane: str = "1 minute", by: Sequence[str] = ("tool",), k: int = SKETCH_K
) -> DataFrame:
    """``pane_start, *by, requests, sketch``: quantile sketches (KLL) of short panes, to be stored.

    A sketch has a few kilobytes, however many requests the pane has, and sketches merge.
    """
    return (
        requests.where(F.col("seconds").isNotNull())
        .groupBy(F.window("ts", pane).alias("_pane"), *by)
        .agg(
            F.count(F.lit(1)).alias("requests"),
            F.call_function("kll_sketch_agg_double", F.col("seconds").cast("double"), F.lit(k)).alias("sketch"),
        )
        .select(F.col("_pane.start").alias("pane_start"), *by, "requests", "sketch")
    )


def merged_sketches(
    panes: DataFrame, window: str = "1 day", slide: str | None = None, by: Sequence[str] = ("tool",)
) -> DataFrame:
    """``window_start, *by, requests, sketch`` of longer windows, from panes that they consist of."""
    return (
        panes.groupBy(F.window("pane_start", window, slide or window).alias("_window"), *by)
        .agg(
            F.sum("requests").alias("requests"),
            F.call_function("kll_merge_agg_double", F.col("sketch")).alias("sketch"),
        )
        .select(F.col("_window.start").alias("window_start"), *by, "requests", "sketch")
    )


def sketched_quantiles(merged: DataFrame, probabilities: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """The rows of ``merged_sketches`` with ``p`` and ``quantile`` for the sketch."""
    wanted = F.explode(
        F.array(
            *(
                F.struct(
                    F.lit(float(p)).alias("p"),
                    F.call_function("kll_sketch_get_quantile_double", F.col("sketch"), F.lit(float(p))).alias("quantile"),
                )
                for p in probabilities
            )
        )
    )
    return merged.select("*", wanted.alias("_q")).select(
        *(c for c in merged.columns if c != "sketch"), "_q.p", "_q.quantile"
    )


# Alarm, metric, limit that has to be exceeded.
ALARMS = (
    ("p95_latency", "p95", fixed.P95_LIMIT_SECONDS),
    ("backend_errors", "errors", fixed.BACKEND_ERROR_LIMIT),
    ("balancer_errors", "errors", fixed.BALANCER_ERROR_LIMIT),
)


def breaches(measured: DataFrame, at: str, alarms: Sequence[tuple[str, str, float]]) -> DataFrame:
    """``at, alarm``: the measured periods in breach, once per alarm."""
    over = [
        F.when(F.col(metric) > F.lit(float(limit)), F.lit(name)) for name, metric, limit in alarms
    ]
    return (
        measured.withColumn("p95", histogram_quantile(0.95))
        .select(at, F.explode(F.array(*over)).alias("alarm"))
        .where(F.col("alarm").isNotNull())
    )


def alerts(
    requests: DataFrame,
    period: str = "1 minute",
    evaluated: int = 5,
    needed: int = 3,
    alarms: Sequence[tuple[str, str, float]] = ALARMS,
) -> DataFrame:
    """``alarm, period_start, breaches``: periods at which an alarm is on.

    It is on when ``needed`` of the last ``evaluated`` periods exceed the limit;
    a period without requests does not. Only periods in breach are kept, and each
    counts for itself and the periods after it that still look back on it.
    """
    breaching = breaches(window_measures(requests, period), "window_start", alarms)
    length = F.make_dt_interval(secs=F.lit(seconds_in(period)))
    return (
        breaching.withColumn("_after", F.explode(F.sequence(F.lit(0), F.lit(evaluated - 1))))
        .withColumn("period_start", F.col("window_start") + F.col("_after") * length)
        .groupBy("alarm", "period_start")
        .agg(F.count(F.lit(1)).alias("breaches"))
        .where(F.col("breaches") >= needed)
    )


def changes(on: DataFrame, at: str, period: str) -> DataFrame:
    """``alarm, at, state`` from the periods alarms are on; ``at`` is a time in the period.

    Windows of two periods each: where only the later one is on, the alarm went on, and
    where only the earlier one is, it went off. No alarm's history is gathered.
    """
    seconds = seconds_in(period)
    pair = F.window(at, f"{2 * seconds} seconds", f"{seconds} seconds")
    middle = F.col("_pair.start") + F.make_dt_interval(secs=F.lit(seconds))
    return (
        on.groupBy("alarm", pair.alias("_pair"))
        .agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first"))
        .where(F.col("n") == 1)
        .select(
            "alarm",
            middle.alias("at"),
            F.when(F.col("first") < middle, "off").otherwise("on").alias("state"),
        )
    )


def alarm_changes(on: DataFrame, period: str = "1 minute") -> DataFrame:
    """``alarm, at, state``: when each alarm goes on and off, from the periods of ``alerts``.

    An alarm goes off with the first period after the last one it is on.
    """
    return changes(on, "period_start", period)


def quota_counts(
    requests: DataFrame, limit: int = fixed.QUOTA_PER_MINUTE, window: str = "1 minute"
) -> DataFrame:
    """``user_id, window_start, requests, rejected`` of every window with a rejection."""
    return (
        requests.groupBy("user_id", F.window("ts", window).alias("_window"))
        .agg(F.count(F.lit(1)).alias("requests"))
        .where(F.col("requests") > limit)
        .select(
            "user_id",
            F.col("_window.start").alias("window_start"),
            "requests",
            (F.col("requests") - limit).alias("rejected"),
        )
    )


def quota_rejections(
    requests: DataFrame, limit: int = fixed.QUOTA_PER_MINUTE, window: str = "1 minute"
) -> DataFrame:
    """The requests beyond the first ``limit`` of their user's window.

    The last request that passes is found with a rank limit, of which each task
    sends on at most ``limit`` rows per window; all later ones are rejected. So
    no task sorts a busy window as a whole. The join that finds these deals a window's
    requests out over ``SALTS`` tasks, each of which gets a copy of the one row.
    """
    placed = requests.withColumn("window_start", F.window("ts", window)["start"])
    order = Window.partitionBy("user_id", "window_start").orderBy("ts", "request_id")
    last = (
        placed.select("user_id", "window_start", "ts", "request_id")
        .withColumn("_place", F.row_number().over(order))
        .where(F.col("_place") <= limit)
        .where(F.col("_place") == limit)
        .select(
            "user_id",
            "window_start",
            F.col("ts").alias("_last_ts"),
            F.col("request_id").alias("_last_id"),
            F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias(
                "_salt"
            ),
        )
    )
    salted = placed.withColumn("_salt", F.pmod(F.xxhash64("request_id"), F.lit(SALTS)))
    later = (F.col("ts") > F.col("_last_ts")) | (
        (F.col("ts") == F.col("_last_ts")) & (F.col("request_id") > F.col("_last_id"))
    )
    return (
        salted.join(last, ["user_id", "window_start", "_salt"])
        .where(later)
        .select("request_id", "user_id", "ts", "window_start")
    )


def load_run_summary(requests: DataFrame) -> DataFrame:
    """A load run against its limits: p95, failed share, share of checks passed.

    A request has two checks: it succeeded, and it answered.
    """
    p95 = group_quantiles(requests, [], "seconds", [0.95]).select("quantile").scalar()
    answered = F.col("seconds").isNotNull()
    passed = count_where(~F.col("failed")) + count_where(answered)
    return (
        requests.agg(
            F.count(F.lit(1)).alias("requests"),
            F.avg(F.col("failed").cast("double")).alias("failed_share"),
            (passed / (2 * F.count(F.lit(1)))).alias("checks_share"),
        )
        .withColumn("p95_seconds", p95)
        .withColumns(
            {
                "p95_ok": F.col("p95_seconds") < fixed.P95_LIMIT_SECONDS,
                "failed_ok": F.col("failed_share") < fixed.FAILED_SHARE_LIMIT,
                "checks_ok": F.col("checks_share") > fixed.CHECKS_SHARE_LIMIT,
            }
        )
    )
