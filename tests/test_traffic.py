from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from catalith import fixed
from catalith.operators import traffic
from catalith.session import scratch_path
from catalith.streaming import traffic as stream
from tests.conftest import rows

START = dt.datetime(2024, 1, 1, 12, 0, 0)
SCHEMA = (
    "request_id bigint, ts timestamp_ntz, user_id bigint, tool string, seconds double, "
    "failed boolean"
)


def log(spark, entries):
    """Entries are (second, user, tool, seconds, failed)."""
    return spark.createDataFrame(
        [
            (i, START + dt.timedelta(seconds=s), user, tool, took, failed)
            for i, (s, user, tool, took, failed) in enumerate(entries)
        ],
        SCHEMA,
    )


def at(minute):
    return START + dt.timedelta(minutes=minute)


def test_rate_over_sliding_windows(spark):
    df = log(spark, [(30, 1, "a", 0.1, False), (90, 1, "a", 0.1, True), (91, 1, "b", 0.1, False)])
    got = {r["window_start"]: r for r in rows(traffic.request_rate(df))}
    assert set(got) == {at(m) for m in range(-4, 2)}
    assert [got[at(m)]["requests"] for m in range(-4, 2)] == [1, 3, 3, 3, 3, 2]
    assert got[at(0)]["per_second"] == pytest.approx(3 / 300)
    errors = {r["window_start"]: r["errors"] for r in rows(traffic.error_rate(df))}
    assert errors[at(1)] == 1 and errors[at(-4)] == 0


def prometheus_quantile(values, p):
    """Rank inside the first bucket that reaches it, written out plainly."""
    rank, below, low = p * len(values), 0, 0.0
    for bound in fixed.LATENCY_BOUNDS:
        upto = sum(v <= bound for v in values)
        if upto >= rank:
            return low + (bound - low) * (rank - below) / (upto - below)
        below, low = upto, float(bound)
    return low


@pytest.mark.parametrize(
    "values",
    [
        [0.003] * 10,
        [0.02, 0.03, 0.04, 0.3, 0.6, 2.0],
        [20.0, 30.0],
        [0.01 * i for i in range(1, 100)],
    ],
)
def test_quantiles_from_the_histogram(spark, values):
    df = log(spark, [(1, 1, "a", v, False) for v in values])
    got = rows(traffic.latency_quantiles(df))[0]
    for p, name in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99")):
        assert got[name] == pytest.approx(prometheus_quantile(values, p))


def test_millisecond_calls_do_not_land_in_seconds(spark):
    df = log(spark, [(1, 1, "a", 0.017, False)] * 50)
    assert rows(traffic.tool_p95(df))[0]["p95"] < 0.025


def test_histogram_is_cumulative(spark):
    df = log(spark, [(1, 1, "a", v, False) for v in (0.004, 0.005, 0.2, 50.0)])
    got = {r["le"]: r["n"] for r in rows(traffic.latency_histogram(df))}
    assert (got["0.005"], got["0.1"], got["0.25"], got["10"], got["+Inf"]) == (2, 2, 3, 3, 4)
    assert len(got) == 15


def test_alarm_needs_three_of_five_periods(spark):
    def burst(minute, count, took):
        return [(minute * 60 + i % 60, 1, "a", took, True) for i in range(count)]

    df = log(spark, burst(0, 11, 0.9) + burst(2, 11, 0.9) + burst(4, 6, 0.01))
    got = {(r["alarm"], r["period_start"]) for r in rows(traffic.alerts(df))}
    assert got == {("balancer_errors", at(4))}
    more = log(spark, burst(0, 11, 0.9) + burst(2, 11, 0.9) + burst(4, 11, 0.9))
    got = {(r["alarm"], r["period_start"]) for r in rows(traffic.alerts(more))}
    assert got == {(a, at(4)) for a in ("p95_latency", "backend_errors", "balancer_errors")}


def test_quota_rejects_what_is_beyond_it(spark):
    df = log(
        spark,
        [(i * 0.5, 1, "a", 0.1, False) for i in range(65)]
        + [(61, 1, "a", 0.1, False), (5, 2, "a", 0.1, False)],
    )
    rejected = rows(traffic.quota_rejections(df), "request_id")
    assert [r["request_id"] for r in rejected] == [60, 61, 62, 63, 64]
    counts = rows(traffic.quota_counts(df))
    assert [(r["user_id"], r["requests"], r["rejected"]) for r in counts] == [(1, 65, 5)]


def test_quota_breaks_ties_by_request(spark):
    df = log(spark, [(1, 1, "a", 0.1, False)] * 5)
    got = rows(traffic.quota_rejections(df, limit=3), "request_id")
    assert [r["request_id"] for r in got] == [3, 4]


def test_quota_with_a_caller_that_holds_a_third_of_the_log(spark):
    entries = [(1 + k % 50 / 10, 7, "a", 0.1, False) for k in range(3000)]
    entries += [(k % 600, 100 + k % 2000, "a", 0.1, False) for k in range(6000)]
    df = log(spark, entries)
    kept = {i: e for i, e in enumerate(entries) if e[1] == 7}
    first = sorted(kept, key=lambda i: (kept[i][0], i))[:60]
    got = traffic.quota_rejections(df, limit=60)
    assert {r["request_id"] for r in got.collect()} == kept.keys() - set(first)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "_salt" in plan


def test_load_run(spark):
    df = log(spark, [(1, 1, "a", 0.1 + i / 1000, i < 2) for i in range(100)])
    got = rows(traffic.load_run_summary(df))[0]
    assert got["failed_share"] == pytest.approx(0.02)
    assert got["checks_share"] == pytest.approx(0.99)
    assert got["p95_seconds"] == pytest.approx(0.1 + 94.05 / 1000)
    assert got["p95_ok"] and got["failed_ok"] and got["checks_ok"]


@pytest.mark.parametrize("name", ["request_rate", "error_rate", "latency_quantiles", "quota_counts"])
def test_stream_equals_batch_for_closed_windows(spark, name):
    entries = [(i * 7 % 7200, i % 5, "ab"[i % 2], (i % 40) / 20, i % 3 == 0) for i in range(3000)]
    source = scratch_path(spark, "log")
    log(spark, entries).orderBy("ts").repartitionByRange(4, "ts").write.parquet(source)
    batch = spark.read.parquet(source)
    arriving = stream.stream_events(spark, source, batch.schema)
    options = {"limit": 2} if name == "quota_counts" else {}
    out = getattr(stream, name)(arriving, **options)
    path = scratch_path(spark, "out")
    stream.run_available(out, path, scratch_path(spark, "state"))
    streamed = spark.read.schema(out.schema).parquet(path)
    got = streamed.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
    length = {"quota_counts": 1}.get(name, 5)
    last = START + dt.timedelta(seconds=max(e[0] for e in entries)) - dt.timedelta(minutes=10)
    closed = F.col("window_start") + F.make_dt_interval(mins=F.lit(length)) <= F.lit(last).cast(
        "timestamp_ntz"
    )
    wanted = getattr(traffic, name)(batch, **options).where(closed)
    assert got.count() == wanted.count() > 0
    assert got.exceptAll(wanted).isEmpty()


def run_stream(spark, source, schema, operator, **options):
    path, state = scratch_path(spark, "out"), scratch_path(spark, "state")
    arriving = stream.stream_events(spark, source, schema, per_trigger=1)
    out = operator(arriving, **options)
    stream.run_available(out, path, state)
    return spark.read.schema(out.schema).parquet(path)


def written(spark, entries, parts):
    """The log as files that arrive in the order of time, one per micro-batch."""
    source = scratch_path(spark, "log")
    whole = log(spark, entries).orderBy("ts", "request_id").collect()
    size = -(-len(whole) // parts)
    for k in range(0, len(whole), size):
        some = spark.createDataFrame(whole[k : k + size], SCHEMA)
        some.coalesce(1).write.mode("append").parquet(source)
    return source, spark.read.parquet(source)


def test_stream_refuses_requests_as_they_arrive(spark):
    entries = [(k % 300, 7, "a", 0.1, False) for k in range(400)]  # one caller has most of the log
    entries += [(k * 11 % 2000, k % 9, "a", 0.1, False) for k in range(250)]
    source, batch = written(spark, entries, 5)
    got = run_stream(spark, source, batch.schema, stream.quota_rejections, limit=6)
    wanted = traffic.quota_rejections(batch, limit=6)
    assert got.columns == wanted.columns and got.dtypes == wanted.dtypes
    assert got.count() == wanted.count() > 100
    assert got.exceptAll(wanted).isEmpty()


def test_stream_judges_late_requests_when_they_come_and_drops_old_state(spark):
    source = scratch_path(spark, "log")
    parts = [
        [(1, 20, 5), (2, 21, 5), (3, 50, 5)],  # id, second, user; two may pass
        [(4, 10, 5), (5, 61, 5)],  # an earlier request that comes later is beyond the limit
        [(6, 3000, 5)],  # the watermark passes the first windows
        [(7, 30, 5), (8, 3001, 5), (9, 3002, 5)],  # too late to be answered; and one beyond
    ]
    for part in parts:
        entries = [(i, START + dt.timedelta(seconds=s), user, "a", 0.1, False) for i, s, user in part]
        spark.createDataFrame(entries, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    schema = spark.read.parquet(source).schema
    got = run_stream(spark, source, schema, stream.quota_rejections, limit=2)
    assert sorted(r["request_id"] for r in got.collect()) == [3, 4, 9]


def bursts(minutes):
    return [(m * 60 + k % 60, 1, "a", 0.9, True) for m in minutes for k in range(11)]


def test_alarms_on_a_stream_equal_those_of_a_batch(spark):
    # On in two spells, with periods without any request in between, and a single breach.
    entries = bursts([0, 2, 4, 6, 7, 8, 30, 45, 46, 48]) + [(90 * 60, 2, "a", 0.1, False)]
    source, batch = written(spark, entries, 6)
    on = traffic.alerts(batch)
    got = run_stream(spark, source, batch.schema, stream.alerts)
    got = got.withColumn("period_start", F.col("period_start").cast("timestamp_ntz"))
    assert got.count() == on.count() > 0 and got.exceptAll(on.select(got.columns)).isEmpty()
    changes = traffic.alarm_changes(on)
    spells = sorted((r["at"], r["state"]) for r in changes.where("alarm = 'backend_errors'").collect())
    wanted = [(4, "on"), (5, "off"), (6, "on"), (11, "off"), (48, "on"), (50, "off")]
    assert spells == [(at(minute), state) for minute, state in wanted]
    streamed = run_stream(spark, source, batch.schema, stream.alarm_changes)
    streamed = streamed.withColumn("at", F.col("at").cast("timestamp_ntz"))
    assert streamed.count() == changes.count() == 18
    assert streamed.exceptAll(changes).isEmpty()


def test_an_alarm_that_is_still_on_has_not_gone_off(spark):
    entries = bursts([0, 1, 2]) + [(15 * 60 - 1, 2, "a", 0.1, False)]  # closed up to minute 4:59
    source, batch = written(spark, entries, 3)
    got = run_stream(spark, source, batch.schema, stream.alarm_changes)
    assert {(r["state"], r["at"].replace(tzinfo=None)) for r in got.collect()} == {("on", at(2))}


def test_stream_judges_users_in_groups(spark, monkeypatch):
    monkeypatch.setattr(stream, "USER_GROUPS", 2)
    entries = [(k * 7 % 1500, k % 700, "a", 0.1, False) for k in range(3000)]
    source, batch = written(spark, entries, 3)
    path, state = scratch_path(spark, "out"), scratch_path(spark, "state")
    arriving = stream.stream_events(spark, source, batch.schema, per_trigger=1)
    out = stream.quota_rejections(arriving, limit=2, window="1 hour")
    going = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", state)
    going = going.trigger(availableNow=True).start()
    going.awaitTermination()
    states = max(p["stateOperators"][0]["numRowsTotal"] for p in going.recentProgress if p["stateOperators"])
    assert states <= 2  # one state per group and window, not one per user
    got, wanted = spark.read.schema(out.schema).parquet(path), traffic.quota_rejections(batch, limit=2, window="1 hour")
    assert got.count() == wanted.count() > 1000 and got.exceptAll(wanted).isEmpty()


def test_stream_keeps_large_and_missing_users(spark):
    source = scratch_path(spark, "log")
    large = 2**60 + 1
    entries = [(k, START + dt.timedelta(seconds=k), u, "a", 0.1, False) for k, u in enumerate([large, None] * 3)]
    spark.createDataFrame(entries, SCHEMA).coalesce(1).write.parquet(source)
    got = run_stream(spark, source, spark.read.parquet(source).schema, stream.quota_rejections, limit=2)
    assert {(r["request_id"], r["user_id"]) for r in got.collect()} == {(4, large), (5, None)}
