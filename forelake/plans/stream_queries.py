"""The online forms, drained over the events file and read back as tables."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from forelake.plans.registry import query, r, rs, shown
from forelake.plans.views import Views
from forelake.streaming import online as O
from forelake.streaming.run import read_event_stream, run_available, shared_folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def live_events(v: Views):
    schema = v.table("events").schema
    stream = read_event_stream(v.spark, f"{v.sf_dir}/events*.parquet", schema, files_per_batch=64)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


PARTS = 3


def arriving(v: Views):
    """The events as a stream that arrives in parts, and the steps that add the later parts.

    Parts follow the events' time. A later part replays every tenth row of the part before, and
    holds late rows: altered copies, under new ids, of rows of the first part.
    """
    events = v.table("events")
    ends = events.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    span = (ends["hi"] - ends["lo"]) / PARTS
    folder = shared_folder(v.spark, "arriving")

    def part(k: int):
        last = k == PARTS - 1
        low, high = (F.lit(ends["lo"] + span * i).cast("timestamp_ntz") for i in (k, k + 1))
        return events.filter((F.col("ts") >= low) & (F.lit(True) if last else F.col("ts") < high))

    def write(k: int) -> None:
        rows = part(k)
        if k:
            rows = rows.unionByName(part(k - 1).filter("event_id % 10 = 0"))
        if k == PARTS - 1:
            rows = rows.unionByName(part(0).filter("event_id % 7 = 0").withColumns({"event_id": F.col("event_id") + 10**9, "value": F.col("value") + 1000}))
        rows.write.parquet(f"{folder}/{k}")

    write(0)
    stream = read_event_stream(v.spark, f"{folder}/*", events.schema, files_per_batch=10_000)
    return stream.withColumn("ts", F.col("ts").cast("timestamp")), [lambda k=k: write(k) for k in range(1, PARTS)]


def live_versions(events):
    """The vintages view with event-time columns."""
    return events.select(
        F.col("event_type").alias("region"),
        (F.timestamp_seconds(F.floor(F.unix_seconds("ts") / 14400) * 14400) + F.make_dt_interval(hours=((F.col("user_id") % 12 + 1) * 4).cast("int"))).alias("target"),
        F.col("ts").alias("as_of"),
        F.timestamp_seconds(F.floor(F.unix_seconds("ts") / 1800) * 1800).alias("nominal_issue"),
        F.col("value").alias("forecast"),
        F.col("event_id").cast("long").alias("seq"),
    )


@contextmanager
def timers(spark):
    """A state store with timers while a query runs."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


_SERIES = "OVER (PARTITION BY region, target ORDER BY as_of, seq)"
_SIX = "OVER (PARTITION BY region, target ORDER BY as_of, seq ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"
_MOMENTS = f"""SELECT region, target, count(*) FILTER (WHERE ok) AS n_versions, count(*) FILTER (WHERE NOT ok) AS late_versions,
  {r('sum(forecast / lead) FILTER (WHERE ok) / sum(1 / lead) FILTER (WHERE ok)', 'inverse_lead')}
FROM (SELECT *, as_of <= target - INTERVAL 60 MINUTE AS ok, (epoch_us(target) - epoch_us(nominal_issue)) / 60000000.0 AS lead FROM vintages)"""


def _naive(df, *columns):
    return shown(df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns}))


@query("stream_inverse_lead", f"{_MOMENTS} GROUP BY region, target", "vintages")
def stream_inverse_lead(v: Views):
    events, feed = arriving(v)
    # Targets lie up to two days after their versions.
    moments = O.online_moments(live_versions(events).drop("seq"), watermark="3 days")
    return _naive(run_available(moments, ["region", "target"], "update", feed=feed).drop("weight", "weighted"), "target")


@query("stream_expiring_moments", f"{_MOMENTS} WHERE target < (SELECT max(as_of) - INTERVAL 10 MINUTE FROM vintages) GROUP BY region, target", "vintages")
def stream_expiring_moments(v: Views):
    events, feed = arriving(v)
    with timers(v.spark):
        table = run_available(O.expiring_moments(live_versions(events).drop("seq"), watermark="10 minutes"), feed=feed)
    return _naive(table.drop("weight", "weighted"), "target")


@query("stream_rolling_revision", f"""
WITH d AS (SELECT *, forecast - lag(forecast) {_SERIES} AS d FROM vintages),
x AS (SELECT region, target, as_of, seq, sum(abs(d)) {_SIX} AS abs_revision, CASE WHEN count(d) {_SIX} >= 2 THEN stddev_samp(d) {_SIX} END AS revision_sd FROM d)
SELECT region, target, as_of, seq, {rs('abs_revision', 'revision_sd')} FROM x WHERE as_of <= (SELECT max(as_of) - INTERVAL 10 MINUTE FROM vintages)""", "vintages")
def stream_rolling_revision(v: Views):
    """The last six revisions of every version, in three micro-batches with late and replayed rows."""
    events, feed = arriving(v)
    with timers(v.spark):
        table = run_available(O.rolling_revisions(live_versions(events).drop("nominal_issue")), feed=feed)
    return _naive(table, "target", "as_of")


@query("stream_window_price", """
SELECT event_type AS region, time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP '2000-01-01') + INTERVAL 30 MINUTE AS target, round(avg(value) + 3e-8, 4) AS price, count(*) AS n FROM events
GROUP BY 1, 2 HAVING count(*) = 2 AND time_bucket(INTERVAL 30 MINUTE, min(ts), TIMESTAMP '2000-01-01') + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 1 MINUTE FROM events)""")
def stream_window_price(v: Views):
    prices = live_events(v).select(F.col("event_type").alias("region"), "ts", F.col("value").alias("price"))
    return _naive(run_available(O.window_price(prices, 30, 2, watermark="1 minute")), "target")


@query("stream_sessions", """
WITH d AS (SELECT event_type AS region, ts FROM events WHERE value >= 100),
f AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY region ORDER BY ts) <= 14400000000 THEN 0 ELSE 1 END AS new FROM d),
s AS (SELECT *, sum(new) OVER (PARTITION BY region ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM f)
SELECT region, min(ts) AS first_target, max(ts) AS last_target, max(ts) + INTERVAL 4 HOUR AS event_end, count(*) AS triggers FROM s GROUP BY region, k
HAVING max(ts) + INTERVAL 4 HOUR <= (SELECT max(ts) - INTERVAL 1 MINUTE FROM d)""")
def stream_sessions(v: Views):
    triggers = live_events(v).filter("value >= 100").select(F.col("event_type").alias("region"), "ts")
    return _naive(run_available(O.session_events(triggers, watermark="1 minute")), "first_target", "last_target", "event_end")


@query("session_window_batch", """
WITH d AS (SELECT event_type AS region, ts FROM events WHERE value >= 100),
f AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY region ORDER BY ts) <= 14400000000 THEN 0 ELSE 1 END AS new FROM d),
s AS (SELECT *, sum(new) OVER (PARTITION BY region ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM f)
SELECT region, min(ts) AS first_target, max(ts) AS last_target, max(ts) + INTERVAL 4 HOUR AS event_end, count(*) AS triggers FROM s GROUP BY region, k""")
def session_window_batch(v: Views):
    triggers = v.table("events").filter("value >= 100").select(F.col("event_type").alias("region"), F.col("ts").cast("timestamp").alias("ts"))
    return _naive(O.session_events(triggers), "first_target", "last_target", "event_end")


@query("stream_sliding_revisions", """
SELECT region, w AS as_of, count(*) AS revisions, round(avg(abs(value)) + 3e-8, 4) AS mean_abs_revision FROM (
  SELECT event_type AS region, value, time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP '2000-01-01') + INTERVAL 30 MINUTE * k AS w FROM events, range(1, 7) t(k))
WHERE w <= (SELECT max(ts) - INTERVAL 3 HOUR FROM events) GROUP BY 1, 2""")
def stream_sliding_revisions(v: Views):
    rows = live_events(v).select(F.col("event_type").alias("region"), F.col("ts").alias("as_of"), F.col("value").alias("revision"))
    return _naive(run_available(O.sliding_revisions(rows, keys=("region",))), "as_of")
