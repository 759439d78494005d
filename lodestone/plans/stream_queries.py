"""Queries over streams: the events table is read as a stream of files and drained into tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.plans.registry import query
from lodestone.sources import polled
from lodestone.sources.landing import landing_folder
from lodestone.streaming import counters
from lodestone.streaming import events as ops
from lodestone.session import table

#: Events of a file that one task sorts, at most about.
_ROWS_A_FILE = 500_000
_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


def _stream(spark, sf_dir, files=4):
    """The events in several files, which a stream reads one by one, in the order of their moments; each key twice."""
    path = landing_folder(spark, "events")
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    rows.repartitionByRange(max(files, -(-rows.count() // _ROWS_A_FILE)), "ts").write.parquet(path)
    return ops.read_events(spark, path, _SCHEMA)


@query("SELECT event_type, epoch(time_bucket(INTERVAL 60 MINUTE, ts))::BIGINT AS slot FROM events GROUP BY 1, 2")
def stream_slots(spark, sf_dir):
    """Z-01, Z-02: one trigger for each slot, by a stream that forgets slots with its watermark."""
    folder = landing_folder(spark, "slots")
    found = ops.drain(ops.slot_triggers(_stream(spark, sf_dir), "event_type", 60, "1 day"), f"{folder}/table", f"{folder}/checkpoint")
    return found.select("event_type", F.unix_timestamp("slot").alias("slot"))


@query("SELECT user_id % 10 AS k, min(event_id) AS event_id FROM events GROUP BY 1")
def stream_inserts(spark, sf_dir):
    """Z-10, K-01: micro-batches merged by key: the first row of a key stays, late and repeated rows add nothing."""
    folder = landing_folder(spark, "inserts")
    stream = _stream(spark, sf_dir).withColumn("k", F.col("user_id") % 10)
    ops.insert_batches(stream, f"{folder}/table", f"{folder}/checkpoint", ["k"], "event_id").awaitTermination()
    return spark.read.parquet(f"{folder}/table").select("k", "event_id")


@query("""WITH c AS (SELECT event_type, time_bucket(INTERVAL 1440 MINUTE, ts) AS slot, count(*) AS n FROM events GROUP BY 1, 2), w AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM events)
SELECT event_type, epoch(slot)::BIGINT AS slot, n FROM c, w WHERE slot + INTERVAL 1 DAY <= mark""")
def stream_counts(spark, sf_dir):
    """Z-02, Z-12: tumbling counts, each given once the watermark has passed its slot."""
    folder = landing_folder(spark, "counts")
    found = ops.drain(ops.slot_counts(_stream(spark, sf_dir, 1), "event_type", 1440), f"{folder}/table", f"{folder}/checkpoint")
    return found.select("event_type", F.unix_timestamp("slot").alias("slot"), "n")


@query("""SELECT user_id AS key, CASE WHEN bool_or(event_type = 'purchase' AND value > 80) THEN 'fetched' WHEN count(*) FILTER (WHERE event_type = 'error') >= 3 THEN 'no_file' ELSE 'missing' END AS status,
       least(count(*) FILTER (WHERE event_type = 'error'), 3) AS strikes FROM events GROUP BY 1""")
def stream_strikes(spark, sf_dir):
    """K-05: the counter with its ceiling as state of a stream: after all files, as the batch rule gives it over the whole history."""
    folder = landing_folder(spark, "strikes")
    outcome = F.when((F.col("event_type") == "purchase") & (F.col("value") > 80), "fetched").when(F.col("event_type") == "error", "missing").otherwise("other")
    states = counters.strike_stream(_stream(spark, sf_dir).withColumn("outcome", outcome), "user_id", "outcome", "ts")
    return counters.last_states(spark, states, f"{folder}/table", f"{folder}/checkpoint")


@query("""WITH g AS (SELECT user_id, ts, coalesce(date_diff('microsecond', lag(ts) OVER w, ts) >= 43200 * 1000000::BIGINT, true) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), w AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM events)
SELECT user_id, floor(epoch(min(ts)))::BIGINT AS started, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 12 HOUR <= (SELECT mark FROM w)""")
def stream_sessions(spark, sf_dir):
    """Z-02: sessions of users, runs of events without twelve hours between, each given once the watermark has passed it."""
    folder = landing_folder(spark, "sessions")
    found = ops.drain(ops.session_counts(_stream(spark, sf_dir, 1), "user_id", "12 hours"), f"{folder}/table", f"{folder}/checkpoint")
    return found.select("user_id", F.unix_timestamp("started").alias("started"), "n")


@query("SELECT o_orderkey, round(o_totalprice, 2) AS price, CASE WHEN o_orderkey % 5 < 4 THEN 0 ELSE 1 END AS trigger FROM orders")
def polled_orders(spark, sf_dir):
    """Z-09, S-06: a folder polled three times: files that are there, then one more, then nothing new; each line is read once."""
    folder, landed = landing_folder(spark, "polled"), landing_folder(spark, "landed")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws(",", "o_orderkey", F.round("o_totalprice", 2)).alias("value"))
    seen = None
    for number, part in enumerate((F.col("o_orderkey") % 5 < 4, F.col("o_orderkey") % 5 == 4, F.lit(False))):
        if number < 2:
            rows.where(part).select("value").write.text(f"{landed}/{number}")
        now = ops.drain(polled.poll(spark, landed), f"{folder}/table", f"{folder}/checkpoint")
        new = now.select("file", "line", F.lit(number).alias("trigger"), "text")
        seen = new if seen is None else seen.unionByName(new)
        seen.write.parquet(f"{folder}/seen{number}")
        seen = spark.read.parquet(f"{folder}/seen{number}")
    firsts = seen.groupBy("file", "line", "text").agg(F.min("trigger").alias("trigger"), F.countDistinct("trigger").alias("_n"))
    fields = F.split("text", ",")
    return firsts.select(fields[0].cast("long").alias("o_orderkey"), fields[1].cast("double").alias("price"), "trigger")
