"""Queries over time slots, sessions, jobs and periods."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import periods as p
from lodestone.operators import jobs as ops
from lodestone.plans.registry import query
from lodestone.session import table

NOW = "2024-01-20 00:00:00"


@query("SELECT epoch(time_bucket(INTERVAL 15 MINUTE, ts))::BIGINT AS slot, event_type, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1, 2")
def slot_floor(spark, sf_dir):
    """D-10, Z-02: one trigger for each slot."""
    slot = F.unix_timestamp(p.slot_start(F.col("ts").cast("timestamp"), 15))
    return table(spark, sf_dir, "events").groupBy(slot.alias("slot"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


@query("""WITH gaps AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM gaps)
SELECT user_id, (epoch_us(min(ts)) // 1000000) AS started, count(*) AS n FROM s GROUP BY user_id, k""")
def sessions(spark, sf_dir):
    """Session windows with a gap of six hours."""
    events = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    found = events.groupBy("user_id", F.session_window("at", "6 hours").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return found.select("user_id", F.unix_timestamp("s.start").alias("started"), "n")


def _jobs(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("embed", "extract", "fetch", "poll", "other"))), (F.col("event_id") % 5 + 1).cast("int"))
    status = F.when(F.col("event_type") == "error", "processing").when(F.col("event_type") == "purchase", "completed").otherwise("pending")
    at = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), kind.alias("kind"), status.alias("status"), (F.col("event_id") % 4).cast("int").alias("attempts"), F.lit(3).alias("max_attempts"),
        at.alias("run_after"), (at + F.expr("interval 5 minutes")).alias("locked_until"),
    )


_JOBS_SQL = f"""jobs AS (SELECT event_id AS id, (['embed','extract','fetch','poll','other'])[(event_id % 5 + 1)::INT] AS kind, CASE event_type WHEN 'error' THEN 'processing' WHEN 'purchase' THEN 'completed' ELSE 'pending' END AS status,
  (event_id % 4)::INT AS attempts, ts AS run_after, ts + INTERVAL 5 MINUTE AS locked_until FROM events),
laned AS (SELECT *, CASE WHEN kind IN ('embed','extract') THEN 'model' WHEN kind IN ('fetch','poll') THEN 'network' ELSE 'default' END AS lane FROM jobs
          WHERE (status = 'pending' AND run_after <= TIMESTAMP '{NOW}') OR (status = 'processing' AND locked_until < TIMESTAMP '{NOW}'))"""


@query(f"""WITH {_JOBS_SQL} SELECT id, lane, attempts + 1 AS attempts, 'processing' AS status FROM (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY run_after, id) AS i FROM laned) WHERE i <= 4""")
def job_claims(spark, sf_dir):
    """Z-03, Z-07, O-06, P-07: oldest due jobs of each lane."""
    return ops.claim(_jobs(spark, sf_dir), NOW, 4).select("id", "lane", "attempts", "status")


@query(f"""WITH {_JOBS_SQL}, o AS (SELECT id, attempts - (id % 2) AS attempt, CASE WHEN id % 7 = 0 THEN 'impossible' WHEN id % 3 = 0 THEN 'done' ELSE 'error' END AS outcome FROM jobs WHERE status = 'processing'),
j AS (SELECT jobs.*, o.outcome FROM jobs LEFT JOIN o ON o.id = jobs.id AND o.attempt = jobs.attempts AND jobs.status = 'processing'),
s AS (SELECT *, CASE WHEN outcome IS NULL THEN status WHEN outcome = 'done' THEN 'completed' WHEN outcome = 'impossible' OR attempts >= 3 THEN 'failed' ELSE 'pending' END AS st FROM j)
SELECT id, st AS status, attempts, CASE WHEN outcome IS NOT NULL AND st = 'pending' THEN epoch(TIMESTAMP '{NOW}')::BIGINT + least(30 * pow(2, attempts - 1), 900)::BIGINT ELSE (epoch_us(run_after) // 1000000) END AS run_after FROM s""")
def job_outcomes(spark, sf_dir):
    """Z-04, Z-05, P-08, D-13, Z-14: fenced outcomes with backoff."""
    jobs = _jobs(spark, sf_dir)
    outcome = F.when(F.col("id") % 7 == 0, "impossible").when(F.col("id") % 3 == 0, "done").otherwise("error")
    results = jobs.where("status = 'processing'").select("id", (F.col("attempts") - (F.col("id") % 2)).cast("int").alias("attempt"), outcome.alias("outcome"))
    found = ops.apply_outcomes(jobs, results, NOW)
    return found.select("id", "status", "attempts", F.floor(F.unix_micros("run_after") / 1000000).alias("run_after"))


@query("""SELECT l_orderkey AS file_id, CASE WHEN min(CASE WHEN l_returnflag = 'A' THEN l_linenumber END) IS NOT NULL THEN 'fetched' WHEN bool_and(l_returnflag = 'R') THEN 'gone' ELSE 'retry_later' END AS outcome,
       min(CASE WHEN l_returnflag = 'A' THEN l_linenumber END) AS place FROM lineitem GROUP BY 1""")
def address_fallback(spark, sf_dir):
    """Z-15, S-16: first address that answers, else retry or gone."""
    http = F.when(F.col("l_returnflag") == "A", 200).when(F.col("l_returnflag") == "R", 404).otherwise(503)
    return ops.fallback_outcome(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("place"), http.alias("http_status")))


@query("""WITH d AS (SELECT o_orderpriority AS source, o_orderdate::DATE AS day, CASE WHEN max(o_orderkey) % 6 = 0 THEN 'refused' WHEN max(o_orderkey) % 4 = 0 THEN 'missing' ELSE 'ok' END AS response FROM orders GROUP BY 1, 2),
w AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY day DESC) AS i, coalesce(max(CASE WHEN response = 'refused' THEN 1 END) OVER (PARTITION BY source ORDER BY day DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS r FROM d)
SELECT source, day, CASE WHEN r = 1 OR i > 8 THEN 'waiting' WHEN response = 'refused' THEN 'refused' ELSE 'handled' END AS result FROM w""")
def rate_limited_run(spark, sf_dir):
    """Z-08: run cap and stop at the first refusal."""
    last = F.max("o_orderkey")
    days = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("source"), F.to_date("o_orderdate").alias("day")).agg(F.when(last % 6 == 0, "refused").when(last % 4 == 0, "missing").otherwise("ok").alias("response"))
    return ops.rate_limited_run(days).select("source", "day", "result")


@query("""SELECT o_orderkey, 'Q' || (((month(o_orderdate) + 8) % 12) // 3 + 1) || 'FY' || (year(o_orderdate) + (month(o_orderdate) >= 4)::INT) AS period,
       (year(o_orderdate) + (month(o_orderdate) >= 4)::INT) * 10 + (((month(o_orderdate) + 8) % 12) // 3 + 1) AS sort_key,
       last_day(make_date(year(o_orderdate), ((month(o_orderdate) - 1) // 3) * 3 + 3, 1)) AS period_end FROM orders""")
def fiscal_periods(spark, sf_dir):
    """D-01, D-03, D-12: codes, ends and sort keys of fiscal quarters."""
    day = F.to_date("o_orderdate")
    coded = table(spark, sf_dir, "orders").select("o_orderkey", p.format_period(p.fiscal_year_of(day), p.fiscal_quarter_of(day)).alias("period"))
    return coded.withColumns({"sort_key": p.period_sort_key(F.col("period")), "period_end": p.period_end(F.col("period"))})


@query("SELECT event_id, (ts + INTERVAL 330 MINUTE)::DATE AS day, least(30 * pow(2, event_id % 9), 900)::DOUBLE AS wait FROM events")
def india_day(spark, sf_dir):
    """D-09, D-13, T14: the day in India; backoff."""
    return table(spark, sf_dir, "events").select("event_id", p.india_date(F.col("ts").cast("timestamp")).alias("day"), p.backoff_seconds(F.col("event_id") % 9 + 1).alias("wait"))


@query("SELECT event_id, CASE WHEN event_id % 5 <> 4 THEN epoch(date_trunc('second', ts))::BIGINT END AS moment FROM events")
def feed_dates(spark, sf_dir):
    """D-11: moments of events as feeds print them, with and without weekday, in three zones, read back; some are no dates."""
    zones = F.get(F.array(F.lit("+0530"), F.lit("+0000"), F.lit("-0330")), (F.col("event_id") % 3).cast("int"))
    minutes = F.get(F.array(F.lit(330), F.lit(0), F.lit(-210)), (F.col("event_id") % 3).cast("int"))
    local = F.timestamp_seconds(F.unix_timestamp(F.col("ts").cast("timestamp")) + minutes * 60)
    day = F.when(F.col("event_id") % 2 == 0, F.concat(F.date_format(local, "E"), F.lit(", "))).otherwise("")
    text = F.when(F.col("event_id") % 5 == 4, "not a date").otherwise(F.concat(day, F.date_format(local, "dd MMM yyyy HH:mm:ss"), F.lit(" "), zones))
    return table(spark, sf_dir, "events").select("event_id", F.unix_timestamp(p.rfc822_timestamp(text)).alias("moment"))


@query("""SELECT (SELECT max(o_orderdate)::DATE FROM orders WHERE o_orderstatus = 'F') AS last_filing, (SELECT max(ts)::DATE FROM events WHERE event_type = 'purchase') AS last_event,
       (SELECT max(l_shipdate)::DATE FROM lineitem) AS last_price, EXISTS (SELECT 1 FROM events WHERE event_type = 'error') AS busy""")
def freshness_status(spark, sf_dir):
    """A-03, A-19, P-09, R-19: independent maxima in one row."""
    last = lambda df, c, name: df.agg(F.to_date(F.max(c)).alias(name))
    events = table(spark, sf_dir, "events")
    out = last(table(spark, sf_dir, "orders").where("o_orderstatus = 'F'"), "o_orderdate", "last_filing")
    out = out.crossJoin(last(events.where("event_type = 'purchase'"), "ts", "last_event")).crossJoin(last(table(spark, sf_dir, "lineitem"), "l_shipdate", "last_price"))
    return out.crossJoin(events.agg(F.coalesce(F.bool_or(F.col("event_type") == "error"), F.lit(False)).alias("busy")))
