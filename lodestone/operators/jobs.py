"""Job queue state as table transitions: claims, fenced outcomes, backoff, lanes; one writer applies each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.periods import backoff_seconds

#: Job kind to lane; other kinds run in the default lane.
LANES = {"embed": "model", "extract": "model", "fetch": "network", "poll": "network", "prices": "network"}


def runnable(jobs: DataFrame, now: str) -> DataFrame:
    """Jobs that are pending and due, or whose worker's lease ran out."""
    moment = F.to_timestamp(F.lit(now))
    due = (F.col("status") == "pending") & (F.col("run_after") <= moment)
    lost = (F.col("status") == "processing") & (F.col("locked_until") < moment)
    return jobs.where(due | lost)


def lane_of(kind):
    out = F.lit("default")
    for name, lane in LANES.items():
        out = F.when(kind == name, lane).otherwise(out)
    return out


def claim(jobs: DataFrame, now: str, workers: int, lease_seconds: int = 300) -> DataFrame:
    """The next jobs of each lane, oldest due first, as many as it has workers: now processing, attempt counted, leased."""
    order = Window.partitionBy("lane").orderBy("run_after", "id")
    chosen = runnable(jobs, now).withColumn("lane", lane_of(F.col("kind"))).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= workers)
    return chosen.drop("_n").withColumns(
        {"status": F.lit("processing"), "attempts": F.col("attempts") + 1, "locked_until": F.to_timestamp(F.lit(now)) + F.make_dt_interval(secs=F.lit(lease_seconds))}
    )


def apply_outcomes(jobs: DataFrame, outcomes: DataFrame, now: str) -> DataFrame:
    """Apply results to jobs; a result whose attempt is not the job's current one lost its lease and does nothing.

    outcomes: id, attempt, outcome (done, error, impossible). A job is completed, or failed if impossible
    or out of attempts, or pending again after a doubling wait.
    """
    results = outcomes.select(F.col("id").alias("_id"), F.col("attempt").alias("_attempt"), "outcome").dropDuplicates(["_id", "_attempt"])
    on = (F.col("id") == F.col("_id")) & (F.col("attempts") == F.col("_attempt")) & (F.col("status") == "processing")
    joined = jobs.join(results, on, "left")
    over = (F.col("outcome") == "impossible") | (F.col("attempts") >= F.col("max_attempts"))
    status = F.when(F.col("outcome").isNull(), F.col("status")).when(F.col("outcome") == "done", "completed").when(over, "failed").otherwise("pending")
    again = F.to_timestamp(F.lit(now)) + F.make_dt_interval(secs=backoff_seconds(F.col("attempts")).cast("decimal(18,6)"))
    run_after = F.when(F.col("outcome").isNotNull() & (status == "pending"), again).otherwise(F.col("run_after"))
    return joined.withColumns({"run_after": run_after, "status": status}).drop("_id", "_attempt", "outcome")


def fallback_outcome(attempts: DataFrame) -> DataFrame:
    """Result of trying a file's addresses in order: the first that answers, else retry if any was busy, else gone.

    attempts: file_id, place, http_status.
    """
    found = attempts.groupBy("file_id").agg(
        F.min(F.when(F.col("http_status") == 200, F.col("place"))).alias("place"),
        F.bool_and(F.col("http_status") == 404).alias("_gone"),
    )
    outcome = F.when(F.col("place").isNotNull(), "fetched").when(F.col("_gone"), "gone").otherwise("retry_later")
    return found.select("file_id", outcome.alias("outcome"), "place")


def rate_limited_run(days: DataFrame, cap: int = 8) -> DataFrame:
    """Which days one run of a rate-limited source handles: newest first, at most cap, ending with the first refusal.

    days: source, day, response (ok, missing, refused). Adds result: handled, refused (ends the run) or waiting.
    """
    order = Window.partitionBy("source").orderBy(F.desc("day"))
    refused_before = F.coalesce(F.max(F.when(F.col("response") == "refused", 1)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(order)
    result = F.when((refused_before == 1) | (place > cap), "waiting").when(F.col("response") == "refused", "refused").otherwise("handled")
    return days.withColumn("result", result)
