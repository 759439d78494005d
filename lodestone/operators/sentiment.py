"""Decayed sentiment of dated events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.dims import IMPACT_WEIGHT, LABEL_AT, SENTIMENT_VALUE, lookup


def label(score: Column) -> Column:
    return F.when(score <= -LABEL_AT, "negative").when(score >= LABEL_AT, "positive").when(score.isNotNull(), "mixed")


def rolling_sentiment(events: DataFrame, as_of: str, window_days: int = 365, half_life_days: int = 90, min_events: int = 3) -> DataFrame:
    """Mean sentiment of each stock's events of the window, weighted by impact and halved every half-life.

    events: id, stock_id, sentiment, impact, event_date. Events after as_of do not count. The score is
    rounded to two places and the label follows the rounded score; both are null under min_events.
    """
    age = F.datediff(F.to_date(F.lit(as_of)), F.col("event_date"))
    weight = lookup(F.col("impact"), IMPACT_WEIGHT) * F.pow(F.lit(0.5), age / half_life_days)
    recent = events.where(age.between(0, window_days)).select("stock_id", "id", weight.alias("_w"), lookup(F.col("sentiment"), SENTIMENT_VALUE).alias("_v"))
    found = recent.groupBy("stock_id").agg(F.sum(F.col("_w") * F.col("_v")).alias("_s"), F.sum("_w").alias("_t"), F.count(F.lit(1)).alias("n_events"), F.sort_array(F.collect_list("id")).alias("event_ids"))
    score = F.when(F.col("n_events") >= min_events, F.round(F.col("_s") / F.col("_t"), 2) + F.lit(0.0))
    found = found.withColumn("score", score)
    status = F.when(F.col("n_events") >= min_events, "ok").otherwise("insufficient_data")
    return found.select("stock_id", status.alias("status"), "score", label(F.col("score")).alias("label"), "n_events", "event_ids")


def recent_events(events: DataFrame, limit: int = 10) -> DataFrame:
    """The newest events of each stock, ties to the larger id."""
    from lodestone.operators.rank import top_n_per_group

    return top_n_per_group(events, ["stock_id"], [F.desc("event_date"), F.desc("id")], limit)
