"""Exponentially decayed sums that can be merged: by day, over sliding windows, and in a stream's state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged(total_a: Column, day_a: Column, total_b: Column, day_b: Column, half_life: float) -> tuple[Column, Column]:
    """The sum of two decayed sums that hold at different days, and the later day, at which it holds."""
    day = F.greatest(day_a, day_b)
    at = lambda total, own: F.coalesce(total * F.pow(F.lit(0.5), (day - own) / half_life), F.lit(0.0))
    return at(total_a, day_a) + at(total_b, day_b), day


def sliding_decayed(rows: DataFrame, key: str, day: str, value: str, weight: str, window_days: int, half_life: float) -> DataFrame:
    """The decayed weighted mean of each key at each of its days, over the window of days that ends there.

    Returns key, day, n (rows of the window) and mean: the sum of weight * value * 0.5^(age / half_life) over that of the weights.
    Rows are reduced to one for each key and day first, which is all that is shuffled further, so that a key with
    a third of all rows has as many rows as days. A sum holds at the start of a block of days longer than the window: the window
    spans two blocks at most, one even and one odd, so that one running frame gives both sums and one factor puts them together; no
    day is scanned again for each window that it is in by more than the frame. Nulls: rows without day, value or weight do not count.
    """
    block_days = window_days + 1
    at = F.unix_date(F.to_date(day))
    known = rows.where(F.col(day).isNotNull() & F.col(value).isNotNull() & F.col(weight).isNotNull())
    daily = known.groupBy(key, F.to_date(day).alias("day")).agg(F.sum(F.col(weight) * F.col(value)).cast("double").alias("_s"), F.sum(weight).cast("double").alias("_w"), F.count(F.lit(1)).alias("_n"))
    daily = daily.withColumn("_d", F.unix_date("day")).withColumn("_block", F.floor(F.col("_d") / block_days))
    grown = F.pow(F.lit(2.0), (F.col("_d") - F.col("_block") * block_days) / half_life)
    even = F.col("_block") % 2 == 0
    frame = Window.partitionBy(key).orderBy("_d").rangeBetween(-window_days, 0)
    side = lambda c, is_even: F.sum(F.when(even == is_even, F.col(c) * grown).otherwise(0.0)).over(frame)
    sums = daily.select(key, "day", "_d", "_block", even.alias("_even"), F.sum("_n").over(frame).alias("n"), *[side(c, e).alias(f"{c}{int(e)}") for c in ("_s", "_w") for e in (True, False)])
    older = F.pow(F.lit(0.5), F.lit(block_days) / half_life)
    both = lambda c: F.when(F.col("_even"), F.col(f"{c}1") + F.col(f"{c}0") * older).otherwise(F.col(f"{c}0") + F.col(f"{c}1") * older)
    return sums.select(key, "day", "n", (both("_s") / F.nullif(both("_w"), F.lit(0.0))).alias("mean"))


def decayed_by_key(rows: DataFrame, key: str, day: str, value: str, weight: str, half_life: float, as_of: Column | None = None) -> DataFrame:
    """key, total, weight and day: decayed sums over all days of a key, which hold at its last day (or at as_of); merged() adds two of them."""
    daily = rows.groupBy(key, F.to_date(day).alias("_day")).agg(F.sum(F.col(weight) * F.col(value)).cast("double").alias("_s"), F.sum(weight).cast("double").alias("_w"))
    last = daily.groupBy(F.col(key).alias("_k")).agg(F.max("_day").alias("_last"))
    joined = daily.join(last, F.col(key).eqNullSafe(F.col("_k")))
    held = F.col("_last") if as_of is None else as_of
    factor = F.pow(F.lit(0.5), F.datediff(held, F.col("_day")) / half_life)
    return joined.groupBy(key).agg(F.sum(F.col("_s") * factor).alias("total"), F.sum(F.col("_w") * factor).alias("weight"), F.max(held).alias("day"))
