"""As-of joins: to each row the last row of another relation at or before its moment, in bounded tasks whatever the key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_at: str,
    right_at: str,
    bucket_seconds: int,
    tolerance_seconds: int | None = None,
    order: Sequence[str] = (),
    prefix: str = "",
    strict: bool = False,
) -> DataFrame:
    """All rows of left with the columns of the last row of right at or before left_at, null where there is none.

    Both sides are put together and sorted once by key, bucket of time and moment; the last row of right is the last one that is
    not null before a row in its bucket. A bucket's own last row is carried to the buckets after it by a window over one row
    for each key and bucket, so that a key with a third of all rows is as many tasks as it has buckets.

    Rows of right with one moment: the last by the order columns counts (nulls first). strict leaves out rows of the same moment.
    tolerance_seconds: how old a row of right may be. Nulls: a null key meets null keys, a row without a moment meets
    nothing. Columns of right are prefixed; its keys are not repeated. Rows that repeat are all kept.
    """
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    bucket = lambda at: F.floor(at / (bucket_seconds * 1_000_000))
    names = [c for c in right.columns if c not in keys]
    clash = [f"{prefix}{c}" for c in names if f"{prefix}{c}" in left.columns]
    if clash:
        raise ValueError(f"both sides have {', '.join(clash)}; give a prefix")
    own, other = F.struct(*left.columns), F.struct(*names)
    lefts = left.select(*keys, seconds(left_at).alias("_at"), F.lit(0 if strict else 1).alias("_side"), own.alias("_left"), F.lit(None).cast(right.select(other).schema[0].dataType).alias("_right"), F.lit(None).cast(_order_type(right, order)).alias("_tie"))
    rights = right.where(F.col(right_at).isNotNull()).select(*keys, seconds(right_at).alias("_at"), F.lit(1 if strict else 0).alias("_side"), F.lit(None).cast(left.select(own).schema[0].dataType).alias("_left"), other.alias("_right"), _order(order).alias("_tie"))
    both = lefts.unionByName(rights).withColumn("_bucket", bucket(F.col("_at")))
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_at", "_side", F.asc_nulls_first("_tie")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_last", F.last("_right", ignorenulls=True).over(inside)).where("_left IS NOT NULL")
    # What each bucket leaves to those after it: one row for each key and bucket that has rows of either side.
    ends = both.groupBy(*keys, "_bucket").agg(F.max(F.when(F.col("_right").isNotNull(), F.struct("_at", "_tie", "_right")))["_right"].alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_carried", F.last("_end", ignorenulls=True).over(before)).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_b"), "_carried")
    same = F.col("_bucket").eqNullSafe(F.col("_b"))
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = found.join(carried, same, "left")
    matched = F.when(F.col("_at").isNotNull(), F.coalesce("_last", "_carried"))
    rows = joined.select(F.col("_left"), F.col("_at"), matched.alias("_m"))
    if tolerance_seconds is not None:
        age = F.col("_at") - F.unix_micros(F.col("_m")[right_at].cast("timestamp"))
        rows = rows.withColumn("_m", F.when(age <= tolerance_seconds * 1_000_000, F.col("_m")))
    return rows.select("_left.*", *[F.col("_m")[c].alias(f"{prefix}{c}") for c in names])


def _order(order: Sequence[str]) -> Column:
    return F.struct(*order) if order else F.struct(F.lit(0).alias("none"))


def _order_type(right: DataFrame, order: Sequence[str]):
    return right.select(_order(order)).schema[0].dataType
