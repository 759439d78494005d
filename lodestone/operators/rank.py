"""Ranked selection: winners, arguments of a maximum, top rows of groups, fair shares, pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def winner_per_group(df: DataFrame, keys: Sequence[str], preference: Sequence[Column]) -> DataFrame:
    """The row of each group whose preference is largest, by one partially aggregated maximum.

    Preferences are compared in turn; null is the least. Null keys form groups of their own.
    """
    others = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*others), F.struct(*preference))
    return df.groupBy(*keys).agg(best.alias("_best")).select(*keys, "_best.*")


def top_n_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each group; Spark limits groups before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("place", place).where(F.col("place") <= n)


def last_n_ascending(df: DataFrame, keys: Sequence[str], order: str, n: int) -> DataFrame:
    """The n latest rows of each group, numbered again from the oldest of them."""
    latest = top_n_per_group(df, keys, [F.desc(order)], n).drop("place")
    return latest.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))


def numbered(df: DataFrame, order: str, *keys_and_order: str) -> DataFrame:
    """Add place (from 1) by order; further names are the group's key, then more columns to order by."""
    window = Window.partitionBy(*keys_and_order[:1]) if keys_and_order else Window.partitionBy(F.lit(0))
    return df.withColumn("place", F.row_number().over(window.orderBy(order, *keys_and_order[1:])))


def consecutive_change(df: DataFrame, key: str, year: str, value: str) -> DataFrame:
    """Add change: percent against the size of the value of the year right before; null without that year or where it was 0."""
    window = Window.partitionBy(key).orderBy(year)
    before, last = F.lag(value).over(window), F.lag(year).over(window)
    rows = df.withColumns({"_before": before, "_last": last})
    change = F.when((F.col("_last") == F.col(year) - 1) & (F.col("_before") != 0), F.round((F.col(value) - F.col("_before")) / F.abs("_before") * 100, 1))
    return rows.withColumn("change", change).drop("_before", "_last")


def fair_cap(df: DataFrame, group: str, order: Sequence[Column], limit: int) -> DataFrame:
    """At most limit rows in all, dealt round-robin over the groups in their order.

    Every group's first rows come before any group's second ones. No group gives more than limit rows
    to the final ranking, so that ranks at most limit rows of each group.
    """
    depth = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    dealt = df.withColumn("depth", depth).where(F.col("depth") <= limit)
    return dealt.orderBy("depth", group).limit(limit)


def keyset_page(df: DataFrame, key: str, cursor: int | Column | None, limit: int) -> DataFrame:
    """One page below the cursor, newest first, with the cursor of the next page (null on the last)."""
    rows = df if cursor is None else df.where(F.col(key) < cursor)
    page = rows.orderBy(F.desc(key)).limit(limit + 1)
    page = page.withColumn("_n", F.row_number().over(Window.orderBy(F.desc(key))))
    more = F.max("_n").over(Window.partitionBy(F.lit(0))) > limit
    last = F.max(F.when(F.col("_n") == limit, F.col(key))).over(Window.partitionBy(F.lit(0)))
    return page.withColumn("next_cursor", F.when(more, last)).where(F.col("_n") <= limit).drop("_n")


def budget_prefix(df: DataFrame, keys: Sequence[str], order: Sequence[Column], size: str, budget: int) -> DataFrame:
    """Rows of each group while their running size fits the budget; the first one always."""
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    used, place = F.sum(size).over(window), F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumns({"used": used, "place": place}).where((F.col("used") <= budget) | (F.col("place") == 1))
