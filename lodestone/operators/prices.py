"""Daily prices: corporate actions, adjusted closes, returns, volatility, per-share ratios.

A price row has symbol, trade_date, close and prev_close (the exchange's previous close, which reflects
bonus issues and splits). Windows are partitioned by symbol and ordered by day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.periods import fiscal_quarter, fiscal_year
from lodestone.operators.dims import ACTION_TOLERANCE, FACTOR_PLACES, MIN_RETURNS, TRADING_DAYS

RETURN_MONTHS = {"return_1m": 1, "return_3m": 3, "return_6m": 6, "return_1y": 12}


def _days():
    return Window.partitionBy("symbol").orderBy("trade_date")


def with_factors(prices: DataFrame) -> DataFrame:
    """Add factor: previous close over the close of the row before, where it differs from 1 by over 1 %.

    The unrounded ratio decides, the ratio rounded to four places is kept; no factor after a close of 0.
    """
    before = F.lag("close").over(_days())
    ratio = F.when(before > 0, F.col("prev_close").cast("double") / before.cast("double"))
    return prices.withColumn("factor", F.when(F.abs(ratio - 1) > ACTION_TOLERANCE, F.round(ratio, FACTOR_PLACES)))


def corporate_actions(prices: DataFrame) -> DataFrame:
    return with_factors(prices).where("factor IS NOT NULL").select("symbol", "trade_date", "factor")


def adjusted_closes(prices: DataFrame) -> DataFrame:
    """Add adjusted: the close times the factors of all later rows; a row's own factor does not apply to it."""
    # From the newest day back, so that the frame only grows and no row's product is computed anew.
    later = Window.partitionBy("symbol").orderBy(F.desc("trade_date")).rowsBetween(Window.unboundedPreceding, -1)
    product = F.coalesce(F.product(F.coalesce("factor", F.lit(1.0))).over(later), F.lit(1.0))
    return with_factors(prices).withColumn("adjusted", F.col("close").cast("double") * product)


def latest_prices(prices: DataFrame) -> DataFrame:
    """The last row of each symbol with its change against the exchange's previous close, in percent."""
    latest = prices.groupBy("symbol").agg(F.max_by(F.struct("trade_date", "close", "prev_close"), "trade_date").alias("_l")).select("symbol", "_l.*")
    change = F.round((F.col("close").cast("double") / F.col("prev_close").cast("double") - 1) * 100, 1)
    return latest.withColumn("day_change", F.when(F.col("prev_close") > 0, change))


def period_returns(adjusted: DataFrame, months: dict[str, int] = RETURN_MONTHS) -> DataFrame:
    """Change of the adjusted close over each number of months, from the last close on or before its start.

    Backward as-of joins, as one pass: each base is the value at the largest day up to the start. Null
    if the history does not reach back or the base is not positive.
    """
    last = adjusted.groupBy("symbol").agg(F.max("trade_date").alias("last_day"))
    rows = adjusted.join(last, "symbol")
    in_time = lambda n: F.col("trade_date") <= F.add_months("last_day", -n)
    bases = [F.max_by(F.when(in_time(n), F.col("adjusted")), F.when(in_time(n), F.col("trade_date"))).alias(name) for name, n in months.items()]
    found = rows.groupBy("symbol", "last_day").agg(F.max_by("adjusted", "trade_date").alias("_last"), *bases)
    return found.select("symbol", "last_day", *[F.when(F.col(name) > 0, F.round((F.col("_last") / F.col(name) - 1) * 100, 1)).alias(name) for name in months])


def volatility(adjusted: DataFrame, days: int = 365) -> DataFrame:
    """Yearly volatility in percent of the returns between rows of the last days; null under 60 returns."""
    last = adjusted.groupBy("symbol").agg(F.max("trade_date").alias("last_day"))
    recent = adjusted.join(last, "symbol").where(F.col("trade_date") >= F.date_sub("last_day", days))
    before = F.lag("adjusted").over(_days())
    returns = recent.withColumn("_r", F.when(before > 0, F.col("adjusted") / before - 1))
    found = returns.groupBy("symbol").agg(F.count("_r").alias("n_returns"), F.stddev_samp("_r").alias("_s"))
    yearly = F.when(F.col("n_returns") >= MIN_RETURNS, F.round(F.col("_s") * F.sqrt(F.lit(float(TRADING_DAYS))) * 100, 1))
    return found.select("symbol", "n_returns", yearly.alias("volatility"))


def _year_end(period: Column) -> Column:
    return F.make_date(fiscal_year(period), F.lit(3), F.lit(31))


def per_share_ratio(latest: DataFrame, facts: DataFrame, actions: DataFrame, kind: str) -> DataFrame:
    """Price over earnings ("pe") or dividend over price in percent ("yield") with a status for each symbol.

    latest: symbol, close; facts: symbol, period, unit, value (the latest per-share figure); actions:
    symbol, trade_date. The first reason that applies: no_price, no_figure, not_in_rupees,
    not_full_year, action_after_year_end, not_positive; else ok.
    """
    names = latest.select("symbol").union(facts.select("symbol")).distinct()
    year_end = facts.select("symbol", _year_end(F.col("period")).alias("_end"))
    after = actions.join(year_end, "symbol").where("trade_date > _end").groupBy("symbol").agg(F.min("trade_date").alias("first_action"))
    own = facts.select("symbol", "period", "unit", F.col("value").alias("figure"))
    rows = names.join(latest.select("symbol", "close"), "symbol", "left").join(own, "symbol", "left").join(after, "symbol", "left")
    low = F.col("figure") <= 0 if kind == "pe" else F.col("close") <= 0
    status = (
        F.when(F.col("close").isNull(), "no_price")
        .when(F.col("figure").isNull(), "no_figure")
        .when(F.col("unit") != "INR_PER_SHARE", "not_in_rupees")
        .when(F.coalesce(fiscal_quarter(F.col("period")), F.lit(-1)) != 0, "not_full_year")
        .when(F.col("first_action").isNotNull(), "action_after_year_end")
        .when(low, "not_positive")
        .otherwise("ok")
    )
    close, figure = F.col("close").cast("double"), F.col("figure").cast("double")
    value = F.round(F.try_divide(close, figure) if kind == "pe" else F.try_divide(figure, close) * 100, 1)
    return rows.withColumn("status", status).select("symbol", "status", F.when(F.col("status") == "ok", value).alias("value"), "period", "first_action")


def snapshot(prices: DataFrame) -> DataFrame:
    """One row for each symbol: latest close, day change, returns, volatility and number of actions."""
    adjusted = adjusted_closes(prices)
    actions = adjusted.groupBy("symbol").agg(F.count("factor").alias("n_actions"))
    out = latest_prices(prices).select("symbol", "trade_date", "close", "day_change")
    return out.join(period_returns(adjusted).drop("last_day"), "symbol").join(volatility(adjusted), "symbol").join(actions, "symbol")


def returns_by_window(prices: DataFrame, months: dict[str, int] = RETURN_MONTHS) -> DataFrame:
    """symbol and returns, a map with every window's name; null under those that the history does not reach or whose base is not positive.

    A symbol without prices is no row; the names of the map are those of months without their prefix, always all of them.
    """
    found = period_returns(adjusted_closes(prices), months)
    pairs = [x for name in months for x in (F.lit(name.removeprefix("return_")), F.col(name))]
    return found.select("symbol", F.create_map(*pairs).alias("returns"))
