"""Rows written as lines of evidence and as tables: facts, rivals, values, prices, events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as t
from lodestone.operators.rank import consecutive_change

SEPARATOR = " · "


def fact_line(symbol: Column, metric: Column, period: Column, basis: Column, value: Column, unit: Column, source: Column, reported_as: Column, status: Column, n_rivals: Column) -> Column:
    """One figure with all that identifies it; a disputed one without listed rivals says so."""
    called = F.coalesce(F.concat(F.lit(', reported as "'), reported_as, F.lit('"')), F.lit(""))
    disputed = F.when((status == "disputed") & (n_rivals == 0), " (disputed: another source differs)").otherwise("")
    return F.concat(F.concat_ws(SEPARATOR, symbol, metric, period, basis, t.format_amount(value, unit), source), called, disputed)


def event_line(symbol: Column, day: Column, kind: Column, sentiment: Column, impact: Column, summary: Column) -> Column:
    return F.concat_ws(SEPARATOR, symbol, day.cast("string"), kind, F.concat(sentiment, F.lit(", "), impact, F.lit(" impact")), summary)


def price_line(symbol: Column, day: Column, close: Column, change: Column) -> Column:
    moved = F.coalesce(F.concat(F.lit(" ("), t.signed_percent(change), F.lit(" on the day)")), F.lit(""))
    return F.concat(F.concat_ws(SEPARATOR, symbol, F.lit("share price"), day.cast("string"), F.concat(F.lit("₹"), t.indian_grouping(close, 2))), moved)


def sentiment_line(symbol: Column, score: Column, label: Column, n_events: Column) -> Column:
    text = F.concat(F.lit("News sentiment "), F.format_number(score, 2), F.lit(", "), label, F.lit(", over "), n_events.cast("string"), F.lit(" events"))
    return F.when(score.isNull(), F.concat(symbol, F.lit(SEPARATOR + "News sentiment is not known: too few events"))).otherwise(F.concat(symbol, F.lit(SEPARATOR), text))


def valuation_claims(ratios: DataFrame) -> DataFrame:
    """One claim for each stock with a stored P/E (stock_id, symbol, pe, pe_status, evidence_id); without one the reason is the claim."""
    reason = F.when(F.col("pe_status") == "no_figure", "no earnings figure is stored").when(F.col("pe_status") == "not_positive", "its earnings are not positive")
    known = F.concat(F.col("symbol"), F.lit(" trades at a P/E of "), t.plain_decimal(F.round("pe", 2).cast("decimal(12,2)")), F.lit("; whether that is cheap needs a view of its growth and its peers."))
    unknown = F.concat(F.col("symbol"), F.lit(" has no P/E: "), reason, F.lit("."))
    return ratios.where(F.col("pe").isNotNull() | reason.isNotNull()).select("stock_id", F.when(F.col("pe").isNotNull(), known).otherwise(unknown).alias("text"), F.array("evidence_id").alias("citations"))


def yearly_table(series: DataFrame, key: str = "stock_id", year: str = "year", value: str = "value") -> DataFrame:
    """A table of years with the change on the year before, newest first, and whether it fits an answer: all values there, two years at least."""
    rows = consecutive_change(series, key, year, value)
    whole = Window.partitionBy(key)
    fits = F.bool_and(F.col(value).isNotNull()).over(whole) & (F.count(F.lit(1)).over(whole) >= 2)
    return rows.withColumns({"fits": fits, "place": F.row_number().over(whole.orderBy(F.desc(year)))})
