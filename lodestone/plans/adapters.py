"""Views of the driver tables as the relations that the operators work on, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.periods import fiscal_year_of
from lodestone.session import table

#: Which metric stands for which order priority, and which source for which order status.
PRIORITY_METRIC = {"1-URGENT": "revenue_from_operations", "2-HIGH": "net_profit", "3-MEDIUM": "total_borrowings", "4-NOT SPECIFIED": "total_equity", "5-LOW": "dividend_per_share"}
STATUS_SOURCE = {"F": "annual_report", "O": "screener", "P": "presentation"}


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as facts: a nation is a stock, a priority a metric, a status a source, a segment a basis."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    day = F.to_date("o_orderdate")
    segment = F.col("c_mktsegment")
    metric = F.coalesce(*[F.when(F.col("o_orderpriority") == k, v) for k, v in PRIORITY_METRIC.items()])
    source = F.coalesce(*[F.when(F.col("o_orderstatus") == k, v) for k, v in STATUS_SOURCE.items()], F.lit("announcement"))
    basis = F.when(segment.isin("BUILDING", "AUTOMOBILE"), "consolidated").when(segment.isin("MACHINERY", "HOUSEHOLD"), "standalone").otherwise("unspecified")
    currency = F.when(segment != "FURNITURE", "INR")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    rows = joined.select(
        F.col("c_nationkey").cast("long").alias("stock_id"), metric.alias("metric"), F.concat(F.lit("FY"), fiscal_year_of(day).cast("string")).alias("period"),
        basis.alias("basis"), currency.alias("currency"), source.alias("source"), "o_orderkey", "o_totalprice", day.alias("day"),
    ).where("metric IS NOT NULL")
    return rows.groupBy("stock_id", "metric", "period", "basis", "currency", "source").agg(
        F.min("o_orderkey").alias("id"),
        F.max("day").alias("source_date"),
        (F.round(F.max("o_totalprice") / 200000, 1)).cast("decimal(20,4)").alias("value"),
    ).withColumn("unit", F.when(F.col("currency").isNull(), "PERCENT").when(F.col("metric") == "dividend_per_share", "INR_PER_SHARE").otherwise("INR_CRORE"))


def _case(column: str, values: dict, otherwise: str = "NULL") -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + f" ELSE {otherwise} END"


FACTS_SQL = f"""
fact_rows AS (
  SELECT c_nationkey::BIGINT AS stock_id, {_case('o_orderpriority', PRIORITY_METRIC)} AS metric,
         'FY' || (year(o_orderdate) + (month(o_orderdate) >= 4)::INT) AS period,
         CASE WHEN c_mktsegment IN ('BUILDING','AUTOMOBILE') THEN 'consolidated' WHEN c_mktsegment IN ('MACHINERY','HOUSEHOLD') THEN 'standalone' ELSE 'unspecified' END AS basis,
         CASE WHEN c_mktsegment <> 'FURNITURE' THEN 'INR' END AS currency,
         {_case('o_orderstatus', STATUS_SOURCE, "'announcement'")} AS source, o_orderkey, o_totalprice, o_orderdate::DATE AS day
  FROM orders JOIN customer ON o_custkey = c_custkey
), facts AS (
  SELECT stock_id, metric, period, basis, currency, source, min(o_orderkey) AS id, max(day) AS source_date,
         round(max(o_totalprice) / 200000, 1)::DECIMAL(20,4) AS value,
         CASE WHEN currency IS NULL THEN 'PERCENT' WHEN metric = 'dividend_per_share' THEN 'INR_PER_SHARE' ELSE 'INR_CRORE' END AS unit,
         right(period, 4)::INT AS year,
         CASE source WHEN 'annual_report' THEN 0 WHEN 'screener' THEN 1 WHEN 'presentation' THEN 2 WHEN 'transcript' THEN 3 ELSE 4 END AS srank,
         CASE basis WHEN 'consolidated' THEN 0 WHEN 'standalone' THEN 1 ELSE 2 END AS brank,
         CASE currency WHEN 'INR' THEN 0 WHEN 'USD' THEN 1 ELSE 2 END AS crank
  FROM fact_rows WHERE metric IS NOT NULL
  GROUP BY stock_id, metric, period, basis, currency, source
), ranked AS (
  SELECT *, row_number() OVER w AS rn, first_value(value) OVER w AS best
  FROM facts WINDOW w AS (PARTITION BY stock_id, metric, period, basis, currency ORDER BY srank, source_date DESC NULLS LAST, id DESC
                          ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
), chosen AS (
  SELECT *, brank + 3 * crank AS view FROM ranked WHERE rn = 1
)"""


def stocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as stocks; every fifth one is a financial company."""
    nation = table(spark, sf_dir, "nation")
    return nation.select(F.col("n_nationkey").cast("long").alias("stock_id"), F.col("n_name").alias("symbol"), (F.col("n_nationkey") % 5 == 0).alias("is_financial"))


STOCKS_SQL = "stocks AS (SELECT n_nationkey::BIGINT AS stock_id, n_name AS symbol, n_nationkey % 5 = 0 AS is_financial FROM nation)"


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as daily prices: a priority is a symbol; on the 15th of each quarter's first month a 1:1 bonus.

    prev_close is the close of the day before, halved on the day of a bonus.
    """
    from pyspark.sql import Window

    orders = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderdate", "o_totalprice", "o_orderkey")
    daily = orders.groupBy(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("trade_date")).agg(
        F.min_by("o_totalprice", "o_orderkey").alias("open"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"),
        F.max_by("o_totalprice", "o_orderkey").alias("close"), F.count(F.lit(1)).alias("volume"),
    )
    daily = daily.withColumns({c: F.round(F.col(c), 2).cast("decimal(14,2)") for c in ("open", "high", "low", "close")})
    before = F.coalesce(F.lag("close").over(Window.partitionBy("symbol").orderBy("trade_date")), F.col("close"))
    bonus = (F.dayofmonth("trade_date") == 15) & (F.month("trade_date") % 3 == 1)
    return daily.withColumn("prev_close", F.when(bonus, F.round(before / 2, 2).cast("decimal(14,2)")).otherwise(before))


PRICES_SQL = """
daily AS (
  SELECT o_orderpriority AS symbol, o_orderdate::DATE AS trade_date, arg_min(o_totalprice, o_orderkey) AS o, max(o_totalprice) AS h, min(o_totalprice) AS l,
         round(arg_max(o_totalprice, o_orderkey), 2)::DECIMAL(14,2) AS close, count(*) AS volume
  FROM orders GROUP BY 1, 2
), prices AS (
  SELECT *, CASE WHEN day(trade_date) = 15 AND month(trade_date) % 3 = 1 THEN round(before::DOUBLE / 2, 2)::DECIMAL(14,2) ELSE before END AS prev_close
  FROM (SELECT *, coalesce(lag(close) OVER (PARTITION BY symbol ORDER BY trade_date), close) AS before FROM daily)
), steps AS (
  SELECT *, CASE WHEN lag(close) OVER p > 0 AND abs(prev_close::DOUBLE / lag(close) OVER p - 1) > 0.01
                 THEN round(prev_close::DOUBLE / lag(close) OVER p, 4) END AS factor
  FROM prices WINDOW p AS (PARTITION BY symbol ORDER BY trade_date)
), adjusted AS (
  SELECT *, close::DOUBLE * coalesce(product(coalesce(factor, 1.0)) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1.0) AS adj
  FROM steps
)"""


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as dated signals: a user is a stock, the type gives the sentiment, the value the impact."""
    events = table(spark, sf_dir, "events")
    sentiment = F.when(F.col("event_type") == "error", "negative").when(F.col("event_type").isin("purchase", "signup"), "positive").otherwise("neutral")
    impact = F.when(F.col("value") >= 100, "high").when(F.col("value") >= 30, "medium").otherwise("low")
    return events.select(F.col("event_id").alias("id"), F.col("user_id").alias("stock_id"), "event_type", sentiment.alias("sentiment"), impact.alias("impact"), F.to_date("ts").alias("event_date"))


SIGNALS_SQL = """
signals AS (
  SELECT event_id AS id, user_id AS stock_id, event_type,
         CASE WHEN event_type = 'error' THEN -1 WHEN event_type IN ('purchase','signup') THEN 1 ELSE 0 END AS mood,
         CASE WHEN value >= 100 THEN 3 WHEN value >= 30 THEN 2 ELSE 1 END AS weight, ts::DATE AS event_date
  FROM events
)"""
