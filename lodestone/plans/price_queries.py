"""Queries over daily prices and dated signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import prices as ops
from lodestone.operators.asof import asof_join
from lodestone.operators.decay import sliding_decayed
from lodestone.operators.dims import IMPACT_WEIGHT, SENTIMENT_VALUE, lookup
from lodestone.operators.sentiment import recent_events as newest_events
from lodestone.operators.sentiment import rolling_sentiment as decayed
from lodestone.plans.adapters import PRICES_SQL, SIGNALS_SQL, prices, signals
from lodestone.plans.registry import query
from lodestone.session import table

AS_OF = "2024-01-31"


@query(f"WITH {PRICES_SQL} SELECT symbol, trade_date, factor FROM steps WHERE factor IS NOT NULL")
def corporate_actions(spark, sf_dir):
    """W-01, R-07."""
    return ops.corporate_actions(prices(spark, sf_dir))


@query(f"WITH {PRICES_SQL} SELECT symbol, trade_date, close::DOUBLE AS close, round(adj, 6) AS adjusted FROM adjusted")
def adjusted_closes(spark, sf_dir):
    """W-02, R-07: reverse cumulative product."""
    return ops.adjusted_closes(prices(spark, sf_dir)).select("symbol", "trade_date", F.col("close").cast("double").alias("close"), F.round("adjusted", 6).alias("adjusted"))


_LAST_SQL = "last AS (SELECT symbol, max(trade_date) AS d, arg_max(adj, trade_date) AS a FROM adjusted GROUP BY 1)"


_RETURNS_SQL = f"""WITH {PRICES_SQL}, {_LAST_SQL}, bases AS (
  SELECT a.symbol, m.months, arg_max(a.adj, a.trade_date) AS base
  FROM adjusted a JOIN last USING (symbol) CROSS JOIN (VALUES (1), (3), (6), (12)) m(months)
  WHERE a.trade_date <= (last.d - to_months(m.months))::DATE GROUP BY 1, 2
)
SELECT last.symbol, last.d AS last_day,
       max(CASE WHEN months = 1 AND base > 0 THEN round((a / base - 1) * 100, 1) END) AS return_1m, max(CASE WHEN months = 3 AND base > 0 THEN round((a / base - 1) * 100, 1) END) AS return_3m,
       max(CASE WHEN months = 6 AND base > 0 THEN round((a / base - 1) * 100, 1) END) AS return_6m, max(CASE WHEN months = 12 AND base > 0 THEN round((a / base - 1) * 100, 1) END) AS return_1y
FROM last LEFT JOIN bases USING (symbol) GROUP BY last.symbol, last.d"""


@query(_RETURNS_SQL)
def period_returns(spark, sf_dir):
    """J-12, D-07, W-05, R-08: backward as-of joins."""
    return ops.period_returns(ops.adjusted_closes(prices(spark, sf_dir)))


@query(f"SELECT symbol, name, CASE name WHEN '1m' THEN return_1m WHEN '3m' THEN return_3m WHEN '6m' THEN return_6m ELSE return_1y END AS value FROM ({_RETURNS_SQL}), (VALUES ('1m'), ('3m'), ('6m'), ('1y')) n(name)")
def returns_by_window(spark, sf_dir):
    """N-07: the returns of a symbol as one map by the window's name; all names are there, whatever the history."""
    return ops.returns_by_window(prices(spark, sf_dir)).select("symbol", F.explode("returns").alias("name", "value"))


_VOLATILITY_SQL = f"""{_LAST_SQL}, recent AS (
  SELECT a.symbol, a.adj / lag(CASE WHEN a.adj > 0 THEN a.adj END) OVER (PARTITION BY a.symbol ORDER BY a.trade_date) - 1 AS r
  FROM adjusted a JOIN last USING (symbol) WHERE a.trade_date >= last.d - 365
), vols AS (SELECT symbol, count(r) AS n_returns, CASE WHEN count(r) >= 60 THEN round(stddev_samp(r) * sqrt(252.0) * 100, 1) END AS volatility FROM recent GROUP BY 1)"""


@query(f"WITH {PRICES_SQL}, {_VOLATILITY_SQL} SELECT * FROM vols")
def volatility(spark, sf_dir):
    """W-03, A-10, R-09."""
    return ops.volatility(ops.adjusted_closes(prices(spark, sf_dir)))


@query(f"""WITH {PRICES_SQL} SELECT symbol, trade_date, close::DOUBLE AS close, prev_close::DOUBLE AS prev_close, CASE WHEN prev_close > 0 THEN round((close::DOUBLE / prev_close::DOUBLE - 1) * 100, 1) END AS day_change
FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS i FROM prices) WHERE i = 1""")
def day_change(spark, sf_dir):
    """W-04, W-06."""
    found = ops.latest_prices(prices(spark, sf_dir))
    return found.withColumns({c: F.col(c).cast("double") for c in ("close", "prev_close")})


@query(f"""WITH {PRICES_SQL}, {_VOLATILITY_SQL} SELECT last.symbol, last.d AS trade_date, count(factor) AS n_actions, any_value(v.n_returns) AS n_returns, any_value(v.volatility) AS volatility
FROM last JOIN adjusted a USING (symbol) JOIN vols v USING (symbol) GROUP BY 1, 2""")
def price_snapshot(spark, sf_dir):
    """R-11: one row for each symbol."""
    return ops.snapshot(prices(spark, sf_dir)).select("symbol", "trade_date", "n_actions", "n_returns", "volatility")


def _figures(spark):
    rows = [("1-URGENT", "FY1997", "INR_PER_SHARE", 5000.0), ("2-HIGH", "FY2001", "INR_PER_SHARE", 4000.0), ("3-MEDIUM", "Q3FY2001", "INR_PER_SHARE", 10.0), ("4-NOT SPECIFIED", "FY2001", "USD_PER_SHARE", 3.0), ("NOWHERE", "FY2001", "INR_PER_SHARE", 1.0)]
    return spark.createDataFrame(rows, "symbol string, period string, unit string, value double")


_RATIO_SQL = f"""WITH {PRICES_SQL}, figures(symbol, period, unit, figure) AS (VALUES ('1-URGENT','FY1997','INR_PER_SHARE',5000.0::DOUBLE), ('2-HIGH','FY2001','INR_PER_SHARE',4000.0), ('3-MEDIUM','Q3FY2001','INR_PER_SHARE',10.0), ('4-NOT SPECIFIED','FY2001','USD_PER_SHARE',3.0), ('NOWHERE','FY2001','INR_PER_SHARE',1.0)),
latest AS (SELECT symbol, arg_max(close, trade_date)::DOUBLE AS close FROM prices GROUP BY 1),
joined AS (
  SELECT coalesce(l.symbol, f.symbol) AS symbol, l.close, f.period, f.unit, f.figure,
         (SELECT min(trade_date) FROM steps s WHERE s.symbol = f.symbol AND s.factor IS NOT NULL AND s.trade_date > make_date(right(f.period, 4)::INT, 3, 31)) AS first_action
  FROM latest l FULL JOIN figures f ON l.symbol = f.symbol
), judged AS (
  SELECT *, CASE WHEN close IS NULL THEN 'no_price' WHEN figure IS NULL THEN 'no_figure' WHEN unit <> 'INR_PER_SHARE' THEN 'not_in_rupees' WHEN NOT starts_with(period, 'FY') THEN 'not_full_year'
                 WHEN first_action IS NOT NULL THEN 'action_after_year_end' WHEN {{low}} THEN 'not_positive' ELSE 'ok' END AS status FROM joined
)
SELECT symbol, status, CASE WHEN status = 'ok' THEN round({{value}}, 1) END AS value, period, first_action FROM judged"""


@query(_RATIO_SQL.format(low="figure <= 0", value="close / figure"))
def pe_ratio(spark, sf_dir):
    """R-10: price to earnings with its reasons."""
    rows = prices(spark, sf_dir)
    return ops.per_share_ratio(ops.latest_prices(rows), _figures(spark), ops.corporate_actions(rows), "pe")


@query(_RATIO_SQL.format(low="close <= 0", value="figure / close * 100"))
def dividend_yield(spark, sf_dir):
    """R-10: dividend yield with its reasons."""
    rows = prices(spark, sf_dir)
    return ops.per_share_ratio(ops.latest_prices(rows), _figures(spark), ops.corporate_actions(rows), "yield")


@query(f"""WITH {SIGNALS_SQL}, s AS (
  SELECT stock_id, count(*) AS n_events, sum(weight * pow(0.5, date_diff('day', event_date, DATE '{AS_OF}') / 90.0) * mood) / sum(weight * pow(0.5, date_diff('day', event_date, DATE '{AS_OF}') / 90.0)) AS raw
  FROM signals WHERE date_diff('day', event_date, DATE '{AS_OF}') BETWEEN 0 AND 365 GROUP BY 1
), r AS (SELECT *, CASE WHEN n_events >= 3 THEN round(raw, 2) + 0.0 END AS score FROM s)
SELECT stock_id, CASE WHEN n_events >= 3 THEN 'ok' ELSE 'insufficient_data' END AS status, score,
       CASE WHEN score <= -0.25 THEN 'negative' WHEN score >= 0.25 THEN 'positive' WHEN score IS NOT NULL THEN 'mixed' END AS label, n_events FROM r""")
def rolling_sentiment(spark, sf_dir):
    """A-09, M-03, M-07, P-14, R-06, Z-12."""
    return decayed(signals(spark, sf_dir), AS_OF).drop("event_ids")


@query(f"""WITH {SIGNALS_SQL} SELECT stock_id, id, event_date, event_type, i AS place FROM (SELECT *, row_number() OVER (PARTITION BY stock_id ORDER BY event_date DESC, id DESC) AS i FROM signals) WHERE i <= 10""")
def recent_events(spark, sf_dir):
    """O-07."""
    return newest_events(signals(spark, sf_dir)).select("stock_id", "id", "event_date", "event_type", F.col("place").cast("long").alias("place"))


@query("""WITH days AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders WHERE o_orderpriority = '1-URGENT'),
span AS (SELECT unnest(generate_series(min(d), max(d), INTERVAL 1 DAY))::DATE AS day FROM days)
SELECT day FROM span WHERE isodow(day) < 6 AND day NOT IN (DATE '1997-01-01', DATE '1997-12-25') AND day NOT IN (SELECT d FROM days)""")
def trading_days_missing(spark, sf_dir):
    """S-13, J-06, D-08: generated days without prices."""
    from lodestone.functions.periods import is_trading_day

    days = prices(spark, sf_dir).where("symbol = '1-URGENT'").select("trade_date")
    span = days.agg(F.min("trade_date").alias("a"), F.max("trade_date").alias("b")).select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("day"))
    holidays = F.array(*[F.to_date(F.lit(x)) for x in ("1997-01-01", "1997-12-25")])
    return span.where(is_trading_day(F.col("day"), holidays)).join(days, F.col("day") == F.col("trade_date"), "left_anti")


@query(f"""WITH {PRICES_SQL} SELECT symbol, trade_date, round((close::DOUBLE - min(close::DOUBLE) OVER w) / (max(close::DOUBLE) OVER w - min(close::DOUBLE) OVER w), 6) AS height
FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS i FROM prices) WHERE i <= 90 WINDOW w AS (PARTITION BY symbol)""")
def sparkline(spark, sf_dir):
    """M-09: closes of the last ninety rows scaled to 0..1."""
    from pyspark.sql import Window

    from lodestone.operators.rank import top_n_per_group

    rows = top_n_per_group(prices(spark, sf_dir), ["symbol"], [F.desc("trade_date")], 90).withColumn("close", F.col("close").cast("double"))
    low, high = (f("close").over(Window.partitionBy("symbol")) for f in (F.min, F.max))
    return rows.select("symbol", "trade_date", F.round((F.col("close") - low) / F.nullif(high - low, F.lit(0.0)), 6).alias("height"))


@query(f"""WITH {PRICES_SQL}, t AS (SELECT o_orderkey, o_orderpriority AS symbol, o_orderdate::DATE - (o_orderkey % 400)::INT AS target FROM orders)
SELECT t.o_orderkey, CASE WHEN target - trade_date <= 30 THEN trade_date END AS trade_date, CASE WHEN target - trade_date <= 30 THEN close::DOUBLE END AS close FROM t ASOF LEFT JOIN prices p ON t.symbol = p.symbol AND t.target >= p.trade_date""")
def closes_as_of(spark, sf_dir):
    """J-12: the last close at or before a day of each order, at most 30 days before it; five hot symbols, split by years."""
    day = F.date_sub(F.to_date("o_orderdate"), (F.col("o_orderkey") % 400).cast("int"))
    targets = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("symbol"), day.alias("target"))
    closes = prices(spark, sf_dir).select("symbol", "trade_date", F.col("close").cast("double").alias("close"))
    return asof_join(targets, closes, ["symbol"], "target", "trade_date", 365 * 86_400, 30 * 86_400).select("o_orderkey", "trade_date", "close")


@query("""WITH p AS (SELECT user_id, ts, max(event_id) AS purchase_id FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT e.event_id, p.purchase_id FROM events e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts > p.ts""")
def purchases_before_events(spark, sf_dir):
    """J-12: the purchase before each event of a user, strictly, of two at one moment that with the larger id."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    bought = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("user_id", F.col("ts").cast("timestamp").alias("bought"), F.col("event_id").alias("purchase_id"))
    return asof_join(events, bought, ["user_id"], "ts", "bought", 3 * 86_400, order=["purchase_id"], strict=True).select("event_id", "purchase_id")


@query(f"""WITH {SIGNALS_SQL}, d AS (SELECT DISTINCT stock_id, event_date AS day FROM signals), w(days, half) AS (VALUES (365, 90.0), (9, 3.0))
SELECT d.stock_id, d.day, w.days, count(*) AS n, round(sum(s.weight * s.mood * pow(0.5, (d.day - s.event_date) / half)) / sum(s.weight * pow(0.5, (d.day - s.event_date) / half)), 6) + 0.0 AS mean
FROM d JOIN signals s USING (stock_id), w WHERE d.day - s.event_date BETWEEN 0 AND w.days GROUP BY 1, 2, 3""")
def sliding_sentiment(spark, sf_dir):
    """Z-12, A-09, M-03: decayed sentiment of each stock at each of its days, over windows of a year and of nine days, from daily sums that merge."""
    rows = signals(spark, sf_dir).withColumns({"value": lookup(F.col("sentiment"), SENTIMENT_VALUE), "weight": lookup(F.col("impact"), IMPACT_WEIGHT)})
    found = [sliding_decayed(rows, "stock_id", "event_date", "value", "weight", days, half).withColumn("days", F.lit(days)) for days, half in ((365, 90.0), (9, 3.0))]
    return found[0].unionByName(found[1]).select("stock_id", "day", "days", "n", (F.round("mean", 6) + F.lit(0.0)).alias("mean"))
