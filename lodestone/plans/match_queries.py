"""Queries over matching and the fundamentals card; nations are stocks, with figures from the facts adapter."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import facts as facts_ops
from lodestone.operators import matching as ops
from lodestone.plans.adapters import FACTS_SQL, STOCKS_SQL, facts, stocks
from lodestone.plans.registry import query

PROFILES = [(1, ["avoid_high_debt", "income"]), (2, ["growth", "quality", "value"]), (3, ["conservative", "stability", "long_term", "short_term"]), (4, ["aggressive", "momentum", "short_term"]), (5, []), (6, ["avoid_high_debt", "conservative", "growth", "momentum", "long_term"])]
DOUBLES = ("debt", "dividend", "revenue_growth", "profit_growth", "roe", "pe", "return_6m", "volatility", "p1", "p2", "p3")


def _stock_rows(spark, sf_dir):
    """One row for each stock with all figures that the rules judge; price figures are made from the id."""
    rows, names = facts(spark, sf_dir), stocks(spark, sf_dir)
    debt = facts_ops.debt_to_equity(rows, names).select("stock_id", F.col("status").alias("debt_status"), F.col("value").alias("debt"))
    views = facts_ops.derived_views(rows, names)
    wide = views.groupBy("stock_id").pivot("name", ["revenue_growth", "profit_growth", "latest_dividend"]).agg(F.first("value"))
    chain = facts_ops.growth_chain(rows.where("metric = 'net_profit'")).select("stock_id", F.col("first_value").alias("p1"), F.col("middle_value").alias("p2"), F.col("latest_value").alias("p3"))
    i = F.col("stock_id")
    out = names.join(debt, "stock_id", "left").join(wide, "stock_id", "left").join(chain, "stock_id", "left").withColumnRenamed("latest_dividend", "dividend")
    out = out.withColumns({
        "roe": F.when(i % 4 != 3, i.cast("double")), "pe": F.when(i % 3 == 0, i + 5.0), "pe_status": F.when(i % 3 == 0, "ok").when(i % 3 == 1, "no_figure").otherwise("not_positive"),
        "mood_label": F.when(i % 6 == 1, "negative").otherwise("neutral"), "mood_score": F.when(i % 6 == 1, -0.4), "negative_events": F.transform(F.sequence(F.lit(4), F.lit(1)), lambda x: i * 10 + x),
        "has_prices": i % 7 != 0, "return_6m": F.when(i % 2 == 0, i - 12.0), "volatility": F.when(i % 5 != 4, i * 2.0),
    })
    return out.withColumns({c: F.col(c).cast("double") for c in DOUBLES})


_ROWS_SQL = f"""WITH {FACTS_SQL}, {STOCKS_SQL}, per_source AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stock_id, metric, period, basis, currency, source ORDER BY source_date DESC, id DESC) AS r FROM facts) WHERE r = 1
), pairs AS (
  SELECT l.*, e.value AS prior, row_number() OVER (PARTITION BY l.stock_id, l.metric ORDER BY l.year DESC, l.brank, l.srank, l.crank) AS pick
  FROM per_source l JOIN per_source e ON e.stock_id = l.stock_id AND e.metric = l.metric AND e.source = l.source AND e.basis = l.basis AND e.currency IS NOT DISTINCT FROM l.currency AND e.unit = l.unit AND e.year = l.year - 1
), chains AS (
  SELECT l.stock_id, o.value AS p1, e.value AS p2, l.value AS p3, row_number() OVER (PARTITION BY l.stock_id ORDER BY l.year DESC, l.brank, l.srank, l.crank) AS pick
  FROM per_source l JOIN per_source e ON e.stock_id = l.stock_id AND e.metric = l.metric AND e.source = l.source AND e.basis = l.basis AND e.currency IS NOT DISTINCT FROM l.currency AND e.unit = l.unit AND e.year = l.year - 1
  JOIN per_source o ON o.stock_id = l.stock_id AND o.metric = l.metric AND o.source = l.source AND o.basis = l.basis AND o.currency IS NOT DISTINCT FROM l.currency AND o.unit = l.unit AND o.year = l.year - 2
  WHERE l.metric = 'net_profit'
), debts AS (
  SELECT d.stock_id, d.value AS debt, e.value AS equity, row_number() OVER (PARTITION BY d.stock_id ORDER BY d.year DESC, d.brank) AS pick
  FROM chosen d JOIN chosen e ON d.stock_id = e.stock_id AND d.year = e.year AND d.basis = e.basis AND d.unit = e.unit
  WHERE d.metric = 'total_borrowings' AND e.metric = 'total_equity' AND d.currency = 'INR' AND e.currency = 'INR'
), grown AS (SELECT stock_id, metric, CASE WHEN prior > 0 THEN round(((value - prior) * 100)::DOUBLE / prior::DOUBLE, 1) END AS g FROM pairs WHERE pick = 1
), paid AS (SELECT * FROM (SELECT stock_id, value::DOUBLE AS dividend, row_number() OVER (PARTITION BY stock_id ORDER BY year DESC, crank, brank) AS pick FROM chosen WHERE metric = 'dividend_per_share') WHERE pick = 1
), stock_rows AS (
  SELECT s.stock_id, s.is_financial, CASE WHEN s.is_financial THEN 'not_applicable' WHEN b.equity > 0 THEN 'ok' ELSE 'not_assessable' END AS debt_status,
         CASE WHEN NOT s.is_financial AND b.equity > 0 THEN round(b.debt::DOUBLE / b.equity::DOUBLE, 2) END AS debt, p.dividend,
         r.g AS revenue_growth, n.g AS profit_growth, CASE WHEN s.stock_id % 4 <> 3 THEN s.stock_id::DOUBLE END AS roe,
         CASE WHEN s.stock_id % 3 = 0 THEN s.stock_id + 5.0 END::DOUBLE AS pe, CASE s.stock_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'no_figure' ELSE 'not_positive' END AS pe_status, s.stock_id % 7 <> 0 AS has_prices,
         CASE WHEN s.stock_id % 2 = 0 THEN s.stock_id - 12.0 END::DOUBLE AS return_6m, CASE WHEN s.stock_id % 5 <> 4 THEN s.stock_id * 2.0 END::DOUBLE AS volatility, c.p1::DOUBLE AS p1, c.p2::DOUBLE AS p2, c.p3::DOUBLE AS p3
  FROM stocks s LEFT JOIN debts b ON b.stock_id = s.stock_id AND b.pick = 1 LEFT JOIN paid p ON p.stock_id = s.stock_id
  LEFT JOIN grown r ON r.stock_id = s.stock_id AND r.metric = CASE WHEN s.is_financial THEN 'net_interest_income' ELSE 'revenue_from_operations' END
  LEFT JOIN grown n ON n.stock_id = s.stock_id AND n.metric = 'net_profit' LEFT JOIN chains c ON c.stock_id = s.stock_id AND c.pick = 1
), profiles(profile_id, wanted) AS (VALUES {', '.join(f"({i}, {w}::VARCHAR[])" for i, w in PROFILES)})"""

_JUDGED_SQL = f"""{_ROWS_SQL}, has AS (
  SELECT *, list_contains(wanted, 'avoid_high_debt') AS w_debt, list_contains(wanted, 'conservative') AS w_cons, list_contains(wanted, 'growth') AS w_growth, p1 IS NOT NULL AS chain FROM stock_rows, profiles
), reasons AS (
  SELECT profile_id, stock_id, 'debt' AS criterion, w_debt AS hard, CASE WHEN debt_status = 'not_applicable' THEN 'not_assessable' WHEN debt IS NULL THEN 'no_data' WHEN w_debt AND debt > 1.0 THEN 'fail' WHEN NOT w_cons OR debt <= 0.5 THEN 'pass' ELSE 'miss' END AS outcome FROM has WHERE w_debt OR w_cons
  UNION ALL SELECT profile_id, stock_id, 'dividend', false, CASE WHEN dividend IS NULL THEN 'no_data' WHEN dividend > 0 THEN 'pass' ELSE 'miss' END FROM has WHERE list_contains(wanted, 'income')
  UNION ALL SELECT profile_id, stock_id, 'revenue_growth', false, CASE WHEN revenue_growth IS NULL THEN 'no_data' WHEN revenue_growth >= 10 THEN 'pass' ELSE 'miss' END FROM has WHERE w_growth OR list_contains(wanted, 'aggressive')
  UNION ALL SELECT profile_id, stock_id, 'profit_growth', false, CASE WHEN profit_growth IS NULL THEN 'no_data' WHEN profit_growth >= CASE WHEN w_growth THEN 10 ELSE 0 END THEN 'pass' ELSE 'miss' END FROM has WHERE w_growth OR w_cons OR list_contains(wanted, 'stability')
  UNION ALL SELECT profile_id, stock_id, 'quality', false, CASE WHEN roe IS NULL THEN 'no_data' WHEN roe >= 15 THEN 'pass' ELSE 'miss' END FROM has WHERE list_contains(wanted, 'quality')
  UNION ALL SELECT profile_id, stock_id, 'value', false, CASE WHEN NOT has_prices THEN 'not_assessable' WHEN pe_status = 'no_figure' THEN 'no_data' WHEN pe IS NULL THEN 'not_assessable' WHEN pe <= 20 THEN 'pass' ELSE 'miss' END FROM has WHERE list_contains(wanted, 'value')
  UNION ALL SELECT profile_id, stock_id, 'momentum', false, CASE WHEN return_6m IS NOT NULL THEN CASE WHEN return_6m >= 0 THEN 'pass' ELSE 'miss' END WHEN NOT chain OR p1 <= 0 OR p2 <= 0 THEN 'no_data'
    WHEN round((p3 - p2) / p2 * 100, 1) > round((p2 - p1) / p1 * 100, 1) THEN 'pass' ELSE 'miss' END FROM has WHERE list_contains(wanted, 'momentum')
  UNION ALL SELECT profile_id, stock_id, 'horizon', false, CASE WHEN list_contains(wanted, 'long_term') THEN CASE WHEN NOT chain THEN 'no_data' WHEN p1 <= p2 AND p2 <= p3 THEN 'pass' ELSE 'miss' END WHEN volatility IS NULL THEN 'no_data' WHEN volatility <= 30 THEN 'pass' ELSE 'miss' END
    FROM has WHERE list_contains(wanted, 'long_term') OR list_contains(wanted, 'short_term')
)"""


def _matches(spark, sf_dir):
    profiles = spark.createDataFrame(PROFILES, "profile_id int, wanted array<string>")
    return ops.match_profiles(_stock_rows(spark, sf_dir), profiles)


@query(f"""{_JUDGED_SQL} SELECT h.profile_id, h.stock_id, count(r.outcome) AS n_reasons, coalesce(string_agg(r.criterion || ':' || r.outcome, ',' ORDER BY list_position(['debt','dividend','revenue_growth','profit_growth','quality','value','momentum','horizon'], r.criterion)), '') AS reasons,
  CASE WHEN h.stock_id % 6 = 1 THEN 'sentiment:' || (h.stock_id * 10 + 4) || ',' || (h.stock_id * 10 + 3) || ',' || (h.stock_id * 10 + 2) ELSE '' END AS cautions,
  CASE WHEN any_value(len(wanted)) = 0 THEN 'not_enough_data' WHEN bool_or(outcome = 'fail') THEN 'no_match' WHEN bool_or(hard AND outcome = 'no_data') THEN 'not_enough_data' WHEN NOT bool_or(outcome IN ('pass','miss','fail')) THEN 'not_enough_data'
       WHEN bool_and(outcome IN ('pass','not_assessable')) THEN 'match' ELSE 'partial' END AS status
FROM has h LEFT JOIN reasons r ON r.profile_id = h.profile_id AND r.stock_id = h.stock_id GROUP BY 1, 2""")
def match_profiles(spark, sf_dir):
    """J-18, A-12, R-18, T12, T13: all criteria for all stocks and profiles."""
    shown = F.array_join(F.transform("reasons", lambda r: F.concat(r["criterion"], F.lit(":"), r["outcome"])), ",")
    warned = F.array_join(F.transform("cautions", lambda c: F.concat(c["criterion"], F.lit(":"), F.array_join(c["events"].cast("array<string>"), ","))), ";")
    return _matches(spark, sf_dir).select("profile_id", "stock_id", F.size("reasons").cast("long").alias("n_reasons"), shown.alias("reasons"), warned.alias("cautions"), "status")


@query(f"""{_JUDGED_SQL} SELECT profile_id, criterion, outcome FROM reasons GROUP BY ALL HAVING count(DISTINCT stock_id) = (SELECT count(*) FROM stocks)""")
def shared_reasons(spark, sf_dir):
    """X-07: reasons that every stock shares."""
    return ops.shared_reasons(_matches(spark, sf_dir))


@query(f"""{_ROWS_SQL}, r AS (SELECT stock_id, stock_id * 1000.0::DOUBLE AS market_cap, stock_id * 10.0::DOUBLE AS price, pe, CASE WHEN stock_id % 2 = 0 THEN stock_id * 3.0 END::DOUBLE AS book_value, 1.5::DOUBLE AS dividend_yield, roe, 10.0::DOUBLE AS face_value, debt_status, debt FROM stock_rows),
cells AS (
  SELECT stock_id, debt_status, unnest([1,2,3,4,5,6,7,8,9,10]) AS place, unnest(['market_cap','roe','pe_ttm','eps_ttm','pb','dividend_yield','industry_pe','book_value','debt_to_equity','face_value']) AS name,
    unnest([market_cap, roe, pe, CASE WHEN pe > 0 THEN round(price / pe, 2) END, CASE WHEN book_value > 0 THEN round(price / book_value, 2) END, dividend_yield, NULL, book_value, CASE WHEN debt_status = 'ok' THEN debt END, face_value]) AS value,
    unnest(['INR_CRORE','PERCENT','RATIO','INR_PER_SHARE','RATIO','PERCENT','RATIO','INR_PER_SHARE','RATIO','INR_PER_SHARE']) AS unit FROM r)
SELECT stock_id, place, name, CASE WHEN value IS NOT NULL THEN 'ok' WHEN name = 'debt_to_equity' AND debt_status = 'not_applicable' THEN 'not_applicable' ELSE 'not_available' END AS status, value, unit,
  CASE WHEN value IS NULL THEN 'none' WHEN name IN ('eps_ttm','pb','debt_to_equity') THEN 'computed' ELSE 'page' END AS source FROM cells""")
def fundamentals_card(spark, sf_dir):
    """R-17, M-01: ten values of each stock, unpivoted."""
    i = F.col("stock_id")
    rows = _stock_rows(spark, sf_dir).withColumns({"market_cap": i * 1000.0, "price": i * 10.0, "book_value": F.when(i % 2 == 0, i * 3.0), "dividend_yield": F.lit(1.5), "face_value": F.lit(10.0)})
    return ops.fundamentals_card(rows)
