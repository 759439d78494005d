"""Queries over facts: conflict resolution, ratios, growth, views."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import facts as ops
from lodestone.plans.adapters import FACTS_SQL, STOCKS_SQL, facts, stocks
from lodestone.plans.registry import query

_PAIRS_SQL = f"""WITH {FACTS_SQL}, per_source AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stock_id, metric, period, basis, currency, source ORDER BY source_date DESC, id DESC) AS r FROM facts) WHERE r = 1
), pairs AS (
  SELECT l.*, e.value AS prior, e.id AS prior_id, e.period AS prior_period,
         row_number() OVER (PARTITION BY l.stock_id, l.metric ORDER BY l.year DESC, l.brank, l.srank, l.crank) AS pick
  FROM per_source l JOIN per_source e ON e.stock_id = l.stock_id AND e.metric = l.metric AND e.source = l.source AND e.basis = l.basis
       AND e.currency IS NOT DISTINCT FROM l.currency AND e.unit = l.unit AND e.year = l.year - 1
)"""


@query(f"""WITH {FACTS_SQL}
SELECT c.stock_id, c.metric, c.period, c.basis, c.currency, c.id, c.value::DOUBLE AS value, c.source,
       count(o.id) FILTER (WHERE abs(o.value - c.value) <= abs(c.value) * 0.01) AS corroborated_by,
       coalesce(string_agg(o.id::VARCHAR, ',' ORDER BY o.id) FILTER (WHERE abs(o.value - c.value) > abs(c.value) * 0.01), '') AS disagreeing,
       CASE WHEN count(o.id) FILTER (WHERE abs(o.value - c.value) > abs(c.value) * 0.01) > 0 THEN 'disputed' WHEN count(o.id) > 0 THEN 'agreed' ELSE 'single' END AS status
FROM chosen c LEFT JOIN facts o ON o.stock_id = c.stock_id AND o.metric = c.metric AND o.period = c.period AND o.basis = c.basis
     AND o.currency IS NOT DISTINCT FROM c.currency AND o.id <> c.id
GROUP BY ALL""")
def choose_fact(spark, sf_dir):
    """A-04, A-05, A-06, R-01: the ranked winner of each key with its corroboration."""
    found = ops.choose_facts(facts(spark, sf_dir))
    return found.select(
        *ops.KEY, "id", F.col("value").cast("double").alias("value"), "source", F.col("corroborated_by").cast("long").alias("corroborated_by"),
        F.array_join(F.transform("disagreeing", lambda x: x.cast("string")), ",").alias("disagreeing"), "status",
    )


@query(f"""WITH {FACTS_SQL}, {STOCKS_SQL}, pairs AS (
  SELECT d.stock_id, d.year, d.basis, d.value AS debt, e.value AS equity, d.id AS debt_id, e.id AS equity_id,
         row_number() OVER (PARTITION BY d.stock_id ORDER BY d.year DESC, d.brank) AS pick
  FROM chosen d JOIN chosen e ON d.stock_id = e.stock_id AND d.year = e.year AND d.basis = e.basis AND d.unit = e.unit
  WHERE d.metric = 'total_borrowings' AND e.metric = 'total_equity' AND d.currency = 'INR' AND e.currency = 'INR'
)
SELECT s.stock_id, CASE WHEN s.is_financial THEN 'not_applicable' WHEN p.equity > 0 THEN 'ok' ELSE 'not_assessable' END AS status,
       CASE WHEN NOT s.is_financial AND p.equity > 0 THEN round(p.debt::DOUBLE / p.equity::DOUBLE, 2) END AS value, p.year, p.basis,
       CASE WHEN s.is_financial OR p.debt_id IS NULL THEN '' ELSE p.debt_id || ',' || p.equity_id END AS fact_ids
FROM stocks s LEFT JOIN pairs p ON p.stock_id = s.stock_id AND p.pick = 1""")
def debt_to_equity(spark, sf_dir):
    """J-11, A-08, M-01, R-02."""
    found = ops.debt_to_equity(facts(spark, sf_dir), stocks(spark, sf_dir))
    return found.select("stock_id", "status", F.col("value").cast("double").alias("value"), "year", "basis", _ids("fact_ids"))


def _ids(column):
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",").alias(column)


@query(f"""{_PAIRS_SQL}
SELECT stock_id, metric, CASE WHEN prior > 0 THEN 'ok' ELSE 'not_assessable' END AS status,
       CASE WHEN prior > 0 THEN round(((value - prior) * 100)::DOUBLE / prior::DOUBLE, 1) END AS value, prior_period, period, basis, source, prior_id || ',' || id AS fact_ids
FROM pairs WHERE pick = 1""")
def growth_yoy(spark, sf_dir):
    """J-09, A-08, M-02, R-03."""
    found = ops.growth_yoy(facts(spark, sf_dir))
    return found.select("stock_id", "metric", "status", F.col("value").cast("double").alias("value"), "prior_period", "period", "basis", "source", _ids("fact_ids"))


@query(f"""{_PAIRS_SQL}, chains AS (
  SELECT p.*, e.value AS oldest, e.id AS oldest_id, row_number() OVER (PARTITION BY p.stock_id, p.metric ORDER BY p.year DESC, p.brank, p.srank, p.crank) AS chain
  FROM pairs p JOIN per_source e ON e.stock_id = p.stock_id AND e.metric = p.metric AND e.source = p.source AND e.basis = p.basis
       AND e.currency IS NOT DISTINCT FROM p.currency AND e.unit = p.unit AND e.year = p.year - 2
)
SELECT stock_id, metric, year, basis, source, oldest::DOUBLE AS first_value, prior::DOUBLE AS middle_value, value::DOUBLE AS latest_value, oldest_id || ',' || prior_id || ',' || id AS fact_ids
FROM chains WHERE chain = 1""")
def growth_chain(spark, sf_dir):
    """J-10, A-08, R-04."""
    found = ops.growth_chain(facts(spark, sf_dir))
    return found.select("stock_id", "metric", "year", "basis", "source", *[F.col(c).cast("double").alias(c) for c in ("first_value", "middle_value", "latest_value")], _ids("fact_ids"))


@query(f"""WITH {FACTS_SQL}
SELECT stock_id, 'ok' AS status, value::DOUBLE AS value, period, unit, id AS fact_id
FROM (SELECT *, row_number() OVER (PARTITION BY stock_id ORDER BY year DESC, crank, brank) AS pick FROM chosen WHERE metric = 'dividend_per_share') WHERE pick = 1""")
def latest_dividend(spark, sf_dir):
    """R-05."""
    found = ops.latest_dividend(facts(spark, sf_dir))
    return found.select("stock_id", "status", F.col("value").cast("double").alias("value"), "period", "unit", F.element_at("fact_ids", 1).alias("fact_id"))


_KEY_FACTS_SQL = """SELECT stock_id, metric, period, year, basis, currency, id, value,
       row_number() OVER (PARTITION BY stock_id, metric ORDER BY year DESC) AS place
FROM (SELECT *, min(view) OVER (PARTITION BY stock_id, metric) AS v FROM chosen) WHERE view = v QUALIFY place <= 3"""


@query(f"WITH {FACTS_SQL} SELECT stock_id, metric, period, basis, currency, id, value::DOUBLE AS value, place FROM ({_KEY_FACTS_SQL})")
def key_facts_latest_years(spark, sf_dir):
    """W-09, R-12: top rows of the first view that has any."""
    found = ops.key_facts(facts(spark, sf_dir))
    return found.select("stock_id", "metric", "period", "basis", "currency", "id", F.col("value").cast("double").alias("value"), F.col("place").cast("long").alias("place"))


@query(f"""WITH {FACTS_SQL} SELECT stock_id, metric, max(value::DOUBLE) FILTER (WHERE year = 1996) AS fy1996, max(value::DOUBLE) FILTER (WHERE year = 1997) AS fy1997,
       max(value::DOUBLE) FILTER (WHERE year = 1998) AS fy1998 FROM ({_KEY_FACTS_SQL}) GROUP BY 1, 2""")
def pivot_facts(spark, sf_dir):
    """N-09: metric by year."""
    found = ops.pivot_years(facts(spark, sf_dir), [1996, 1997, 1998])
    return found.select("stock_id", "metric", *[F.col(c).cast("double").alias(c) for c in ("fy1996", "fy1997", "fy1998")])


_MEASURE_SQL = f"""WITH {FACTS_SQL}, viewed AS (
  SELECT *, brank + 3 * crank AS view FROM facts
), first_view AS (
  SELECT * FROM (SELECT *, min(view) OVER (PARTITION BY stock_id, metric) AS v FROM viewed) WHERE view = v
), wanted AS (
  SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY stock_id, metric ORDER BY year DESC) AS newest FROM first_view) WHERE newest <= 3
), best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stock_id, metric, year, source ORDER BY source_date DESC, id DESC) AS r FROM wanted) WHERE r = 1
), whole AS (
  SELECT stock_id, metric, min(srank) AS whole FROM (
    SELECT stock_id, metric, srank, count(DISTINCT year) AS have, any_value(n) AS n FROM (
      SELECT *, (SELECT count(DISTINCT year) FROM best b2 WHERE b2.stock_id = b.stock_id AND b2.metric = b.metric) AS n FROM best b) GROUP BY 1, 2, 3) WHERE have = n GROUP BY 1, 2
), picked AS (
  SELECT * FROM (SELECT b.*, row_number() OVER (PARTITION BY b.stock_id, b.metric, b.year ORDER BY (b.srank IS DISTINCT FROM w.whole)::INT, b.srank) AS pick
                 FROM best b LEFT JOIN whole w ON w.stock_id = b.stock_id AND w.metric = b.metric) WHERE pick = 1
), measured AS (
  SELECT p.stock_id, p.metric, p.year, p.period, p.id, p.value, p.source, p.unit, p.basis, p.currency,
         count(o.id) FILTER (WHERE abs(o.value - p.value) <= abs(p.value) * 0.01) AS agreeing,
         count(o.id) FILTER (WHERE abs(o.value - p.value) > abs(p.value) * 0.01) AS n_rivals
  FROM picked p LEFT JOIN best o ON o.stock_id = p.stock_id AND o.metric = p.metric AND o.year = p.year AND o.source <> p.source GROUP BY ALL
)"""


@query(f"""{_MEASURE_SQL} SELECT stock_id, metric, period, id, value::DOUBLE AS value, source, agreeing, n_rivals,
       CASE WHEN n_rivals > 0 THEN 'disputed' WHEN agreeing > 0 THEN 'agreed' ELSE 'single' END AS status FROM measured""")
def measure_one_source(spark, sf_dir):
    """J-17, R-14: relational division over sources, with rivals."""
    found = ops.measure_facts(facts(spark, sf_dir))
    return found.select("stock_id", "metric", "period", "id", F.col("value").cast("double").alias("value"), "source", F.col("agreeing").cast("long").alias("agreeing"), F.size("rival_ids").cast("long").alias("n_rivals"), "status")


@query(f"""{_MEASURE_SQL}, pairs AS (
  SELECT *, lag(value) OVER w AS pv, lag(period) OVER w AS prior_period, lag(source) OVER w AS ps, lag(basis) OVER w AS pb, lag(unit) OVER w AS pu, lag(currency) OVER w AS pc
  FROM measured WINDOW w AS (PARTITION BY stock_id, metric ORDER BY year)
)
SELECT stock_id, metric, prior_period, period, CASE WHEN pv > 0 THEN 'ok' ELSE 'not_assessable' END AS status,
       CASE WHEN pv > 0 THEN round(((value - pv) * 100)::DOUBLE / pv::DOUBLE, 1) END AS value, CASE WHEN pv > 0 THEN (value - pv)::DOUBLE END AS difference
FROM pairs WHERE source = ps AND basis = pb AND unit = pu AND currency IS NOT DISTINCT FROM pc""")
def period_changes(spark, sf_dir):
    """W-08, R-15."""
    found = ops.change_views(ops.measure_facts(facts(spark, sf_dir)))
    return found.select("stock_id", "metric", "prior_period", "period", "status", *[F.col(c).cast("double").alias(c) for c in ("value", "difference")])


@query(f"""WITH {FACTS_SQL}, per_source AS (
  SELECT *, brank + 3 * crank AS view FROM (SELECT *, row_number() OVER (PARTITION BY stock_id, metric, period, basis, currency, source ORDER BY source_date DESC, id DESC) AS r FROM facts) WHERE r = 1 AND metric = 'net_profit'
), sizes AS (SELECT stock_id, view, source, any_value(srank) AS srank, count(*) AS n FROM per_source GROUP BY 1, 2, 3
), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stock_id ORDER BY n DESC, view, srank) AS pick FROM sizes) WHERE pick = 1)
SELECT stock_id, period, value, unit, source FROM (
  SELECT p.stock_id, p.period, p.value::DOUBLE AS value, p.unit, p.source, row_number() OVER (PARTITION BY p.stock_id ORDER BY p.year DESC) AS i
  FROM per_source p JOIN best b ON b.stock_id = p.stock_id AND b.view = p.view AND b.source = p.source) WHERE i <= 10""")
def metric_series(spark, sf_dir):
    """P-05, O-03, R-16: one metric, one source, at most ten years."""
    found = ops.series(facts(spark, sf_dir), "net_profit")
    return found.withColumn("value", F.col("value").cast("double"))


@query(f"""{_PAIRS_SQL}, {STOCKS_SQL}, debt AS (
  SELECT s.stock_id, 1 AS place, 'debt_to_equity' AS name, CASE WHEN s.is_financial THEN 'not_applicable' WHEN p.equity > 0 THEN 'ok' ELSE 'not_assessable' END AS status,
         CASE WHEN NOT s.is_financial AND p.equity > 0 THEN round(p.debt::DOUBLE / p.equity::DOUBLE, 2) END AS value
  FROM stocks s LEFT JOIN (
    SELECT d.stock_id, d.value AS debt, e.value AS equity, row_number() OVER (PARTITION BY d.stock_id ORDER BY d.year DESC, d.brank) AS pick
    FROM chosen d JOIN chosen e ON d.stock_id = e.stock_id AND d.year = e.year AND d.basis = e.basis AND d.unit = e.unit
    WHERE d.metric = 'total_borrowings' AND e.metric = 'total_equity' AND d.currency = 'INR' AND e.currency = 'INR') p ON p.stock_id = s.stock_id AND p.pick = 1
), grown AS (
  SELECT s.stock_id, g.place, g.name, coalesce(CASE WHEN p.prior > 0 THEN 'ok' WHEN p.prior IS NOT NULL THEN 'not_assessable' END, 'not_assessable') AS status,
         CASE WHEN p.prior > 0 THEN round(((p.value - p.prior) * 100)::DOUBLE / p.prior::DOUBLE, 1) END AS value
  FROM stocks s CROSS JOIN (VALUES (2, 'revenue_growth'), (3, 'profit_growth')) g(place, name)
  LEFT JOIN pairs p ON p.stock_id = s.stock_id AND p.pick = 1
       AND p.metric = CASE WHEN g.place = 3 THEN 'net_profit' WHEN s.is_financial THEN 'net_interest_income' ELSE 'revenue_from_operations' END
), paid AS (
  SELECT s.stock_id, 4 AS place, 'latest_dividend' AS name, CASE WHEN d.value IS NULL THEN 'insufficient_data' ELSE 'ok' END AS status, d.value::DOUBLE AS value
  FROM stocks s LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY stock_id ORDER BY year DESC, crank, brank) AS pick FROM chosen WHERE metric = 'dividend_per_share') d ON d.stock_id = s.stock_id AND d.pick = 1
)
SELECT * FROM debt UNION ALL SELECT * FROM grown UNION ALL SELECT * FROM paid""")
def derived_views(spark, sf_dir):
    """R-13, X-01: four derived values of each stock in a fixed order."""
    found = ops.derived_views(facts(spark, sf_dir), stocks(spark, sf_dir))
    return found.select("stock_id", "place", "name", "status", F.col("value").cast("double").alias("value"))


@query(f"""{_PAIRS_SQL}, newest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stock_id, metric ORDER BY year DESC, brank, crank) AS pick FROM chosen) WHERE pick = 1
)
SELECT n.stock_id, n.metric, n.period, n.basis, n.value::DOUBLE AS value, CASE WHEN p.prior > 0 THEN round(((p.value - p.prior) * 100)::DOUBLE / p.prior::DOUBLE, 1) END AS growth
FROM newest n LEFT JOIN pairs p ON p.stock_id = n.stock_id AND p.metric = n.metric AND p.pick = 1""")
def metrics_panel(spark, sf_dir):
    """R-20: the newest year of each metric with its growth."""
    found = ops.metrics_panel(facts(spark, sf_dir))
    return found.withColumns({c: F.col(c).cast("double") for c in ("value", "growth")})
