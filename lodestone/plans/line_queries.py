"""Queries over lines of evidence and tables of years."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import lines as ops
from lodestone.plans.adapters import FACTS_SQL, facts
from lodestone.plans.registry import query
from lodestone.plans.text_queries import grouped_sql
from lodestone.session import table


@query(f"""WITH {FACTS_SQL} SELECT id, 'S' || stock_id || ' · ' || metric || ' · ' || period || ' · ' || basis || ' · ' || rtrim(rtrim(value::DECIMAL(20,4)::VARCHAR, '0'), '.') || '% · ' || source || ' (disputed: another source differs)' AS line FROM facts WHERE unit = 'PERCENT'""")
def fact_lines(spark, sf_dir):
    """Q-23, M-04, M-05: figures as lines of evidence."""
    none = F.lit(None).cast("string")
    line = ops.fact_line(F.concat(F.lit("S"), F.col("stock_id").cast("string")), F.col("metric"), F.col("period"), F.col("basis"), F.col("value"), F.col("unit"), F.col("source"), none, F.lit("disputed"), F.lit(0))
    return facts(spark, sf_dir).where("unit = 'PERCENT'").select("id", line.alias("line"))


@query("SELECT event_id, 'S' || user_id || ' · ' || ts::DATE || ' · ' || event_type || ' · neutral, low impact · s' AS line FROM events")
def event_lines(spark, sf_dir):
    """Q-23: events as lines of evidence."""
    line = ops.event_line(F.concat(F.lit("S"), F.col("user_id").cast("string")), F.to_date("ts"), F.col("event_type"), F.lit("neutral"), F.lit("low"), F.lit("s"))
    return table(spark, sf_dir, "events").select("event_id", line.alias("line"))


@query(f"""SELECT o_orderkey, CASE k WHEN 0 THEN s || ' · share price · ' || d || ' · ₹' || g || ' (' || CASE WHEN change > 0 THEN '+' ELSE '' END || format('{{:.1f}}', change) || '% on the day)'
  WHEN 1 THEN s || ' · share price · ' || d || ' · ₹' || g WHEN 2 THEN s || ' · News sentiment ' || format('{{:.2f}}', score) || ', ' || CASE WHEN score > 0 THEN 'positive' ELSE 'negative' END || ', over ' || n || ' events'
  ELSE s || ' · News sentiment is not known: too few events' END AS line
FROM (SELECT o_orderkey, o_orderkey % 4 AS k, 'C' || o_custkey AS s, (o_orderdate::DATE)::VARCHAR AS d, {grouped_sql('round(o_totalprice, 2)::DECIMAL(20,2)')} AS g, ((o_orderkey % 101) - 50)::DOUBLE / 10 + 0.1 * (o_orderkey % 101 = 50)::INT AS change, ((o_orderkey % 21) - 10.5)::DOUBLE / 10.5 AS score, o_orderkey % 9 AS n FROM orders)""")
def value_lines(spark, sf_dir):
    """Q-23, M-10: prices with and without their change, and sentiment, as lines of evidence."""
    k = F.col("o_orderkey")
    symbol, day = F.concat(F.lit("C"), F.col("o_custkey").cast("string")), F.to_date("o_orderdate")
    change = ((k % 101) - 50).cast("double") / 10 + F.when(k % 101 == 50, 0.1).otherwise(0.0)
    score = ((k % 21) - 10.5).cast("double") / 10.5
    price = lambda moved: ops.price_line(symbol, day, F.round("o_totalprice", 2).cast("decimal(14,2)"), moved)
    mood = lambda value: ops.sentiment_line(symbol, value, F.when(score > 0, "positive").otherwise("negative"), k % 9)
    line = F.when(k % 4 == 0, price(change)).when(k % 4 == 1, price(F.lit(None).cast("double"))).when(k % 4 == 2, mood(score)).otherwise(mood(F.lit(None).cast("double")))
    return table(spark, sf_dir, "orders").select("o_orderkey", line.alias("line"))


@query("""SELECT s_suppkey AS stock_id, CASE s_suppkey % 4 WHEN 0 THEN s_name || ' trades at a P/E of ' || (s_suppkey % 30 + 5) || '.5; whether that is cheap needs a view of its growth and its peers.'
  WHEN 1 THEN s_name || ' has no P/E: no earnings figure is stored.' ELSE s_name || ' has no P/E: its earnings are not positive.' END AS text FROM supplier WHERE s_suppkey % 4 < 3""")
def valuation_claims(spark, sf_dir):
    """Q-18: a claim for each stock with a stored P/E, or with a reason for its lack."""
    i = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(
        i.alias("stock_id"), F.col("s_name").alias("symbol"), F.when(i % 4 == 0, i % 30 + 5.5).alias("pe"), F.when(i % 4 == 1, "no_figure").when(i % 4 == 2, "not_positive").alias("pe_status"), F.lit("M1").alias("evidence_id")
    )
    return ops.valuation_claims(rows).select("stock_id", "text")


@query("""WITH y AS (SELECT o_custkey AS stock_id, year(o_orderdate) AS year, nullif(round(max(o_totalprice) / 100000, 0), 3) AS value FROM orders GROUP BY 1, 2),
l AS (SELECT *, lag(year) OVER w AS py, lag(value) OVER w AS pv FROM y WINDOW w AS (PARTITION BY stock_id ORDER BY year))
SELECT stock_id, year, value, CASE WHEN py = year - 1 AND pv <> 0 THEN round((value - pv) / abs(pv) * 100, 1) END AS change, bool_and(value IS NOT NULL) OVER (PARTITION BY stock_id) AND count(*) OVER (PARTITION BY stock_id) >= 2 AS fits,
  row_number() OVER (PARTITION BY stock_id ORDER BY year DESC) AS place FROM l""")
def yearly_tables(spark, sf_dir):
    """Q-14, W-07, A-12: years with their changes, and whether the table is whole."""
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("stock_id"), F.year("o_orderdate").cast("long").alias("year"))
    values = rows.agg(F.nullif(F.round(F.max("o_totalprice") / 100000, 0), F.lit(3.0)).alias("value"))
    found = ops.yearly_table(values)
    return found.withColumn("place", F.col("place").cast("long"))
