"""Queries over answers and their evidence: an answer about each customer, one for each problem code at least, and the orders' own figures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.operators import answers as ops
from lodestone.plans import planted
from lodestone.plans.registry import query
from lodestone.session import spread, table

def _fact(i, period, amount, value, source="filing", rival_of=None, rivals=(), label="Annual report · p. 4", metric="net_profit", called=None):
    return (i, "fact", "{a}", f"{{a}} · {metric} · {period} · consolidated · {amount}", source, label, metric, period, [("{a}", metric, period, "consolidated", value)], rival_of, list(rivals), amount, called)


#: Evidence of every answer; a customer's amount, nation and year are its figures, name and period.
_ITEMS = [
    _fact("F1", "FY{y}", "₹{g} crore", 1200.0, rivals=["F4"], called="PAT"),
    _fact("F2", "FY{p}", "₹1,000 crore", 1000.0),
    _fact("F3", "FY2014", "₹900 crore", 900.0, source="screener", label="screener.in · page"),
    _fact("F4", "FY{y}", "₹{m} crore", 1150.0, source="screener", label="screener.in · page", rival_of="F1"),
    _fact("F5", "FY{y}", "US${n} million", 300.0, metric="revenue"),
    ("D1", "derived", "{a}", "{a} · profit growth · FY{p} to FY{y} · 20.0%", "computed", "Computed value", None, None, [("{a}", "net_profit", "FY{y}", "consolidated", 1200.0)], None, [], None, None),
    ("D2", "derived", "{b}", "Debt to equity does not apply to banks.", "computed", "Computed value", None, None, [], None, [], None, None),
    ("S1", "derived", "{a}", "News sentiment 0.40 over 5 events", "computed", "News sentiment", None, None, [], None, [], None, None),
    ("N1", "passage", "{a}", "Margins of {a} rose because of lower input prices, to 12% in {y}.", "filing", "Transcript · p. 2", None, None, [], None, [], None, None),
]
_CLAIMS = [
    (0, 0, "Net profit of {a} rose 20% to ₹{n} crore in FY{y} [F1, D1].", ["F1", "D1"]),
    (1, 0, "x" * 601, []),
    (2, 0, "See https://example.org for ₹{g} crore.", ["F1", "Z9"]),
    (3, 0, "Net profit was ₹{m} crore.", ["F1"]),
    (4, 0, "Revenue was ₹{n} crore in FY{y}.", ["F5"]),
    (5, 0, "Net profit went from ₹900 crore to ₹1,000 crore.", ["F2", "F3"]),
    (6, 0, "Net profit rose 20% due to demand.", ["D1"]),
    (6, 1, "Margins rose because of prices.", ["N1"]),
    (7, 0, "News sentiment of 0.40 confirms the results.", ["S1"]),
    (8, 0, "Profit growth was strong.", ["F1", "D1"]),
    (9, 0, "Net profit was ₹{g} crore.", ["F1"]),
    (9, 1, "Another figure is ₹{m} crore.", ["F4"]),
    (10, 0, "Net profit was ₹{g} crore, ₹1,000 crore and 20%, by 12% in {y} and 0.40.", ["F1", "F2", "D1", "D2", "S1", "N1"]),
    (11, 0, "It does not apply to banks.", ["D2"]),
    (13, 0, "In {y} net profit was ₹{g} crore, and in 2098 it will be more.", ["F1", "F1"]),
    (14, 0, "Net profit was ₹{m} crore.", ["F4"]),
    (14, 1, "Net profit grew 20%.", ["D1"]),
]
_PROBLEMS = [
    (1, 0, "claim_too_long"), (1, 0, "uncited_claim"), (2, 0, "url_in_answer"), (2, 0, "unknown_citation"), (3, 0, "number_not_in_evidence"), (4, 0, "currency_mismatch"), (5, 0, "mixed_sources"),
    (6, 0, "cause_without_source"), (7, 0, "sentiment_as_evidence"), (8, 0, "figure_missing"), (10, 0, "too_many_citations"), (12, -1, "no_claims"), (13, 0, "number_not_in_evidence"), (14, 1, "conflicting_figures"),
]
_ANSWERS = 15


def _evidence(spark, sf_dir, key):
    """Nine items for each customer."""
    names = "id string, kind string, symbol string, text string, source string, label string, metric string, period string, value double, rival_of string, rivals array<string>, amount string, reported_as string, place int"
    flat = [(*item[:8], item[8][0][4] if item[8] else None, *item[9:], n) for n, item in enumerate(_ITEMS)]
    rows = planted.cases(spark, sf_dir, flat, names.replace("id string", "item string", 1), whole=True)
    figure = F.array(F.struct("symbol", F.coalesce("metric", F.lit("net_profit")).alias("metric"), F.coalesce("period", F.regexp_extract("text", "to (FY[0-9]{4})", 1)).alias("period"), F.lit("consolidated").alias("basis"), "value"))
    figures = F.when(F.col("value").isNotNull(), figure).otherwise(F.array().cast("array<struct<symbol:string,metric:string,period:string,basis:string,value:double>>"))
    return rows.withColumn("figures", figures).withColumnRenamed("id", key).withColumnRenamed("item", "id").drop("value")


def _answers(spark, sf_dir):
    made = spark.createDataFrame(_CLAIMS, "case int, claim int, text string, citations array<string>")
    rows = planted.rows(spark, sf_dir)
    claims = rows.join(F.broadcast(made), F.col("id") % _ANSWERS == F.col("case")).select(F.col("id").alias("answer_id"), "claim", planted.filled(F.col("text")).alias("text"), "citations")
    return rows.select(F.col("id").alias("answer_id")), claims, _evidence(spark, sf_dir, "answer_id")


@query(planted.cases_sql(_PROBLEMS, "claim, code", "id AS answer_id, claim, code", _ANSWERS))
def claim_check(spark, sf_dir):
    """Q-09, Q-10, X-04, A-16, A-17: every problem of an answer about each customer, whose figures are the customer's own; all thirteen codes occur."""
    return ops.check_answers(*_answers(spark, sf_dir)).select("answer_id", "claim", "code")


@query("""WITH o AS (SELECT o_orderkey, o_custkey, 1000 + floor(o_totalprice / 25000)::BIGINT AS v, lag(o_orderkey) OVER w AS before, lead(o_orderkey) OVER w AS after FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
c AS (SELECT o_custkey, o_orderkey, v, unnest([before, after]) AS cited FROM o)
SELECT c.o_custkey AS answer_id, c.o_orderkey AS claim, CASE WHEN count(e.v) FILTER (WHERE e.v = c.v) = 0 THEN 'number_not_in_evidence' ELSE 'currency_mismatch' END AS code
FROM c JOIN o e ON e.o_orderkey = c.cited GROUP BY ALL
HAVING count(e.v) FILTER (WHERE e.v = c.v) = 0 OR (c.o_orderkey % 2 = 0 AND count(*) FILTER (WHERE e.v = c.v AND e.o_orderkey % 2 = 0) = 0) OR (c.o_orderkey % 2 = 1 AND count(*) FILTER (WHERE e.v = c.v AND e.o_orderkey % 2 = 1) = 0)""")
def figures_of_orders(spark, sf_dir):
    """Q-09, Q-10, X-04: each order states its amount, in dollars or rupees, and cites the orders of its customer before and after it, which may have the same amount, or not, or in the other currency."""
    at = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    value = (1000 + F.floor(F.col("o_totalprice") / 25000)).cast("string")
    money = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("US$"), value, F.lit(" million"))).otherwise(F.concat(F.lit("₹"), value, F.lit(" crore")))
    near = F.filter(F.array(F.lag("o_orderkey").over(at), F.lead("o_orderkey").over(at)), lambda x: x.isNotNull())
    # Dealt anew after the window: what costs is to write and read the texts.
    placed = spread(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", near.alias("near")), 100_000)
    orders = placed.select(F.col("o_custkey").alias("answer_id"), F.col("o_orderkey").alias("claim"), F.concat(F.lit("The order came to "), money, F.lit(".")).alias("text"), F.transform("near", lambda k: F.concat(F.lit("P"), k.cast("string"))).alias("citations"))
    null = lambda kind: F.lit(None).cast(kind)
    evidence = orders.select(
        "answer_id", F.concat(F.lit("P"), F.col("claim").cast("string")).alias("id"), F.lit("passage").alias("kind"), "text", F.lit("filing").alias("source"), F.lit("Order").alias("label"), null("string").alias("metric"), null("string").alias("period"),
        F.array().cast("array<struct<symbol:string,metric:string,period:string,basis:string,value:double>>").alias("figures"), null("string").alias("rival_of"),
    )
    found = ops.check_answers(orders.select("answer_id").distinct(), orders, evidence)
    return found.where(F.col("code").isin("number_not_in_evidence", "currency_mismatch")).select("answer_id", "claim", "code")


_DISCLOSED = 'screener.in gives ₹{m} crore for FY{y}, against ₹{g} crore in the annual report (reported as "PAT").'


@query(planted.cases_sql([(i, "F4", _DISCLOSED) for i in (0, 2, 3, 8, 10, 13)], "rival_id, text", "id AS answer_id, rival_id, text", _ANSWERS))
def answer_disclosures(spark, sf_dir):
    """Q-11: rivals of cited figures that the answer does not cite."""
    _, claims, evidence = _answers(spark, sf_dir)
    return ops.disclosures(claims, evidence)


@query(f"SELECT c_custkey AS answer_id FROM customer WHERE c_custkey % {_ANSWERS} NOT IN (9, 14)")
def every_disclosure(spark, sf_dir):
    """Q-11: for a question about sources, every rival that is not cited."""
    _, claims, evidence = _answers(spark, sf_dir)
    return ops.disclosures(claims, evidence, every=True).select("answer_id")


_RENDERED = [
    (0, "Net profit of {a} rose 20% to ₹{n} crore in FY{y}. [1][2]", "Annual report · p. 4|Computed value"), (5, "Net profit went from ₹900 crore to ₹1,000 crore. [1][2]", "Annual report · p. 4|screener.in · page"),
    (6, "Net profit rose 20% due to demand. [1] Margins rose because of prices. [2]", "Computed value|Transcript · p. 2"), (9, "Net profit was ₹{g} crore. [1] Another figure is ₹{m} crore. [2]", "Annual report · p. 4|screener.in · page"),
    (13, "In {y} net profit was ₹{g} crore, and in 2098 it will be more. [1]", "Annual report · p. 4"),
]


@query(planted.cases_sql(_RENDERED, "answer, sources", "id AS answer_id, answer, sources", _ANSWERS))
def rendered_answers(spark, sf_dir):
    """Q-12, W-16, T-24: claims as one text with markers numbered by first use, and the sources in that order."""
    _, claims, evidence = _answers(spark, sf_dir)
    found = ops.render(claims.where((F.col("answer_id") % _ANSWERS).isin(*[r[0] for r in _RENDERED])), evidence)
    return found.select("answer_id", "answer", F.array_join("sources", "|").alias("sources"))


@query(f"SELECT c_custkey AS answer_id, c_custkey % {_ANSWERS} = 6 AS explained FROM customer WHERE c_custkey % {_ANSWERS} <> 12")
def explained_answers(spark, sf_dir):
    """Q-20: answers with a cause that cites a passage or an event."""
    _, claims, evidence = _answers(spark, sf_dir)
    return ops.explained(claims, evidence)


_ASKED = [(["{a}"], ["net_profit"], ["FY{p}", "FY{y}"]), (["{a}", "{b}"], ["net_profit", "revenue"], []), (["{a}"], ["net_profit"], ["FY2090"]), (["{b}"], ["eps"], [])]


def _asked(spark, sf_dir):
    made = spark.createDataFrame([(i, *r) for i, r in enumerate(_ASKED)], "case int, symbols array<string>, metrics array<string>, periods array<string>")
    joined = planted.rows(spark, sf_dir).join(F.broadcast(made), F.col("id") % len(_ASKED) == F.col("case"))
    fill = lambda c: F.transform(c, lambda x: planted.filled(x))
    return joined.select(F.col("id").alias("question_id"), fill("symbols").alias("symbols"), "metrics", fill("periods").alias("periods")), _evidence(spark, sf_dir, "question_id")


@query(planted.cases_sql([(0, 1, "F2", "₹1,000 crore"), (0, 2, "F1", "₹{g} crore"), (1, 1, "F1", "₹{g} crore"), (1, 2, "F5", "US${n} million")], "claim, citation, amount", "id AS question_id, claim, citation, amount", len(_ASKED)))
def lookup_answers(spark, sf_dir):
    """Q-08: figures stated by code; a question with a period that is not stored is not answered so."""
    return ops.lookup_claims(*_asked(spark, sf_dir)).select("question_id", "claim", "citation", "amount")


@query(planted.cases_sql([(1, "{b}", "net_profit"), (1, "{b}", "revenue"), (3, "{b}", "eps")], "symbol, metric", "id AS question_id, symbol, metric", len(_ASKED)))
def missing_lines(spark, sf_dir):
    """Q-13: what was asked and is not there, read off the bits of what is."""
    return ops.missing_lines(*_asked(spark, sf_dir), ["net_profit", "revenue", "eps", "debt"])


@query(planted.cases_sql([("N1", "<passage>[N1] Margins of {a} rose because of lower input prices, to 12% in {y}.</passage>", "[F1] {a} · net_profit · FY{y} · consolidated · ₹{g} crore")], "last, line, first", "id AS question_id, 9 AS n_lines, last, line, first"))
def evidence_blocks(spark, sf_dir):
    """Q-24, T-23: own lines first, untrusted ones wrapped at the end."""
    found = ops.evidence_block(_evidence(spark, sf_dir, "question_id"))
    lines = F.split("block", "\n")
    last = F.element_at(lines, -1)
    return found.select("question_id", F.size(lines).alias("n_lines"), F.regexp_extract(last, r"^<passage>\[(\w+)\].*</passage>$", 1).alias("last"), last.alias("line"), F.get(lines, 0).alias("first"))


_EVIDENCE_SQL = """e AS (SELECT o_custkey AS question_id, CASE WHEN o_orderstatus = 'F' THEN 'fact' WHEN o_orderstatus = 'O' THEN 'passage' ELSE 'event' END AS kind, (o_orderkey % 3)::INT AS grp, o_orderkey AS place FROM orders),
d AS (SELECT *, row_number() OVER (PARTITION BY question_id, kind, grp ORDER BY place) AS depth FROM e), t AS (SELECT *, row_number() OVER (PARTITION BY question_id, kind ORDER BY depth, grp) AS turn FROM d),
k AS (SELECT * FROM t WHERE turn <= CASE kind WHEN 'fact' THEN 30 WHEN 'passage' THEN 8 ELSE 10 END)"""


@query(f"WITH {_EVIDENCE_SQL} SELECT question_id, place, CASE kind WHEN 'fact' THEN 'F' WHEN 'passage' THEN 'N' ELSE 'E' END || row_number() OVER (PARTITION BY question_id, kind ORDER BY grp, place) AS id FROM k")
def built_evidence(spark, sf_dir):
    """Q-07, X-01, W-14: evidence of three kinds, each capped round-robin over its groups and numbered."""
    kind = F.when(F.col("o_orderstatus") == "F", "fact").when(F.col("o_orderstatus") == "O", "passage").otherwise("event")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("question_id"), kind.alias("kind"), (F.col("o_orderkey") % 3).cast("int").alias("group"), F.col("o_orderkey").alias("place"))
    return ops.build_evidence(rows, {"fact": 30, "passage": 8, "event": 10}, {"fact": "F", "passage": "N", "event": "E"}).select("question_id", "place", "id")
