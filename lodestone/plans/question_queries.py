"""Queries over questions, preferences, nested forms and exchanges: texts with facts of each customer planted in them, and given rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import text as t
from lodestone.operators import forms, merge, names
from lodestone.operators import questions as ops
from lodestone.operators import retrieval
from lodestone.plans import planted
from lodestone.plans.registry import query
from lodestone.session import spread, table

_QUESTIONS = [
    ("What was the net profit of {a} in FY{y}?", "{a}", "net_profit", "FY{y}", "fact_lookup", "code"),
    ("Compare the revenue and debt of {b} and {a} over the last 3 years", "{b},{a}", "revenue_from_operations,total_borrowings", "", "comparison", "retrieve"),
    ("Why did margins of {b} fall in Q3 FY{z} and FY {p}-{z}?", "{b}", "net_interest_margin", "Q3FY{y},FY{y}", "explanation", "retrieve"),
    ("Do you remember my preferences?", "", "", "", "memory_read", "memory"),
    ("Will {a}'s price rise next year?", "{a}", "", "", "future_unsupported", "refuse"),
    ("What is {e}gamma Motors worth?", "", "", "", "unsupported_company", "retrieve"),
    ("What is the return on equity?", "", "return_on_equity", "", "which_company", "ask"),
    ("Is {a} undervalued?", "{a}", "", "", "valuation", "retrieve"),
    ("Where did you get that?", "", "", "", "source_request", "replay"),
    ("Which of them suits me?", "", "", "", "personalized", "retrieve"),
    ("Any inconsistencies in the sales of {a}?", "{a}", "revenue_from_operations", "", "source_conflict", "retrieve"),
    ("Calculate the dividend cover of {a}", "{a}", "dividend_per_share", "", "calculation", "retrieve"),
    ("How did sales of {a} grow? Not those of x{b}.", "{a}", "revenue_from_operations", "", "trend", "retrieve"),
    ("Latest news on {b}", "{b}", "", "", "news", "retrieve"),
    ("Tell me about the share price of {a}", "{a}", "", "", "price", "retrieve"),
    ("How much did {a} have?", "{a}", "", "", "which_measure", "ask"),
    ("{a} Holdings in general", "{a} Holdings", "", "", "general", "retrieve"),
    ("What was said in the earnings call of {a} for FY{z}?", "{a}", "", "FY{y}", "which_measure", "ask"),
]


def _aliases(spark, sf_dir):
    """Nations as companies, and every one as a group of that name."""
    name = F.initcap("n_name")
    nations = table(spark, sf_dir, "nation").select(name.alias("symbol"), F.explode(F.array(F.lit(""), F.lit(" Holdings"))).alias("_more"))
    return nations.select(F.concat("symbol", "_more").alias("symbol"), F.concat(F.lower("symbol"), "_more").alias("alias"))


def _understood(spark, sf_dir):
    asked = planted.cases(spark, sf_dir, [q[:1] for q in _QUESTIONS], "text string").withColumnRenamed("id", "question_id")
    return ops.understand(asked, _aliases(spark, sf_dir))


@query(planted.cases_sql([q[1:] for q in _QUESTIONS], "symbols, metrics, periods, intent, route", "id AS question_id, * EXCLUDE (id)"))
def understood_questions(spark, sf_dir):
    """Q-01, Q-02, Q-05, T-18, T-25, D-14, X-09: what the question of each customer names, in which order, and what it asks for; all seventeen intents."""
    listed = {c: F.array_join(c, ",").alias(c) for c in ("symbols", "metrics", "periods")}
    return _understood(spark, sf_dir).select("question_id", *listed.values(), "intent", "route")


_WANTED = ["net_profit", "revenue_from_operations,total_borrowings,net_profit", "net_interest_margin", None, None, None, "return_on_equity", None, None, None, "revenue_from_operations", "dividend_per_share", "revenue_from_operations", None, None, None, None, None]


@query(planted.cases_sql([(w, w is None) for w in _WANTED], "named, main", "id AS question_id, CASE WHEN NOT main THEN named WHEN id % 2 = 0 THEN 'net_interest_income,net_profit' ELSE 'revenue_from_operations,net_profit' END AS wanted"))
def measures_of_questions(spark, sf_dir):
    """Q-06: metrics to look up for a question, those named or the main ones of its kind of company."""
    wanted = ops.measures_for(F.col("metrics"), F.col("question_id") % 2 == 0, F.col("intent") == "comparison")
    return _understood(spark, sf_dir).select("question_id", F.array_join(wanted, ",").alias("wanted"))


@query(f"SELECT c_custkey AS question_id, place, 'For ' || company AS choice FROM customer, (VALUES (0, 'Acme'), (1, 'Beta')) v(place, company) WHERE c_custkey % {len(_QUESTIONS)} = 6")
def clarifying_choices(spark, sf_dir):
    """Q-22: a choice for each company where a question names none."""
    return ops.clarify(_understood(spark, sf_dir), ["Acme", "Beta"]).select("question_id", "place", "choice")


@query("""WITH u AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations WHERE role = 'user')
SELECT conv_id, turn, 'Nation_' || ((conv_id + 5 * (k // 3)) % 25) AS symbols, CASE k % 3 WHEN 0 THEN CASE WHEN (k // 3) % 2 = 0 THEN 'net_profit' ELSE '' END WHEN 1 THEN CASE WHEN (k // 3) % 2 = 0 THEN 'net_profit' ELSE '' END ELSE 'total_borrowings' END AS metrics,
  CASE k % 3 WHEN 0 THEN '' ELSE 'FY' || (2000 + conv_id % 20) END AS periods FROM u""")
def questions_with_history(spark, sf_dir):
    """Q-01, W-19, D-14: user turns as questions and follow-ups: company, measure and period of the topic are carried to the turns that leave them out; a new company begins a new topic."""
    turns = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn")
    k = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    topic = F.floor(F.col("k") / 3)
    company = F.concat(F.lit("Nation_"), ((F.col("conv_id") + 5 * topic) % 25).cast("string"))
    year = F.concat(F.lit(" in FY"), (2000 + F.col("conv_id") % 20).cast("string"))
    text = F.when(F.col("k") % 3 == 0, F.concat(F.when(topic % 2 == 0, "What was the net profit of ").otherwise("Tell me about "), company, F.lit("?"))).when(F.col("k") % 3 == 1, F.concat(F.lit("And how was it"), year, F.lit("?"))).otherwise(F.lit("And its debt?"))
    rows = turns.withColumn("k", k).withColumn("text", text).withColumn("row", F.struct("conv_id", "turn"))
    read = ops.with_metrics(names.with_symbols(rows, _aliases(spark, sf_dir), "row"), "text").withColumn("periods", ops.periods_in(F.col("text")))
    carried = ops.carry_context(read)
    return carried.select("conv_id", "turn", *[F.array_join(f"asked_{c}", ",").alias(c) for c in ("symbols", "metrics", "periods")])


@query("""SELECT id, place, symbol FROM (SELECT o_orderkey AS id, a.c_custkey AS a, b.c_custkey AS b, o_orderkey % 4 AS v FROM orders JOIN customer a ON o_custkey = a.c_custkey JOIN customer b ON b.c_custkey = o_custkey // 2),
LATERAL (SELECT unnest([1, 2]) AS place, unnest([CASE WHEN v = 0 THEN a WHEN v = 1 THEN CASE WHEN a % 3 = 0 THEN -a - 1 ELSE a END WHEN v = 2 THEN b ELSE CASE WHEN b % 3 = 0 THEN -b - 1 ELSE b END END, CASE WHEN v IN (0, 1) THEN b END]) AS symbol) WHERE symbol IS NOT NULL""")
def names_in_texts(spark, sf_dir):
    """T-25, X-09, J-15, T-16: thousands of names (customers, and groups called after them) found in texts by an index of their words; the longest at each place counts."""
    customers, orders = table(spark, sf_dir, "customer").select("c_custkey", "c_name"), spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), 100_000)
    named = lambda n: customers.select(F.col("c_custkey").alias(f"{n}_key"), F.col("c_name").alias(n))
    rows = orders.join(named("a"), F.col("o_custkey") == F.col("a_key")).join(named("b"), F.floor(F.col("o_custkey") / 2) == F.col("b_key"))
    v = F.col("o_orderkey") % 4
    text = (
        F.when(v == 0, F.concat(F.lit("Sales of "), "a", F.lit(" rose, "), F.upper("b"), F.lit(" fell.")))
        .when(v == 1, F.concat("a", F.lit(" Holdings and "), "b"))
        .when(v == 2, F.concat(F.lit("x"), "a", F.lit(" holdings; "), F.lower("b"), F.lit(" Holding")))
        .otherwise(F.concat("a", F.lit("Holdings "), "b", F.lit(" holdings holdings")))
    )
    group = customers.where("c_custkey % 3 = 0").select(F.concat("c_name", F.lit(" Holdings")).alias("alias"), (-F.col("c_custkey") - 1).alias("symbol"))
    aliases = customers.select(F.col("c_name").alias("alias"), F.col("c_custkey").alias("symbol")).unionByName(group)
    return names.mentions(rows.select(F.col("o_orderkey").alias("id"), text.alias("text")), aliases, "id").select("id", "place", "symbol")


_PERIODS = [
    ("Q3 FY{z}", "Q3FY{y}"), ("3QFY{y}", "Q3FY{y}"), ("FY{y}", "FY{y}"), ("FY {p}-{z}", "FY{y}"), ("{p}-{z}", "FY{y}"), ("fiscal {y}", "FY{y}"), ("quarter ended December {p}", "Q3FY{y}"),
    ("quarter ended 31 March {y}", "Q4FY{y}"), ("year ended 31 March {y}", "FY{y}"), ("H1 FY{z}", None), ("nine months FY{z}", None), ("Q4", "Q4FY{y}"), ("Q1", "Q1FY{y}"), ("no period", None),
]


@query(planted.cases_sql([(p,) for _, p in _PERIODS], "period", "id, period"))
def free_text_periods(spark, sf_dir):
    """D-02: periods in words; a quarter alone is read with the document's month, in which the year's first quarter is over or the year before it."""
    made = planted.cases(spark, sf_dir, [(x,) for x, _ in _PERIODS], "text string").join(planted.rows(spark, sf_dir).select("id", F.col("{y}").cast("int").alias("_y")), "id")
    return made.select("id", ops.parse_period(F.col("text"), F.make_date(F.when(F.col("text") == "Q1", F.col("_y") - 1).otherwise(F.col("_y")), F.lit(7), F.lit(1))).alias("period"))


_DATED = [("transcript", "{e} {y}", "on 9 June 2011", "label"), ("announcement", "{e} {y}", "held on 5 {e} {y} at noon", "text"), ("announcement", "x", "{d} board", "text"), ("presentation", "soon", "no date", "fetched")]


@query(planted.cases_sql([(o, "{d}") for *_, o in _DATED], "origin, day", "id, CASE origin WHEN 'label' THEN date_trunc('month', day::DATE)::DATE WHEN 'text' THEN day::DATE ELSE DATE '2060-09-01' END AS day, origin"))
def event_dates(spark, sf_dir):
    """D-06: the day of an event with its origin: the month on its label, a date in its text in words or digits, the day of fetching."""
    rows = planted.cases(spark, sf_dir, [r[:3] for r in _DATED], "kind string, label string, text string")
    day, origin = ops.event_date(F.col("kind"), F.col("label"), F.col("text"), F.to_date(F.lit("2060-09-01")))
    return rows.select("id", day.alias("day"), origin.alias("origin"))


_MESSAGES = [
    ("I am a conservative investor. I like growth and dividends of {a}, for years!", [("risk_preference", "conservative"), ("investment_style", "income,growth"), ("other_preferences", "long_term")]),
    ("Is growth of {a} good?", []),
    ("I'm not aggressive. I want to avoid debt.", [("debt_preference", "avoid_high_debt")]),
    ("Tell me about my risk in {a}.", []),
    ('He said "I like momentum"; growth of {b} is fine.', []),
    ("I am aggressive but my wife is cautious. I don't mind debt. Actually I am balanced since {y}.", [("risk_preference", "moderate"), ("debt_preference", "debt_ok")]),
    ("My style is low-risk and I like stable trading", [("risk_preference", "conservative"), ("other_preferences", "short_term,stability")]),
    ("I avoid highly leveraged companies such as {b}", [("debt_preference", "avoid_high_debt")]),
]
_TOLD = [(i, f, v) for i, (_, told) in enumerate(_MESSAGES) for f, v in told]


def _preferences(spark, sf_dir):
    return ops.extract_preferences(planted.cases(spark, sf_dir, [m[:1] for m in _MESSAGES], "text string").withColumnRenamed("id", "message_id"))


@query(planted.cases_sql(_TOLD, "field, vals", "id AS message_id, field, vals", len(_MESSAGES)))
def stated_preferences(spark, sf_dir):
    """Q-03, T-13, T-14, T-15, O-09: preferences in the first person, negations and quotes taken out, the last sentence of a field counts."""
    return _preferences(spark, sf_dir).select("message_id", "field", F.array_join("values", ",").alias("vals"))


@query(f"WITH told AS ({planted.cases_sql(_TOLD, 'field, vals', 'id AS user_id, field, vals', len(_MESSAGES))}) SELECT * FROM told UNION ALL SELECT c_custkey, field, vals FROM customer, (VALUES ('risk_preference', 'aggressive'), ('investment_style', 'quality')) s(field, vals) WHERE NOT EXISTS (SELECT 1 FROM told WHERE told.user_id = c_custkey AND told.field = s.field)")
def merged_profile(spark, sf_dir):
    """Q-04, K-03: what is told replaces the stored value of its field."""
    stored = planted.cases(spark, sf_dir, [("risk_preference", "aggressive"), ("investment_style", "quality")], "field string, v string", whole=True).select(F.col("id").alias("user_id"), "field", F.array("v").alias("values"), F.lit("a").alias("quote"))
    told = _preferences(spark, sf_dir).select(F.col("message_id").alias("user_id"), "field", "values", "quote")
    return ops.merge_profile(stored, told).select("user_id", "field", F.array_join("values", ",").alias("vals"))


_SUMMARIES = [
    'conservative ("I am a conservative investor.") | income, growth; long_term ("I like growth and dividends of {a}, for years!")', None, 'avoid_high_debt ("I want to avoid debt.")', None, None,
    'moderate ("Actually I am balanced since {y}.") | debt_ok ("I don\'t mind debt.")', 'conservative; short_term, stability ("My style is low-risk and I like stable trading")', 'avoid_high_debt ("I avoid highly leveraged companies such as {b}")',
]


@query(planted.cases_sql([(x,) for x in _SUMMARIES], "summary", "id AS user_id, summary") + " WHERE summary IS NOT NULL")
def profile_summaries(spark, sf_dir):
    """Q-21: fields grouped by the sentence that gave them, in the vocabulary's order."""
    return ops.profile_summary(_preferences(spark, sf_dir).withColumnRenamed("message_id", "user_id"))


@query("""SELECT conv_id, 'Conversation:' || chr(10) || string_agg(role || ': ' || left(text, 50), chr(10) ORDER BY turn) || chr(10) || chr(10) || 'Question:' || chr(10) || 'q' AS message
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 6 GROUP BY 1""")
def user_messages(spark, sf_dir):
    """Q-17: prompts from the last six turns."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.select("conv_id").distinct().select("conv_id", F.lit("q").alias("question"), F.lit("").alias("preferences"), F.lit(None).cast("string").alias("block"), F.array().cast("array<string>").alias("problems"))
    return ops.user_message(asked, turns, 6, 50).select("conv_id", "message")


@query("""SELECT conv_id, 0 AS place, left(arg_max(text, turn), 10) AS source FROM conversations WHERE role = 'assistant' AND length(text) > 20 GROUP BY 1""")
def replayed_sources(spark, sf_dir):
    """Q-19: the sources of each conversation's last answer that has any."""
    long = F.char_length("text") > 20
    turns = table(spark, sf_dir, "conversations").withColumn("sources", F.when(long, F.array(F.substring("text", 1, 10))).otherwise(F.array().cast("array<string>")))
    return ops.previous_sources(turns)


_FORMS = [
    ('{"outcome": "answered", "claims": [{"text": "{a}", "citations": ["F1"]}, {"text": null}, {"text": "", "citations": []}, {"text": "{n}"}]}', "answered", "{a},{n}"),
    ('{"outcome": "sure", "claims": []}', "not_in_data", ""), ("no form of {a}", "not_in_data", ""), ('{"claims": {"text": "{a}"}}', "not_in_data", ""),
    ('{"outcome": "partial", "claims": [' + ", ".join(f'{{"text": "{{n}}.{i}"}}' for i in range(12)) + "]}", "partial", ",".join(f"{{n}}.{i}" for i in range(8))),
]


@query(planted.cases_sql([f[1:] for f in _FORMS], "outcome, claims", "id AS form, outcome, claims"))
def parsed_forms(spark, sf_dir):
    """Q-25, N-02, N-08: forms read tolerantly: unknown outcomes, malformed claims and more than eight of them."""
    schema = "outcome string, claims array<struct<text:string,citations:array<string>>>"
    rows = planted.cases(spark, sf_dir, [f[:1] for f in _FORMS], "text string")
    claims = forms.parse_form(F.col("text"), schema, "claims", 8, lambda c: F.coalesce(c["text"], F.lit("")) != "")
    outcome = F.from_json("text", "outcome string")["outcome"]
    known = F.when(outcome.isin("answered", "partial", "not_in_data"), outcome).otherwise("not_in_data")
    return rows.select(F.col("id").alias("form"), known.alias("outcome"), F.array_join(F.transform(claims, lambda c: c["text"]), ",").alias("claims"))


@query("""SELECT conv_id, to_json({'conv_id': conv_id, 'roles': list_sort(list(DISTINCT role)), 'n': count(*)})::VARCHAR AS payload FROM conversations GROUP BY 1""")
def built_objects(spark, sf_dir):
    """N-01, N-02: objects built and written as JSON."""
    found = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_set("role")).alias("roles"), F.count(F.lit(1)).alias("n"))
    return found.select("conv_id", F.to_json(F.struct("conv_id", "roles", "n")).alias("payload"))


@query("""WITH v AS (SELECT conv_id, list(role ORDER BY turn) AS v FROM conversations GROUP BY 1)
SELECT conv_id, len(v) = 1 AND ok AS one, ok AS many FROM (SELECT conv_id, v, len(v) = len(list_distinct(v)) AND len(list_filter(v, lambda x: x NOT IN ('system', 'user', 'assistant'))) = 0 AND conv_id % 5 <> 0 AS ok FROM v)""")
def array_rules(spark, sf_dir):
    """N-03, N-05, X-04: arrays of known, distinct values, one or several; every fifth holds a null."""
    roles = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(roles.alias("v"))
    v = F.when(F.col("conv_id") % 5 == 0, F.array_append("v", F.lit(None).cast("string"))).otherwise(F.col("v"))
    known = ("system", "user", "assistant")
    return rows.select("conv_id", forms.valid_values(v, known, True).alias("one"), forms.valid_values(v, known, False).alias("many"))


@query("""SELECT source, CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 ELSE 3 END AS place, lang, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id DESC) <= 10 AS shown FROM documents""")
def grouped_documents(spark, sf_dir):
    """N-10, O-11: documents grouped by kind in a fixed order, the ten newest of each group shown."""
    docs = forms.grouped_in_order(table(spark, sf_dir, "documents").select("source", "lang", "doc_id"), "lang", ("en", "de"))
    shown = docs.select(F.col("source").alias("_s"), F.col("lang").alias("_l"), F.col("doc_id").alias("_d")).withColumn("_n", F.row_number().over(Window.partitionBy("_s", "_l").orderBy(F.desc("_d")))).where("_n <= 10")
    found = docs.join(shown, F.col("source").eqNullSafe(F.col("_s")) & F.col("lang").eqNullSafe(F.col("_l")) & (F.col("doc_id") == F.col("_d")), "left")
    return found.select("source", F.col("place").cast("long").alias("place"), "lang", "doc_id", F.col("_n").isNotNull().alias("shown"))


@query("SELECT s_suppkey, s_name FROM supplier WHERE contains(lower(s_name), 'supp') AND contains(lower(s_name), '1')")
def found_stocks(spark, sf_dir):
    """X-08: rows whose name has all typed words."""
    return table(spark, sf_dir, "supplier").where(forms.in_words(F.col("s_name"), F.lit(" SUPP  1 "))).select("s_suppkey", "s_name")


@query("SELECT doc_id, sum(length(s)) AS n, count(*) AS sentences FROM (SELECT doc_id, unnest(list_filter(list_transform(regexp_extract_all(text, '[^.!?\\n]+[.!?]*'), lambda x: trim(x, ' ')), lambda x: x <> '')) AS s FROM documents) GROUP BY 1")
def sentence_counts(spark, sf_dir):
    """T-14: sentences with their end marks."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(t.sentences(F.col("text"))).alias("s"))
    return rows.groupBy("doc_id").agg(F.sum(F.char_length("s")).alias("n"), F.count(F.lit(1)).alias("sentences"))


@query("""WITH n AS (SELECT DISTINCT sha256(text) AS sha256, min(doc_id) AS doc_id FROM documents GROUP BY 1) SELECT sha256, doc_id, 'ingest:' || doc_id AS dedupe_key, 'pending' AS status FROM n""")
def documents_with_jobs(spark, sf_dir):
    """K-11, C-15: one document for each content and one job for it, made of one input."""
    documents, jobs = merge.documents_and_jobs(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    return documents.join(jobs, "doc_id").select("sha256", "doc_id", "dedupe_key", "status")


@query("""SELECT conv_id, max(turn) + 2 AS last_turn, count(*) + 2 AS n, max(turn) + 2 AS touched FROM conversations WHERE conv_id % 2 = 0 GROUP BY 1 UNION ALL SELECT conv_id, max(turn), count(*), max(turn) FROM conversations WHERE conv_id % 2 = 1 GROUP BY 1""")
def added_exchanges(spark, sf_dir):
    """K-12: a question and its answer appended, and their conversation touched."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    threads = turns.groupBy("conv_id").agg(F.max("turn").alias("touched"))
    new = threads.where("conv_id % 2 = 0").select("conv_id", F.lit("q").alias("question"), F.lit("a").alias("answer"), (F.col("touched") + 2).alias("at"))
    turns, threads = merge.add_exchange(turns, threads, new)
    return turns.groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.count(F.lit(1)).alias("n")).join(threads, "conv_id")


@query("""SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_returnflag = 'N' OR l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'N')""")
def version_replaced(spark, sf_dir):
    """K-07: rows of a parent that another version derived go once the current one has derived it."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return merge.replace_version(lines.where("l_returnflag <> 'N'"), lines.where("l_returnflag = 'N'"), "l_orderkey", "l_returnflag")


@query("""SELECT vec_id, round(0.5 + 0.02 * CASE WHEN vec_id % 3 = 0 THEN 1 ELSE 0 END + 0.02 * greatest(coalesce(CASE WHEN vec_id % 2 = 0 THEN (vec_id - 100) / 1000.0 END, 0), 0), 9)::DOUBLE AS score FROM embeddings""")
def bonus_scores(spark, sf_dir):
    """M-08, V-02: a second similarity that is absent for some and never below zero."""
    profile = F.when(F.col("vec_id") % 2 == 0, (F.col("vec_id") - 100) / 1000.0)
    recent = F.when(F.col("vec_id") % 3 == 0, 1.0).otherwise(0.0)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(retrieval.bonus_score(F.lit(0.5), recent, profile), 9).alias("score"))


_EVENTS = [([1, 2], 2, "Net  profit of “{a}” rose", "x net profit of \"{a}\" rose by {n}", None), ([1], 2, "{a}", "{a}", "page_outside_window"), ([1], 1, "{a} fell", "a page of {b}", "quote_not_on_page"), ([1], 1, " ", "{a}", "bad_quote"), ([1], 1, "up {g}", "it is up {n} or ₹{g}", None), ([1], 1, "up {m}", "up {n}", "quote_not_on_page")]


@query(planted.cases_sql([(e[-1],) for e in _EVENTS], "code", "id, CASE WHEN id % 6 = 4 THEN 'quote_not_on_page' ELSE code END AS code"))
def accepted_events(spark, sf_dir):
    """C-12: an event is accepted if its page was shown and holds its quote, number for number."""
    from lodestone.operators.documents import validate_events

    rows = planted.cases(spark, sf_dir, [e[:4] for e in _EVENTS], "pages array<int>, page int, quote string, page_text string")
    return validate_events(rows).select("id", "code")
