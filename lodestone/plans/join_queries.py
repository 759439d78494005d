"""Queries over citation joins, recency lists, paging and turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import citations as ops
from lodestone.operators import dims
from lodestone.operators import rank
from lodestone.plans.adapters import FACTS_SQL, STOCKS_SQL, facts, stocks
from lodestone.plans.registry import query
from lodestone.session import table

_long = lambda c: F.col(c).cast("long").alias(c)

_DOCS_SQL = "docs AS (SELECT doc_id AS document_id, left(text, 20) AS title, 'u' || doc_id AS url, CASE WHEN doc_id % 3 = 0 THEN 'pending' ELSE 'completed' END AS status FROM documents)"


def _docs(spark, sf_dir):
    status = F.when(F.col("doc_id") % 3 == 0, "pending").otherwise("completed")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.substring("text", 1, 20).alias("title"), F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"), status.alias("status"))


@query("SELECT n_nationkey AS id, n_name AS symbol, row_number() OVER (ORDER BY n_nationkey) AS place FROM nation")
def stock_list(spark, sf_dir):
    """S-01, P-01: a small dimension in the order of its ids."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("symbol"))
    return rank.numbered(rows, "id").select("id", "symbol", _long("place"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders)")
def point_lookup(spark, sf_dir):
    """S-02: one row by its unique key, which a subquery of the same plan gives."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return orders.where(F.col("o_orderkey") == orders.agg(F.max("o_orderkey")).scalar())


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P')")
def optional_filters(spark, sf_dir):
    """P-03, P-06: a filter that is given, one that is not, and membership of a list."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    given = ops.where_if(orders, "o_orderstatus", "F")
    return given.unionByName(ops.where_if(ops.where_if(orders, "o_orderkey", None), "o_orderstatus", "O").where(F.col("o_orderstatus").isin("X", "Y"))).unionByName(orders.where(F.col("o_orderstatus").isin("P", "Q")))


@query(f"""WITH {_DOCS_SQL}, f AS (SELECT o_orderkey AS id, o_custkey AS stock_id, CASE WHEN o_orderstatus = 'F' THEN 'screener' ELSE 'annual_report' END AS source, CASE WHEN o_orderstatus <> 'F' THEN o_orderkey % 400 END AS document_id FROM orders)
SELECT f.id, f.stock_id, f.source, d.title, d.url FROM f LEFT JOIN docs d ON d.document_id = f.document_id WHERE f.source = 'screener' OR d.status = 'completed'""")
def facts_with_citations(spark, sf_dir):
    """S-03, J-02, P-04: facts with their documents; a table's facts need none."""
    filed = F.col("o_orderstatus") != "F"
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("stock_id"), F.when(filed, "annual_report").otherwise("screener").alias("source"), F.when(filed, F.col("o_orderkey") % 400).alias("document_id")
    )
    return ops.facts_with_citations(rows, _docs(spark, sf_dir)).select("id", "stock_id", "source", "title", "url")


@query(f"""WITH {_DOCS_SQL}, e AS (SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN event_id % 300 END AS document_id, CASE WHEN event_id % 2 = 1 THEN event_id % 60 END AS item_id FROM events)
SELECT e.id, coalesce('item ' || p.page_id, d.title) AS title, coalesce(p.url, d.url) AS url FROM e LEFT JOIN docs d ON d.document_id = e.document_id LEFT JOIN pages p ON p.page_id = e.item_id WHERE e.item_id IS NOT NULL OR d.status = 'completed'""")
def events_with_citations(spark, sf_dir):
    """S-04, J-03, N-04: events of a filing or of a feed item, exactly one of which they name."""
    i = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(i.alias("id"), F.when(i % 2 == 0, i % 300).alias("document_id"), F.when(i % 2 == 1, i % 60).alias("item_id"))
    items = table(spark, sf_dir, "pages").select(F.col("page_id").alias("item_id"), F.concat(F.lit("item "), F.col("page_id").cast("string")).alias("title"), "url")
    sound = rows.where(ops.has_one_source(F.col("document_id"), F.col("item_id")))
    return ops.events_with_citations(sound, _docs(spark, sf_dir), items).select("id", "title", "url")


@query("SELECT n_name AS symbol, o_orderdate::DATE AS day, count(*) AS n, row_number() OVER (PARTITION BY n_name ORDER BY o_orderdate::DATE) AS place FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2")
def price_history(spark, sf_dir):
    """S-05, J-05: a history joined to its dimensions (small sides are broadcast by their size), oldest first."""
    orders, customers, nations = (table(spark, sf_dir, n) for n in ("orders", "customer", "nation"))
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    daily = joined.groupBy(F.col("n_name").alias("symbol"), F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return rank.numbered(daily, "day", "symbol").select("symbol", "day", "n", _long("place"))


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS followed FROM customer")
def followed_flag(spark, sf_dir):
    """J-04, P-02: a flag from the nullness of an outer join whose right side is filtered first."""
    marks = ops.where_if(table(spark, sf_dir, "orders"), "o_orderstatus", "P")
    return ops.with_flag(table(spark, sf_dir, "customer").select("c_custkey"), marks, "c_custkey", "o_custkey", "followed")


_CHUNKS_SQL = "ch AS (SELECT doc_id AS chunk_id, doc_id % 40 AS document_id, sha256(text) AS content_hash FROM documents), em AS (SELECT DISTINCT sha256(text) AS h, CASE WHEN doc_id % 2 = 0 THEN 'one' ELSE 'two' END AS model FROM documents WHERE doc_id % 5 <> 0)"


def _chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), (F.col("doc_id") % 40).alias("document_id"), F.sha2("text", 256).alias("content_hash"))
    made = docs.where("doc_id % 5 <> 0").select(F.when(F.col("doc_id") % 2 == 0, "one").otherwise("two").alias("model"), F.sha2("text", 256).alias("content_hash"), F.array(F.lit(1.0)).alias("embedding"))
    return chunks, made


@query(f"WITH {_CHUNKS_SQL} SELECT chunk_id, document_id, n_name AS symbol FROM ch JOIN nation ON n_nationkey = document_id % 30 JOIN em ON em.h = content_hash AND em.model = 'one'")
def search_passages(spark, sf_dir):
    """J-01: passages, documents, stocks and embeddings of one model joined."""
    chunks, made = _chunks(spark, sf_dir)
    documents = chunks.select("document_id", (F.col("document_id") % 30).alias("stock_id")).distinct()
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("stock_id"), F.col("n_name").alias("symbol"))
    return ops.search_passages(chunks, documents, names, made, "one").select("chunk_id", "document_id", "symbol")


@query(f"WITH {_CHUNKS_SQL} SELECT content_hash, min(chunk_id) AS chunk_id FROM ch WHERE content_hash NOT IN (SELECT h FROM em WHERE model = 'one') GROUP BY 1")
def missing_contents(spark, sf_dir):
    """A-07, J-06, V-05: one row for each content hash that a model has not embedded; equal texts are paid once."""
    chunks, made = _chunks(spark, sf_dir)
    return ops.missing_contents(chunks, made, "one")


@query(f"WITH {_CHUNKS_SQL} SELECT DISTINCT document_id FROM ch WHERE content_hash NOT IN (SELECT h FROM em WHERE model = 'two')")
def embedding_backlog(spark, sf_dir):
    """J-07: documents with a chunk that has no embedding: a semi join on an anti join."""
    chunks, made = _chunks(spark, sf_dir)
    return ops.backlog_documents(chunks.select("document_id").distinct(), chunks, made, "two")


@query("""WITH i AS (SELECT c_custkey, id, min(pos) AS pos FROM (SELECT c_custkey, unnest([c_nationkey, c_custkey % 30, c_nationkey, 3]) AS id, unnest([1, 2, 3, 4]) AS pos FROM customer) GROUP BY 1, 2)
SELECT c_custkey, coalesce(string_agg(n_name, '|' ORDER BY pos) FILTER (WHERE n_name IS NOT NULL), '') AS labels FROM i LEFT JOIN nation ON n_nationkey = id GROUP BY 1""")
def cited_labels(spark, sf_dir):
    """J-16, A-13, N-06: ids of a list resolved to rows, each once, in the list's order."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.array(F.col("c_nationkey").cast("long"), F.col("c_custkey") % 30, F.col("c_nationkey").cast("long"), F.lit(3).cast("long")).alias("ids"))
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), "n_name")
    return ops.resolve(rows, "c_custkey", "ids", names, "id", "n_name").select("c_custkey", F.array_join("labels", "|").alias("labels"))


@query("""SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY f) AS marker FROM (SELECT conv_id, role, min(turn) AS f FROM conversations GROUP BY 1, 2)""")
def first_use_numbers(spark, sf_dir):
    """W-16: items numbered in the order of their first use."""
    return ops.numbered_by_first_use(table(spark, sf_dir, "conversations"), "conv_id", "role", ["turn"]).select("conv_id", "role", _long("marker"))


@query("""WITH r AS (SELECT n_regionkey, n_nationkey, list_filter([100, 200, 300], lambda x: x <= (n_nationkey % 4) * 100) AS kids FROM nation),
b AS (SELECT *, coalesce(sum(len(kids) + 1) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS n FROM r)
SELECT n_regionkey, n_nationkey, 'F' || (n + 1) AS id, NULL AS child, NULL AS parent, len(kids) AS n_children FROM b
UNION ALL SELECT n_regionkey, n_nationkey, 'F' || (n + 1 + i), kids[i], 'F' || (n + 1), 0 FROM (SELECT *, unnest(range(1, len(kids) + 1)) AS i FROM b)""")
def nested_numbers(spark, sf_dir):
    """W-17: rows numbered with their children right after them, linked both ways."""
    kids = F.filter(F.array(*map(F.lit, (100, 200, 300))), lambda x: x <= (F.col("n_nationkey") % 4) * 100)
    rows = table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", kids.alias("kids"))
    found = ops.numbered_with_children(rows, "n_regionkey", ["n_nationkey"], "kids")
    return found.select("n_regionkey", "n_nationkey", "id", "child", "parent", F.size("child_ids").cast("long").alias("n_children"))


@query("SELECT event_id, nullif(user_id, 7) AS moment FROM events ORDER BY moment DESC NULLS LAST, event_id DESC LIMIT 50")
def recent_items(spark, sf_dir):
    """O-02, O-10: the newest rows with nulls last, a top-k sort."""
    rows = table(spark, sf_dir, "events").select("event_id", F.nullif("user_id", F.lit(7)).alias("moment"))
    return ops.newest_items(rows, "moment", "event_id", 50)


@query("""SELECT kind, id, day FROM (SELECT 1 AS kind, event_id AS id, ts::DATE AS day FROM events UNION ALL SELECT 2, o_orderkey, o_orderdate::DATE FROM orders) ORDER BY day DESC NULLS LAST, kind, id DESC LIMIT 40""")
def newest_of_two(spark, sf_dir):
    """X-06: two kinds of items as one list, newest first."""
    a = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.to_date("ts").alias("day"))
    b = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("day"))
    return ops.newest_of_two(a, b, "day", "id", 40).select("kind", "id", "day")


@query("""WITH p AS (SELECT o_orderkey FROM orders WHERE o_orderkey < (SELECT max(o_orderkey) - 20 FROM orders) ORDER BY 1 DESC LIMIT 10) SELECT o_orderkey, (SELECT min(o_orderkey) FROM p) AS next_cursor FROM p""")
def keyset_page(spark, sf_dir):
    """O-04: one page below a cursor, with the next page's cursor."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return rank.keyset_page(orders, "o_orderkey", orders.agg(F.max("o_orderkey")).scalar() - 20, 10)


@query("""SELECT conv_id, turn, place FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM (
  SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3)""")
def last_n_turns(spark, sf_dir):
    """W-18: the three latest turns of each conversation, from the oldest of them on."""
    return rank.last_n_ascending(table(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id"], "turn", 3).select("conv_id", "turn", _long("place"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn // 2, role = 'assistant', turn) AS place FROM conversations")
def question_before_answer(spark, sf_dir):
    """O-05: of one moment, the question comes before the answer."""
    rows = table(spark, sf_dir, "conversations").withColumns({"at": F.floor(F.col("turn") / 2), "is_answer": F.col("role") == "assistant"})
    return rank.numbered(rows, "at", "conv_id", "is_answer", "turn").select("conv_id", "turn", _long("place"))


@query("""SELECT conv_id, turn, (SELECT arg_max(text, p.turn) FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn < c.turn AND p.role = 'user' AND contains(p.text, 'e')) AS earlier FROM conversations c""")
def previous_user_turn(spark, sf_dir):
    """W-19: the latest earlier turn of the user that names something."""
    wanted = (F.col("role") == "user") & F.col("text").contains("e")
    return ops.previous_matching(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], wanted, "text").select("conv_id", "turn", "earlier")


@query("""SELECT event_id, event_type, depth FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS depth FROM events) ORDER BY depth, event_type LIMIT 33""")
def fair_cap(spark, sf_dir):
    """W-14: a limit dealt round-robin over groups."""
    return rank.fair_cap(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", [F.col("event_id")], 33).select("event_id", "event_type", _long("depth"))


@query("""SELECT source, round((coalesce(sum(n_chars), 0)::DECIMAL(28,0) * 0.15::DECIMAL(10,4) + coalesce(sum(n_chars % 100), 0)::DECIMAL(28,0) * 0.60::DECIMAL(10,4))::DOUBLE / 1000000, 9) AS usd,
  (coalesce(sum(n_chars), 0)::DECIMAL(28,0) * 0.15::DECIMAL(10,4) + coalesce(sum(n_chars % 100), 0)::DECIMAL(28,0) * 0.60::DECIMAL(10,4))::DOUBLE / 1000000 < 0.02 AS allowed FROM documents GROUP BY 1""")
def token_spend(spark, sf_dir):
    """A-01, A-02, Q-16: exact cost of tokens by group, and whether it is below a cap."""
    calls = table(spark, sf_dir, "documents").select("source", "n_chars", (F.col("n_chars") % 100).alias("n_out"))
    spent = ops.within_budget(ops.spend(calls, "source", "n_chars", "n_out", "0.15", "0.60"), "0.02")
    return spent.withColumn("usd", F.round(F.col("usd").cast("double"), 9))


@query(f"WITH {FACTS_SQL}, {STOCKS_SQL} SELECT DISTINCT f.stock_id, f.metric FROM facts f JOIN stocks s USING (stock_id) WHERE NOT (s.is_financial AND f.metric IN ('revenue_from_operations', 'total_borrowings'))")
def metrics_that_apply(spark, sf_dir):
    """P-11: metrics of the vocabulary that apply to the kind of company."""
    dim = spark.createDataFrame([(name, applies) for name, (_, applies) in dims.METRICS.items()], "metric string, applies string")
    rows = facts(spark, sf_dir).select("stock_id", "metric").distinct().join(stocks(spark, sf_dir), "stock_id").join(F.broadcast(dim), "metric")
    own = F.when(F.col("is_financial"), "bank").otherwise("non_financial")
    return rows.where(F.col("applies").isin("all") | (F.col("applies") == own)).select("stock_id", "metric")


@query(f"""WITH {FACTS_SQL} SELECT stock_id, arg_min(id, (CASE metric WHEN 'revenue_from_operations' THEN 1 WHEN 'net_profit' THEN 3 WHEN 'total_borrowings' THEN 4 WHEN 'total_equity' THEN 5 ELSE 6 END) * 100000000000 + id) AS id FROM facts GROUP BY 1""")
def first_key_fact(spark, sf_dir):
    """A-11, O-09: the first fact of a group in the vocabulary's order."""
    order = F.struct(dims.rank_of(F.col("metric"), tuple(dims.METRICS)), "id")
    return facts(spark, sf_dir).groupBy("stock_id").agg(F.min_by("id", order).alias("id"))


@query(f"""WITH {FACTS_SQL} SELECT stock_id, metric, count(DISTINCT period) AS n_periods, count(DISTINCT source) AS n_sources FROM facts GROUP BY 1, 2 HAVING count(DISTINCT period) > 1 AND count(DISTINCT source) > 1""")
def mixed_metrics(spark, sf_dir):
    """A-17: metrics with several periods and several sources."""
    found = facts(spark, sf_dir).groupBy("stock_id", "metric").agg(F.count_distinct("period").alias("n_periods"), F.count_distinct("source").alias("n_sources"))
    return found.where("n_periods > 1 AND n_sources > 1")


@query("SELECT source, count(*) AS n_documents, sum(n_chars)::BIGINT AS n_chars, count(*) || ' documents, ' || sum(n_chars)::BIGINT || ' characters' AS summary FROM documents GROUP BY 1")
def summary_lines(spark, sf_dir):
    """A-18: a sum and a count as one line."""
    found = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_chars").alias("n_chars"))
    return found.withColumn("summary", F.concat(F.col("n_documents").cast("string"), F.lit(" documents, "), F.col("n_chars").cast("string"), F.lit(" characters")))


@query("""WITH y AS (SELECT o_custkey, year(o_orderdate) AS y, round(max(o_totalprice), 2) - 100000 AS v FROM orders GROUP BY 1, 2), l AS (SELECT *, lag(y) OVER w AS py, lag(v) OVER w AS pv FROM y WINDOW w AS (PARTITION BY o_custkey ORDER BY y))
SELECT o_custkey, y, CASE WHEN py = y - 1 AND pv <> 0 THEN round((v - pv) / abs(pv) * 100, 1) END AS change FROM l""")
def consecutive_changes(spark, sf_dir):
    """W-07, T17: changes over consecutive years only, against the size of the earlier value; empty where it is 0."""
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg((F.round(F.max("o_totalprice"), 2) - 100000).alias("v"))
    return rank.consecutive_change(rows, "o_custkey", "y", "v").select("o_custkey", F.col("y").cast("long").alias("y"), "change")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey * 10 + l_linenumber NOT IN (SELECT l_orderkey * 10 + l_linenumber FROM lineitem WHERE l_returnflag = 'R')")
def windows_to_do(spark, sf_dir):
    """X-05: a set difference by two keys."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    done = lines.where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber")
    return lines.select("l_orderkey", "l_linenumber").join(done, ["l_orderkey", "l_linenumber"], "left_anti")
