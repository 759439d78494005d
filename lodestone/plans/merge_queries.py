"""Queries over merges: halves of a driver table play the stored and the arriving rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import buckets
from lodestone.operators import merge as ops
from lodestone.plans.registry import query
from lodestone.session import table
from lodestone.sources.landing import landing_folder


def _halves(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return events.where("event_id % 3 = 0"), events.where("event_id % 3 <> 0")


@query("""WITH old AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM events WHERE event_id % 3 = 0) WHERE r = 1),
new AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM events WHERE event_id % 3 <> 0) WHERE r = 1)
SELECT event_id, user_id, event_type, value FROM old UNION ALL
SELECT event_id, user_id, event_type, value FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.user_id = n.user_id AND o.event_type = n.event_type)""")
def upsert_first(spark, sf_dir):
    """K-01, T18: first row wins."""
    old, new = _halves(spark, sf_dir)
    return ops.insert_if_absent(ops.reduce_batch(old, ["user_id", "event_type"], F.col("event_id")), new, ["user_id", "event_type"], "event_id")


@query("""SELECT event_id, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY (event_id % 3 <> 0) DESC, CASE WHEN event_id % 3 <> 0 THEN -event_id ELSE event_id END) AS r FROM events) WHERE r = 1""")
def upsert_latest(spark, sf_dir):
    """K-03: last write wins."""
    old, new = _halves(spark, sf_dir)
    return ops.replace_by_key(ops.reduce_batch(old, ["user_id", "event_type"], F.col("event_id")), new, ["user_id", "event_type"], "event_id")


@query("""SELECT event_id, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value, (event_id % 3 <> 0)::INT, event_id) AS r FROM events) WHERE r = 1""")
def upsert_lowest_page(spark, sf_dir):
    """K-04: of conflicting rows the least stays."""
    old, new = _halves(spark, sf_dir)
    return ops.keep_least(old, new, ["user_id", "event_type"], "value", "event_id")


@query("""SELECT user_id, CASE WHEN bool_or(event_type = 'purchase' AND value > 80) THEN 'fetched' WHEN count(*) FILTER (WHERE event_type = 'error') >= 3 THEN 'no_file' ELSE 'missing' END AS status,
       least(count(*) FILTER (WHERE event_type = 'error' AND NOT (event_type = 'purchase' AND value > 80)), 3) AS strikes FROM events GROUP BY 1""")
def strike_counter(spark, sf_dir):
    """K-05: counter with a ceiling, never demoted once fetched."""
    outcome = F.when((F.col("event_type") == "purchase") & (F.col("value") > 80), "fetched").when(F.col("event_type") == "error", "missing").otherwise("other")
    return ops.strike_states(table(spark, sf_dir, "events").withColumn("outcome", outcome), "user_id", "outcome")


@query("""WITH items AS (SELECT page_id, split_part(url, '#', 1) AS url, sha256(lower(regexp_extract(html, '<title>([^<]*)</title>', 1))) AS title_hash FROM pages),
old AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id) r, row_number() OVER (PARTITION BY title_hash ORDER BY page_id) t FROM items WHERE page_id % 4 = 0) WHERE r = 1 AND t = 1),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id) r FROM items WHERE page_id % 4 <> 0) WHERE r = 1),
fresh AS (SELECT * FROM one WHERE url NOT IN (SELECT url FROM old) AND title_hash NOT IN (SELECT title_hash FROM old))
SELECT page_id, url, title_hash FROM old UNION ALL
SELECT page_id, url, title_hash FROM (SELECT page_id, url, title_hash, row_number() OVER (PARTITION BY title_hash ORDER BY page_id) t FROM fresh) WHERE t = 1""")
def feed_dedupe(spark, sf_dir):
    """K-02, T-10, C-14, T4: two unique keys in three ordered steps."""
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    items = table(spark, sf_dir, "pages").select("page_id", F.split_part("url", F.lit("#"), F.lit(1)).alias("url"), F.sha2(F.lower(title), 256).alias("title_hash"), F.lit("feed").alias("source"))
    old = items.where("page_id % 4 = 0")
    by_url, by_title = (ops.unique_window([c], [F.col("page_id")]) for c in ("url", "title_hash"))
    old = old.withColumns({"_r": by_url, "_t": by_title}).where("_r = 1 AND _t = 1").drop("_r", "_t")
    return ops.insert_two_keys(old, items.where("page_id % 4 <> 0"), "url", "title_hash", "source", "page_id").drop("source")


@query("SELECT l_orderkey, l_linenumber, l_quantity * CASE WHEN l_orderkey % 5 = 0 THEN 2 ELSE 1 END AS l_quantity FROM lineitem WHERE NOT (l_orderkey % 5 = 0 AND l_linenumber > 2)")
def replace_children(spark, sf_dir):
    """K-06: lines of orders that come again are replaced as a whole."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    again = lines.where("l_orderkey % 5 = 0 AND l_linenumber <= 2").withColumn("l_quantity", F.col("l_quantity") * 2)
    # Orders whose every line is above 2 would not come again, so the parents are those of the batch.
    gone = lines.where("l_orderkey % 5 = 0").select("l_orderkey").distinct()
    kept = ops.delete_ids(lines, gone, "l_orderkey")
    return ops.replace_children(kept, again, "l_orderkey")


@query("SELECT doc_id, quality FROM labels WHERE quality = 1")
def current_version(spark, sf_dir):
    """K-07: rows of another version go."""
    return ops.current_version(table(spark, sf_dir, "labels"), F.col("quality") == 1).select("doc_id", "quality")


@query("""WITH jobs AS (SELECT user_id::VARCHAR AS k, max(ts) AS created_at, bool_or(event_type = 'error') AS live FROM events GROUP BY 1)
SELECT DISTINCT c_custkey::VARCHAR AS dedupe_key FROM customer c WHERE NOT EXISTS (SELECT 1 FROM jobs j WHERE j.k = c.c_custkey::VARCHAR AND (j.live OR j.created_at > TIMESTAMP '2024-01-30 00:00:00'))""")
def enqueue_missing(spark, sf_dir):
    """K-08, J-08, Z-06, Z-11: anti join with a time condition."""
    events = table(spark, sf_dir, "events")
    jobs = events.groupBy(F.col("user_id").cast("string").alias("dedupe_key")).agg(F.max("ts").cast("timestamp").alias("created_at"), F.bool_or(F.col("event_type") == "error").alias("_live"))
    jobs = jobs.withColumn("status", F.when(F.col("_live"), "pending").otherwise("done"))
    wanted = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("dedupe_key"))
    return ops.enqueue(jobs, wanted, "2024-01-31 00:00:00")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')")
def cascade_delete(spark, sf_dir):
    """K-10, K-14: children of deleted parents go."""
    parents = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'")
    return ops.cascade_delete(table(spark, sf_dir, "lineitem"), parents, "l_orderkey", "o_orderkey").select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 2 = 0 THEN l_suppkey END AS l_suppkey FROM lineitem")
def set_null_reference(spark, sf_dir):
    """K-10: references to deleted parents become null."""
    suppliers = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0")
    return ops.set_null(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), suppliers, "l_suppkey", "s_suppkey")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_ids(spark, sf_dir):
    """K-09, C-11, K-15: bulk delete by id list."""
    return ops.delete_ids(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id")


@query("""WITH RECURSIVE p AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM (SELECT user_id, date_trunc('second', ts) AS ts, event_id FROM events WHERE event_type = 'click')),
kept AS (
  SELECT user_id, i, ts, ts AS last, true AS k FROM p WHERE i = 1
  UNION ALL
  SELECT p.user_id, p.i, p.ts, CASE WHEN p.ts >= kept.last + INTERVAL 24 HOUR THEN p.ts ELSE kept.last END, p.ts >= kept.last + INTERVAL 24 HOUR FROM kept JOIN p ON p.user_id = kept.user_id AND p.i = kept.i + 1
)
SELECT user_id, epoch(ts)::BIGINT AS at FROM kept WHERE k""")
def kept_presses(spark, sf_dir):
    """K-13, Z-13: an ordered fold, not a comparison of neighbours."""
    clicks = table(spark, sf_dir, "events").where("event_type = 'click'").select("user_id", F.date_trunc("second", "ts").alias("ts"))
    return ops.kept_presses(clicks, "user_id", "ts", 24 * 60).select("user_id", F.unix_seconds("ts").alias("at"))


@query("""SELECT document_id, attempt, CASE outcome WHEN 'ok' THEN 'completed' WHEN 'rejected' THEN 'failed' ELSE CASE WHEN attempt >= 3 THEN 'failed' ELSE 'pending' END END AS status FROM (
  SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY attempt DESC, outcome DESC) AS i FROM (
    SELECT l_orderkey AS document_id, l_linenumber AS attempt, CASE l_returnflag WHEN 'A' THEN 'ok' WHEN 'R' THEN 'rejected' ELSE 'error' END AS outcome FROM lineitem)) WHERE i = 1""")
def document_status(spark, sf_dir):
    """K-16, Z-14: status from the latest attempt."""
    outcome = F.when(F.col("l_returnflag") == "A", "ok").when(F.col("l_returnflag") == "R", "rejected").otherwise("error")
    attempts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("attempt"), outcome.alias("outcome"), F.lit(3).alias("max_attempts"))
    return ops.document_statuses(attempts)


@query("""WITH r AS (SELECT user_id, event_type, event_id, value, event_id % 3 = 0 AS late FROM events), h AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM r WHERE NOT (late AND user_id % 4 <> 0))
SELECT user_id, event_type, event_id, value FROM h WHERE n = 1""")
def replaced_on_storage(spark, sf_dir):
    """K-03: last write wins on storage: a table in buckets of its keys, of which a batch rewrites those that it touches."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    path, keys = landing_folder(spark, "replaced"), ["user_id", "event_type"]
    late = F.col("event_id") % 3 == 0
    first = events.where(~late)
    buckets.create(first.join(first.groupBy(*keys).agg(F.max("event_id").alias("event_id")), [*keys, "event_id"], "left_semi").select(*events.columns), path, keys, 16)
    batch = events.where(late & (F.col("user_id") % 4 == 0))
    buckets.replace_by_key(spark, batch, path, keys, 16, "event_id")
    buckets.replace_by_key(spark, batch, path, keys, 16, "event_id")  # once more: nothing changes
    return buckets.read(spark, path).select(*events.columns)
