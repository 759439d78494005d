"""Queries over embeddings: exact similarity, top-k, rerank."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions.periods import filing_date, recency
from lodestone.operators import retrieval as ops
from lodestone.operators.vectors import text_vectors as hashed_vectors
from lodestone.plans.registry import query
from lodestone.session import table


def _chunks(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("long").alias("document_id"), F.md5((F.col("vec_id") % 250).cast("string")).alias("content_hash"), "embedding")


_COS = "list_inner_product(a.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])))"
_CHUNKS_SQL = "chunks AS (SELECT vec_id AS chunk_id, label::BIGINT AS document_id, md5((vec_id % 250)::VARCHAR) AS content_hash, embedding FROM embeddings)"


@query(f"WITH {_CHUNKS_SQL} SELECT a.chunk_id, a.document_id, round({_COS}, 9) AS similarity FROM chunks a, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY {_COS} DESC, a.chunk_id LIMIT 50")
def top_k_similarity(spark, sf_dir):
    """V-01, O-01: exact cosine top-k for one question."""
    asked = table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding")
    return ops.top_k(_chunks(spark, sf_dir), asked).select("chunk_id", "document_id", F.round("similarity", 9).alias("similarity"))


_PER_QUERY_SQL = f"""WITH {_CHUNKS_SQL}, q AS (SELECT vec_id AS question_id, embedding FROM embeddings WHERE vec_id % 20 = 0),
scored AS (SELECT q.question_id, a.chunk_id, a.document_id, a.content_hash, {_COS} AS similarity FROM chunks a, q),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY similarity DESC, chunk_id) AS place FROM scored) WHERE place <= 50)"""


def _per_query(spark, sf_dir):
    questions = table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("question"))
    return ops.top_k_per_query(_chunks(spark, sf_dir), questions, 50)


@query(f"{_PER_QUERY_SQL} SELECT question_id, place, chunk_id, round(similarity, 9) AS similarity FROM top")
def top_k_per_query(spark, sf_dir):
    """V-01, W-15: top-k of each of a stated set of questions."""
    return _per_query(spark, sf_dir).select("question_id", F.col("place").cast("long").alias("place"), "chunk_id", F.round("similarity", 9).alias("similarity"))


@query(f"""{_PER_QUERY_SQL.replace('WITH', 'WITH RECURSIVE', 1)}, scored2 AS (
  SELECT question_id, chunk_id, document_id, content_hash, round(similarity, 9) + 0.02 * (CASE WHEN chunk_id % 3 = 0 THEN 1.0 WHEN chunk_id % 3 = 1 THEN 0.5 ELSE 0.0 END) AS score FROM top
), ordered AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS i FROM scored2),
fold AS (
  SELECT question_id, 0::BIGINT AS i, []::VARCHAR[] AS hashes, []::BIGINT[] AS docs, []::BIGINT[] AS ids FROM q
  UNION ALL
  SELECT f.question_id, o.i, CASE WHEN ok THEN list_append(f.hashes, o.content_hash) ELSE f.hashes END, CASE WHEN ok THEN list_append(f.docs, o.document_id) ELSE f.docs END, CASE WHEN ok THEN list_append(f.ids, o.chunk_id) ELSE f.ids END
  FROM fold f JOIN (SELECT * FROM ordered) o ON o.question_id = f.question_id AND o.i = f.i + 1,
       LATERAL (SELECT len(f.ids) < 5 AND NOT list_contains(f.hashes, o.content_hash) AND len(list_filter(f.docs, lambda x: x = o.document_id)) < 2 AS ok)
), last AS (SELECT question_id, arg_max(ids, i) AS ids FROM fold GROUP BY 1)
SELECT question_id, generate_subscripts(ids, 1)::BIGINT AS place, unnest(ids) AS chunk_id FROM last""")
def rerank_greedy(spark, sf_dir):
    """V-03, V-04, T1, D-05: greedy rerank as an ordered fold."""
    bonus = F.when(F.col("chunk_id") % 3 == 0, 1.0).when(F.col("chunk_id") % 3 == 1, 0.5).otherwise(0.0)
    scored = _per_query(spark, sf_dir).withColumn("score", ops.bonus_score(F.round("similarity", 9), bonus, F.lit(None).cast("double")))
    return ops.rerank(scored, 5).select("question_id", F.col("place").cast("long").alias("place"), "chunk_id")


@query("""SELECT DISTINCT d.doc_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.doc_id IS NULL AND length(d.text) > 0""")
def missing_embeddings(spark, sf_dir):
    """J-06, J-07, A-07, V-05: backlog by anti join, one row for each content hash of a document."""
    docs = table(spark, sf_dir, "documents").where(F.char_length("text") > 0).select("doc_id", F.sha2("text", 256).alias("content_hash"))
    done = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("_d"))
    backlog = docs.dropDuplicates(["doc_id", "content_hash"]).join(done, F.col("doc_id") == F.col("_d"), "left_anti")
    return docs.select("doc_id").distinct().join(backlog.select(F.col("doc_id").alias("_b")), F.col("doc_id") == F.col("_b"), "left_semi")


@query("""WITH c AS (SELECT DISTINCT sha256(text) AS content_hash, text FROM documents WHERE text IS NOT NULL), w AS (SELECT content_hash, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS word FROM c),
n AS (SELECT content_hash, word, count(*) AS n FROM w GROUP BY 1, 2), r AS (SELECT word, ln((1 + (SELECT count(DISTINCT content_hash) FROM n)) / (1 + count(*))) + 1 AS idf FROM n GROUP BY 1),
v AS (SELECT content_hash, ('0x' || left(md5(word), 6))::INT % 1024 AS dim, sum(n * idf * CASE WHEN ('0x' || substr(md5(word), 7, 1))::INT % 2 = 0 THEN 1 ELSE -1 END) AS v FROM n JOIN r USING (word) GROUP BY 1, 2)
SELECT content_hash, count(*) FILTER (WHERE abs(v) > 1e-9) AS dims, round(sum(v * (dim % 7 - 3)) / sqrt(sum(v * v)), 6) + 0.0 AS probe, 1.0 AS length FROM v GROUP BY 1""")
def text_vectors(spark, sf_dir):
    """S-17: texts as vectors of 1,024 hashed dimensions, one for each content hash: how many are not zero, the product with a fixed vector, the length."""
    found = hashed_vectors(table(spark, sf_dir, "documents"))
    probe = F.sum(F.col("value") * (F.col("dim") % 7 - 3))
    return found.groupBy("content_hash").agg(F.count(F.lit(1)).alias("dims"), (F.round(probe, 6) + F.lit(0.0)).alias("probe"), F.round(F.sqrt(F.sum(F.col("value") * F.col("value"))), 6).alias("length"))


@query("""SELECT count(*) AS n, count(*) FILTER (WHERE len(v) = 64 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0) AS sound
FROM (SELECT CASE vec_id % 7 WHEN 0 THEN list_transform(embedding, lambda x, i: CASE WHEN i = 9 THEN 'nan'::FLOAT ELSE x::FLOAT END) WHEN 1 THEN list_transform(embedding, lambda x, i: CASE WHEN i = 9 THEN '-inf'::FLOAT ELSE x::FLOAT END)
  WHEN 2 THEN list_transform(embedding, lambda x, i: CASE WHEN i = 9 THEN NULL ELSE x::FLOAT END) WHEN 3 THEN list_slice(embedding, 1, 63) ELSE embedding END::FLOAT[] AS v FROM embeddings)""")
def embedding_checks(spark, sf_dir):
    """V-06, S-17: dimension and finiteness, where a component of some vectors is made no number, infinite, or null, or is cut off."""
    k, v = F.col("vec_id") % 7, F.col("embedding").cast("array<float>")
    odd = F.when(k == 0, float("nan")).when(k == 1, float("-inf")).cast("float")
    spoilt = F.when(k < 3, F.transform(v, lambda x, i: F.when(i == 8, odd).otherwise(x))).when(k == 3, F.slice(v, 1, 63)).otherwise(v)
    return table(spark, sf_dir, "embeddings").agg(F.count(F.lit(1)).alias("n"), F.count_if(ops.is_sound(spoilt, 64)).alias("sound"))


@query("""WITH b AS (SELECT source, doc_id, n_chars, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 8 AS batch FROM documents),
s AS (SELECT source, batch, sum(n_chars) AS n FROM b GROUP BY 1, 2), o AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY source ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM s)
SELECT b.doc_id, b.batch FROM b JOIN o ON o.source = b.source AND o.batch = b.batch WHERE o.spent < 50000""")
def token_batches(spark, sf_dir):
    """V-07: batches under a token budget."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return ops.token_batches(docs, 8, 50_000, "source", "doc_id", "n_chars").select("doc_id", "batch")


@query("""SELECT doc_id, CASE WHEN length(t) <= 300 THEN t ELSE rtrim(CASE WHEN contains(left(t, 300), ' ') THEN regexp_replace(left(t, 300), ' [^ ]*$', '') ELSE left(t, 300) END, ' ') || '…' END AS excerpt
FROM (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')) AS t FROM documents)""")
def excerpts(spark, sf_dir):
    """T-05."""
    return table(spark, sf_dir, "documents").select("doc_id", ops.excerpt(F.col("text")).alias("excerpt"))


_FILED = "CASE o_orderkey % 4 WHEN 0 THEN date_trunc('month', o_orderdate)::DATE + INTERVAL 25 YEAR WHEN 1 THEN make_date(year(o_orderdate) + 25, 6, 30) WHEN 3 THEN make_date(year(o_orderdate) + 25, 6, 30) END::DATE"


@query(f"""SELECT o_orderkey, filing, CASE WHEN date_diff('day', filing, DATE '2026-09-27') <= 365 THEN 1.0::DOUBLE WHEN date_diff('day', filing, DATE '2026-09-27') <= 730 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS recency
FROM (SELECT o_orderkey, {_FILED} AS filing FROM orders)""")
def filing_recency(spark, sf_dir):
    """D-04, D-05: dates of free-text periods of orders, 25 years on: a month with its year, a year alone, no date, a year after what is no month."""
    day, k = F.add_months(F.to_date("o_orderdate"), 300), F.col("o_orderkey") % 4
    year = F.year(day).cast("string")
    label = F.when(k == 0, F.date_format(day, "MMM yyyy")).when(k == 1, F.concat(F.lit("Annual Report "), year)).when(k == 2, "no date").otherwise(F.concat(F.lit("Xyz "), year))
    dated = table(spark, sf_dir, "orders").select("o_orderkey", filing_date(label).alias("filing"))
    return dated.withColumn("recency", recency(F.col("filing"), F.to_date(F.lit("2026-09-27"))))
