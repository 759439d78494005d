"""What the third review found: results that differed from their SQL on larger tables, and work that lay in few tasks."""

import oracle
import __spark_entry__ as entry
from pyspark.sql import functions as F


def _same(spark, name, sf_dir):
    return oracle.differences(entry.queries()[name](spark, sf_dir), entry.oracle_sql()[name], oracle.duck(sf_dir))


def test_feed_titles_with_other_entities_are_read_as_they_are(spark, tmp_path):
    titles = ["a &quot;b&quot; &amp; c", "x &lt;i&gt; y", "&amp;quot; &amp;amp;", "]]> &nbsp;z", "plain"]
    rows = [(i, f"https://h.example/{i}?a=1&lt;2", f"<html><title> {t}\n</title></html>") for i, t in enumerate(titles * 3)]
    path = str(tmp_path / "pages.parquet")
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).toPandas().to_parquet(path)
    assert _same(spark, "rss_items", str(tmp_path)) == ""


def test_figures_are_multiplied_as_the_sql_does(spark, tmp_path):
    rows = [(i, f"Some words of document {i}.") for i in (908, 37508, 38138, 38538, 4438, 7, 1, 2)]
    spark.createDataFrame(rows, "doc_id long, text string").toPandas().to_parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: r.value for r in entry.queries()["figures_in_texts"](spark, str(tmp_path)).collect()}
    expected = {k: v for k, v in oracle.duck(str(tmp_path)).execute(f"SELECT doc_id, value FROM ({entry.oracle_sql()['figures_in_texts']})").fetchall()}
    assert found == expected and expected[37508] == 477.96000000000004  # to the last bit


def test_text_vectors_send_words_of_batches_not_of_texts(spark):
    from lodestone.operators.vectors import text_vectors

    docs = spark.range(400).select(F.concat(F.lit("one two three four five six "), F.col("id").cast("string")).alias("text")).cache()
    assert text_vectors(docs).select("content_hash").distinct().count() == 400
    plan = text_vectors(docs)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(content_hash" not in plan and "SortMergeJoin" not in plan


def test_planted_rows_of_a_small_file_are_many_tasks(spark, tmp_path):
    from lodestone.plans import planted

    spark.range(2_000).select(F.col("id").alias("c_custkey"), (F.col("id") % 25).alias("c_nationkey"), F.lit(1.5).alias("c_acctbal")).toPandas().to_parquet(str(tmp_path / "customer.parquet"))
    made = planted.rows(spark, str(tmp_path))
    assert made.count() == 2_000
    assert made.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_similarities_of_a_block_are_held_for_few_questions_at_once():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from lodestone.operators import retrieval

    made = np.random.default_rng(1).standard_normal((5_000, 8))
    lists = lambda rows: pa.array(list(rows), pa.list_(pa.float64()))
    chunks = pa.table({"_key": pa.array(range(4_000)), "_vector": lists(made[:4_000])})
    questions = pa.table({"question_id": pa.array(range(1_000)), "_vector": lists(made[4_000:])})
    tracemalloc.start()
    found = retrieval._block_top(5)(chunks, questions).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20_000_000  # all similarities are 32 MB
    unit = made / np.linalg.norm(made, axis=1)[:, None]
    best = np.argsort(-(unit[4_000:] @ unit[:4_000].T), axis=1)[:, :5]
    assert [r["_key"] for r in found] == best.ravel().tolist()


def test_sessions_of_a_stream_of_several_files(spark, monkeypatch):
    from lodestone.plans import stream_queries

    monkeypatch.setattr(stream_queries, "_ROWS_A_FILE", 300)
    names = []
    monkeypatch.setattr(stream_queries.ops, "read_events", lambda s, path, schema, real=stream_queries.ops.read_events: names.append(path) or real(s, path, schema))
    assert _same(spark, "stream_sessions", "/root/testdata/sf0.001") == ""
    assert spark.read.parquet(names[0]).select(F.input_file_name()).distinct().count() > 1
