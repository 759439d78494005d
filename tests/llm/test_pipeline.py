"""Each stage of the pipeline on the result of the one before, against plain versions."""

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from lodestone.llm import lang_id, mixing
from lodestone.llm.decontaminate import find_leaks

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    found = {"documents": spark.read.parquet(f"{SF}/documents.parquet")}
    docs = found["documents"]
    for name, stage in pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        docs = found[name] = spark.read.parquet(f"{folder}/{name}")
    return found


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_stages_keep_the_columns(stages):
    columns = stages["documents"].columns
    assert all(df.columns == columns for name, df in stages.items() if name != "mixing")
    assert stages["mixing"].columns == [*columns, "target", "copies", "taken"]


def test_texts_of_known_language_stay(stages):
    before = stages["documents"]
    named = {r["doc_id"]: r for r in lang_id.identify(before, lang_id.fit(lang_id.learn_from(before))).collect()}
    kept = dict(texts(stages["language_id"]))
    assert set(kept) == {i for i, r in named.items() if r["lang_pred"] != "und" and r["score"] >= 0.5} and len(kept) > 0.9 * len(named)


def test_shared_lines_go(stages):
    assert dict(texts(stages["line_dedup"])) == {i: x[2] for i, x in brute.without_lines(texts(stages["language_id"])).items()}
    assert stages["line_dedup"].where(F.char_length("text") != F.col("n_chars")).isEmpty()


def test_one_of_each_group_stays(stages):
    before = texts(stages["line_dedup"])
    assert sorted(texts(stages["near_dup"])) == sorted((i, t) for i, t in before if brute.components(before)[i] == i)


def test_leaks_go(spark, stages):
    leaks = {r["doc_id"] for r in find_leaks(stages["near_dup"], spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert sorted(texts(stages["decontaminate"])) == sorted((i, t) for i, t in texts(stages["near_dup"]) if i not in leaks)


def test_the_mix_is_that_of_the_operator(stages):
    got = {r["doc_id"]: r for r in stages["mixing"].collect()}
    assert got and all(r["copies"] > 0 and r["taken"] == r["copies"] * len(brute.words(r["text"])) for r in got.values())
    sizes = mixing.source_targets(stages["decontaminate"].select("source", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size")), (5, 2, 1), 1.5, 2.0)
    for r in sizes.collect():
        own = [x for x in got.values() if x["source"] == r["source"]]
        assert abs(sum(x["taken"] for x in own) - r["target"]) <= max((len(brute.words(x["text"])) for x in own), default=0)


def test_odd_rows_pass_all_stages(spark, odd):
    docs = odd
    for name, stage in pipeline.STAGES:
        found = stage(spark, docs, SF)
        docs = spark.createDataFrame(found.collect(), found.schema)
        if name != "mixing":
            assert docs.columns == odd.columns
    assert {r["doc_id"] for r in docs.collect()} >= {3, 4}
    none = odd.limit(0)
    assert all(stage(spark, none, SF).isEmpty() for _, stage in pipeline.STAGES)


def test_texts_that_share_an_id_stay(spark):
    rows = [(1, "one two three four five six", "en", "a", 27), (1, "other words that are not like these", "en", "a", 35), (1, "one two three four five six", "en", "b", 27), (2, "ONE two three four five six", "en", "a", 27)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r["doc_id"], r["text"], r["source"]) for r in pipeline.near_dup(spark, docs, SF).collect()) == [(1, rows[0][1], "a"), (1, rows[1][1], "a")]


def test_run_is_the_stages_in_turn(spark, stages):
    key = lambda df: sorted((r["doc_id"], r["copies"]) for r in df.collect())
    assert key(pipeline.run(spark, SF)) == key(stages["mixing"])
