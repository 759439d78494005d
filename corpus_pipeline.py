"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import row_key, shared_folder, unused
from lodestone.llm.decontaminate import find_leaks
from lodestone.llm.lang_id import UNKNOWN, fit, identify, learn_from
from lodestone.llm.line_dedup import dedup_lines
from lodestone.llm.mixing import mix_sources
from lodestone.llm.near_dup import near_duplicates, text_key
from lodestone.session import table

#: A text whose best language is less probable than this is rejected.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; texts without letters, or of no clear language, go."""
    named = identify(docs, fit(learn_from(docs)))
    return named.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten or more of them share."""
    found = dedup_lines(docs)
    replaced = found.withColumns({"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")})
    return replaced.select(*docs.columns)


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id; rows without id stay.

    Rows that repeat an id are told apart by their text: of those with one text too, the first by the
    order of their columns stays.
    """
    key, kept_id, kept_key = unused(docs, "_text_key", "_kept_id", "_kept_key")
    kept = near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias(kept_id), F.col("text_key").alias(kept_key)).distinct()
    keyed = docs.withColumn(key, text_key(F.col("text")))
    chosen = keyed.join(kept, (F.col("doc_id") == F.col(kept_id)) & (F.col(key) == F.col(kept_key)), "left_semi")
    one = chosen.groupBy("doc_id", key).agg(F.min(F.struct(*[c for c in docs.columns if c != "doc_id"])).alias(kept_id))
    return one.select("doc_id", f"{kept_id}.*").select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, be it with other numbers, names or units."""
    k1, k2, a, b = unused(docs, "_k1", "_k2", "_a", "_b")
    leaks = find_leaks(docs, table(spark, sf_dir, "benchmark")).select(F.col("_k1").alias(a), F.col("_k2").alias(b)).distinct()
    keys = row_key(F.col("doc_id"), F.col("text"))
    keyed = docs.withColumns({k1: keys[0], k2: keys[1]})
    return keyed.join(leaks, (F.col(k1) == F.col(a)) & (F.col(k2) == F.col(b)), "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix with the copies of each, their words (taken) and their source's target.

    Columns of these names are replaced.
    """
    docs = docs.drop("target", "copies", "taken")
    row, mixed = unused(docs, "_row", "_mixed")
    keyed = docs.withColumn(row, F.concat_ws(":", *row_key(F.col("doc_id"), F.col("text"), F.col("source"))))
    found = mix_sources(keyed, doc_id=row).where("copies > 0").groupBy(F.col("doc_id").alias(mixed))
    found = found.agg(F.max("target").alias("target"), F.sum("copies").alias("copies"), F.sum("taken").alias("taken"))
    return keyed.dropDuplicates([row]).join(found, F.col(row) == F.col(mixed)).select(*docs.columns, "target", "copies", "taken")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dup", near_dup), ("decontaminate", decontaminate), ("mixing", mixing)]

#: Language identification and near duplicates have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents, by way of tables in the shared folder."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
