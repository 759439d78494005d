"""Texts as vectors by signed feature hashing: words to dimensions and signs, weighted by rarity, of unit length."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"
#: Characters of the texts whose words are weighed in one task at a time, about, and texts that have their sums at once.
BATCH_CHARS, TEXTS_AT_ONCE = 4_000_000, 1_000


def dimension(word: Column, dims: int) -> Column:
    """A word's dimension, from the first six digits of its MD5."""
    return F.conv(F.substring(F.md5(word.cast("binary")), 1, 6), 16, 10).cast("int") % dims


def sign(word: Column) -> Column:
    """A word's sign, from the seventh digit of its MD5, independent of its dimension."""
    return F.when(F.conv(F.substring(F.md5(word.cast("binary")), 7, 1), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)


def _weigh(dims: int):
    def run(texts: pa.Table, vocabulary: pa.Table) -> pa.Table:
        hashes, rows_dims, rows_values = [], [], []
        known, place, weight = vocabulary["_word"].combine_chunks(), vocabulary["_dim"].to_numpy(), vocabulary["_weight"].to_numpy()
        for at in range(0, texts.num_rows, TEXTS_AT_ONCE):
            part = texts.slice(at, TEXTS_AT_ONCE)
            lists = part["_words"].combine_chunks()
            word = pc.index_in(lists.flatten(), value_set=known).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(part.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            sums = np.bincount(row * dims + place[word], weight[word], part.num_rows * dims).reshape(part.num_rows, dims)
            length = np.sqrt((sums * sums).sum(axis=1))
            for name, v, n in zip(part["content_hash"].to_pylist(), sums, length, strict=True):
                if n > 1e-9:
                    some = np.flatnonzero(np.abs(v / n) > 1e-12)
                    hashes.append(name)
                    rows_dims.append(some.astype(np.int32))
                    rows_values.append(v[some] / n)
        return pa.table({"content_hash": pa.array(hashes, pa.string()), "_dims": pa.array(rows_dims, pa.list_(pa.int32())), "_values": pa.array(rows_values, pa.list_(pa.float64()))})

    return run


def text_vectors(docs: DataFrame, text: str = "text", dims: int = 1024) -> DataFrame:
    """content_hash, dim and value for each dimension that is not zero, of each distinct text with words.

    A word weighs its count in the text times ln((1 + texts) / (1 + texts with it)) + 1, and adds that with its sign to its
    dimension; vectors have length 1. Copies of a text give one vector, found by content hash and not read again.
    Texts are dealt by hash to batches of about BATCH_CHARS characters, and only the distinct words of a batch are sent to have
    their weight looked up, not those of each text; a word that all texts have is one row for each batch. Null texts and texts without
    words have no vector.
    """
    batches = max(1, -(-(docs.agg(F.sum(F.char_length(F.col(text)))).first()[0] or 0) // BATCH_CHARS))
    named = docs.where(F.col(text).isNotNull()).select(F.sha2(F.col(text).cast("binary"), 256).alias("content_hash"), F.col(text).alias("_text"))
    dealt = named.withColumn("_batch", F.pmod(F.xxhash64("content_hash"), F.lit(batches)).cast("int")).repartition("_batch")
    once = dealt.dropDuplicates(["_batch", "content_hash"])
    texts = once.select("_batch", "content_hash", F.regexp_extract_all(F.lower("_text"), F.lit(WORD), F.lit(0)).alias("_words"))
    held = texts.select("_batch", F.explode(F.array_distinct("_words")).alias("_word")).groupBy("_batch", "_word").agg(F.count(F.lit(1)).alias("_n"))
    total = once.agg(F.count_if(F.lower("_text").rlike(WORD)).alias("_texts"))
    every = held.withColumn("_df", F.sum("_n").over(Window.partitionBy("_word"))).crossJoin(F.broadcast(total))  # one row
    idf = F.ln((1 + F.col("_texts")) / (1 + F.col("_df"))) + 1
    vocabulary = every.select(F.col("_batch").alias("_of"), "_word", dimension(F.col("_word"), dims).alias("_dim"), (idf * sign(F.col("_word"))).alias("_weight"))
    found = texts.groupBy("_batch").cogroup(vocabulary.groupBy("_of")).applyInArrow(_weigh(dims), "content_hash string, _dims array<int>, _values array<double>")
    return found.select("content_hash", F.inline(F.arrays_zip(F.col("_dims").alias("dim"), F.col("_values").alias("value"))))


def as_dense(vectors: DataFrame, dims: int = 1024) -> DataFrame:
    """content_hash and embedding, an array of dims floats."""
    held = vectors.groupBy("content_hash").agg(F.map_from_entries(F.collect_list(F.struct("dim", "value"))).alias("_m"))
    return held.select("content_hash", F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.element_at("_m", i), F.lit(0.0)).cast("float")).alias("embedding"))
