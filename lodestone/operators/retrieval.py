"""Exact vector retrieval: similarity, top-k, a greedy rerank with caps, excerpts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.dims import CANDIDATES, MAX_PER_DOCUMENT, PROFILE_WEIGHT, RECENCY_WEIGHT


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, added from the first component on."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_similarity(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def is_sound(vector: Column, size: int) -> Column:
    """Whether a vector has the right length and only finite components."""
    return (F.size(vector) == size) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def top_k(chunks: DataFrame, question: list[float] | DataFrame, k: int = CANDIDATES, vector: str = "embedding", key: str = "chunk_id") -> DataFrame:
    """The k chunks most similar to one question vector, ties to the smaller id; a top-k sort, not a full one.

    question: the values, or a frame whose first row has them in its only column; that row is broadcast.
    """
    if isinstance(question, DataFrame):
        asked = chunks.crossJoin(F.broadcast(question.limit(1).toDF("_asked")))
    else:
        asked = chunks.withColumn("_asked", F.array(*[F.lit(float(x)) for x in question]))
    return asked.withColumn("similarity", cosine_similarity(F.col(vector), F.col("_asked"))).drop("_asked").orderBy(F.desc("similarity"), key).limit(k)


#: Vectors of chunks and of questions that meet in one task.
CHUNK_BLOCK, QUESTION_BLOCK = 20_000, 1_000
#: Questions whose similarities to a block of chunks are held at once.
AT_ONCE = 32
#: By so much two ways of adding up a similarity may differ.
_SLACK = 1e-9


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows of doubles; those that are null, of another length than the first or hold nulls are rows of zeros."""
    lists = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    width = next((int(n) for n in lengths if n), 1)
    out = np.zeros((len(lists), width))
    fit = np.flatnonzero(lengths == width)
    if len(fit):
        values = lists.take(pa.array(fit)).flatten()
        nulls = values.is_null().to_numpy(zero_copy_only=False).reshape(-1, width).any(axis=1)
        rows = values.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(-1, width)
        out[fit] = np.where(nulls[:, None], 0.0, rows)
    return out


def _block_top(k: int):
    def run(chunks: pa.Table, questions: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if chunks.num_rows and questions.num_rows:
            a, q = _vectors(chunks["_vector"]), _vectors(questions["_vector"])
            if a.shape[1] == q.shape[1]:
                norm = lambda m: np.sqrt(_fold(m, m))
                na, nq, ids, asked = norm(a), norm(q), chunks["_key"].to_numpy(), questions["question_id"].to_pylist()
                for i in range(len(asked)):
                    if i % AT_ONCE == 0:
                        with np.errstate(all="ignore"):
                            near = q[i : i + AT_ONCE] @ a.T
                            near /= nq[i : i + AT_ONCE, None]
                            near /= na
                        np.nan_to_num(near, copy=False, nan=-2.0)
                    row = near[i % AT_ONCE]
                    least = np.partition(row, -k)[-k] if len(row) > k else -1.5
                    some = np.flatnonzero((row >= least - _SLACK) & (row > -1.5))
                    score = _fold(a[some], np.broadcast_to(q[i], a[some].shape)) / (na[some] * nq[i])
                    best = np.lexsort((ids[some], -score))[:k]
                    out += zip([asked[i]] * len(best), ids[some][best].tolist(), score[best].tolist(), strict=True)
        asked, keys, scores = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"question_id": pa.array(asked, pa.int64()), "_key": pa.array(keys, pa.int64()), "similarity": pa.array(scores, pa.float64())})

    return run


def _fold(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, added from the first component on, as dot() does."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total = total + a[:, j] * b[:, j]
    return total


def top_k_per_query(chunks: DataFrame, questions: DataFrame, k: int, vector: str = "embedding", key: str = "chunk_id") -> DataFrame:
    """The k most similar chunks of each question (question_id, question), exact, ties to the smaller key; place from 1.

    Chunks and questions are cut into blocks by hash, each block of one meets each block of the other in a task of
    bounded size as one matrix product, and keeps the k best of each question there; these are ranked. Nothing is
    broadcast, and what is shuffled grows with chunks times blocks of questions. What rounding could order otherwise
    is added up anew from the first component on. key and question_id are integers; chunks whose vector is null, has
    nulls, no length or another length than the question's are found for none. Rows that repeat a key are one.
    """
    n_chunks, n_questions = -(-chunks.count() // CHUNK_BLOCK) or 1, -(-questions.count() // QUESTION_BLOCK) or 1
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    once = chunks.dropDuplicates([key])
    left = once.select(F.col(key).cast("long").alias("_key"), F.col(vector).cast("array<double>").alias("_vector"), block(key, n_chunks).alias("_c"), every(n_questions).alias("_q"))
    right = questions.select(F.col("question_id").cast("long"), F.col("question").cast("array<double>").alias("_vector"), block("question_id", n_questions).alias("_q"), every(n_chunks).alias("_c"))
    found = left.groupBy("_c", "_q").cogroup(right.groupBy("_c", "_q")).applyInArrow(_block_top(k), "question_id long, _key long, similarity double")
    place = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("similarity"), "_key"))
    best = found.withColumn("place", place).where(F.col("place") <= k)
    return best.join(once.drop(vector), F.col("_key") == F.col(key)).drop("_key")


def bonus_score(similarity: Column, recency: Column, profile_similarity: Column) -> Column:
    """Similarity with small bonuses for recent documents and for those near the profile (never below 0)."""
    return similarity + RECENCY_WEIGHT * recency + PROFILE_WEIGHT * F.greatest(F.coalesce(profile_similarity, F.lit(0.0)), F.lit(0.0))


def rerank(candidates: DataFrame, k: int, per_document: int = MAX_PER_DOCUMENT) -> DataFrame:
    """Greedy choice by score: skip texts that were chosen already and documents with enough passages.

    candidates: question_id, chunk_id, document_id, content_hash, score, at most CANDIDATES a question. A
    fold over each question's ordered candidates: a text counts as seen only once it is chosen, which
    independent windows cannot express. Returns question_id, place, chunk_id, score.
    """
    item = F.struct((-F.col("score")).alias("s"), F.col("chunk_id").alias("chunk_id"), F.col("document_id").alias("doc"), F.col("content_hash").alias("hash"), F.col("score").alias("score"))
    grouped = candidates.groupBy("question_id").agg(F.sort_array(F.collect_list(item)).alias("_items"))
    start = F.slice(F.col("_items"), 1, 0)

    def step(chosen: Column, x: Column) -> Column:
        seen = F.exists(chosen, lambda c: c["hash"] == x["hash"])
        full = F.size(F.filter(chosen, lambda c: c["doc"] == x["doc"])) >= per_document
        return F.when((F.size(chosen) >= k) | seen | full, chosen).otherwise(F.array_append(chosen, x))

    return grouped.select("question_id", F.posexplode(F.aggregate("_items", start, step)).alias("_i", "_x")).select(
        "question_id", (F.col("_i") + 1).alias("place"), F.col("_x.chunk_id").alias("chunk_id"), F.col("_x.score").alias("score")
    )


def excerpt(text: Column, limit: int = 300) -> Column:
    """White space tidied, cut at a word near limit characters and marked by an ellipsis."""
    tidy = F.trim(F.regexp_replace(text, r"\s+", " "))
    cut = F.substring(tidy, 1, limit)
    whole_words = F.when(F.contains(cut, F.lit(" ")), F.regexp_replace(cut, r" [^ ]*$", "")).otherwise(cut)
    return F.when(F.char_length(tidy) <= limit, tidy).otherwise(F.concat(F.rtrim(whole_words), F.lit("…")))


def token_batches(chunks: DataFrame, size: int = 32, budget: int | None = None, group: str = "document_id", order: str = "chunk_id", tokens: str = "tokens") -> DataFrame:
    """Number chunks into batches of a group; with a budget, only batches that start before it is used up."""
    window = Window.partitionBy(group).orderBy(order)
    batches = chunks.withColumn("batch", F.floor((F.row_number().over(window) - 1) / size))
    if budget is None:
        return batches
    sums = batches.groupBy(group, "batch").agg(F.sum(tokens).alias("_n"))
    spent = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_batches = sums.withColumn("_spent", spent).where(F.col("_spent") < budget).select(F.col(group).alias("_g"), F.col("batch").alias("_b"))
    return batches.join(open_batches, (F.col(group) == F.col("_g")) & (F.col("batch") == F.col("_b")), "left_semi")
