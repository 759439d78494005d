"""Ranked lexical search in integers: postings traversed in windows of doc_id, scores added into small arrays, kept in heaps."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import ascii_lower, cut
from lodestone.session import table

#: A term is a maximal run of these: digits, letters and all that is not ASCII. One pattern for Spark and DuckDB.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The same rule on UTF-8 bytes: other ASCII becomes a space, A-Z becomes a-z.
FOLDED = bytes(ord(chr(b).lower()) if chr(b).isalnum() or b >= 128 else 32 for b in range(128)) + bytes(range(128, 256))
#: Documents of a window; its sums (twice as many, for rows that repeat an id) take 512 KB.
WINDOW = 1 << 15
#: (item, term) pairs of the queries that are searched together; they and their terms are what is broadcast.
PAIRS = 1 << 20
#: Ids of null stand after all others.
NO_ID = (1 << 63) - 1


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, term and times of each term of an item. Rows that share an item_id are one item; a null text has no terms."""
    words = F.explode(F.regexp_extract_all(ascii_lower(F.col(text)), F.lit(TERM), F.lit(0)))
    return items.select(F.col(item_id).cast("long").alias("item_id"), words.alias("term")).groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times"))


def query_blocks(pairs: DataFrame, most: int = PAIRS) -> Iterator[list[tuple[int | None, list[tuple[bytes, int]]]]]:
    """Items with their terms, in blocks of about so many pairs; an item is never split."""
    block, item, size = [], (), 0
    for row in pairs.orderBy("item_id").toLocalIterator():
        if (row["item_id"],) != item:
            if size >= most:
                yield block
                block, size = [], 0
            item = (row["item_id"],)
            block.append((row["item_id"], []))
        block[-1][1].append((row["term"].encode(), row["times"]))
        size += 1
    if block:
        yield block


# ---- documents to postings --------------------------------------------------------------------------------

_POSTINGS = pa.schema([("docs", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int64()))])
POSTINGS_SCHEMA = "docs long, doc_id long, n long, terms array<int>, tfs array<long>"


def _lists(values: list[np.ndarray], kind: np.dtype) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(kind)))


def _count(vocabulary: object):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = vocabulary.value
        df, docs, length, get = np.zeros(len(place), np.int64), 0, 0, place.get
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                some = batch.slice(low, 1000)
                ids, ns, terms, tfs = [], [], [], []
                for doc_id, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    words = (text or b"").translate(FOLDED).split()
                    if not words:
                        continue
                    docs += 1
                    length += len(words)
                    found = np.fromiter(map(get, words, repeat(-1)), np.int32, len(words))
                    found, times = np.unique(found[found >= 0], return_counts=True)
                    if len(found):
                        df[found] += 1
                        ids.append(doc_id), ns.append(len(words)), terms.append(found), tfs.append(times)
                if ids:
                    columns = [pa.array([None] * len(ids), pa.int64()), pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), _lists(terms, np.int32), _lists(tfs, np.int64)]
                    yield pa.RecordBatch.from_arrays(columns, schema=_POSTINGS)
        held = np.flatnonzero(df)
        columns = [pa.array([docs], pa.int64()), pa.array([None], pa.int64()), pa.array([length], pa.int64()), _lists([held], np.int32), _lists([df[held]], np.int64)]
        yield pa.RecordBatch.from_arrays(columns, schema=_POSTINGS)

    return run


def postings(docs: DataFrame, vocabulary: object, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Each document's terms of the vocabulary with their counts (docs is null), and a row of sums for each task.

    vocabulary: a broadcast dict of terms (bytes) and places. n is a document's terms of any kind. In a
    task's row docs counts its documents with terms, n sums all their terms, and tfs are the documents that hold each of the terms.
    """
    chosen = docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string").cast("binary"))
    return chosen.mapInArrow(_count(vocabulary), POSTINGS_SCHEMA)


# ---- scoring ----------------------------------------------------------------------------------------------


class WindowScorer:
    """Scores the documents of one window after another for a block of items and keeps each item's best.

    items: for each item (place, times) pairs; weights by place; docs and length of the whole corpus.
    """

    def __init__(self, items: list[list[tuple[int, int]]], weights: np.ndarray, docs: int, length: int, top: int):
        self.items, self.weights, self.docs, self.length, self.top = items, weights, docs, length, top
        self.sums = np.zeros(2 * WINDOW, np.int64)
        self.taken = np.zeros(2 * WINDOW // 64, np.uint64)
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in items]

    def shrink(self, n: np.ndarray) -> np.ndarray:
        """The document's m for n terms of its own; exact, also where 64 bits are too few."""
        if len(n) and 75 * int(n.max()) * self.docs >= 1 << 63:
            return np.array([25 + 75 * int(x) * self.docs // self.length for x in n], np.int64)
        return 25 + 75 * n * self.docs // self.length

    def window(self, ids: np.ndarray, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> None:
        """Score at most WINDOW documents of one window: ids sorted, sizes how many of terms and tfs each has."""
        again = np.concatenate([[False], ids[1:] == ids[:-1]])
        slots = ids % WINDOW
        slots[again] = WINDOW + np.arange(int(again.sum()))
        owner = np.zeros(2 * WINDOW, np.int64)
        owner[slots] = ids
        slot = np.repeat(slots, sizes)
        order = np.argsort(terms.astype(np.int64) * (2 * WINDOW) + slot)
        terms, slot = terms[order], slot[order]
        tf, m = tfs[order], np.repeat(self.shrink(n), sizes)[order]
        adds = self.weights[terms] * (1_000_000_000 * tf // (1000 * tf + 8 * m))
        begins = np.searchsorted(terms, np.arange(len(self.weights) + 1))
        # The occupancy of each term's documents, 64 to a word.
        word = slot >> 6
        first = np.flatnonzero(np.concatenate([[True], (terms[1:] != terms[:-1]) | (word[1:] != word[:-1])]))
        bits = np.bitwise_or.reduceat(np.uint64(1) << (slot & 63).astype(np.uint64), first)
        word, bit_begins = word[first], np.searchsorted(first, begins)
        for item, heap in zip(self.items, self.heaps, strict=True):
            for place, times in item:
                a, b = begins[place], begins[place + 1]
                if a < b:
                    self.sums[slot[a:b]] += adds[a:b] * times
                    a, b = bit_begins[place], bit_begins[place + 1]
                    self.taken[word[a:b]] |= bits[a:b]
            self.harvest(heap, owner)

    def harvest(self, heap: list[tuple[int, int]], owner: np.ndarray) -> None:
        """Empty the arrays into the heap of (score, -id), smallest first."""
        held = np.flatnonzero(self.taken)
        if not len(held):
            return
        inside = np.unpackbits(self.taken[held].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, bit = np.nonzero(inside)
        found = held[row] * 64 + bit
        scores = self.sums[found]
        self.sums[found] = 0
        self.taken[held] = 0
        least = max(1, heap[0][0] if len(heap) >= self.top else 1)
        better = scores >= least
        scores, ids = scores[better], owner[found[better]]
        if len(scores) > self.top:
            better = scores >= np.partition(scores, -self.top)[-self.top]
            scores, ids = scores[better], ids[better]
        best = np.lexsort((ids, -scores))[: self.top]
        for entry in zip(scores[best].tolist(), (-ids[best]).tolist(), strict=True):
            if len(heap) < self.top:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)


FOUND_SCHEMA = "item int, doc_id long, score long"


def _score(shared: object, docs: int, length: int, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = shared.value
        scorer = WindowScorer(items, weights, docs, length, top)
        held: list[pa.RecordBatch] = []
        now, rows = None, 0

        def flush() -> None:
            nonlocal held, rows
            if rows:
                t = pa.Table.from_batches(held).combine_chunks()
                terms, tfs = t["terms"].combine_chunks(), t["tfs"].combine_chunks()
                sizes = np.diff(terms.offsets.to_numpy())
                scorer.window(t["doc_id"].to_numpy(), t["n"].to_numpy(), sizes, terms.flatten().to_numpy(), tfs.flatten().to_numpy())
            held, rows = [], 0

        for batch in batches:
            ids = batch.column(0).to_numpy()
            windows = ids // WINDOW
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(windows)) + 1, [len(ids)]])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if a < b and windows[a] != now:
                    flush()
                    now = windows[a]
                while a < b:
                    n = min(b - a, WINDOW - rows)
                    held.append(batch.slice(a, n))
                    rows, a = rows + n, a + n
                    if rows == WINDOW:
                        flush()
        flush()
        found = [(i, None if id_ == -NO_ID else -id_, score) for i, heap in enumerate(scorer.heaps) for score, id_ in heap]
        if found:
            item, ids, scores = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], names=["item", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, top: int = 10, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score of the top highest-scoring documents of each item; scores above 0 only.

    Items are searched in blocks of bounded size against all documents. For a block, each document is read
    once and keeps its counts of the block's terms; sums of documents and terms come from the same rows. Those rows are
    range-partitioned by doc_id (and a hash, so that rows of one id may lie in several tasks) and
    traversed in windows of doc_id; a task yields the best of each item over all its windows, and these are ranked.

    Null and empty texts have no terms, count nowhere and are never found. Rows that repeat a doc_id
    are each a document, found with that id; a null id stands after all others in a tie.
    Without documents or items there are no rows. Other columns are not kept.
    """
    spark = docs.sparkSession
    result = None
    for block in query_blocks(item_terms(items, item_id, item_text)):
        place: dict[bytes, int] = {}
        for _, terms in block:
            for term, _ in terms:
                place.setdefault(term, len(place))
        rows = cut(postings(docs, spark.sparkContext.broadcast(place), text, doc_id))
        sums = rows.where("docs IS NOT NULL")
        total = sums.agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")).first()
        if not total["docs"]:
            break
        df = np.zeros(len(place), np.int64)
        for row in sums.select(F.inline(F.arrays_zip("terms", "tfs"))).groupBy("terms").agg(F.sum("tfs").alias("df")).collect():  # a row for each term of the block
            df[row["terms"]] = row["df"]
        weights = np.array([math.floor(1000 * math.log((2 * total["docs"] + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        shared = spark.sparkContext.broadcast(([[(place[t], times) for t, times in terms] for _, terms in block], weights))
        held = rows.where("docs IS NULL").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "n", "terms", "tfs")
        salted = held.withColumn("_salt", F.xxhash64("n", "terms", "tfs")).repartitionByRange("doc_id", "_salt").sortWithinPartitions("doc_id")
        found = salted.drop("_salt").mapInArrow(_score(shared, total["docs"], total["n"], top), FOUND_SCHEMA)
        # First the best of each of 256 groups of tasks, so that no item's rows of all tasks meet in one.
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        grouped = found.withColumn("_group", F.spark_partition_id() % 256)
        near = grouped.withColumn("_rank", F.row_number().over(Window.partitionBy("item", "_group").orderBy(*order))).where(F.col("_rank") <= top)
        best = near.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], "item int, item_id long")
        ranked = best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        result = ranked if result is None else result.unionByName(ranked)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if result is None else result


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = rf"""
WITH words AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS terms
  FROM documents
), sized AS (
  SELECT rid, doc_id, terms, len(terms)::BIGINT AS n FROM words WHERE len(terms) > 0
), whole AS (
  SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM sized
), tf AS (
  SELECT rid, doc_id, n, term, count(*)::BIGINT AS tf
  FROM (SELECT rid, doc_id, n, unnest(terms) AS term FROM sized) GROUP BY rid, doc_id, n, term
), weight AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term), whole
), query AS (
  SELECT item_id, term, count(*)::BIGINT AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term FROM benchmark)
  GROUP BY item_id, term
), scored AS (
  SELECT item_id, rid, any_value(doc_id) AS doc_id,
         sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total))))::BIGINT AS score
  FROM query JOIN tf USING (term) JOIN weight USING (term), whole GROUP BY item_id, rid
)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM scored WHERE score > 0
) WHERE rank <= 10
"""
