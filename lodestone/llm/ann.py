"""Approximate nearest neighbours by shifted Hilbert curves over projected vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import cut, unplaced
from lodestone.session import table

#: Curves, dimensions that each projects to, and bits of each dimension in a key.
CURVES, DIMS, BITS = 16, 8, 6
#: Vectors in a block of a curve's order: a 64th of all, but between these bounds, so that what a task holds does not grow with the table.
LEAST_BLOCK, LARGEST_BLOCK = 128, 1024
#: Queries that the window is calibrated on, and the recall it must reach on them.
CALIBRATION, RECALL = 96, 0.95


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of cell numbers (each below 2**bits) along the Hilbert curve through all cells.

    The cells' bits are transposed into the curve's order from the highest bit down, undoing at each
    level the exchange or inversion of axes that the curve applies below it, then Gray-decoded.
    """
    x, (n, dims) = cells.astype(np.uint64).T.copy(), cells.shape
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        bit, below = one << np.uint64(level), (one << np.uint64(level)) - one
        for axis in range(dims):
            inverted = (x[axis] & bit) != 0
            exchange = np.where(inverted, np.uint64(0), (x[0] ^ x[axis]) & below)
            x[0] ^= np.where(inverted, below, exchange)
            if axis:
                x[axis] ^= exchange
    for axis in range(1, dims):
        x[axis] ^= x[axis - 1]
    flips = np.zeros(n, np.uint64)
    for level in range(bits - 1, 0, -1):
        flips ^= np.where((x[-1] >> np.uint64(level)) & one != 0, (one << np.uint64(level)) - one, np.uint64(0))
    x ^= flips
    key = np.zeros(n, np.uint64)
    for level in range(bits - 1, -1, -1):
        for axis in range(dims):
            key = (key << one) | ((x[axis] >> np.uint64(level)) & one)
    return key.astype(np.int64)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    n = len(column)
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.empty((0, 0))


def curve_keys(vectors: np.ndarray, longest: float, curves: int = CURVES) -> tuple[np.ndarray, np.ndarray]:
    """Keys (curve by vector) as candidates and as queries.

    Candidates get one more component that makes all of them as long as the longest, queries are
    stretched to that length: the largest inner product is then the nearest point. Each curve has
    projections and a shift of its own.
    """
    norms = np.linalg.norm(vectors, axis=1)
    extra = np.sqrt(np.maximum(longest**2 - norms**2, 0))
    d = vectors.shape[1] + 1
    dims = min(DIMS, d)
    out = []
    for points in (np.column_stack([vectors, extra]), np.column_stack([vectors * (longest / norms)[:, None], np.zeros(len(vectors))])):
        keys = []
        for curve in range(curves):
            rng = np.random.default_rng(1000 + curve)
            axes, shift = np.linalg.qr(rng.standard_normal((d, dims)))[0], rng.random(dims) * 0.25
            # Projections of a vector of this length spread by length / sqrt(d); three of these span the cells.
            place = (points @ axes) / (6 * longest / np.sqrt(d)) + 0.5 + shift
            cells = np.clip(place / 1.25 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.uint64)
            keys.append(hilbert_keys(cells, BITS))
        out.append(np.array(keys))
    return out[0], out[1]


def _is_sound(vector: str) -> Column:
    """Neither null nor zero, and without nulls and numbers that are not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def vector_classes(rows: DataFrame, k: int, query: str) -> tuple[DataFrame, DataFrame]:
    """Distinct vectors with the k + 1 smallest ids of each, and the queries (vec_id) with their class.

    A class is named by its smallest id. Of rows that repeat an id, the vector with the smallest hash counts.
    """
    h1, h2 = F.xxhash64("embedding"), F.xxhash64(F.lit("vector"), "embedding")
    one = rows.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(F.struct(h1.alias("h1"), h2.alias("h2"), F.col("embedding").alias("vector"))).alias("v"))
    one = cut(one.select("vec_id", "v.h1", "v.h2", "v.vector"))
    order = Window.partitionBy("h1", "h2").orderBy("vec_id")
    few = one.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1)
    classes = few.groupBy("h1", "h2").agg(F.min("vec_id").alias("class"), F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("vector").alias("vector"))
    classes = cut(classes)
    named = classes.select(unplaced(F.col("h1")).alias("_h1"), F.col("h2").alias("_h2"), "class")
    queries = one.where(query).select("vec_id", "h1", "h2").join(named, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))).select("vec_id", "class")
    return classes.select("class", "ids", "vector"), cut(queries)


def curve_blocks(classes: DataFrame, asked: DataFrame, n: int, curves: int = CURVES) -> DataFrame:
    """class, curve, role (0 candidate, 1 query) and block: all vectors as candidates, those of asked as queries too.

    Rows are range-partitioned by curve and key; a running count inside each partition and the counts
    of the partitions before it number the candidates of a curve, and equal shares of them are blocks.
    """
    longest = classes.agg(F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))).alias("m")).first()["m"]
    longest = float(np.sqrt(longest))

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                names, is_query = part.column(0).to_numpy(), part.column(1).to_numpy(zero_copy_only=False).astype(bool)
                for role, (keys, own) in enumerate(zip(curve_keys(_matrix(part.column(2)), longest, curves), (np.ones(len(names), bool), is_query), strict=True)):
                    m = int(own.sum())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.tile(names[own], curves)), pa.array(np.repeat(np.arange(curves), m)), pa.array(np.full(m * curves, role)), pa.array(keys[:, own].ravel())],
                        names=["class", "curve", "role", "key"],
                    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, part = np.zeros(curves, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            curve, candidate = batch.column(1).to_numpy(), batch.column(2).to_numpy() == 0
            before = np.empty(len(curve), np.int64)
            for c in np.unique(curve):
                own = curve == c
                before[own] = seen[c] + np.cumsum(candidate[own]) - candidate[own]
                seen[c] += int(candidate[own].sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.full(len(curve), part)), pa.array(before)], names=["class", "curve", "role", "part", "before"])

    flagged = classes.join(asked.select(F.col("class").alias("_asked")).distinct(), F.col("class") == F.col("_asked"), "left")
    keyed = flagged.select("class", F.col("_asked").isNotNull().alias("is_query"), "vector").mapInArrow(key, "class long, curve long, role long, key long")
    ordered = keyed.repartitionByRange("curve", "key", "class").sortWithinPartitions("curve", "key", "class", "role")
    counted = cut(ordered.mapInArrow(count, "class long, curve long, role long, part long, before long"))
    # At most a row for each partition and curve in it.
    parts = counted.where("role = 0").groupBy("curve", "part").agg(F.count(F.lit(1)).alias("n"))
    over = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("curve", "part").distinct().join(parts, ["curve", "part"], "left").withColumn("offset", F.coalesce(F.sum("n").over(over), F.lit(0))).drop("n")
    size = min(LARGEST_BLOCK, max(LEAST_BLOCK, -(-n // 64)))
    last = (n - 1) // size
    return counted.join(offsets, ["curve", "part"]).select("class", "curve", "role", F.least(F.floor((F.col("before") + F.col("offset")) / size), F.lit(last)).alias("block"))


def _top(scores: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k best of each row, best first, ties to the smaller name."""
    if scores.shape[1] > k:
        rows, cols = np.nonzero(scores >= np.partition(scores, -k, axis=1)[:, -k][:, None])
    else:
        rows, cols = (x.ravel() for x in np.indices(scores.shape))
    order = np.lexsort((names[cols], -scores[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[place < k], cols[place < k]


def _exact(a: np.ndarray, b: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    return (a[rows] * b[cols]).sum(axis=1)


def _search_block(k: int):
    def search(key: tuple, candidates: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[list] = [[], [], []]
        if candidates.num_rows and queries.num_rows:
            names, asked = candidates.column("class").to_numpy(), queries.column("class").to_numpy()
            c, q = _matrix(candidates.column("vector")), _matrix(queries.column("vector"))
            for at in range(0, len(q), 256):
                part = q[at : at + 256]
                rows, cols = _top(part @ c.T, names, k)
                exact = _exact(part, c, rows, cols)
                cuts = np.searchsorted(rows, np.arange(len(part) + 1))
                for i in range(len(part)):
                    own = slice(cuts[i], cuts[i + 1])
                    found[0].append(int(asked[at + i]))
                    found[1].append(names[cols[own]])
                    found[2].append(exact[own])
        return pa.Table.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.list_(pa.int64())), pa.array(found[2], pa.list_(pa.float64()))], names=["query", "found", "scores"])

    return search


def _merge(k: int):
    def merge(key: tuple, lists: pa.Table) -> pa.Table:
        names = lists.column("found").combine_chunks().flatten().to_numpy()
        scores = lists.column("scores").combine_chunks().flatten().to_numpy()
        names, first = np.unique(names, return_index=True)
        scores = scores[first]
        best = np.lexsort((names, -scores))[:k]
        return pa.Table.from_arrays([pa.array(np.full(len(best), key[0].as_py())), pa.array(names[best]), pa.array(scores[best])], names=["query", "class", "score"])

    return merge


def _window(classes: DataFrame, blocks: DataFrame, asked: DataFrame, k: int) -> int:
    """Blocks to either side that give RECALL on a bounded sample of queries, by exact search of these."""
    drawn = asked.select("class").distinct().orderBy(F.xxhash64("class"), "class").limit(CALIBRATION)
    sample = classes.join(drawn.withColumnRenamed("class", "_c"), F.col("class") == F.col("_c")).select("class", "vector").toArrow()
    names, vectors = sample.column("class").to_numpy(), _matrix(sample.column("vector"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own, c = batch.column(0).to_numpy(), _matrix(batch.column(1))
            scores = vectors @ c.T
            scores[names[:, None] == own[None, :]] = -np.inf
            rows, cols = _top(scores, own, k)
            yield pa.RecordBatch.from_arrays([pa.array(names[rows]), pa.array(own[cols]), pa.array(scores[rows, cols])], names=["query", "near", "score"])

    order = Window.partitionBy("query").orderBy(F.desc("score"), "near")
    near = classes.select("class", "vector").mapInArrow(scan, "query long, near long, score double").where("query <> near")
    near = near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).select("query", "near")
    place = lambda role, name: blocks.where(F.col("role") == role).select(F.col("class").alias(f"_{name}"), F.col("curve").alias(f"_c{role}"), F.col("block").alias(f"_b{role}"))
    pairs = near.join(place(0, "near"), F.col("near") == F.col("_near")).join(place(1, "query"), (F.col("query") == F.col("_query")) & (F.col("_c0") == F.col("_c1")))
    away = pairs.groupBy("query", "near").agg(F.min(F.abs(F.col("_b0") - F.col("_b1"))).alias("away")).groupBy("away").count().collect()
    total, seen = sum(r["count"] for r in away), 0
    for r in sorted(away, key=lambda r: r["away"]):
        seen += r["count"]
        if seen >= RECALL * total:
            return int(r["away"])
    return 0


def nearest(vectors: DataFrame, k: int = 20, query: str = "vec_id % 20 = 0", curves: int = CURVES) -> DataFrame:
    """The k nearest other vectors by inner product, found for each row that the condition query picks.

    Every vector is indexed: its keys along several Hilbert curves, each over projections and with a
    shift of its own, are range-partitioned and cut into equal blocks. A query meets all vectors of the
    blocks around its own place on each curve, in double precision, and the lists of all curves are
    merged. How many blocks around is calibrated by exact search for CALIBRATION queries, so that the
    recall on these is at least RECALL.

    Equal vectors are one class, so a vector that a third of all rows share is one point in the
    index; its smallest k + 1 ids are enough for any list. Vectors that are null, zero or hold nulls or
    numbers that are not finite take no part. Vectors of different lengths have no inner product: each
    length is searched by itself. vec_id is the key of the table; of rows that repeat one with
    different vectors, that with the smallest hash counts. Returns query_id, rank (from 1; ties to the
    smaller vec_id), vec_id, score; columns beside vec_id and embedding are not kept. Fewer vectors
    give shorter lists, an empty table none.
    """
    rows = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & _is_sound("embedding"))
    found = None
    for size in sorted(r["n"] for r in rows.select(F.size("embedding").alias("n")).distinct().collect()):
        own = _nearest_of_length(rows.where(F.size("embedding") == size), k, query, curves)
        found = own if found is None else found.unionByName(own)
    return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double") if found is None else found


def _nearest_of_length(rows: DataFrame, k: int, query: str, curves: int) -> DataFrame:
    classes, asked = vector_classes(rows, k, query)
    n = classes.count()
    blocks = curve_blocks(classes, asked, n, curves)
    around = _window(classes, blocks, asked, k)
    held = classes.select(F.col("class").alias("_c"), "vector")
    candidates = blocks.where("role = 0").join(held, F.col("class") == F.col("_c")).select("curve", "block", "class", "vector")
    places = blocks.where("role = 1").withColumn("block", F.explode(F.sequence(F.col("block") - around, F.col("block") + around)))
    queries = places.join(held, F.col("class") == F.col("_c")).select("curve", "block", "class", "vector")
    queries = queries.toDF("curve", "block", "class", "vector")
    lists = candidates.groupBy("curve", "block").cogroup(queries.groupBy("curve", "block")).applyInArrow(_search_block(k + 1), "query long, found array<long>, scores array<double>")
    best = lists.groupBy("query").applyInArrow(_merge(k + 1), "query long, class long, score double")
    members = best.join(classes.select(F.col("class").alias("_c"), "ids"), F.col("class") == F.col("_c")).select("query", "score", F.explode("ids").alias("vec_id"))
    ranked = members.withColumn("_n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("_n") <= k + 1).drop("_n")
    named = asked.select(F.col("vec_id").alias("query_id"), F.col("class").alias("_class")).join(ranked, F.col("_class") == F.col("query")).where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
