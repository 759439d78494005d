"""Near-duplicate documents: banded MinHash candidates, odd-sketch verification, exact confirmation, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import cut, text_bytes, unplaced
from lodestone.llm.components import connected_components
from lodestone.llm.shingles import STEP, U64, WordHashes, mix, shingle_set, split_words
from lodestone.session import table

#: Words in a shingle; the similarity of a link, in hundredths.
WIDTH, PERCENT = 5, 75
#: 32 bands of 4 MinHash values: a link of similarity 0.75 misses all bands with probability 5e-6.
BANDS, ROWS = 32, 4
#: MinHash samples folded into an odd sketch of so many bits.
SAMPLES, SKETCH_BITS = 256, 512
#: Candidates whose sketches estimate less are dropped; a link of 0.75 is over six standard errors above.
LEAST_ESTIMATE = 0.55
#: Members of a bucket that are compared in one task, against as many others, and shingles that they hold at most about (16 MB).
BLOCK, BLOCK_SHINGLES = 512, 2_000_000
#: A bucket with more members is split by the members' other bands before it is compared in blocks, and what that leaves by their rarest shingles.
HOT_BUCKET = 32_768
#: Rest buckets with at most so many members are joined with themselves; larger ones are compared in blocks.
FEW = 32
#: So many ids (some 100 MB) are broadcast to pick their documents; more are joined by a shuffle.
BROADCAST_IDS = 4_000_000
_A = np.random.default_rng(20240607).integers(0, 1 << 31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def _minima(sets: list[np.ndarray]) -> np.ndarray:
    out = np.empty((len(sets), SAMPLES), np.uint32)
    buffer = np.empty((512, SAMPLES), np.uint32)
    for row, shingles in enumerate(sets):
        x = (shingles >> U64(32)).astype(np.uint32)
        least = out[row]
        least.fill(0xFFFFFFFF)
        for at in range(0, len(x), 512):
            part = x[at : at + 512]
            products = np.multiply(part[:, None], _A[None, :], out=buffer[: len(part)])
            np.minimum(least, products.min(axis=0), out=least)
    return out


def band_values(minima: np.ndarray) -> np.ndarray:
    """One 64-bit value for each band, the band's number mixed in."""
    rows = minima[:, : BANDS * ROWS].astype(U64).reshape(len(minima), BANDS, ROWS)
    value = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U64), rows.shape[:2]).copy()
    for j in range(ROWS):
        value = mix(value * STEP + rows[:, :, j])
    return value.view(np.int64)


def odd_sketches(minima: np.ndarray) -> np.ndarray:
    """Parity bitmaps: each (sample, minimum) flips one of SKETCH_BITS bits. As 64-bit integers."""
    n = len(minima)
    place = mix(minima.astype(U64) + np.arange(SAMPLES, dtype=U64) * STEP) % U64(SKETCH_BITS)
    flips = np.bincount((place.astype(np.int64) + np.arange(n)[:, None] * SKETCH_BITS).ravel(), minlength=n * SKETCH_BITS)
    return np.packbits((flips & 1).astype(np.uint8).reshape(n, SKETCH_BITS), axis=1).view(np.int64)


def _lists(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.ravel()))


def _documents(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], list[list[bytes]]]]:
    """Some rows at a time, with the shingles and words of the text in their last column."""
    hashes = WordHashes()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            words = [split_words(x.as_py()) for x in part.column(part.num_columns - 1)]
            yield part, [shingle_set(hashes.of(w), WIDTH) for w in words], words


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, sets, words in _documents(batches, 256):
        minima = _minima(sets)
        content = [xxhash.xxh3_128_digest(b" ".join(w)) for w in words]
        yield pa.RecordBatch.from_arrays(
            [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(content, pa.binary()), _lists(band_values(minima)), _lists(odd_sketches(minima))],
            names=["doc_id", "text_key", "n_shingles", "content", "bands", "sketch"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, sets, _ in _documents(batches, 256):
        ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
        values = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=["node", "shingles"])


def signatures(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, text_key (hash of the text), n_shingles, content (128-bit hash of the words), bands and sketch of each row."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_key(F.col(text)).alias("text_key"), text_bytes(F.col(text)).alias("_data"))
    return rows.mapInArrow(_sign, "doc_id long, text_key long, n_shingles long, content binary, bands array<long>, sketch array<long>")


def text_key(text: Column) -> Column:
    """What tells apart the texts of rows that repeat an id."""
    return F.xxhash64(F.lit("text"), F.coalesce(text, F.lit("")))


def estimate(a: Column, b: Column) -> Column:
    """Similarity estimated from two odd sketches: 1 + bits / (4 samples) * ln(1 - 2 differing / bits)."""
    differing = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)
    odd = 1 - 2 * differing / F.lit(float(SKETCH_BITS))
    return F.when(odd > 0, 1 + F.lit(SKETCH_BITS / (4.0 * SAMPLES)) * F.log(odd)).otherwise(F.lit(-1.0))


def _close_in_size(a: Column, b: Column) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def _estimates(sketches: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(sketches.view(np.uint8).reshape(len(sketches), -1), axis=1).astype(np.float32)
    ones = bits.sum(axis=1)
    odd = 1 - 2 * (ones[:, None] + ones[None, :] - 2 * bits @ bits.T) / SKETCH_BITS
    return np.where(odd > 0, 1 + SKETCH_BITS / (4 * SAMPLES) * np.log(np.maximum(odd, 1e-9)), -1)


def _open_pairs(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two blocks (or of one) whose components differ and whose sketches and sizes allow a link."""
    sides, n, comp = pdf["side"].to_numpy(), pdf["n"].to_numpy(), pdf["component"].to_numpy()
    good = _estimates(np.array(pdf["sketch"].tolist(), np.int64)) >= LEAST_ESTIMATE
    good &= np.minimum(n[:, None], n[None, :]) * 100 >= np.maximum(n[:, None], n[None, :]) * PERCENT
    good &= comp[:, None] != comp[None, :]
    if sides.max() > sides.min():
        good &= sides[:, None] < sides[None, :]
    return np.nonzero(np.triu(good, 1) if sides.max() == sides.min() else good)


def _maybe_linked(pdf: pd.DataFrame) -> pd.DataFrame:
    i, j = _open_pairs(pdf)
    return pdf.iloc[np.union1d(i, j)][["bucket", "node"]]


def _unite(pdf: pd.DataFrame) -> pd.DataFrame:
    """Confirm pairs on full sets, skipping those whose components are united already; at most one edge less than members."""
    i, j = _open_pairs(pdf)
    comp, sets = pdf["component"].tolist(), pdf["shingles"].tolist()
    up = {c: c for c in comp}

    def find(c: int) -> int:
        while up[c] != c:
            up[c] = c = up[up[c]]
        return c

    edges = []
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        a, b = find(comp[x]), find(comp[y])
        if a != b:
            common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if common * 100 >= PERCENT * (len(sets[x]) + len(sets[y]) - common):
                up[max(a, b)] = min(a, b)
                edges.append((comp[x], comp[y]))
    return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")


def _in_blocks(members: DataFrame) -> DataFrame:
    """Deal the members of each bucket to pairs of blocks: bucket, left and right name a pair, side the row's block.

    members has n_members and n_held (shingles) of its bucket. A row is repeated once for each block of its bucket.
    """
    blocks = F.ceil(F.greatest(F.col("n_members") / BLOCK, F.col("n_held") / BLOCK_SHINGLES)).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    return (
        members.withColumn("side", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumns({"left": F.least("side", "_other"), "right": F.greatest("side", "_other")})
        .drop("_other")
    )


def _open_buckets(members: DataFrame) -> DataFrame:
    """_b and n_members of each bucket that holds several components."""
    found = members.groupBy(F.col("bucket").alias("_b")).agg(F.count(F.lit(1)).alias("n_members"), F.min("component").alias("_lo"), F.max("component").alias("_hi"))
    return found.where("_lo <> _hi").select(unplaced(F.col("_b")).alias("_b"), "n_members")


def _pairs(buckets: DataFrame) -> float:
    """Pairs of members of buckets that have n_members."""
    return float(buckets.agg(F.sum(F.col("n_members").cast("double") * (F.col("n_members") - 1) / 2).alias("n")).first()["n"] or 0)


def _rarest(sets: DataFrame) -> DataFrame:
    """node and bucket: a bucket for each shingle that a link of the node may have to rely on.

    Two linked sets share PERCENT of the larger one's shingles at least, so with all shingles in one order, by how many sets hold
    them, they share one outside the so many less one most frequent of each. Shingles of a single set link nothing.
    """
    held = sets.select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    often = held.groupBy("shingle").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    often = often.select(unplaced(F.col("shingle")).alias("_s"), "often")
    order = Window.partitionBy("node").orderBy(F.desc("often"), F.desc("shingle"))
    ranked = held.join(often, F.col("shingle") == F.col("_s")).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") * 100 >= F.col("n") * PERCENT).select("node", F.xxhash64(F.lit("rare"), "shingle").alias("bucket"))


def _split_hot(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Members of open buckets, those of very large buckets dealt to smaller ones by their other bands.

    Two texts of a large bucket that are linked share a further band but for one pair in a hundred thousand, as they share any
    band at all, so a large bucket becomes one for each other band's value, and its rows grow by the number of bands and not with its
    members. What is large even then is compared in blocks; the pairs that share no further band are left to _rest_of_hot.
    """
    dealt = members.where(F.col("n_members") > HOT_BUCKET)
    others = classes.select(F.col("node").alias("_n"), F.explode("bands").alias("_other"))
    dealt = dealt.drop("n_members").join(others, F.col("node") == F.col("_n")).where(F.col("_other") != F.col("bucket"))
    dealt = dealt.withColumn("bucket", F.xxhash64("bucket", "_other")).drop("_n", "_other")
    kept = dealt.join(_open_buckets(dealt), F.col("bucket") == F.col("_b")).drop("_b")
    return cut(members.where(F.col("n_members") <= HOT_BUCKET).unionByName(kept))


def _rest_of_hot(hot: DataFrame, sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Members of very large buckets that hold several components still, dealt to smaller ones by their rarest shingles.

    This is exact: two members that are linked share one of these shingles, whatever bands they share. Rows grow with the
    shingles of the members. Where texts are so alike that this makes more pairs than the buckets have, the buckets stay whole;
    what is large in the end is compared in blocks.
    """
    still = cut(_open_buckets(hot))
    hot = cut(hot.drop("n_members").join(still, F.col("bucket") == F.col("_b")).drop("_b"))
    nodes = cut(hot.select(F.col("node").alias("_n"), "component", "n", "sketch").dropDuplicates(["_n"]))
    rare = _rarest(cut(sets_of(nodes.select(F.col("_n").alias("node")))))
    rare = cut(rare.join(nodes.select("_n", "component"), F.col("node") == F.col("_n")).select("bucket", "node", "component"))
    open_ = cut(_open_buckets(rare))
    if _pairs(open_) >= _pairs(still):
        return hot
    dealt = rare.join(open_, F.col("bucket") == F.col("_b")).drop("component").join(nodes, F.col("node") == F.col("_n"))
    return cut(dealt.select(*hot.columns))


def _pairs_of_small(members: DataFrame) -> DataFrame:
    """Pairs a, b of members of one bucket whose components differ, each once."""
    one = members.select("bucket", F.col("node").alias("a"), F.col("component").alias("_ca"))
    other = members.select("bucket", F.col("node").alias("b"), F.col("component").alias("_cb"))
    return one.join(other, "bucket").where("a < b AND _ca <> _cb").select("a", "b").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Components of documents linked by a Jaccard similarity of 0.75 or more of their 5-word shingle sets.

    Returns doc_id, text_key, n_shingles, component_id (the smallest doc_id reachable) and kept. A text with
    fewer than five words is one shingle; one without words is linked with nothing. A row without
    doc_id is linked with nothing, has no component and is kept. Rows that repeat an id are told apart
    by their text, which text_key names; texts that share an id and are each the first of their class
    count as one document. Equal sequences of words are one class from the start, which a minimum by content
    hash finds, so copies are never paired. Shingles and contents are told apart by 64- and 128-bit
    hashes. Other columns are not kept; an empty table gives an empty table.

    1. Every class meets the smallest member of each of its MinHash buckets: one pair for a member.
    2. Odd sketches of the two drop pairs that are clearly less similar; full sets confirm the rest.
    3. Links of one bucket that this star does not show lie between different components. Buckets
       that still hold several components are compared in blocks, again by sketches first and full
       sets then, and a block emits at most as many edges as it has members. Very large buckets are
       split by further bands first. Then their members are dealt by their rarest shingles, which shows every link that is left.
    """
    signed = cut(signatures(docs, text, doc_id))
    classes = (
        signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("content")
        .agg(F.min(F.struct("doc_id", "text_key")).alias("_first"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
        .select("content", F.col("_first.doc_id").alias("node"), F.col("_first.text_key").alias("key"), "n", "bands", "sketch")
    )
    classes = cut(classes)
    facts = classes.select("node", "n", "sketch")
    exploded = classes.select("node", F.explode("bands").alias("bucket"))
    buckets = exploded.groupBy("bucket").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n_members")).where("n_members > 1")
    buckets = buckets.withColumn("bucket", unplaced(F.col("bucket")))
    members = cut(exploded.join(buckets, "bucket").select("bucket", "node", "leader", "n_members"))

    def with_facts(pairs: DataFrame, side: str) -> DataFrame:
        renamed = facts.select(F.col("node").alias(f"_{side}"), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}"))
        return pairs.join(renamed, F.col(side) == F.col(f"_{side}")).drop(f"_{side}")

    star = members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()

    def sets_of(nodes: DataFrame) -> DataFrame:
        named = classes.select(F.col("node").alias("_node"), F.col("key").alias("_key"))
        wanted = cut(named.join(nodes.distinct(), F.col("_node") == F.col("node"), "left_semi"))
        if wanted.count() <= BROADCAST_IDS:
            wanted = F.broadcast(wanted)
        rows = docs.select(F.col(doc_id).cast("long").alias("node"), text_key(F.col(text)).alias("key"), text_bytes(F.col(text)).alias("_data"))
        rows = rows.join(wanted, (F.col("node") == F.col("_node")) & (F.col("key") == F.col("_key")), "left_semi").dropDuplicates(["node", "key"])
        return rows.select("node", "_data").mapInArrow(_sets, "node long, shingles array<long>")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Those of the pairs a, b that are linked, by sketches first and full sets then."""
        likely = with_facts(with_facts(pairs, "b"), "a").where(
            _close_in_size(F.col("n_a"), F.col("n_b")) & (estimate(F.col("sketch_a"), F.col("sketch_b")) >= LEAST_ESTIMATE)
        )
        likely = cut(likely.select("a", "b"))
        sets = cut(sets_of(likely.select(F.col("b").alias("node")).union(likely.select("a"))))
        both = likely.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
        both = both.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
        common = F.size(F.array_intersect("sa", "sb"))
        links = both.withColumn("_n", common).where(F.col("_n") * 100 >= (F.size("sa") + F.size("sb") - F.col("_n")) * PERCENT)
        return links.select("a", "b")

    first = connected_components(confirmed(star))

    labelled = (
        members.where("n_members > 2")
        .select("bucket", "node", "n_members")
        .join(first.select(F.col("node").alias("_n"), F.col("component").alias("_c")), F.col("node") == F.col("_n"), "left")
        .select("bucket", "node", "n_members", F.coalesce("_c", "node").alias("component"))
    )
    several = labelled.groupBy(F.col("bucket").alias("_b")).agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).where("_lo <> _hi").select(unplaced(F.col("_b")).alias("_b"))
    open_members = cut(
        labelled.join(several, F.col("bucket") == F.col("_b"), "left_semi")
        .join(facts.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"))
        .drop("_n")
    )
    pair = ["bucket", "left", "right"]

    def links_in_blocks(members: DataFrame) -> DataFrame:
        maybe = _in_blocks(members.withColumn("n_held", F.lit(0))).groupBy(*pair).applyInPandas(_maybe_linked, "bucket long, node long").distinct()
        chosen = cut(maybe.withColumnsRenamed({"bucket": "_b", "node": "_n"}))
        counted = members.drop("n_members").join(chosen, (F.col("bucket") == F.col("_b")) & (F.col("node") == F.col("_n"))).drop("_b", "_n")
        sized = chosen.join(facts.select(F.col("node").alias("_f"), "n"), F.col("_n") == F.col("_f"))
        sizes = sized.groupBy(F.col("_b").alias("_bucket")).agg(F.count(F.lit(1)).alias("n_members"), F.sum("n").alias("n_held"))
        sizes = sizes.withColumn("_bucket", unplaced(F.col("_bucket")))
        counted = counted.join(sizes, F.col("bucket") == F.col("_bucket")).drop("_bucket")
        more_sets = sets_of(chosen.select(F.col("_n").alias("node")))
        with_sets = counted.join(more_sets.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n")).drop("_n")
        return _in_blocks(with_sets).groupBy(*pair).applyInPandas(_unite, "a long, b long")

    def united(components: DataFrame, more: DataFrame) -> DataFrame:
        """Components, those that more links named by an id of each."""
        joined = components.unionByName(
            more.join(components.select(F.col("node").alias("_n")), F.col("node") == F.col("_n"), "left_anti").select("node", "component")
        )
        roots = more.select(F.col("node").alias("_root"), F.col("component").alias("_to"))
        return joined.join(roots, F.col("component") == F.col("_root"), "left").select("node", F.coalesce("_to", "component").alias("component"))

    hot = open_members.where(F.col("n_members") > HOT_BUCKET)
    has_hot = not hot.isEmpty()
    second = connected_components(links_in_blocks(_split_hot(open_members, classes) if has_hot else open_members))
    final = united(first, second)
    if has_hot:
        roots = second.select(F.col("node").alias("_root"), F.col("component").alias("_to"))
        hot = hot.join(roots, F.col("component") == F.col("_root"), "left").withColumn("component", F.coalesce("_to", "component")).drop("_root", "_to")
        rest = _rest_of_hot(hot, sets_of)
        small = confirmed(_pairs_of_small(rest.where(F.col("n_members") <= FEW))).join(
            rest.select(F.col("node").alias("a"), F.col("component").alias("_ca")).distinct(), "a"
        ).join(rest.select(F.col("node").alias("b"), F.col("component").alias("_cb")).distinct(), "b")
        more = links_in_blocks(rest.where(F.col("n_members") > FEW)).unionByName(small.select(F.col("_ca").alias("a"), F.col("_cb").alias("b")))
        final = united(cut(final), connected_components(more))

    named = (
        classes.select("content", "node")
        .join(final.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left")
        .select(F.col("content").alias("_content"), F.coalesce("component", "node").alias("_component"))
    )
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id"))
    return (
        signed.select("doc_id", "text_key", "n_shingles", "content")
        .join(named, (F.col("content") == F.col("_content")) & (F.col("n_shingles") > 0), "left")
        .select("doc_id", "text_key", "n_shingles", component.alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
