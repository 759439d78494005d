"""Mixing sources to target weights: capped shares, whole copies, Pareto order sampling of the rest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import WORD, cut
from lodestone.session import table

#: Documents in a slice of a source's ranking, by which its running sum is split over tasks; the root of all where that is more.
SLICE = 1000


def source_targets(sized: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Target words of each source: its weight's part of share * all words, at most cap * its own words.

    Sources are ordered by code point, null last, and take the weights in turn. What a cap cuts off
    is shared again by weight among the others; in closed form, sources reach their cap in the order
    of cap * size / weight, so one running sum over the sources (not over documents) finds them.
    A source without words gets 0; when every source is at its cap, the rest of the total is not taken.
    Sources are few beside documents: the windows over them are one task's work, as their order is.
    Returns source, source_size, n_docs, target.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("_weight", weight).withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    everything, filling = Window.partitionBy(F.lit(0)), Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumns(
        {
            "_total": F.sum("source_size").over(everything) * F.lit(float(share)),
            "_cap_before": F.coalesce(F.sum("_cap").over(before), F.lit(0.0)),
            "_weight_left": F.sum("_weight").over(filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        }
    )
    # With all sources before this one at their caps, would this one's part of the rest pass its cap?
    level = (F.col("_total") - F.col("_cap_before")) / F.col("_weight_left")
    ranked = ranked.withColumn("_level", level).withColumn("_capped", F.col("_level") * F.col("_weight") > F.col("_cap"))
    free_level = F.min(F.when(~F.col("_capped"), F.struct((F.col("_cap") / F.col("_weight")).alias("o"), F.col("_level").alias("level")))).over(everything)
    target = F.when(F.col("_capped"), F.col("_cap")).otherwise(F.least(free_level["level"] * F.col("_weight"), F.col("_cap")))
    return ranked.select("source", "source_size", "n_docs", target.alias("target"))


def uniform(doc_id: Column, seed: str) -> Column:
    """A number in (0, 1) drawn from the id: 48 bits of an md5, so that reruns and other engines agree."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def mix_sources(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    source: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    seed: str = "mix:",
) -> DataFrame:
    """Copies of each document such that each source's words come near its target.

    A source with target t and s words takes floor(t / s) copies of each of its documents for
    certain. The fraction p left is filled by one more copy of some, which Pareto order sampling
    picks with probabilities that grow with a document's size: its inclusion odds are p / (1 - p) times
    its words over the source's mean. Documents are ranked by the random odds u / (1 - u) over their
    inclusion odds, and the first ones whose words fit the rest of the target, to the nearest document,
    are taken. The sample's size in words is thus fixed. A document without words has the odds of one word.

    Words are counted once and written to the shared folder as three small columns. The running sum
    over a source's ranking is taken in two levels: words by slice of the ranking first, then documents
    inside a slice of about SLICE documents (or the root of the source's number, if that is more), so
    that a source with a third of all rows is spread over many groups. Sources that take only whole
    copies are sliced alike, by the same random odds.

    A null text has 0 words; a null source is a source of its own, the last; a null id is drawn like
    any other id; repeated rows tie and are taken in turn. Without words, targets and copies are 0.
    Returns doc_id, size, source, source_size, target, copies, taken; other columns are not kept.
    """
    sized = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    sized = cut(sized)
    targets = source_targets(sized, weights, share, cap)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    u, p = uniform(F.col("doc_id"), seed), F.col("_ratio") - F.floor("_ratio")
    # p / (1 - p) is the same for a whole source, so it is left out of the order of its documents, and whole copies (p = 0) are ordered too.
    inclusion = F.greatest("size", F.lit(1)) / (F.greatest("source_size", F.lit(1)) / F.col("n_docs"))
    odds = F.col("_u") / (1 - F.col("_u")) / inclusion
    n_slices = F.ceil(F.col("n_docs") / F.greatest(F.lit(float(SLICE)), F.sqrt("n_docs")))
    # odds runs over (0, inf); odds / (1 + odds) over (0, 1) in the same order
    ranked = (
        sized.withColumn("_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")))
        .join(targets.select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")).alias("_key"), "source_size", "n_docs", "target"), "_key")
        .withColumn("_ratio", ratio)
        .withColumns({"_u": u, "_p": p})
        .withColumn("_odds", odds)
        .withColumn("_slice", F.floor(F.col("_odds") / (1 + F.col("_odds")) * n_slices).cast("int"))
        .withColumn("_extra", (F.col("_ratio") - F.floor("_ratio")) * F.col("source_size"))
    )
    slices = ranked.groupBy("_key", "_slice").agg(F.sum("size").alias("_words"))
    running = Window.partitionBy("_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("_before", F.coalesce(F.sum("_words").over(running), F.lit(0))).withColumnsRenamed({"_key": "_k", "_slice": "_s"}).drop("_words")
    placed = ranked.join(slices, (F.col("_key") == F.col("_k")) & (F.col("_slice") == F.col("_s")))
    inside = Window.partitionBy("_key", "_slice").orderBy("_odds", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.col("_before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    more = (F.col("_p") > 0) & (F.col("_reached") + F.col("size") / 2 <= F.col("_extra"))
    copies = F.floor("_ratio").cast("long") + F.coalesce(more, F.lit(False)).cast("long")
    return placed.withColumn("_reached", reached).select(
        "doc_id", "size", "source", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix_sources(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s0 AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs FROM sized GROUP BY source
), s1 AS (
  SELECT *, ([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS w,
         source_size * 2.0::DOUBLE AS cap FROM s0
), s2 AS (
  SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS total,
         coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS cap_before,
         sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left
  FROM s1
), s3 AS (
  SELECT *, (total - cap_before) / w_left AS level, (total - cap_before) / w_left * w > cap AS capped FROM s2
), s4 AS (
  SELECT source, source_size, n_docs,
         CASE WHEN capped THEN cap
              ELSE least((arg_min(level, cap / w) FILTER (WHERE NOT capped) OVER ()) * w, cap) END AS target
  FROM s3
), drawn AS (
  SELECT d.doc_id, d.size, d.source, s.source_size, s.n_docs, s.target,
         CASE WHEN s.source_size > 0 THEN s.target / s.source_size ELSE 0.0 END AS ratio,
         (('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u
  FROM sized d JOIN s4 s ON d.source IS NOT DISTINCT FROM s.source
), ranked AS (
  SELECT *, ratio - floor(ratio) AS p, (ratio - floor(ratio)) * source_size AS extra FROM drawn
), reached AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY u / (1 - u) / (greatest(size, 1)::DOUBLE / (greatest(source_size, 1)::DOUBLE / n_docs::DOUBLE)), doc_id NULLS LAST, size
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM ranked
)
SELECT doc_id, size, source_size, target,
       ((floor(ratio)::BIGINT + (CASE WHEN p > 0 AND before + size / 2.0::DOUBLE <= extra THEN 1 ELSE 0 END)) * size)::BIGINT AS taken
FROM reached
"""
