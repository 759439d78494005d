"""Feeds: items of landed XML files, read tolerantly, whatever declarations or breaks a file has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as t
from lodestone.functions.periods import rfc822_timestamp

#: Items that are read of one file, and characters of titles and summaries.
MAX_ITEMS, MAX_TITLE, MAX_SUMMARY = 200, 500, 600
_CDATA = r"(?s)<!\[CDATA\[(.*?)\]\]>"


def _field(item: Column, name: str) -> Column:
    """A field's text: as it is written inside CDATA, else with its entities decoded once."""
    raw = F.regexp_extract(item, rf"(?is)<{name}(?:\s[^>]*)?>(.*?)</{name}\s*>", 1)
    return F.when(raw.rlike(_CDATA), F.regexp_replace(raw, _CDATA, "$1")).otherwise(t.unescape_entities(raw))


def items_of(feeds: DataFrame, body: str = "body", key: str = "feed") -> DataFrame:
    """Items of each feed body in order: canonical_url, title, title_hash, published_at, summary.

    Items without a title or a sound address, and repeats of an address in a feed, are left out.
    """
    blocks = F.slice(F.regexp_extract_all(F.col(body), F.lit(r"(?is)<item(?:\s[^>]*)?>(.*?)</item\s*>"), F.lit(1)), 1, MAX_ITEMS)
    item = F.col("_item")
    rows = feeds.select(key, F.posexplode(blocks).alias("place", "_item")).select(
        key,
        "place",
        t.canonical_url(F.trim(_field(item, "link"))).alias("canonical_url"),
        F.rtrim(F.substring(t.strip_markup(_field(item, "title")), 1, MAX_TITLE)).alias("title"),
        rfc822_timestamp(_field(item, "pubDate")).alias("published_at"),
        t.cut_at_word(t.strip_markup(_field(item, "description")), MAX_SUMMARY).alias("summary"),
    )
    first = F.row_number().over(Window.partitionBy(key, "canonical_url").orderBy("place"))
    sound = rows.where((F.col("title") != "") & F.col("canonical_url").isNotNull()).withColumn("_n", first).where("_n = 1").drop("_n")
    return sound.withColumn("title_hash", t.title_hash(F.col("title")))


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """Items of the feed files under path; a file is one feed, named by its path."""
    files = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("feed"), F.col("value").alias("body"))
    return items_of(files)


def changed_feeds(landed: DataFrame, state: DataFrame) -> DataFrame:
    """Feeds whose validator (etag) is not the remembered one; a feed without a validator always counts as changed.

    landed: feed, etag, body; state: feed, etag. An unchanged feed is not read again.
    """
    known = state.select(F.col("feed").alias("_feed"), F.col("etag").alias("_etag"))
    return landed.join(known, (F.col("feed") == F.col("_feed")) & (F.col("etag") == F.col("_etag")), "left_anti")


def fixture_feed(spark: SparkSession, n: int = 3) -> DataFrame:
    """A made feed of n items for work without a network: one row of feed and body."""
    item = "<item><title>Notice {i}: penalty &amp;amp; order</title><link>https://example.org/notice/{i}?utm_source=x</link><pubDate>Tue, 15 Sep 2026 10:3{i}:00 +0530</pubDate><description>About notice {i}</description></item>"
    body = "<rss><channel>" + "".join(item.format(i=i) for i in range(n)) + "</channel></rss>"
    return spark.createDataFrame([("fixture", body)], "feed string, body string")
