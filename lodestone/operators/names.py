"""Names in texts: an index of alias words joined by hash to windows of a text's words, the leftmost longest name at each place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A word of a name or text; what stands between words does not count.
WORD = r"[\p{L}\p{N}_]+"
#: Names have at most so many words; longer ones are an error of the caller's.
MAX_WORDS = 4


def words(text: Column) -> Column:
    """The words of a text in lower case, in order; of null none."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _hash(part: Column) -> list[Column]:
    """128 bits that stand for a list of words."""
    return [F.xxhash64(part), F.xxhash64(F.lit("second"), part)]


def alias_index(aliases: DataFrame, alias: str = "alias", symbol: str = "symbol", max_words: int = MAX_WORDS) -> DataFrame:
    """h1, h2, symbol and n_words of each alias; an alias of several symbols stands for the smallest. Aliases without a word are left out."""
    rows = aliases.select(words(F.col(alias)).alias("_w"), F.col(symbol).alias("symbol")).where(F.size("_w") > 0)
    fits = F.when(F.size("_w") <= max_words, F.size("_w")).otherwise(F.raise_error(F.lit(f"an alias has more than {max_words} words")).cast("int"))
    h1, h2 = _hash(F.col("_w"))
    return rows.select(h1.alias("h1"), h2.alias("h2"), "symbol", fits.alias("n_words")).groupBy("h1", "h2", "n_words").agg(F.min("symbol").alias("symbol"))


def mentions(texts: DataFrame, aliases: DataFrame, key: str, text: str = "text", alias: str = "alias", symbol: str = "symbol", max_words: int = MAX_WORDS) -> DataFrame:
    """Every mention of a name: key, place (1 for the first in a text), symbol, at (the index of its first word) and n_words.

    Windows of one to max_words words are joined by hash to the aliases, so that work grows with words of texts and not with
    the number of aliases; the join is a broadcast where the aliases are few, and Spark's skew handling splits a frequent
    window where they are not. Of names that overlap the leftmost counts, of those that begin together the longest. Case and what stands
    between words do not count. key tells texts apart; a null text has no names, rows that repeat a key are one text each only if their texts differ.
    """
    rows = texts.select(F.col(key).alias("_key"), words(F.col(text)).alias("_words"))
    windows = F.flatten(
        F.transform(
            F.array(*[F.lit(n) for n in range(1, max_words + 1)]),
            lambda n: F.when(
                F.size("_words") >= n,
                F.transform(F.sequence(F.lit(1), F.size("_words") - n + 1), lambda i: F.struct((i - 1).alias("at"), n.alias("n"), *[h.alias(f"h{k}") for k, h in enumerate(_hash(F.slice("_words", i, n)), 1)])),
            ).otherwise(F.array().cast("array<struct<at:int,n:int,h1:bigint,h2:bigint>>")),
        )
    )
    spread = rows.select("_key", F.inline(windows))
    index = alias_index(aliases, alias, symbol, max_words)
    found = spread.join(index, ["h1", "h2"]).where(F.col("n") == F.col("n_words")).select("_key", "at", "n_words", "symbol").distinct()
    # Mentions that touch none before them begin a cluster; only inside a cluster is the choice in sequence.
    before = Window.partitionBy("_key").orderBy("at", F.desc("n_words")).rowsBetween(Window.unboundedPreceding, -1)
    ends = found.withColumn("_end", F.max(F.col("at") + F.col("n_words")).over(before))
    upto = Window.partitionBy("_key").orderBy("at", F.desc("n_words")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    clusters = ends.withColumn("_cluster", F.count_if(F.col("_end").isNull() | (F.col("at") >= F.col("_end"))).over(upto))
    held = clusters.groupBy("_key", "_cluster").agg(F.sort_array(F.collect_list(F.struct("at", (-F.col("n_words")).alias("less"), "symbol"))).alias("_m"))
    kind = held.schema["_m"].dataType
    start = F.struct(F.lit(0).alias("end"), F.array().cast(kind).alias("kept"))
    chosen = F.aggregate("_m", start, lambda acc, m: F.when(m["at"] >= acc["end"], F.struct((m["at"] - m["less"]).alias("end"), F.array_append(acc["kept"], m).alias("kept"))).otherwise(acc), lambda acc: acc["kept"])
    kept = held.select("_key", F.inline(chosen))
    place = F.row_number().over(Window.partitionBy("_key").orderBy("at"))
    return kept.select(F.col("_key").alias(key), place.alias("place"), "symbol", "at", (-F.col("less")).alias("n_words"))


def with_symbols(texts: DataFrame, aliases: DataFrame, key: str, text: str = "text", into: str = "symbols") -> DataFrame:
    """Add the symbols that each text names, in the order of their first mention; none is an empty array. key is unique."""
    firsts = mentions(texts, aliases, key, text).groupBy(key, "symbol").agg(F.min("place").alias("place"))
    listed = firsts.groupBy(F.col(key).alias("_k")).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "symbol"))), lambda x: x["symbol"]).alias(into))
    none = F.array().cast(listed.schema[into].dataType)
    return texts.join(listed, F.col(key) == F.col("_k"), "left").withColumn(into, F.coalesce(into, none)).drop("_k")
