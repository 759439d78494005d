"""Rows with what they cite: joins of facts, events and passages with their documents, and lists of ids resolved to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def facts_with_citations(facts: DataFrame, documents: DataFrame, table_source: str = "screener") -> DataFrame:
    """Facts with their document's title and url. A fact shows if its source is a table page or its document is completed.

    facts: document_id (null for a table page), source and more; documents: document_id, title, url, status.
    """
    cited = documents.select(F.col("document_id").alias("_d"), "title", "url", "status")
    joined = facts.join(cited, F.col("document_id") == F.col("_d"), "left")
    return joined.where((F.col("source") == table_source) | (F.col("status") == "completed")).drop("_d", "status")


def events_with_citations(events: DataFrame, documents: DataFrame, items: DataFrame) -> DataFrame:
    """Events of a filing or of a feed item, whichever they name, with that one's title and url. Filings must be completed."""
    filed = documents.select(F.col("document_id").alias("_d"), F.col("title").alias("_dt"), F.col("url").alias("_du"), "status")
    fed = items.select(F.col("item_id").alias("_i"), F.col("title").alias("_it"), F.col("url").alias("_iu"))
    joined = events.join(filed, F.col("document_id") == F.col("_d"), "left").join(fed, F.col("item_id") == F.col("_i"), "left")
    shown = joined.where(F.col("item_id").isNotNull() | (F.col("status") == "completed"))
    return shown.withColumns({"title": F.coalesce("_it", "_dt"), "url": F.coalesce("_iu", "_du")}).drop("_d", "_dt", "_du", "status", "_i", "_it", "_iu")


def has_one_source(*columns: Column) -> Column:
    """Whether exactly one of the columns is not null."""
    n = F.lit(0)
    for column in columns:
        n = n + column.isNotNull().cast("int")
    return n == 1


def with_flag(rows: DataFrame, marks: DataFrame, key: str, mark_key: str, name: str) -> DataFrame:
    """A boolean column that tells whether a mark exists for the row; marks are filtered (to one user, say) before the join."""
    found = marks.select(F.col(mark_key).alias("_m")).distinct()
    return rows.join(found, F.col(key) == F.col("_m"), "left").withColumn(name, F.col("_m").isNotNull()).drop("_m")


def where_if(rows: DataFrame, column: str, value: object) -> DataFrame:
    """The rows with a value in a column, or all rows if the value is None; the condition reaches the scan."""
    return rows if value is None else rows.where(F.col(column) == F.lit(value))


def search_passages(chunks: DataFrame, documents: DataFrame, stocks: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    """Passages with their document, stock and the embedding of their content by one model; passages without one are left out."""
    vectors = where_if(embeddings, "model", model).select(F.col("content_hash").alias("_h"), "embedding").dropDuplicates(["_h"])
    located = chunks.join(documents, "document_id").join(stocks, "stock_id")
    return located.join(vectors, F.col("content_hash") == F.col("_h")).drop("_h")


def missing_contents(chunks: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    """One row for each content that the model has not embedded: content_hash and the first chunk that has it."""
    done = where_if(embeddings, "model", model).select(F.col("content_hash").alias("_h"))
    return chunks.join(done, F.col("content_hash") == F.col("_h"), "left_anti").groupBy("content_hash").agg(F.min("chunk_id").alias("chunk_id"))


def backlog_documents(documents: DataFrame, chunks: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    """Documents that have a chunk whose content the model has not embedded."""
    done = where_if(embeddings, "model", model).select(F.col("content_hash").alias("_h"))
    open_chunks = chunks.join(done, F.col("content_hash") == F.col("_h"), "left_anti").select(F.col("document_id").alias("_d"))
    return documents.join(open_chunks, F.col("document_id") == F.col("_d"), "left_semi")


def resolve(rows: DataFrame, key: str, ids: str, sources: DataFrame, source_id: str, label: str) -> DataFrame:
    """The labels of a list of ids, in the list's order, each id once; ids that no source has are left out."""
    listed = rows.select(key, F.posexplode(F.array_distinct(ids)).alias("_at", "_id"))
    named = listed.join(sources.select(F.col(source_id).alias("_s"), F.col(label).alias("_label")), F.col("_id") == F.col("_s"))
    gathered = named.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", "_label"))), lambda x: x["_label"]).alias("labels"))
    return rows.join(gathered.withColumnRenamed(key, "_k"), F.col(key) == F.col("_k"), "left").drop("_k").withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))


def numbered_by_first_use(uses: DataFrame, group: str, item: str, order: list[str]) -> DataFrame:
    """Number the items of a group 1, 2, ... in the order in which each is used first."""
    first = uses.groupBy(group, item).agg(F.min(F.struct(*order)).alias("_first"))
    return first.withColumn("marker", F.row_number().over(Window.partitionBy(group).orderBy("_first"))).drop("_first")


def numbered_with_children(rows: DataFrame, group: str, order: list[str], children: str, prefix: str = "F") -> DataFrame:
    """Number each row and, right after it, its children: a row F1 with two children is followed by F4. Adds id, child_ids and parent.

    children is an array column; its elements become rows of their own with child (the element) and parent (the id of theirs).
    """
    at = Window.partitionBy(group).orderBy(*order)
    before = F.coalesce(F.sum(F.size(children) + 1).over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    name = lambda n: F.concat(F.lit(prefix), n.cast("string"))
    own = rows.withColumn("_n", before)
    own = own.withColumns({"id": name(F.col("_n") + 1), "child_ids": F.transform(children, lambda c, i: name(F.col("_n") + 2 + i))})
    mains = own.withColumns({"child": F.lit(None).cast(rows.schema[children].dataType.elementType), "parent": F.lit(None).cast("string")})
    below = own.select(*[c for c in own.columns if c not in ("id", "child_ids")], F.col("id").alias("parent"), F.posexplode(children).alias("_i", "child"))
    below = below.withColumns({"id": name(F.col("_n") + 2 + F.col("_i")), "child_ids": F.array().cast("array<string>")})
    return mains.drop("_n").unionByName(below.drop("_n", "_i"))


def newest_items(rows: DataFrame, at: str, key: str, limit: int) -> DataFrame:
    """The newest rows, those without a date last, ties to the larger key: a top-k sort."""
    return rows.orderBy(F.col(at).desc_nulls_last(), F.desc(key)).limit(limit)


def newest_of_two(first: DataFrame, second: DataFrame, at: str, key: str, limit: int) -> DataFrame:
    """Two kinds of items as one list, newest first, at most limit; kind tells them apart."""
    both = first.withColumn("kind", F.lit(1)).unionByName(second.withColumn("kind", F.lit(2)))
    return both.orderBy(F.col(at).desc_nulls_last(), "kind", F.desc(key)).limit(limit)


def previous_matching(turns: DataFrame, conversation: str, order: list[str], wanted: Column, value: str) -> DataFrame:
    """For each turn the value of the latest earlier turn for which wanted holds; null where there is none."""
    before = Window.partitionBy(conversation).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("earlier", F.last(F.when(wanted, F.col(value)), ignorenulls=True).over(before))


def spend(calls: DataFrame, group: str | None, tokens_in: str, tokens_out: str, price_in: str, price_out: str) -> DataFrame:
    """Dollars spent: tokens in and out at their prices (dollars for a million), as an exact decimal; 0 without calls."""
    cost = lambda column, price: F.coalesce(F.sum(column), F.lit(0)).cast("decimal(18,0)") * F.lit(price).cast("decimal(8,4)")
    total = ((cost(tokens_in, price_in) + cost(tokens_out, price_out)) * F.lit("0.000001").cast("decimal(7,6)")).cast("decimal(28,10)").alias("usd")
    return (calls.groupBy(group) if group else calls).agg(total)


def within_budget(spent: DataFrame, cap: str) -> DataFrame:
    """Whether another call is allowed: what is spent is below the cap."""
    return spent.withColumn("allowed", F.col("usd") < F.lit(cap).cast("decimal(10,2)"))
