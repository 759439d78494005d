"""Line deduplication over a corpus: lines found in many documents go, the rest keep their places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import BLANKS, ascii_lower, cut, row_key, unplaced, unused
from lodestone.session import table

#: So many line hashes (some 100 MB) are broadcast; more are joined by a shuffle.
BROADCAST_LINES = 1_000_000


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def dedup_lines(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_docs: int = 10, min_chars: int = 1
) -> DataFrame:
    """Drop every line whose key occurs in at least min_docs documents.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased; keys shorter
    than min_chars code points are never dropped. Documents are told apart by doc_id: rows that
    repeat an id count once, and so do all rows whose id is null. A null or empty text is one empty
    line. All columns of docs are kept; kept_text, n_lines and n_dropped are added (and replace
    columns of these names). An empty table gives an empty table.

    Only 128-bit line hashes are shuffled for counting; distinct (hash, document) pairs are reduced
    before they are counted by hash, so a line that is in a third of all documents is spread over
    all tasks. The hashes of the lines to drop are broadcast if they are few; if not, they are shuffled
    apart from the count, so that Spark splits the rows of a hot line. The positions to drop are
    joined back to the texts.
    """
    source = docs.drop("kept_text", "n_lines", "n_dropped")
    k1, k2, all_lines, gone = unused(source, "_k1", "_k2", "_lines", "_dropped")
    keys = row_key(F.col(doc_id), F.col(text))
    with_lines = source.select(F.col(doc_id).alias("_doc"), keys[0].alias("_k1"), keys[1].alias("_k2"), F.col(text).alias("_text"))
    line_keys = F.transform(_lines(F.col("_text")), _line_key)
    hashed = F.transform(
        line_keys,
        lambda key: F.when(
            F.char_length(key) >= min_chars, F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2"))
        ),
    )
    exploded = (
        with_lines.select("_doc", "_k1", "_k2", F.posexplode(hashed).alias("_pos", "_h"))
        .where("_h IS NOT NULL")
        .select("_doc", "_k1", "_k2", "_pos", F.col("_h.h1").alias("_h1"), F.col("_h.h2").alias("_h2"))
    )
    frequent = (
        exploded.select("_h1", "_h2", "_doc")
        .distinct()
        .groupBy("_h1", "_h2")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") >= min_docs)
        .select(unplaced(F.col("_h1")).alias("_f1"), F.col("_h2").alias("_f2"))
    )
    frequent = cut(frequent)
    if frequent.count() <= BROADCAST_LINES:
        frequent = F.broadcast(frequent)
    dropped = (
        exploded.join(frequent, (F.col("_h1") == F.col("_f1")) & (F.col("_h2") == F.col("_f2")))
        .groupBy("_k1", "_k2")
        .agg(F.collect_set("_pos").alias(gone))
        .select(unplaced(F.col("_k1")).alias(k1), F.col("_k2").alias(k2), gone)
    )
    joined = source.withColumns({k1: keys[0], k2: keys[1]}).join(dropped, [k1, k2], "left").withColumn(all_lines, _lines(F.col(text)))
    places = F.sequence(F.lit(0), F.size(all_lines) - 1)
    kept = F.when(F.col(gone).isNull(), F.col(all_lines)).otherwise(
        F.transform(F.array_except(places, F.col(gone)), lambda i: F.get(F.col(all_lines), i))
    )
    return joined.select(
        *[F.col(c) for c in source.columns],
        F.array_join(kept, "\n").alias("kept_text"),
        F.size(all_lines).cast("long").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH lines AS (
  SELECT doc_id, rid, i, line,
         translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (
    SELECT doc_id, rid, unnest(ls) AS line, generate_subscripts(ls, 1) AS i
    FROM (SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
  )
), frequent AS (
  SELECT k FROM lines WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT coalesce(doc_id, -1)) >= 10
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE f.k IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.k IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN frequent f ON lines.k = f.k
GROUP BY rid
"""
