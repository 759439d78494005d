"""Figures proposed from texts: places of labels and of numbers, merged by position, and judged by the rules of validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as t
from lodestone.operators.documents import LABELS, SCALE
from lodestone.operators.questions import parse_period

#: A number belongs to the label before it if it begins within so many characters of the label's end.
REACH = 60
#: A quote begins at most so many characters before its label and ends at most so many after its number, inside the sentence.
BEFORE, AFTER = 40, 40
_LABEL = r"\b(?:" + "|".join(LABELS.values()) + r")\b"
_PLACES = rf"{_LABEL}|{t.NUMBER_IN_TEXT}"
_END = r"[!?\n;]|\.(?!\d)"


def places(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every label and number of a text: doc_id, at (characters before it), found, metric (null for a number).

    Text is in the form in which quotes are compared, rupee marks kept. One pattern finds both; what stands between two places is
    as long as the pieces that the pattern splits off, so that places are running sums and no text is searched twice.
    """
    plain = docs.select(F.col(doc_id).alias("_doc"), t.collapse(t.prepare(F.col(text))).alias("_text")).where("_text IS NOT NULL")
    found, between = F.regexp_extract_all("_text", F.lit(_PLACES), F.lit(0)), F.split("_text", _PLACES, -1)
    rows = plain.select("_doc", found.alias("_found"), between.alias("_between")).where(F.size("_found") > 0)
    rows = rows.select("_doc", F.posexplode(F.arrays_zip("_found", F.slice("_between", 1, F.size("_found")).alias("_gap"))).alias("_i", "_p"))
    order = Window.partitionBy("_doc").orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    long = F.char_length("_p._found")
    placed = rows.withColumn("at", F.sum(F.char_length("_p._gap") + long).over(order) - long)
    metric = F.lit(None).cast("string")
    for name, pattern in reversed(LABELS.items()):
        metric = F.when(F.col("_p._found").rlike(rf"^(?:{pattern})$"), name).otherwise(metric)
    return placed.select(F.col("_doc").alias(doc_id), F.col("at").cast("int").alias("at"), F.col("_p._found").alias("found"), metric.alias("metric"))


def nearest_after(found: DataFrame, doc_id: str = "doc_id", reach: int = REACH) -> DataFrame:
    """The positional join: to each label the first number behind it that begins within reach, with no other label between.

    One window over the places of a text from its end, last one that is not null: linear in places, and a text is one key.
    """
    back = Window.partitionBy(doc_id).orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    near = found.withColumn("_next", F.last(F.struct("at", "found", "metric")).over(back))
    ends = F.col("at") + F.char_length("found")
    paired = near.where(F.col("metric").isNotNull() & F.col("_next.metric").isNull() & (F.col("_next.at") - ends <= reach))
    return paired.select(doc_id, "metric", "at", F.col("_next.at").alias("number_at"), F.col("_next.found").alias("value_text"))


def propose(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Candidates for validation of each text: metric, value_text, unit_word, currency, period, basis, quote, page_text.

    A quote is the part of the label's sentence around label and number; unit, period and basis are what it says.
    Null texts have none. doc_id is unique.
    """
    pages = docs.select(F.col(doc_id).alias("_d"), F.col(text).alias("page_text"), t.collapse(t.prepare(F.col(text))).alias("_text"))
    joined = nearest_after(places(docs, doc_id, text), doc_id).join(pages, F.col(doc_id) == F.col("_d")).drop("_d")
    cut: Column = F.greatest(F.col("at") - BEFORE, F.lit(0))
    head = F.substr(F.col("_text"), cut + 1, F.col("at") - cut)
    own = F.regexp_replace(head, rf"(?s)^.*(?:{_END})\s*", "")
    end = F.col("number_at") + F.char_length("value_text")
    tail = F.regexp_extract(F.substr(F.col("_text"), end + 1, F.lit(AFTER)), rf"(?s)^((?:(?!{_END}).)*)", 1)
    body = F.substr(F.col("_text"), F.col("at") + 1, end - F.col("at"))
    quote = F.trim(F.concat(own, body, tail))
    unit = F.lit("none")
    for name, pattern in reversed(SCALE.items()):
        unit = F.when(F.col("_tail").rlike(rf"^[\s/-]*{pattern}"), name).otherwise(unit)
    unit = F.when(F.col("_tail").rlike(r"^\s*(?:%|per ?cent\b)"), "percent").when(F.col("_tail").rlike(r"^\s*(?:/-\s*)?per (?:equity |ordinary )?share\b"), "per_share").otherwise(unit)
    period = F.regexp_extract("quote", r"(?:q[1-4]\s*)?fy\s*'?\d{2,4}(?:\s*-\s*\d{2,4})?|\b20\d{2}\s*-\s*(?:20)?\d{2}\b", 0)
    # What several expressions read is a column of its own, so that none is computed, or compiled, again for each.
    rows = joined.withColumns({"quote": quote, "_tail": tail}).withColumn("_period", F.nullif(period, F.lit("")))
    basis = F.when(F.col("quote").rlike(r"\bconsolidated\b"), "consolidated").when(F.col("quote").rlike(r"\bstandalone\b"), "standalone").otherwise("unspecified")
    return rows.select(doc_id, "at", "metric", "value_text", unit.alias("unit_word"), F.lit("none").alias("currency"), parse_period(F.col("_period")).alias("period"), basis.alias("basis"), "quote", "page_text")
