"""Helpers shared by the corpus operators: lineage cuts, word rules, row keys."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the word rule, [\x20\x09-\x0D], and its regex class.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of this machine only in local mode, where the session names none."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Compute df once and write it to the shared folder, so that a lost executor costs no lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def row_key(*columns: Column) -> list[Column]:
    """Two independent 64-bit hashes that stand for the columns' values; nulls are told from values."""
    typed = [F.coalesce(c.cast("string"), F.lit("")) for c in columns] + [c.isNull() for c in columns]
    return [F.xxhash64(*typed), F.xxhash64(F.lit("second"), *typed)]


def unused(df: DataFrame, *stems: str) -> list[str]:
    """Column names like the stems that df does not have, so that helper columns clash with nothing."""
    taken = {c.lower() for c in df.columns}
    names = []
    for stem in stems:
        while stem in taken:
            stem += "_"
        names.append(stem)
    return names


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def total_bytes(df: DataFrame, column: str) -> int:
    """Bytes of text in a column over all rows; sizes the batches of a blocked shuffle."""
    found = df.agg(F.sum(F.octet_length(column)).alias("n")).first()
    return int(found["n"] or 0)


def unplaced(key: Column) -> Column:
    """An integer key with the same values that the planner does not take for the column it was grouped by.

    A join of rows with an aggregate of them by the same key would reuse the aggregate's partitions,
    and Spark splits a hot key of a join only where both sides are shuffled for that join.
    """
    return key.bitwiseXOR(F.lit(0).cast("long"))
