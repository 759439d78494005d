"""Tables that are replaced by key on storage: bucketed by key hash, of which a batch rewrites only the buckets that it touches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKET = "bucket"


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def create(rows: DataFrame, path: str, keys: Sequence[str], buckets: int) -> None:
    """Write a table of one folder for each bucket of its keys."""
    rows.withColumn(BUCKET, bucket_of(keys, buckets)).repartition(buckets, BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BUCKET)


def replace_by_key(spark: SparkSession, incoming: DataFrame, path: str, keys: Sequence[str], buckets: int, newest: str) -> None:
    """Last write wins: each key of incoming takes its row with the largest value of newest, unless the table's own is larger.

    Only buckets that incoming has keys of are read (the list of them prunes the scan; it is no longer than buckets) and
    rewritten, by dynamic partition overwrite: files of other buckets keep their names, and the same batch
    applied again changes no row. Null keys are a key. A failed write leaves the table as it was.
    """
    batch = incoming.withColumn(BUCKET, bucket_of(keys, buckets))
    touched = [r[BUCKET] for r in batch.select(BUCKET).distinct().collect()]
    if not touched:
        return
    held = spark.read.parquet(path).where(F.col(BUCKET).isin(touched)).select(*incoming.columns, BUCKET)
    last = Window.partitionBy(BUCKET, *keys).orderBy(F.desc_nulls_last(newest), F.desc("_new"))
    ranked = batch.withColumn("_new", F.lit(1)).unionByName(held.withColumn("_new", F.lit(0))).withColumn("_place", F.row_number().over(last))
    kept = ranked.where("_place = 1").drop("_place", "_new")
    kept.repartition(len(touched), BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
