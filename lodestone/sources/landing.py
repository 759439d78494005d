"""Folders that driver and executors share, for files that one step writes and another reads."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def landing_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the session's checkpoints; one of this machine only in local mode."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="landing-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def blob_key(content: Column) -> Column:
    """Where a document's bytes are kept: named by their hash, so that equal contents are one file."""
    return F.concat(F.lit("documents/"), F.sha2(content, 256), F.lit(".pdf"))


def put_blobs(documents: DataFrame, path: str, content: str = "content") -> DataFrame:
    """Store each distinct content once under path, and return the documents with their blob_key instead of the content."""
    keyed = documents.withColumn("blob_key", blob_key(F.col(content)))
    keyed.select("blob_key", F.col(content).alias("content")).dropDuplicates(["blob_key"]).write.mode("append").parquet(path)
    return keyed.drop(content)


def get_blobs(spark: SparkSession, keyed: DataFrame, path: str) -> DataFrame:
    """The documents with their contents; null where the blob is missing."""
    blobs = spark.read.parquet(path).dropDuplicates(["blob_key"]).withColumnRenamed("blob_key", "_key")
    return keyed.join(blobs, F.col("blob_key") == F.col("_key"), "left").drop("_key")


_PUT = pa.schema([("blob_key", pa.string()), ("n_bytes", pa.int64())])


def put_objects(documents: DataFrame, path: str, content: str = "content") -> DataFrame:
    """Store each distinct content as a file of its own, path/documents/<sha256>.pdf; blob_key and n_bytes of each.

    Contents are put by the tasks that hold them, on any file system that Arrow knows. A file is written under a name of
    its own and then moved to that of its hash, so that readers never see a part of one, and tasks that run twice, or two that hold one
    content, leave the same file. A null content is not stored.
    """
    root = place_of(path)
    once = documents.where(F.col(content).isNotNull()).select(blob_key(F.col(content).cast("binary")).alias("blob_key"), F.col(content).cast("binary").alias("content"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        system.create_dir(f"{base.rstrip('/')}/documents", recursive=True)
        for batch in batches:
            sizes = []
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                target = f"{base.rstrip('/')}/{key}"
                own = f"{target}.{uuid.uuid4().hex}.part"
                with system.open_output_stream(own) as out:
                    out.write(data.as_buffer())
                system.move(own, target)
                sizes.append(data.as_buffer().size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], schema=_PUT)

    return once.dropDuplicates(["blob_key"]).mapInArrow(put, "blob_key string, n_bytes long")


def objects(spark: SparkSession, path: str) -> DataFrame:
    """The stored files: blob_key, n_bytes, content. Where content is not asked for, no file is opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(f"{path}/documents")
    return files.select(F.concat(F.lit("documents/"), F.element_at(F.split("path", "/"), -1)).alias("blob_key"), F.col("length").alias("n_bytes"), "content")


def place_of(path: str) -> str:
    """A path as Arrow takes it: with an absolute URI, where Spark writes file:/x."""
    return "file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path
