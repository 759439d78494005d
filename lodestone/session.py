"""Session construction and table access shared by queries, tests and the bench."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A single-node session for tests and the bench; a cluster supplies its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lodestone")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.memory", "6g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of which one task makes and reads texts, at most about.
ROWS_A_TASK = 20_000


def spread(df: DataFrame, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """Rows dealt evenly over the cores, in more tasks the more rows there are.

    A row of a small file stands for much work once texts are written from it, which Spark cannot see: it reads a file of less
    than 128 MB in one task, and would join small parts again where their number is left to it.
    """
    return df.repartition(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows_a_task)))
