"""Daily price files: comma-separated values with a fixed header, checked before any row is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns that a price file must have, and the type of instrument that is an equity.
REQUIRED = ("TradDt", "FinInstrmTp", "FinInstrmId", "OpnPric", "HghPric", "LwPric", "ClsPric", "PrvsClsgPric", "TtlTradgVol")
EQUITY = "STK"
PRICES = {"open": "OpnPric", "high": "HghPric", "low": "LwPric", "close": "ClsPric", "prev_close": "PrvsClsgPric"}


class BadPriceFile(ValueError):
    """The file's header is not that of a price file, as with an error page."""


def _price(name: str) -> Column:
    value = F.trim(name).try_cast("decimal(14,2)")
    return F.when(value > 0, value)


def read_price_file(spark: SparkSession, path: str, codes: DataFrame) -> DataFrame:
    """Prices of the equities whose code is in codes (one column, bse_code).

    A byte-order mark before the header is tolerated. Rows that are short, of another instrument, without a
    day or with a price that is no positive number or a volume that is negative are left out.
    """
    header = spark.read.option("header", True).csv(path).columns
    names = [name.removeprefix("﻿").strip() for name in header]
    if not set(REQUIRED) <= set(names):
        raise BadPriceFile("the file is not a daily price file")
    schema = ", ".join(f"`{name}` string" for name in names) + ", `_bad` string"
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("columnNameOfCorruptRecord", "_bad").csv(path)
    volume = F.trim("TtlTradgVol").try_cast("decimal(20,0)").cast("long")
    read = rows.where(F.col("_bad").isNull() & (F.trim("FinInstrmTp") == EQUITY)).select(
        F.trim("FinInstrmId").alias("bse_code"), F.trim("TradDt").try_cast("date").alias("trade_date"), *[_price(c).alias(n) for n, c in PRICES.items()], volume.alias("volume")
    )
    whole = F.col("trade_date").isNotNull() & (F.col("volume") >= 0)
    for name in PRICES:
        whole = whole & F.col(name).isNotNull()
    return read.where(whole).join(codes.select(F.col("bse_code").alias("_code")).distinct(), F.col("bse_code") == F.col("_code"), "left_semi")
