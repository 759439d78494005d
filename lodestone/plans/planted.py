"""Texts made of the rows of a table, with facts planted in them; the same facts in SQL are what must be found again.

Every customer carries one case of a list, chosen by its key, whose blanks are filled from the customer's own row: {a} and {b}
are nations, {y}, {z} and {p} a year, the year's last two digits and the year before, {n} an amount (of the balance), {g} the same
amount with a comma, {m} another amount, {d} and {e} a day as a date and its month in words.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import spread, table

#: What is known of each customer, in SQL.
BASE_SQL = "(SELECT c_custkey AS id, c_nationkey, 10000 + floor(abs(c_acctbal) * 10)::BIGINT % 80000 AS planted_n, make_date((2017 + c_custkey % 7)::INT, (1 + c_custkey % 12)::INT, 5) AS planted_day FROM customer)"
_FILL_SQL = {
    "{a}": "'Nation_' || c_nationkey",
    "{b}": "'Nation_' || ((c_nationkey + 7) % 25)",
    "{y}": "year(planted_day)::VARCHAR",
    "{z}": "right(year(planted_day)::VARCHAR, 2)",
    "{p}": "(year(planted_day) - 1)::VARCHAR",
    "{n}": "planted_n::VARCHAR",
    "{g}": "(planted_n // 1000) || ',' || lpad((planted_n % 1000)::VARCHAR, 3, '0')",
    "{m}": "(planted_n + 1)::VARCHAR",
    "{d}": "planted_day::VARCHAR",
    "{e}": "strftime(planted_day, '%b')",
}


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, the customer's key, and a column for each blank."""
    key = F.col("c_custkey")
    day = F.make_date((2017 + key % 7).cast("int"), (1 + key % 12).cast("int"), F.lit(5))
    customers = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")).withColumn("day", day)
    year, amount = F.year("day"), F.lit(10_000) + F.floor(F.abs("c_acctbal") * 10) % 80_000
    nation = F.col("c_nationkey")
    fill = {
        "{a}": F.concat(F.lit("Nation_"), nation.cast("string")),
        "{b}": F.concat(F.lit("Nation_"), ((nation + 7) % 25).cast("string")),
        "{y}": year.cast("string"),
        "{z}": F.right(year.cast("string"), F.lit(2)),
        "{p}": (year - 1).cast("string"),
        "{n}": amount.cast("string"),
        "{g}": F.concat(F.floor(amount / 1000).cast("string"), F.lit(","), F.lpad((amount % 1000).cast("string"), 3, "0")),
        "{m}": (amount + 1).cast("string"),
        "{d}": F.col("day").cast("string"),
        "{e}": F.date_format("day", "MMM"),
    }
    return customers.select(F.col("c_custkey").alias("id"), *[value.alias(blank) for blank, value in fill.items()])


def filled(text: Column, blanks: Iterable[str] = tuple(_FILL_SQL)) -> Column:
    for blank in blanks:
        text = F.replace(text, F.lit(blank), F.col(blank))
    return text


def cases(spark: SparkSession, sf_dir: str, listed: list[tuple], schema: str, whole: bool = False) -> DataFrame:
    """id and the columns of the case of each customer, blanks filled; of every case, if whole. schema: names and types; only strings have blanks."""
    made = rows(spark, sf_dir)
    numbered = spark.createDataFrame([(i, *r) for i, r in enumerate(listed)], "_case int, " + schema)
    joined = made.crossJoin(F.broadcast(numbered)) if whole else made.join(F.broadcast(numbered), F.col("id") % len(listed) == F.col("_case"))
    used = [[b for b in _FILL_SQL if any(isinstance(r[k], str) and b in r[k] for r in listed)] for k in range(len(numbered.columns) - 1)]
    return joined.select("id", *[filled(F.col(f.name), used[k]).alias(f.name) if used[k] else F.col(f.name) for k, f in enumerate(f for f in numbered.schema if f.name != "_case")])


def _show(x: object) -> str:
    return "NULL" if x is None else f"'{x.replace(chr(39), chr(39) * 2)}'" if isinstance(x, str) else str(x)


def cases_sql(listed: list[tuple], names: str, select: str, groups: int | None = None) -> str:
    """SQL of what was planted: the select list over id and the named columns, whose blanks are filled. Of rows that begin with a case number (groups says how many cases there are), all of the customer's case; else the row with its number."""
    columns = names.replace(" ", "").split(",")
    values = [r if groups else (i, *r) for i, r in enumerate(listed)]
    strings = {c for k, c in enumerate(columns, 1) if any(isinstance(r[k], str) for r in values)}

    def fill(column: str) -> str:
        if column not in strings:
            return column
        out = f"x.{column}"
        for blank, value in _FILL_SQL.items():
            if any(isinstance(r[columns.index(column) + 1], str) and blank in r[columns.index(column) + 1] for r in values):
                out = f"replace({out}, '{blank}', {value})"
        return f"{out} AS {column}"

    made = ", ".join("(" + ", ".join(map(_show, r)) + ")" for r in values)
    return f"""WITH planted AS (
  SELECT id, {', '.join(map(fill, columns))}
  FROM {BASE_SQL} o JOIN (VALUES {made}) x(_case, {names}) ON id % {groups or len(listed)} = x._case
) SELECT {select} FROM planted"""
