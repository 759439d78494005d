"""Nested values: objects, tolerant forms, rules of arrays, ordered groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def vocabulary_order(values: Column, vocabulary: Sequence[str]) -> Column:
    """The known values of an array, each once, in the vocabulary's order and not in their own."""
    return F.filter(F.array(*map(F.lit, vocabulary)), lambda v: F.array_contains(values, v))


def valid_values(values: Column, vocabulary: Sequence[str], single: bool) -> Column:
    """Whether an array holds only known values, each once, at least one, and one at most if single; null is not valid."""
    known = F.size(F.array_except(values, F.array(*map(F.lit, vocabulary)))) == 0
    sound = known & ~F.exists(values, lambda v: v.isNull()) & (F.size(F.array_distinct(values)) == F.size(values)) & (F.size(values) > 0)
    return F.coalesce(sound & (F.size(values) <= 1) if single else sound, F.lit(False))


def parse_form(text: Column, schema: str, items: str, most: int, keep: Column | None = None) -> Column:
    """The items of a JSON form, at most the first most of those that pass keep; what cannot be read is no item.

    keep is a condition on an element as a lambda of one column. A form that is no object, or without items, gives an empty array.
    """
    read = F.from_json(text, schema, {"mode": "PERMISSIVE"})[items]
    found = F.coalesce(read, F.array().cast(f"array<{_element(schema, items)}>"))
    return F.slice(found if keep is None else F.filter(found, keep), 1, most)


def _element(schema: str, items: str) -> str:
    """The element type of a field of arrays in a schema such as "claims array<struct<text:string>>, outcome string"."""
    at = schema.index(f"{items} array<") + len(items) + 7
    depth, end = 1, at
    while depth:
        depth += {"<": 1, ">": -1}.get(schema[end], 0)
        end += 1
    return schema[at : end - 1]


def grouped_in_order(rows: DataFrame, kind: str, kinds: Sequence[str]) -> DataFrame:
    """Add place: kinds numbered as they are listed; kinds that are not listed come last. Rows stay rows, however many a group has."""
    place = F.array_position(F.array(*map(F.lit, kinds)), F.col(kind))
    return rows.withColumn("place", F.when(place > 0, place).otherwise(len(kinds) + 1))


def in_words(text: Column, typed: Column) -> Column:
    """Whether the text contains each of the typed words, case ignored; true if nothing is typed."""
    words = F.filter(F.split(F.lower(F.trim(typed)), r"\s+"), lambda w: w != "")
    return F.forall(words, lambda w: F.contains(F.lower(text), w))


def first_mention_order(text: Column, names: Sequence[str]) -> Column:
    """The names that the text has as whole words, in the order in which each is mentioned first."""
    places = [F.struct(F.regexp_instr(text, F.lit(rf"(?i)(?<!\w){n}(?!\w)")).alias("at"), F.lit(n).alias("name")) for n in names]
    return F.transform(F.array_sort(F.filter(F.array(*places), lambda p: p["at"] > 0)), lambda p: p["name"])
