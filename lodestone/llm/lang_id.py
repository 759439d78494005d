"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import fold
from lodestone.session import table

#: Character n-grams of 1 to ORDERS letters, hashed to 2**BITS features.
ORDERS, BITS = 3, 15
#: Code points that are scored at once, and weights that are looked up at once (32 MB).
CHUNK, LOOKED_UP = 400_000, 4_000_000
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _features(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Feature numbers of all texts, an array for each order; each text's first place in it; whether it has a letter.

    Letters are lower-cased; every run of other characters is one space. A gap of ORDERS marks stands
    before each text and after the last, so that no n-gram has letters of two texts; marks count as spaces.
    """
    gap = "\0" * ORDERS
    lowered = [x.replace("\0", " ").lower() for x in texts]
    points = np.frombuffer((gap + gap.join(lowered) + gap).encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.cumsum([0] + [len(x) + ORDERS for x in lowered])
    letter = _letters()[points]
    keep = letter | (points == 0)
    keep[1:] |= letter[:-1]  # the first of each run of other characters
    signs = np.where(letter, points, np.uint32(32))[keep]
    places = (np.cumsum(keep) - keep)[bounds]
    starts, end = places[:-1], places[-1]
    seen = np.cumsum(letter)
    has_letter = seen[bounds[1:]] > seen[bounds[:-1]]
    grams, found = np.zeros(len(signs), np.uint32), []
    for n in range(1, ORDERS + 1):
        grams = grams[: len(signs) - n + 1] * np.uint32(0x01000193) + signs[n - 1 :] + np.uint32(n)
        mixed = (grams ^ (grams >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        found.append((((mixed ^ (mixed >> np.uint32(12))) * np.uint32(0x297A2D39)) >> np.uint32(32 - BITS))[:end].astype(np.int64))
    return found, starts, has_letter


def _chunks(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Row number of the first, and whole texts of about CHUNK code points together; null is empty."""
    held, size, first = [], 0, 0
    for i in range(len(column)):
        held.append(column[i].as_py() or "")
        size += len(held[-1])
        if size >= CHUNK:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


def _parts(text: str) -> Iterator[str]:
    """The text in parts of at most CHUNK code points, cut at blanks where there are any; each part has edges of its own."""
    at = 0
    while len(text) - at > CHUNK:
        end = text.rfind(" ", at + CHUNK // 2, at + CHUNK) + 1 or at + CHUNK
        yield text[at:end]
        at = end
    yield text[at:]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for first, texts in _chunks(batch.column(1)):
            langs = batch.column(0).slice(first, len(texts)).to_pylist()
            for lang in set(langs):
                held = counts.setdefault(lang, np.zeros(1 << BITS, np.int64))
                for part in _by_size([p for x, own in zip(texts, langs, strict=True) if own == lang for p in _parts(x)]):
                    for features in _features(part)[0]:
                        held += np.bincount(features, minlength=1 << BITS)
    for lang, held in counts.items():
        used = np.nonzero(held)[0]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used), pa.array(held[used])], names=["lang", "feature", "n"])


def _by_size(parts: list[str]) -> Iterator[list[str]]:
    """Runs of parts of about CHUNK code points together."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part)
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


@dataclass(frozen=True)
class Model:
    """Languages in code point order, log prior of each, and log probabilities by feature and language."""

    langs: list[str]
    prior: np.ndarray
    weights: np.ndarray

    def score(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Best language and its posterior probability; UNKNOWN and 0 for a text without letters.

        Long texts are added up part by part, and weights are looked up by LOOKED_UP at a time, so that
        neither a text's length nor the number of languages sets the memory.
        """
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        total, has_letter = np.tile(self.prior, (len(texts), 1)), np.zeros(len(texts), bool)
        owners, parts = [], []
        for i, text in enumerate(texts):
            for part in _parts(text):
                owners.append(i)
                parts.append(part)
        at, step = 0, max(1, LOOKED_UP // len(self.langs))
        for run in _by_size(parts):
            own = np.array(owners[at : at + len(run)])
            at += len(run)
            found, starts, letters = _features(run)
            has_letter[own[letters]] = True
            for features in found:
                for low in range(0, len(features), step):
                    first = np.searchsorted(starts, low, side="right") - 1
                    last = np.searchsorted(starts, min(low + step, len(features)), side="left")
                    edges = np.maximum(starts[first:last] - low, 0)
                    np.add.at(total, own[first:last], np.add.reduceat(self.weights[features[low : low + step]], edges, axis=0))
        odds = np.exp(total - total.max(axis=1, keepdims=True))
        best = total.argmax(axis=1)
        sure = odds[np.arange(len(texts)), best] / odds.sum(axis=1)
        names = [self.langs[b] if known else UNKNOWN for b, known in zip(best.tolist(), has_letter.tolist(), strict=True)]
        return names, np.where(has_letter, sure, 0.0)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", docs_per_lang: int = 3000, alpha: float = 0.5) -> Model:
    """Fit the model on at most about docs_per_lang documents of each language, drawn by hash.

    Rows without text or language are not used. The hash is of doc_id and text, so that copies of a
    text are drawn each by itself. The sample is bounded by docs_per_lang, and the model holds 256 KB for
    each language, whatever the size of the table.
    """
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.lit("fit"), doc_id, text).alias("h")).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = rows.groupBy("lang").count().collect()
    if not sizes:
        return Model([], np.empty(0), np.empty((1 << BITS, 0)))
    sizes = sorted((r["lang"], r["count"]) for r in sizes)
    wanted = labelled.sparkSession.createDataFrame([(x, min(1.0, docs_per_lang / n)) for x, n in sizes], "own string, part double")
    drawn = rows.join(F.broadcast(wanted), F.col("lang") == F.col("own")).where(F.pmod("h", F.lit(1 << 30)) < F.col("part") * float(1 << 30))
    parts = max(1, min(16, len(sizes)))  # the sample is bounded, and so are the tasks that count it
    counted = drawn.select("lang", "text").repartition(parts).mapInArrow(_count, "lang string, feature long, n long")
    found = counted.groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    langs = [x for x, _ in sizes]
    counts = np.zeros((1 << BITS, len(langs)))
    counts[found["feature"].to_numpy(), found["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy()] = found["n"].to_numpy()
    weights = np.log(counts + alpha) - np.log(counts.sum(axis=0) + alpha * (1 << BITS))
    prior = np.log([n for _, n in sizes]) - np.log(sum(n for _, n in sizes))
    return Model(langs, prior, weights - weights.mean(axis=1, keepdims=True))


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add lang_pred and score (the posterior probability, 0 to 1) to docs; the model is broadcast.

    Whole texts are scored. A text that is null or has no letter is "und" with score 0, and so is every
    text if no language was learned. Columns of these names are replaced, others stay; ties of
    languages go to the first by code point.
    """
    source = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = source.columns.index(text)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _chunks(batch.column(place)):
                names, sure = shared.value.score(texts)
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(sure)], names=[*batch.schema.names, "lang_pred", "score"])

    schema = T.StructType([*source.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return source.mapInArrow(score, schema)


def learn_from(docs: DataFrame) -> DataFrame:
    """The documents that may be learned from: all but the held-out fold."""
    return docs.where(fold(F.col("doc_id"), 5) != 0)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), fit(learn_from(docs)))
    return found.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")
