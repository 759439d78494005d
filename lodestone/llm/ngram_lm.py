"""Language-model scoring by deleted interpolation: n-gram estimates mixed by context frequency.

Counting and looking up go through one blocked shuffle. Documents are dealt to batches by a hash. A
batch sends each of its distinct n-grams once, with its count, to the n-gram's bucket (a range of
64-bit hashes); a bucket adds the counts of all batches and sends each batch the totals of its
n-grams, in the batch's order. Rows are packed arrays, so neither a frequent n-gram nor a long document
is more than one entry per batch, and no table of n-grams is broadcast or collected. A batch writes a row to
a bucket only if it has n-grams there, so rows are never more than the distinct n-grams of the batches,
which grow in proportion to the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import cut, fold, text_bytes, total_bytes
from lodestone.llm.shingles import STEP, U64, WordHashes, mix, split_words
from lodestone.session import table

#: Folds of ten: 0 is never learned from, 1 is held out from the counts that train the mixture.
TEST, HELD_OUT, COUNTED = 0, 1, 2
BATCH_BYTES, BUCKET_BYTES = 6_000_000, 12_000_000
#: Context-frequency buckets (by powers of two) and steps of a probability's binary logarithm in the histogram.
LEVELS, GRAIN = 16, 4
#: Words never hold white space, so these stand for no word.
_EDGES = WordHashes()
END, BEGIN = U64(_EDGES[b"\nend"]), U64(_EDGES[b"\nbegin"])
#: The low byte of a bigram's hash is dropped: 56 bits are told apart, one byte less is sent.
_KEEP = U64(0xFFFFFFFFFFFFFF00)


def _pack(values: np.ndarray) -> bytes:
    """Bytes by place: sorted keys agree in their high places, which a compressing shuffle then shrinks."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def _unpack(data: bytes, kind: type = np.uint64) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _write_counts(counts: np.ndarray) -> bytes:
    """Counts as the smallest type that holds them, led by its width and their number, compressed."""
    top = int(counts.max()) if len(counts) else 0
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(k).max)
    data = counts.astype(kind)
    return bytes([data.itemsize]) + len(data).to_bytes(4, "little") + pa.compress(_pack(data), codec="zstd", asbytes=True)


def _read_counts(data: bytes) -> np.ndarray:
    width, n = data[0], int.from_bytes(data[1:5], "little")
    return _unpack(pa.decompress(data[5:], n * width, codec="zstd", asbytes=True), np.dtype(f"u{width}")).astype(np.int64)


_DEALT = "batch long, ids array<long>, sizes array<int>, data binary"


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pack the documents of one batch that come together: ids, sizes and compressed texts."""
    for part in batches:
        number = part.column(0).to_numpy(zero_copy_only=False)
        order = np.argsort(number, kind="stable")
        for rows in np.split(order, np.nonzero(np.diff(number[order]))[0] + 1) if len(order) else []:
            own = part.take(pa.array(rows))
            texts = own.column(2).to_pylist()
            blob = pa.compress(b"".join(texts), codec="zstd", asbytes=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(number[rows[0]])]), pa.array([own.column(1).to_pylist()], pa.list_(pa.int64())), pa.array([[len(x) for x in texts]], pa.list_(pa.int32())), pa.array([blob], pa.binary())],
                names=["batch", "ids", "sizes", "data"],
            )


def deal(docs: DataFrame, batches: dict[int, int]) -> DataFrame:
    """Documents (doc_id, text) in packed rows of a batch; batch // 2**40 is the kind of its fold.

    The place of a row is part of its hash, so that repeated rows are spread over batches; the packed rows
    are written to the shared folder, so that all later steps see the same batches and read no text again.
    """
    which = F.least(fold(F.col("doc_id"), 10), F.lit(COUNTED))
    size = F.element_at(F.create_map(*[F.lit(x) for pair in batches.items() for x in pair]), F.col("_kind").cast("int"))
    rows = (
        docs.withColumn("_kind", which)
        .select(
            (F.col("_kind") * F.lit(1 << 40) + F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), size)).cast("long").alias("batch"),
            F.col("doc_id").cast("long").alias("doc_id"),
            text_bytes(F.col("text")).alias("data"),
        )
    )
    return cut(rows.mapInArrow(_deal, _DEALT))


class Batch:
    """Tokens of a batch's documents, and its distinct unigrams and bigrams."""

    def __init__(self, packed: pa.Table):
        hashes, words, self.ids, sizes = WordHashes(), [], [], []
        for ids, lengths, data in zip(*(packed.column(c).to_pylist() for c in ("ids", "sizes", "data")), strict=True):
            texts, at = pa.decompress(data, sum(lengths), codec="zstd", asbytes=True), 0
            self.ids += ids
            for n in lengths:
                words += [hashes.of(split_words(texts[at : at + n])), END[None]]
                sizes.append(len(words[-2]) + 1)
                at += n
        self.sizes = np.array(sizes, np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.tokens = np.concatenate(words)
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[self.starts] = BEGIN
        self.unigrams, self.word, self.word_counts = np.unique(self.tokens, return_inverse=True, return_counts=True)
        pairs = mix(before * STEP + self.tokens) & _KEEP
        self.bigrams, self.pair, self.pair_counts = np.unique(pairs, return_inverse=True, return_counts=True)

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.starts)


def _kind(batch: int) -> int:
    return batch >> 40


def _send(bits: int):
    schema = pa.schema([("bucket", pa.int64()), ("batch", pa.int64()), *((c, pa.binary()) for c in ("words", "word_n", "pairs", "pair_n"))])

    def send(key: tuple, packed: pa.Table) -> pa.Table:
        batch, number = Batch(packed), key[0].as_py()
        counts = _kind(number) != TEST
        buckets = np.unique(np.concatenate([batch.unigrams >> U64(64 - bits), batch.bigrams >> U64(64 - bits)]))
        ends = [np.searchsorted(k >> U64(64 - bits), buckets, side="right") for k in (batch.unigrams, batch.bigrams)]
        rows = []
        for i, bucket in enumerate(buckets.tolist()):
            row = [bucket, number]
            for keys, n, cuts in ((batch.unigrams, batch.word_counts, ends[0]), (batch.bigrams, batch.pair_counts, ends[1])):
                part = slice(cuts[i - 1] if i else 0, cuts[i])
                row += [_pack(keys[part] >> U64(0 if keys is batch.unigrams else 8)), _write_counts(n[part] if counts else np.zeros_like(n[part]))]
            rows.append(row)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return send


_TOTALS = "bucket long, batch long, words binary, words_kept binary, pairs binary, pairs_kept binary, tokens long, tokens_kept long, types long, types_kept long"


def _total(key: tuple, sent: pa.Table) -> pa.Table:
    """Totals of a bucket's n-grams for each batch; the first row also has the bucket's tokens and types."""
    numbers = sent.column("batch").to_pylist()
    kinds = np.array([_kind(x) for x in numbers])
    out, marks = {}, {}
    for name, n in (("words", "word_n"), ("pairs", "pair_n")):
        keys = [_unpack(x) for x in sent.column(name).to_pylist()]
        sizes = [len(k) for k in keys]
        counts = np.concatenate([_read_counts(x) for x in sent.column(n).to_pylist()])
        found, where = np.unique(np.concatenate(keys), return_inverse=True)
        del keys
        every = np.bincount(where, counts, len(found)).astype(np.int64)
        counts[np.repeat(kinds == HELD_OUT, sizes)] = 0
        kept = np.bincount(where, counts, len(found)).astype(np.int64)
        ends = np.cumsum(sizes)
        out[name] = [_write_counts(every[where[e - s : e]]) for s, e in zip(sizes, ends, strict=True)]
        out[f"{name}_kept"] = [_write_counts(kept[where[e - s : e]]) if k == HELD_OUT else None for s, e, k in zip(sizes, ends, kinds, strict=True)]
        marks[name] = [int(x) for x in (every.sum(), kept.sum(), (every > 0).sum(), (kept > 0).sum())]
    stats = [[m] + [0] * (len(numbers) - 1) for m in marks["words"]]
    columns = [pa.array([key[0].as_py()] * len(numbers)), pa.array(numbers), *(pa.array(out[c], pa.binary()) for c in ("words", "words_kept", "pairs", "pairs_kept")), *map(pa.array, stats)]
    return pa.Table.from_arrays(columns, names=[x.split()[0] for x in _TOTALS.split(", ")])


def _receive(batch: Batch, totals: pa.Table, suffix: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Total counts of each token, of the token before it (as a context), and of the pair."""
    totals = totals.sort_by("bucket")
    words = np.concatenate([_read_counts(x) for x in totals.column(f"words{suffix}").to_pylist()])[batch.word]
    pairs = np.concatenate([_read_counts(x) for x in totals.column(f"pairs{suffix}").to_pylist()])[batch.pair]
    context = np.empty_like(words)
    context[1:] = words[:-1]
    # A text begins as often as one ends, and each document's last token is its end.
    context[batch.starts] = words[batch.starts[0] + batch.sizes[0] - 1]
    return words, context, pairs


def level(context: np.ndarray) -> np.ndarray:
    """Context-frequency bucket: 0 for an unseen context, then one for each power of two."""
    return np.minimum(np.frexp(context.astype(np.float64))[1], LEVELS - 1)


def estimates(words: np.ndarray, context: np.ndarray, pairs: np.ndarray, tokens: int, types: int) -> np.ndarray:
    """Uniform, unigram and bigram maximum-likelihood estimates of each token, in three rows."""
    return np.array([np.full(len(words), 1 / (types + 1)), words / max(tokens, 1), np.where(context > 0, pairs / np.maximum(context, 1), 0.0)])


def _histogram(tokens: int, types: int):
    def grade(p: np.ndarray, base: float) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return np.where(p > 0, np.round(np.log2(p / base) * GRAIN), -9999).astype(np.int64)

    def count(key: tuple, packed: pa.Table, totals: pa.Table) -> pa.Table:
        names = ["level", "one", "two", "n"]
        if not packed.num_rows:
            return pa.Table.from_arrays([pa.array([], pa.int64())] * 4, names=names)
        batch = Batch(packed)
        words, context, pairs = _receive(batch, totals, "_kept")
        p = estimates(words, context, pairs, tokens, types)
        rows, n = np.unique(np.stack([level(context), grade(p[1], p[0, 0]), grade(p[2], p[0, 0])]), axis=1, return_counts=True)
        return pa.Table.from_arrays([*map(pa.array, rows), pa.array(n)], names=names)

    return count


def mixture_weights(cells: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Weights of uniform, unigram and bigram estimates for each level, by expectation-maximisation.

    cells: rows of level, grades of unigram and bigram (binary logarithms of their ratio to the uniform
    estimate, times GRAIN; -9999 for zero) and how many held-out tokens have them. A little mass on
    each estimate keeps weights positive; a level without held-out tokens keeps the even start.
    """
    weights = np.full((LEVELS, 3), 1 / 3)
    for at in range(LEVELS):
        own = cells[cells[:, 0] == at]
        ratios = np.concatenate([np.zeros((len(own), 1)), own[:, 1:3] / GRAIN], axis=1)
        p, n = np.where(ratios < -2000, 0.0, np.exp2(ratios)), own[:, 3:4].astype(np.float64)
        for _ in range(rounds if len(own) else 0):
            part = weights[at] * p
            part /= part.sum(axis=1, keepdims=True)
            gained = (part * n).sum(axis=0) + 0.01
            weights[at] = gained / gained.sum()
    return weights


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(weights: np.ndarray, tokens: int, types: int):
    def score(key: tuple, packed: pa.Table, totals: pa.Table) -> pa.Table:
        batch, number = Batch(packed), key[0].as_py()
        words, context, pairs = _receive(batch, totals)
        p = (estimates(words, context, pairs, tokens, types) * weights[level(context)].T).sum(axis=0)
        base = (words + 0.1) / (tokens + 0.1 * (types + 1))
        n = len(batch.ids)
        return pa.Table.from_arrays(
            [
                pa.array(batch.ids, pa.int64()),
                pa.array([_kind(number) == TEST] * n),
                pa.array(batch.sizes),
                pa.array(batch.sums((words > 0).astype(np.int64))),
                pa.array([tokens] * n, pa.int64()),
                pa.array(batch.sums(np.log10(base))),
                pa.array(batch.sums(np.log10(p))),
            ],
            names=[x.split()[0] for x in _SCORES.split(", ")],
        )

    return score


def score_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Score whole texts by an interpolated bigram model of the learning folds.

    The model mixes uniform, unigram and bigram estimates; how, depends on the frequency of the
    context. Counts of folds 2 to 9 give the estimates, fold 1 the mixture weights (through a
    histogram of bounded size), then counts of folds 1 to 9 the scores; fold 0 is only scored. A
    null text is empty; a text's end is a token; whole texts are scored, however long, a text in one batch. Without learning documents every token has the
    uniform estimate. Repeated rows are scored each; other columns are not kept. Returns doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score (a smoothed unigram score to compare with) and score, both log10.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    size = total_bytes(rows, "text")
    batches = {kind: max(1, -(-size * share // (10 * batch_bytes))) for kind, share in ((TEST, 1), (HELD_OUT, 1), (COUNTED, 8))}
    bits = max(3, (size // BUCKET_BYTES).bit_length())
    dealt = deal(rows, batches)
    sent = dealt.groupBy("batch").applyInArrow(_send(bits), "bucket long, batch long, words binary, word_n binary, pairs binary, pair_n binary")
    totals = cut(sent.groupBy("bucket").applyInArrow(_total, _TOTALS))
    stats = totals.agg(*[F.sum(c).alias(c) for c in ("tokens", "tokens_kept", "types", "types_kept")]).first()
    tokens, tokens_kept, types, types_kept = (int(stats[c] or 0) for c in ("tokens", "tokens_kept", "types", "types_kept"))
    held_out = totals.where(F.shiftright("batch", 40) == HELD_OUT).select("batch", "bucket", "words_kept", "pairs_kept")
    cells = (
        dealt.where(F.shiftright("batch", 40) == HELD_OUT)
        .groupBy("batch")
        .cogroup(held_out.groupBy("batch"))
        .applyInArrow(_histogram(tokens_kept, types_kept), "level long, one long, two long, n long")
        .groupBy("level", "one", "two")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    weights = mixture_weights(cells[["level", "one", "two", "n"]].to_numpy(np.int64))
    answers = totals.select("batch", "bucket", "words", "pairs")
    return dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_score(weights, tokens, types), _SCORES)


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
