"""Token ids of a corpus in compact binary files: static range asymmetric numeral systems in interleaved blocks."""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import cut, shared_folder
from lodestone.session import table

U32, U64 = np.uint32, np.uint64
#: A block is BLOCK ids dealt to LANES coders in turn; a segment is the blocks that share one frequency table, about SEGMENT ids.
LANES, BLOCK, SEGMENT = 32, 1 << 15, 1 << 21
#: Coder states are in [2^31, 2^63) and move in words of 32 bits.
LOW, WORD = U64(1 << 31), U64(32)
MAGIC = b"LTF1"
#: Length of the record, part, number in the part, ids, documents, symbols, bits of the table, blocks, bytes of the packed lists.
HEAD = struct.Struct("<4sQQQQIIBII")
#: Segments in a file, which a reader takes whole.
SEGMENTS_PER_FILE = 4
#: Words that a worker remembers the ids of (some 200 MB; twice as many with older ones), and the longest of them.
REMEMBERED, LONGEST_PART = 1_000_000, 48

#: All that some library may take for white space, before a space; there a text is not cut.
_SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{2060}\x{3000}\x{feff}"
_CUT = re.compile("(?<![" + re.sub(r"x\{(\w+)\}", lambda m: f"u{int(m[1], 16):04x}", _SPACE) + "]) ")
# Words of letters of Latin-1, marks and single line ends between them: always split where these meet.
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(f" ?[{_LETTER}][{_LETTER}.,;:!?\n]*")
_PART = re.compile(f" ?[{_LETTER}]+|[.,;:!?]+|\n")
#: Bytes of texts that are looked up together.
SLICE = 8_000_000

# ---- text to ids ------------------------------------------------------------------------------------------


class Encoder:
    """Ids of texts by a tokenizer of the tokenizers library, given as its JSON.

    A byte-level tokenizer that splits texts by the usual pattern before it looks at anything else (no
    normaliser, prefix space, or added token with spaces) always splits before a space behind a visible character, so
    a text has the ids of its words in turn; each word of a batch is looked up once. Any other tokenizer gets whole texts.
    """

    def __init__(self, tokenizer: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task for each core already
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(tokenizer)
        setup = json.loads(tokenizer)
        before = setup.get("pre_tokenizer") or {}
        self.by_word = (
            before.get("type") == "ByteLevel"
            and before.get("use_regex", True)
            and not before.get("add_prefix_space", True)
            and not setup.get("normalizer")
            and not setup.get("truncation")
            and not setup.get("padding")
            and setup["model"].get("type", "BPE") == "BPE"
            and not setup["model"].get("dropout")
            and not any(" " in t["content"] or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in setup.get("added_tokens", []))
        )
        self.remembered = remembered
        #: Ids of words and parts seen, each with the space before it if it has one: now, and before there were too many.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, U32).tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, parts: set[str]) -> dict[str, bytes]:
        """The ids of each of parts; they are known from now on, unless they are too long to remember."""
        known, older = self.known, self.older
        found = {x: ids for x in parts if (ids := known.get(x) or older.get(x)) is not None}
        new = [x for x in parts if x not in found]
        found.update(zip(new, self._plain(new), strict=True))
        if len(known) > self.remembered:
            self.older, self.known = known, {}
        self.known.update((x, ids) for x, ids in found.items() if len(x) <= LONGEST_PART)
        return found

    def _look_up(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words, new ones by way of their parts."""
        found = list(map(self.known.get, words))
        gaps = [i for i, ids in enumerate(found) if ids is None]
        parts = [_PART.findall(w) if _PLAIN.fullmatch(w) and "\n\n" not in w else [w] for w in map(words.__getitem__, gaps)]
        learnt = self._learn(set().union(*parts))
        for i, p in zip(gaps, parts, strict=True):
            found[i] = learnt[p[0]] if len(p) == 1 else b"".join([learnt[x] for x in p])
        return found

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each has."""
        if not self.by_word or not len(texts):
            found = self._plain(texts.to_pylist())
            return np.frombuffer(b"".join(found), U32), np.array([len(f) // 4 for f in found], np.int64)
        odd = pc.match_substring_regex(texts, f"[{_SPACE}] ").to_numpy(zero_copy_only=False)
        rows = [np.flatnonzero(~odd), np.flatnonzero(odd)]
        cut = [pc.split_pattern(texts.take(rows[0]), " "), pa.array([_CUT.split(t) for t in texts.take(rows[1]).to_pylist()], pa.list_(pa.string()))]
        sizes = np.concatenate([pc.list_value_length(c).to_numpy() for c in cut])
        words = pa.concat_arrays([c.flatten() for c in cut]).dictionary_encode()
        code = words.indices.to_numpy().copy()
        spelled = pc.binary_join_element_wise(" ", words.dictionary, "").to_numpy(zero_copy_only=False).tolist()
        begins = np.cumsum(sizes) - sizes
        heads: dict[int, int] = {}
        code[begins] = [heads.setdefault(c, len(spelled) + len(heads)) for c in code[begins].tolist()]
        ids = self._look_up([*spelled, *[spelled[c][1:] for c in heads]])
        counts = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        pool, starts, taken = np.frombuffer(b"".join(ids), U32), np.cumsum(counts) - counts, counts[code]
        ends = np.cumsum(taken)
        found = pool[np.repeat(starts[code] - ends + taken, taken) + np.arange(int(ends[-1]))]
        lengths = np.add.reduceat(taken, begins)
        if not len(rows[1]):
            return found, lengths
        # Back to the order of the texts.
        at, places = np.cumsum(lengths) - lengths, np.concatenate(rows)
        order = np.argsort(places)
        return np.concatenate([found[at[i] : at[i] + lengths[i]] for i in order]), lengths[order]


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(tokenizer: str) -> Encoder:
    """The worker's encoder, which later tasks of the worker find with all it has learnt."""
    if tokenizer not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[tokenizer] = Encoder(tokenizer)
    return _ENCODERS[tokenizer]


# ---- ids to bytes and back --------------------------------------------------------------------------------


def frequencies(counts: np.ndarray) -> tuple[np.ndarray, int]:
    """Counts scaled to sum to a power of two, each at least 1, and that power."""
    bits = min(22, max(12, int(len(counts) - 1).bit_length() + 4))
    whole = 1 << bits
    scaled = np.maximum(1, counts.astype(np.int64) * whole // int(counts.sum()))
    spare = whole - int(scaled.sum())
    if spare > 0:
        scaled[np.argmax(scaled)] += spare
    for i in np.argsort(-scaled, kind="stable") if spare < 0 else ():
        taken = min(-spare, int(scaled[i]) // 2)
        scaled[i] -= taken
        spare += taken
        if spare == 0:
            break
    return scaled.astype(U64), bits


def _starts(freq: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, U64), np.cumsum(freq)[:-1].astype(U64)])


def encode_blocks(symbols: np.ndarray, freq: np.ndarray, bits: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Final states (blocks, lanes) and the words of each block, in the order in which a decoder takes them.

    symbols: places in the table, shape (blocks, steps, lanes). All lanes of all blocks move together, last id first.
    """
    blocks, steps, lanes = symbols.shape
    start, power, bound = _starts(freq), U64(bits), U64(63 - bits)
    state = np.full((blocks, lanes), LOW, U64)
    words, full = np.empty((steps, blocks, lanes), U32), np.empty((steps, blocks, lanes), bool)
    for t in range(steps - 1, -1, -1):
        at = symbols[:, t]
        f = freq[at]
        full[t] = out = state >= f << bound
        words[t] = state & U64(0xFFFFFFFF)
        state = np.where(out, state >> WORD, state)
        quotient = state // f
        state = (quotient << power) + (state - quotient * f) + start[at]
    return state, [words[:, b][full[:, b]] for b in range(blocks)]


def decode_blocks(states: np.ndarray, words: list[np.ndarray], freq: np.ndarray, bits: int, steps: int) -> np.ndarray:
    """The symbols (blocks, steps, lanes) of blocks, any of a segment's: what encode_blocks got."""
    blocks, lanes = states.shape
    start, power, mask = _starts(freq), U64(bits), U64((1 << bits) - 1)
    slots = np.repeat(np.arange(len(freq), dtype=np.int32), freq.astype(np.int64))
    stream = np.concatenate([*words, np.zeros(1, U32)]).astype(U64)
    place = np.cumsum([0, *map(len, words)])[:-1, None]
    state, symbols = states.copy(), np.empty((blocks, steps, lanes), np.int32)
    for t in range(steps):
        low = state & mask
        symbols[:, t] = at = slots[low]
        state = freq[at] * (state >> power) + low - start[at]
        more = state < LOW
        taken = np.cumsum(more, axis=1)
        word = stream[np.where(more, place + taken - 1, len(stream) - 1)]
        state = np.where(more, (state << WORD) | word, state)
        place = place + taken[:, -1:]
    return symbols


def pack_segment(ids: np.ndarray, doc_ids: list[int | None], lengths: Sequence[int], part: int, number: int) -> bytes:
    """One segment: a header, its packed lists (documents, table), a checkpoint and a checksum for each block, the blocks' words.

    A checkpoint is a block's coder states and where its words begin; with the table it decodes the block alone.
    """
    symbols, at, counts = _table(ids)
    freq, bits = frequencies(counts) if len(symbols) else (np.zeros(0, U64), 12)
    whole = len(at) // BLOCK * BLOCK
    states, words = [], []
    for piece in (at[:whole].reshape(-1, BLOCK // LANES, LANES), _padded(at[whole:])):
        if piece.size:
            s, w = encode_blocks(piece, freq, bits)
            states.append(s)
            words += w
    checks = np.array([zlib.crc32(w.tobytes(), zlib.crc32(s.tobytes())) for s, w in zip((s for piece in states for s in piece), words, strict=True)], U32)
    sizes = np.array([len(w) for w in words], U32)
    lists = zlib.compress(
        b"".join(
            [
                np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
                np.array([d is not None for d in doc_ids], np.uint8).tobytes(),
                np.array(lengths, "<i8").tobytes(),
                np.diff(symbols.astype("<i8"), prepend=0).astype("<u4").tobytes(),
                freq.astype("<u4").tobytes(),
                sizes.tobytes(),
                checks.tobytes(),
            ]
        ),
        1,
    )
    body = b"".join([lists, *[s.tobytes() for s in states], *[w.tobytes() for w in words]])
    length = HEAD.size + len(body) + 4
    head = HEAD.pack(MAGIC, length, part, number, len(ids), len(doc_ids), len(symbols), bits, len(words), len(lists))
    return head + body + struct.pack("<I", zlib.crc32(lists, zlib.crc32(head)))


def _table(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ids in order, the place of each id among them, and how often each occurs."""
    if len(ids) and int(ids.max()) >= 1 << 22:
        symbols, at, counts = np.unique(ids, return_inverse=True, return_counts=True)
        return symbols, at.astype(np.int32).reshape(-1), counts
    times = np.bincount(ids.astype(np.int32))
    symbols = np.flatnonzero(times)
    place = np.zeros(len(times), np.int32)
    place[symbols] = np.arange(len(symbols), dtype=np.int32)
    return symbols.astype(U32), place[ids], times[symbols]


def _padded(rest: np.ndarray) -> np.ndarray:
    """The ids after the last whole block as one short block, filled up with the first symbol."""
    steps = -(-len(rest) // LANES)
    return np.concatenate([rest, np.zeros(steps * LANES - len(rest), np.int32)]).reshape(1, steps, LANES) if steps else np.empty((0, 0, LANES), np.int32)


class Segment:
    """A segment read from bytes; its blocks are decoded when asked for, any of them alone."""

    def __init__(self, data: bytes, at: int = 0):
        magic, self.length, self.part, self.number, self.n, docs, symbols, self.bits, self.blocks, packed = HEAD.unpack_from(data, at)
        if magic != MAGIC:
            raise ValueError(f"no segment at byte {at}")
        if at + self.length > len(data):
            raise ValueError(f"the segment at byte {at} is cut off")
        place = at + HEAD.size
        lists = data[place : place + packed]
        if struct.unpack_from("<I", data, at + self.length - 4)[0] != zlib.crc32(lists, zlib.crc32(data[at:place])):
            raise ValueError(f"the lists of the segment at byte {at} do not have their checksum")
        raw, done = zlib.decompress(lists), 0

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal done
            done += n * np.dtype(kind).itemsize
            return np.frombuffer(raw, kind, n, done - n * np.dtype(kind).itemsize)

        ids, there = take("<i8", docs), take("u1", docs)
        self.doc_ids = [int(d) if ok else None for d, ok in zip(ids, there, strict=True)]
        self.lengths = take("<i8", docs)
        self.symbols = np.cumsum(take("<u4", symbols).astype(np.int64)).astype(U32)
        self.freq = take("<u4", symbols).astype(U64)
        self.sizes, self.checks = take("<u4", self.blocks), take("<u4", self.blocks)
        place += packed
        self.states = np.frombuffer(data, "<u8", self.blocks * LANES, place).reshape(-1, LANES)
        self.words = np.frombuffer(data, "<u4", int(self.sizes.sum()), place + self.states.nbytes)
        self.begins = np.concatenate([[0], np.cumsum(self.sizes, dtype=np.int64)])

    def ids(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids of blocks first to last (not included), all by default; a block with a wrong checksum is an error."""
        last = self.blocks if last is None else min(last, self.blocks)
        whole, out = self.n // BLOCK, []
        for a, b, steps in ((first, min(last, whole), BLOCK // LANES), (max(first, whole), last, -(-(self.n - whole * BLOCK) // LANES))):
            if a < b:
                words = [self.words[self.begins[i] : self.begins[i + 1]] for i in range(a, b)]
                for i, w in zip(range(a, b), words, strict=True):
                    if zlib.crc32(w.tobytes(), zlib.crc32(self.states[i].tobytes())) != self.checks[i]:
                        raise ValueError(f"block {i} of segment {self.part}.{self.number} does not have its checksum")
                out.append(self.symbols[decode_blocks(self.states[a:b], words, self.freq, self.bits, steps)].reshape(-1))
        found = np.concatenate(out) if out else np.empty(0, U32)
        return found[: max(0, min(self.n, last * BLOCK) - first * BLOCK)]


def segments(content: bytes) -> Iterator[Segment]:
    """The segments of one file; each ends in a line end."""
    at = 0
    while at < len(content):
        found = Segment(content, at)
        yield found
        at += found.length + 1


# ---- Spark jobs -------------------------------------------------------------------------------------------


def _write_part(tokenizer: object, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, number = encoder_of(tokenizer.value), TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        doc_ids: list[int | None] = []
        lengths: list[np.ndarray] = []
        held = 0

        def segment() -> pa.RecordBatch:
            nonlocal number, held
            record = pack_segment(np.concatenate(ids), doc_ids, np.concatenate(lengths), part, number)
            number, held = number + 1, 0
            ids.clear(), doc_ids.clear(), lengths.clear()
            return pa.RecordBatch.from_arrays([pa.array([record], pa.binary())], names=["record"])

        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy().astype(np.int64))
            low = 0
            while low < batch.num_rows:
                high = max(low + 1, int(np.searchsorted(sizes, SLICE + (sizes[low - 1] if low else 0), "right")))
                found, counts = encoder(batch.column(1).slice(low, high - low))
                ids.append(np.insert(found, np.cumsum(counts), end_id))
                lengths.append(counts + 1)
                doc_ids += batch.column(0).slice(low, high - low).to_pylist()
                held += len(ids[-1])
                low = high
                if held >= SEGMENT:
                    yield segment()
        if doc_ids:
            yield segment()

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str, text: str = "text", doc_id: str = "doc_id", end_id: int = 0) -> None:
    """Write the ids of all texts under path, documents in ascending doc_id order over the files in order of their names.

    tokenizer: the JSON of a tokenizer of the tokenizers library. Each document's ids are followed by end_id.
    A null text is empty and gives the end alone. Null ids go first; rows of one id go by a hash of
    their text, and rows that repeat both are all written. Other columns are not kept. Text that looks like
    a special token becomes that token, as the library does by default. An empty table gives files without segments.

    Texts are range-partitioned by id and text hash, so that rows of one id may lie in several tasks; each task
    tokenises its texts once and packs them segment by segment, each with a table of its own ids'
    frequencies, so nothing has to be counted over the corpus first and no segment waits for another. The files come
    from Spark's text writer, whose commit protocol copes with lost executors; a segment's bytes are a line to it.
    """
    spark = docs.sparkSession
    chosen = docs.select(F.col(doc_id).cast("long").alias("_doc"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    ordered = chosen.withColumn("_hash", F.xxhash64("_text")).repartitionByRange("_doc", "_hash").sortWithinPartitions("_doc", "_hash")
    records = ordered.select("_doc", "_text").mapInArrow(_write_part(spark.sparkContext.broadcast(tokenizer), end_id), "record binary")
    lines = records.select(F.col("record").cast("string").alias("value"))
    lines.write.mode("overwrite").option("maxRecordsPerFile", SEGMENTS_PER_FILE).option("lineSep", "\n").text(path)


_DOC = pa.schema([("part", pa.int64()), ("number", pa.int64()), ("place", pa.int64()), ("doc_id", pa.int64()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])
DOC_SCHEMA = "part long, number long, place long, doc_id long, before long, n_tokens long, ids_crc32 long, ids binary"


def _read_files(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for s in segments(content.as_py()):
                    ids = s.ids()
                    ends = np.cumsum(s.lengths)
                    pieces = [ids[b - n : b].astype("<u4").tobytes() for n, b in zip(s.lengths, ends, strict=True)]
                    n = len(pieces)
                    columns = [[s.part] * n, [s.number] * n, range(n), s.doc_ids, ends - s.lengths, s.lengths, map(zlib.crc32, pieces), pieces if with_ids else [None] * n]
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _DOC, strict=True)], schema=_DOC)

    return run


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Each document in the files: its segment (part, number), place and ids before it there, n_tokens, ids_crc32 and ids (binary).

    ids are little-endian unsigned 32-bit integers, null unless with_ids. A wrong checksum is an error.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(_read_files(with_ids), DOC_SCHEMA)


def with_starts(read: DataFrame) -> DataFrame:
    """Add start, the ids of all documents before each, by sums over segments, then over groups of parts.

    Sums of a part's segments and of a group's parts are running sums by key; what is ordered in one
    task is one row for each 4,096 parts. read should be cut, as it is read twice.
    """
    from pyspark.sql import Window

    def before(rows: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
        span = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return rows.withColumn(name, F.sum("n").over(span) - F.col("n"))

    sizes = read.groupBy("part", "number").agg(F.sum("n_tokens").alias("n")).withColumn("block", F.shiftright("part", 12))
    numbers = before(sizes, ["block", "part"], "number", "in_part")
    parts = before(sizes.groupBy("block", "part").agg(F.sum("n").alias("n")), ["block"], "part", "in_block")
    blocks = before(sizes.groupBy("block").agg(F.sum("n").alias("n")).withColumn("all", F.lit(0)), ["all"], "block", "in_all")
    offsets = numbers.drop("n").join(parts.drop("n"), ["block", "part"]).join(blocks.drop("n", "all"), "block")
    starts = offsets.select(F.col("part").alias("_part"), F.col("number").alias("_number"), (F.col("in_part") + F.col("in_block") + F.col("in_all")).alias("_offset"))
    joined = read.join(starts, (F.col("part") == F.col("_part")) & (F.col("number") == F.col("_number")))
    return joined.withColumn("start", F.col("_offset") + F.col("before")).drop("_part", "_number", "_offset")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), path, Path(public_tokenizers.path("byte_bpe_50k.json")).read_text(encoding="utf-8"))
    read = cut(read_token_files(spark, path, with_ids=False).drop("ids"))
    return with_starts(read).select("doc_id", "start", "n_tokens", "ids_crc32")
