"""Token files, repair of conversation structure and ranked lexical search."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import duck
from tokenizers import Tokenizer

from lodestone.llm import lexical, token_files, turns

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
JSON = Path(VOCABULARY).read_text(encoding="utf-8")
PLAIN = Tokenizer.from_file(VOCABULARY)


# ---- token files ------------------------------------------------------------------------------------------


def plain_ids(text: str | None) -> list[int]:
    return PLAIN.encode(text or "", add_special_tokens=False).ids


def token_rows(docs: list[tuple[int, str | None]]) -> list[tuple]:
    out, start = [], 0
    for doc_id, text in docs:
        ids = [*plain_ids(text), 0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_hold_the_librarys_ids_in_order(spark, documents):
    got = [tuple(r) for r in token_files.op11_token_files(spark, SF).orderBy("doc_id").collect()]
    assert got == token_rows(sorted(documents[1]))


def encoded(encoder, texts: list[str]) -> list[list[int]]:
    ids, counts = encoder(pa.array(texts, pa.string()))
    assert len(ids) == counts.sum()
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


ENCODER = token_files.Encoder(JSON, remembered=20)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet="ab1 .'\n\t\xa0 \u200b\x1c\x85é漢🙂|<>?endoftx-", max_size=40), max_size=4))
def test_ids_by_word_are_those_of_whole_texts(texts):
    texts = [*texts, " ".join(texts), "<|endoftext|> a  b \n c<|endoftext|>", "x.\n\ny?!z it's\nA"]
    assert encoded(ENCODER, texts) == [plain_ids(t) for t in texts]


def test_other_tokenizers_get_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, plain = token_files.Encoder(Path(path).read_text(encoding="utf-8")), Tokenizer.from_file(path)
    assert not encoder.by_word and ENCODER.by_word
    texts = ["Some  Words here", "", "x y"]
    assert encoded(encoder, texts) == [plain.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize(("n", "distinct"), [(0, 1), (1, 1), (5, 3), (70_000, 1), (40_000, 40_000), (100_000, 700), (token_files.BLOCK * 2, 9)])
def test_segments_round_trip(n, distinct):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % distinct * 7919 % (1 << 31)).astype(np.uint32)
    lengths = [n // 3, n - n // 3] if n else []
    data = token_files.pack_segment(ids, [5, None][: len(lengths)], lengths, 3, 4)
    back = token_files.Segment(data)
    assert (back.ids() == ids).all() and back.lengths.tolist() == lengths and back.doc_ids == [5, None][: len(lengths)] and (back.part, back.number) == (3, 4)
    for first in range(back.blocks):  # each block alone
        assert (back.ids(first, first + 1) == ids[first * token_files.BLOCK : (first + 1) * token_files.BLOCK]).all()
    if n == 100_000:
        counts = Counter(ids.tolist())
        entropy = -sum(c * np.log2(c / n) for c in counts.values()) / 8
        assert len(data) < 1.1 * entropy + 16_000


def test_damaged_segments_are_errors():
    ids = np.arange(90_000, dtype=np.uint32) % 1000
    data = bytearray(token_files.pack_segment(ids, [1], [90_000], 0, 0))
    for place in (30, 200, len(data) - 3):
        bad = bytearray(data)
        bad[place] ^= 1
        with pytest.raises(ValueError, match="checksum|cut off"):
            token_files.Segment(bytes(bad)).ids()
    with pytest.raises(ValueError, match="cut off"):
        token_files.Segment(bytes(data[:-9]))
    bad = bytearray(data)
    bad[-100] ^= 1  # in the last block; the others can still be read
    assert (token_files.Segment(bytes(bad)).ids(0, 1) == ids[: token_files.BLOCK]).all()


def test_token_files_of_odd_rows(spark, odd, tmp_path):
    token_files.write_token_files(odd, str(tmp_path / "a"), JSON)
    rows = token_files.with_starts(token_files.read_token_files(spark, str(tmp_path / "a"))).orderBy("start").collect()
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in rows) == Counter((r["doc_id"], np.array([*plain_ids(r["text"]), 0], "<u4").tobytes()) for r in odd.collect())
    ids = [r["doc_id"] for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i)) and [r["start"] for r in rows] == [0, *np.cumsum([r["n_tokens"] for r in rows])[:-1]]
    token_files.write_token_files(odd.where("false"), str(tmp_path / "b"), JSON)
    assert token_files.with_starts(token_files.read_token_files(spark, str(tmp_path / "b"))).count() == 0


def test_starts_over_many_segments(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(token_files, "SEGMENTS_PER_FILE", 1)
    docs = [(i, f"text number {i} " * (i % 5)) for i in range(300)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    token_files.write_token_files(frame, str(tmp_path / "c"), JSON)
    rows = token_files.with_starts(token_files.read_token_files(spark, str(tmp_path / "c"), with_ids=False)).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("doc_id")
    assert [tuple(r) for r in rows.collect()] == token_rows(docs)


# ---- repair -----------------------------------------------------------------------------------------------

NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
NAME = {"u": "user", "a": "assistant"}


def plain_repair(rows: list[tuple]) -> tuple:
    """gaps, blank, duplicate, truncated, illegal, cost, audit, repaired of (turn, role, text) rows, by a dynamic programme."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda q: (q[0] is not None, q[0] or 0, q[1], q[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
        seen.add((role, text))
    initials = [r[:1] or " " for _, r, _ in rows]
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0

    def insert(best):
        for _ in range(3):
            for state in list(best):
                cost, audit, lines = best[state]
                put(best, NEXT[state], (cost + 2, audit + "I", (*lines, NAME[NEXT[state]] + ":")))
        return best

    def put(best, state, value):
        if state not in best or value[:2] < best[state][:2]:
            best[state] = value

    best = insert({"": (0, "", ())})
    for (_, role, text), fault, first in zip(rows, faults, initials, strict=True):
        after: dict = {}
        for state, (cost, audit, lines) in best.items():
            put(after, state, (cost + 3, audit + "D", lines))
            if fault not in (1, 2):
                more, to = int(fault == 3), NEXT[state]
                put(after, to, (cost + 2 + more, audit + "R", (*lines, f"{NAME[to]}:{text}")))
                if first == to or first == "s" and state == "":
                    put(after, first, (cost + more, audit + "K", (*lines, f"{role}:{text}")))
        best = insert(after)
    cost, audit, lines = min(best[e] for e in ("", "a") if e in best)
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, "\n".join(lines)


def plain_damage(rows: list[tuple]) -> dict:
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        by[conv] += [(turn, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return by


def repaired(df) -> dict:
    return {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired"]) for r in df.collect()}


def test_repair_is_that_of_a_dynamic_programme(spark):
    table = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = {c: plain_repair(rows) for c, rows in plain_damage(table).items()}
    got = {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) for r in turns.op12_repair(spark, SF).collect()}
    assert got == {c: (*w[:-1], hashlib.sha256(w[-1].encode()).hexdigest()) for c, w in want.items()}


TURNS = st.lists(st.tuples(st.sampled_from(["s", "u", "a", "x", " "]), st.sampled_from([0, 0, 0, 1, 2, 3])), max_size=9)


@settings(max_examples=400, deadline=None)
@given(TURNS, st.integers(1, 4))
def test_blocks_give_what_one_search_gives(turn_list, size):
    """The search over all turns, that over joined blocks and the dynamic programme agree in cost and audit."""
    initials, faults = "".join(t[0] for t in turn_list), [t[1] for t in turn_list]
    ((cost, audit),) = turns.search(initials, faults).values()
    pieces = [(initials[i : i + size], faults[i : i + size]) for i in range(0, len(faults), size)]
    joined, path = turns.join_blocks([{s: turns.search(a, b, s, end=False) for s in range(4)} for a, b in pieces])
    assert (joined, "".join(a for _, a in path)) == (cost, audit)
    texts = {0: "fine.", 1: " ", 3: "cut"}
    rows = [(i, {"s": "system", "u": "user", "a": "assistant", "x": "x", " ": " "}[r], texts.get(f, "fine.") + ("" if f == 1 else f"{i}." if f == 0 else str(i))) for i, (r, f) in enumerate(turn_list) if f != 2]
    plain = plain_repair(rows)
    ((cost, audit),) = turns.search("".join(r[1][0] for r in rows), [f for _, f in turn_list if f != 2]).values()
    assert (cost, audit) == plain[5:7]


def odd_turns() -> list[tuple]:
    rows = [(1, i, "user" if i % 3 else "assistant", f"text {i % 50}." if i % 7 else "open") for i in range(900)]  # longer than blocks, over partitions
    rows += [(None, None, None, None), (None, 3, "user", None), (2, None, "user", "a."), (2, None, "user", "a."), (2, 1, "user", "a."), (2, 1, "assistant", "b"), (3, 0, "", ""), (4, 5, "system", "only."), (5, 0, "assistant", "\x1c"), (5, 9, "user", "word " * 50000)]
    rows += [(6, 1, "user", "same."), (6, 1, "user", "same."), (6, 1, "user", "same.")] + [(7, 2, "assistant", "x!")] * 600
    return rows


@pytest.mark.parametrize("block", [turns.BLOCK, 3])
def test_repair_of_odd_conversations(spark, monkeypatch, block):
    monkeypatch.setattr(turns, "BLOCK", block)
    rows = odd_turns()
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, place int, fault string").repartition(5)
    ids = spark.createDataFrame([(c,) for c in {r[0] for r in rows} | {99}], "conv_id long")
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r[1:])
    assert repaired(turns.repair(frame, ids)) == {c: plain_repair(x) for c, x in by.items()} | {99: (0, 0, 0, 0, 0, 0, "", "")}
    assert turns.repair(frame.where("false"), ids.where("false")).count() == 0


def test_repaired_turns_follow_the_grammar(spark):
    frame = spark.createDataFrame(odd_turns(), "conv_id long, turn long, role string, text string")
    by = defaultdict(list)
    for r in turns.repaired_turns(turns.repair_blocks(frame)).orderBy("place", "number").collect():
        by[r["conv_id"]].append(r["role"][0])
    assert all(re.fullmatch("(s?(ua)+)?", "".join(x)) for x in by.values())


# ---- search -----------------------------------------------------------------------------------------------


def plain_search(spark, docs: list[tuple], items: list[tuple]) -> list[tuple]:
    con = duck(SF)
    for name in ("documents", "benchmark"):
        con.execute(f"DROP VIEW IF EXISTS {name}")
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    return sorted(con.execute(f"SELECT item_id, rank, doc_id, score FROM ({lexical.OP13_SQL})").fetchall(), key=repr)


ODD_ITEMS = [(1, "Alpha beta beta gamma-delta"), (2, None), (3, "none of these 12 漢字"), (4, ""), (1, "more of ONE"), (5, "same"), (None, "alpha é")]


def odd_documents() -> list[tuple]:
    words = ["alpha", "BETA", "gamma", "delta", "12", "漢字", "é", "of", "one", "these"]
    docs = [(i * 977 % 100_003, " ".join(words[(i * j) % 10] for j in range(1, 2 + i % 13))) for i in range(500)]
    docs += [(7, "same")] * 15 + [(None, "same same alpha"), (None, None), (8, ""), (9, "\x1c--"), (-40_000, "alpha " * 20_000), (10, "of " * 3)]
    return docs


def test_search_is_that_of_sql_in_any_split(spark, monkeypatch):
    docs, items = odd_documents(), ODD_ITEMS
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, n int, score int").repartition(6)
    asked = spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, rank int")
    want = plain_search(spark, docs, items)
    assert sorted(map(tuple, lexical.search(frame, asked).collect()), key=repr) == want
    monkeypatch.setattr(lexical, "PAIRS", 3)
    blocks = list(lexical.query_blocks(lexical.item_terms(asked), 3))
    assert len(blocks) > 1 and sum(len(b) for b in blocks) == 4
    monkeypatch.setattr(lexical.query_blocks, "__defaults__", (3,))
    assert sorted(map(tuple, lexical.search(frame, asked).collect()), key=repr) == want


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(ODD_ITEMS, "item_id long, text string")
    assert lexical.search(docs, items).count() == 0
    assert lexical.search(spark.createDataFrame([(1, "alpha")], "doc_id long, text string"), items.where("false")).count() == 0
    assert lexical.search(spark.createDataFrame([(1, None), (2, "..")], "doc_id long, text string"), items).count() == 0


def test_full_windows_and_large_sums():
    """More rows of one id than a window has, and a corpus for which 64 bits are too few in between."""
    scorer = lexical.WindowScorer([[(0, 2)]], np.array([1000]), 10**15, 10**16, 3)
    assert scorer.shrink(np.array([10**6])).tolist() == [25 + 75 * 10**6 * 10**15 // 10**16]
    n = lexical.WINDOW
    scorer.window(np.full(n, 5), np.full(n, 3), np.ones(n, int), np.zeros(n, np.int32), np.ones(n, np.int64))
    scorer.window(np.arange(n, n + 4), np.array([3, 1, 3, 9]), np.ones(4, int), np.zeros(4, np.int32), np.ones(4, np.int64))
    best = sorted(scorer.heaps[0], reverse=True)
    assert [-i for _, i in best] == [n + 1, 5, 5] and not scorer.sums.any() and not scorer.taken.any()
