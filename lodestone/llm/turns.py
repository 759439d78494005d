"""Repair of conversation structure: cheapest edits by Dijkstra's search on the lattice of turn index and grammar state."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import BLANKS, cut, unplaced
from lodestone.session import table

#: Grammar states of (s?(ua)+)?: nothing yet, after system, after user, after assistant; where a conversation may end.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (NOTHING, ASSISTANT)
#: The role that may come next, by state, and the state it leads to. A system turn may come first.
NEXT_ROLE = ("user", "user", "assistant", "user")
NEXT_STATE = (USER, USER, ASSISTANT, USER)
#: Costs of edits, and what an undeleted truncated turn adds.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Turns that are searched at a time; longer conversations are searched block by block.
BLOCK = 256
BLANK, DUPLICATE, CUT_OFF = 1, 2, 3


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text with faults planted by crc32("conv_id:turn") % 20; nulls in role, text and the key are one space.

    0 drops the row, 1 empties its text, 2 removes its . ! and ?, 3 repeats it, 4 makes it a user's.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat_ws(":", spaced("conv_id"), spaced("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), code.alias("_code")).where("_code <> 0")
    text = F.when(F.col("_code") == 1, "").when(F.col("_code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_code") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("_code") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("_copy")).drop("_copy")


def _order(turn: Column) -> Column:
    """A turn as a value whose order puts null first."""
    return F.struct(turn.isNotNull().alias("there"), turn.alias("turn"))


# ---- the search -------------------------------------------------------------------------------------------


def _moves(place: int, state: int, initials: str, faults: list[int], end: bool) -> Iterator[tuple[int, str, int, int]]:
    """Cost, letter, place and state of each edit at a node of the lattice; end: insertions after the last turn too."""
    last = place == len(faults)
    if end or not last:
        yield INSERT, "I", place, NEXT_STATE[state]
    if last:
        return
    fault, first = faults[place], initials[place]
    yield DELETE, "D", place + 1, state
    if fault in (BLANK, DUPLICATE):
        return
    more = TRUNCATED if fault == CUT_OFF else 0
    yield REROLE + more, "R", place + 1, NEXT_STATE[state]
    if first == NEXT_ROLE[state][0]:
        yield more, "K", place + 1, NEXT_STATE[state]
    if first == "s" and state == NOTHING:
        yield more, "K", place + 1, SYSTEM


def search(initials: str, faults: list[int], state: int = NOTHING, end: bool = True) -> dict[int, tuple[int, str]]:
    """Cheapest (cost, audit) from a state before the turns to states after them, ties to the least audit.

    initials: a character for each turn (a space for none). With end, the search stops at the first
    popped end node that accepts. Without, it goes on to every state right after the last turn, with no insertion behind
    it. Audits of equal cost to one node are never prefixes of each other: they take the same turns, so
    the longer would only have more insertions, which cost. So the lesser stays less whatever follows.
    """
    heap: list[tuple[int, str, int, int]] = [(0, "", 0, state)]
    done: set[tuple[int, int]] = set()
    found: dict[int, tuple[int, str]] = {}
    while heap:
        cost, audit, place, at = heapq.heappop(heap)
        if (place, at) in done:
            continue
        done.add((place, at))
        if place == len(faults) and (not end or at in ENDS):
            found[at] = (cost, audit)
            if end:
                break
        for more, letter, p, s in _moves(place, at, initials, faults, end):
            if (p, s) not in done:
                heapq.heappush(heap, (cost + more, audit + letter, p, s))
    return found


def join_blocks(blocks: list[dict[int, dict[int, tuple[int, str]]]]) -> tuple[int, list[tuple[int, str]]]:
    """Cost of a conversation, and the state before and the audit of each of its blocks; a last block holds the closing insertions.

    blocks: what search() without end found, by first and last state. States after a block are settled
    block by block. An audit up to there ends in the letter of a turn, so none is a prefix of another and their ranks
    stand for them in ties: no audit is ever spelled out before the end.
    """
    best: dict[int, tuple[int, int]] = {NOTHING: (0, 0)}  # cost and rank by audit
    back: list[dict[int, tuple[int, str]]] = []
    closing = {s: search("", [], s) for s in range(4)}
    for k, block in enumerate([*blocks, closing]):
        offers: dict[int, tuple[int, int, str, int]] = {}
        for s, (cost, rank) in best.items():
            for e, (more, audit) in block.get(s, {}).items():
                offer = (cost + more, rank, audit, s)
                offers[e] = min(offers.get(e, offer), offer)
        if k == len(blocks):
            offers = {0: min(offers.values())}  # the first accepting end in the order of (cost, audit)
        ranks = {x: r for r, x in enumerate(sorted({o[1:3] for o in offers.values()}))}
        best = {e: (o[0], ranks[o[1:3]]) for e, o in offers.items()}
        back.append({e: (o[3], o[2]) for e, o in offers.items()})
    path, at = [], 0
    for step in reversed(back):
        path.append(step[at])
        at = step[at][0]
    return best[0][0], path[::-1]


def apply_audit(state: int, audit: str, roles: list[str], texts: list[str]) -> list[tuple[str, str]]:
    """The turns that edits make of a block that begins in a state."""
    out, place = [], 0
    for letter in audit:
        if letter == "I":
            out.append((NEXT_ROLE[state], ""))
        elif letter == "R":
            out.append((NEXT_ROLE[state], texts[place]))
        elif letter == "K":
            out.append((roles[place], texts[place]))
        if letter == "K" and state == NOTHING and roles[place][0] == "s":
            state = SYSTEM
        elif letter != "D":
            state = NEXT_STATE[state]
        place += letter != "I"
    return out


# ---- Spark jobs -------------------------------------------------------------------------------------------

_TURN = pa.struct([("role", pa.string()), ("text", pa.string())])
_LONGS = ["place", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_EDITS = pa.schema([("conv_id", pa.int64()), *[(n, pa.int64()) for n in _LONGS], ("audit", pa.string()), ("turns", pa.list_(_TURN))])
_BLOCKS = pa.schema(
    [*_EDITS, ("open", pa.bool_()), ("size", pa.int64()), ("turn_first", pa.int64()), ("turn_last", pa.int64()), ("turn_min", pa.int64()), ("turn_max", pa.int64()), ("turn_distinct", pa.int64()),
     ("initials", pa.string()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))]
)
EDIT_SCHEMA = "conv_id long, " + ", ".join(f"{n} long" for n in _LONGS) + ", audit string, turns array<struct<role: string, text: string>>"
BLOCK_SCHEMA = EDIT_SCHEMA + ", open boolean, size long, turn_first long, turn_last long, turn_min long, turn_max long, turn_distinct long, initials string, costs array<long>, audits array<string>"
_LEGAL = {"su", "ua", "au"}


def _block(conv_id: int | None, place: int, rows: list[tuple], whole: bool) -> dict:
    """What a block of (turn, role, text, fault) rows gives; a whole conversation is settled here."""
    turns = [r[0] for r in rows if r[0] is not None]
    initials = "".join(r[1][:1] or " " for r in rows)
    faults = [r[3] for r in rows]
    found = {
        "conv_id": conv_id, "place": place, "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(CUT_OFF),
        "illegal": sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:], strict=False)), "gaps": 0, "cost": 0, "audit": None,
        "turn_first": rows[0][0], "turn_last": rows[-1][0], "turn_min": min(turns, default=None), "turn_max": max(turns, default=None), "turn_distinct": len(set(turns)),
        "size": len(rows), "initials": initials[0] + initials[-1], "open": not whole, "costs": None, "audits": None,
    }
    if whole:
        ((found["cost"], found["audit"]),) = search(initials, faults).values()
        found["gaps"] = found["turn_max"] - found["turn_min"] + 1 - found["turn_distinct"] if turns else 0
        kept = apply_audit(NOTHING, found["audit"], [r[1] for r in rows], [r[2] for r in rows])
    else:
        ends = [search(initials, faults, s, end=False) for s in range(4)]
        pairs = [ends[s].get(e, (None, None)) for s in range(4) for e in range(4)]
        found["costs"], found["audits"] = [p[0] for p in pairs], [p[1] for p in pairs]
        kept = [(r[1], r[2]) for r in rows]
    return found | {"turns": [{"role": r, "text": t} for r, t in kept]}


def _find_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a partition of sorted rows. A conversation that may go on in another partition stays open."""
    place = TaskContext.get().partitionId() << 40
    rows: list[tuple] = []
    conv: tuple = ()
    split = True  # the partition's first conversation may have begun before
    before: tuple = ()
    out: list[dict] = []

    def close(whole: bool) -> None:
        nonlocal rows, place
        if rows:
            out.append(_block(conv[0], place, rows, whole))
            place += 1
        rows = []

    def sent() -> pa.RecordBatch:
        nonlocal out
        batch, out = pa.RecordBatch.from_pylist(out, _BLOCKS), []
        return batch

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:1] != conv:
                close(not split)
                split = conv == ()
                conv = row[:1]
            elif len(rows) == BLOCK:
                split = True
                close(False)
            turn, role, text, fault = row[1:]
            if row[:4] == before and fault != BLANK:
                fault = DUPLICATE
            before = row[:4]
            rows.append((turn, role, text, fault))
            if len(out) >= 500:
                yield sent()
    close(False)
    if out:
        yield sent()


def _join_group(group: pa.Table) -> pa.Table:
    """Edits of the blocks of one conversation, in the order of place; its gaps and cost stand at the first."""
    rows = sorted(group.to_pylist(), key=lambda r: r["place"])
    blocks = []
    for r in rows:
        pairs = [None if c is None else (c, a) for c, a in zip(r["costs"], r["audits"], strict=True)]
        blocks.append({s: {e: pairs[4 * s + e] for e in range(4) if pairs[4 * s + e]} for s in range(4)})
    cost, path = join_blocks(blocks)
    seen = [r for r in rows if r["turn_min"] is not None]
    distinct = sum(r["turn_distinct"] for r in seen) - sum(a["turn_last"] is not None and a["turn_last"] == b["turn_first"] for a, b in zip(rows, rows[1:], strict=False))
    gaps = max(r["turn_max"] for r in seen) - min(r["turn_min"] for r in seen) + 1 - distinct if seen else 0
    out = []
    for k, (r, (state, audit)) in enumerate(zip(rows, path, strict=False)):
        border = k > 0 and rows[k - 1]["initials"][1] + r["initials"][0] not in _LEGAL
        out.append({"_place": r["place"], "_state": state, "_audit": audit + (path[-1][1] if k == len(rows) - 1 else ""), "_gaps": 0 if k else gaps, "_cost": 0 if k else cost, "_border": int(border)})
    return pa.Table.from_pylist(out, pa.schema([("_place", pa.int64()), ("_state", pa.int64()), ("_audit", pa.string()), ("_gaps", pa.int64()), ("_cost", pa.int64()), ("_border", pa.int64())]))


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        for r in rows:
            kept = apply_audit(r.pop("_state"), r["audit"], [t["role"] for t in r["turns"]], [t["text"] for t in r["turns"]])
            r["turns"] = [{"role": role, "text": text} for role, text in kept]
        yield pa.RecordBatch.from_pylist(rows, _EDITS)


def repair_blocks(conversations: DataFrame) -> DataFrame:
    """Edits by block of turns: conv_id, place (blocks of a conversation in order), counts, cost, audit and the repaired turns.

    Rows go by turn, nulls first, ties by role and text. A null role or text is one space; other
    columns are not kept. Counts are a block's share: they sum to those of the conversation. Rows that repeat role
    and text of an earlier turn are found by a minimum by hash, so a row that a third of all repeat is one row after it.
    Rows are range-partitioned by conversation and turn; a conversation inside one partition and
    no longer than a block is settled there by one search. Of others every block is searched from each
    state, and a group by conversation joins what was found: a few short strings for each block, no texts.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), spaced("role").alias("role"), spaced("text").alias("text"))
    # Hashes stand for (conversation, role, text).
    whose = [F.coalesce(F.col("conv_id"), F.lit(0)), F.col("conv_id").isNull(), F.col("role"), F.col("text")]
    rows = rows.withColumns({"_k1": F.xxhash64(*whose), "_k2": F.xxhash64(F.lit("second"), *whose)})
    order = _order(F.col("turn"))
    firsts = rows.groupBy("_k1", "_k2").agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    firsts = firsts.select(unplaced(F.col("_k1")).alias("_f1"), F.col("_k2").alias("_f2"), "_first")
    marked = rows.join(firsts, (F.col("_k1") == F.col("_f1")) & (F.col("_k2") == F.col("_f2")), "left")
    bare = F.btrim("text", F.lit(BLANKS))
    fault = F.when(bare == "", BLANK).when(F.col("_first") < order, DUPLICATE).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), CUT_OFF).otherwise(0)
    ready = marked.select("conv_id", "turn", "role", "text", fault.alias("fault"))
    # Equal rows lie in one partition, next to each other.
    ranged = ready.repartitionByRange("conv_id", "turn", "role", F.left("text", F.lit(40))).sortWithinPartitions("conv_id", "turn", "role", "text")
    blocks = cut(ranged.mapInArrow(_find_blocks, BLOCK_SCHEMA))
    names = [f.name for f in _EDITS]
    unsettled = blocks.where("open")
    summary = unsettled.select("conv_id", "place", "turn_first", "turn_last", "turn_min", "turn_max", "turn_distinct", "initials", "costs", "audits")
    joined = summary.groupBy("conv_id").applyInArrow(_join_group, "_place long, _state long, _audit string, _gaps long, _cost long, _border long")
    chosen = unsettled.join(joined, F.col("place") == F.col("_place")).withColumns({"audit": F.col("_audit"), "gaps": F.col("_gaps"), "cost": F.col("_cost"), "illegal": F.col("illegal") + F.col("_border")})
    return blocks.where("NOT open").select(*names).unionByName(chosen.select(*names, "_state").mapInArrow(_apply, EDIT_SCHEMA))


def repaired_turns(edits: DataFrame) -> DataFrame:
    """The repaired conversations as rows: conv_id, place and number (their order), role, text."""
    return edits.select("conv_id", "place", F.posexplode("turns").alias("number", "_turn")).select("conv_id", "place", "number", "_turn.role", "_turn.text")


def repair(conversations: DataFrame, ids: DataFrame) -> DataFrame:
    """One row for each conv_id of ids: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired (its turns as role:text lines).

    conversations: conv_id, turn, role, text as in repair_blocks. An id without rows has zeros and empty
    strings; rows without conv_id are one conversation. Only a conversation's edits and its result, which is one
    row by its nature, are gathered by conversation.
    """
    edits = repair_blocks(conversations)
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    own = edits.select("conv_id", *_LONGS, "audit", F.when(F.size("turns") > 0, lines).alias("lines"))
    none = ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    for name in own.columns[1:]:
        none = none.withColumn(name, F.lit(None if name in ("audit", "lines") else 0).cast(own.schema[name].dataType))
    pieces = lambda c: F.transform(F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("place", c)))), lambda p: p[c])
    sums = [F.sum(n).alias(n) for n in _LONGS[1:]]
    return own.unionByName(none).groupBy("conv_id").agg(*sums, F.array_join(pieces("audit"), "").alias("audit"), F.array_join(pieces("lines"), "\n").alias("repaired"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    found = repair(damage(conversations), conversations)
    return found.withColumn("repaired_sha256", F.sha2("repaired", 256)).drop("repaired")


def _sql() -> str:
    """The repair in SQL: a dynamic programme over turns. k0, ks, ku, ka are the cheapest (cost, audit, text) by state."""

    def edit(state: str, cost: str, letter: str, line: str) -> str:
        return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {state}.t || {line}}} END"

    def insert(state: str, role: str) -> str:
        return edit(state, "2", "I", f"chr(10) || '{role}:'")

    def turn(state: str, role: str) -> str:
        own = f"chr(10) || '{role}:' || text"
        reroled = f"CASE WHEN fault NOT IN (1, 2) THEN {edit(state, '2 + more', 'R', own)} END"
        kept = f"CASE WHEN fault NOT IN (1, 2) AND left(role, 1) = '{role[0]}' THEN {edit(state, 'more', 'K', 'chr(10) || role || chr(58) || text')} END"
        return f"{reroled}, {kept}"

    def deleted(state: str) -> str:
        return edit(state, "3", "D", "''")

    system = "CASE WHEN fault NOT IN (1, 2) AND left(role, 1) = 's' THEN " + edit("k0", "more", "K", "chr(10) || role || chr(58) || text") + " END"
    return f"""
WITH RECURSIVE damaged AS (
  SELECT conv_id, turn, CASE code WHEN 4 THEN 'user' ELSE role END AS role,
         CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE code WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           xor(list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda ch: ascii(ch)::BIGINT),
               lambda crc, b: list_reduce(range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(crc, b)), 4294967295::BIGINT), 4294967295::BIGINT) % 20 AS code
    FROM conversations) WHERE code <> 0
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, trim(text, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)) AS bare FROM damaged
), turns AS (
  SELECT *, (fault = 3)::INT AS more FROM (
    SELECT *, CASE WHEN bare = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
                   WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
           lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair
    FROM numbered)
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate,
         count(*) FILTER (WHERE fault = 3) AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM turns GROUP BY conv_id
), walk AS (
  SELECT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': '', 't': ''}} AS k0, NULL::STRUCT(c INT, a VARCHAR, t VARCHAR) AS ks, {{'c': 2, 'a': 'I', 't': chr(10) || 'user:'}} AS ku,
         {{'c': 4, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS ka
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, k0, ks, u AS ku, least(a, {insert("u", "assistant")}) AS ka FROM (
    SELECT conv_id, i, k0, ks, a, least(u, {insert("k0", "user")}, {insert("ks", "user")}, {insert("a", "user")}) AS u FROM (
      SELECT w.conv_id, w.i + 1 AS i, {deleted("k0")} AS k0, least({deleted("ks")}, {system}) AS ks,
             least({deleted("ku")}, {turn("k0", "user")}, {turn("ks", "user")}, {turn("ka", "user")}) AS u,
             least({deleted("ka")}, {turn("ku", "assistant")}) AS a
      FROM walk w JOIN turns t ON w.conv_id IS NOT DISTINCT FROM t.conv_id AND t.i = w.i + 1))
)
SELECT w.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, least(k0, ka).c::BIGINT AS cost, least(k0, ka).a AS audit, sha256(substr(least(k0, ka).t, 2)) AS repaired_sha256
FROM walk w LEFT JOIN counts c ON w.conv_id IS NOT DISTINCT FROM c.conv_id WHERE w.i = coalesce(c.n, 0)
"""


OP12_SQL = _sql()
