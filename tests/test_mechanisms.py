"""Index joins, as-of joins, decayed windows, hashed vectors, positions of figures, buckets, state of streams: against plain loops, at their edges."""

import datetime as dt
import math
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from lodestone.operators import answers, asof, buckets, decay, figures, names, questions, retrieval, vectors
from lodestone.sources import polled
from lodestone.streaming import counters, events


def rows_of(df) -> list:
    return sorted(map(tuple, df.collect()), key=repr)


# ---- names ------------------------------------------------------------------------------------------------


def plain_mentions(text: str | None, aliases: list[tuple[str, str]]) -> list[tuple]:
    words, out, at = re.findall(r"\w+", (text or "").lower()), [], 0
    index = {}
    for alias, symbol in aliases:
        own = tuple(re.findall(r"\w+", alias.lower()))
        if own:
            index[own] = min(symbol, index.get(own, symbol))
    while at < len(words):
        for n in range(4, 0, -1):
            if (own := tuple(words[at : at + n])) in index and len(own) == n:
                out.append((len(out) + 1, index[own], at, n))
                at += n
                break
        else:
            at += 1
    return out


def test_names_are_those_of_a_plain_search(spark):
    rng = random.Random(4)
    vocabulary = ["acme", "beta", "bank", "of", "the", "steel", "x", "L&T"]
    aliases = [(" ".join(rng.choices(vocabulary, k=rng.randint(1, 2))), f"S{i}") for i in range(60)] + [("", "none"), ("--", "none")]
    texts = [(i, " ".join(rng.choices([*vocabulary, "Acme,", "BETA", "other"], k=rng.randint(0, 30)))) for i in range(80)] + [(100, None), (101, "acme " * 3000)]
    got = defaultdict(list)
    for r in names.mentions(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(aliases, "alias string, symbol string"), "id").orderBy("place").collect():
        got[r["id"]].append((r["place"], r["symbol"], r["at"], r["n_words"]))
    for i, text in texts:
        assert got[i] == plain_mentions(text, aliases), text


def test_names_of_many_aliases_use_no_nested_loop(spark):
    aliases = spark.range(5000).select(F.concat(F.lit("name "), F.col("id").cast("string")).alias("alias"), "id").withColumnRenamed("id", "symbol")
    found = names.mentions(spark.createDataFrame([(1, "a name 7, name 4999 and name 5000")], "id long, text string"), aliases, "id")
    assert [r["symbol"] for r in found.orderBy("place").collect()] == [7, 4999]
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_questions_carry_their_topic(spark):
    rows = [(1, 1, ["A"], ["m"], []), (1, 2, [], [], ["p"]), (1, 3, [], ["n"], []), (1, 4, ["B"], [], []), (1, 5, [], [], []), (2, 1, [], [], []), (2, 2, [], ["m"], [])]
    frame = spark.createDataFrame(rows, "conv_id int, turn int, symbols array<string>, metrics array<string>, periods array<string>")
    got = {(r["conv_id"], r["turn"]): (r["asked_symbols"], r["asked_metrics"], r["asked_periods"]) for r in questions.carry_context(frame).collect()}
    assert got == {(1, 1): (["A"], ["m"], []), (1, 2): (["A"], ["m"], ["p"]), (1, 3): (["A"], ["n"], ["p"]), (1, 4): (["B"], [], []), (1, 5): (["B"], [], []), (2, 1): ([], [], []), (2, 2): ([], ["m"], [])}


def test_lost_words_of_questions(spark):
    asked = spark.createDataFrame([(1, "What was said in the earnings call of Acme?"), (2, "What were the earnings of Acme?")], "question_id int, text string")
    got = {r["question_id"]: r["metrics"] for r in questions.with_metrics(asked, "text").collect()}
    assert got == {1: [], 2: ["net_profit"]}
    told = questions.extract_preferences(spark.createDataFrame([(1, "I avoid highly leveraged companies")], "message_id int, text string")).collect()
    assert [(r["field"], r["values"]) for r in told] == [("debt_preference", ["avoid_high_debt"])]


# ---- as-of, decay, vectors --------------------------------------------------------------------------------


def test_asof_is_that_of_a_plain_search(spark):
    rng, base = random.Random(5), dt.datetime(2026, 1, 1)
    at = lambda: base + dt.timedelta(seconds=rng.randint(0, 400) * 50) if rng.random() > 0.05 else None
    key = lambda: rng.choice(["hot", "hot", "hot", "a", None])
    left = [(i, key(), at()) for i in range(300)] + [(900, "alone", base)]
    right = [(i, key(), at(), rng.randint(0, 3)) for i in range(200)] + [(950, "late", base, 1)]
    lefts = spark.createDataFrame(left, "id int, k string, at timestamp").repartition(4)
    rights = spark.createDataFrame(right, "rid int, k string, seen timestamp, tie int").repartition(3)
    for strict in (False, True):
        for tolerance in (None, 1000):
            for bucket in (100, 3600, 10**6):
                got = {r["id"]: r["rid"] for r in asof.asof_join(lefts, rights, ["k"], "at", "seen", bucket, tolerance, ["tie", "rid"], strict=strict).collect()}
                for i, k, t in left:
                    fits = [(s, tie, r) for r, k2, s, tie in right if k == k2 and t and s and (s < t if strict else s <= t)]
                    best = max(fits) if fits else None
                    if best and tolerance is not None and (t - best[0]).total_seconds() > tolerance:
                        best = None
                    assert got[i] == (best[2] if best else None)
    assert asof.asof_join(lefts, rights.limit(0), ["k"], "at", "seen", 100).where("rid IS NOT NULL").isEmpty()
    assert asof.asof_join(lefts.limit(0), rights, ["k"], "at", "seen", 100).isEmpty()
    repeated = lefts.where("id = 900").unionByName(lefts.where("id = 900"))
    assert asof.asof_join(repeated, rights, ["k"], "at", "seen", 100).count() == 2


def test_sliding_means_are_those_of_a_plain_sum(spark):
    rng, base = random.Random(6), dt.date(2020, 1, 1)
    rows = [(rng.choice("ab"), base + dt.timedelta(days=rng.randint(0, 1500)), float(rng.randint(-2, 2)), rng.randint(1, 3)) for _ in range(400)] + [("a", None, 1.0, 1), ("c", base, None, 1), ("d", base, 0.5, 0)]
    frame = spark.createDataFrame(rows, "k string, day date, v double, w int")
    for window, half in ((365, 90.0), (10, 0.5), (0, 5.0)):
        got = {(r["k"], r["day"]): (r["n"], r["mean"]) for r in decay.sliding_decayed(frame, "k", "day", "v", "w", window, half).collect()}
        days = {(k, d) for k, d, v, _ in rows if d and v is not None}
        assert set(got) == days
        for k, d in days:
            inside = [(v, w * 0.5 ** ((d - e).days / half)) for k2, e, v, w in rows if k2 == k and e and v is not None and 0 <= (d - e).days <= window]
            total = sum(w for _, w in inside)
            assert got[k, d][0] == len(inside)
            assert got[k, d][1] is None if not total else math.isclose(got[k, d][1], sum(v * w for v, w in inside) / total, rel_tol=1e-9, abs_tol=1e-9)
    assert decay.sliding_decayed(frame.limit(0), "k", "day", "v", "w", 5, 5.0).isEmpty()


def test_decayed_sums_merge(spark):
    base = dt.date(2020, 1, 1)
    frame = spark.createDataFrame([("a", base + dt.timedelta(days=i * 7), float(i), 1) for i in range(20)], "k string, day date, v double, w int")
    whole = decay.decayed_by_key(frame, "k", "day", "v", "w", 30.0).first()
    early, late = (decay.decayed_by_key(frame.where(c), "k", "day", "v", "w", 30.0) for c in ("v < 9", "v >= 9"))
    both = early.toDF("k", "ta", "wa", "da").join(late.toDF("k", "tb", "wb", "db"), "k")
    day = lambda c: F.unix_date(c)
    total, at = decay.merged(F.col("ta"), day("da"), F.col("tb"), day("db"), 30.0)
    (got,) = both.select(total.alias("t"), at.alias("d")).collect()
    assert math.isclose(got["t"], whole["total"], rel_tol=1e-12) and got["d"] == (whole["day"] - dt.date(1970, 1, 1)).days


def test_vectors_have_unit_length_and_one_for_each_text(spark):
    docs = spark.createDataFrame([("one two two",), ("one two two",), ("three",), ("",), (None,), ("... --",), ("word " * 5000,)], "text string")
    found = vectors.text_vectors(docs, dims=64)
    lengths = {r["content_hash"]: r["n"] for r in found.groupBy("content_hash").agg(F.sum(F.col("value") * F.col("value")).alias("n")).collect()}
    assert len(lengths) == 3 and all(math.isclose(n, 1.0) for n in lengths.values())
    assert all(len(r["embedding"]) == 64 for r in vectors.as_dense(found, 64).collect())


def test_top_k_by_blocks_is_exact(spark, monkeypatch):
    rng = np.random.default_rng(7)
    data = np.round(rng.normal(size=(120, 6)), 1)
    data[40:60] = data[3]  # ties
    chunks = [(i, [float(x) for x in v], f"d{i}") for i, v in enumerate(data)] + [(500, None, "x"), (501, [1.0, None, 0.0, 0.0, 0.0, 0.0], "x"), (502, [0.0] * 6, "x"), (503, [1.0], "x")]
    frame = spark.createDataFrame(chunks, "chunk_id long, embedding array<double>, document_id string")
    asked = frame.where("chunk_id % 10 = 3 AND chunk_id < 120").select(F.col("chunk_id").alias("question_id"), F.col("embedding").alias("question"))
    wants = {}
    for q in range(3, 120, 10):
        scores = data @ data[q] / np.linalg.norm(data, axis=1) / np.linalg.norm(data[q])
        wants[q] = [int(i) for i in np.lexsort((np.arange(120), -np.round(scores, 12)))[:15]]
    for sizes in ((20_000, 1_000), (30, 4)):
        monkeypatch.setattr(retrieval, "CHUNK_BLOCK", sizes[0])
        monkeypatch.setattr(retrieval, "QUESTION_BLOCK", sizes[1])
        got = defaultdict(list)
        for r in retrieval.top_k_per_query(frame, asked, 15).orderBy("place").collect():
            got[r["question_id"]].append(r["chunk_id"])
        assert got == wants


# ---- figures and answers ----------------------------------------------------------------------------------


def test_figures_are_paired_by_place(spark):
    texts = [
        (1, "Net profit was ₹1,234 crore in FY2020. Net profit and net worth of 55 crore; EPS: 3.2"),
        (2, "Net profit " + "x " * 40 + "12 crore"),
        (3, None), (4, ""), (5, "12 crore net profit"), (6, "ROE 12% and " * 2000),
    ]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    got = [(r["doc_id"], r["metric"], r["value_text"], r["unit_word"], r["period"]) for r in figures.propose(frame).where("doc_id < 6").orderBy("doc_id", "at").collect()]
    assert got == [(1, "net_profit", "1,234", "crore", "FY2020"), (1, "total_equity", "55", "crore", None), (1, "eps_basic", "3.2", "none", None)]
    assert figures.propose(frame.where("doc_id = 6")).count() == 2000


def test_every_place_of_a_text_is_found(spark):
    text = "Total debt: 5; (1,200) roe 12.5% dps 1.2.3 net profit\nafter tax"
    got = figures.places(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("at").collect()
    flat = re.sub(r"\s+", " ", text.lower())
    assert all(flat[r["at"] : r["at"] + len(r["found"])] == r["found"] for r in got)
    assert [r["found"] for r in got] == ["total debt", "5", "(1,200)", "roe", "12.5", "dps", "net profit"]


def test_answers_with_nulls_repeats_and_many_citations(spark):
    claims = spark.createDataFrame(
        [(1, 0, "It was 5 in 2026.", ["a", "a"]), (1, 1, None, ["a"]), (1, 2, "7", None), (2, 0, "9 and 9", [f"n{i}" for i in range(500)]), (3, 0, "2026", ["y"]), (3, 1, "₹2026 crore", ["y"])],
        "answer_id int, claim int, text string, citations array<string>",
    )
    kind = "answer_id int, id string, kind string, text string, label string, source string, metric string, period string, rival_of string, figures array<struct<symbol:string,metric:string,period:string,basis:string,value:double>>"
    item = lambda a, i, text: (a, i, "passage", text, "l", "s", None, None, None, [])
    evidence = spark.createDataFrame([item(1, "a", "5 of 2026"), item(2, "n7", "9"), item(3, "y", "FY in 2026"), item(4, "z", None)], kind)
    got = Counter((r["answer_id"], r["claim"], r["code"]) for r in answers.check_answers(spark.createDataFrame([(1,), (2,), (3,), (5,)], "answer_id int"), claims, evidence).collect())
    assert got == Counter({(1, 2, "uncited_claim"): 1, (2, 0, "unknown_citation"): 499, (2, 0, "too_many_citations"): 1, (5, -1, "no_claims"): 1})


# ---- storage and streams ----------------------------------------------------------------------------------


def test_buckets_that_a_batch_does_not_touch_keep_their_files(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k string, n int, at int"
    buckets.create(spark.createDataFrame([(f"k{i}", i, 0) for i in range(200)] + [(None, 1, 0)], schema), path, ["k"], 8)
    files = lambda: {str(p.relative_to(path)): p.read_bytes() for p in Path(path).rglob("*.parquet")}
    before = files()
    batch = spark.createDataFrame([("k3", 1000, 5), ("k3", 999, 4), ("new", 7, 1), ("k4", 0, -1)], schema)
    touched = {r["b"] for r in batch.select(buckets.bucket_of(["k"], 8).alias("b")).collect()}
    buckets.replace_by_key(spark, batch, path, ["k"], 8, "at")
    after = files()
    of = lambda held, inside: {f for f in held if (int(re.search(r"bucket=(\d+)", f)[1]) in touched) == inside}
    assert of(before, False) == of(after, False) and not of(before, True) & of(after, True)
    want = {f"k{i}": i for i in range(200)} | {None: 1, "k3": 1000, "new": 7}
    assert {r["k"]: r["n"] for r in buckets.read(spark, path).collect()} == want
    buckets.replace_by_key(spark, batch, path, ["k"], 8, "at")
    buckets.replace_by_key(spark, batch.limit(0), path, ["k"], 8, "at")
    assert {r["k"]: r["n"] for r in buckets.read(spark, path).collect()} == want


def test_strikes_do_not_depend_on_the_order_of_files(spark, tmp_path):
    rng, base = random.Random(8), dt.datetime(2026, 1, 1)
    rows = [(rng.randint(0, 12), rng.choice(["missing", "missing", "other", "fetched" if rng.random() < 0.2 else "missing"]), base + dt.timedelta(minutes=i)) for i in range(150)]
    results = []
    for order in (1, -1):
        folder = tmp_path / f"in{order}"
        for part in range(3):
            spark.createDataFrame(rows[::order][part * 50 : part * 50 + 50], "k long, outcome string, ts timestamp").coalesce(1).write.parquet(str(folder / str(part)))
        stream = spark.readStream.schema("k long, outcome string, ts timestamp").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(folder))
        states = counters.strike_stream(stream, "k", "outcome", "ts", late="1000 days")
        results.append({r["key"]: (r["status"], r["strikes"]) for r in counters.last_states(spark, states, str(tmp_path / f"out{order}"), str(tmp_path / f"cp{order}")).collect()})
    count = Counter(k for k, o, _ in rows if o == "missing")
    fetched = {k for k, o, _ in rows if o == "fetched"}
    want = {k: ("fetched" if k in fetched else "no_file" if count[k] >= 3 else "missing", min(count[k], 3)) for k, _, _ in rows}
    assert results == [want, want]


def test_strikes_are_forgotten_by_a_timer(spark, tmp_path):
    base = dt.datetime(2026, 1, 1)
    for part, rows in enumerate([[(1, "missing", base), (2, "fetched", base)], [(3, "missing", base + dt.timedelta(days=30))], [(3, "other", base + dt.timedelta(days=60))]]):
        spark.createDataFrame(rows, "k long, outcome string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in" / str(part)))
    stream = spark.readStream.schema("k long, outcome string, ts timestamp").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    states = counters.strike_stream(stream, "k", "outcome", "ts", forget_ms=5 * 86_400_000)
    got = {r["key"]: r["status"] for r in counters.last_states(spark, states, str(tmp_path / "out"), str(tmp_path / "cp")).collect()}
    assert got[1] == "forgotten" and got[2] == "fetched"


def test_polled_files_are_read_once_for_each_change(spark, tmp_path):
    landed = tmp_path / "landed"
    landed.mkdir()
    (landed / "a.csv").write_text("1\n2\n")
    (landed / "b.csv").write_bytes("﻿x\r\nü".encode())
    (landed / "_hidden").write_text("no")
    (landed / "empty.csv").write_text("")
    folder = str(landed)

    def trigger() -> Counter:
        held = events.drain(polled.poll(spark, folder), str(tmp_path / "out"), str(tmp_path / "cp"))
        return Counter((r["file"], r["line"], r["text"]) for r in held.collect())

    first = trigger()
    assert first == Counter({("a.csv", 1, "1"): 1, ("a.csv", 2, "2"): 1, ("b.csv", 1, "x"): 1, ("b.csv", 2, "ü"): 1})
    assert trigger() == first
    (landed / "a.csv").write_text("1\n2\n3\n")
    (landed / "sub").mkdir()
    (landed / "sub" / "c.csv").write_text("c")
    assert trigger() - first == Counter({("a.csv", 1, "1"): 1, ("a.csv", 2, "2"): 1, ("a.csv", 3, "3"): 1, ("sub/c.csv", 1, "c"): 1})
    assert rows_of(polled.read_all(spark, folder).select("file", "line", "text")) == [("a.csv", 1, "1"), ("a.csv", 2, "2"), ("a.csv", 3, "3"), ("b.csv", 1, "x"), ("b.csv", 2, "ü"), ("sub/c.csv", 1, "c")]
    assert polled.read_all(spark, str(tmp_path / "nowhere")).isEmpty()
