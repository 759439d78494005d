"""Nulls, ties, repeated rows, empty tables and long texts of the relational operators, against plain versions."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as t
from lodestone.operators import answers, citations, documents, facts, forms, jobs, merge, prices, questions, rank
from lodestone.sources import company_pages, feeds, price_files
from lodestone.streaming import events as streams

FACT = "id long, stock_id long, metric string, period string, basis string, currency string, unit string, value decimal(20,4), source string, source_date date"


def _facts(spark, rows):
    return spark.createDataFrame([(i, 1, m, p, "consolidated", c, u, v, s, d) for i, m, p, c, u, v, s, d in rows], FACT.replace("decimal(20,4)", "double")).withColumn("value", F.col("value").cast("decimal(20,4)"))


def test_facts_with_null_dates_ties_and_null_currency(spark):
    d = date(2026, 1, 1)
    rows = _facts(spark, [
        (1, "net_profit", "FY2025", "INR", "INR_CRORE", 100.0, "screener", None), (2, "net_profit", "FY2025", "INR", "INR_CRORE", 101.0, "screener", d), (3, "net_profit", "FY2025", "INR", "INR_CRORE", 101.0, "screener", d),
        (4, "roe", "FY2025", None, "PERCENT", 12.0, "annual_report", None), (5, "roe", "FY2025", None, "PERCENT", 13.0, "annual_report", None), (6, "debt", "FY2025", "INR", "INR_CRORE", 0.0, "annual_report", d), (7, "debt", "FY2025", "INR", "INR_CRORE", 0.0, "screener", d),
    ])
    got = {r["metric"]: r for r in facts.choose_facts(rows).collect()}
    assert got["net_profit"]["id"] == 3 and got["net_profit"]["status"] == "agreed" and got["net_profit"]["corroborated_by"] == 2
    assert got["roe"]["id"] == 5 and got["roe"]["status"] == "disputed" and got["roe"]["disagreeing"] == [4]
    assert got["debt"]["status"] == "agreed"
    assert facts.choose_facts(rows.limit(0)).isEmpty() and facts.choose_facts(rows.unionByName(rows.where("id = 4"))).count() == 3


def test_growth_needs_consecutive_years_of_one_series(spark):
    d = date(2026, 1, 1)
    year = lambda i, y, v, s="screener", u="INR_CRORE": (i, "net_profit", f"FY{y}", "INR", u, v, s, d)
    rows = _facts(spark, [year(1, 2022, 50.0), year(2, 2024, 100.0), year(3, 2025, 110.0), year(4, 2026, 121.0), (5, "net_profit", "FY2026", "USD", "USD_MILLION", 1.0, "screener", d), year(6, 2023, -5.0, "annual_report"), year(7, 2024, 10.0, "annual_report"), (8, "net_profit", "not a period", "INR", "INR_CRORE", 1.0, "screener", d)])
    (got,) = facts.growth_yoy(rows).collect()
    assert (got["fact_ids"], float(got["value"]), got["status"]) == ([3, 4], 10.0, "ok")
    (chain,) = facts.growth_chain(rows).collect()
    assert chain["fact_ids"] == [2, 3, 4]
    (old,) = facts.growth_yoy(rows.where("source = 'annual_report'")).collect()
    assert old["status"] == "not_assessable" and old["value"] is None
    assert facts.growth_yoy(rows.limit(0)).isEmpty() and facts.growth_chain(rows.where("id IN (1, 2, 3)")).isEmpty()


def test_debt_to_equity_stops_at_equity_that_is_not_positive(spark):
    d, rows = date(2026, 1, 1), []
    for i, (year, debt, equity) in enumerate([(2026, 20.0, 0.0), (2025, 20.0, 100.0)]):
        rows += [(2 * i, "total_borrowings", f"FY{year}", "INR", "INR_CRORE", debt, "screener", d), (2 * i + 1, "total_equity", f"FY{year}", "INR", "INR_CRORE", equity, "screener", d)]
    stocks = spark.createDataFrame([(1, False), (2, True), (3, False)], "stock_id long, is_financial boolean")
    got = {r["stock_id"]: (r["status"], r["value"]) for r in facts.debt_to_equity(_facts(spark, rows), stocks).collect()}
    assert got == {1: ("not_assessable", None), 2: ("not_applicable", None), 3: ("not_assessable", None)}


def test_merges_are_idempotent_and_treat_nulls_alike(spark):
    schema = "k string, n int, at int"
    old = spark.createDataFrame([("a", 1, 0), (None, 2, 0)], schema)
    new = spark.createDataFrame([("b", 5, 1), ("b", 6, 2), (None, 9, 3), ("a", 7, 4), ("a", 8, 5)], schema)
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    first = merge.insert_if_absent(old, new, ["k"], "at")
    assert rows(first) == rows(spark.createDataFrame([("a", 1, 0), (None, 2, 0), ("b", 5, 1)], schema)) == rows(merge.insert_if_absent(first, new, ["k"], "at"))
    last = merge.replace_by_key(old, new, ["k"], "at")
    assert {(r["k"], r["n"]) for r in last.collect()} == {("a", 8), ("b", 6), (None, 9)} and rows(merge.replace_by_key(last, new, ["k"], "at")) == rows(last)
    assert {(r["k"], r["n"]) for r in merge.keep_least(old, new, ["k"], "n", "at").collect()} == {("a", 1), ("b", 5), (None, 2)}
    assert rows(merge.insert_if_absent(old, new.limit(0), ["k"], "at")) == rows(old)
    kept = merge.replace_version(spark.createDataFrame([(1, 1), (2, 1)], "p int, v int"), spark.createDataFrame([(1, 2)], "p int, v int"), "p", "v")
    assert rows(kept) == [(1, 2), (2, 1)]


def _greedy(pieces, separator, limit):
    out = []
    for piece in pieces:
        if out and len(out[-1]) + len(separator) + len(piece) <= limit:
            out[-1] += separator + piece
        else:
            out.append(piece)
    return out


def test_packing_is_the_greedy_loop():
    rng = random.Random(1)
    for _ in range(60):
        pieces = ["x" * rng.randint(1, 30) for _ in range(rng.randint(0, 40))]
        assert documents.pack(pieces, "--", 50) == _greedy(pieces, "--", 50)


def test_chunks_lose_no_word_and_keep_their_limit(spark):
    rng = random.Random(2)
    word = lambda: "w" * rng.choice([1, 3, 8, 70])
    texts = ["", "short", "y" * 333, "\n\n".join(" ".join(word() + rng.choice(["", "."]) for _ in range(rng.randint(1, 60))) for _ in range(12))]
    pages = spark.createDataFrame([(1, i, x) for i, x in enumerate(texts)] + [(2, 0, None)], "document_id long, page_number int, text string")
    got = sorted(documents.chunk_pages(pages, 100).collect(), key=lambda r: r["ordinal"])
    bare = lambda x: "".join(x.split())
    assert [r["ordinal"] for r in got] == list(range(len(got))) and all(len(r["text"]) <= 100 for r in got)
    for i, x in enumerate(texts):
        assert bare("".join(r["text"] for r in got if r["page_number"] == i)) == bare(x)
    assert documents.chunk_pages(pages.limit(0)).isEmpty()


def test_windows_are_the_greedy_loop(spark):
    rng = random.Random(3)
    pages = [(d, n, "z" * rng.choice([5, 40, 90, 300])) for d in range(8) for n in range(rng.randint(1, 15))]
    want = {}
    for d in range(8):
        out, alone = [], True
        for _, n, text in [p for p in pages if p[0] == d]:
            block = f"=== PAGE {n} ===\n{text}"
            long = len(block) > 200
            if not long and not alone and len(out[-1][1]) + 1 + len(block) <= 200:
                out[-1] = (out[-1][0] + [n], out[-1][1] + "\n" + block)
            else:
                mark = "[page truncated]"
                out.append(([n], block[: 200 - len(mark) - 1] + "\n" + mark if long else block))
                alone = long
        want[d] = out
    got = documents.page_windows(spark.createDataFrame(pages, "document_id int, page_number int, text string"), 200).collect()
    for d, out in want.items():
        assert [(r["pages"], r["text"]) for r in sorted(got, key=lambda r: r["window_no"]) if r["document_id"] == d] == out


def test_job_claims_and_outcomes_at_their_edges(spark):
    schema = "id long, kind string, status string, attempts int, max_attempts int, run_after timestamp, locked_until timestamp"
    from datetime import datetime

    t0, t1 = datetime(2026, 1, 1), datetime(2026, 1, 2)
    rows = spark.createDataFrame([(1, "embed", "pending", 0, 3, t0, None), (2, "embed", "pending", 0, 3, t0, None), (3, "fetch", "processing", 3, 3, t0, t0), (4, "fetch", "pending", 0, 3, t1, None), (5, "other", "processing", 1, 3, t0, t1)], schema)
    now = "2026-01-01 12:00:00"
    assert {r["id"] for r in jobs.claim(rows, now, 1).collect()} == {1, 3} and jobs.claim(rows.limit(0), now, 1).isEmpty()
    outcomes = spark.createDataFrame([(3, 3, "error"), (5, 2, "done"), (5, 1, "error"), (9, 1, "done")], "id long, attempt int, outcome string")
    got = {r["id"]: r["status"] for r in jobs.apply_outcomes(rows, outcomes, now).collect()}
    assert got[3] == "failed" and got[5] == "pending" and got[1] == "pending" and len(got) == 5


def test_price_files_with_bad_headers_and_marks(spark, tmp_path):
    good = tmp_path / "good"
    good.mkdir()
    head = "TradDt,FinInstrmTp,FinInstrmId,OpnPric,HghPric,LwPric,ClsPric,PrvsClsgPric,TtlTradgVol"
    (good / "a.csv").write_text("﻿" + head + "\n2026-01-01,STK,1,1,2,0.5,1.5,1,10\n2026-01-01,STK,1,0,2,0.5,1.5,1,10\n2026-01-02,STK,1,1,2\n2026-01-02,STK,2,1,2,0.5,NaN,1,10\n2026-01-03, STK ,1,1,2,0.5,1.5,1,0\n", encoding="utf-8")
    codes = spark.createDataFrame([("1",), ("1",), (None,)], "bse_code string")
    assert [(r["trade_date"].day, r["volume"]) for r in price_files.read_price_file(spark, str(good), codes).orderBy("trade_date").collect()] == [(1, 10), (3, 0)]
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "a.csv").write_text("<html>error</html>\n")
    with pytest.raises(price_files.BadPriceFile):
        price_files.read_price_file(spark, str(bad), codes)


def test_feeds_that_are_broken_or_empty(spark):
    item = "<item><title>{}</title><link>{}</link></item>"
    rows = [("a", item.format("One", "http://x.org/1#f") + item.format("Two", "https://x.org/1") + item.format("", "http://x.org/2") + item.format("Bad", "ftp://x.org") + "<item><title>cut"), ("b", ""), ("c", None), ("d", item.format("<![CDATA[A & <b>B</b>]]>", "https://x.org/3?utm_source=q&k=1") * 300)]
    got = {(r["feed"], r["canonical_url"], r["title"]) for r in feeds.items_of(spark.createDataFrame(rows, "feed string, body string")).collect()}
    assert got == {("a", "https://x.org/1", "One"), ("d", "https://x.org/3?k=1", "A & B")}


def test_pages_without_tables(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "<section id='quarters'>"), (4, '<section id="ratios"><table class="data-table"><tr><th></th></tr></table></section>')], "page_id int, html string")
    assert company_pages.table_cells(pages).isEmpty() and company_pages.filing_links(pages).isEmpty()
    assert company_pages.top_ratios(pages).where("pe IS NOT NULL").isEmpty()


def test_numbered_children_and_fair_shares_are_those_of_a_loop(spark):
    rows = spark.createDataFrame([(1, 1, ["a", "b"]), (1, 2, []), (1, 3, ["c"]), (2, 1, [])], "g int, n int, kids array<string>")
    got = [(r["g"], r["id"], r["child"], r["parent"]) for r in citations.numbered_with_children(rows, "g", ["n"], "kids").collect()]
    assert sorted(got, key=repr) == sorted([(1, "F1", None, None), (1, "F2", "a", "F1"), (1, "F3", "b", "F1"), (1, "F4", None, None), (1, "F5", None, None), (1, "F6", "c", "F5"), (2, "F1", None, None)], key=repr)
    dealt = rank.fair_cap(spark.createDataFrame([("a", i) for i in range(9)] + [("b", 1), ("c", 1), ("c", 2)], "g string, i int"), "g", [F.col("i")], 6)
    assert sorted((r["g"], r["i"]) for r in dealt.collect()) == [("a", 0), ("a", 1), ("a", 2), ("b", 1), ("c", 1), ("c", 2)]


def test_forms_and_periods_of_nothing(spark):
    rows = spark.createDataFrame([(1, None, None), (2, "", "")], "i int, a string, b string")
    got = rows.select(forms.parse_form(F.col("a"), "claims array<struct<text:string>>", "claims", 3).alias("c"), questions.parse_period(F.col("b")).alias("p"), questions.periods_in(F.coalesce("b", F.lit(""))).alias("q")).collect()
    assert all(r["c"] == [] and r["p"] is None and r["q"] == [] for r in got)
    assert questions.extract_preferences(spark.createDataFrame([(1, None), (2, "")], "message_id int, text string")).isEmpty()


def test_markers_are_numbered_over_all_claims(spark):
    claims = spark.createDataFrame([(1, 0, "a [F1]", ["F2", "F2"]), (1, 1, "b", ["F1", "F2"]), (1, 2, "c", [])], "answer_id int, claim int, text string, citations array<string>")
    evidence = spark.createDataFrame([(1, "F1", "one"), (1, "F2", "two")], "answer_id int, id string, label string")
    (got,) = answers.render(claims, evidence).collect()
    assert got["answer"] == "a [1] b [2][1] c" and got["sources"] == ["two", "one"]


def test_sentences_are_trimmed_by_blanks(spark):
    got = spark.createDataFrame([(" 1 a.  12 b! c\n",)], "x string").select(t.sentences(F.col("x")).alias("s")).first()["s"]
    assert got == ["1 a.", "12 b!", "c"]


def test_a_batch_that_runs_again_adds_nothing(spark, tmp_path):
    events = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "n int, k string")
    events.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("n int, k string").parquet(str(tmp_path / "in"))
    for checkpoint in ("one", "two"):  # a lost checkpoint runs the batch anew
        streams.insert_batches(stream(), str(tmp_path / "out"), str(tmp_path / checkpoint), ["k"], "n").awaitTermination()
        assert sorted((r["k"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", 1), ("b", 3)]


def test_prices_of_an_empty_history(spark):
    none = spark.createDataFrame([], "symbol string, trade_date date, close decimal(14,2), prev_close decimal(14,2)")
    assert prices.corporate_actions(none).isEmpty()
