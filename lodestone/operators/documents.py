"""Document pipeline: scan rejection, page selection, chunks, windows, fact validation, tagging."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as t
from lodestone.operators.dims import METRICS
from lodestone.operators.rank import budget_prefix

#: Fixed values of page selection: pages of an annual report, numbers on a metric page, characters of a window.
MAX_REPORT_PAGES, MIN_NUMBERS, WINDOW_CHARS, CHUNK_CHARS = 40, 8, 12_000, 1_200
HEADLINES = (
    r"(consolidated|standalone) balance sheet as at|statement of profit and loss for the (year|period)|financial highlights|key (financial )?indicators"
    r"|ten[- ]year|dividend per (equity )?share|net interest margin|gross npa|key performance"
)
METRIC_WORDS = r"\b(revenues?|profits?|pat|borrowings?|debt|equity|net worth|dividends?|earnings per share|eps|return on equity|roe|net interest income|net interest margin|nim|npas?)\b"
MONEY_WORDS = r"₹|%|us\$|\b(rs|inr|crores?|cr|lakhs?|usd|millions?|billions?|bn)\b"
#: Fixed values of tagging: the first pattern that matches a title gives type, sentiment and impact.
TITLE_TAGS = [
    (r"(?i)cancel(?:s|led|lation)?\b.{0,40}\b(?:licen[cs]e|registration)|\bsection 35a\b", ("regulatory_legal", "negative", "high")),
    (r"(?i)\bpenalty\b|\bpenalties\b", ("regulatory_legal", "negative", "medium")),
    (r"(?i)\b(?:re-?)?appointment\b", ("management_change", "neutral", "low")),
    (r"(?i)\bapproves?\b|\bapproval\b|\bapproved\b", ("regulatory_legal", "neutral", "low")),
]
NO_TAG = ("other", "neutral", "low")


def scan_status(pages: DataFrame, least: int = 50) -> DataFrame:
    """Documents whose pages hold almost no visible characters are rejected as scans."""
    found = pages.groupBy("document_id").agg(F.coalesce(F.sum(t.visible_characters(F.col("text"))), F.lit(0)).alias("visible"), F.count(F.lit(1)).alias("n_pages"))
    return found.withColumn("status", F.when(F.col("visible") < least, "rejected").otherwise("ok"))


def is_headline_page(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"\s+", " ")).rlike(HEADLINES)


def is_metric_page(text: Column, least: int = MIN_NUMBERS) -> Column:
    tidy = F.lower(F.regexp_replace(text, r"\s+", " "))
    money = tidy.rlike(MONEY_WORDS) | text.rlike(r"(?<![A-Za-z])H ?\d")
    return tidy.rlike(METRIC_WORDS) & money & (t.count_numbers(text) >= least)


def fact_pages(pages: DataFrame, headline: Column | None = None, metric: Column | None = None, limit: int = MAX_REPORT_PAGES) -> DataFrame:
    """Pages to read for facts, by the document's kind: the headline pages with most numbers, or all metric pages.

    pages: document_id, kind, page_number, text. Ties go to the earlier page.
    """
    headline = is_headline_page(F.col("text")) if headline is None else headline
    metric = is_metric_page(F.col("text")) if metric is None else metric
    wanted = F.when(F.col("kind") == "annual_report", headline).when(F.col("kind").isin("presentation", "transcript"), metric).otherwise(False)
    order = Window.partitionBy("document_id").orderBy(F.desc("n_numbers"), "page_number")
    rows = pages.where(wanted).withColumn("n_numbers", t.count_numbers(F.col("text"))).withColumn("_n", F.row_number().over(order))
    return rows.where((F.col("kind") != "annual_report") | (F.col("_n") <= limit)).drop("_n")


def event_pages(pages: DataFrame, budget: int = WINDOW_CHARS) -> DataFrame:
    """First pages of transcripts and announcements within a budget of characters; the first page always."""
    rows = pages.where(F.col("kind").isin("transcript", "announcement")).withColumn("_size", F.char_length("text"))
    return budget_prefix(rows, ["document_id"], [F.col("page_number")], "_size", budget).drop("_size", "used", "place")


_GAPS, _AT_ENDS, _SENTENCES = re.compile(r"[ \t\n\x0b\f\r]+"), " \t\n\x0b\f\r", re.compile(r"(?<=[.!?])[ \t\n\x0b\f\r]+")


def pack(pieces: list[str], separator: str, limit: int) -> list[str]:
    """Neighbouring pieces joined while the result fits; each piece is at most limit long."""
    out: list[list[str]] = []
    size = 0
    for piece in pieces:
        if out and size + len(separator) + len(piece) <= limit:
            out[-1].append(piece)
            size += len(separator) + len(piece)
        else:
            out.append([piece])
            size = len(piece)
    return [separator.join(x) for x in out]


def chunks_of(text: str, limit: int = CHUNK_CHARS) -> list[str]:
    """Chunks of a page: paragraphs packed up to limit; long ones cut between sentences, then words, then anywhere.

    No text is lost but white space between pieces, and no chunk is longer than limit.
    """

    def by_words(sentence: str) -> list[str]:
        words = [w for w in _GAPS.split(sentence) if w]
        return pack([w[i : i + limit] for w in words for i in range(0, len(w), limit)], " ", limit)

    def by_sentences(paragraph: str) -> list[str]:
        return pack([x for s in _SENTENCES.split(paragraph) for x in ([s] if len(s) <= limit else by_words(s))], " ", limit)

    paragraphs = [p for p in (p.strip(_AT_ENDS) for p in text.split("\n\n")) if p]
    return pack([x for p in paragraphs for x in ([p] if len(p) <= limit else by_sentences(p))], "\n\n", limit)


def chunk_pages(pages: DataFrame, limit: int = CHUNK_CHARS) -> DataFrame:
    """Chunks of all pages with their ordinal in the document and content hash; no chunk crosses pages.

    Pages are cut in Arrow batches, each in one pass, as greedy packing is a loop and nothing else; a null text has no chunks.
    """
    kinds = pages.schema
    columns = ", ".join(f"{c} {kinds[c].dataType.simpleString()}" for c in ("document_id", "page_number"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [chunks_of(x, limit) if x else [] for x in part.column(2).to_pylist()]
                rows = pa.array([i for i, x in enumerate(found) for _ in x], pa.int64())
                places, texts = [i for x in found for i in range(len(x))], [c for x in found for c in x]
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), pa.array(places, pa.int32()), pa.array(texts, pa.string())], names=["document_id", "page_number", "_i", "text"])

    rows = pages.select("document_id", "page_number", "text").mapInArrow(cut, f"{columns}, _i int, text string")
    order = Window.partitionBy("document_id").orderBy("page_number", "_i")
    return rows.select("document_id", (F.row_number().over(order) - 1).alias("ordinal"), "page_number", "text", F.sha2("text", 256).alias("content_hash"))


def page_windows(pages: DataFrame, limit: int = WINDOW_CHARS, mark: str = "[page truncated]") -> DataFrame:
    """Pack a document's pages in order into windows of at most limit characters; a longer page is alone and cut.

    A greedy fold over each document's pages, which a running sum cannot express.
    """
    block = F.concat(F.lit("=== PAGE "), F.col("page_number").cast("string"), F.lit(" ===\n"), F.col("text"))
    cut = F.concat(F.substring(block, 1, limit - len(mark) - 1), F.lit("\n" + mark))
    long = F.char_length(block) > limit
    item = F.struct(F.col("page_number").alias("page"), F.when(long, cut).otherwise(block).alias("text"), long.alias("alone"))
    grouped = pages.groupBy("document_id").agg(F.sort_array(F.collect_list(item)).alias("_items"))
    empty = F.array().cast("array<struct<pages:array<int>,text:string,alone:boolean>>")

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(last["text"], F.lit("\n"), x["text"])
        fits = (F.size(acc) > 0) & ~x["alone"] & ~last["alone"] & (F.char_length(joined) <= limit)
        grown = F.struct(F.array_append(last["pages"], x["page"].cast("int")).alias("pages"), joined.alias("text"), F.lit(False).alias("alone"))
        own = F.struct(F.array(x["page"].cast("int")).alias("pages"), x["text"].alias("text"), x["alone"].alias("alone"))
        return F.when(fits, F.array_append(F.slice(acc, 1, F.size(acc) - 1), grown)).otherwise(F.array_append(acc, own))

    windows = F.aggregate("_items", empty, step)
    return grouped.select("document_id", F.posexplode(windows).alias("window_no", "_w")).select("document_id", "window_no", F.col("_w.pages").alias("pages"), F.col("_w.text").alias("text"))


def dedupe_documents(incoming: DataFrame, existing: DataFrame, content: str = "text", key: str = "doc_id") -> DataFrame:
    """New documents by content hash, the smallest id of each content, with the key of their blob."""
    hashed = incoming.withColumn("sha256", F.sha2(content, 256))
    first = hashed.groupBy("sha256").agg(F.min(key).alias(key), F.count(F.lit(1)).alias("n_copies"))
    known = existing.select(F.sha2(content, 256).alias("_known")).distinct()
    return first.join(known, F.col("sha256") == F.col("_known"), "left_anti").withColumn("blob_key", F.concat(F.lit("documents/"), "sha256", F.lit(".pdf")))


def tag_items(items: DataFrame, aliases: DataFrame, title: str = "title") -> DataFrame:
    """Events of items that name a stock: one for each item and stock, tagged by the title's first pattern.

    aliases (stock, alias, place) is a small stated dimension, joined by a broadcast nested loop over whole words.
    """
    named = items.join(F.broadcast(aliases), t.whole_word(F.col(title), F.col("alias")))
    once = named.groupBy(*items.columns, "stock").agg(F.min("place").alias("place"))
    return once.withColumn("_tag", t.first_tag(F.col(title), TITLE_TAGS, NO_TAG)).select(*items.columns, "stock", "place", "_tag.*")


#: Fixed values of validation: how a quote names each metric, and which wording disqualifies it.
LABELS = {
    "revenue_from_operations": r"revenue from operations|total income from operations|income from operations",
    "net_interest_income": r"net interest income|nii",
    "net_profit": r"net profit|profit after tax|pat|profit for the (?:year|period|quarter)",
    "total_borrowings": r"total borrowings|total debt|gross debt",
    "total_equity": r"total equity|net worth|shareholders'? funds|shareholders'? equity|equity attributable",
    "dividend_per_share": r"dividend per (?:equity )?share|dividend of|final dividend|interim dividend|special dividend|dps",
    "eps_basic": r"earnings per (?:equity )?share|eps",
    "return_on_equity": r"return on (?:average )?(?:equity|net worth)|roe|roae|ronw",
    "net_interest_margin": r"net interest margin|nim",
    "gross_npa_ratio": r"gross npas?|gross non[- ]performing|gnpa",
}
#: Wording of adjusted profits, of dividends that were paid and of those that are a part of the year's.
DIVIDEND_PAID, DIVIDEND_PART, DIVIDEND_TOTAL = r"\bdividends? (?:on equity shares|paid)\b|\bappropriation", r"\b(?:final|interim|special) dividend", r"\btotal dividend"
#: How percentages and figures by share are written, and what shows rupees.
PERCENT_SHOWN, SHARE_SHOWN, RUPEE_SCALES = r"%|\bper ?cent\b", r"\bper (?:equity |ordinary )?share\b|/ ?share\b|\beps\b|\bdps\b", r"\b(?:crores?|cr|lakhs?|lacs?)\b"
ADJUSTED = r"\b(?:excluding|before) exceptional|\badjusted\b|\bunderlying\b|\bnormali[sz]ed\b"
SCALE = {"crore": r"\b(?:crores?|cr)\b", "lakh": r"\b(?:lakhs?|lacs?)\b", "million": r"\b(?:millions?|mn|mln)\b", "billion": r"\b(?:billions?|bn)\b", "thousand": r"\bthousands?\b"}
TO_CRORE = {"lakh": "0.01", "crore": "1", "million": "0.1", "billion": "100", "thousand": "0.0001"}
TO_MILLION = {"thousand": "0.001", "million": "1", "billion": "1000"}


def _by_metric(metric: Column, values: dict, otherwise: Column) -> Column:
    out = otherwise
    for name, value in values.items():
        out = F.when(metric == name, value if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return out


def evidenced_currency(quote: Column, page: Column) -> Column:
    """INR or USD as the quote shows it, else as the page does; null where the nearest evidence shows both or none."""

    def shown(text: Column) -> Column:
        marked = t.prepare(text)
        rupee, dollar = marked.rlike(rf"{t.RUPEE}|{RUPEE_SCALES}"), marked.rlike(r"\$|\busd\b")
        return F.when(rupee & dollar, "both").when(rupee, "INR").when(dollar, "USD")

    found = F.coalesce(shown(quote), shown(page))
    return F.when(found != "both", found)


def validate_candidates(candidates: DataFrame) -> DataFrame:
    """Accept a proposed figure only if its page proves it: the first code of an ordered list of rejections, else null.

    candidates: metric, value_text, unit_word, currency, period (a strict code, null if unreadable),
    basis, quote, page_text (null if the page was not shown), is_financial. Adds code, value (in the
    metric's unit), unit, evidenced currency and basis.
    """
    # What all conditions read is prepared once, in columns of its own.
    rows = candidates.withColumns(
        {
            "_quote": t.normalise(F.col("quote")),
            "_page": t.normalise(F.col("page_text")),
            "_number": t.parse_number(F.col("value_text")),
            "_numbers": t.numbers_in(F.col("quote")),
            "_evidenced": evidenced_currency(F.col("quote"), F.col("page_text")),
        }
    )
    metric, quote, page = F.col("metric"), F.col("_quote"), F.col("_page")
    labelled = _by_metric(metric, {k: quote.rlike(rf"\b(?:{v})\b") for k, v in LABELS.items()}, F.lit(False))
    rows = rows.withColumns({"_kind": _by_metric(metric, {k: v[0] for k, v in METRICS.items()}, F.lit(None)), "_applies": _by_metric(metric, {k: v[1] for k, v in METRICS.items()}, F.lit(None))})
    kind, applies = F.col("_kind"), F.col("_applies")
    problem = F.when((metric == "net_profit") & quote.rlike(ADJUSTED), "adjusted_figure").when(
        metric == "dividend_per_share",
        F.when(quote.rlike(DIVIDEND_PAID), "dividend_paid_not_declared").when(
            quote.rlike(DIVIDEND_PART) & ~quote.rlike(DIVIDEND_TOTAL), "partial_dividend"
        ),
    )
    number = F.col("_number")
    rows = rows.withColumn("_currency", F.when(kind != "percent", F.col("_evidenced")))
    currency = F.col("_currency")
    word = F.col("unit_word")
    scale_shown = _by_metric(word, {k: page.rlike(v) for k, v in SCALE.items()}, F.lit(False))
    factor = F.when(currency == "INR", _by_metric(word, {k: F.lit(v).cast("decimal(10,4)") for k, v in TO_CRORE.items()}, F.lit(None))).otherwise(
        _by_metric(word, {k: F.lit(v).cast("decimal(10,4)") for k, v in TO_MILLION.items()}, F.lit(None))
    )
    rows = rows.withColumn("_factor", factor)
    factor = F.col("_factor")
    unit = F.when(kind == "percent", "PERCENT").otherwise(
        F.concat(currency, F.when(kind == "per_share", "_PER_SHARE").when(currency == "INR", "_CRORE").otherwise("_MILLION"))
    )
    shown = (
        F.when(kind == "percent", word.isin("percent", "none") & quote.rlike(PERCENT_SHOWN))
        .when(kind == "per_share", word.isin("per_share", "none") & quote.rlike(SHARE_SHOWN))
        .otherwise(factor.isNotNull() & scale_shown)
    )
    rows = rows.withColumns({"_unit": unit, "_value": F.when(kind == "amount", number * factor).otherwise(number).cast("decimal(24,4)")})
    unit, value = F.col("_unit"), F.col("_value")
    year = F.right(F.col("period"), F.lit(4))
    yy, before = F.right(year, F.lit(2)), F.lpad((year.try_cast("int") - 1).cast("string").substr(3, 2), 2, "0")
    evidence = F.concat(
        F.lit(r"(?<![\d,.])"), year, F.lit(r"(?!\d)|fy\s*'?(?:20)?"), yy, F.lit(r"(?!\d)|fy\s*'?(?:20)?"), before, F.lit(r"\s*-\s*(?:20)?"), yy, F.lit(r"(?!\d)|(?<!\d)20"), before, F.lit(r"\s*-\s*(?:20)?"), yy, F.lit(r"(?!\d)")
    )
    quarter_year = F.when(F.col("period").rlike("^Q[1-3]"), F.concat(F.lit(r"|(?<![\d,.])"), (year.try_cast("int") - 1).cast("string"), F.lit(r"(?!\d)"))).otherwise("")
    in_range = (
        F.when(unit == "PERCENT", value.between(F.when(metric == "return_on_equity", -100).otherwise(0), 100))
        .when(kind == "per_share", F.when(metric == "eps_basic", (value != 0) & (F.abs(value) < 10_000)).otherwise((value > 0) & (value < 10_000)))
        .otherwise(((value > 0) | ((metric == "net_profit") & (value < 0))) & (F.abs(value) < F.when(unit == "INR_CRORE", 100_000_000).otherwise(10_000_000)))
    )
    code = (
        F.when(kind.isNull(), "unknown_metric")
        .when((applies != "all") & ((applies == "bank") != F.col("is_financial")), "metric_not_applicable")
        .when(F.coalesce(quote, F.lit("")).eqNullSafe("") | (F.char_length("quote") > 400), "bad_quote")
        .when(F.col("page_text").isNull(), "page_outside_window")
        .when(~page.contains(quote), "quote_not_on_page")
        .when(~labelled, "label_not_in_quote")
        .when(problem.isNotNull(), problem)
        .when(number.isNull() | ~F.array_contains("_numbers", number), "number_not_in_quote")
        .when((kind != "percent") & currency.isNull(), "ambiguous_currency")
        .when((kind != "percent") & (F.col("currency") != "none") & (F.col("currency") != currency), "currency_mismatch")
        .when(~shown, "unit_not_evidenced")
        .when(F.col("period").isNull(), "unparseable_period")
        .when(~F.regexp_like(page, F.concat(evidence, quarter_year)), "period_not_evidenced")
        .when(~in_range, "out_of_range")
    )
    said = F.col("basis").isin("consolidated", "standalone") & F.regexp_like(page, F.concat(F.lit(r"\b"), F.col("basis"), F.lit(r"\b")))
    out = rows.withColumn("code", code)
    accepted = F.col("code").isNull()
    return out.withColumns(
        {
            "value": F.when(accepted, value),
            "unit": F.when(accepted, unit),
            "evidenced": F.when(accepted, currency),
            "basis": F.when(said, F.col("basis")).otherwise("unspecified"),
        }
    ).drop("_quote", "_page", "_number", "_numbers", "_evidenced", "_kind", "_applies", "_currency", "_factor", "_unit", "_value")


def validate_events(events: DataFrame) -> DataFrame:
    """Accept a proposed event if its page is among those shown and holds its quote: the first code that applies, else null.

    events: pages (those shown), page, quote, page_text.
    """
    read = events.withColumns({"_quote": t.normalise(F.col("quote")), "_page": t.normalise(F.col("page_text"))})
    code = (
        F.when(F.coalesce("_quote", F.lit("")) == "", "bad_quote")
        .when(~F.array_contains("pages", F.col("page")), "page_outside_window")
        .when(~F.coalesce(F.contains("_page", "_quote"), F.lit(False)), "quote_not_on_page")
    )
    return read.withColumn("code", code).drop("_quote", "_page")
