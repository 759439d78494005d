"""Company pages: cells of sectioned data tables, a list of ratios, links to filings; and their mapping to facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as t

#: The sections that are read, those that hold money, and the caption that gives their unit.
SECTIONS = ("quarters", "profit-loss", "balance-sheet", "cash-flow", "ratios")
MONEY_SECTIONS = ("quarters", "profit-loss", "balance-sheet", "cash-flow")
UNIT_CAPTION = "Figures in Rs. Crores"
#: Fixed values: (section, row, metric, unit, whether a bank has it).
MAPPING = (
    ("quarters", "Net Profit", "net_profit", "INR_CRORE", True),
    ("quarters", "EPS in Rs", "eps_basic", "INR_PER_SHARE", True),
    ("profit-loss", "Net Profit", "net_profit", "INR_CRORE", True),
    ("profit-loss", "EPS in Rs", "eps_basic", "INR_PER_SHARE", True),
    ("ratios", "ROE %", "return_on_equity", "PERCENT", True),
    ("quarters", "Sales", "revenue_from_operations", "INR_CRORE", False),
    ("quarters", "Revenue", "revenue_from_operations", "INR_CRORE", False),
    ("profit-loss", "Sales", "revenue_from_operations", "INR_CRORE", False),
    ("profit-loss", "Revenue", "revenue_from_operations", "INR_CRORE", False),
    ("balance-sheet", "Borrowings", "total_borrowings", "INR_CRORE", False),
)
#: Names of the ratios on the page, with a unit that the item's text must show.
RATIOS = {
    "market_cap": ("Market Cap", "Cr."), "price": ("Current Price", ""), "pe": ("Stock P/E", ""), "book_value": ("Book Value", ""),
    "dividend_yield": ("Dividend Yield", ""), "roce": ("ROCE", ""), "roe": ("ROE", ""), "face_value": ("Face Value", ""),
}
#: Kinds of filing in the order in which they are chosen, with their words.
KINDS = {"transcript": "earnings call transcript", "presentation": "investor presentation", "annual_report": "annual report", "announcement": "announcement"}
_TABLE = r'(?is)<table\b[^>]*\bclass\s*=\s*"[^"]*\bdata-table\b[^"]*"[^>]*>(.*?)</table\s*>'


def _texts(html: Column, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), t.strip_markup)


def _number(text: Column) -> Column:
    """A printed figure with Western or Indian grouping; a percent sign and a rupee sign go; null for an empty cell."""
    return F.regexp_replace(text, r"[,%₹\s]", "").try_cast("decimal(20,4)")


def table_cells(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Cells of the data tables of the known sections: section, row_label, column_label, value (null for an empty cell).

    A table's first row gives the columns. A section of money counts only if its text beside the table states
    the unit. Rows without a label and rows of links are left out; cells without a column too.
    """
    names = "|".join(SECTIONS)
    sections = F.regexp_extract_all(F.col(html), F.lit(rf'(?is)(<section\b[^>]*\bid\s*=\s*"(?:{names})".*?)</section\s*>'), F.lit(1))
    rows = pages.select(key, F.posexplode(sections).alias("_s", "_html")).select(
        key,
        "_s",
        F.regexp_extract("_html", r'(?is)^<section\b[^>]*\bid\s*=\s*"([^"]*)"', 1).alias("section"),
        t.strip_markup(F.regexp_replace("_html", _TABLE, " ")).contains(UNIT_CAPTION).alias("_stated"),
        F.regexp_extract_all("_html", F.lit(_TABLE), F.lit(1)).alias("_tables"),
    )
    rows = rows.where(~F.col("section").isin(*MONEY_SECTIONS) | F.col("_stated")).select(key, "_s", "section", F.posexplode("_tables").alias("_t", "_table"))
    trs = F.regexp_extract_all(F.col("_table"), F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr\s*>"), F.lit(1))
    rows = rows.select(key, "_s", "_t", "section", _texts(F.get(trs, 0), r"(?is)<th\b[^>]*>(.*?)</th\s*>").alias("_columns"), F.posexplode(F.slice(trs, 2, F.size(trs))).alias("_r", "_tr"))
    cells = _texts(F.col("_tr"), r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]\s*>")
    label = F.trim(F.regexp_replace(F.get(F.col("_cells"), 0), r"[\s+]+$", ""))
    rows = rows.withColumn("_cells", cells).withColumn("row_label", label).where((F.col("row_label") != "") & (F.col("row_label") != "Raw PDF"))
    pairs = F.arrays_zip(F.slice("_columns", 2, F.size("_columns")).alias("c"), F.slice("_cells", 2, F.size("_cells")).alias("v"))
    out = rows.select(key, "_s", "_t", "section", "_r", "row_label", F.posexplode(pairs).alias("_c", "_p")).where("_p.c IS NOT NULL AND _p.v IS NOT NULL")
    return out.select(key, "section", "row_label", F.col("_p.c").alias("column_label"), _number(F.col("_p.v")).alias("value"))


def top_ratios(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """One row for each page with its list of ratios; an item that has not exactly one number, such as a pair, is null."""
    listed = F.regexp_extract(html, r'(?is)<ul\b[^>]*\bid\s*=\s*"top-ratios"[^>]*>(.*?)</ul\s*>', 1)
    items = pages.select(key, F.explode_outer(F.regexp_extract_all(listed, F.lit(r"(?is)<li\b[^>]*>(.*?)</li\s*>"), F.lit(1))).alias("_li"))
    name = t.strip_markup(F.regexp_extract("_li", r'(?is)<span\b[^>]*class\s*=\s*"[^"]*\bname\b[^"]*"[^>]*>(.*?)</span\s*>', 1))
    numbers = _texts(F.col("_li"), r'(?is)<span\b[^>]*class\s*=\s*"[^"]*\bnumber\b[^"]*"[^>]*>(.*?)</span\s*>')
    read = items.select(key, name.alias("_name"), numbers.alias("_numbers"), t.strip_markup(F.col("_li")).alias("_text"))
    value = lambda label, says: F.max(F.when((F.col("_name") == label) & (F.size("_numbers") == 1) & F.col("_text").contains(says), _number(F.get("_numbers", 0))))
    return read.groupBy(key).agg(*[value(label, says).alias(column) for column, (label, says) in RATIOS.items()])


def filing_links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Links of the page's documents in order: place, kind, label, url. Blocks of other kinds, such as ratings, are skipped."""
    part = F.regexp_extract(html, r'(?is)\bid\s*=\s*"documents"[^>]*>(.*)$', 1)
    blocks = F.split(part, r'(?i)(?=<div\b[^>]*class="[^"]*\bdocuments\b)')
    rows = pages.select(key, F.posexplode(blocks).alias("_b", "_block"))
    classes = F.regexp_extract("_block", r'(?i)^<div\b[^>]*class="([^"]*)"', 1)
    kind = F.when(classes == "", None).when(classes.contains("annual-reports"), "annual_report").when(classes.contains("concalls"), "call").when(classes.contains("credit-ratings"), None).otherwise("announcement")
    entries = F.regexp_extract_all(F.col("_block"), F.lit(r"(?is)<li\b[^>]*>(.*?)</li\s*>"), F.lit(1))
    rows = rows.withColumn("_kind", kind).where("_kind IS NOT NULL").select(key, "_b", "_kind", F.posexplode(entries).alias("_e", "_li"))
    month = t.strip_markup(F.regexp_extract("_li", r"(?is)<div\b[^>]*>(.*?)</div\s*>", 1))
    anchors = F.regexp_extract_all(F.col("_li"), F.lit(r"(?is)(<a\b.*?</a\s*>)"), F.lit(1))
    rows = rows.select(key, "_b", "_e", "_kind", F.when(F.col("_kind") == "call", month).alias("_month"), F.posexplode(anchors).alias("_a", "_link"))
    text = t.strip_markup(F.regexp_replace("_link", r"(?is)<div\b.*?</div\s*>", " "))
    low = F.lower("_label")
    found = F.when(F.col("_kind") != "call", F.col("_kind")).when(low.contains("transcript"), "transcript").when(low == "ppt", "presentation")
    rows = rows.withColumn("_label", text).withColumn("kind", found).where("kind IS NOT NULL AND (kind <> 'announcement' OR _label <> '')")
    place = F.row_number().over(Window.partitionBy(key).orderBy("_b", "_e", "_a"))
    return rows.select(key, place.alias("place"), "kind", F.coalesce("_month", "_label").alias("label"), t.unescape_entities(F.regexp_extract("_link", r'(?i)\bhref\s*=\s*"([^"]*)"', 1)).alias("url"))


def select_filings(links: DataFrame, official: Column, oldest: str, reports: int, key: str = "page_id") -> DataFrame:
    """Filings to read, in the order of KINDS, each in page order: first link of each address that is official.

    Calls and presentations count from the month oldest (a date) on, by the month of their label; of annual reports
    the first ones listed, official or not, take the places.
    """
    listed = F.row_number().over(Window.partitionBy(key, "kind").orderBy("place"))
    first = F.row_number().over(Window.partitionBy(key, "url").orderBy("place"))
    month = F.to_date(F.try_to_timestamp(F.when(F.col("label").rlike("^[A-Z][a-z]{2} [0-9]{4}$"), F.col("label")), F.lit("MMM yyyy")))
    rows = links.withColumns({"_listed": listed, "_month": month}).where(official).withColumn("_first", first).where("_first = 1")
    calls = F.col("kind").isin("transcript", "presentation") & (F.col("_month") >= F.to_date(F.lit(oldest)))
    kept = rows.where(calls | ((F.col("kind") == "annual_report") & (F.col("_listed") <= reports)) | (F.col("kind") == "announcement"))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    order = F.row_number().over(Window.partitionBy(key).orderBy(rank, "place"))
    return kept.withColumn("choice", order).select(key, "choice", "kind", "label", "url")


def clean_label(label: Column) -> Column:
    return F.substring(t.collapse(F.replace(label, F.lit("''"), F.lit("'"))), 1, 200)


def title_for(symbol: Column, kind: Column, label: Column) -> Column:
    words = F.element_at(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair]), kind)
    return F.substring(F.concat(symbol, F.lit(" "), words, F.lit(", "), clean_label(label)), 1, 200)


def _period(section: Column, column: Column) -> Column:
    """The fiscal period of a column such as "Mar 2026"; null for other texts, and for months that end no year (or quarter, in that section)."""
    at = F.to_date(F.try_to_timestamp(F.when(column.rlike("^[A-Z][a-z]{2} [0-9]{4}$"), column), F.lit("MMM yyyy")))
    month, year = F.month(at), F.year(at)
    quarter = F.concat(F.lit("Q"), F.when(month == 3, 4).otherwise((month / 3 - 1).cast("int")).cast("string"), F.lit("FY"), F.when(month == 3, year).otherwise(year + 1).cast("string"))
    annual = F.concat(F.lit("FY"), year.cast("string"))
    return F.when(section == "quarters", F.when(month % 3 == 0, quarter)).when(month == 3, annual)


def map_cells(cells: DataFrame, companies: DataFrame, key: str = "page_id") -> DataFrame:
    """Facts of the known rows (a broadcast mapping of fixed size), and total equity: equity capital and reserves of one column.

    companies: the key and is_financial. A bank has only the rows that mean the same for it.
    """
    dim = cells.sparkSession.createDataFrame(MAPPING, "section string, row_label string, metric string, unit string, for_banks boolean")
    dated = cells.withColumn("period", _period(F.col("section"), F.col("column_label"))).where("period IS NOT NULL AND value IS NOT NULL")
    named = dated.join(companies.select(key, "is_financial"), key)
    mapped = named.join(F.broadcast(dim), ["section", "row_label"]).where(F.col("for_banks") | ~F.col("is_financial"))
    part = lambda label: F.max(F.when(F.col("row_label") == label, F.col("value")))
    sheet = named.where((F.col("section") == "balance-sheet") & F.col("row_label").isin("Equity Capital", "Reserves"))
    equity = sheet.groupBy(key, "period").agg(part("Equity Capital").alias("_a"), part("Reserves").alias("_b")).where("_a IS NOT NULL AND _b IS NOT NULL")
    total = equity.select(key, F.lit("total_equity").alias("metric"), "period", F.lit("INR_CRORE").alias("unit"), (F.col("_a") + F.col("_b")).cast("decimal(20,4)").alias("value"))
    return mapped.select(key, "metric", "period", "unit", "value").unionByName(total)
