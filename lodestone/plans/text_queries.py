"""Queries over text functions, on given texts and on figures written in many forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as t
from lodestone.plans.registry import query
from lodestone.session import table


#: An order's price in cents, and times ten thousand, in SQL; whole digits with commas by thousands, and by lakhs and crores.
_PRICE = "round(o_totalprice, 2)::DECIMAL(20,2)"


def grouped_sql(value: str) -> str:
    """A positive decimal of two places with Indian grouping, put together from its groups."""
    whole, last = f"floor({value})::BIGINT", "lpad(({w} % 1000)::VARCHAR, 3, '0')"
    pair = lambda d: f"lpad((({{w}} // {d}) % 100)::VARCHAR, 2, '0')"
    out = f"""CASE WHEN {{w}} < 1000 THEN {{w}}::VARCHAR WHEN {{w}} < 100000 THEN ({{w}} // 1000)::VARCHAR || ',' || {last}
  WHEN {{w}} < 10000000 THEN ({{w}} // 100000)::VARCHAR || ',' || {pair(1000)} || ',' || {last}
  WHEN {{w}} < 1000000000 THEN ({{w}} // 10000000)::VARCHAR || ',' || {pair(100000)} || ',' || {pair(1000)} || ',' || {last}
  ELSE ({{w}} // 1000000000)::VARCHAR || ',' || {pair(10000000)} || ',' || {pair(100000)} || ',' || {pair(1000)} || ',' || {last} END"""
    return "(" + out.replace("{w}", f"({whole})") + f" || '.' || lpad((({value} * 100)::BIGINT % 100)::VARCHAR, 2, '0'))"


@query(f"SELECT o_orderkey, CASE o_orderkey % 8 WHEN 1 THEN -p WHEN 6 THEN NULL WHEN 7 THEN NULL ELSE p END::DOUBLE AS value FROM (SELECT o_orderkey, {_PRICE} AS p FROM orders)")
def printed_numbers(spark, sf_dir):
    """T-02: each order's price in eight printed forms, read back."""
    price = F.round("o_totalprice", 2).cast("decimal(20,2)")
    indian = t.indian_grouping(price, 2)
    forms = [indian, F.concat(F.lit("("), indian, F.lit(")")), F.concat(price.cast("string"), F.lit("%")), F.concat(F.lit("US$ "), F.format_number(price, 2)), F.concat(price.cast("string"), F.lit("/-")), F.concat(F.lit("₹ "), indian), F.lit("n.a."), F.concat(price.cast("string"), F.lit(" 2"))]
    text = F.get(F.array(*forms), (F.col("o_orderkey") % 8).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", t.parse_number(text).cast("double").alias("value"))


@query(f"""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '₹' || {grouped_sql('v')} || ' crore' WHEN 1 THEN '₹' || {grouped_sql('p')} || ' per share' WHEN 2 THEN 'US$' || format('{{:,.2f}}', v::DOUBLE) || ' million'
  WHEN 3 THEN regexp_replace(p::VARCHAR, '\\.?0+$', '') || '%' ELSE '₹-' || {grouped_sql('v')} || ' crore' END AS shown FROM (SELECT o_orderkey, {_PRICE} AS p, (floor(o_totalprice) * (CASE WHEN o_orderkey % 3 = 0 THEN 10000 ELSE 1 END))::DECIMAL(20,2) AS v FROM orders)""")
def formatted_amounts(spark, sf_dir):
    """M-04, M-05: prices as amounts with their units; the sign follows the currency."""
    k = F.col("o_orderkey")
    price = F.round("o_totalprice", 2).cast("decimal(20,2)")
    whole = (F.floor("o_totalprice") * F.when(k % 3 == 0, 10000).otherwise(1)).cast("decimal(20,2)")
    unit = F.get(F.array(*map(F.lit, ["INR_CRORE", "INR_PER_SHARE", "USD_MILLION", "PERCENT", "INR_CRORE"])), (k % 5).cast("int"))
    value = F.when(k % 5 == 4, -whole).when((k % 5).isin(1, 3), price).otherwise(whole).cast("decimal(20,2)")
    return table(spark, sf_dir, "orders").select("o_orderkey", t.format_amount(value, unit).alias("shown"))


@query("""SELECT page_id, CASE WHEN regexp_matches(url, '^https?://') THEN 'https://' || lower(regexp_extract(url, '^[^:/]+://([^/?#:]*)', 1)) || regexp_extract(url, '^[^:/]+://[^/?#]*([^?#]*)', 1)
  || coalesce('?' || nullif(list_aggregate(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(split_part(x, '=', 1), '^(utm_.*|fbclid|gclid|msclkid|mc_cid|mc_eid|igshid)$')), 'string_agg', '&'), ''), '') END AS url FROM pages""")
def canonical_urls(spark, sf_dir):
    """T-09, P-12: canonical addresses without tracking."""
    return table(spark, sf_dir, "pages").select("page_id", t.canonical_url(F.col("url")).alias("url"))


@query("SELECT page_id, sha256(trim(regexp_replace(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))) AS h, length(trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))) AS n FROM pages")
def title_hashes(spark, sf_dir):
    """T-10, T-22: title hashes."""
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return table(spark, sf_dir, "pages").select("page_id", t.title_hash(title).alias("h"), F.char_length(t.collapse(title)).cast("long").alias("n"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[0-9][0-9,]*(?:\\.[0-9]+)?'))::BIGINT AS n_numbers, length(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]+', '', 'g')) AS visible FROM documents")
def text_counts(spark, sf_dir):
    """A-14, A-15: counts over texts."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", t.count_numbers(F.col("text")).cast("long").alias("n_numbers"), t.visible_characters(F.col("text")).cast("long").alias("visible"))


@query("SELECT doc_id, length(text) AS n, sha256(text) AS h FROM documents")
def figure_pieces(spark, sf_dir):
    """T-27: lossless split into figures and the rest."""
    joined = F.array_join(t.figure_pieces(F.col("text")), "")
    return table(spark, sf_dir, "documents").select("doc_id", F.char_length(joined).cast("long").alias("n"), F.sha2(joined, 256).alias("h"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 6 = 4 THEN NULL ELSE p_name END AS label FROM part")
def reported_labels(spark, sf_dir):
    """T-04: a source's own name of a figure: a part's name before its price, in six wordings."""
    n, price = F.col("p_name"), F.format_number("p_retailprice", 2)
    quotes = [F.concat(n, F.lit(" "), price), F.concat(n, F.lit(" at H "), price), F.concat(n, F.lit(" stood at Rs. "), price), F.concat(n, F.lit(" : ("), price, F.lit(")")), price, F.concat(n, F.lit(" was ₹"), price, F.lit(" after 5"))]
    return table(spark, sf_dir, "part").select("p_partkey", t.reported_label(F.get(F.array(*quotes), (F.col("p_partkey") % 6).cast("int"))).alias("label"))


_RUNS = "[ \\t\\n\\x0b\\f\\r]+"


@query(f"""WITH c AS (SELECT conv_id, turn, text, trim(regexp_replace(text, '{_RUNS}', ' ', 'g')) AS flat FROM conversations)
SELECT conv_id, turn, sha256(flat) AS markers, sha256(text || ' &lt;/document> &lt; Document') AS block, sha256(lower(flat)) AS normal,
  CASE WHEN length(text) <= 60 THEN text ELSE rtrim(CASE WHEN regexp_matches(substr(text, 61, 1), '^[ \\t\\n\\x0b\\f\\r]') OR NOT contains(substr(text, 2, 59), ' ') THEN left(text, 60) ELSE regexp_replace(left(text, 60), ' [^ ]*$', '') END, ' ') END AS cut,
  CASE WHEN length(text) <= 30 THEN text ELSE rtrim(left(text, 29), ' ') || '…' END AS hard FROM c""")
def text_cleaning(spark, sf_dir):
    """T-01, T-06, T-07, T-23, T-24: messages with markers, closing tags, broken words and typographic marks put in, and cleaned of them."""
    x = F.col("text")
    marked = F.concat(F.regexp_replace(x, "([.,])", " [F1, D2]$1"), F.lit(" [N3]"))
    broken = F.replace(F.replace(x, F.lit("th"), F.lit("t-\nh")), F.lit("en"), F.lit("e\u00adn"))
    return table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        F.sha2(t.without_markers(marked), 256).alias("markers"),
        F.sha2(t.protect_block(F.concat(x, F.lit(" </document> < Document"))), 256).alias("block"),
        F.sha2(t.normalise(broken), 256).alias("normal"),
        t.cut_at_word(x, 60).alias("cut"),
        t.cut_hard(x, 30).alias("hard"),
    )


@query(f"""SELECT page_id, sha256(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&apos;', chr(39)), '&nbsp;', ' '), '&amp;', '&'), '{_RUNS}', ' ', 'g'))) AS text FROM pages""")
def stripped_pages(spark, sf_dir):
    """T-08: pages without tags, entities decoded, single spaces."""
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(t.strip_markup(F.col("html")), 256).alias("text"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(text, '^The ') THEN 'annual' WHEN regexp_matches(text, '^[A-M]') THEN 'early' ELSE 'late' END AS kind, nullif(regexp_extract(text, '([0-9]{4})', 1), '') AS year FROM documents""")
def pattern_backfill(spark, sf_dir):
    """T-26, P-05: kind and year from patterns."""
    x = F.col("text")
    kind = F.when(x.rlike("^The "), "annual").when(x.rlike("^[A-M]"), "early").otherwise("late")
    return table(spark, sf_dir, "documents").select("doc_id", kind.alias("kind"), F.nullif(F.regexp_extract(x, "([0-9]{4})", 1), F.lit("")).alias("year"))
