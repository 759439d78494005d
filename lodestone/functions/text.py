"""Text and number expressions. All of them are built-in functions; none leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that mean the same as plain ones. NFKC folding is limited to these and to
#: full-width forms, because Spark has no normalisation function.
CURLY, STRAIGHT = "‘’‚‛“”„‐‒–—―−", "''''\"\"\"------"
FULL_WIDTH = "".join(chr(0xFF01 + i) for i in range(94))
HALF_WIDTH = "".join(chr(0x21 + i) for i in range(94))
#: A rupee sign, "Rs", "INR", or the "h" that some extractors make of the sign before a number.
RUPEE = r"₹|\brs\b\.?|\binr\b|(?<![^\s(])h(?= ?\d)(?![12](?!\d|[,.]\d))"
#: Digits with Indian or Western grouping, or plain, and an optional fraction.
DIGITS = r"(?:\d{1,3}(?:,\d{2})*,\d{3}|\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?"
NUMBER_IN_TEXT = rf"(?<![\w.,])(?:\({DIGITS}\)|-?{DIGITS})(?!\d|[.,]\d)"
DECIMAL = "decimal(24,6)"


def prepare(text: Column) -> Column:
    """Lower case, with soft hyphens and words split at line ends joined and typographic marks made plain."""
    folded = F.lower(F.translate(F.translate(text, FULL_WIDTH, HALF_WIDTH), "   　", "    "))
    joined = F.regexp_replace(F.regexp_replace(folded, "­\\s*", ""), "[-‐][ \\t]*\\r?\\n\\s*(?=[a-z])", "")
    return F.translate(joined, CURLY, STRAIGHT)


def normalise(text: Column) -> Column:
    """The form in which a quote and its page are compared: prepared, without rupee marks, single spaces."""
    return collapse(F.regexp_replace(prepare(text), rf"(?:{RUPEE})\s*", ""))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _signed(number: Column) -> Column:
    plain = F.regexp_replace(number, r"[(),]", "")
    value = plain.try_cast(DECIMAL)
    return F.when(F.startswith(number, F.lit("(")), -value).otherwise(value)


def parse_number(text: Column) -> Column:
    """One printed number as a decimal: brackets are negative; %, /- and dollar signs go; null for anything else."""
    cleaned = F.regexp_replace(normalise(text), r"^(?:us\$|usd|\$)\s*", "")
    cleaned = F.trim(F.regexp_replace(F.trim(F.regexp_replace(cleaned, r"%$", "")), r"/-$", ""))
    return F.when(cleaned.rlike(rf"^(?:\({DIGITS}\)|-?{DIGITS})$"), _signed(cleaned))


def numbers_in(text: Column) -> Column:
    """Every number that stands on its own, in order."""
    return F.transform(F.regexp_extract_all(normalise(text), F.lit(NUMBER_IN_TEXT), F.lit(0)), _signed)


def numbers_in_prepared(prepared: Column) -> Column:
    """As numbers_in, of a text that prepare() has been applied to."""
    plain = collapse(F.regexp_replace(prepared, rf"(?:{RUPEE})\s*", ""))
    return F.transform(F.regexp_extract_all(plain, F.lit(NUMBER_IN_TEXT), F.lit(0)), _signed)


def printed_amount(digits: Column) -> Column:
    """A number that a pattern has cut out of a prepared text; null if its grouping is none."""
    return F.when(digits.rlike(rf"^(?:\({DIGITS}\)|-?{DIGITS})$"), _signed(digits))


def count_numbers(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\d[\d,]*(?:\.\d+)?"))


def visible_characters(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, r"\s+", ""))


def cut_at_word(text: Column, limit: int) -> Column:
    """At most limit characters, cut at a word unless a word ends there; spaces at the end go."""
    head = F.substring(text, 1, limit)
    at_end = F.substring(text, limit + 1, 1).rlike(r"^\s")
    whole = F.when(at_end | ~F.substring(head, 2, limit).contains(" "), head).otherwise(F.regexp_replace(head, r" [^ ]*$", ""))
    return F.when(F.char_length(text) <= limit, text).otherwise(F.rtrim(whole))


def cut_hard(text: Column, limit: int) -> Column:
    """At most limit characters, the last an ellipsis if something was cut."""
    return F.when(F.char_length(text) <= limit, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, limit - 1)), F.lit("…")))


def unescape_entities(text: Column) -> Column:
    """The entities that feeds use, decimal references to ASCII letters aside; an ampersand is decoded last."""
    out = text
    for name, value in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(value))
    return out


def escape_markup(text: Column) -> Column:
    """Text that unescape_entities() turns back into the given one, and in which no tag or CDATA section begins or ends."""
    for value, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(value), F.lit(name))
    return text


def strip_markup(text: Column) -> Column:
    return collapse(unescape_entities(F.regexp_replace(text, r"<[^>]*>", " ")))


def clean_page(text: Column) -> Column:
    """Text of a page without control characters, with single spaces and at most one empty line in a row."""
    plain = F.regexp_replace(F.translate(text, " ", " "), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    lines = F.regexp_replace(F.regexp_replace(plain, r"\r\n?", "\n"), r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(lines, r" ?\n ?", "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def canonical_url(url: Column) -> Column:
    """https with a lower-case host, without fragment and tracking parameters; null for other schemes, users or ports."""
    bare = F.trim(url)
    scheme, host = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.lower(F.regexp_extract(bare, r"^[^:/]+://(?:[^@/?#]*@)?([^:/?#]*)", 1))
    user, port = F.regexp_extract(bare, r"^[^:/]+://([^@/?#]*)@", 1), F.regexp_extract(bare, r"^[^:/]+://(?:[^@/?#]*@)?[^:/?#]*:(\d+)", 1)
    path, text = F.regexp_extract(bare, r"^[^:/]+://[^/?#]*([^?#]*)", 1), F.regexp_extract(bare, r"\?([^#]*)", 1)
    tracking = r"^(?i:utm_.*|fbclid|gclid|msclkid|mc_cid|mc_eid|igshid)$"
    kept = F.array_join(F.filter(F.split(text, "&"), lambda x: (x != "") & ~F.split_part(x, F.lit("="), F.lit(1)).rlike(tracking)), "&")
    usual = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    sound = scheme.isin("http", "https") & (host != "") & (user == "") & usual
    return F.when(sound, F.concat(F.lit("https://"), host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def title_hash(title: Column) -> Column:
    return F.sha2(collapse(F.lower(title)), 256)


def whole_word(text: Column, word: Column) -> Column:
    """Whether the text has the word, case ignored, not inside a longer word; the word is taken literally."""
    quoted = F.regexp_replace(word, r"([\\.\[\]{}()*+?^$|-])", r"\\$1")
    return F.regexp_like(text, F.concat(F.lit(r"(?i)(?<!\w)"), quoted, F.lit(r"(?!\w)")))


def first_tag(text: Column, patterns: list[tuple[str, tuple[str, str, str]]], otherwise: tuple[str, str, str]) -> Column:
    """The (type, sentiment, impact) of the first pattern that the text matches."""
    names = ("event_type", "sentiment", "impact")
    as_struct = lambda tag: F.struct(*[F.lit(v).alias(n) for n, v in zip(names, tag, strict=True)])
    out = as_struct(otherwise)
    for pattern, tag in reversed(patterns):
        out = F.when(text.rlike(pattern), as_struct(tag)).otherwise(out)
    return out


def reported_label(quote: Column) -> Column:
    """A source's own name for a figure: the words before the first number, without words that only lead to it."""
    head = F.split(quote, r"[\d₹(]", 2)[0]
    words = collapse(head)
    trimmed = F.regexp_replace(words, r"(?i)(?:^|(?<= ))(?:(?:rs\.?|inr|at|of|was|is|to|were|stood|by|\S)(?: |$))+$", "")
    label = F.substring(F.btrim(trimmed, F.lit(" :-,.")), 1, 80)
    return F.nullif(label, F.lit(""))


def without_markers(text: Column) -> Column:
    """Text without citation markers such as [F1, D2]."""
    return collapse(F.regexp_replace(text, r"\s*\[[FDMNE]\d+(?:,\s*[FDMNE]\d+)*\]", ""))


def protect_block(text: Column, name: str = "document") -> Column:
    """Text in which no tag of the wrapping block can open or close."""
    return F.regexp_replace(text, rf"(?i)<(?=\s*/?\s*{name}\b)", "&lt;")


def sentences(text: Column) -> Column:
    """Sentences with their end marks."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"[^.!?\n]+[.!?]*"), F.lit(0)), lambda s: F.trim(s)), lambda s: s != "")


def without_quotes(text: Column) -> Column:
    """Text without quoted passages; single quotes count from three words on."""
    return F.regexp_replace(F.regexp_replace(text, r"\"[^\"]*\"|“[^”]*”", " "), r"(?<!\w)'(?:\S+\s+){2,}\S+?'(?!\w)", " ")


def figure_pieces(text: Column) -> Column:
    """The text as pieces that are figures or not; joined they give the text again."""
    pattern = r"(?:₹\s?|US\$\s?|\$\s?)?\d[\d,]*(?:\.\d+)?%?"
    figures = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    pairs = F.flatten(F.transform(between, lambda b, i: F.array(b, F.coalesce(F.get(figures, i), F.lit("")))))
    return F.filter(pairs, lambda p: p != "")


def indian_grouping(value: Column, places: int = 0) -> Column:
    """A decimal with a final group of three digits and pairs before it: 12345678.5 gives 1,23,45,678.50."""
    rounded = F.round(F.abs(value), places)
    text = rounded.cast(f"decimal(30,{places})").cast("string")
    whole, fraction = F.split_part(text, F.lit("."), F.lit(1)), F.split_part(text, F.lit("."), F.lit(2))
    grouped = F.regexp_replace(whole, r"(\d)(?=(?:\d\d)+\d$)", "$1,")
    return F.concat(F.when(value < 0, "-").otherwise(""), grouped, F.when(fraction != "", F.concat(F.lit("."), fraction)).otherwise(""))


def plain_decimal(value: Column) -> Column:
    """A decimal without trailing zeros."""
    text = value.cast("string")
    return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def format_amount(value: Column, unit: Column) -> Column:
    """A value with its unit: rupees in Indian, dollars in Western grouping, percentages plain."""
    return (
        F.when(unit == "INR_CRORE", F.concat(F.lit("₹"), indian_grouping(value, 2), F.lit(" crore")))
        .when(unit == "INR_PER_SHARE", F.concat(F.lit("₹"), indian_grouping(value, 2), F.lit(" per share")))
        .when(unit == "USD_MILLION", F.concat(F.lit("US$"), F.format_number(value, 2), F.lit(" million")))
        .when(unit == "USD_PER_SHARE", F.concat(F.lit("US$"), F.format_number(value, 2), F.lit(" per share")))
        .when(unit == "PERCENT", F.concat(plain_decimal(value), F.lit("%")))
        .otherwise(plain_decimal(value))
    )


def signed_percent(value: Column) -> Column:
    return F.concat(F.when(value > 0, "+").otherwise(""), F.format_number(value, 1), F.lit("%"))
