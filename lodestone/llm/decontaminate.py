"""Benchmark decontamination by templates: typed placeholders, hash-joined windows, consistent slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import cut, row_key
from lodestone.session import table

#: A token is a word or a number.
NUMBER = r"\p{N}+(?:[.,]\p{N}+)*"
TOKEN = rf"\p{{L}}[\p{{L}}\p{{M}}'’]*|{NUMBER}"
#: Words that count as units after a number.
UNITS = (
    "mm cm m km in inch inches ft foot feet yard yards mile miles g kg mg lb lbs oz pound pounds gram grams ton tons ml l litre litres liter liters "
    "s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
    "usd eur gbp dollar dollars euro euros cent cents percent kmh mph degrees"
).split()
#: Tokens in a window, and how many of them must be ordinary words.
WINDOW, LEAST_WORDS = 8, 4
#: Part of an item's tokens that matching windows must cover.
COVERAGE = 0.5
#: A benchmark of at most so many windows (some 100 MB) is broadcast; a larger one is shuffled.
BROADCAST_WINDOWS = 1_000_000


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def _template_tokens(text: Column) -> Column:
    """The same tokens with "0" for each number, which no word is."""
    return tokens(F.regexp_replace(text, NUMBER, "0"))


def _placeholder(name: str) -> Column:
    return F.xxhash64(F.lit(f"\x01{name}"))


def _hashes(raw: Column) -> Column:
    """A hash of each token of the plain template: words in lower case, placeholders for numbers and units after them."""

    def one(token: Column, i: Column) -> Column:
        unit = (F.get(raw, i - 1) == "0") & F.lower(token).isin(UNITS)
        return F.when(token == "0", _placeholder("number")).when(unit, _placeholder("unit")).otherwise(F.xxhash64(F.lower(token)))

    return F.transform(raw, one)


def _is_capital(token: Column) -> Column:
    return F.when(F.ascii(token) < 128, F.ascii(token).between(65, 90)).otherwise(token.rlike(r"^\p{Lu}"))


def _with_names(hashes: Column, raw: Column) -> Column:
    """The hashes with a placeholder for each name: a word that begins with a capital of any script and is no unit."""
    return F.transform(hashes, lambda h, i: F.when(_is_capital(F.get(raw, i)) & (h != _placeholder("unit")), _placeholder("name")).otherwise(h))


def _joined(left: Column, right: Column, by: int) -> Column:
    """Hash of each window of left with the one of right that begins by places later; null where there is none."""
    later = F.slice(right, by + 1, F.greatest(F.size(right), F.lit(0)))
    return F.zip_with(left, later, lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b)))


def _add_windows(df: DataFrame, hashes: str, widths: list[int]) -> DataFrame:
    """Add, for each width, the column hashes_width: the hash of the window at each place, null at the last width - 1 places."""
    df = df.withColumn(f"{hashes}_1", F.col(hashes))
    for size in (2, 4, 8):
        if size <= max(widths):
            half = F.col(f"{hashes}_{size // 2}")
            df = df.withColumn(f"{hashes}_{size}", _joined(half, half, size // 2))
    for width in widths:
        done = 0
        for size in (4, 2, 1):
            if width != WINDOW and width & size:
                part = F.col(f"{hashes}_{size}")
                found = part if not done else _joined(found, part, done)
                done += size
        if width in (3, 5, 6, 7):
            df = df.withColumn(f"{hashes}_{width}", found)
    return df


def _own_windows(windows: Column, words: Column, width: Column) -> Column:
    """An item's windows, null where fewer than LEAST_WORDS (half of a shorter item's) are ordinary words."""
    least = F.least(F.lit(LEAST_WORDS), F.greatest(F.floor(width / 2), F.lit(1)))
    enough = lambda i: F.aggregate(F.slice(words, i + 1, width), F.lit(0), lambda n, x: n + x) >= least
    return F.transform(F.slice(windows, 1, F.size(windows) - width + 1), lambda w, i: F.when(enough(i), w))


def _places(starts: Column, width: Column) -> Column:
    """Places that the windows which start at starts cover."""
    return F.array_distinct(F.flatten(F.transform(starts, lambda p: F.sequence(p, p + width - 1))))


def _n_covered(starts: Column, width: Column) -> Column:
    """How many places the windows which start at the (distinct) starts cover: each its width, or what is left before the next."""
    ordered = F.sort_array(starts)
    own = F.zip_with(ordered, F.slice(ordered, 2, F.greatest(F.size(starts), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, width), width))
    return F.aggregate(own, F.lit(0), lambda n, x: n + x)


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Pairs of a document and a benchmark item whose template the document holds.

    Numbers, names (words with a capital, wherever they stand) and units are placeholders, so an item with
    other values in them has the same template. A second, plain template has all words in lower case and no
    names, so that a text in capitals is found too; either finds a pair. Windows of WINDOW template tokens are
    hash-joined; items with fewer tokens are one window of their own length. A pair counts if its windows
    cover COVERAGE of the item's tokens, where only windows of consistent alignments count. An alignment (the
    windows of one distance between the places in document and item) is consistent if equal values of the item
    in the slots under its windows have equal values in the document; all consistent alignments add up, so
    ties need no order. Windows that repeat an earlier one of their item add nothing, so that an item of one
    phrase over and over meets a like text once for each of the text's places. The kind is "exact" if
    alignments whose values are all the same reach COVERAGE, else "reparameterised".

    Returns _k1 and _k2 (hashes of doc_id and text, for joining back), doc_id, item_id, n_windows, coverage, kind;
    other columns of docs and benchmark are not kept and clash with nothing. A null text has no tokens; an item
    without tokens matches nothing. Repeated rows give one pair; items that repeat an id are told apart by their
    text and give one pair together. The work on long texts and items grows in proportion to their length.
    """
    items = (
        benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("_item_text"))
        .distinct()
        .select("item_id", F.xxhash64("item_id", "_item_text").alias("_item"), tokens(F.col("_item_text")).alias("_item_raw"), _template_tokens(F.col("_item_text")).alias("_template"))
        .where(F.size("_item_raw") > 0)
        .withColumn("_width", F.least(F.size("_item_raw"), F.lit(WINDOW)))
        .withColumn("_plain", _hashes(F.col("_template")))
        .withColumn("_named", _with_names(F.col("_plain"), F.col("_template")))
    )
    # At most WINDOW numbers.
    widths = sorted({WINDOW} | {r["_width"] for r in items.select("_width").distinct().collect()})
    placeholders = [_placeholder(x) for x in ("number", "unit", "name")]
    for form in ("_plain", "_named"):
        items = _add_windows(items, form, widths).withColumn(f"{form}_words", F.transform(form, lambda h: (~h.isin(placeholders)).cast("int")))
        own = F.coalesce(*[F.when(F.col("_width") == w, F.col(f"{form}_{w}")) for w in widths])
        items = items.withColumn(f"{form}_own", _own_windows(own, F.col(f"{form}_words"), F.col("_width")))
    items = cut(
        items.select(
            "item_id",
            "_item",
            "_width",
            F.transform("_item_raw", lambda t, i: F.when(F.get(F.col("_named_words"), i) == 0, F.xxhash64(F.lower(t)))).alias("_values"),
            F.array(*[F.struct(F.lit(n).alias("form"), F.col(f"{form}_own").alias("own")) for n, form in enumerate(("_plain", "_named"))]).alias("_forms"),
        )
    )
    places = items.select("_item", "_width", F.explode("_forms").alias("_f")).select("_item", "_width", F.col("_f.form").alias("_form"), F.posexplode("_f.own").alias("_at", "_window"))
    known = places.where("_window IS NOT NULL").groupBy("_item", "_form", "_window").agg(F.min("_at").alias("_at"))
    # Places without a window of enough words count as such; repeats of a window do not.
    counted = known.select("_item", "_form", "_at").union(places.where("_window IS NULL").select("_item", "_form", "_at"))
    counted = counted.groupBy("_item", "_form").agg(F.collect_set("_at").alias("_starts"))
    sized = (
        items.select("item_id", F.col("_item").alias("_i"), "_width", "_values")
        .join(counted.withColumnsRenamed({"_item": "_c", "_form": "_f"}), F.col("_i") == F.col("_c"))
        .select("item_id", "_i", "_f", "_width", "_values", _n_covered(F.col("_starts"), F.col("_width")).alias("_to_cover"))
    )
    if known.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS:
        known = F.broadcast(known)
    keys = row_key(F.col(doc_id), F.col(text))
    hashed = docs.select(keys[0].alias("_k1"), keys[1].alias("_k2"), _template_tokens(F.col(text)).alias("_raw")).withColumn("_plain", _hashes(F.col("_raw")))
    hashed = hashed.withColumn("_named", _with_names(F.col("_plain"), F.col("_raw")))
    for form in ("_plain", "_named"):
        hashed = _add_windows(hashed, form, widths)
    # All lists are as long as the document, so that a place is what is left by its length. Items' windows without enough words are null, so only windows of enough words meet one.
    lists = F.concat(*[F.col(f"{form}_{w}") for w in widths for form in ("_plain", "_named")])
    seen = hashed.select("_k1", "_k2", F.size("_raw").alias("_n"), F.posexplode(lists).alias("_pos", "_seen")).where("_seen IS NOT NULL")
    hits = seen.join(known, F.col("_seen") == F.col("_window")).select("_k1", "_k2", "_item", "_form", "_at", (F.col("_pos") % F.col("_n") - F.col("_at")).alias("_shift"))
    aligned = hits.groupBy("_k1", "_k2", "_item", "_form", "_shift").agg(F.collect_set("_at").alias("_at"))
    covered = _n_covered(F.array_distinct(F.flatten(F.col("_alignments._at"))), F.col("_width"))
    pairs = aligned.groupBy("_k1", "_k2", "_item", "_form").agg(F.collect_list(F.struct("_shift", "_at")).alias("_alignments"))
    pairs = pairs.join(sized, (F.col("_item") == F.col("_i")) & (F.col("_form") == F.col("_f")))
    pairs = cut(pairs.withColumn("coverage", covered / F.col("_to_cover")).where(F.col("coverage") >= COVERAGE))
    # Only documents with such a pair are read again, for the values in their slots.
    texts = docs.select(keys[0].alias("_a"), keys[1].alias("_b"), F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    texts = texts.join(pairs.select(F.col("_k1").alias("_a"), F.col("_k2").alias("_b")).distinct(), ["_a", "_b"], "left_semi").dropDuplicates(["_a", "_b"])
    texts = texts.select("_a", "_b", "doc_id", F.transform(tokens(F.col("_text")), lambda t: F.xxhash64(F.lower(t))).alias("_found"))
    pairs = pairs.join(texts, (F.col("_k1") == F.col("_a")) & (F.col("_k2") == F.col("_b")))
    # A slot as the item's value and a hash of both values, for a consistent alignment has one of these for each of those.
    slots = lambda a: F.transform(
        F.filter(_places(a["_at"], F.col("_width")), lambda i: F.get(F.col("_values"), i).isNotNull()),
        lambda i: F.struct(F.get(F.col("_values"), i).alias("own"), F.get(F.col("_found"), i + a["_shift"]).alias("other")),
    )
    with_slots = F.transform("_alignments", lambda a: F.struct(a["_at"].alias("_at"), slots(a).alias("slots")))
    both = lambda a: F.transform(a["slots"], lambda s: F.xxhash64(s["own"], s["other"]))
    consistent = F.filter("_alignments", lambda a: F.size(F.array_distinct(a["slots"]["own"])) == F.size(F.array_distinct(both(a))))
    same = F.filter("_alignments", lambda a: F.forall(a["slots"], lambda s: s["own"] == s["other"]))
    kinds = (
        pairs.withColumn("_alignments", with_slots)
        .withColumn("_alignments", consistent)
        .withColumn("coverage", covered / F.col("_to_cover"))
        .where(F.col("coverage") >= COVERAGE)
        .withColumn("n_windows", F.size(F.array_distinct(F.flatten(F.col("_alignments._at")))).cast("long"))
        .withColumn("_same", same)
        .withColumn("kind", F.when(_n_covered(F.array_distinct(F.flatten(F.col("_same._at"))), F.col("_width")) / F.col("_to_cover") >= COVERAGE, "exact").otherwise("reparameterised"))
    )
    best_form = F.max(F.struct("coverage", "n_windows"))
    return kinds.groupBy("_k1", "_k2", "doc_id", "item_id").agg(best_form.alias("_best"), F.min("kind").alias("kind")).select("_k1", "_k2", "doc_id", "item_id", "_best.n_windows", "_best.coverage", "kind")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")).drop("_k1", "_k2")
