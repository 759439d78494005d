"""Rule-based matching of profiles to stocks: criteria, outcomes with their figures, and a status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import dims as d

#: Profiles that are matched at once, and events that a caution cites.
MAX_PROFILES, CAUTION_CITATIONS = 1000, 3
#: Criteria in the order in which reasons are listed.
CRITERIA = ("debt", "dividend", "revenue_growth", "profit_growth", "quality", "value", "momentum", "horizon")


def reason(criterion: str, preference: Column, outcome: Column, figure: Column, hard: Column | None = None) -> Column:
    return F.struct(
        F.lit(criterion).alias("criterion"),
        preference.alias("preference"),
        outcome.alias("outcome"),
        figure.cast("double").alias("figure"),
        F.coalesce(hard if hard is not None else F.lit(False), F.lit(False)).alias("hard"),
    )


def _judge(passed: Column) -> Column:
    return F.when(passed, "pass").otherwise("miss")


def reasons(wanted: Column) -> Column:
    """Reasons for one stock and one profile, in criterion order; only criteria that the profile asks for.

    The row has debt_status, debt, dividend, revenue_growth, profit_growth, roe, pe_status, pe, has_prices,
    return_6m, volatility, p1, p2, p3 (net profit of three consecutive years, oldest first, or null).
    """
    has = lambda value: F.array_contains(wanted, value)
    c = F.col
    hard, careful = has("avoid_high_debt"), has("conservative")
    debt = (
        F.when(c("debt_status") == "not_applicable", "not_assessable")
        .when((c("debt_status") != "ok") | c("debt").isNull(), "no_data")
        .when(hard & (c("debt") > d.DEBT_LIMIT), "fail")
        .when(~careful | (c("debt") <= d.CONSERVATIVE_DEBT), "pass")
        .otherwise("miss")
    )
    growth = lambda value, least: F.when(value.isNull(), "no_data").otherwise(_judge(value >= least))
    floor_style = F.when(has("stability"), "stability").when(careful, "conservative")
    chain = c("p1").isNotNull() & c("p2").isNotNull() & c("p3").isNotNull()
    before, after = F.round((c("p2") - c("p1")) / F.nullif(c("p1"), F.lit(0.0)) * 100, 1), F.round((c("p3") - c("p2")) / F.nullif(c("p2"), F.lit(0.0)) * 100, 1)
    earnings = F.when(~chain | (c("p1") <= 0) | (c("p2") <= 0), "no_data").otherwise(_judge(after > before))
    momentum = F.when(c("return_6m").isNotNull(), _judge(c("return_6m") >= 0)).otherwise(earnings)
    value = F.when(~c("has_prices"), "not_assessable").when(c("pe_status") == "no_figure", "no_data").when(c("pe").isNull(), "not_assessable").otherwise(_judge(c("pe") <= d.PE_MAX))
    # A long holding is judged where both horizons are asked for.
    horizon = F.when(has("long_term"), F.when(~chain, "no_data").otherwise(_judge((c("p1") <= c("p2")) & (c("p2") <= c("p3"))))).otherwise(
        F.when(c("volatility").isNull(), "no_data").otherwise(_judge(c("volatility") <= d.VOLATILITY_MAX))
    )
    candidates = [
        F.when(hard | careful, reason("debt", F.when(hard, "avoid_high_debt").otherwise("conservative"), debt, c("debt"), hard)),
        F.when(has("income"), reason("dividend", F.lit("income"), F.when(c("dividend").isNull(), "no_data").otherwise(_judge(c("dividend") > 0)), c("dividend"))),
        F.when(has("growth") | has("aggressive"), reason("revenue_growth", F.when(has("growth"), "growth").otherwise("aggressive"), growth(c("revenue_growth"), d.GROWTH_MIN), c("revenue_growth"))),
        F.when(has("growth"), reason("profit_growth", F.lit("growth"), growth(c("profit_growth"), d.GROWTH_MIN), c("profit_growth"))).when(
            floor_style.isNotNull(), reason("profit_growth", floor_style, growth(c("profit_growth"), d.NO_FALL_MIN), c("profit_growth"))
        ),
        F.when(has("quality"), reason("quality", F.lit("quality"), F.when(c("roe").isNull(), "no_data").otherwise(_judge(c("roe") >= d.ROE_MIN)), c("roe"))),
        F.when(has("value"), reason("value", F.lit("value"), value, c("pe"))),
        F.when(has("momentum"), reason("momentum", F.lit("momentum"), momentum, F.coalesce(c("return_6m"), after))),
        F.when(has("long_term") | has("short_term"), reason("horizon", F.when(has("long_term"), "long_term").otherwise("short_term"), horizon, F.when(has("long_term"), c("p3")).otherwise(c("volatility")))),
    ]
    return F.filter(F.array(*candidates), lambda r: r.isNotNull())


def status(found: Column) -> Column:
    """no_match on any failure; not_enough_data if a hard criterion has no data or nothing was judged; match if all that can be judged passed; else partial."""
    judged = F.exists(found, lambda r: r["outcome"].isin("pass", "miss", "fail"))
    return (
        F.when(F.exists(found, lambda r: r["outcome"] == "fail"), "no_match")
        .when(F.exists(found, lambda r: r["hard"] & (r["outcome"] == "no_data")), "not_enough_data")
        .when(~judged, "not_enough_data")
        .when(F.forall(found, lambda r: r["outcome"].isin("pass", "not_assessable")), "match")
        .otherwise("partial")
    )


def match_profiles(stocks: DataFrame, profiles: DataFrame) -> DataFrame:
    """Status, reasons and cautions of every stock for every profile.

    Profiles (profile_id, wanted) are few beside stocks and are broadcast; more than MAX_PROFILES are an error, to be matched in parts.
    A profile without wishes matches nothing for lack of data. Negative news (mood_label, mood_score and
    negative_events, newest first, of the row) is a caution that cites three events and leaves the status as it is.
    """
    if profiles.limit(MAX_PROFILES + 1).count() > MAX_PROFILES:
        raise ValueError(f"more than {MAX_PROFILES} profiles: match them in parts")
    pairs = stocks.join(F.broadcast(profiles))
    judged = pairs.withColumn("reasons", reasons(F.col("wanted")))
    caution = F.struct(F.lit("sentiment").alias("criterion"), F.col("mood_score").alias("figure"), F.slice("negative_events", 1, CAUTION_CITATIONS).alias("events"))
    cautions = F.filter(F.array(F.when(F.col("mood_label") == "negative", caution)), lambda c: c.isNotNull())
    return judged.select("profile_id", "stock_id", F.when(F.size("wanted") == 0, "not_enough_data").otherwise(status(F.col("reasons"))).alias("status"), "reasons", cautions.alias("cautions"))


def shared_reasons(matches: DataFrame) -> DataFrame:
    """Reasons that all stocks of a profile share, to be told once: profile_id, criterion, outcome.

    Each stock adds a row without a criterion, whose count is that of the profile's stocks, so that matches are made once.
    """
    told = F.transform("reasons", lambda r: F.struct(r["criterion"].alias("criterion"), r["outcome"].alias("outcome")))
    every = F.array(F.struct(F.lit(None).cast("string").alias("criterion"), F.lit(None).cast("string").alias("outcome")))
    rows = matches.select("profile_id", "stock_id", F.explode(F.concat(told, every)).alias("_r")).select("profile_id", "stock_id", "_r.criterion", "_r.outcome")
    counted = rows.groupBy("profile_id", "criterion", "outcome").agg(F.count_distinct("stock_id").alias("_have"))
    n = F.max(F.when(F.col("criterion").isNull(), F.col("_have"))).over(Window.partitionBy("profile_id"))
    return counted.withColumn("_n", n).where("criterion IS NOT NULL AND _have = _n").select("profile_id", "criterion", "outcome")


#: The card's values in order, with their units; those that are computed name their parts.
CARD = (
    ("market_cap", "INR_CRORE"), ("roe", "PERCENT"), ("pe_ttm", "RATIO"), ("eps_ttm", "INR_PER_SHARE"), ("pb", "RATIO"),
    ("dividend_yield", "PERCENT"), ("industry_pe", "RATIO"), ("book_value", "INR_PER_SHARE"), ("debt_to_equity", "RATIO"), ("face_value", "INR_PER_SHARE"),
)


def fundamentals_card(ratios: DataFrame) -> DataFrame:
    """Ten values of each stock as rows: stored, computed (price over P/E, price over book value) or not available.

    ratios: stock_id, market_cap, price, pe, book_value, dividend_yield, roe, face_value, debt_status, debt.
    """
    c = F.col
    over = lambda a, b: F.when(c(b) > 0, F.round(F.try_divide(c(a), c(b)), 2))
    values = {
        "market_cap": c("market_cap"), "roe": c("roe"), "pe_ttm": c("pe"), "eps_ttm": over("price", "pe"), "pb": over("price", "book_value"), "dividend_yield": c("dividend_yield"),
        "industry_pe": F.lit(None), "book_value": c("book_value"), "debt_to_equity": F.when(c("debt_status") == "ok", c("debt")), "face_value": c("face_value"),
    }
    rows = [F.struct(F.lit(i + 1).alias("place"), F.lit(name).alias("name"), values[name].cast("double").alias("value"), F.lit(unit).alias("unit")) for i, (name, unit) in enumerate(CARD)]
    cells = ratios.select("stock_id", "debt_status", F.explode(F.array(*rows)).alias("_c")).select("stock_id", "debt_status", "_c.*")
    computed = F.col("name").isin("eps_ttm", "pb", "debt_to_equity")
    state = F.when(F.col("value").isNotNull(), "ok").when((F.col("name") == "debt_to_equity") & (F.col("debt_status") == "not_applicable"), "not_applicable").otherwise("not_available")
    source = F.when(F.col("value").isNull(), "none").when(computed, "computed").otherwise("page")
    return cells.select("stock_id", "place", "name", state.alias("status"), "value", "unit", source.alias("source"))
