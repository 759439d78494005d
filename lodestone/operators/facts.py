"""Facts from ranked sources: conflict resolution, ratios, growth, views; every result carries its facts' ids.

A fact has id, stock_id, metric, period, basis, currency (may be null), unit, value (decimal), source and
source_date. All operators take facts of all stocks at once and are lazy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.periods import fiscal_quarter, fiscal_year
from lodestone.operators.dims import AGREEMENT, BASES, CURRENCIES, METRICS, SOURCES, rank_of
from lodestone.operators.rank import winner_per_group

KEY = ["stock_id", "metric", "period", "basis", "currency"]


def agrees(value: Column, with_value: Column) -> Column:
    return F.abs(value - with_value) <= F.abs(with_value) * F.lit(AGREEMENT).cast("decimal(3,2)")


def choose_facts(facts: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """One fact for each key: the best-ranked source, then the latest source date (null oldest), then the largest id.

    Adds corroborated_by (other figures within 1 % of the chosen one), disagreeing (ids of the rest, in
    order) and status: single, agreed or disputed. One shuffle on the key; null currencies are a key.
    """
    others = [c for c in facts.columns if c not in keys]
    preference = F.struct(-rank_of(F.col("source"), SOURCES), "source_date", "id")
    grouped = facts.groupBy(*keys).agg(
        F.max_by(F.struct(*others), preference).alias("_best"),
        F.collect_list(F.struct("id", "value")).alias("_all"),
    )
    rivals = F.filter("_all", lambda x: x["id"] != F.col("_best.id"))
    far = F.filter(rivals, lambda x: ~agrees(x["value"], F.col("_best.value")))
    out = grouped.withColumns({"_rivals": rivals, "_far": far}).select(
        *keys,
        "_best.*",
        (F.size("_rivals") - F.size("_far")).alias("corroborated_by"),
        F.sort_array(F.transform("_far", lambda x: x["id"])).alias("disagreeing"),
    )
    status = F.when(F.size("disagreeing") > 0, "disputed").when(F.col("corroborated_by") > 0, "agreed").otherwise("single")
    return out.withColumn("status", status)


def with_period(facts: DataFrame) -> DataFrame:
    return facts.withColumns({"year": fiscal_year(F.col("period")), "quarter": fiscal_quarter(F.col("period"))}).where("year IS NOT NULL")


def _preferred(*columns: tuple[str, tuple]) -> list[Column]:
    return [-rank_of(F.col(c), values) for c, values in columns]


def debt_to_equity(facts: DataFrame, stocks: DataFrame) -> DataFrame:
    """Total borrowings over total equity of the latest full year that has both in INR and in one unit.

    stocks: stock_id, is_financial. Status is not_applicable for financial companies, not_assessable
    without such a year or where equity is not positive (older years are not tried then), else ok.
    """
    chosen = with_period(choose_facts(facts.where(F.col("metric").isin("total_borrowings", "total_equity")))).where("quarter = 0 AND currency = 'INR'")
    side = lambda metric, p: chosen.where(F.col("metric") == metric).select("stock_id", "year", "basis", "unit", F.col("id").alias(f"{p}_id"), F.col("value").alias(p))
    pairs = side("total_borrowings", "debt").join(side("total_equity", "equity"), ["stock_id", "year", "basis", "unit"])
    best = winner_per_group(pairs, ["stock_id"], [F.col("year"), *_preferred(("basis", BASES))])
    found = stocks.select("stock_id", "is_financial").join(best, "stock_id", "left")
    status = F.when(F.col("is_financial"), "not_applicable").when(F.col("equity") > 0, "ok").otherwise("not_assessable")
    ratio = F.when(F.col("status") == "ok", F.round(F.try_divide("debt", "equity"), 2))
    ids = F.when(F.col("is_financial") | F.col("debt_id").isNull(), F.array().cast("array<bigint>")).otherwise(F.array("debt_id", "equity_id"))
    return found.withColumn("status", status).select("stock_id", "status", ratio.alias("value"), "year", "basis", ids.alias("fact_ids"))


def _per_source(facts: DataFrame) -> DataFrame:
    return with_period(choose_facts(facts, [*KEY, "source"]))


_SERIES = ("stock_id", "metric", "source", "basis", "currency", "unit", "quarter")


def _with_earlier(chosen: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """The figures of the years right before, one for each name, in the same series; null where a year is missing.

    One window over each series, in which a year occurs once, instead of a self-join for each year.
    """
    order = Window.partitionBy(*_SERIES).orderBy("year")
    fields = F.struct("value", "id", "period", "year")
    rows = chosen.withColumns({f"_{n}": F.lag(fields, back).over(order) for back, n in enumerate(names, 1)})
    for back, n in enumerate(names, 1):
        there = F.col(f"_{n}.year") == F.col("year") - back
        rows = rows.withColumns({c: F.when(there, F.col(f"_{n}.{f}")) for c, f in ((n, "value"), (f"{n}_id", "id"), (f"{n}_period", "period"))})
    return rows.drop(*[f"_{n}" for n in names])


def growth_yoy(facts: DataFrame) -> DataFrame:
    """Change of each metric over a year, both figures from one kind of source, in percent.

    Of all pairs the preferred one counts: a full year over a quarter, then the latest, then the
    better basis, source and currency. A prior value that is not positive is not_assessable.
    """
    return _growth(_with_earlier(_per_source(facts), ("prior",)))


def _growth(rows: DataFrame) -> DataFrame:
    pairs = rows.where("prior_id IS NOT NULL")
    order = [F.col("quarter") == 0, F.col("year"), F.col("quarter"), *_preferred(("basis", BASES), ("source", SOURCES), ("currency", CURRENCIES))]
    best = winner_per_group(pairs, ["stock_id", "metric"], order)
    change = F.when(F.col("prior") > 0, F.round(F.try_divide(F.col("value") - F.col("prior"), F.col("prior")) * 100, 1))
    status = F.when(F.col("prior") > 0, "ok").otherwise("not_assessable")
    return best.select(
        "stock_id", "metric", status.alias("status"), change.alias("value"), "prior_period", "period", "basis", "source", F.array("prior_id", "id").alias("fact_ids")
    )


def growth_chain(facts: DataFrame) -> DataFrame:
    """The latest three consecutive full years of a metric from one source, basis, currency and unit."""
    chains = _with_earlier(_per_source(facts).where("quarter = 0"), ("middle", "oldest")).where("middle_id IS NOT NULL AND oldest_id IS NOT NULL")
    best = winner_per_group(chains, ["stock_id", "metric"], [F.col("year"), *_preferred(("basis", BASES), ("source", SOURCES), ("currency", CURRENCIES))])
    return best.select(
        "stock_id", "metric", "year", "basis", "source", "unit", F.col("oldest").alias("first_value"), F.col("middle").alias("middle_value"), F.col("value").alias("latest_value"),
        F.array("oldest_id", "middle_id", "id").alias("fact_ids"),
    )


def latest_dividend(facts: DataFrame, metric: str = "dividend_per_share") -> DataFrame:
    """The latest full year's dividend, INR first, then the better basis. Stocks without one have no row."""
    chosen = with_period(choose_facts(facts.where(F.col("metric") == metric))).where("quarter = 0")
    best = winner_per_group(chosen, ["stock_id"], [F.col("year"), *_preferred(("currency", CURRENCIES), ("basis", BASES))])
    return best.select("stock_id", F.lit("ok").alias("status"), "value", "period", "unit", F.array("id").alias("fact_ids"))


def view_rank(basis: Column, currency: Column) -> Column:
    """Order of the views of a metric: by currency, then by basis."""
    return rank_of(currency, CURRENCIES) * len(BASES) + rank_of(basis, BASES)


def key_facts(facts: DataFrame, years: int = 3) -> DataFrame:
    """The latest full years of each metric in the first view (currency and basis) that has any."""
    annual = with_period(choose_facts(facts)).where("quarter = 0").withColumn("view", view_rank(F.col("basis"), F.col("currency")))
    by_metric = Window.partitionBy("stock_id", "metric")
    shown = annual.withColumn("place", F.row_number().over(by_metric.orderBy("view", F.desc("year")))).withColumn("_first", F.min("view").over(by_metric))
    return shown.where((F.col("view") == F.col("_first")) & (F.col("place") <= years)).drop("_first")


def metric_order(metric: Column) -> Column:
    return rank_of(metric, tuple(METRICS))


def derived_views(facts: DataFrame, stocks: DataFrame) -> DataFrame:
    """Four values for each stock: debt to equity, top-line growth, profit growth, latest dividend.

    The top line of a financial company is net interest income. A value without data has status
    not_assessable (insufficient_data for the dividend) and no ids.
    """
    names = stocks.select("stock_id", "is_financial")
    growth = growth_yoy(facts.where(F.col("metric").isin("revenue_from_operations", "net_interest_income", "net_profit")))
    top = F.when(F.col("is_financial"), "net_interest_income").otherwise("revenue_from_operations")
    empty = F.array().cast("array<bigint>")

    lines = F.array(F.struct(F.lit(2).alias("place"), F.lit("revenue_growth").alias("name"), top.alias("metric")), F.struct(F.lit(3).alias("place"), F.lit("profit_growth").alias("name"), F.lit("net_profit").alias("metric")))
    wanted = names.select("stock_id", F.explode(lines).alias("_l")).select("stock_id", "_l.*")
    grown = wanted.join(growth, ["stock_id", "metric"], "left").select(
        "stock_id", "place", "name", F.coalesce("status", F.lit("not_assessable")).alias("status"), F.col("value").cast("decimal(38,4)").alias("value"), F.coalesce("fact_ids", empty).alias("fact_ids")
    )
    debt = debt_to_equity(facts, stocks).select("stock_id", F.lit(1).alias("place"), F.lit("debt_to_equity").alias("name"), "status", F.col("value").cast("decimal(38,4)").alias("value"), "fact_ids")
    paid = names.join(latest_dividend(facts), "stock_id", "left")
    paid = paid.select("stock_id", F.lit(4).alias("place"), F.lit("latest_dividend").alias("name"), F.coalesce("status", F.lit("insufficient_data")).alias("status"), F.col("value").cast("decimal(38,4)").alias("value"), F.coalesce("fact_ids", empty).alias("fact_ids"))
    return debt.unionByName(grown).unionByName(paid)


def measure_facts(facts: DataFrame, years: int = 3) -> DataFrame:
    """The latest full years of each metric in its first view, from the best source that has them all.

    Where no source has all wanted years, each year's own best figure counts. rivals are the best
    figures of other sources beyond 1 %; agreeing counts those within.
    """
    view = facts.withColumn("view", view_rank(F.col("basis"), F.col("currency")))
    annual = with_period(view).where("quarter = 0")
    first = annual.groupBy("stock_id", "metric").agg(F.min("view").alias("view"))
    rows = annual.join(first, ["stock_id", "metric", "view"])
    wanted_order = Window.partitionBy("stock_id", "metric").orderBy(F.desc("year"))
    rows = rows.withColumn("_newest", F.dense_rank().over(wanted_order)).where(F.col("_newest") <= years)
    best = choose_facts(rows, ["stock_id", "metric", "year", "source"]).withColumn("_rank", rank_of(F.col("source"), SOURCES))
    n_wanted = best.groupBy("stock_id", "metric").agg(F.count_distinct("year").alias("_wanted"))
    whole = best.groupBy("stock_id", "metric", "_rank").agg(F.count_distinct("year").alias("_have")).join(n_wanted, ["stock_id", "metric"]).where("_have = _wanted")
    whole = whole.groupBy("stock_id", "metric").agg(F.min("_rank").alias("_whole"))
    by_year = best.join(whole, ["stock_id", "metric"], "left")
    grouped = by_year.groupBy("stock_id", "metric", "year").agg(
        F.min_by(F.struct("id", "value", "source", "unit", "basis", "currency", "period"), F.struct(F.when(F.col("_rank") == F.col("_whole"), 0).otherwise(1), F.col("_rank"))).alias("_best"),
        F.collect_list(F.struct("_rank", "id", "value", "source")).alias("_all"),
    )
    others = F.filter(F.sort_array("_all"), lambda x: x["source"] != F.col("_best.source"))
    rivals = F.filter(others, lambda x: ~agrees(x["value"], F.col("_best.value")))
    out = grouped.withColumns({"_others": others, "_rivals": rivals})
    status = F.when(F.size("_rivals") > 0, "disputed").when(F.size("_others") > 0, "agreed").otherwise("single")
    return out.select("stock_id", "metric", "year", "_best.*", status.alias("status"), (F.size("_others") - F.size("_rivals")).alias("agreeing"), F.transform("_rivals", lambda x: x["id"]).alias("rival_ids"))


def change_views(measured: DataFrame) -> DataFrame:
    """Change between each two neighbouring periods of a measure, if they are of one source, basis, currency and unit."""
    order = Window.partitionBy("stock_id", "metric").orderBy("year")
    before = {f"prior_{c}": F.lag(c).over(order) for c in ("id", "value", "period", "source", "basis", "currency", "unit")}
    pairs = measured.withColumns(before).where(
        (F.col("source") == F.col("prior_source")) & (F.col("basis") == F.col("prior_basis")) & (F.col("unit") == F.col("prior_unit")) & F.col("currency").eqNullSafe(F.col("prior_currency"))
    )
    ok = F.col("prior_value") > 0
    change = F.when(ok, F.round(F.try_divide(F.col("value") - F.col("prior_value"), F.col("prior_value")) * 100, 1))
    return pairs.select(
        "stock_id", "metric", "prior_period", "period", F.when(ok, "ok").otherwise("not_assessable").alias("status"), change.alias("value"),
        F.when(ok, F.col("value") - F.col("prior_value")).alias("difference"),
    )


def series(facts: DataFrame, metric: str, points: int = 10) -> DataFrame:
    """Up to ten latest full years of one metric, from one source and view: that with the most points, then the best rank."""
    chosen = _per_source(facts.where(F.col("metric") == metric)).where("quarter = 0").withColumn("view", view_rank(F.col("basis"), F.col("currency")))
    sizes = chosen.groupBy("stock_id", "view", "source").agg(F.count(F.lit(1)).alias("n"))
    best = sizes.groupBy("stock_id").agg(F.max_by(F.struct("view", "source"), F.struct("n", -F.col("view"), -rank_of(F.col("source"), SOURCES))).alias("_b")).select("stock_id", "_b.*")
    rows = chosen.join(best, ["stock_id", "view", "source"])
    latest = rows.withColumn("_n", F.row_number().over(Window.partitionBy("stock_id").orderBy(F.desc("year")))).where(F.col("_n") <= points)
    return latest.select("stock_id", "period", "value", "unit", "source")


def pivot_years(facts: DataFrame, years: list[int]) -> DataFrame:
    """Key facts as one row for each stock and metric, a column for each year."""
    shown = key_facts(facts, len(years))
    return shown.groupBy("stock_id", "metric").pivot("year", years).agg(F.first("value")).select("stock_id", "metric", *[F.col(str(y)).alias(f"fy{y}") for y in years])


def metrics_panel(facts: DataFrame) -> DataFrame:
    """The newest full year of each metric, the better basis on a tie, with its growth where there is one."""
    chosen = with_period(choose_facts(facts)).where("quarter = 0")
    newest = winner_per_group(chosen, ["stock_id", "metric"], [F.col("year"), *_preferred(("basis", BASES), ("currency", CURRENCIES))])
    growth = growth_yoy(facts).select("stock_id", "metric", F.col("value").alias("growth"))
    return newest.join(growth, ["stock_id", "metric"], "left").select("stock_id", "metric", "period", "basis", "value", "growth")

