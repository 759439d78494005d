"""Ranks, weights, vocabularies and thresholds that results depend on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of source, the most trusted first.
SOURCES = ("annual_report", "screener", "presentation", "transcript", "announcement")
#: Bases and currencies, the preferred first; None stands for figures without a currency.
BASES = ("consolidated", "standalone", "unspecified")
CURRENCIES = ("INR", "USD", None)
#: Figures within this part of the chosen one agree with it.
AGREEMENT = 0.01
IMPACT_WEIGHT = {"low": 1, "medium": 2, "high": 3}
SENTIMENT_VALUE = {"negative": -1, "neutral": 0, "positive": 1}
#: Sentiment scores from here up are positive, from minus this down negative.
LABEL_AT = 0.25
#: Metrics in display order: kind of value, and which companies have them.
METRICS = {
    "revenue_from_operations": ("amount", "non_financial"),
    "net_interest_income": ("amount", "bank"),
    "net_profit": ("amount", "all"),
    "total_borrowings": ("amount", "non_financial"),
    "total_equity": ("amount", "all"),
    "dividend_per_share": ("per_share", "all"),
    "eps_basic": ("per_share", "all"),
    "return_on_equity": ("percent", "all"),
    "net_interest_margin": ("percent", "bank"),
    "gross_npa_ratio": ("percent", "bank"),
}
#: Matching thresholds.
DEBT_LIMIT, CONSERVATIVE_DEBT, GROWTH_MIN, NO_FALL_MIN, ROE_MIN, PE_MAX, VOLATILITY_MAX = 1.0, 0.5, 10.0, 0.0, 15.0, 20.0, 30.0
#: A price step of more than this against the exchange's previous close is a corporate action.
ACTION_TOLERANCE, FACTOR_PLACES, TRADING_DAYS, MIN_RETURNS = 0.01, 4, 252, 60
#: Retrieval: candidates, passages of a document, weights of the bonuses.
CANDIDATES, MAX_PER_DOCUMENT, RECENCY_WEIGHT, PROFILE_WEIGHT = 50, 2, 0.02, 0.02
MIN_SIMILARITY = 0.35


def rank_of(column: Column, values: tuple) -> Column:
    """Place of the value in values; one past the end for others. Null finds None."""
    out = F.lit(len(values))
    for i, value in reversed(list(enumerate(values))):
        out = F.when(column.eqNullSafe(F.lit(value)), i).otherwise(out)
    return out


def lookup(column: Column, values: dict) -> Column:
    """The value under the column's key; null for other keys."""
    out = F.lit(None)
    for key, value in values.items():
        out = F.when(column == key, F.lit(value)).otherwise(out)
    return out
