"""Price history: typical prices, deal scores and outliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def history(offers: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Prices seen in the ``days`` up to ``as_of``."""
    day = F.lit(as_of).cast("date")
    return offers.where((F.col("valid_from") <= day) & (F.col("valid_from") > F.date_sub(day, days))).select("product_id", "store_id", "price_cents", "valid_from")


def typical(offers: DataFrame, as_of: str) -> DataFrame:
    """Twice the 90-day median (so that it is whole), its minimum and that of 30 days, by product."""
    recent = F.col("valid_from") > F.date_sub(F.lit(as_of).cast("date"), 30)
    return history(offers, as_of).groupBy("product_id").agg(
        (F.median("price_cents") * 2).cast("bigint").alias("double_median"),
        F.min("price_cents").alias("min_90"),
        F.min(F.when(recent, F.col("price_cents"))).alias("min_30"),
        F.count("*").alias("seen"),
    )


def deal_label(price, double_median):
    """How a price compares with the typical one: 82, 94 and 106 hundredths part the labels."""
    ratio = price * 200
    return (
        F.when(double_median.isNull(), "unknown")
        .when(ratio <= double_median * 82, "great")
        .when(ratio <= double_median * 94, "good")
        .when(ratio <= double_median * 106, "usual")
        .otherwise("high")
    )


def deals(live: DataFrame, offers: DataFrame, as_of: str) -> DataFrame:
    """Live offers with four signals of 0 to 1000 and their weighted score, weights of missing signals left out."""
    t = typical(offers, as_of)
    market = live.groupBy("product_id").agg(F.max("price_cents").alias("dearest"))
    rows = live.select("offer_id", "product_id", "price_cents", "off_permille").join(t, "product_id", "left").join(market, "product_id")
    part = lambda of, weight: (F.when(of.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(1000), of))).cast("bigint"), weight)
    parts = [
        part(F.expr("500 + (double_median - 2 * price_cents) * 1000 div double_median"), 40),
        part(F.expr("(dearest - price_cents) * 1000 div dearest"), 25),
        part(F.col("off_permille"), 20),
        part(F.when(F.col("min_30").isNotNull(), F.when(F.col("price_cents") <= F.col("min_30"), 1000).otherwise(0)), 15),
    ]
    got = [F.coalesce(v, F.lit(0)) * w for v, w in parts]
    weight = [F.when(v.isNotNull(), w).otherwise(0) for v, w in parts]
    scored = rows.withColumns({"_got": sum(got[1:], got[0]), "_weight": sum(weight[1:], weight[0])})
    return scored.select("offer_id", F.expr("_got div _weight").alias("deal_score"), deal_label(F.col("price_cents"), F.col("double_median")).alias("deal"))


def without_outliers(offers: DataFrame, low: int = 40, high: int = 250, least: int = 3) -> DataFrame:
    """Offers but those whose price is far from the median of their store and product group of at least ``least``."""
    middle = offers.groupBy("store_id", "product_id").agg((F.median("price_cents") * 2).cast("bigint").alias("_m"), F.count("*").alias("_n"))
    joined = offers.join(middle, ["store_id", "product_id"])
    ratio = F.col("price_cents") * 200
    fits = (F.col("_n") < least) | ((ratio >= F.col("_m") * low) & (ratio <= F.col("_m") * high))
    return joined.where(fits).select(*offers.columns)


def unit_price_fits(price_cents, grams, printed_per_kg_cents, least_cents=30):
    """Whether a printed price by kilogram agrees with price and amount, to ``least_cents`` or 2 %; sources print with 30, 35 or 100."""
    computed = (price_cents * 1000 / grams).cast("bigint")
    return F.abs(computed - printed_per_kg_cents) <= F.greatest(F.lit(least_cents), printed_per_kg_cents * 2 / 100)
