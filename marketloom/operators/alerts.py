"""Price alerts and favourites: who is told of which offer, once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RETRY_HOURS, ATTEMPTS, PAUSE_MINUTES = 6, 5, 5


def merged_alerts(alerts: DataFrame) -> DataFrame:
    """One alert for each user, product and store (null: any), with the greatest target."""
    return alerts.groupBy("user_id", "product_id", "store_id").agg(F.max("target_cents").alias("target_cents"), F.count("*").alias("merged"))


def price_matches(alerts: DataFrame, live: DataFrame) -> DataFrame:
    """Offers at or below an alert's target: equality on the product, the rest as residual conditions."""
    a, o = alerts.alias("a"), live.select("offer_id", "product_id", F.col("store_id").alias("at"), "price_cents").alias("o")
    fits = (F.col("a.product_id") == F.col("o.product_id")) & (F.col("price_cents") <= F.col("target_cents")) & (F.col("a.store_id").isNull() | (F.col("a.store_id") == F.col("at")))
    return a.join(o, fits).select("user_id", F.col("o.product_id").alias("product_id"), "offer_id", "price_cents")


def favourite_matches(favourites: DataFrame, live: DataFrame) -> DataFrame:
    """Discounted offers of a user's favourites."""
    found = live.where("off_permille > 0").select("offer_id", "product_id", "price_cents")
    return favourites.join(found, "product_id").select("user_id", "product_id", "offer_id", "price_cents").distinct()


def unsent(matches: DataFrame, sent: DataFrame) -> DataFrame:
    """Matches not told before, by user, offer and price; so a replay sends nothing twice."""
    return matches.join(sent, ["user_id", "offer_id", "price_cents"], "left_anti")


def retryable(deliveries: DataFrame, now) -> DataFrame:
    """Failed deliveries young enough, tried less than ``ATTEMPTS`` times and not just now."""
    age = F.unix_timestamp(now) - F.unix_timestamp("ts")
    return deliveries.where((age <= RETRY_HOURS * 3600) & (age >= PAUSE_MINUTES * 60) & (F.col("attempts") < ATTEMPTS))
