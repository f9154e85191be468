"""Reports on feeds, queues and jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def store_feeds(stores: DataFrame, offers: DataFrame, as_of: str) -> DataFrame:
    """Of each store: offers by state, the latest day, and whether the feed is missing, stale or fresh."""
    day = F.lit(as_of).cast("date")
    valid = (F.col("valid_to") >= day) & (F.col("valid_from") <= day)
    counted = offers.groupBy("store_id").agg(
        F.count_if((F.col("status") == "published") & F.col("is_verified") & valid).alias("live"),
        F.count_if(F.col("status") == "review").alias("in_review"),
        F.max(F.when(F.col("valid_from") <= day, F.col("valid_from"))).alias("latest"),
        F.bool_or(F.col("coverage") == "national").alias("has_national"),
    )
    rows = stores.select("store_id", "slug", "is_active").join(counted, "store_id", "left")
    state = F.when(~F.col("is_active"), "inactive").when(F.coalesce("live", F.lit(0)) == 0, "missing").when(F.datediff(day, "latest") > 7, "stale").otherwise("fresh")
    return rows.select("store_id", "slug", F.coalesce("live", F.lit(0)).alias("live"), F.coalesce("in_review", F.lit(0)).alias("in_review"), "latest", F.coalesce("has_national", F.lit(False)).alias("has_national"), state.alias("state"))


def automation(events: DataFrame) -> DataFrame:
    """By day: runs, failures, and failures in a thousand runs."""
    day = events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("runs"), F.count_if(F.col("event_type") == "error").alias("failed"), F.countDistinct("user_id").alias("sources"))
    return day.withColumn("failed_permille", F.expr("failed * 1000 div runs"))


def stale_jobs(events: DataFrame, now: str, minutes: int = 45) -> DataFrame:
    """Sources whose last event is older than ``minutes``."""
    last = events.groupBy("user_id").agg(F.max("ts").alias("last"))
    return last.where(F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("last") > minutes * 60).select("user_id", F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("last"))


def recent_views(events: DataFrame, most: int = 30) -> DataFrame:
    """Of each user the things last seen, at most ``most``, with how often."""
    from pyspark.sql import Window

    item = F.get_json_object("props", "$.k").cast("bigint")
    seen = events.where("event_type = 'view'").groupBy("user_id", item.alias("item")).agg(F.max("ts").alias("last"), F.count("*").alias("views"))
    w = Window.partitionBy("user_id").orderBy(F.desc("last"), "item")
    return seen.withColumn("place", F.row_number().over(w).cast("bigint")).where(F.col("place") <= most).select("user_id", "item", "views", "place")


def catalogue_coverage(cache: DataFrame) -> DataFrame:
    """Offers by filter group, and how many of them are discounted."""
    return cache.groupBy("filter_group").agg(F.count("*").alias("n"), F.count_if(F.col("old_cents") > F.col("price_cents")).alias("discounted"), F.countDistinct("store_id").alias("stores"))


def due(sources: DataFrame, now: Column) -> DataFrame:
    """Sources (``checked_at``, ``every_minutes``) to be read again: never read, or not for their interval (360 minutes unless said, 15 at least)."""
    every = F.greatest(F.lit(15), F.coalesce(F.nullif(F.col("every_minutes"), F.lit(0)), F.lit(360)))
    waited = F.unix_micros(now) - F.unix_micros(F.col("checked_at").cast("timestamp"))
    return sources.where(F.col("checked_at").isNull() | (waited >= every.cast("bigint") * 60_000_000))
