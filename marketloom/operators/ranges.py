"""Joins and windows over ranges: overlaps, tolerances, spans of time, nearest known values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Tasks that make pairs within a tolerance.
PAIR_TASKS = 200


def overlapping(offers: DataFrame, key: list[str]) -> DataFrame:
    """How many others of the same ``key`` share a day with each offer, where there are any.

    Those that begin by its end, less those that were over before its start:
    counted from sorted days in one window, so no row is made for each two
    offers of a group, and offers are read and moved once. An ``offer_id`` names
    offers of one ``key`` only.
    """
    day = lambda c, ends: F.unix_date(c) * 2 + F.lit(int(ends))  # noqa: E731 - a day's starts stand before its ends
    sides = F.array(F.struct(day("valid_from", False).alias("at"), F.lit(False).alias("ends")), F.struct(day("valid_to", True).alias("at"), F.lit(True).alias("ends")))
    each = offers.select(*key, "offer_id", "valid_from", "valid_to").repartition(*key).select(*key, "offer_id", F.inline(sides))
    up_to = Window.partitionBy(*key).orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    begun, over = (F.sum(F.when(F.col("ends") == side, 1).otherwise(0)).over(up_to) for side in (False, True))
    seen = each.select(*key, "offer_id", "ends", begun.alias("begun"), over.alias("over"))
    counted = seen.groupBy(*key, "offer_id").agg((F.sum(F.when(F.col("ends"), F.col("begun")).otherwise(-F.col("over"))) - 1).alias("overlaps"))
    return counted.select("offer_id", "overlaps").where("overlaps > 0")


def within_tolerance(products: DataFrame, key: list[str], amount: str, percent: int) -> DataFrame:
    """Pairs of products of one ``key`` whose amounts differ by at most ``percent`` of the greater.

    Amounts are cut into bands as wide as the tolerance at their lower end, and
    only neighbouring bands meet. Every pair comes out, so the result grows with
    the square of a group of equal amounts; :func:`count_within_tolerance` gives
    counts instead. Little is read and very much made, so the number of tasks is
    given, not left to the bytes read.
    """
    band = F.floor(F.log(F.col(amount).cast("double")) / F.log(F.lit(1 + percent / 100))).cast("bigint")
    rows = products.where(F.col(amount) > 0).select(*key, "product_id", F.col(amount).alias("amount"), band.alias("band"))
    other = rows.select(*key, F.col("product_id").alias("other_id"), F.col("amount").alias("other_amount"), F.explode(F.array(*(F.col("band") + k for k in (-2, -1, 0, 1, 2)))).alias("band"))
    near = F.abs(F.col("amount") - F.col("other_amount")) * 100 <= F.greatest("amount", "other_amount") * percent
    rows, other = (x.repartition(PAIR_TASKS, *key, "band") for x in (rows, other))
    return rows.join(other, [*key, "band"]).where((F.col("product_id") < F.col("other_id")) & near).select("product_id", "other_id")


def count_within_tolerance(products: DataFrame, key: list[str], amount: str, percent: int) -> DataFrame:
    """``product_id`` and how many other products of its ``key`` have an amount within ``percent`` of the greater.

    Equal amounts are one node with a count; nodes meet in neighbouring bands,
    so what is joined grows with the different amounts, not with the products.
    """
    band = F.floor(F.log(F.col(amount).cast("double")) / F.log(F.lit(1 + percent / 100))).cast("bigint")
    rows = products.where(F.col(amount) > 0)
    nodes = rows.groupBy(*key, F.col(amount).alias("amount"), band.alias("band")).agg(F.count("*").alias("n"))
    other = nodes.select(*key, F.col("amount").alias("other"), F.col("n").alias("m"), F.explode(F.array(*(F.col("band") + k for k in (-2, -1, 0, 1, 2)))).alias("band"))
    near = F.abs(F.col("amount") - F.col("other")) * 100 <= F.greatest("amount", "other") * percent
    counted = nodes.join(other, [*key, "band"]).where(near).groupBy(*key, "amount").agg((F.sum("m") - 1).alias("alike"))
    return rows.select("product_id", *key, F.col(amount).alias("amount")).join(counted, [*key, "amount"]).select("product_id", "alike")


def in_the_last(events: DataFrame, seconds: int) -> DataFrame:
    """Each event with how many of its user came in the ``seconds`` up to it, itself included."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy(at).rangeBetween(-seconds * 1_000_000, Window.currentRow)
    return events.select("event_id", "user_id", F.count("*").over(w).alias("recent"))


def nearest_known(offers: DataFrame, key: list[str], value: str, order: list[str]) -> DataFrame:
    """``offer_id`` with the nearest value before and after that is not null."""
    w = Window.partitionBy(*key).orderBy(*order)
    before = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(value, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return offers.select("offer_id", before.alias("before"), after.alias("after"))


def upsert(old: DataFrame, new: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """The state after ``new``: a row replaces a verified one only if it is verified itself; nulls never replace a value."""
    a = old.select(*key, F.lit(True).alias("in_old"), *(F.col(c).alias(f"old_{c}") for c in ["is_verified", *values]))
    b = new.select(*key, F.lit(True).alias("in_new"), *(F.col(c).alias(f"new_{c}") for c in ["is_verified", *values]))
    takes = F.col("in_new").isNotNull() & (F.col("in_old").isNull() | F.col("new_is_verified") | ~F.col("old_is_verified"))
    pick = lambda c: F.when(takes, F.coalesce(f"new_{c}", f"old_{c}")).otherwise(F.col(f"old_{c}")).alias(c)
    return a.join(b, key, "full_outer").select(*key, pick("is_verified"), *map(pick, values))
