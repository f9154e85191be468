"""Which offers hold at chosen branches.

Both sides are turned into scope keys, a hash of what a scope names, so that one
semi-join on equal keys takes the place of a condition with alternatives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions.text import fold


def _key(kind: str, store: str, place: Column) -> Column:
    """The key of a place of a store; null if the place has no name."""
    return F.when(F.coalesce(place, F.lit("")) != "", F.xxhash64(F.lit(kind), F.col(store).cast("string"), place))


def scope_key(scope: str = "coverage", store: str = "store_id", branch: str = "branch_id", city: str = "offer_city", region: str = "offer_region") -> Column:
    """The one key of an offer; no scope means everywhere, and a scope without its place, or an unknown one, nowhere (null)."""
    known = F.coalesce(F.nullif(F.lower(F.trim(F.col(scope))), F.lit("")), F.lit("national"))
    return (
        F.when(known == "national", F.xxhash64(F.lit("national")))
        .when(known == "city", _key("city", store, fold(F.col(city))))
        .when(known == "region", _key("region", store, fold(F.col(region))))
        .when(known == "store", _key("store", store, F.col(branch).cast("string")))
    )


def branch_keys(branches: DataFrame) -> DataFrame:
    """The keys that branches (``store_id``, ``branch_id``, ``city``, ``region``) fulfil, each once; "everywhere" always."""
    keys = F.array(_key("city", "store_id", fold(F.col("city"))), _key("region", "store_id", fold(F.col("region"))), _key("store", "store_id", F.col("branch_id").cast("string")))
    everywhere = branches.sparkSession.range(1).select(F.xxhash64(F.lit("national")).alias("scope_key"))
    return branches.select(F.explode(F.array_compact(keys)).alias("scope_key")).unionByName(everywhere).distinct()


def covered(offers: DataFrame, branches: DataFrame, **columns: str) -> DataFrame:
    """The ``offers`` that hold at one of the ``branches`` of their own store, or everywhere."""
    keyed = offers.withColumn("scope_key", scope_key(**columns))
    return keyed.join(branch_keys(branches), "scope_key", "left_semi").drop("scope_key")


def nearest_per_chain(branches: DataFrame) -> DataFrame:
    """The nearest branch (``metres``) of each chain (``store_id``)."""
    rest = [c for c in branches.columns if c != "store_id"]
    near = branches.groupBy("store_id").agg(F.min_by(F.struct(*rest), F.struct(F.coalesce("metres", F.lit(2**62)), "branch_id")).alias("near"))
    return near.select("store_id", "near.*")
