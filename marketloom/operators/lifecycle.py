"""Snapshots of a store's offers: publish, guard, expire, supersede and restore."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class GuardError(ValueError):
    """A new snapshot is too small to replace the present one."""


def guard(new: DataFrame, least: int) -> DataFrame:
    """``new``, if it has at least ``least`` rows; counted before anything is written."""
    n = new.count()
    if n < least:
        raise GuardError(f"{n} rows, {least} wanted: the present snapshot stays")
    return new


def diff(old: DataFrame, new: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """``key`` and ``change``: insert, update, keep or expire, by one full outer join."""
    a = old.select(*key, F.struct(*values).alias("_old"))
    b = new.select(*key, F.struct(*values).alias("_new"))
    change = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "expire").when(F.col("_old") == F.col("_new"), "keep").otherwise("update")
    return a.join(b, key, "full_outer").select(*key, change.alias("change"))


def publish(old: DataFrame, new: DataFrame, key: list[str], least: int) -> DataFrame:
    """The state after publishing ``new``: its rows, and old rows it lacks, expired."""
    guard(new, least)
    gone = old.join(new.select(*key), key, "left_anti").withColumn("status", F.lit("expired"))
    return new.withColumn("status", F.lit("published")).unionByName(gone)


def expire(offers: DataFrame, as_of: str) -> DataFrame:
    """Published offers whose last day has passed become expired."""
    over = (F.col("status") == "published") & (F.col("valid_to") < F.lit(as_of).cast("date"))
    return offers.withColumn("status", F.when(over, "expired").otherwise(F.col("status")))


def superseded(offers: DataFrame) -> DataFrame:
    """Offers that a later one of the same store and product replaces before they end."""
    w = Window.partitionBy("store_id", "product_id").orderBy("valid_from", "offer_id")
    later = offers.withColumns({"by_id": F.lead("offer_id").over(w), "_from": F.lead("valid_from").over(w)})
    return later.where(F.col("_from") <= F.col("valid_to")).select("offer_id", "by_id")


def snapshot_json(rows: DataFrame, key: str) -> DataFrame:
    """Rows as JSON text for the archive; :func:`restored` reads them back."""
    return rows.select(F.col(key), F.to_json(F.struct(*rows.columns)).alias("row"))


def restored(archive: DataFrame, like: DataFrame) -> DataFrame:
    return archive.select(F.from_json("row", like.schema).alias("r")).select("r.*")
