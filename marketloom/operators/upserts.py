"""Offers that arrive again: which one they are, and what of the old one stays.

An offer with an ``external_id`` is known by its store and that id. Any other
is known by its store, title, days and scope; such a row never replaces one
that has been locked by hand, and merges into one that has not, each column by
its own rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.sources.versioned import PART, SPREAD, VersionedTable

#: Columns of a written offer; all but the first are merged.
COLUMNS = ("offer_id", "product_id", "store_id", "title", "price_cents", "old_cents", "status", "is_verified", "confidence", "locked", "external_id", "valid_from", "valid_to", "coverage", "region", "city", "published_at", "updated_at")


def identity() -> Column:
    """What an offer is known by, as one hash of 16 bytes; two kinds that never meet."""
    external = F.nullif(F.trim(F.coalesce("external_id", F.lit(""))), F.lit(""))
    title = F.lower(F.trim(F.coalesce("title", F.lit(""))))
    scope = [F.coalesce(c, F.lit("")) for c in ("coverage", "region", "city")]
    parts = F.when(external.isNotNull(), F.struct(F.lit("external").alias("kind"), F.col("store_id").cast("string").alias("store"), F.array(external).alias("parts")))
    texts = F.array(title, F.col("valid_from").cast("string"), F.col("valid_to").cast("string"), *scope)
    known = parts.otherwise(F.struct(F.lit("text").alias("kind"), F.col("store_id").cast("string").alias("store"), texts.alias("parts")))
    return F.substring(F.unhex(F.sha2(F.to_json(known), 256)), 1, 16)


def _latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``o`` and ``n`` of each identity: of the rows that are not ``late``, and of those that are, that updated last, then of greatest id."""
    order = F.struct(F.coalesce("updated_at", F.lit("1900-01-01").cast("timestamp")), F.col("offer_id"))
    newest = lambda which: F.max_by(F.struct(*COLUMNS), F.when(which, order))
    return rows.groupBy(*keys).agg(newest(~F.col("late")).alias("o"), newest(F.col("late")).alias("n"))


def merged(old: DataFrame | None, new: DataFrame, part: Column | None = None) -> DataFrame:
    """``COLUMNS`` of all offers after ``new`` came: kept, merged or added; ``change`` says which, or that a lock kept one.

    Old and new rows move together, once. With ``part``, which equal identities
    share, they move by it, as the rows of a :meth:`VersionedTable.commit` do,
    which then has a column ``PART`` and need not move them again.
    """
    rows = new.select(*COLUMNS, F.lit(True).alias("late"))
    if old is not None:
        rows = old.select(*COLUMNS, F.lit(False).alias("late")).unionByName(rows)
    rows, keys = rows.withColumn("identity", identity()), ["identity"]
    if part is not None:
        rows = rows.withColumns({PART: part, "salt": F.pmod(F.xxhash64("identity"), F.lit(SPREAD)).cast("byte")}).repartition(PART, "salt")
        keys = [PART, "salt", "identity"]
    both = _latest(rows, keys)
    o, n = F.col("o"), F.col("n")
    external = F.trim(F.coalesce(n["external_id"], F.lit(""))) != ""
    change = F.when(n.isNull(), "kept").when(o.isNull(), "added").when(external, "replaced").when(F.coalesce(o["locked"], F.lit(False)), "locked").otherwise("merged")
    first = lambda c: F.coalesce(n[c], o[c])
    rules = {
        "offer_id": o["offer_id"],
        "product_id": first("product_id"),
        "old_cents": F.when(n["old_cents"] >= n["price_cents"], n["old_cents"]).when(o["old_cents"] >= n["price_cents"], o["old_cents"]),
        "status": F.when((n["status"] == "published") | (o["status"] == "published"), "published").otherwise(n["status"]),
        "is_verified": F.coalesce(o["is_verified"], F.lit(False)) | F.coalesce(n["is_verified"], F.lit(False)),
        "confidence": F.greatest(o["confidence"], n["confidence"]),
        "locked": o["locked"],
        "published_at": F.when(n["status"] == "published", first("published_at")).otherwise(o["published_at"]),
    }
    pick = lambda c: F.when(F.col("change").isin("kept", "locked"), o[c]).when(F.col("change") == "merged", rules.get(c, n[c])).otherwise(n[c]).alias(c)
    # A replaced offer keeps the id that others know it by.
    ident = F.when(F.col("change") == "added", n["offer_id"]).otherwise(o["offer_id"]).alias("offer_id")
    return both.withColumn("change", change).select(ident, *(pick(c) for c in COLUMNS[1:]), "change", *keys[:-2])


def write_offers(table: VersionedTable, new: DataFrame) -> int:
    """Merge ``new`` into a table divided by ``table.partition`` and commit the partitions that change; the new version.

    The offers of an identity share its days, so only the partitions of the new
    rows' own values are read and written, if it is divided by a part of the identity.
    """
    before = table.manifest()
    # Both kinds of identities have a store.
    part, columns = (table.value(), [*COLUMNS, PART]) if table.partition == "store_id" else (None, COLUMNS)
    if before["schema"] is None:
        return table.commit(merged(None, new, part).select(*columns))
    touched = {r[0] for r in new.select(table.value()).distinct().collect()}
    old = table.read(before["version"], lambda value: value in touched)
    return table.commit(merged(old, new, part).select(*columns), since=before["version"])
