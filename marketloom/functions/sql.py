"""The functions of the offer domain under names in SQL, for one session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marketloom.functions.text import ACCENTED, PLAIN

_FOLD = f"trim(regexp_replace(translate(lower(t), '{ACCENTED}', '{PLAIN}'), '[^a-z0-9]+', ' '))"
#: Name, parameters, type and body of each scalar function.
SCALARS = {
    "fold_text": ("t STRING", "STRING", _FOLD),
    "slug_text": ("t STRING", "STRING", "replace(fold_text(t), ' ', '-')"),
    "text_trigrams": (
        "t STRING",
        "ARRAY<STRING>",
        "array_distinct(flatten(transform(filter(split(fold_text(t), ' '), w -> w <> ''), w -> transform(sequence(1, length(w) + 1), i -> substring(concat('  ', w, ' '), i, 3)))))",
    ),
    "similarity_permille": (
        "a STRING, b STRING",
        "BIGINT",
        "coalesce(bigint(floor(try_divide(size(array_intersect(text_trigrams(a), text_trigrams(b))) * 1000, size(array_union(text_trigrams(a), text_trigrams(b)))))), 0L)",
    ),
    "off_permille": ("price BIGINT, old BIGINT", "BIGINT", "CASE WHEN old > price THEN (old - price) * 1000 div old ELSE 0 END"),
}
#: Table functions over the views ``offers`` and ``stores`` of the session.
TABLES = {
    "public_view": (
        "as_of DATE",
        "offer_id STRING, store_id BIGINT, product_id BIGINT, price_cents BIGINT, old_cents BIGINT, valid_from DATE, valid_to DATE",
        "SELECT o.offer_id, o.store_id, o.product_id, o.price_cents, o.old_cents, o.valid_from, o.valid_to FROM offers o JOIN stores s ON o.store_id = s.store_id AND s.is_active "
        "WHERE o.status = 'published' AND o.is_verified AND o.valid_to >= as_of AND o.valid_from <= date_add(as_of, 7)",
    ),
    "offer_words": ("t STRING", "place INT, word STRING", f"SELECT pos, col FROM posexplode(filter(split({_FOLD}, ' '), w -> w <> '')) AS p(pos, col)"),
}


def register(spark: SparkSession, offers: DataFrame, stores: DataFrame) -> None:
    """Make the functions of SCALARS and TABLES, and the views that they read, known to ``spark.sql``."""
    offers.createOrReplaceTempView("offers")
    stores.createOrReplaceTempView("stores")
    for name, (parameters, kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    for name, (parameters, columns, body) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE ({columns}) RETURN {body}")
