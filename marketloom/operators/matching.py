"""Matching scores, codes and identities of products and offers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.text import fold, once_each, ordered_trigrams, pack_size_key, similarity_permille, trigrams, word_similarity_permille


def tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(fold(text), " "), lambda w: w != ""))


def token_scores(rows: DataFrame, one: str, other: str, key: str) -> DataFrame:
    """How much of ``one`` stands in ``other`` (coverage) and of both together (Jaccard), in whole thousandths."""
    split = rows.select(key, tokens(F.col(one)).alias("a"), tokens(F.col(other)).alias("b"))
    shared = split.withColumn("shared", F.size(F.array_intersect("a", "b")))
    return shared.select(
        key,
        F.coalesce(F.expr("try_divide(shared * 1000, size(a))").cast("bigint"), F.lit(0)).alias("coverage"),
        F.coalesce(F.expr("try_divide(shared * 1000, size(a) + size(b) - shared)").cast("bigint"), F.lit(0)).alias("jaccard"),
    )


def ean(text: Column) -> Column:
    """The digits of a text if they are 8 to 14, else null."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    return F.when(F.length(digits).between(8, 14), digits)


IDENTITY = ("store_id", "product_id", "price_cents", "old_cents", "valid_from", "valid_to", "status", "coverage")


def once_by_identity(offers: DataFrame) -> DataFrame:
    """One offer of each that are alike in all eight parts of ``IDENTITY``, with the parts' SHA-256 and how many there were.

    ``min`` combines before the shuffle, so very many copies of one offer are no hot group.
    """
    parts = F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in IDENTITY)), 256)
    return offers.groupBy(parts.alias("identity")).agg(F.min("offer_id").alias("offer_id"), F.count("*").alias("copies"))


def catalogue_search(products: DataFrame, offers: DataFrame, query: str, as_of: str, limit: int = 120) -> DataFrame:
    """Products by relevance, in thousandths: how the name and the brand meet the words, and how alike both are in trigrams.

    A product is shown if it is verified, or has a published offer at two units
    of money or more that has not ended. Its name must contain the words or be
    alike (0.3, or 0.32 as a part of it), or its brand must.
    """
    needle = fold(F.lit(query))
    sold = offers.where((F.col("status") == "published") & (F.col("price_cents") >= 200) & (F.col("valid_to") >= F.lit(as_of).cast("date"))).select("product_id").distinct()
    wanted = trigrams(needle)
    named = products.select("product_id", "is_verified", fold(F.concat_ws(" ", "label", "name")).alias("folded"), fold(F.coalesce("brand", F.lit(""))).alias("of_brand"))
    near = lambda c: similarity_permille(trigrams(F.col(c)), wanted)
    alike = once_each(named, ["folded"], lambda texts: texts.withColumns({"near": near("folded"), "part": word_similarity_permille(wanted, ordered_trigrams(F.col("folded")))}))
    alike = once_each(alike, ["of_brand"], lambda texts: texts.withColumn("brand_near", near("of_brand")))
    found = (F.col("near") >= 300) | (F.col("part") >= 320) | F.contains("folded", needle) | (F.col("brand_near") >= 300) | F.contains("of_brand", needle)
    name = F.when(F.col("folded") == needle, 120_000).when(F.startswith("folded", needle), 100_000).when(F.contains("folded", needle), 82_000).otherwise(0)
    brand = F.when(F.col("of_brand") == needle, 32_000).when(F.startswith("of_brand", needle), 20_000).otherwise(0)
    relevance = name + brand + F.col("near") * 55 + F.col("part") * 40 + F.col("brand_near") * 24
    shown = alike.where((F.length(needle) >= 2) & found).join(sold.withColumn("sold", F.lit(True)), "product_id", "left").where("is_verified or sold")
    ranked = shown.select("product_id", F.col("folded").alias("name"), relevance.cast("bigint").alias("relevance"))
    return ranked.orderBy(F.desc("relevance"), "name", "product_id").limit(min(max(limit, 1), 200))


def best_per_query(offers: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` cheapest offers for each query (``query_id``, ``word``): a search for each row of a table.

    A query's word is a token of the searched text, so queries and offers meet
    in a join on tokens.
    """
    words = offers.select("offer_id", "price_cents", F.explode(tokens(F.col("search_text"))).alias("word"))
    w = Window.partitionBy("query_id").orderBy("price_cents", "offer_id")
    return queries.join(words, "word").withColumn("place", F.row_number().over(w).cast("bigint")).where(F.col("place") <= k).select("query_id", "offer_id", "place")


def repaired_price(text: Column, marker: str = "") -> Column:
    """Cents of a price whose hundredths were split off, read before ``marker`` at the end of a text: ``... 32 90 Weekly deal`` is 3290.

    Null unless the two numbers stand last and the price is from 2 to below 100,000.
    """
    ending = rf"(?i)(?:^|\s)([0-9]{{1,5}})\s+([0-9]{{2}})\s*{marker}\s*$"
    whole, rest = (F.nullif(F.regexp_extract(text, ending, k), F.lit("")).cast("bigint") for k in (1, 2))
    cents = whole * 100 + rest
    return F.when(cents.between(200, 9_999_999), cents)


def match_tokens(text: Column) -> Column:
    """Words of two letters or more."""
    return F.filter(tokens(text), lambda w: F.length(w) >= 2)


#: Score from which a match needs no one to look at it.
SURE_MATCH = 0.92


def match_evidence(rows: DataFrame, title: str, source: str, brand: str, keep: list[str]) -> DataFrame:
    """``keep``, and for an offer's ``title`` and a product's ``source`` text: ``score`` (0 to 1), ``quantity`` (same, mismatch, missing, none), ``evidence`` (signals that agree) and ``safe``.

    Coverage of the smaller set of words counts 0.72, their Jaccard similarity
    0.28; an equal pack size adds 0.15, a different one takes 0.4, one on a single
    side 0.22; a brand adds or takes 0.1 by whether the title holds it.
    """
    split = rows.select(*keep, fold(F.col(title)).alias("_t"), fold(F.col(source)).alias("_s"), fold(F.coalesce(F.col(brand), F.lit(""))).alias("_b"), match_tokens(F.col(title)).alias("_x"), match_tokens(F.col(source)).alias("_y"), pack_size_key(F.col(title)).alias("_p"), pack_size_key(F.col(source)).alias("_q"))
    shared = F.size(F.array_intersect("_x", "_y"))
    alike = F.when((F.size("_x") == 0) | (F.size("_y") == 0), 0.0).otherwise(shared / F.least(F.size("_x"), F.size("_y")) * 0.72 + shared / F.size(F.array_union("_x", "_y")) * 0.28)
    quantity = F.when(F.col("_p") == F.col("_q"), "same").when(F.col("_p").isNotNull() & F.col("_q").isNotNull(), "mismatch").when(F.col("_p").isNotNull() | F.col("_q").isNotNull(), "missing").otherwise("none")
    branded, holds = F.col("_b") != "", (F.col("_b") != "") & F.contains("_t", F.col("_b"))
    told = split.withColumns({"_a": alike, "quantity": quantity})
    by_quantity = F.when(F.col("quantity") == "same", 0.15).when(F.col("quantity") == "mismatch", -0.4).when(F.col("quantity") == "missing", -0.22).otherwise(0.0)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_a") + by_quantity + F.when(branded, F.when(holds, 0.1).otherwise(-0.1)).otherwise(0.0)))
    exact = (F.col("_t") == F.col("_s")) & (F.size("_y") >= 2)
    evidence = (F.col("_a") >= 0.94).cast("int") + (F.col("quantity") == "same").cast("int") + holds.cast("int") + exact.cast("int")
    specific = title_is_specific(F.col("_t")) & title_is_specific(F.col("_s"))
    scored = told.withColumns({"score": score, "evidence": evidence})
    safe = specific & F.col("quantity").isin("same", "none") & (~branded | holds) & (F.col("evidence") >= 2) & (F.col("score") >= SURE_MATCH)
    return scored.select(*keep, F.round("score", 6).alias("score"), "quantity", "evidence", safe.alias("safe"))


# Folded titles that name no product.
GENERAL_TITLES = ("cena", "akce", "sleva", "vybrane druhy", "dle nabidky", "s klubem", "club", "original", "mini", "selection", "cool")


def title_is_specific(folded: Column) -> Column:
    """Not one of GENERAL_TITLES, not a number, and with a word of three characters that has a letter."""
    words = F.filter(F.split(folded, " "), lambda w: (F.length(w) >= 3) & w.rlike("[a-z]"))
    return F.coalesce((F.length(folded) >= 3) & ~folded.isin(*GENERAL_TITLES) & (F.size(words) > 0), F.lit(False))


#: The parts that tell offers of one product apart.
SHOWN_IDENTITY = ("store_id", "location", "price", "old_price", "unit_price", "unit", "valid_from", "valid_to")


def once_by_shown_identity(offers: DataFrame) -> DataFrame:
    """Of offers alike in ``SHOWN_IDENTITY`` the one of least id: amounts to four places, 0 where there is none, names folded to lower case."""
    amount = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("decimal(24,4)").cast("string")
    name = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    how = {"location": name, "unit": name, "price": amount, "old_price": amount, "unit_price": amount}
    key = F.concat_ws("|", *(how.get(c, plain)(c) for c in SHOWN_IDENTITY))
    return offers.groupBy("product_id", key.alias("identity")).agg(F.min("offer_id").alias("offer_id"), F.count("*").alias("copies"))


def shown_price(cents: Column) -> Column:
    return F.format_string("%d,%02d Kč", F.floor(cents / 100).cast("bigint"), cents % 100)
