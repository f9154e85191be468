"""Product identity: resolving labels, equivalent and duplicate products."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.text import fold, label_is_specific, pack_size_key


def resolve(rows: DataFrame, products: DataFrame) -> DataFrame:
    """``product_id`` for each row by tiers: brand, name and amount; brand and name; name alone.

    A tier counts only if it leaves exactly one product; the first that does wins.
    """
    p = products.select("product_id", "brand", fold(F.col("name")).alias("folded"), "grams")
    r = rows.withColumn("folded", fold(F.col("name")))
    keys = (["brand", "folded", "grams"], ["brand", "folded"], ["folded"])
    out = r
    for k, on in enumerate(keys):
        one = p.groupBy(*on).agg(F.countDistinct("product_id").alias("_n"), F.min("product_id").alias(f"_tier{k}")).where("_n = 1").drop("_n")
        out = out.join(one, on, "left")
    tier = F.when(F.col("_tier0").isNotNull(), 1).when(F.col("_tier1").isNotNull(), 2).when(F.col("_tier2").isNotNull(), 3)
    return out.select(*rows.columns, F.coalesce("_tier0", "_tier1", "_tier2").alias("product_id"), tier.cast("bigint").alias("tier"))


def equivalents(products: DataFrame) -> DataFrame:
    """Links of each verified product to the first of its brand, name and pack-size group.

    A star for each group, not its pairs: groups may be large.
    """
    p = products.where("is_verified").select("product_id", "brand", "name", fold(F.col("label")).alias("label"), pack_size_key(F.col("label")).alias("size"))
    w = Window.partitionBy("brand", "name", "label", "size")
    first = p.where("size is not null").withColumn("first_id", F.min("product_id").over(w))
    return first.where("product_id <> first_id").select("first_id", "product_id", "size")


def duplicates(products: DataFrame, offers: DataFrame) -> DataFrame:
    """Products that repeat a brand, name and amount, with the one to keep: most offers, then least id."""
    used = offers.groupBy("product_id").agg(F.count("*").alias("n_offers"))
    p = products.select("product_id", "brand", "name", "grams").join(used, "product_id", "left").fillna(0, ["n_offers"])
    group = Window.partitionBy("brand", "name", "grams")
    ranked = p.withColumns({"size": F.count("*").over(group), "keep_id": F.first("product_id").over(group.orderBy(F.desc("n_offers"), "product_id"))})
    return ranked.where("size > 1 and product_id <> keep_id").select("product_id", "keep_id", "n_offers")


def consensus(products: DataFrame, least: int = 3) -> DataFrame:
    """Categories on which all products of a brand and name agree, of at least ``least``."""
    agreed = products.groupBy("brand", "name").agg(F.countDistinct("category").alias("kinds"), F.min("category").alias("category"), F.count("*").alias("evidence"))
    return agreed.where((F.col("kinds") == 1) & (F.col("evidence") >= least)).drop("kinds")


def labelled(products: DataFrame) -> DataFrame:
    """What the text functions make of each product's label."""
    return products.select("product_id", fold(F.col("label")).alias("folded"), label_is_specific(F.col("label")).alias("is_specific"), pack_size_key(F.col("label")).alias("pack_size"))
