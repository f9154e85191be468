"""Further queries of the offer domain: ranges, matching, JSON, upserts and published tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.functions.text import fold as folded
from marketloom.operators import baskets, matching, ranges
from marketloom.plans.base_sql import fold
from marketloom.plans.registry import HOME, cache, live, query, sold_items
from marketloom.sources import retail

_TOKENS = "list_distinct(list_filter(string_split({0}, ' '), lambda w: w <> ''))"


@query("overlapping_offers", """ SELECT a.offer_id, count(*) AS overlaps FROM offers a JOIN offers b ON a.store_id = b.store_id AND a.product_id = b.product_id AND a.offer_id <> b.offer_id
  AND a.valid_from <= b.valid_to AND b.valid_from <= a.valid_to GROUP BY a.offer_id""")
def overlapping_offers(spark, d):
    return ranges.overlapping(retail.offers(spark, d), ["store_id", "product_id"])


@query("sizes_within_tolerance", """ SELECT a.product_id, b.product_id AS other_id FROM products a JOIN products b ON a.brand = b.brand AND a.product_id < b.product_id AND a.grams > 0 AND b.grams > 0
  AND abs(a.grams - b.grams) * 100 <= greatest(a.grams, b.grams) * 2""")
def sizes_within_tolerance(spark, d):
    return ranges.within_tolerance(retail.products(spark, d), ["brand"], "grams", 2)


@query("events_in_the_last_hour", "SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS recent FROM events", base=False)
def events_in_the_last_hour(spark, d):
    return ranges.in_the_last(retail.table(spark, d, "events"), 3600)


@query("nearest_old_prices", """ SELECT offer_id, last_value(old_cents IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, first_value(old_cents IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after
  FROM offers WINDOW w AS (PARTITION BY product_id ORDER BY valid_from, offer_id)""")
def nearest_old_prices(spark, d):
    return ranges.nearest_known(retail.offers(spark, d), ["product_id"], "old_cents", ["valid_from", "offer_id"])


@query("conditional_upsert", """, o AS (SELECT store_id, product_id, bool_or(is_verified) AS is_verified, min(price_cents) AS price_cents, max(old_cents) AS old_cents FROM offers WHERE status = 'published' GROUP BY ALL),
  n AS (SELECT store_id, product_id, bool_or(is_verified) AS is_verified, min(price_cents) AS price_cents, max(old_cents) AS old_cents FROM offers WHERE status = 'review' GROUP BY ALL)
  SELECT store_id, product_id, CASE WHEN takes THEN coalesce(nv, ov) ELSE ov END AS is_verified, CASE WHEN takes THEN coalesce(np, op) ELSE op END AS price_cents, CASE WHEN takes THEN coalesce(nc, oc) ELSE oc END AS old_cents
  FROM (SELECT store_id, product_id, o.is_verified AS ov, n.is_verified AS nv, o.price_cents AS op, n.price_cents AS np, o.old_cents AS oc, n.old_cents AS nc,
   n.is_verified IS NOT NULL AND (o.is_verified IS NULL OR n.is_verified OR NOT o.is_verified) AS takes FROM o FULL JOIN n USING (store_id, product_id)) x""")
def conditional_upsert(spark, d):
    best = retail.offers(spark, d).groupBy("status", "store_id", "product_id").agg(F.bool_or("is_verified").alias("is_verified"), F.min("price_cents").alias("price_cents"), F.max("old_cents").alias("old_cents"))
    return ranges.upsert(best.where("status = 'published'"), best.where("status = 'review'"), ["store_id", "product_id"], ["price_cents", "old_cents"])


@query("token_scores", f""" SELECT product_id, coalesce(len(list_intersect(a, b)) * 1000 // nullif(len(a), 0), 0) AS coverage, coalesce(len(list_intersect(a, b)) * 1000 // nullif(len(a) + len(b) - len(list_intersect(a, b)), 0), 0) AS jaccard
  FROM (SELECT product_id, {_TOKENS.format(fold("concat_ws(' ', name, brand)"))} AS a, {_TOKENS.format(fold("concat_ws(' ', category, brand)"))} AS b FROM products) x""")
def token_scores(spark, d):
    rows = retail.products(spark, d).select("product_id", F.concat_ws(" ", "name", "brand").alias("one"), F.concat_ws(" ", "category", "brand").alias("other"))
    return matching.token_scores(rows, "one", "other", "product_id")


@query("ean_codes", "SELECT page_id, CASE WHEN length(x) BETWEEN 8 AND 14 THEN x END AS ean FROM (SELECT page_id, regexp_replace(url, '[^0-9]', '', 'g') AS x FROM pages) y", base=False)
def ean_codes(spark, d):
    return retail.table(spark, d, "pages").select("page_id", matching.ean(F.col("url")).alias("ean"))


@query("offer_identities", """ SELECT sha256(concat_ws('|', store_id, product_id, price_cents, coalesce(old_cents::VARCHAR, '-'), valid_from, valid_to, status, coverage)) AS identity, min(offer_id) AS offer_id, count(*) AS copies FROM offers GROUP BY 1""")
def offer_identities(spark, d):
    return matching.once_by_identity(retail.offers(spark, d))


@query("content_signatures", " SELECT store_id, valid_from, md5(string_agg(offer_id || ':' || price_cents, ',' ORDER BY offer_id)) AS signature, count(*) AS n FROM offers GROUP BY ALL")
def content_signatures(spark, d):
    row = F.struct("offer_id", "price_cents")
    told = F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: F.concat_ws(":", r["offer_id"], r["price_cents"].cast("string"))), ",")
    return retail.offers(spark, d).groupBy("store_id", "valid_from").agg(F.md5(told).alias("signature"), F.count("*").alias("n"))


@query("list_documents", """ SELECT list_id, '{"list_id":' || list_id || ',"verified":' || count(*) FILTER (WHERE is_verified) || ',"items":[' || string_agg('{"offer_id":"' || offer_id || '","quantity":' || quantity || '}', ',' ORDER BY offer_id, quantity) || ']}' AS body FROM offers GROUP BY list_id""")
def list_documents(spark, d):
    items = F.array_sort(F.collect_list(F.struct("offer_id", "quantity")))
    rows = retail.offers(spark, d).groupBy("list_id").agg(F.count_if("is_verified").alias("verified"), items.alias("items"))
    return rows.select("list_id", F.to_json(F.struct("list_id", "verified", "items")).alias("body"))


@query("event_properties", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_exists(props, '$.k') AS has_k, '{"k":' || (props::JSON->>'k') || ',"seen":1}' AS merged, '{}' AS without_k FROM events""", base=False)
def event_properties(spark, d):
    props = F.from_json("props", "map<string,bigint>")
    return retail.table(spark, d, "events").select(
        "event_id",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        F.map_contains_key(props, "k").alias("has_k"),
        F.to_json(F.map_concat(props, F.create_map(F.lit("seen"), F.lit(1).cast("bigint")))).alias("merged"),
        F.to_json(F.map_filter(props, lambda k, _: k != "k")).alias("without_k"),
    )


@query("store_flags", """ SELECT store_id, bool_and(is_verified) FILTER (WHERE status = 'published') AS all_verified, bool_or(old_cents IS NOT NULL) AS any_discount, max(price_cents) FILTER (WHERE status = 'review') AS dearest_in_review,
  round(count(*) FILTER (WHERE is_verified) * 1000.0 / count(*))::BIGINT AS verified_permille FROM offers GROUP BY store_id""")
def store_flags(spark, d):
    return retail.offers(spark, d).groupBy("store_id").agg(
        F.expr("bool_and(is_verified) FILTER (WHERE status = 'published')").alias("all_verified"),
        F.bool_or(F.col("old_cents").isNotNull()).alias("any_discount"),
        F.expr("max(price_cents) FILTER (WHERE status = 'review')").alias("dearest_in_review"),
        F.round(F.count_if("is_verified") * F.lit(1000.0) / F.count("*")).cast("bigint").alias("verified_permille"),
    )


@query("best_per_query", f""", q AS (SELECT DISTINCT w AS query_id, w AS word FROM (SELECT unnest({_TOKENS.format(fold("brand"))}) AS w FROM products) x),
  t AS (SELECT offer_id, price_cents, unnest({_TOKENS.format("search_text")}) AS word FROM cache)
  SELECT query_id, offer_id, place FROM (SELECT query_id, offer_id, row_number() OVER (PARTITION BY query_id ORDER BY price_cents, offer_id) AS place FROM q JOIN t USING (word)) y WHERE place <= 3""")
def best_per_query(spark, d):
    words = retail.products(spark, d).select(F.explode(matching.tokens(F.col("brand"))).alias("word")).distinct()
    return matching.best_per_query(cache(spark, d), words.select(F.col("word").alias("query_id"), "word"), 3)


@query("repaired_prices", " SELECT product_id, retail_cents AS cents, printf('%d,%02d Kč', retail_cents // 100, retail_cents % 100) AS shown FROM products")
def repaired_prices(spark, d):
    split = retail.products(spark, d).withColumn("text", F.format_string("%d %02d", F.floor(F.col("retail_cents") / 100).cast("bigint"), F.col("retail_cents") % 100))
    return split.select("product_id", matching.repaired_price(F.col("text")).alias("cents"), matching.shown_price(F.col("retail_cents")).alias("shown"))


@query("public_offers", " SELECT o.status, s.region, count(*) AS n FROM offers o JOIN stores s ON o.store_id = s.store_id AND s.is_active WHERE o.status = 'published' AND o.is_verified GROUP BY ALL")
def public_offers(spark, d):
    """What anyone may see: a view of the table, not a copy."""
    shown = retail.offers(spark, d).where("status = 'published' and is_verified").join(retail.stores(spark, d).where("is_active"), "store_id")
    return shown.groupBy("status", "region").agg(F.count("*").alias("n"))


_FAR = f"CAST(round(2 * 6371000 * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians({HOME[0]} - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians({HOME[0]})) * pow(sin(radians({HOME[1]} - longitude) / 2), 2))))) AS BIGINT)"


@query("nearest_per_city", f" SELECT city, store_id, metres FROM (SELECT city, store_id, {_FAR} AS metres FROM stores WHERE is_active) x WHERE metres <= 300000 QUALIFY row_number() OVER (PARTITION BY city ORDER BY metres, store_id) = 1")
def nearest_per_city(spark, d):
    near = baskets.nearby(retail.stores(spark, d), HOME, 300)
    return near.groupBy("city").agg(F.min(F.struct("metres", "store_id")).alias("f")).select("city", "f.store_id", "f.metres")


@query("place_search", f" SELECT city, region, count(*) AS stores FROM stores WHERE starts_with({fold('city')}, 'u') OR contains({fold('city')}, 'land') GROUP BY ALL")
def place_search(spark, d):
    city = folded(F.col("city"))
    return retail.stores(spark, d).where(F.startswith(city, F.lit("u")) | F.contains(city, F.lit("land"))).groupBy("city", "region").agg(F.count("*").alias("stores"))


@query("plan_absolute", """, one AS (SELECT * FROM live QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY price_cents, store_id, offer_id) = 1), items AS (SELECT list_id, product_id, sum(quantity)::BIGINT AS quantity FROM offers GROUP BY ALL)
  SELECT list_id, count(*) AS matched, count(DISTINCT store_id) AS stores, sum(price_cents * quantity)::BIGINT AS cents FROM items JOIN one USING (product_id) GROUP BY list_id""")
def plan_absolute(spark, d):
    """Each item where it is cheapest, however many stores that takes."""
    return baskets.cheapest_anywhere(sold_items(spark, d), live(spark, d))


@query("cache_published", " SELECT valid_to, slug, count(*) AS n, min(price_cents) AS cheapest FROM live GROUP BY ALL")
def cache_published(spark, d):
    """The published cache, read back with its files pruned by the month of their last day."""
    return live(spark, d).groupBy("valid_to", "slug").agg(F.count("*").alias("n"), F.min("price_cents").alias("cheapest"))
