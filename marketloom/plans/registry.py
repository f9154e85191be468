"""Every query of the offer domain, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions.text import slug
from marketloom.operators import alerts, baskets, health, identity, lifecycle, parsers, pricing, search, trigram_index
from marketloom.operators.search import Search
from marketloom.plans.base_sql import BASE, fold
from marketloom.sources import offer_store, retail
from marketloom.sources.retail import AS_OF
from marketloom.streaming import changes as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
HOME = (49.5, 15.0)


def query(name: str, sql: str | None = None, base: bool = True) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = BASE + sql if base else sql
        return f

    return keep


def cache(spark: SparkSession, d: str) -> DataFrame:
    """The published cache; the first query of an application publishes it."""
    return offer_store.of_tables(spark, d).cache().drop(*offer_store.DERIVED)


def live(spark: SparkSession, d: str) -> DataFrame:
    """Live offers, from the months of the published cache that can hold any."""
    return search.live(offer_store.of_tables(spark, d).cache(AS_OF).drop(*offer_store.DERIVED), AS_OF)


def live_products(spark: SparkSession, d: str) -> DataFrame:
    return live(spark, d).select("product_id").distinct()


def sold_items(spark: SparkSession, d: str) -> DataFrame:
    """The list items that some live offer fits; lines of other products are left out before any are moved."""
    return baskets.items(retail.offers(spark, d, live_products(spark, d)))


# Search and facets

PAGE = ["offer_id", "slug", "product_id", "label", "filter_group", "price_cents", "old_cents", "off_permille", "score", "upcoming"]
_PAGE = ", ".join(PAGE)
TRI = "list_distinct(flatten(list_transform(list_filter(string_split({0}, ' '), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
SIM = "coalesce(len(list_intersect({0}, {1})) * 1000 // nullif(len({0}) + len({1}) - len(list_intersect({0}, {1})), 0), 0)"
_FUZZY = SIM.format(TRI.format(fold("label")), TRI.format(fold("'máslo'")))


@query("offer_cache", f"SELECT offer_id, slug, product_id, price_cents, old_cents, valid_from, valid_to, search_text, filter_group FROM cache")
def offer_cache(spark, d):
    built = search.build_cache(retail.offers(spark, d), retail.stores(spark, d), retail.products(spark, d))
    return built.select("offer_id", "slug", "product_id", "price_cents", "old_cents", "valid_from", "valid_to", "search_text", "filter_group")


PAGES = {
    "page_recommended": (dict(), "", "score DESC"),
    "page_discount": (dict(sort="discount"), "", "off_permille DESC"),
    "page_cheapest": (dict(sort="cheapest", limit=50, offset=20), "", "price_cents"),
    "page_dearest": (dict(sort="dearest"), "", "price_cents DESC"),
    "page_newest": (dict(sort="newest"), "", None),
    "page_ending": (dict(sort="ending"), "", "valid_to"),
    "page_saving": (dict(sort="saving"), "", "greatest(coalesce(old_cents, 0) - price_cents, 0) DESC"),
    "page_name": (dict(sort="name"), "", "label NULLS LAST"),
    "page_current_only": (dict(include_upcoming=False), "AND NOT upcoming", "score DESC"),
    "page_food": (dict(mode="food"), "AND filter_group = 'food'", "score DESC"),
    "page_mode_recommended": (dict(mode="recommended"), "AND score > 0", "score DESC"),
    "page_mode_ending": (dict(mode="ending"), f"AND valid_to - DATE '{AS_OF}' BETWEEN 0 AND 2", "score DESC"),
    "page_under50": (dict(mode="under50"), "AND price_cents < 5000", "score DESC"),
    "page_under100": (dict(mode="under100"), "AND price_cents < 10000", "score DESC"),
    "page_mode_discount": (dict(mode="discount", sort="cheapest"), "AND off_permille > 0", "off_permille DESC, price_cents"),
    "page_mode_new": (dict(mode="new", sort="cheapest"), f"AND DATE '{AS_OF}' - CAST(published_at AS DATE) BETWEEN 0 AND 3", "published_at DESC, price_cents"),
    "page_store": (dict(store="supplier-000000007"), "AND slug = 'supplier-000000007'", "score DESC"),
    "page_group": (dict(group="drinks"), "AND filter_group = 'drinks'", "score DESC"),
    "page_price_range": (dict(min_cents=20000, max_cents=60000), "AND price_cents BETWEEN 20000 AND 60000", "score DESC"),
    "page_region": (dict(region="EUROPE"), "AND (coverage = 'national' OR region = 'EUROPE')", "score DESC"),
    "page_city": (dict(city="FRANCE"), "AND (coverage IN ('national', 'region') OR city = 'FRANCE')", "score DESC"),
    "page_text": (dict(query=" Máslo "), f"AND (contains(search_text, 'maslo') OR {_FUZZY} >= 240)", "score DESC"),
}


def _page(spec: dict) -> Query:
    return lambda spark, d: offer_store.of_tables(spark, d).page(Search(AS_OF, **spec)).select(*PAGE)


for _name, (_spec, _where, _key) in PAGES.items():
    _order = ", ".join(x for x in ("upcoming", _key, "published_at DESC NULLS LAST", "offer_id") if x)
    query(_name, f"SELECT {_PAGE} FROM live WHERE true {_where} ORDER BY {_order} LIMIT {_spec.get('limit', 24)} OFFSET {_spec.get('offset', 0)}")(_page(_spec))


@query("page_total", "SELECT count(*) AS total, count(*) FILTER (WHERE upcoming) AS upcoming, count(*) FILTER (WHERE NOT upcoming) AS current FROM live WHERE filter_group = 'food'")
def page_total(spark, d):
    return search.total(offer_store.of_tables(spark, d).cache(AS_OF), Search(AS_OF, group="food"))


@query("facet_stores", "SELECT slug, count(*) AS n FROM live WHERE filter_group = 'food' GROUP BY slug")
def facet_stores(spark, d):
    return search.store_facet(offer_store.of_tables(spark, d).cache(AS_OF), Search(AS_OF, group="food", store="supplier-000000007"))


@query("facet_groups", "SELECT filter_group, count(*) AS n FROM live WHERE slug = 'supplier-000000007' GROUP BY filter_group")
def facet_groups(spark, d):
    return search.group_facet(offer_store.of_tables(spark, d).cache(AS_OF), Search(AS_OF, group="food", store="supplier-000000007"))


@query("facet_cities", "SELECT city, count(*) AS n, count(DISTINCT store_id) AS stores FROM live WHERE region = 'ASIA' GROUP BY city")
def facet_cities(spark, d):
    return live(spark, d).where("region = 'ASIA'").groupBy("city").agg(F.count("*").alias("n"), F.countDistinct("store_id").alias("stores"))


@query("store_directory", "SELECT s.slug, s.city, count(l.offer_id) AS n, min(l.price_cents) AS cheapest FROM stores s LEFT JOIN live l ON s.store_id = l.store_id WHERE s.is_active GROUP BY s.slug, s.city")
def store_directory(spark, d):
    counted = live(spark, d).groupBy("store_id").agg(F.count("*").alias("n"), F.min("price_cents").alias("cheapest"))
    return retail.stores(spark, d).where("is_active").join(counted, "store_id", "left").select("slug", "city", F.coalesce("n", F.lit(0)).alias("n"), "cheapest")


@query("top_per_store", """SELECT slug, product_id, offer_id, place FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY off_permille DESC, price_cents, offer_id) AS place
  FROM (SELECT *, row_number() OVER (PARTITION BY store_id, product_id ORDER BY off_permille DESC, price_cents, offer_id) AS b FROM live) x WHERE b = 1) y WHERE place <= 3""")
def top_per_store(spark, d):
    return search.top_per_store(offer_store.of_tables(spark, d).cache(AS_OF), AS_OF, 3).select("slug", "product_id", "offer_id", "place")


@query("product_comparison", "SELECT product_id, count(*) AS n, count(DISTINCT store_id) AS stores, min(price_cents) AS cheapest, max(price_cents) AS dearest FROM cache GROUP BY product_id HAVING count(DISTINCT store_id) > 1")
def product_comparison(spark, d):
    return cache(spark, d).groupBy("product_id").agg(F.count("*").alias("n"), F.countDistinct("store_id").alias("stores"), F.min("price_cents").alias("cheapest"), F.max("price_cents").alias("dearest")).where("stores > 1")


@query("saved_page", "SELECT offer_id, price_cents FROM live WHERE product_id IN (SELECT l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT')")
def saved_page(spark, d):
    urgent = retail.table(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    wanted = retail.table(spark, d, "lineitem").join(urgent, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_partkey").alias("product_id"))
    return live(spark, d).join(wanted, "product_id", "left_semi").select("offer_id", "price_cents")


@query("similar_labels", f"""SELECT label, other, permille FROM (SELECT a.label, b.label AS other, {SIM.format(TRI.format('a.label'), TRI.format('b.label'))} AS permille
  FROM (SELECT DISTINCT {fold('label')} AS label FROM products) a JOIN (SELECT DISTINCT {fold('label')} AS label FROM products) b ON a.label < b.label) x WHERE permille >= 100""")
def similar_labels(spark, d):
    found = trigram_index.similar(offer_store.product_labels(spark, d), offer_store.folded_labels(spark, d).withColumnRenamed("text", "query"), 100)
    return found.where("query < text").select(F.col("query").alias("label"), F.col("text").alias("other"), "permille")


# Text and identity

@query("fold_and_slug", f"SELECT product_id, {fold('label')} AS folded, replace({fold('label')}, ' ', '-') AS slug FROM products")
def fold_and_slug(spark, d):
    return identity.labelled(retail.products(spark, d)).select("product_id", "folded").join(retail.products(spark, d).select("product_id", slug(F.col("label")).alias("slug")), "product_id")


@query("label_specific", f"SELECT product_id, length(f) >= 3 AND regexp_matches(f, '[a-z]') AND NOT regexp_matches(f, '^(akce|ruzne|vybrane|nabidka|sleva)\\b') AS is_specific FROM (SELECT product_id, {fold('label')} AS f FROM products) x")
def label_specific(spark, d):
    return identity.labelled(retail.products(spark, d)).select("product_id", "is_specific")


_SIZE = {"Mléko plnotučné 1,5% 2x900 ml": "1800ml", "Máslo 250 g": "250g", "Pivo světlý ležák 0,5 l": "500ml", "Šampon na vlasy 400 ml": "400ml", "Krmivo pro kočky 4 x 50 g": "200g", "Hrnec 5 l": "5000ml", "Vitamin C 60 ks": "60ks", "Chléb 1,00 kg": "1000g", "Prací gel 3 l": "3000ml", "Káva mletá 1 kg": "1000g", "Rohlík 43 g": "43g"}
_PACK = "CASE label " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _SIZE.items()) + " END"


@query("pack_size", f"SELECT product_id, {_PACK} AS pack_size FROM products")
def pack_size(spark, d):
    return identity.labelled(retail.products(spark, d)).select("product_id", "pack_size")


@query("resolve_products", f"""SELECT r.row_id, coalesce(a.product_id, b.product_id, c.product_id) AS product_id,
  CASE WHEN a.product_id IS NOT NULL THEN 1 WHEN b.product_id IS NOT NULL THEN 2 WHEN c.product_id IS NOT NULL THEN 3 END::BIGINT AS tier
  FROM (SELECT product_id AS row_id, brand, name, CASE WHEN product_id % 2 = 0 THEN grams ELSE grams + 1 END AS grams FROM products) r
  LEFT JOIN (SELECT brand, name, grams, min(product_id) AS product_id FROM products GROUP BY ALL HAVING count(DISTINCT product_id) = 1) a ON r.brand = a.brand AND r.name = a.name AND r.grams = a.grams
  LEFT JOIN (SELECT brand, name, min(product_id) AS product_id FROM products GROUP BY ALL HAVING count(DISTINCT product_id) = 1) b ON r.brand = b.brand AND r.name = b.name
  LEFT JOIN (SELECT name, min(product_id) AS product_id FROM products GROUP BY ALL HAVING count(DISTINCT product_id) = 1) c ON r.name = c.name""")
def resolve_products(spark, d):
    p = retail.products(spark, d)
    rows = p.select(F.col("product_id").alias("row_id"), "brand", "name", F.expr("if(product_id % 2 = 0, grams, grams + 1)").alias("grams"))
    return identity.resolve(rows, p).select("row_id", "product_id", "tier")


@query("equivalent_products", f"""SELECT first_id, product_id, size FROM (SELECT product_id, {_PACK} AS size, min(product_id) OVER (PARTITION BY brand, name, {fold('label')}, {_PACK}) AS first_id FROM products WHERE is_verified) x
  WHERE size IS NOT NULL AND first_id <> product_id""")
def equivalent_products(spark, d):
    return identity.equivalents(retail.products(spark, d))


@query("duplicate_products", """, u AS (SELECT product_id, count(*) AS n FROM offers GROUP BY product_id), g AS (SELECT p.product_id, coalesce(u.n, 0) AS n_offers, count(*) OVER w AS size,
  first_value(p.product_id) OVER (w ORDER BY coalesce(u.n, 0) DESC, p.product_id) AS keep_id FROM products p LEFT JOIN u ON p.product_id = u.product_id WINDOW w AS (PARTITION BY brand, name, grams))
  SELECT product_id, keep_id, n_offers FROM g WHERE size > 1 AND product_id <> keep_id""")
def duplicate_products(spark, d):
    return identity.duplicates(retail.products(spark, d), retail.offers(spark, d))


@query("category_consensus", "SELECT brand, name, min(category) AS category, count(*) AS evidence FROM products GROUP BY brand, name HAVING count(DISTINCT category) = 1 AND count(*) >= 3")
def category_consensus(spark, d):
    return identity.consensus(retail.products(spark, d))


# Baskets and prices

ITEMS = ", items AS (SELECT list_id, product_id, sum(quantity)::BIGINT AS quantity FROM offers GROUP BY ALL)"
BEST = ", best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store_id, product_id ORDER BY upcoming, price_cents, valid_from, offer_id) AS bn FROM live) x WHERE bn = 1)"
COSTS = ITEMS + BEST + ", costs AS (SELECT list_id, store_id, count(*) AS matched, sum(price_cents * quantity)::BIGINT AS cents FROM items JOIN best USING (product_id) GROUP BY ALL)"
SETS = COSTS + """, cand AS (SELECT list_id, store_id FROM costs),
  sets AS (SELECT list_id, [store_id] AS s FROM cand UNION ALL SELECT a.list_id, [a.store_id, b.store_id] FROM cand a JOIN cand b ON a.list_id = b.list_id AND a.store_id < b.store_id),
  buys AS (SELECT s.list_id, s.s, i.product_id, min(b.price_cents * i.quantity) AS cents FROM sets s JOIN items i ON s.list_id = i.list_id JOIN best b ON b.product_id = i.product_id AND list_contains(s.s, b.store_id) GROUP BY ALL),
  sums AS (SELECT list_id, s, count(*) AS matched, sum(cents)::BIGINT AS cents FROM buys GROUP BY ALL)"""


@query("best_offer_per_store", BEST + " SELECT store_id, product_id, offer_id, price_cents FROM best")
def best_offer_per_store(spark, d):
    return baskets.best_per_store(live(spark, d)).select("store_id", "product_id", "offer_id", "price_cents")


@query("basket_metrics", ITEMS + """, one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY upcoming, price_cents, offer_id) AS bn FROM live) x WHERE bn = 1)
  SELECT list_id, coalesce(sum(price_cents * quantity), 0)::BIGINT AS total_cents, coalesce(sum(greatest(price_cents, coalesce(old_cents, price_cents)) * quantity), 0)::BIGINT AS reference_cents,
  count(DISTINCT store_id) AS stores, count(offer_id) AS matched, count(*) FILTER (WHERE offer_id IS NULL) AS missing, count(*) FILTER (WHERE upcoming) AS upcoming,
  coalesce(sum((greatest(price_cents, coalesce(old_cents, price_cents)) - price_cents) * quantity), 0)::BIGINT AS saved_cents FROM items LEFT JOIN one USING (product_id) GROUP BY list_id""")
def basket_metrics(spark, d):
    return baskets.metrics(baskets.items(retail.offers(spark, d)), live(spark, d))


@query("plan_one_store", COSTS + " SELECT list_id, store_id, matched, cents FROM (SELECT *, row_number() OVER (PARTITION BY list_id ORDER BY matched DESC, cents, store_id) AS n FROM costs) x WHERE n = 1")
def plan_one_store(spark, d):
    return baskets.one_store(sold_items(spark, d), live(spark, d))


@query("plan_balanced", SETS + """ SELECT list_id, array_to_string(s, ',') AS stores, matched, cents, charged FROM (SELECT *, cents + (len(s) - 1) * 3500 AS charged,
  row_number() OVER (PARTITION BY list_id ORDER BY matched DESC, cents + (len(s) - 1) * 3500, len(s), array_to_string(s, ',')) AS n FROM sums) x WHERE n = 1""")
def plan_balanced(spark, d):
    return baskets.balanced(sold_items(spark, d), live(spark, d))


_LEG = "CAST(round(2 * 6371000 * asin(sqrt(least(sin(radians({1}.la - {0}.la) / 2) * sin(radians({1}.la - {0}.la) / 2) + cos(radians({0}.la)) * cos(radians({1}.la)) * sin(radians({1}.lo - {0}.lo) / 2) * sin(radians({1}.lo - {0}.lo) / 2), 1.0::DOUBLE)))) AS BIGINT)"


def _trip(*order: str) -> str:
    return " + ".join(_LEG.format(a, b) for a, b in zip(("h", *order), (*order, "h")))


ROUTES = COSTS + f""", cand AS (SELECT list_id, store_id FROM costs),
  sets AS (SELECT list_id, [store_id] AS s FROM cand UNION ALL SELECT a.list_id, [a.store_id, b.store_id] FROM cand a JOIN cand b ON a.list_id = b.list_id AND a.store_id < b.store_id
   UNION ALL SELECT a.list_id, [a.store_id, b.store_id, c.store_id] FROM cand a JOIN cand b ON a.list_id = b.list_id AND a.store_id < b.store_id JOIN cand c ON a.list_id = c.list_id AND b.store_id < c.store_id),
  buys AS (SELECT s.list_id, s.s, i.product_id, min(b.price_cents * i.quantity) AS cents FROM sets s JOIN items i ON s.list_id = i.list_id JOIN best b ON b.product_id = i.product_id AND list_contains(s.s, b.store_id) GROUP BY ALL),
  sums AS (SELECT list_id, s, count(*) AS matched, sum(cents)::BIGINT AS cents FROM buys GROUP BY ALL),
  spot AS (SELECT store_id, latitude AS la, longitude AS lo FROM stores), h AS (SELECT {HOME[0]}::DOUBLE AS la, {HOME[1]}::DOUBLE AS lo),
  trips AS (SELECT list_id, s, matched, cents, CASE len(s) WHEN 1 THEN {_trip("a")} WHEN 2 THEN {_trip("a", "b")} ELSE least({_trip("a", "b", "c")}, {_trip("b", "a", "c")}, {_trip("a", "c", "b")}) END AS metres
   FROM sums CROSS JOIN h JOIN spot a ON a.store_id = s[1] LEFT JOIN spot b ON b.store_id = s[2] LEFT JOIN spot c ON c.store_id = s[3]),
  costed AS (SELECT list_id, array_to_string(s, ',') AS stores, matched, cents, metres, cents + metres * {baskets.KM_CENTS} // 1000 + (len(s) - 1) * {baskets.STOP_CENTS} AS trip_cents FROM trips)
  SELECT * FROM costed QUALIFY row_number() OVER (PARTITION BY list_id ORDER BY matched DESC, trip_cents, stores) = 1"""


@query("plan_route", ROUTES)
def plan_route(spark, d):
    return baskets.routes(sold_items(spark, d), live(spark, d), retail.stores(spark, d), HOME)


@query("nearby_stores", f"""SELECT store_id, slug, city, metres FROM (SELECT *, CAST(round(2 * 6371000 * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians({HOME[0]} - latitude) / 2), 2)
  + cos(radians(latitude)) * cos(radians({HOME[0]})) * pow(sin(radians({HOME[1]} - longitude) / 2), 2))))) AS BIGINT) AS metres FROM stores WHERE is_active) x WHERE metres <= 100000""")
def nearby_stores(spark, d):
    return baskets.nearby(retail.stores(spark, d), HOME, 100)


@query("merged_lists", """, ours AS (SELECT list_id, product_id, sum(quantity)::BIGINT AS quantity FROM offers WHERE is_verified GROUP BY ALL), theirs AS (SELECT list_id, product_id, sum(quantity)::BIGINT AS quantity FROM offers WHERE coverage <> 'national' GROUP BY ALL)
  SELECT list_id, product_id, greatest(a.quantity, b.quantity) AS quantity, CASE WHEN b.quantity IS NULL THEN 'local' WHEN a.quantity IS NULL THEN 'remote' ELSE 'both' END AS origin FROM ours a FULL JOIN theirs b USING (list_id, product_id)""")
def merged_lists(spark, d):
    """Lists as two devices have them: one knows the verified lines, the other those of a place."""
    offers = retail.offers(spark, d)
    return baskets.merged_lists(baskets.items(offers.where("is_verified")), baskets.items(offers.where("coverage <> 'national'")))


TYPICAL = f""", typical AS (SELECT product_id, CAST(median(price_cents) * 2 AS BIGINT) AS double_median, min(price_cents) AS min_90, min(price_cents) FILTER (WHERE valid_from > DATE '{AS_OF}' - 30) AS min_30, count(*) AS seen
  FROM offers WHERE valid_from <= DATE '{AS_OF}' AND valid_from > DATE '{AS_OF}' - 90 GROUP BY product_id)"""


@query("typical_price", TYPICAL + " SELECT * FROM typical")
def typical_price(spark, d):
    return pricing.typical(retail.offers(spark, d), AS_OF)


@query("deal_scores", TYPICAL + """, m AS (SELECT product_id, max(price_cents) AS dearest FROM live GROUP BY product_id),
  s AS (SELECT offer_id, price_cents, double_median, CASE WHEN double_median IS NOT NULL THEN greatest(0, least(1000, 500 + CASE WHEN double_median >= 2 * price_cents THEN (double_median - 2 * price_cents) * 1000 // double_median ELSE -((2 * price_cents - double_median) * 1000 // double_median) END)) END AS a,
   (dearest - price_cents) * 1000 // dearest AS b, least(1000, off_permille) AS c, CASE WHEN min_30 IS NOT NULL THEN CASE WHEN price_cents <= min_30 THEN 1000 ELSE 0 END END AS e
   FROM live LEFT JOIN typical USING (product_id) JOIN m USING (product_id))
  SELECT offer_id, CAST((coalesce(a, 0) * 40 + b * 25 + c * 20 + coalesce(e, 0) * 15) // (CASE WHEN a IS NULL THEN 0 ELSE 40 END + 45 + CASE WHEN e IS NULL THEN 0 ELSE 15 END) AS BIGINT) AS deal_score,
  CASE WHEN double_median IS NULL THEN 'unknown' WHEN price_cents * 200 <= double_median * 82 THEN 'great' WHEN price_cents * 200 <= double_median * 94 THEN 'good' WHEN price_cents * 200 <= double_median * 106 THEN 'usual' ELSE 'high' END AS deal FROM s""")
def deal_scores(spark, d):
    return pricing.deals(live(spark, d), retail.offers(spark, d), AS_OF)


@query("without_outliers", """SELECT offer_id, price_cents FROM (SELECT *, CAST(median(price_cents) OVER w * 2 AS BIGINT) AS m, count(*) OVER w AS n FROM offers WINDOW w AS (PARTITION BY store_id, product_id)) x
  WHERE n < 3 OR (price_cents * 200 >= m * 40 AND price_cents * 200 <= m * 250)""")
def without_outliers(spark, d):
    return pricing.without_outliers(retail.offers(spark, d)).select("offer_id", "price_cents")


# Lifecycle and alerts

#: Two snapshots of a catalogue: the least price of each product among the offers that ended before a day, and among the others.
SNAPSHOTS = f", old AS (SELECT product_id, min(price_cents) AS p FROM cache WHERE valid_to < DATE '{AS_OF}' GROUP BY 1), new AS (SELECT product_id, min(price_cents) AS p FROM cache WHERE valid_to >= DATE '{AS_OF}' GROUP BY 1)"


def snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    over = F.col("valid_to") < F.lit(AS_OF).cast("date")
    least = lambda test: cache(spark, d).where(test).groupBy("product_id").agg(F.min("price_cents").alias("price_cents"))
    return least(over), least(~over)


@query("snapshot_diff", SNAPSHOTS + " SELECT product_id, CASE WHEN old.p IS NULL THEN 'insert' WHEN new.p IS NULL THEN 'expire' WHEN old.p = new.p THEN 'keep' ELSE 'update' END AS change FROM old FULL JOIN new USING (product_id)")
def snapshot_diff(spark, d):
    old, new = snapshots(spark, d)
    return lifecycle.diff(old, new, ["product_id"], ["price_cents"])


@query("publish_snapshot", SNAPSHOTS + " SELECT product_id, p AS price_cents, 'published' AS status FROM new UNION ALL SELECT product_id, p, 'expired' FROM old WHERE product_id NOT IN (SELECT product_id FROM new)")
def publish_snapshot(spark, d):
    old, new = snapshots(spark, d)
    return lifecycle.publish(old, new, ["product_id"], 1).select("product_id", "price_cents", "status")


@query("expire_offers", f"SELECT CASE WHEN status = 'published' AND valid_to < DATE '{AS_OF}' THEN 'expired' ELSE status END AS status, count(*) AS n, sum(price_cents)::BIGINT AS cents FROM offers GROUP BY 1")
def expire_offers(spark, d):
    return lifecycle.expire(retail.offers(spark, d), AS_OF).groupBy("status").agg(F.count("*").alias("n"), F.sum("price_cents").alias("cents"))


@query("superseded_offers", """SELECT offer_id, by_id FROM (SELECT offer_id, valid_to, lead(offer_id) OVER w AS by_id, lead(valid_from) OVER w AS nf FROM offers WINDOW w AS (PARTITION BY store_id, product_id ORDER BY valid_from, offer_id)) x WHERE nf <= valid_to""")
def superseded_offers(spark, d):
    return lifecycle.superseded(retail.offers(spark, d))


@query("archive_restore", "SELECT store_id, slug, city, is_active FROM stores")
def archive_restore(spark, d):
    s = retail.stores(spark, d).select("store_id", "slug", "city", "is_active")
    return lifecycle.restored(lifecycle.snapshot_json(s, "store_id"), s)


ALERTS = """, wants AS (SELECT o_custkey AS user_id, l_partkey AS product_id, CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey END AS store_id, CAST(round(p_retailprice * 100) AS BIGINT) * (l_linenumber + 5) // 10 AS target_cents
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey), merged AS (SELECT user_id, product_id, store_id, max(target_cents) AS target_cents, count(*) AS merged FROM wants GROUP BY ALL)"""


def wants(spark: SparkSession, d: str, of: DataFrame | None = None) -> DataFrame:
    """What users want; with ``of`` only wants of these products."""
    lines, orders = retail.lines_of(retail.table(spark, d, "lineitem"), of), retail.table(spark, d, "orders")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("product_id"), F.expr("if(l_linenumber % 2 = 0, l_suppkey, null)").alias("store_id"), "l_linenumber")
    priced = rows.join(retail.products(spark, d).select("product_id", "retail_cents"), "product_id")
    return priced.select("user_id", "product_id", "store_id", F.expr("retail_cents * (l_linenumber + 5) div 10").alias("target_cents"))


@query("alerts_merged", ALERTS + " SELECT * FROM merged")
def alerts_merged(spark, d):
    return alerts.merged_alerts(wants(spark, d))


@query("alerts_matched", ALERTS + """ SELECT DISTINCT m.user_id, m.product_id, l.offer_id, l.price_cents FROM merged m JOIN live l ON m.product_id = l.product_id AND l.price_cents <= m.target_cents AND (m.store_id IS NULL OR m.store_id = l.store_id)""")
def alerts_matched(spark, d):
    return alerts.price_matches(alerts.merged_alerts(wants(spark, d, live_products(spark, d))), live(spark, d)).distinct()


@query("favourites_matched", ALERTS + " SELECT DISTINCT m.user_id, m.product_id, l.offer_id, l.price_cents FROM merged m JOIN live l ON m.product_id = l.product_id AND l.off_permille > 0")
def favourites_matched(spark, d):
    likes = wants(spark, d, live_products(spark, d)).select("user_id", "product_id").distinct()
    return alerts.favourite_matches(likes, live(spark, d))


@query("alerts_unsent", ALERTS + """, hits AS (SELECT DISTINCT m.user_id, m.product_id, l.offer_id, l.price_cents FROM merged m JOIN live l ON m.product_id = l.product_id AND l.price_cents <= m.target_cents AND (m.store_id IS NULL OR m.store_id = l.store_id))
  SELECT * FROM hits WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def alerts_unsent(spark, d):
    """Alerts not yet told; the customers of one segment have been."""
    hits = alerts_matched(spark, d)
    told = retail.table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    return alerts.unsent(hits, hits.join(told, "user_id", "left_semi").select("user_id", "offer_id", "price_cents"))


@query("retryable", "SELECT event_id, user_id FROM events WHERE event_type = 'error' AND epoch(TIMESTAMP '2024-01-20 12:00:00') - floor(epoch(ts)) BETWEEN 300 AND 21600 AND event_id % 7 < 5", base=False)
def retryable(spark, d):
    failed = retail.table(spark, d, "events").where("event_type = 'error'").withColumn("attempts", F.col("event_id") % 7)
    return alerts.retryable(failed, F.lit("2024-01-20 12:00:00").cast("timestamp")).select("event_id", "user_id")


# Parsers

@query("page_links", """WITH a AS (SELECT page_id, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') AS t FROM pages), b AS (SELECT page_id, unnest(range(0, len(t))) AS place, t FROM a)
  SELECT page_id, place, regexp_extract(t[place + 1], 'href="([^"]*)"', 1) AS href, regexp_extract(t[place + 1], '>([^<]*)<', 1) AS title FROM b""", base=False)
def page_links(spark, d):
    return parsers.links(retail.table(spark, d, "pages"))


@query("page_fields", """SELECT page_id, nullif(regexp_extract(html, '<html lang="([a-z]+)"', 1), '') AS lang, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title, nullif(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '') AS heading FROM pages""", base=False)
def page_fields(spark, d):
    return parsers.fields(retail.table(spark, d, "pages"))


@query("canonical_urls", """WITH u AS (SELECT page_id, regexp_extract(url, '^([^?#]*)', 1) AS b, list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|width|height)='))) AS q FROM pages)
  SELECT page_id, b || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url FROM u""", base=False)
def canonical_urls(spark, d):
    return retail.table(spark, d, "pages").select("page_id", parsers.canonical_url(F.col("url")).alias("url"))


@query("url_scores", """SELECT page_id, ((CASE WHEN regexp_matches(url, '\\.pdf($|\\?)') THEN 70 ELSE 0 END) + (CASE WHEN regexp_matches(url, '\\.html($|\\?)') THEN 30 ELSE 0 END) + (CASE WHEN regexp_matches(url, '/(en|de)/') THEN 20 ELSE 0 END)
  + (CASE WHEN regexp_matches(url, '/[0-9]+') THEN 15 ELSE 0 END) - (CASE WHEN contains(url, 'utm_source') THEN 25 ELSE 0 END) - (CASE WHEN regexp_matches(url, '(adult|spam|bets)') THEN 100 ELSE 0 END))::BIGINT AS score FROM pages""", base=False)
def url_scores(spark, d):
    return retail.table(spark, d, "pages").select("page_id", parsers.url_score(F.col("url")).alias("score"))


@query("document_paragraphs", """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents), p AS (SELECT doc_id, unnest(range(0, len(t))) AS place, t FROM l), n AS (SELECT doc_id, place, length(t[place + 1])::BIGINT AS n_chars FROM p)
  SELECT doc_id, place, n_chars, max(CASE WHEN n_chars < 40 THEN place END) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS heading_place FROM n""", base=False)
def document_paragraphs(spark, d):
    return parsers.paragraphs(retail.table(spark, d, "documents"))


_WORDS = "SELECT l_orderkey AS page_id, l_partkey AS word_id, CAST(l_quantity AS BIGINT) * 7 AS \"left\", l_suppkey % 40 AS top, l_linenumber::BIGINT * 10 AS confidence, l_returnflag || l_partkey AS text FROM lineitem"


def words(spark: SparkSession, d: str) -> DataFrame:
    return retail.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("page_id"), F.col("l_partkey").alias("word_id"), (F.col("l_quantity").cast("bigint") * 7).alias("left"), (F.col("l_suppkey") % 40).alias("top"),
        (F.col("l_linenumber").cast("bigint") * 10).alias("confidence"), F.concat("l_returnflag", F.col("l_partkey").cast("string")).alias("text"),
    )


@query("word_lines", f"""SELECT page_id, (top + 2) // 4 * 4 AS y, min("left") AS x_min, max("left") AS x_max, count(*) AS n_words, CAST(sum(confidence) // count(*) AS BIGINT) AS confidence, string_agg(text, ' ' ORDER BY "left", text) AS line FROM ({_WORDS}) w GROUP BY page_id, y""", base=False)
def word_lines(spark, d):
    return parsers.word_lines(words(spark, d))


@query("nearest_titles", f"""WITH w AS ({_WORDS}), j AS (SELECT p.page_id, p.word_id AS price_id, t.word_id AS title_id, abs(p."left" - t."left") + 2 * (p.top - t.top) AS distance FROM (SELECT DISTINCT page_id, word_id, "left", top FROM w WHERE word_id % 2 = 0) p
  JOIN (SELECT DISTINCT page_id, word_id, "left", top FROM w WHERE word_id % 2 = 1) t ON p.page_id = t.page_id AND abs(p."left" - t."left") <= 250 AND p.top - t.top BETWEEN 0 AND 120)
  SELECT page_id, price_id, title_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY page_id, price_id ORDER BY distance, title_id) AS n FROM j) x WHERE n = 1""", base=False)
def nearest_titles(spark, d):
    w = words(spark, d).select("page_id", "word_id", F.col("left").alias("x"), F.col("top").alias("y")).distinct()
    return parsers.nearest_titles(w.where("word_id % 2 = 0").withColumnRenamed("word_id", "price_id"), w.where("word_id % 2 = 1").withColumnRenamed("word_id", "title_id"))


@query("unit_price_check", "SELECT product_id, abs(retail_cents * 1000 // grams - (retail_cents * 1000 // grams + product_id % 100 * 40)) <= greatest(30, (retail_cents * 1000 // grams + product_id % 100 * 40) * 2 / 100) AS fits FROM products WHERE grams > 0")
def unit_price_check(spark, d):
    printed = F.expr("retail_cents * 1000 div grams + product_id % 100 * 40")
    return retail.products(spark, d).where("grams > 0").select("product_id", pricing.unit_price_fits(F.col("retail_cents"), F.col("grams"), printed).alias("fits"))


# Health

@query("store_health", f""", c AS (SELECT store_id, count(*) FILTER (WHERE status = 'published' AND is_verified AND valid_to >= DATE '{AS_OF}' AND valid_from <= DATE '{AS_OF}') AS live, count(*) FILTER (WHERE status = 'review') AS in_review,
  max(valid_from) FILTER (WHERE valid_from <= DATE '{AS_OF}') AS latest, bool_or(coverage = 'national') AS nat FROM offers GROUP BY store_id)
  SELECT s.store_id, s.slug, coalesce(live, 0) AS live, coalesce(in_review, 0) AS in_review, latest, coalesce(nat, false) AS has_national,
  CASE WHEN NOT s.is_active THEN 'inactive' WHEN coalesce(live, 0) = 0 THEN 'missing' WHEN DATE '{AS_OF}' - latest > 7 THEN 'stale' ELSE 'fresh' END AS state FROM stores s LEFT JOIN c ON s.store_id = c.store_id""")
def store_health(spark, d):
    return health.store_feeds(retail.stores(spark, d), retail.offers(spark, d), AS_OF)


@query("automation_health", "SELECT CAST(ts AS DATE) AS day, count(*) AS runs, count(*) FILTER (WHERE event_type = 'error') AS failed, count(DISTINCT user_id) AS sources, count(*) FILTER (WHERE event_type = 'error') * 1000 // count(*) AS failed_permille FROM events GROUP BY 1", base=False)
def automation_health(spark, d):
    return health.automation(retail.table(spark, d, "events"))


@query("stale_jobs", "SELECT user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last FROM events GROUP BY user_id HAVING epoch(TIMESTAMP '2024-01-30 12:00:00') - floor(epoch(max(ts))) > 2700", base=False)
def stale_jobs(spark, d):
    return health.stale_jobs(retail.table(spark, d, "events"), "2024-01-30 12:00:00")


@query("recent_views", """WITH v AS (SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS item, max(ts) AS last, count(*) AS views FROM events WHERE event_type = 'view' GROUP BY ALL)
  SELECT user_id, item, views, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last DESC, item) AS place FROM v) x WHERE place <= 30""", base=False)
def recent_views(spark, d):
    return health.recent_views(retail.table(spark, d, "events"))


@query("catalogue_coverage", "SELECT filter_group, count(*) AS n, count(*) FILTER (WHERE old_cents > price_cents) AS discounted, count(DISTINCT store_id) AS stores FROM cache GROUP BY filter_group")
def catalogue_coverage(spark, d):
    return health.catalogue_coverage(cache(spark, d))


# Streams

@query("stream_tumbling", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS cents FROM events GROUP BY ALL", base=False)
def stream_tumbling(spark, d):
    return streams.run(spark, d, streams.tumbling, "complete")


@query("stream_first_notices", "SELECT DISTINCT user_id, event_type FROM events WHERE event_type IN ('purchase', 'signup')", base=False)
def stream_first_notices(spark, d):
    return streams.run(spark, d, streams.first_notices, "append")


@query("stream_changes", "WITH c AS (SELECT user_id, event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS x FROM events) SELECT user_id, count(*) FILTER (WHERE x) AS changes FROM c GROUP BY user_id", base=False)
def stream_changes(spark, d):
    return streams.run(spark, d, streams.changes, "append").groupBy("user_id").agg(F.max("changes").alias("changes"))


@query("window_sliding", """WITH e AS (SELECT *, unnest([0, 1]) AS k FROM events) SELECT strftime(time_bucket(INTERVAL 12 HOUR, ts) - k * INTERVAL 12 HOUR, '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS cents FROM e GROUP BY ALL""", base=False)
def window_sliding(spark, d):
    return streams.tumbling(retail.table(spark, d, "events"), "1 day", "12 hours")


@query("window_sessions", """WITH a AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  b AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM b GROUP BY user_id, s""", base=False)
def window_sessions(spark, d):
    return streams.sessions(retail.table(spark, d, "events"))


from marketloom.plans import extras, flows, more, rules, searches  # noqa: E402, F401  register their queries
