"""Coverage of branches, plans for occasions, structured sources, locale order, and functions in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.functions import sql
from marketloom.functions.text import metres
from marketloom.operators import coverage, documents, parsers, scenarios, trigram_index
from marketloom.plans.base_sql import fold
from marketloom.plans.more import _FAR
from marketloom.plans.registry import _WORDS, HOME, SIM, TRI, live, query, words
from marketloom.sources import offer_store, retail, sitemap
from marketloom.sources.folders import shared_folder
from marketloom.sources.retail import AS_OF

#: Branches within so many kilometres of HOME are the chosen ones.
CHOSEN_KM = 250


def placed_offers(spark: SparkSession, d: str) -> DataFrame:
    """Live offers with the place they are meant for: the nation and region of the customer of their list."""
    orders, customer, nation, region = (retail.table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    homes = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    places = homes.select(F.col("o_orderkey").alias("list_id"), F.col("n_name").alias("offer_city"), F.col("r_name").alias("offer_region"))
    listed = retail.offers(spark, d).select("offer_id", "list_id").join(places, "list_id")
    return live(spark, d).join(listed, "offer_id").withColumn("branch_id", F.col("store_id"))


def chosen_branches(spark: SparkSession, d: str) -> DataFrame:
    far = metres(F.col("latitude"), F.col("longitude"), F.lit(HOME[0]), F.lit(HOME[1]))
    return retail.stores(spark, d).where("is_active").withColumns({"branch_id": F.col("store_id"), "metres": far}).where(F.col("metres") <= CHOSEN_KM * 1000)


_CHOSEN = f""", chosen AS (SELECT * FROM (SELECT *, {_FAR} AS metres FROM stores WHERE is_active) x WHERE metres <= {CHOSEN_KM * 1000}),
  placed AS (SELECT l.*, n_name AS offer_city, r_name AS offer_region FROM live l JOIN offers o ON l.offer_id = o.offer_id JOIN orders ON o_orderkey = o.list_id JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


@query("covered_offers", _CHOSEN + f""" SELECT offer_id, coverage FROM placed p WHERE coverage = 'national' OR EXISTS (SELECT 1 FROM chosen b WHERE b.store_id = p.store_id
  AND (coverage = 'store' OR (coverage = 'city' AND {fold('b.city')} = {fold('p.offer_city')}) OR (coverage = 'region' AND {fold('b.region')} = {fold('p.offer_region')})))""")
def covered_offers(spark, d):
    """Live offers that hold at one of the chosen branches, by one semi-join on hashed scopes."""
    return coverage.covered(placed_offers(spark, d), chosen_branches(spark, d)).select("offer_id", "coverage")


@query("nearest_branches", _CHOSEN + " SELECT city AS chain, store_id AS branch_id, metres FROM chosen QUALIFY row_number() OVER (PARTITION BY city ORDER BY metres, store_id) = 1")
def nearest_branches(spark, d):
    """The nearest chosen branch of each chain; a nation's stores are a chain here."""
    branches = chosen_branches(spark, d).select(F.col("city").alias("store_id"), "branch_id", "metres")
    return coverage.nearest_per_chain(branches).select(F.col("store_id").alias("chain"), "branch_id", "metres")


PEOPLE = 7


def occasion_fits(spark: SparkSession, d: str) -> DataFrame:
    wanted = scenarios.needs(spark, PEOPLE)
    store = offer_store.of_tables(spark, d)
    texts = trigram_index.containing(store.texts, wanted.select(F.col("word").alias("query")))
    near = chosen_branches(spark, d).where(F.col("metres") <= 120_000).select("store_id")
    return scenarios.fitting(wanted, live(spark, d).join(near, "store_id", "left_semi"), texts)


@query("occasion_fits", _CHOSEN + f""", wanted(scenario, place, word) AS (VALUES {", ".join(f"('{s}', {k}, '{w}')" for s, list_ in scenarios.OCCASIONS.items() for k, n in enumerate(list_) for w in n.words)}),
  m AS (SELECT DISTINCT scenario, place, store_id, product_id, min(price_cents) OVER (PARTITION BY scenario, place, store_id, product_id) AS price_cents FROM wanted JOIN live ON contains(search_text, word) AND product_id IS NOT NULL AND price_cents > 0
   WHERE store_id IN (SELECT store_id FROM chosen WHERE metres <= 120000)), s AS (SELECT scenario, max(place) + 1 AS size FROM wanted GROUP BY scenario)
  SELECT scenario, place, store_id, product_id, price_cents FROM m JOIN s USING (scenario) QUALIFY row_number() OVER (PARTITION BY scenario, place, store_id ORDER BY price_cents, product_id) <= size""")
def occasion_fits_query(spark, d):
    """What each need of each occasion could take in each near store."""
    return occasion_fits(spark, d).select("scenario", "place", "store_id", "product_id", "price_cents")


@query("occasion_plans")
def occasion_plans(spark, d):
    """The best plan of one or two near stores for each occasion; greedy, so held against the plain loop in the tests."""
    at = shared_folder(spark, "occasion-fits")  # read several times, so made once
    occasion_fits(spark, d).write.parquet(at)
    return scenarios.best_plans(spark.read.parquet(at), retail.stores(spark, d), HOME)


@query("event_variants", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_exists(props, '$.missing') AS has_missing FROM events", base=False)
def event_variants(spark, d):
    """Properties of events read as variants, whatever else they hold."""
    body = F.try_parse_json("props")
    return retail.table(spark, d, "events").select("event_id", F.try_variant_get(body, "$.k", "bigint").alias("k"), F.try_variant_get(body, "$.missing", "string").isNotNull().alias("has_missing"))


def branch_feed(spark: SparkSession, d: str) -> DataFrame:
    """A page for each region with its branches embedded as JSON, an object whose keys are their numbers."""
    one = F.struct(F.col("slug"), F.col("city"), F.col("latitude"), F.when(F.col("is_active"), F.lit(True)).alias("open"))
    feeds = retail.stores(spark, d).groupBy("region").agg(F.map_from_entries(F.collect_list(F.struct(F.col("store_id").cast("string"), one))).alias("results"))
    body = F.to_json(F.struct(F.array(F.struct(F.col("results"))).alias("stores")))
    return feeds.select("region", F.concat(F.lit('<html><script>var a = 1;</script><script type="application/json" id="__BRANCHES__">'), body, F.lit("</script><p>end</p></html>")).alias("html"))


@query("embedded_branches", " SELECT region, store_id::VARCHAR AS branch, slug, city, latitude, CASE WHEN is_active THEN true END AS open FROM stores")
def embedded_branches(spark, d):
    """Branches read back from the JSON inside pages: every member of an object of unknown keys."""
    found = documents.objects_of(branch_feed(spark, d), documents.embedded_json(F.col("html"), "__BRANCHES__"), "$.stores[0].results", "branch", "body")
    field = lambda name, kind: F.try_variant_get("body", f"$.{name}", kind).alias(name)
    return found.select("region", "branch", field("slug", "string"), field("city", "string"), field("latitude", "double"), field("open", "boolean"))


def tile_pages(spark: SparkSession, d: str) -> DataFrame:
    """A page for each store with a tile for each live offer; every fifth percent shown is wrong, some tiles are for members."""
    crowns = lambda c: F.concat(F.regexp_replace((c / 100).cast("bigint").cast("string"), "(?<=[0-9])(?=(?:[0-9]{3})+$)", " "), F.lit(","), F.lpad((c % 100).cast("string"), 2, "0"), F.lit(" Kč"))
    off = F.round((F.col("old_cents") - F.col("price_cents")) / F.col("old_cents") * 100).cast("int")
    shown = F.when(F.col("price_cents") % 5 == 0, off + 3).otherwise(off)
    tile = F.concat(
        F.lit('<li class="t" data-qa="ProductTile"><a href="/shop/'), "offer_id", F.lit('" aria-label="'), "label", F.lit('"></a><span data-qa="ProductPrice">'), crowns(F.col("price_cents")), F.lit("</span>"),
        F.coalesce(F.concat(F.lit("<s>Original price "), crowns(F.col("old_cents")), F.lit("</s><b>-"), shown.cast("string"), F.lit("%</b>")), F.lit("")),
        F.when(F.col("price_cents") % 7 == 0, "<i>For members</i>").otherwise(""), F.lit("</li>"),
    )
    rows = live(spark, d).groupBy("store_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat("offer_id", F.lit("\x01"), tile))), "").alias("body"))
    return rows.select("store_id", F.concat(F.lit("<ul>"), F.regexp_replace("body", "[^\x01<>]*\x01", ""), F.lit("</ul>")).alias("html"))


@query("tile_offers", """, t AS (SELECT *, CAST(round((old_cents - price_cents) / old_cents::DOUBLE * 100) AS INTEGER) AS computed FROM live WHERE old_cents > price_cents)
  SELECT store_id, '/shop/' || offer_id AS href, trim(label) AS title, price_cents, old_cents, computed AS shown FROM t WHERE price_cents >= 1000 AND price_cents <= 10000000 AND price_cents % 5 <> 0 AND price_cents % 7 <> 0""")
def tile_offers(spark, d):
    """Offers parsed from tiles whose prices and shown discount prove each other."""
    found = documents.evident(documents.tiles(tile_pages(spark, d)))
    return found.select("store_id", "href", "title", "price_cents", "old_cents", "shown")


@query("locale_order", "WITH t AS (SELECT DISTINCT regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages WHERE regexp_extract(html, '<title>([^<]*)</title>', 1) <> '') SELECT title, row_number() OVER (ORDER BY title COLLATE fr, title) AS place FROM t ORDER BY place LIMIT 100", base=False)
def locale_order(spark, d):
    """The first hundred page titles as a French reader would sort them."""
    first = retail.titles(spark, d).select("title").distinct().orderBy(F.collate("title", "fr"), "title").limit(100)
    return first.select("title", F.row_number().over(Window.orderBy(F.collate("title", "fr"), "title")).cast("bigint").alias("place"))


@query("functions_in_sql", f""" SELECT p.product_id, {fold('label')} AS folded, replace({fold('label')}, ' ', '-') AS slug, {SIM.format(TRI.format(fold('label')), TRI.format("'kava'"))}::BIGINT AS near FROM products p""")
def functions_in_sql(spark, d):
    """Folding, slugs and similarity under their names in SQL."""
    sql.register(spark, retail.offers(spark, d), retail.stores(spark, d))
    retail.products(spark, d).createOrReplaceTempView("products")
    return spark.sql("SELECT product_id, fold_text(label) AS folded, slug_text(label) AS slug, similarity_permille(label, 'káva') AS near FROM products")


@query("public_view", f""" SELECT s.slug, count(*) AS n, sum(CASE WHEN o.old_cents > o.price_cents THEN (o.old_cents - o.price_cents) * 1000 // o.old_cents ELSE 0 END)::BIGINT AS off FROM offers o JOIN stores s ON o.store_id = s.store_id AND s.is_active
  WHERE o.status = 'published' AND o.is_verified AND o.valid_to >= DATE '{AS_OF}' AND o.valid_from <= DATE '{AS_OF}' + 7 GROUP BY s.slug""")
def public_view(spark, d):
    """What anyone may see on a day, as a table function with the day as its argument."""
    sql.register(spark, retail.offers(spark, d), retail.stores(spark, d))
    return spark.sql(f"SELECT slug, count(*) AS n, sum(off_permille(price_cents, old_cents)) AS off FROM public_view(DATE '{AS_OF}') JOIN stores USING (store_id) GROUP BY slug")


@query("words_in_sql", f" SELECT word, count(*) AS n FROM (SELECT unnest(list_filter(string_split({fold('label')}, ' '), lambda w: w <> '')) AS word FROM products) x GROUP BY word")
def words_in_sql(spark, d):
    """Words of labels, by a table function joined to each row."""
    sql.register(spark, retail.offers(spark, d), retail.stores(spark, d))
    retail.products(spark, d).createOrReplaceTempView("products")
    return spark.sql("SELECT word, count(*) AS n FROM products, LATERAL offer_words(label) GROUP BY word")


@query("raised_prices", " SELECT product_id, CASE WHEN product_id % 3 <> 0 AND retail_cents < 100000000 THEN retail_cents END AS cents FROM products")
def raised_prices(spark, d):
    """Prices of leaflet lines that print hundredths raised; every third line has none."""
    raised = F.translate(F.lpad((F.col("retail_cents") % 100).cast("string"), 2, "0"), documents.DIGITS, documents.RAISED)
    whole = F.floor(F.col("retail_cents") / 100).cast("string")
    line = F.concat(F.col("label"), F.lit(" jen "), whole, F.when(F.col("product_id") % 3 == 0, F.lit(" Kč")).when(F.col("product_id") % 3 == 1, raised).otherwise(F.concat(F.lit(" "), raised, F.lit(" Kč"))))
    return retail.products(spark, d).select("product_id", documents.raised_cents(line).alias("cents"))


@query("text_paragraphs", r"""WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n[ \t\r]*(?:\n[ \t\r]*)+'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '') AS t FROM documents WHERE text IS NOT NULL)
  SELECT doc_id, k::INTEGER AS place, md5(t[k + 1]) AS digest FROM (SELECT doc_id, t, unnest(range(0, len(t))) AS k FROM p) x""", base=False)
def text_paragraphs(spark, d):
    """Paragraphs of documents between blank lines, in their order, by digest."""
    found = documents.blank_line_paragraphs(retail.table(spark, d, "documents"), ["doc_id"])
    return found.select("doc_id", "place", F.md5("paragraph").alias("digest"))


_LINES = """SELECT page_id, (top + 2) // 4 * 4 AS y, min("left") AS x_min, max("left") AS x_max, count(*) AS n_words, CAST(sum(confidence) // count(*) AS BIGINT) AS confidence, string_agg(text, ' ' ORDER BY "left", text) AS line FROM ({0}) w GROUP BY page_id, y"""


@query("recognised_lines", _LINES.format(_WORDS), base=False)
def recognised_lines(spark, d):
    """Words of tab-separated tables, one for each page, joined to lines."""
    rows = words(spark, d)
    line = F.concat_ws("\t", F.lit(5), "page_id", "word_id", "left", "top", F.concat("confidence", F.lit(".5")), "text")
    noise = F.concat_ws("\t", F.lit(4), "page_id", F.lit(0), F.lit(1), F.lit(2), F.lit(-1), F.lit(""))
    tables = rows.groupBy("page_id").agg(F.concat_ws("\n", F.lit("level\tpage\tword\tleft\ttop\tconf\ttext"), F.first(noise), F.array_join(F.collect_list(line), "\n"), F.lit("")).alias("tsv"))
    return parsers.word_lines(documents.recognised_words(tables))


@query("lines_from_json", _LINES.format(_WORDS), base=False)
def lines_from_json(spark, d):
    """The same words out of JSON, one document for each page."""
    one = F.struct(F.col("word_id").alias("id"), F.col("left").alias("x"), F.col("top").alias("y"), F.col("confidence").alias("conf"), F.col("text").alias("t"))
    bodies = words(spark, d).groupBy("page_id").agg(F.collect_list(one).alias("words")).select(F.to_json(F.struct(F.col("page_id").alias("page"), "words")).alias("body"))
    return parsers.word_lines(documents.json_words(bodies))


@query("sitemap", f" SELECT 'https://shop.example/product/' || product_id || '?a=1&b=2' AS loc, strftime(max(valid_to), '%Y-%m-%d') AS lastmod, CASE WHEN bool_or(valid_to >= DATE '{AS_OF}') THEN '0.8' ELSE '0.3' END AS priority FROM cache GROUP BY product_id")
def sitemap_query(spark, d):
    """The addresses of products that were ever on offer, written as a sitemap and read back."""
    last = offer_store.of_tables(spark, d).cache().groupBy("product_id").agg(F.max("valid_to").alias("lastmod"))
    live_now = F.when(F.col("lastmod") >= F.lit(AS_OF).cast("date"), 0.8).otherwise(0.3)
    at = shared_folder(spark, "sitemap")
    sitemap.write(last.select(F.concat(F.lit("https://shop.example/product/"), F.col("product_id").cast("string"), F.lit("?a=1&b=2")).alias("loc"), "lastmod", live_now.alias("priority")), at)
    return sitemap.read(spark, at)
