"""Decisions, whole plans, trips and matching by their full rules."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from marketloom.functions.text import pack_size_key
from marketloom.operators import baskets, decisions, health, images, matching, parsers, pricing, ranges
from marketloom.plans.base_sql import fold
from marketloom.plans.more import _FAR
from marketloom.plans.registry import _PACK, HOME, ITEMS, live, live_products, query, sold_items
from marketloom.sources import retail
from marketloom.sources.retail import AS_OF

_SIGNALS = f""", best AS (SELECT * FROM live WHERE price_cents > 0 QUALIFY row_number() OVER (PARTITION BY product_id, store_id ORDER BY upcoming, price_cents, valid_from, offer_id) = 1),
  m AS (SELECT product_id, count(*) AS stores, min(price_cents) AS low, max(price_cents) AS high, count(*) FILTER (WHERE NOT upcoming) AS stores_now, min(price_cents) FILTER (WHERE NOT upcoming) AS low_now FROM best GROUP BY product_id),
  h AS (SELECT product_id, count(*) AS seen, median(price_cents) AS usual, count(*) FILTER (WHERE valid_from > DATE '{AS_OF}' - 30) AS seen_30, min(price_cents) FILTER (WHERE valid_from > DATE '{AS_OF}' - 30) AS min_30
   FROM offers WHERE price_cents > 0 AND valid_from <= DATE '{AS_OF}' AND valid_from > DATE '{AS_OF}' - 90 GROUP BY product_id),
  j AS (SELECT l.*, stores, low, high, stores_now, low_now, seen, usual, seen_30, min_30, p.is_verified AND trim(p.brand) <> '' AND {_PACK.replace('label', 'p.label')} IS NOT NULL AND l.price_cents > 0 AS exact,
   CASE WHEN old_cents > price_cents THEN (old_cents - price_cents::DOUBLE) / old_cents * 100 END AS off, (price_cents::DOUBLE - min_30) / min_30 AS above FROM live l LEFT JOIN m USING (product_id) LEFT JOIN h USING (product_id) JOIN products p USING (product_id)),
  s AS (SELECT *, CASE WHEN seen >= 3 AND usual > 0 THEN least(100.0::DOUBLE, greatest(0.0::DOUBLE, 50 + (usual - price_cents::DOUBLE) / usual * 250)) END AS a,
   CASE WHEN stores >= 2 THEN CASE WHEN high - low < 1 THEN 50.0::DOUBLE ELSE least(100.0::DOUBLE, greatest(0.0::DOUBLE, (high - price_cents::DOUBLE) / (high - low)::DOUBLE * 100)) END END AS b,
   least(100.0::DOUBLE, greatest(0.0::DOUBLE, CASE WHEN off IS NOT NULL THEN off / 40 * 100 END)) AS cc,
   CASE WHEN seen_30 >= 2 AND min_30 > 0 THEN CASE WHEN above <= 0.01::DOUBLE THEN 100.0::DOUBLE ELSE least(100.0::DOUBLE, greatest(0.0::DOUBLE, 100 - above * 400)) END END AS e FROM j),
  w AS (SELECT *, CASE WHEN off IS NULL THEN NULL ELSE cc END AS c FROM s),
  t AS (SELECT *, exact AND (CASE WHEN a IS NULL THEN 0 ELSE 1 END + CASE WHEN b IS NULL THEN 0 ELSE 1 END + CASE WHEN c IS NULL THEN 0 ELSE 1 END + CASE WHEN e IS NULL THEN 0 ELSE 1 END) >= 2 AND (coalesce(seen, 0) >= 3 OR coalesce(stores, 0) >= 2) AS enough,
   CAST(floor((coalesce(a, 0) * 40 + coalesce(b, 0) * 25 + coalesce(c, 0) * 20 + coalesce(e, 0) * 15) / nullif(CASE WHEN a IS NULL THEN 0 ELSE 40 END + CASE WHEN b IS NULL THEN 0 ELSE 25 END + CASE WHEN c IS NULL THEN 0 ELSE 20 END + CASE WHEN e IS NULL THEN 0 ELSE 15 END, 0) + 0.5) AS INTEGER) AS raw FROM w),
  u AS (SELECT * EXCLUDE (score), CASE WHEN enough THEN raw END AS score FROM t)"""


@query("deal_decisions", _SIGNALS + """ SELECT offer_id, score, CASE WHEN score IS NULL THEN 'unknown' WHEN score >= 90 THEN 'exceptional' WHEN score >= 75 THEN 'very good' WHEN score >= 60 THEN 'good' ELSE 'usual' END AS label,
  CASE WHEN NOT exact THEN 'none' WHEN NOT enough THEN 'neutral' WHEN coalesce(NOT upcoming AND stores_now >= 2 AND price_cents * 100 > low_now * 110, false) THEN 'skip'
   WHEN NOT upcoming AND score >= 85 AND (coalesce(price_cents * 100 <= usual * 92, false) OR coalesce(price_cents * 100 <= min_30 * 103, false) OR coalesce(off >= 25, false)) THEN 'buy' ELSE 'wait' END AS decision FROM u""")
def deal_decisions(spark, d):
    """Whether to buy each live offer now, by four weighted signals."""
    return decisions.deal_decisions(live(spark, d), retail.offers(spark, d, live_products(spark, d)), retail.products(spark, d), AS_OF)


_WANTED = ITEMS + """, sold AS (SELECT i.*, count(*) OVER (PARTITION BY list_id) AS wanted FROM items i WHERE product_id IN (SELECT product_id FROM live)),
  best AS (SELECT * FROM live QUALIFY row_number() OVER (PARTITION BY store_id, product_id ORDER BY upcoming, price_cents, offer_id) = 1),
  priced AS (SELECT s.list_id, s.product_id, s.quantity, s.wanted, b.store_id, b.upcoming, b.price_cents FROM sold s JOIN best b USING (product_id))"""


def _sets(most: int) -> str:
    pair = " UNION ALL SELECT a.list_id, [a.store_id, b.store_id] FROM have a JOIN have b ON a.list_id = b.list_id AND a.store_id < b.store_id" if most > 1 else ""
    three = " UNION ALL SELECT a.list_id, [a.store_id, b.store_id, c.store_id] FROM have a JOIN have b ON a.list_id = b.list_id AND a.store_id < b.store_id JOIN have c ON a.list_id = c.list_id AND b.store_id < c.store_id" if most > 2 else ""
    return f""", have AS (SELECT DISTINCT list_id, store_id FROM priced), sets AS (SELECT list_id, [store_id] AS s FROM have{pair}{three}),
  buys AS (SELECT t.list_id, t.s, p.product_id, p.wanted, p.store_id, p.upcoming, p.price_cents * p.quantity AS cents FROM sets t JOIN priced p ON t.list_id = p.list_id AND list_contains(t.s, p.store_id)
   QUALIFY row_number() OVER (PARTITION BY t.list_id, t.s, p.product_id ORDER BY p.upcoming, p.price_cents, p.store_id) = 1),
  full_sets AS (SELECT list_id, s, sum(cents)::BIGINT AS cents, count(*) FILTER (WHERE upcoming) AS upcoming FROM buys GROUP BY list_id, s, wanted HAVING count(*) = wanted AND count(DISTINCT store_id) = len(s))"""


_CHEAPEST = " SELECT list_id, array_to_string(s, ',') AS stores, cents, upcoming, cents + (len(s) - 1) * 3500 AS charged FROM full_sets QUALIFY row_number() OVER (PARTITION BY list_id ORDER BY cents + (len(s) - 1) * 3500, len(s), array_to_string(s, ',')) = 1"


@query("plan_cover_absolute", _WANTED + """, one AS (SELECT * FROM priced QUALIFY row_number() OVER (PARTITION BY list_id, product_id ORDER BY upcoming, price_cents, store_id) = 1)
  SELECT list_id, count(*) AS items, sum(price_cents * quantity)::BIGINT AS cents, count(DISTINCT store_id) AS stores, count(*) FILTER (WHERE upcoming) AS upcoming FROM one GROUP BY list_id""")
def plan_cover_absolute(spark, d):
    """Every item at its best offer anywhere; one that holds today comes before any other."""
    return decisions.absolute_plan(sold_items(spark, d), live(spark, d))


@query("plan_cover_one_store", _WANTED + _sets(1) + _CHEAPEST)
def plan_cover_one_store(spark, d):
    """The cheapest store that has all that can be bought; no plan where none has."""
    return decisions.one_store_plan(sold_items(spark, d), live(spark, d))


@query("plan_cover_balanced", _WANTED + _sets(2) + _CHEAPEST)
def plan_cover_balanced(spark, d):
    """The cheapest store or pair that has all of it, a second store at its price."""
    return decisions.balanced_plan(sold_items(spark, d), live(spark, d))


#: The given stores lie far apart, so the presets are tried with a wider circle.
WIDER_KM = 120
_LEG = "CAST(round(2 * 6371000 * asin(sqrt(least(sin(radians({1}.la - {0}.la) / 2) * sin(radians({1}.la - {0}.la) / 2) + cos(radians({0}.la)) * cos(radians({1}.la)) * sin(radians({1}.lo - {0}.lo) / 2) * sin(radians({1}.lo - {0}.lo) / 2), 1.0::DOUBLE)))) AS BIGINT)"


def _way(*order: str) -> str:
    return " + ".join(_LEG.format(a, b) for a, b in zip(("h", *order), order))


_THREE = f"least({', '.join(_way(*o) for o in (('a', 'b', 'c'), ('a', 'c', 'b'), ('b', 'a', 'c'), ('b', 'c', 'a'), ('c', 'a', 'b'), ('c', 'b', 'a')))})"
for _name, _trip in decisions.PRESETS.items():
    _trip = replace(_trip, radius_km=WIDER_KM)
    _sql = ITEMS + f""", near AS (SELECT *, {_FAR} AS far FROM stores), best AS (SELECT * FROM live WHERE NOT upcoming AND store_id IN (SELECT store_id FROM near WHERE is_active AND far <= {WIDER_KM * 1000}) QUALIFY row_number() OVER (PARTITION BY store_id, product_id ORDER BY price_cents, offer_id) = 1),
  sold AS (SELECT i.*, count(*) OVER (PARTITION BY list_id) AS wanted FROM items i), priced AS (SELECT s.list_id, s.product_id, s.quantity, s.wanted, b.store_id, b.upcoming, b.price_cents FROM sold s JOIN best b USING (product_id))""" + _sets(_trip.most_stores) + f""",
  spot AS (SELECT store_id, latitude AS la, longitude AS lo FROM stores), h AS (SELECT {HOME[0]}::DOUBLE AS la, {HOME[1]}::DOUBLE AS lo),
  trips AS (SELECT list_id, s, cents, CASE len(s) WHEN 1 THEN {_way('a')} WHEN 2 THEN least({_way('a', 'b')}, {_way('b', 'a')}) ELSE {_THREE} END AS metres
   FROM full_sets CROSS JOIN h JOIN spot a ON a.store_id = s[1] LEFT JOIN spot b ON b.store_id = s[2] LEFT JOIN spot c ON c.store_id = s[3]),
  weighed AS (SELECT list_id, array_to_string(s, ',') AS stores, cents, metres, cents + metres * {_trip.km_cents} // 1000 + (len(s) - 1) * {_trip.stop_cents} AS weight FROM trips)
  SELECT * FROM weighed QUALIFY row_number() OVER (PARTITION BY list_id ORDER BY weight, stores) = 1"""

    def _made(spark, d, trip=_trip):
        branches = retail.stores(spark, d).where("is_active").withColumn("branch_id", F.col("store_id"))
        return decisions.trips(baskets.items(retail.offers(spark, d)), live(spark, d), branches, HOME, trip)

    query(f"trip_{_name}", _sql)(_made)


#: How pack sizes are written, with the multiple of 1/1000 of the base unit that the number stands for.
_PACKS = [
    ("%s g", 1000, "g"), ("%s kg", 1_000_000, "g"), ("3x%s ml a jiné", 3000, "ml"), ("%s,5 l", None, "ml"), ("%s KS", 1000, "ks"), ("500 mg tablety (%s", 1000, "ks"), ("2 × %s cl (sada)", 20_000, "ml"), ("%s mg", 1, "g"), ("%s rolí", 1000, "role"), ("%s gramů", 0, ""),
]


def _packed() -> tuple[str, str]:
    """SQL of a text that holds a product's amount in one of the ways of writing it, and of the key that it must have."""
    texts, keys = [], []
    for k, (shape, by, unit) in enumerate(_PACKS):
        before, after = shape.split("%s")
        texts.append(f"WHEN {k} THEN concat(name, ' ', '{before}', grams, '{after}')")
        number = "grams * 1000 + 500" if by is None else f"grams * {by} / 1000.0"
        keys.append(f"WHEN {k} THEN " + ("NULL" if by == 0 else f"concat(regexp_replace(regexp_replace(CAST(CAST({number} AS DECIMAL(18,3)) AS VARCHAR), '0+$', ''), '\\.$', ''), '{unit}')"))
    return f"CASE product_id % {len(_PACKS)} {' '.join(texts)} END", f"CASE product_id % {len(_PACKS)} {' '.join(keys)} END"


@query("pack_sizes_written", f" SELECT product_id, {_packed()[1]} AS pack_size FROM products")
def pack_sizes_written(spark, d):
    """Pack sizes of each product's amount as different shops write it; the SQL computes them from the amount."""
    texts = retail.products(spark, d).withColumn("text", F.expr(_packed()[0]))
    return texts.select("product_id", pack_size_key(F.col("text")).alias("pack_size"))


_WORDS2 = "list_distinct(list_filter(string_split({0}, ' '), lambda w: length(w) >= 2))"


@query("match_evidence", f""", r AS (SELECT product_id, label || ' ' || name AS title, name || ' ' || label AS source, category AS brand, {_PACK} AS size FROM products), x AS (SELECT product_id, {fold('title')} AS t, {fold('source')} AS s, {fold('brand')} AS b, size FROM r),
  y AS (SELECT *, {_WORDS2.format('t')} AS a, {_WORDS2.format('s')} AS c FROM x), z AS (SELECT *, len(list_intersect(a, c)) / least(len(a), len(c))::DOUBLE * 0.72::DOUBLE + len(list_intersect(a, c)) / len(list_distinct(list_concat(a, c)))::DOUBLE * 0.28::DOUBLE AS alike, contains(t, b) AS holds FROM y)
  SELECT product_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, alike + CASE WHEN size IS NULL THEN 0.0::DOUBLE ELSE 0.15::DOUBLE END + CASE WHEN holds THEN 0.1::DOUBLE ELSE -0.1::DOUBLE END)), 6) AS score, CASE WHEN size IS NULL THEN 'none' ELSE 'same' END AS quantity,
   (CASE WHEN alike >= 0.94 THEN 1 ELSE 0 END + CASE WHEN size IS NULL THEN 0 ELSE 1 END + CASE WHEN holds THEN 1 ELSE 0 END + CASE WHEN t = s THEN 1 ELSE 0 END)::INTEGER AS evidence, holds AND alike + CASE WHEN size IS NULL THEN 0.1::DOUBLE ELSE 0.25::DOUBLE END >= 0.92 AND (CASE WHEN alike >= 0.94 THEN 1 ELSE 0 END + CASE WHEN size IS NULL THEN 0 ELSE 1 END + 1 + CASE WHEN t = s THEN 1 ELSE 0 END) >= 2 AS safe FROM z""")
def match_evidence(spark, d):
    """How well a title of a product's words in another order stands for it, its type taken as a brand."""
    rows = retail.products(spark, d).select("product_id", F.concat_ws(" ", "label", "name").alias("title"), F.concat_ws(" ", "name", "label").alias("source"), F.col("category").alias("brand"))
    return matching.match_evidence(rows, "title", "source", "brand", ["product_id"])


@query("offers_shown_once", """, u AS (SELECT o.offer_id, o.product_id, concat_ws('|', o.store_id, lower(trim(s.city)), CAST(CAST(o.price_cents AS DECIMAL(24,4)) AS VARCHAR), CAST(CAST(coalesce(o.old_cents, 0) AS DECIMAL(24,4)) AS VARCHAR),
   CAST(CAST(CASE WHEN p.grams > 0 THEN o.price_cents * 1000 // p.grams ELSE 0 END AS DECIMAL(24,4)) AS VARCHAR), 'kg', o.valid_from, o.valid_to) AS identity FROM offers o JOIN stores s ON o.store_id = s.store_id JOIN products p ON o.product_id = p.product_id)
  SELECT product_id, identity, min(offer_id) AS offer_id, count(*) AS copies FROM u GROUP BY ALL""")
def offers_shown_once(spark, d):
    """Offers of a product without those that look the same to a reader."""
    named = retail.offers(spark, d).join(retail.stores(spark, d).select("store_id", F.col("city").alias("location")), "store_id").join(retail.products(spark, d).select("product_id", "grams"), "product_id")
    rows = named.withColumns({"price": F.col("price_cents"), "old_price": F.col("old_cents"), "unit_price": F.expr("case when grams > 0 then price_cents * 1000 div grams end"), "unit": F.lit(" KG ")})
    return matching.once_by_shown_identity(rows)


@query("split_prices", """ SELECT product_id, CASE WHEN product_id % 4 = 1 THEN NULL WHEN retail_cents BETWEEN 200 AND 9999999 THEN retail_cents END AS cents FROM products""")
def split_prices(spark, d):
    """Prices read before the words that end a leaflet's line; lines that end in something else have none."""
    line = F.expr("concat(label, ' 2 50 ', name, ' ', retail_cents div 100, '  ', lpad(retail_cents % 100, 2, '0'), case product_id % 4 when 0 then ' Weekly deal' when 1 then ' each' when 2 then 'WEEKLY DEAL ' else ' weekly deal' end)")
    return retail.products(spark, d).select("product_id", matching.repaired_price(line, "Weekly deal").alias("cents"))


@query("unit_price_by_source", """ SELECT product_id, abs(c - p) <= greatest(30, p * 2 / 100) AS by_30, abs(c - p) <= greatest(35, p * 2 / 100) AS by_35, abs(c - p) <= greatest(100, p * 2 / 100) AS by_100
  FROM (SELECT product_id, retail_cents * 1000 // grams AS c, retail_cents * 1000 // grams + product_id % 130 AS p FROM products WHERE grams > 0) x""")
def unit_price_by_source(spark, d):
    """Whether a printed unit price agrees with price and amount, by how exactly each kind of source prints."""
    printed = F.expr("retail_cents * 1000 div grams + product_id % 130")
    fits = lambda n: pricing.unit_price_fits(F.col("retail_cents"), F.col("grams"), printed, n).alias(f"by_{n}")
    return retail.products(spark, d).where("grams > 0").select("product_id", fits(30), fits(35), fits(100))


_SCORE = "((CASE WHEN regexp_matches({0}, '\\.pdf($|\\?)') THEN 70 ELSE 0 END) + (CASE WHEN regexp_matches({0}, '\\.html($|\\?)') THEN 30 ELSE 0 END) + (CASE WHEN regexp_matches({0}, '/(en|de)/') THEN 20 ELSE 0 END) + (CASE WHEN regexp_matches({0}, '/[0-9]+') THEN 15 ELSE 0 END) - (CASE WHEN contains({0}, 'utm_source') THEN 25 ELSE 0 END) - (CASE WHEN regexp_matches({0}, '(adult|spam|bets)') THEN 100 ELSE 0 END))::BIGINT"


@query("document_candidates", f"""WITH l AS (SELECT unnest([url, url || '.pdf', url || '/2024.pdf?utm_source=x', regexp_extract(url, '^([^?#]*)', 1) || '.pdf#a']) AS href FROM pages),
  u AS (SELECT regexp_extract(href, '^([^?#]*)', 1) AS b, list_sort(list_filter(string_split(regexp_extract(href, '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|width|height)='))) AS q, {_SCORE.format('href')} AS score FROM l)
  SELECT b || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url, max(score) AS score FROM u WHERE score >= 60 GROUP BY 1""", base=False)
def document_candidates(spark, d):
    """Leaflets that pages may link to: addresses made from each page's own, scored, cut off at 60, once each."""
    made = F.array(F.col("url"), F.concat("url", F.lit(".pdf")), F.concat("url", F.lit("/2024.pdf?utm_source=x")), F.concat(F.regexp_extract("url", "^([^?#]*)", 1), F.lit(".pdf#a")))
    return parsers.document_candidates(retail.table(spark, d, "pages").select(F.explode(made).alias("href")))


@query("sizes_alike", """ SELECT a.product_id, count(b.product_id) AS alike FROM products a LEFT JOIN products b ON a.brand = b.brand AND a.product_id <> b.product_id AND b.grams > 0 AND abs(a.grams - b.grams) * 100 <= greatest(a.grams, b.grams) * 2 WHERE a.grams > 0 GROUP BY a.product_id""")
def sizes_alike(spark, d):
    """How many products of the same brand come in about the same size."""
    return ranges.count_within_tolerance(retail.products(spark, d), ["brand"], "grams", 2)


@query("autopilot_savings", ITEMS + """, one AS (SELECT * FROM live WHERE NOT upcoming QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY price_cents, offer_id) = 1)
  SELECT list_id, coalesce(sum(price_cents * quantity), 0)::BIGINT AS cents, coalesce(sum(CASE WHEN old_cents > price_cents THEN (old_cents - price_cents) * quantity END), 0)::BIGINT AS saved, count(DISTINCT store_id) AS stores,
   count(offer_id) AS linked, count(*) FILTER (WHERE offer_id IS NULL) AS missing, count(*) FILTER (WHERE old_cents > price_cents) AS documented FROM items LEFT JOIN one USING (product_id) GROUP BY list_id""")
def autopilot_savings(spark, d):
    """What each list costs and saves at today's cheapest offers."""
    return decisions.autopilot(baskets.items(retail.offers(spark, d)), live(spark, d))


@query("sources_due", "WITH s AS (SELECT user_id, max(ts) AS checked_at, count(*) FILTER (WHERE event_type = 'error') * 60 AS every_minutes FROM events GROUP BY user_id) SELECT user_id FROM s WHERE epoch_us(TIMESTAMP '2024-01-30 12:00:00') - epoch_us(checked_at) >= greatest(15, coalesce(nullif(every_minutes, 0), 360)) * 60000000", base=False)
def sources_due(spark, d):
    """Feeds to be read again: each user's events as a feed, read less often the more errors it had."""
    events = retail.table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("checked_at"), (F.count_if(F.col("event_type") == "error") * 60).alias("every_minutes"))
    return health.due(events, F.lit("2024-01-30 12:00:00").cast("timestamp")).select("user_id")


_W = "list_distinct(list_filter(string_split({0}, ' '), lambda w: length(w) >= {1}))"


@query("picture_scores", f""", r AS (SELECT product_id, {fold("label || ' ' || name")} AS l, {fold("name || ' ' || brand || ' ' || label")} AS r, {_PACK} AS size FROM products), w AS (SELECT *, {_W.format('l', 2)} AS a, {_W.format('r', 2)} AS b FROM r), c AS (SELECT *, list_intersect(a, b) AS s FROM w)
  SELECT product_id, round(least(1.0::DOUBLE, len(s) / least(len(a), len(b))::DOUBLE * 0.58::DOUBLE + len(s) / len(list_distinct(list_concat(a, b)))::DOUBLE * 0.22::DOUBLE + CASE WHEN size IS NULL THEN 0.0::DOUBLE ELSE 0.16::DOUBLE END + CASE WHEN len(list_filter(s, lambda w: length(w) >= 5)) > 0 THEN 0.08::DOUBLE ELSE 0.0::DOUBLE END), 6) AS score, len(s)::INTEGER AS common FROM c""")
def picture_scores(spark, d):
    """How well the words of a picture of each product stand for its offers."""
    names = ["label", "name", "brand"]
    rows = retail.products(spark, d).select("product_id", *names)
    return images.lexical_scores(rows, F.concat_ws(" ", "label", "name"), F.concat_ws(" ", "name", "brand", "label"), names).select("product_id", "m.score", "m.common")
