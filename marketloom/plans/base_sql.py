"""The domain relations in DuckDB SQL, for the oracle queries."""

from __future__ import annotations

from marketloom.functions.text import ACCENTED, GROUP_RULES, PLAIN
from marketloom.sources.retail import AS_OF, LABELS

CENTS, OFF, N = "CAST(round(l_extendedprice * 100) AS BIGINT)", "CAST(round(l_discount * 100) AS BIGINT)", "CAST(l_quantity AS BIGINT)"


def fold(x: str) -> str:
    return f"trim(regexp_replace(translate(lower({x}), '{ACCENTED}', '{PLAIN}'), '[^a-z0-9]+', ' ', 'g'))"


def group(x: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '\\b({w})\\b') THEN '{g}'" for g, w in GROUP_RULES) + " ELSE 'other' END"


BASE = f"""
WITH stores AS (SELECT s_suppkey AS store_id, lower(replace(s_name, '#', '-')) AS slug, n_name AS city, r_name AS region, s_acctbal >= 0 AS is_active,
  48.5::DOUBLE + ((s_suppkey * 37) % 250)::DOUBLE / 100 AS latitude, 12.0::DOUBLE + ((s_suppkey * 53) % 680)::DOUBLE / 100 AS longitude
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
products AS (SELECT p_partkey AS product_id, ([{", ".join(f"'{x}'" for x in LABELS)}])[p_partkey % {len(LABELS)} + 1] AS label, p_name AS name, p_brand AS brand,
  p_type AS category, p_size::BIGINT AS grams, p_partkey % 3 = 0 AS is_verified, CAST(round(p_retailprice * 100) AS BIGINT) AS retail_cents FROM part),
offers AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE)) AS offer_id, l_partkey AS product_id, l_suppkey AS store_id,
  ({CENTS} * (100 - {OFF}) * 2 + 100 * {N}) // (200 * {N}) AS price_cents, CASE WHEN l_discount > 0 THEN ({CENTS} * 2 + {N}) // (2 * {N}) END AS old_cents,
  CAST(l_shipdate AS DATE) AS valid_from, CAST(l_shipdate AS DATE) + l_linenumber * 2 AS valid_to,
  CASE o_orderstatus WHEN 'F' THEN 'published' WHEN 'O' THEN 'review' ELSE 'expired' END AS status, l_returnflag <> 'R' AS is_verified,
  CASE left(o_orderpriority, 1) WHEN '1' THEN 'store' WHEN '2' THEN 'city' WHEN '3' THEN 'region' ELSE 'national' END AS coverage,
  l_shipdate AS published_at, l_orderkey AS list_id, l_quantity::BIGINT AS quantity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
ranked AS (SELECT o.offer_id, o.store_id, o.product_id, s.slug, s.city, s.region, o.price_cents, o.old_cents, o.valid_from, o.valid_to, o.published_at, o.coverage, p.label, p.brand, p.name, p.category,
  {fold("concat_ws(' ', p.label, p.brand, p.name)")} AS search_text, {group(fold("p.label"))} AS filter_group,
  row_number() OVER (PARTITION BY o.store_id, o.product_id, o.price_cents, o.valid_from, o.valid_to ORDER BY o.old_cents IS NULL, o.published_at DESC, o.offer_id) AS nth
  FROM offers o JOIN stores s ON o.store_id = s.store_id AND s.is_active LEFT JOIN products p ON o.product_id = p.product_id WHERE o.status = 'published' AND o.is_verified),
cache AS (SELECT * EXCLUDE (nth) FROM ranked WHERE nth = 1),
live AS (SELECT *, valid_from > DATE '{AS_OF}' AS upcoming, CASE WHEN old_cents > price_cents THEN (old_cents - price_cents) * 1000 // old_cents ELSE 0 END AS off_permille,
  CASE WHEN old_cents > price_cents THEN (old_cents - price_cents) * 20000 // old_cents + least(old_cents - price_cents, 10000) ELSE 0 END AS score
  FROM cache WHERE valid_to >= DATE '{AS_OF}' AND valid_from <= DATE '{AS_OF}' + 7)
"""
