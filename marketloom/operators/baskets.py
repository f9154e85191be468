"""Shopping lists against offers: best offers, basket metrics, plans and routes. All lists at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.text import metres

EXTRA_STORE_CENTS = 3500
#: Costs of a route: by kilometre and by stop after the first.
KM_CENTS, STOP_CENTS = 600, 1500


def items(offers: DataFrame) -> DataFrame:
    """List items: one row per list and product with its quantity."""
    return offers.groupBy("list_id", "product_id").agg(F.sum("quantity").alias("quantity"))


def _first(rows: DataFrame, key: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The first row of each ``key``; partial minima come before the shuffle, so a product with very many offers is no hot group."""
    least = rows.groupBy(*key).agg(F.min_by(F.struct(*values), F.struct(*order)).alias("_first"))
    return least.select(*key, *(F.col("_first")[v].alias(v) for v in values))


def best_per_store(live: DataFrame) -> DataFrame:
    """The offer of each store and product that counts: current before upcoming, then cheapest, then earliest."""
    return _first(live, ["store_id", "product_id"], ["upcoming", "price_cents", "valid_from", "offer_id"], ["offer_id", "price_cents", "old_cents", "upcoming"])


def best_per_item(lists: DataFrame, live: DataFrame) -> DataFrame:
    """The best offer of each list item over all stores; items without an offer stay, with nulls."""
    best = _first(live, ["product_id"], ["upcoming", "price_cents", "offer_id"], ["offer_id", "store_id", "price_cents", "old_cents", "upcoming"])
    return lists.join(best, "product_id", "left")


def metrics(lists: DataFrame, live: DataFrame) -> DataFrame:
    """Totals, reference totals, savings and coverage of each list."""
    cost = F.col("price_cents") * F.col("quantity")
    before = F.greatest("price_cents", F.coalesce("old_cents", "price_cents")) * F.col("quantity")
    return (
        best_per_item(lists, live)
        .groupBy("list_id")
        .agg(
            F.coalesce(F.sum(cost), F.lit(0)).alias("total_cents"),
            F.coalesce(F.sum(before), F.lit(0)).alias("reference_cents"),
            F.countDistinct("store_id").alias("stores"),
            F.count("offer_id").alias("matched"),
            F.count_if(F.col("offer_id").isNull()).alias("missing"),
            F.count_if(F.col("upcoming")).alias("upcoming"),
        )
        .withColumn("saved_cents", F.col("reference_cents") - F.col("total_cents"))
    )


def store_costs(lists: DataFrame, live: DataFrame) -> DataFrame:
    """What each store that has something of a list asks for it."""
    priced = lists.join(best_per_store(live), "product_id")
    return priced.groupBy("list_id", "store_id").agg(F.count("*").alias("matched"), F.sum(F.col("price_cents") * F.col("quantity")).alias("cents"))


def one_store(lists: DataFrame, live: DataFrame) -> DataFrame:
    """The store that has most of a list, then the cheapest."""
    w = Window.partitionBy("list_id").orderBy(F.desc("matched"), "cents", "store_id")
    return store_costs(lists, live).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def cheapest_anywhere(lists: DataFrame, live: DataFrame) -> DataFrame:
    """Each list with every item where it is cheapest, in as many stores as that takes."""
    best = _first(live, ["product_id"], ["price_cents", "store_id", "offer_id"], ["store_id", "price_cents"])
    cost = F.col("price_cents") * F.col("quantity")
    return lists.join(best, "product_id").groupBy("list_id").agg(F.count("*").alias("matched"), F.countDistinct("store_id").alias("stores"), F.sum(cost).alias("cents"))


def combinations(lists: DataFrame, live: DataFrame, most: int) -> DataFrame:
    """Every set of one to ``most`` of the stores that have something of a list: ``list_id``, ``set`` (sorted store ids)."""
    return store_sets(lists.join(best_per_store(live), "product_id").select("list_id", "store_id"), most)


def store_sets(have: DataFrame, most: int) -> DataFrame:
    """Every ``set`` (sorted) of one to ``most`` of the stores of a list, each once.

    A list's stores are gathered once and sets grow from them where they lie:
    each passes on, and is extended by each store behind its last.
    """
    none = F.slice("rest", 1, 0)
    rows = have.groupBy("list_id").agg(F.array_sort(F.collect_set("store_id")).alias("rest")).select("list_id", none.alias("set"), "rest")
    grown = F.transform("rest", lambda s, k: F.struct(F.array_append("set", s).alias("set"), F.slice("rest", k + 2, F.size("rest")).alias("rest")))
    for _ in range(most):
        rows = rows.select("list_id", F.inline(F.concat(F.array(F.struct("set", none.alias("rest"))), grown)))
    return rows.where(F.size("set") > 0).select("list_id", "set")


def set_costs(lists: DataFrame, live: DataFrame, most: int) -> DataFrame:
    """Cost of each set of stores, each item bought where it is cheapest in the set."""
    sets = combinations(lists, live, most)
    members = sets.select("list_id", "set", F.explode("set").alias("store_id"))
    priced = lists.join(best_per_store(live), "product_id").select("list_id", "product_id", "store_id", "quantity", "price_cents")
    cheapest = members.join(priced, ["list_id", "store_id"]).groupBy("list_id", "set", "product_id").agg(F.min(F.col("price_cents") * F.col("quantity")).alias("cents"))
    return cheapest.groupBy("list_id", "set").agg(F.count("*").alias("matched"), F.sum("cents").alias("cents"))


def balanced(lists: DataFrame, live: DataFrame) -> DataFrame:
    """The best of all single stores and pairs of stores of a list, a second store costing ``EXTRA_STORE_CENTS``."""
    charged = F.col("cents") + (F.size("set") - 1) * EXTRA_STORE_CENTS
    w = Window.partitionBy("list_id").orderBy(F.desc("matched"), "charged", F.size("set"), F.array_join(F.col("set").cast("array<string>"), ","))
    ranked = set_costs(lists, live, 2).withColumn("charged", charged.cast("bigint")).withColumn("_n", F.row_number().over(w))
    return ranked.where("_n = 1").select("list_id", F.array_join(F.col("set").cast("array<string>"), ",").alias("stores"), "matched", "cents", "charged")


def routes(lists: DataFrame, live: DataFrame, stores: DataFrame, home: tuple[float, float]) -> DataFrame:
    """The cheapest trip of up to three stores and back, goods, kilometres and stops together.

    All orders of a set are tried; a set of three has six.
    """
    sets = set_costs(lists, live, 3)
    where = stores.select("store_id", "latitude", "longitude")
    stops = sets.select("*", F.posexplode("set").alias("_k", "store_id")).join(where, "store_id")
    placed = stops.groupBy("list_id", "set", "matched", "cents").agg(F.array_sort(F.collect_list(F.struct("_k", "latitude", "longitude"))).alias("p"))
    at = lambda k: F.get("p", F.lit(k))
    leg = lambda a, b: metres(a["latitude"], a["longitude"], b["latitude"], b["longitude"])
    base = F.struct(F.lit(home[0]).alias("latitude"), F.lit(home[1]).alias("longitude"))

    def trip(order: tuple[int, ...]):
        legs = [leg(base, at(order[0])), *(leg(at(a), at(b)) for a, b in zip(order, order[1:])), leg(at(order[-1]), base)]
        return sum(legs[1:], legs[0])

    # A trip may be turned around, so of six orders three differ.
    length = F.when(F.size("set") == 1, trip((0,))).when(F.size("set") == 2, trip((0, 1))).otherwise(F.least(trip((0, 1, 2)), trip((1, 0, 2)), trip((0, 2, 1))))
    costed = placed.withColumn("metres", length).withColumn("trip_cents", F.expr(f"cents + metres * {KM_CENTS} div 1000 + (size(set) - 1) * {STOP_CENTS}"))
    key = F.array_join(F.col("set").cast("array<string>"), ",")
    w = Window.partitionBy("list_id").orderBy(F.desc("matched"), "trip_cents", key)
    return costed.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("list_id", key.alias("stores"), "matched", "cents", "metres", "trip_cents")


def nearby(stores: DataFrame, home: tuple[float, float], km: float) -> DataFrame:
    """Active stores within ``km``: a bounding box first, then the great circle."""
    lat, lon = home
    box = km / 111.0
    near = stores.where("is_active").where(F.col("latitude").between(lat - box, lat + box) & F.col("longitude").between(lon - 2 * box, lon + 2 * box))
    far = metres(F.col("latitude"), F.col("longitude"), F.lit(lat), F.lit(lon))
    return near.withColumn("metres", far).where(F.col("metres") <= km * 1000).select("store_id", "slug", "city", "metres")


def merged_lists(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Two copies of lists as one: quantities of both sides, the greater counts."""
    l, r = local.withColumnRenamed("quantity", "ours"), remote.withColumnRenamed("quantity", "theirs")
    both = l.join(r, ["list_id", "product_id"], "full_outer")
    origin = F.when(F.col("theirs").isNull(), "local").when(F.col("ours").isNull(), "remote").otherwise("both")
    return both.select("list_id", "product_id", F.greatest("ours", "theirs").alias("quantity"), origin.alias("origin"))
