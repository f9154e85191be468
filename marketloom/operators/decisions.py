"""Whether to buy: deal scores with decisions, plans that leave nothing out, and trips by preset."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.text import metres, pack_size_key
from marketloom.operators.baskets import store_sets
from marketloom.operators.pricing import history

# Deal scores


def _clamped(value: Column) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), value))


def market(live: DataFrame) -> DataFrame:
    """Of each product: stores that offer it (their best offer counts, a current one before any other), the range of these prices, and the same for today alone."""
    order = F.struct(F.col("upcoming"), "price_cents", "valid_from", "offer_id")
    best = live.where("price_cents > 0").groupBy("product_id", "store_id").agg(F.min_by(F.struct("price_cents", "upcoming"), order).alias("b"))
    now = F.when(~F.col("b.upcoming"), F.col("b.price_cents"))
    return best.groupBy("product_id").agg(
        F.count("*").alias("stores"), F.min("b.price_cents").alias("low"), F.max("b.price_cents").alias("high"), F.count(now).alias("stores_now"), F.min(now).alias("low_now")
    )


def exact_products(products: DataFrame) -> DataFrame:
    """``product_id`` and whether the product is known exactly: verified, of a brand, with a pack size."""
    known = F.coalesce("is_verified", F.lit(False)) & (F.trim(F.coalesce("brand", F.lit(""))) != "") & pack_size_key(F.col("label")).isNotNull()
    return products.select("product_id", known.alias("exact"))


def deal_decisions(live: DataFrame, offers: DataFrame, products: DataFrame, as_of: str) -> DataFrame:
    """``offer_id``, ``score`` (0 to 100), ``label`` and ``decision`` (buy, wait, skip, neutral; none if the product isn't known exactly).

    Up to four signals, each from 0 to 100 and with a weight: the price against
    the median of 90 days (of three prices at least), its place in the range of
    two stores or more, the discount (40 % is full), and the minimum of 30 days
    (of two prices). Fewer than two signals, or neither history nor market, are
    too little to decide.
    """
    day = F.lit(as_of).cast("date")
    recent = F.when(F.col("valid_from") > F.date_sub(day, 30), F.col("price_cents"))
    past = history(offers.where("price_cents > 0"), as_of).groupBy("product_id").agg(F.count("*").alias("seen"), F.median("price_cents").alias("usual"), F.count(recent).alias("seen_30"), F.min(recent).alias("min_30"))
    rows = live.drop("score").join(past, "product_id", "left").join(market(live), "product_id", "left").join(exact_products(products), "product_id", "left")
    price = F.col("price_cents").cast("double")
    spread = (F.col("high") - F.col("low")).cast("double")
    discount = F.when(F.col("old_cents") > F.col("price_cents"), (F.col("old_cents") - price) / F.col("old_cents") * 100)
    above = (price - F.col("min_30")) / F.col("min_30")
    signals = [
        (F.when((F.col("seen") >= 3) & (F.col("usual") > 0), _clamped(50 + (F.col("usual") - price) / F.col("usual") * 250)), 40),
        (F.when(F.col("stores") >= 2, F.when(spread < 1, 50.0).otherwise(_clamped((F.col("high") - price) / spread * 100))), 25),
        (_clamped(discount / 40 * 100), 20),
        (F.when((F.col("seen_30") >= 2) & (F.col("min_30") > 0), F.when(above <= 0.01, 100.0).otherwise(_clamped(100 - above * 400))), 15),
    ]
    signals = [(F.when(discount.isNotNull(), v) if w == 20 else v, w) for v, w in signals]
    count = sum((v.isNotNull().cast("int") for v, _ in signals), F.lit(0))
    weight = sum((F.when(v.isNotNull(), w).otherwise(0) for v, w in signals), F.lit(0))
    got = sum((F.coalesce(v, F.lit(0.0)) * w for v, w in signals), F.lit(0.0))
    exact = F.coalesce("exact", F.lit(False)) & (F.col("price_cents") > 0)
    enough = exact & (count >= 2) & ((F.coalesce("seen", F.lit(0)) >= 3) | (F.coalesce("stores", F.lit(0)) >= 2))
    score = F.when(enough, F.floor(got / weight + 0.5).cast("int"))
    scored = rows.select("*", score.alias("score"), exact.alias("_exact"), enough.alias("_enough"), discount.alias("_off"))
    today = ~F.col("upcoming")
    cheaper = today & (F.col("stores_now") >= 2) & (price * 100 > F.col("low_now") * 110)
    strong = F.coalesce(price * 100 <= F.col("usual") * 92, F.lit(False)) | F.coalesce(price * 100 <= F.col("min_30") * 103, F.lit(False)) | F.coalesce(F.col("_off") >= 25, F.lit(False))
    decision = F.when(~F.col("_exact"), "none").when(~F.col("_enough"), "neutral").when(F.coalesce(cheaper, F.lit(False)), "skip").when(today & (F.col("score") >= 85) & strong, "buy").otherwise("wait")
    label = F.when(F.col("score").isNull(), "unknown").when(F.col("score") >= 90, "exceptional").when(F.col("score") >= 75, "very good").when(F.col("score") >= 60, "good").otherwise("usual")
    return scored.select("offer_id", "score", label.alias("label"), decision.alias("decision"))


# Plans that leave nothing out

EXTRA_STORE_CENTS = 3500


def wanted_items(lists: DataFrame, live: DataFrame) -> DataFrame:
    """The items of each list that any offer fits; ``wanted`` is how many these are. The rest can't be planned."""
    sold = lists.join(live.select("product_id").distinct(), "product_id", "left_semi")
    return _counted(sold)


def _counted(items: DataFrame) -> DataFrame:
    """Items with ``wanted``, how many their list has; made where they lie, not joined with themselves."""
    return items.withColumn("wanted", F.count("*").over(Window.partitionBy("list_id")))


def item_offers(items: DataFrame, live: DataFrame) -> DataFrame:
    """What each store asks for each item, the better of its offers: a current one before one to come, then the cheapest."""
    best = live.groupBy("store_id", "product_id").agg(F.min(F.struct("upcoming", "price_cents", "offer_id")).alias("o"))
    return items.join(best, "product_id").select("list_id", "product_id", "quantity", "wanted", "store_id", "o.upcoming", "o.price_cents", "o.offer_id")


def set_plans(priced: DataFrame, most: int) -> DataFrame:
    """Every set of up to ``most`` of a list's stores that has all its items: each bought at the best offer of the set.

    ``used`` are the stores that something is bought in; sets that use fewer
    stores than they have are plans of the smaller set again, and left out.
    """
    offered = store_sets(priced.select("list_id", "store_id"), most).select("list_id", "set", F.explode("set").alias("store_id")).join(priced, ["list_id", "store_id"])
    best = offered.groupBy("list_id", "set", "product_id", "quantity", "wanted").agg(F.min(F.struct("upcoming", "price_cents", "store_id")).alias("o"))
    cost = F.col("o.price_cents") * F.col("quantity")
    plans = best.groupBy("list_id", "set", "wanted").agg(F.count("*").alias("n"), F.sum(cost).alias("cents"), F.array_sort(F.collect_set("o.store_id")).alias("used"), F.count_if("o.upcoming").alias("upcoming"))
    return plans.where((F.col("n") == F.col("wanted")) & (F.size("used") == F.size("set"))).select("list_id", "used", "cents", "upcoming")


def _named(used: str = "used") -> Column:
    return F.array_join(F.col(used).cast("array<string>"), ",")


def absolute_plan(lists: DataFrame, live: DataFrame) -> DataFrame:
    """Each item at its best offer anywhere: current before to come, then cheapest."""
    best = item_offers(wanted_items(lists, live), live).groupBy("list_id", "product_id", "quantity").agg(F.min(F.struct("upcoming", "price_cents", "store_id")).alias("o"))
    return best.groupBy("list_id").agg(F.count("*").alias("items"), F.sum(F.col("o.price_cents") * F.col("quantity")).alias("cents"), F.count_distinct("o.store_id").alias("stores"), F.count_if("o.upcoming").alias("upcoming"))


def one_store_plan(lists: DataFrame, live: DataFrame) -> DataFrame:
    """The cheapest store that has everything; lists without such a store have no plan."""
    return _cheapest(set_plans(item_offers(wanted_items(lists, live), live), 1), F.col("cents"))


def balanced_plan(lists: DataFrame, live: DataFrame) -> DataFrame:
    """The cheapest of all single stores and pairs that have everything, a second store costing EXTRA_STORE_CENTS."""
    plans = set_plans(item_offers(wanted_items(lists, live), live), 2)
    return _cheapest(plans, F.col("cents") + (F.size("used") - 1) * EXTRA_STORE_CENTS)


def _cheapest(plans: DataFrame, charged: Column) -> DataFrame:
    rows = plans.select("list_id", _named().alias("stores"), "cents", "upcoming", charged.cast("bigint").alias("charged"), F.size("used").alias("k"))
    best = rows.groupBy("list_id").agg(F.min_by(F.struct("stores", "cents", "upcoming", "charged"), F.struct("charged", "k", "stores")).alias("b"))
    return best.select("list_id", "b.*")


@dataclass(frozen=True)
class Trip:
    """How far to go, how many stores to enter, and what a kilometre and a further stop weigh."""

    most_stores: int
    radius_km: float
    km_cents: int
    stop_cents: int


# The presets of a trip.
PRESETS = {"quick": Trip(1, 10, 800, 8000), "balanced": Trip(2, 15, 500, 3000), "saving": Trip(3, 25, 300, 1000)}


def trips(lists: DataFrame, live: DataFrame, branches: DataFrame, home: tuple[float, float], trip: Trip) -> DataFrame:
    """The trip of least weight that brings home all of each list: goods, the way out, further stops.

    Only the nearest branch of each store (``store_id``, ``branch_id``) within the
    radius counts, and only offers of those stores; a list that they don't have
    in full has no trip. The way ends at the last store.
    """
    lat, lon = home
    far = metres(F.lit(lat), F.lit(lon), F.col("latitude"), F.col("longitude"))
    near = branches.withColumn("metres", far).where(F.col("metres") <= trip.radius_km * 1000)
    nearest = near.groupBy("store_id").agg(F.min_by(F.struct("latitude", "longitude", "branch_id"), F.struct("metres", "branch_id")).alias("at"))
    own = live.where("not upcoming").join(nearest.select("store_id"), "store_id", "left_semi")
    # Everything of a list must be sold near, so items are counted over all live offers.
    plans = set_plans(item_offers(_counted(lists), own), min(max(trip.most_stores, 1), 3))
    sets = plans.select("used").distinct()
    stops = sets.select("used", F.posexplode("used").alias("k", "store_id")).join(nearest, "store_id")
    placed = stops.groupBy("used").agg(F.array_sort(F.collect_list(F.struct("k", "at"))).alias("p"))
    at = lambda k: F.get("p", F.lit(k))["at"]
    leg = lambda a, b: metres(a["latitude"], a["longitude"], b["latitude"], b["longitude"])
    start = F.struct(F.lit(lat).alias("latitude"), F.lit(lon).alias("longitude"))

    def way(*order: int) -> Column:
        return sum((leg(at(a), at(b)) for a, b in zip(order, order[1:])), leg(start, at(order[0])))

    orders = {1: [(0,)], 2: [(0, 1), (1, 0)], 3: [(0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)]}
    shortest = {n: F.least(*(way(*o) for o in some)) if len(some) > 1 else way(*some[0]) for n, some in orders.items()}
    length = F.when(F.size("used") == 1, shortest[1]).when(F.size("used") == 2, shortest[2]).otherwise(shortest[3])
    ways = placed.select("used", length.alias("metres"))
    weight = F.expr(f"cents + metres * {trip.km_cents} div 1000 + (size(used) - 1) * {trip.stop_cents}")
    rows = plans.join(ways, "used").select("list_id", _named().alias("stores"), "cents", "metres", weight.alias("weight"))
    best = rows.groupBy("list_id").agg(F.min_by(F.struct("stores", "cents", "metres", "weight"), F.struct("weight", "stores")).alias("b"))
    return best.select("list_id", "b.*")


# Savings of the list as it stands


def autopilot(lists: DataFrame, live: DataFrame) -> DataFrame:
    """Of each list: total, savings, stores, how many items are linked or missing, and how many have a former price, by the cheapest offers that hold today."""
    best = live.where(~F.col("upcoming") & (F.col("price_cents") >= 0)).groupBy("product_id").agg(F.min(F.struct("price_cents", "offer_id", "store_id", "old_cents")).alias("o"))
    rows = lists.join(best, "product_id", "left")
    price, before = F.col("o.price_cents"), F.col("o.old_cents")
    fell = F.coalesce(before > price, F.lit(False))
    zero = F.lit(0).cast("bigint")
    return rows.groupBy("list_id").agg(
        F.coalesce(F.sum(price * F.col("quantity")), zero).alias("cents"),
        F.coalesce(F.sum(F.when(fell, before - price) * F.col("quantity")), zero).alias("saved"),
        F.count_distinct("o.store_id").alias("stores"),
        F.count("o.offer_id").alias("linked"),
        F.count_if(F.col("o").isNull()).alias("missing"),
        F.count_if(fell).alias("documented"),
    )
