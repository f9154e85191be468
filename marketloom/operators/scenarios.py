"""Plans for an occasion: what a scenario needs, bought at few stores, no product twice.

A scenario is a list of needs in order, each with words that fit it and a
quantity for so many people. For every set of stores the needs are met one after
another: each takes the cheapest fitting product that no need before it took.
All scenarios and sets are planned at once; a set's needs are folded in one
expression over a list of bounded size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.functions.text import fold, metres

KM_CENTS, STOP_CENTS = 600, 3500
#: The most stores of a plan.
MOST_STORES = 3
#: Stores of each kind, and pairs of each scenario, that are tried first.
FEW, TRIED = 3, 200


@dataclass(frozen=True)
class Need:
    """``words`` that fit, any of them; one piece for so many people, or one in all."""

    label: str
    words: tuple[str, ...]
    people_per_piece: int | None = None


#: Some occasions; a parameter of :func:`needs`.
OCCASIONS: dict[str, tuple[Need, ...]] = {
    "breakfast": (Need("bread", ("rohlik", "chleb"), 3), Need("butter", ("maslo",), 6), Need("milk", ("mleko",), 4), Need("coffee", ("kava",), 8)),
    "grill": (Need("bread", ("chleb", "rohlik"), 3), Need("beer", ("pivo",), 3), Need("grill", ("gril",)), Need("drinks", ("pivo", "kava"), 4)),
    "household": (Need("washing", ("praci",)), Need("shampoo", ("sampon",)), Need("pets", ("krmivo",)), Need("vitamins", ("vitamin",), 5), Need("pot", ("hrnec",))),
}


def needs(spark: SparkSession, people: int, occasions: dict[str, tuple[Need, ...]] = OCCASIONS) -> DataFrame:
    """``scenario``, ``place`` (order of its needs), ``label``, ``word`` and ``quantity``: a row for each word."""
    rows = [
        (name, k, need.label, word, math.ceil(people / need.people_per_piece) if need.people_per_piece else 1)
        for name, list_ in occasions.items() for k, need in enumerate(list_) for word in need.words
    ]
    return spark.createDataFrame(rows, "scenario string, place int, label string, word string, quantity int").withColumn("word", fold(F.col("word")))


def fitting(wanted: DataFrame, offers: DataFrame, texts: DataFrame) -> DataFrame:
    """The offers of each need that can matter: per store the cheapest one of each product, and of those as many as its scenario has needs.

    More can't be taken by the needs before. ``texts`` says which ``search_text``
    holds which word (``query``).
    """
    size = wanted.groupBy("scenario").agg((F.max("place") + 1).alias("size"))
    meant = wanted.join(texts, F.col("word") == F.col("query")).select("scenario", "place", "quantity", F.col("text").alias("search_text")).distinct()
    found = meant.join(offers.where("product_id is not null and price_cents > 0"), "search_text")
    once = found.groupBy("scenario", "place", "quantity", "store_id", "product_id").agg(F.min(F.struct("price_cents", "offer_id", "old_cents")).alias("o"))
    w = Window.partitionBy("scenario", "place", "store_id").orderBy("o.price_cents", "product_id", "o.offer_id")
    ranked = once.withColumn("nth", F.row_number().over(w)).join(size, "scenario").where(F.col("nth") <= F.col("size"))
    return ranked.select("scenario", "place", "quantity", "store_id", "product_id", "o.price_cents", "o.old_cents", "o.offer_id")


def plans(fits: DataFrame, stores: DataFrame, home: tuple[float, float], most: int = 2) -> DataFrame:
    """Every set of up to ``most`` stores of each scenario with what it buys: needs met, cost, savings, stores used, the way to them."""
    have = fits.select("scenario", "store_id").distinct()
    sets = have.select("scenario", F.array("store_id").alias("set"), F.col("store_id").alias("last"))
    every = sets
    for _ in range(min(max(most, 1), MOST_STORES) - 1):
        sets = sets.join(have, "scenario").where("store_id > last").select("scenario", F.array_append("set", F.col("store_id")).alias("set"), F.col("store_id").alias("last"))
        every = every.unionByName(sets)
    return plans_of(every.drop("last"), fits, stores, home)


def plans_of(sets: DataFrame, fits: DataFrame, stores: DataFrame, home: tuple[float, float]) -> DataFrame:
    """What each ``set`` of stores of a ``scenario`` buys, as in :func:`plans`."""
    offered = sets.withColumn("store_id", F.explode("set")).join(fits, ["scenario", "store_id"])
    one = F.struct("price_cents", "product_id", "offer_id", "store_id", F.coalesce(F.greatest("old_cents", "price_cents"), "price_cents").alias("before"), "quantity")
    by_need = offered.groupBy("scenario", "set", "place").agg(F.array_sort(F.collect_list(one)).alias("offers"))
    lists = by_need.groupBy("scenario", "set").agg(F.array_sort(F.collect_list(F.struct("place", "offers"))).alias("needs"))
    taken = F.aggregate(
        "needs",
        F.expr("cast(array() as array<struct<price_cents: bigint, product_id: bigint, offer_id: string, store_id: bigint, before: bigint, quantity: int>>)"),
        lambda acc, need: F.concat(acc, F.slice(F.filter(need["offers"], lambda o: ~F.array_contains(F.transform(acc, lambda t: t["product_id"]), o["product_id"])), 1, 1)),
    )
    zero = F.lit(0).cast("bigint")
    total = lambda name: F.aggregate("taken", zero, lambda s, t: s + t[name] * t["quantity"])
    bought = lists.select("scenario", "set", taken.alias("taken"))
    summed = bought.select("scenario", "set", F.size("taken").alias("matched"), total("price_cents").alias("cents"), (total("before") - total("price_cents")).alias("saved"), F.array_sort(F.array_distinct(F.transform("taken", lambda t: t["store_id"]))).alias("used"))
    return _with_way(summed, stores, home)


def _with_way(found: DataFrame, stores: DataFrame, home: tuple[float, float]) -> DataFrame:
    """The shortest way from ``home`` over the used stores, and what it makes the plan cost."""
    spots = stores.select("store_id", "latitude", "longitude")
    sets = found.select("used").distinct()
    stops = sets.select("used", F.posexplode("used").alias("k", "store_id")).join(spots, "store_id")
    placed = stops.groupBy("used").agg(F.array_sort(F.collect_list(F.struct("k", "latitude", "longitude"))).alias("p"))
    start = F.struct(F.lit(home[0]).alias("latitude"), F.lit(home[1]).alias("longitude"))
    at = lambda k: F.get("p", F.lit(k))
    leg = lambda a, b: metres(a["latitude"], a["longitude"], b["latitude"], b["longitude"])

    def way(*order: int):
        first = leg(start, at(order[0]))
        return sum((leg(at(a), at(b)) for a, b in zip(order, order[1:])), first)

    three = F.least(*(way(*o) for o in ((0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0))))
    length = F.when(F.size("used") == 1, way(0)).when(F.size("used") == 2, F.least(way(0, 1), way(1, 0))).otherwise(three)
    cost = F.expr(f"cents + metres * {KM_CENTS} div 1000 + (size(used) - 1) * {STOP_CENTS}")
    return found.join(placed.select("used", length.alias("metres")), "used").withColumn("cost", cost)


def _goods_of(a: str, b: str) -> Column:
    """What a pair that meets ``upper`` needs pays at least: the lesser cost of each place, of so many of the cheapest places."""
    costs = F.map_values(F.map_zip_with(a, b, lambda _, x, y: F.least(x, y)))
    return F.aggregate(F.slice(F.array_sort(costs), F.lit(1), F.col("upper")), F.lit(0).cast("bigint"), lambda total, cents: total + cents)


def _at_least(goods: Column, way: str, stops: int) -> Column:
    """What a plan costs at least. Each leg of a way is rounded, so it may be shorter than its farthest store by less than a metre a leg."""
    return goods + F.expr(f"greatest({way}, 0) * {KM_CENTS} div 1000") + stops * STOP_CENTS


def store_kinds(fits: DataFrame, stores: DataFrame, home: tuple[float, float]) -> DataFrame:
    """Of each store of a scenario: ``costs`` (the least of each place), ``mask`` of the places, ``n`` (how many of them its products can meet at most), the ``way`` there."""
    by_place = fits.groupBy("scenario", "store_id", "place").agg(F.min(F.col("price_cents") * F.col("quantity")).alias("cents"), F.collect_set("product_id").alias("products"))
    own = by_place.groupBy("scenario", "store_id").agg(
        F.map_from_entries(F.collect_list(F.struct("place", "cents"))).alias("costs"), F.expr("bit_or(shiftleft(1L, place))").alias("mask"), F.size(F.array_distinct(F.flatten(F.collect_list("products")))).alias("n")
    )
    way = metres(F.lit(home[0]), F.lit(home[1]), F.col("latitude"), F.col("longitude"))
    placed = own.join(stores.select("store_id", (way - MOST_STORES).alias("way")), "store_id")
    return placed.withColumn("n", F.least("n", F.bit_count("mask")))


def promising_pairs(kinds: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs of stores that can be as good as the ``known`` plan of their scenario (``matched``, ``cost``), and perhaps some more.

    Stores are first compared by kind (``mask`` and ``n``): a pair meets no more
    needs than its kinds together. Of pairs that can meet just as many, a store
    stays only if it could keep the cost with the best of the other kind.
    """
    by = ["scenario", "mask", "n"]
    least = kinds.select(*by, F.explode("costs").alias("place", "cents")).groupBy(*by, "place").agg(F.min("cents").alias("cents"))
    best = least.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("place", "cents"))).alias("costs"))
    each = best.join(kinds.groupBy(*by).agg(F.min("way").alias("way")), by)
    side = lambda rows, k: rows.select("scenario", *(F.col(c).alias(f"{c}_{k}") for c in rows.columns if c != "scenario"))
    both = side(each, "a").join(side(each, "b"), "scenario").where("struct(mask_a, n_a) <= struct(mask_b, n_b)").join(F.broadcast(known), "scenario")
    both = both.withColumn("upper", F.least(F.bit_count(F.col("mask_a").bitwiseOR(F.col("mask_b"))), F.col("n_a") + F.col("n_b"))).where("upper >= matched")
    kept = (F.col("upper") > F.col("matched")) | (_at_least(_goods_of("costs_a", "costs_b"), "greatest(way_a, way_b)", 1) <= F.col("cost"))
    pairs = both.where(kept)
    one, other = (
        side(kinds, k).join(F.broadcast(pairs.drop(f"costs_{k}", f"way_{k}")), ["scenario", f"mask_{k}", f"n_{k}"]).where(kept)
        for k in ("a", "b")
    )
    key = ["scenario", "mask_a", "n_a", "mask_b", "n_b"]
    met = one.select(*key, "store_id_a", "costs_a", "way_a", "upper", "matched", "cost").join(other.select(*key, "store_id_b", "costs_b", "way_b"), key)
    same = F.expr("mask_a = mask_b and n_a = n_b")
    met = met.where(F.col("store_id_a") != F.col("store_id_b")).where(~same | (F.col("store_id_a") < F.col("store_id_b"))).where(kept)
    return met.select("scenario", F.array_sort(F.array("store_id_a", "store_id_b")).alias("set"))


def first_sets(kinds: DataFrame) -> DataFrame:
    """Each store alone and some pairs that look good, to have a plan that others must reach; which pairs makes no difference to results."""
    way = F.expr(f"way * {KM_CENTS} div 1000")
    w = Window.partitionBy("scenario", "mask", "n").orderBy(F.aggregate(F.map_values("costs"), F.lit(0).cast("bigint"), lambda total, cents: total + cents) + way, "store_id")
    few = kinds.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= FEW)
    a = few.select("scenario", *(F.col(c).alias(f"{c}_a") for c in ("store_id", "costs", "mask", "n", "way")))
    b = few.select("scenario", *(F.col(c).alias(f"{c}_b") for c in ("store_id", "costs", "mask", "n", "way")))
    upper = F.least(F.bit_count(F.col("mask_a").bitwiseOR(F.col("mask_b"))), F.col("n_a") + F.col("n_b"))
    bound = _at_least(_goods_of("costs_a", "costs_b"), "greatest(way_a, way_b)", 1)
    first = Window.partitionBy("scenario").orderBy(F.desc("upper"), "bound", "store_id_a", "store_id_b")
    pairs = a.join(b, "scenario").where("store_id_a < store_id_b").withColumn("upper", upper).select("scenario", "store_id_a", "store_id_b", "upper", bound.alias("bound"))
    good = pairs.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= TRIED)
    return kinds.select("scenario", F.array("store_id").alias("set")).unionByName(good.select("scenario", F.array("store_id_a", "store_id_b").alias("set")))


def best_plans(fits: DataFrame, stores: DataFrame, home: tuple[float, float], most: int = 2) -> DataFrame:
    """The plan of each scenario that meets most needs, then costs least with its way, then uses fewest stores.

    Pairs that can't be as good as a plan found before are not tried; sets of
    three all are. A set of which only some stores are used is the plan of those
    again, so it needs no trial for its sake.
    """
    if most != 2:
        return _best(plans(fits, stores, home, most))
    kinds = store_kinds(fits, stores, home)
    first = plans_of(first_sets(kinds), fits, stores, home)
    known = first.groupBy("scenario").agg(F.min(F.struct((-F.col("matched")).alias("a"), "cost")).alias("k")).select("scenario", (-F.col("k.a")).alias("matched"), "k.cost")
    more = promising_pairs(kinds, known)
    return _best(first.unionByName(plans_of(more, fits, stores, home)))


def _best(tried: DataFrame) -> DataFrame:
    text = F.array_join(F.col("used").cast("array<string>"), ",")
    key = F.struct((-F.col("matched")).alias("a"), "cost", F.size("used").alias("b"), text.alias("stores"))
    best = tried.groupBy("scenario").agg(F.min_by(F.struct("matched", "cents", "saved", "metres", "cost", text.alias("stores")), key).alias("best"))
    return best.select("scenario", "best.*")
