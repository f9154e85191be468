from itertools import combinations

from marketloom.operators import baskets


def test_best_trip_may_need_stores_beyond_the_first_four(spark):
    """Against every set of up to three stores, all at one place, so trips differ in stops only."""
    sells = {1: {1: 100, 2: 100}, 2: {1: 110, 2: 90}, 3: {1: 120, 2: 95}, 4: {1: 130, 2: 130}, 5: {3: 500}, 6: {4: 700}}
    offers = [(s, p, 10 * s + p, c, c, False, "2026-01-01") for s, has in sells.items() for p, c in has.items()]
    live = spark.createDataFrame(offers, "store_id long, product_id long, offer_id long, price_cents long, old_cents long, upcoming boolean, valid_from string")
    lists = spark.createDataFrame([(7, p, 2) for p in (1, 2, 3, 4)], "list_id long, product_id long, quantity long")
    stores = spark.createDataFrame([(s, 49.5, 15.0) for s in sells], "store_id long, latitude double, longitude double")

    def priced(chosen):
        cheapest = {p: min(sells[s][p] for s in chosen if p in sells[s]) for s in chosen for p in sells[s]}
        return -len(cheapest), 2 * sum(cheapest.values()) + (len(chosen) - 1) * baskets.STOP_CENTS, ",".join(map(str, chosen))

    best = min(priced(c) for n in (1, 2, 3) for c in combinations(sells, n))
    (got,) = baskets.routes(lists, live, stores, (49.5, 15.0)).collect()
    assert (-got.matched, got.trip_cents, got.stores) == best and got.matched == 4
