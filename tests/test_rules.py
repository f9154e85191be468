import datetime

import pytest

from marketloom.functions import text
from marketloom.operators import decisions, matching, ranges

F = text.F
DAY = datetime.date(2026, 3, 1)


@pytest.mark.parametrize("title, key", [
    ("Mléko 1,5% 2x900 ml", "1800ml"), ("Paralen 500 mg tablety (24", "24ks"), ("2 x 10 g tobolka balení 30 ", "30ks"), ("Paralen tablety 500 mg, 24", "0.5g"), ("500 mg 12 x 10 cl a 3 kg", "1200ml"), ("0,5 g", "0.5g"), ("250 mg", "0.25g"), ("1,00 kg", "1000g"),
    ("8 rolí", "8role"), ("3 × 2 kusy", "6ks"), ("10 gramů", None), ("2kgx", None), ("5 dávek", "5davka"), ("Televize 55", None), (None, None), ("1 kg nebo 2 l", "2000ml"), ("100 ks", "100ks"),
])
def test_pack_sizes(spark, title, key):
    assert spark.createDataFrame([(title,)], "t string").select(text.pack_size_key(F.col("t"))).first()[0] == key


@pytest.mark.parametrize("line, cents", [("Milk 2 kusy 32 90 Weekly deal", 3290), ("32 90 weekly deal  ", 3290), ("Milk 32 90", None), ("1 99 Weekly deal", None), ("99999 99 Weekly deal", 9999999), ("x32 90 Weekly deal", None), ("Weekly deal", None), (None, None)])
def test_split_prices(spark, line, cents):
    assert spark.createDataFrame([(line,)], "t string").select(matching.repaired_price(F.col("t"), "Weekly deal")).first()[0] == cents


def test_match_evidence(spark):
    rows = [(1, "Milk Acme 1 l", "milk acme 1 l", "Acme"), (2, "Milk 1 l", "milk 2 l", None), (3, "Milk", "milk 1 l", None), (4, "Akce", "akce", None), (5, "Acme beer", "beer", "Acme"), (6, None, "x", None), (7, "fresh bread", "bread fresh", "")]
    got = {r.k: (r.score, r.quantity, r.evidence, r.safe) for r in matching.match_evidence(spark.createDataFrame(rows, "k int, title string, source string, brand string"), "title", "source", "brand", ["k"]).collect()}
    assert got[1] == (1.0, "same", 4, True) and got[2] == (0.6, "mismatch", 1, False) or got[2][1:] == ("mismatch", 1, False)
    assert got[3][1:] == ("missing", 0, False) or got[3][1] == "missing" and not got[3][3]
    assert got[4][3] is False and got[5][1] == "none" and got[7][3] is False and not got[6][3]


def offer(store, product, price, old=None, upcoming=False, ident=None):
    return ident or f"{store}-{product}", store, product, price, old, upcoming, str(DAY)


LIVE = "offer_id string, store_id long, product_id long, price_cents long, old_cents long, upcoming boolean, valid_from string"


def test_plans_have_everything_and_prefer_today(spark):
    live = spark.createDataFrame([offer(1, 1, 500), offer(1, 2, 500), offer(2, 1, 100), offer(3, 2, 100), offer(2, 2, 90, upcoming=True), offer(4, 3, 10)], LIVE)
    lists = spark.createDataFrame([(7, 1, 1), (7, 2, 10), (7, 99, 1), (8, 1, 1), (8, 3, 1), (9, 99, 1)], "list_id long, product_id long, quantity long")
    absolute = {r.list_id: (r.items, r.cents, r.stores, r.upcoming) for r in decisions.absolute_plan(lists, live).collect()}
    assert absolute == {7: (2, 1100, 2, 0), 8: (2, 110, 2, 0)}  # what is on offer today, though 90 is to come
    one = {r.list_id: (r.stores, r.cents, r.upcoming) for r in decisions.one_store_plan(lists, live).collect()}
    assert one == {7: ("2", 1000, 1)}
    balanced = {r.list_id: (r.stores, r.cents, r.charged) for r in decisions.balanced_plan(lists, live).collect()}
    assert balanced == {7: ("2", 1000, 1000), 8: ("2,4", 110, 3610)}


def test_trips_end_at_the_last_store(spark):
    live = spark.createDataFrame([offer(1, 1, 500), offer(2, 1, 100), offer(2, 2, 100), offer(3, 2, 1), offer(4, 1, 1)], LIVE)
    lists = spark.createDataFrame([(7, 1, 1), (7, 2, 1), (8, 1, 1), (8, 99, 1)], "list_id long, product_id long, quantity long")
    branches = spark.createDataFrame([(1, 1, 50.0, 15.0), (2, 2, 50.05, 15.0), (2, 3, 51.0, 15.0), (3, 4, 50.01, 15.0), (4, 5, 60.0, 15.0)], "store_id long, branch_id long, latitude double, longitude double")
    (got,) = decisions.trips(lists, live, branches, (50.0, 15.0), decisions.Trip(2, 10, 500, 3000)).collect()
    assert (got.list_id, got.stores, got.cents) == (7, "2", 200) and 5500 < got.metres < 5600 and got.weight == 200 + got.metres * 500 // 1000
    (got,) = decisions.trips(lists, live, branches, (50.0, 15.0), decisions.Trip(2, 10, 100_000, 0)).collect()
    assert got.stores == "1,3" and got.metres < 1200
    assert decisions.trips(lists, live, branches, (50.0, 15.0), decisions.Trip(1, 1, 0, 0)).count() == 0


def test_decisions(spark):
    ago = lambda n: DAY - datetime.timedelta(days=n)
    past = [(p, 1, c, ago(n)) for p, c, n in [(1, 1000, 5), (1, 1000, 20), (1, 1200, 60), (2, 100, 5), (3, 1000, 5), (3, 1000, 20), (3, 1000, 60), (4, 1000, 5), (4, 1000, 20), (4, 1000, 60)]]
    offers = spark.createDataFrame(past, "product_id long, store_id long, price_cents long, valid_from date")
    live = spark.createDataFrame([offer(1, 1, 700, 1200), offer(1, 2, 100), offer(1, 3, 1000, 2000), offer(2, 3, 800), offer(1, 4, 700, 1200), offer(1, 9, 5), offer(3, 1, 690, 1200, True)], LIVE)
    products = spark.createDataFrame([(1, "Milk 1 l", "A", True), (2, "Milk 1 l", "A", True), (3, "Milk 1 l", "A", True), (4, "Milk", "A", True)], "product_id long, label string, brand string, is_verified boolean")
    got = {r.offer_id: (r.score, r.label, r.decision) for r in decisions.deal_decisions(live, offers, products, str(DAY)).collect()}
    # 1-1: usual 1000, range 690 to 700 of two stores: (100*40 + 0*25 + 100*20 + 100*15) / 100
    assert got["1-1"] == (75, "very good", "wait") and got["1-2"] == (None, "unknown", "neutral") and got["1-3"][2] == "skip"
    assert got["2-3"] == (100, "exceptional", "buy") and got["1-4"] == (None, "unknown", "none") and got["1-9"][2] == "none" and got["3-1"] == (100, "exceptional", "wait")


def test_counts_within_a_tolerance(spark):
    rows = [(k, "a", g) for k, g in enumerate([100, 100, 101, 102, 103, 200, 0, 5, 98])] + [(50, "b", 100), (51, "b", None)]
    got = {r.product_id: r.alike for r in ranges.count_within_tolerance(spark.createDataFrame(rows, "product_id long, brand string, grams long"), ["brand"], "grams", 2).collect()}
    amount = {k: g for k, b, g in rows if b == "a" and g}
    want = {k: sum(abs(g - h) * 100 <= max(g, h) * 2 for j, h in amount.items() if j != k) for k, g in amount.items()}
    assert got == want | {50: 0}


def test_best_pictures(spark):
    from marketloom.operators import images

    offers = spark.createDataFrame([("a", "Fresh milk Acme"), ("b", "Dark bread"), ("c", "Nothing"), ("d", None)], "offer_id string, title string")
    pictures = spark.createDataFrame([("https://x/1", "fresh milk", True, 80), ("https://x/2", "fresh milk acme", False, 10), ("http://x/3", "fresh milk acme", True, 99), ("https://x/4", "dark chocolate", False, 90), ("https://x/5", None, True, 90)], "url string, title string, verified boolean, quality int")
    got = {r.offer_id: (r.url, r.score) for r in images.best_pictures(offers, pictures).collect()}
    assert got == {"a": ("https://x/2", 1.0)}
    rows = spark.createDataFrame([("mléko 1 l plnotučné", "Mléko 2 l"), (None, "x y"), ("rohlik", "rohlik"), ("ab cd", "cd ef")], "l string, r string")
    scores = [tuple(r[0]) for r in rows.select(images.lexical_score(F.col("l"), F.col("r"))).collect()]
    assert scores[0][1:] == (1, True) and scores[1] == (0.0, 0, False) and scores[2] == (0.88, 1, True) and scores[3][1:] == (1, False)


def test_due_sources(spark):
    from marketloom.operators import health

    rows = [(1, None, 60), (2, "2026-01-01 11:00:00", 60), (3, "2026-01-01 11:00:01", 60), (4, "2026-01-01 06:00:00", None), (5, "2026-01-01 06:00:01", 0), (6, "2026-01-01 11:45:00", 1), (7, "2026-01-01 11:46:00", 1)]
    sources = spark.createDataFrame(rows, "k int, at string, every_minutes int").withColumn("checked_at", F.col("at").cast("timestamp"))
    assert sorted(r.k for r in health.due(sources, F.lit("2026-01-01 12:00:00").cast("timestamp")).collect()) == [1, 2, 4, 6]
