"""What queries look at does not outgrow their input."""

import datetime
import itertools
import random

from pyspark.sql import functions as F

from marketloom.functions import tags
from marketloom.operators import baskets, decisions, images, matching, ranges, scenarios, search
from marketloom.plans import registry
from marketloom.sources import offer_store, retail

DAY = datetime.date(1998, 6, 1)


def test_texts_are_described_once_each_not_once_for_each_offer(spark, tmp_path, monkeypatch):
    looked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(value):
        looked.add(1)
        return value

    real = tags.offer_tags
    monkeypatch.setattr(search.tags, "offer_tags", lambda folded: real(counted(folded)))
    offers = spark.createDataFrame(
        [(f"{p}-{k}", p, 1, 100 + k, None, DAY, DAY, "published", True, "store", DAY, k, 1) for p in (1, 2, 3, 9) for k in range(25)],
        "offer_id string, product_id long, store_id long, price_cents long, old_cents long, valid_from date, valid_to date, status string, is_verified boolean, coverage string, published_at date, list_id long, quantity long",
    )
    stores = spark.createDataFrame([(1, "a", "B", "C", True)], "store_id long, slug string, city string, region string, is_active boolean")
    products = spark.createDataFrame([(1, "Máslo 250 g", None, "x", "c"), (2, "Máslo 250 g", None, "x", "c"), (3, None, "b", "y", "c")], "product_id long, label string, brand string, name string, category string")
    store = offer_store.OfferStore(spark, str(tmp_path / "store"))
    offer_store.publish(store, offers, stores, products)
    found = store.cache().groupBy("product_id", "search_text", "filter_group", "tags", "folded_label").count().orderBy("product_id").collect()
    assert [tuple(r) for r in found] == [(1, "maslo 250 g x", "food", ["butter"], "maslo 250 g", 25), (2, "maslo 250 g x", "food", ["butter"], "maslo 250 g", 25), (3, "b y", "other", [], None, 25), (9, "", "other", [], None, 25)]
    assert looked.value <= 4 * len(tags.TAGS)  # two texts, of which a plan may ask for each rule; 100 offers before


def test_occasions_try_few_pairs_and_find_the_best_of_all(spark, monkeypatch):
    rng = random.Random(11)
    fits, n = [], 0
    for k, (stores, share, products) in enumerate([(30, 0.3, 6), (30, 0.2, 60), (30, 0.8, 3), (12, 1.0, 2), (250, 0.25, 200)]):
        for store in range(stores):
            for place in range(4):
                # A product may fit several places and be taken by one of them only.
                for product in {rng.randrange(products) for _ in range(4)} if rng.random() < share else ():
                    n += 1
                    fits.append((f"s{k}", place, 1 + place % 3, store, product, rng.choice([rng.randint(1, 9) * 100, rng.randint(1, 90_000)]), rng.choice([None, 500]), f"o{n:05}"))
    rows = spark.createDataFrame(fits, "scenario string, place int, quantity int, store_id long, product_id long, price_cents long, old_cents long, offer_id string")
    spots = spark.createDataFrame([(s, 48.5 + (s * 37 % 250) / 100, 12 + (s * 53 % 680) / 100) for s in range(250)], "store_id long, latitude double, longitude double")
    home, tried, real = (49.5, 15.0), [], scenarios.plans_of
    want = sorted(map(tuple, scenarios._best(scenarios.plans(rows, spots, home, 2)).collect()))

    def counted(sets, *rest):
        tried.append(sets.where("scenario = 's4'").count())
        return real(sets, *rest)

    monkeypatch.setattr(scenarios, "plans_of", counted)
    assert sorted(map(tuple, scenarios.best_plans(rows, spots, home).collect())) == want
    have = rows.where("scenario = 's4'").select("store_id").distinct().count()
    assert have > 120 and sum(tried) < have + 2 * scenarios.TRIED < have * have / 8  # all pairs before


def test_lines_are_spread_over_parts_that_grow_in_number(spark, sf_dir):
    lines = retail.table(spark, sf_dir, "lineitem")
    n = lines.count()
    assert retail.spread(lines).rdd.getNumPartitions() == lines.rdd.getNumPartitions()
    spread = retail.spread(lines, 100)
    at = spread.select("l_orderkey", F.spark_partition_id().alias("at"))
    assert spread.rdd.getNumPartitions() == -(-n // 100) and at.count() == n
    assert at.groupBy("l_orderkey").agg(F.count_distinct("at").alias("k")).where("k > 1").isEmpty()


def test_items_of_a_list_are_counted_without_reading_the_lists_again(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(value):
        read.add(1)
        return value

    lists = spark.createDataFrame([(1, 1, 2), (1, 2, 1), (2, 1, 1)], "list_id long, product_id long, quantity long").withColumn("product_id", counted.asNondeterministic()("product_id"))
    sold = spark.createDataFrame([(1,), (2,)], "product_id long")
    got = decisions.wanted_items(lists, sold).select("list_id", "product_id", "quantity", "wanted").collect()
    assert sorted(map(tuple, got)) == [(1, 1, 2, 2), (1, 2, 1, 2), (2, 1, 1, 1)]
    assert read.value == 3  # each item is made once


def test_overlaps_read_each_offer_once(spark):
    rng = random.Random(4)
    made = [(f"o{k}", rng.randrange(4), rng.randint(1, 30), rng.randint(0, 9)) for k in range(120)]
    rows = [(i, key, datetime.date(1998, 5, d), datetime.date(1998, 5, d) + datetime.timedelta(n)) for i, key, d, n in made]
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(value):
        read.add(1)
        return value

    offers = spark.createDataFrame(rows, "offer_id string, k int, valid_from date, valid_to date").withColumn("offer_id", counted.asNondeterministic()("offer_id"))
    want = {i: n for i, k, a, b in rows if (n := sum(k == l and j != i and c <= b and a <= d for j, l, c, d in rows))}
    assert {r.offer_id: r.overlaps for r in ranges.overlapping(offers, ["k"]).collect()} == want
    assert read.value == len(rows)


def test_names_are_compared_once_for_each_different_text(spark, monkeypatch):
    looked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(value):
        looked.add(1)
        return value

    real = images.pack_size_key
    monkeypatch.setattr(images, "pack_size_key", lambda text: real(counted(text)))
    rows = spark.createDataFrame([(k, "Pivo 0,5 l", ["x", "y", None][k % 3]) for k in range(300)], "product_id long, label string, name string")
    found = images.lexical_scores(rows, F.concat_ws(" ", "label", "name"), F.col("label"), ["label", "name"])
    want = {(r.name, r.m) for r in rows.select("name", images.lexical_score(F.concat_ws(" ", "label", "name"), F.col("label")).alias("m")).collect()}
    looked.value = 0
    got = found.collect()
    assert len(got) == 300 and {(r.name, r.m) for r in got} == want
    assert looked.value <= 40  # three pairs, which a plan may ask for some times; 600 and more before


def test_catalogue_words_are_compared_once_for_each_different_name(spark, monkeypatch):
    looked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(value):
        looked.add(1)
        return value

    real = matching.ordered_trigrams
    monkeypatch.setattr(matching, "ordered_trigrams", lambda text: real(counted(text)))
    products = spark.createDataFrame([(k, "Vitamin C", ["a", None][k % 2], None, True) for k in range(100)], "product_id long, label string, name string, brand string, is_verified boolean")
    offers = spark.createDataFrame([], "product_id long, status string, price_cents long, valid_to date")
    got = matching.catalogue_search(products, offers, "vitamin c", "1998-06-15").collect()
    assert [r.product_id for r in got] == [*range(1, 100, 2), *range(0, 100, 2)]
    assert looked.value <= 20  # two names; 100 and more before


def test_plans_move_only_lines_of_products_on_offer(spark, sf_dir, monkeypatch):
    on_offer = {r.product_id for r in registry.live_products(spark, sf_dir).collect()}
    moved, real, want = [], retail.lines_of, retail.table(spark, sf_dir, "lineitem").where(F.col("l_partkey").isin(*on_offer)).count()

    def seen(lines, of):
        kept = real(lines, of)
        moved.append(kept.count())
        return kept

    monkeypatch.setattr(retail, "lines_of", seen)
    for name in ("deal_decisions", "alerts_matched", "plan_one_store", "plan_route", "plan_cover_one_store"):
        registry.QUERIES[name](spark, sf_dir)
    assert 0 < want < retail.table(spark, sf_dir, "lineitem").count() / 2 and moved == [want] * 5


def test_sets_of_stores_are_made_without_joins(spark):
    have = [(k, s) for k in range(6) for s in random.Random(k).sample(range(20), k)]
    sets = baskets.store_sets(spark.createDataFrame(have + have, "list_id long, store_id long"), 3)
    want = sorted((k, list(c)) for k in range(6) for n in (1, 2, 3) for c in itertools.combinations(sorted(s for i, s in have if i == k), n))
    assert sorted((r.list_id, r.set) for r in sets.collect()) == want
    assert "Join" not in sets._jdf.queryExecution().executedPlan().toString()
