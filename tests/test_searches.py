import random

import pytest

from pyspark.sql import functions as F

from marketloom.functions import tags, text
from marketloom.operators import trigram_index
from marketloom.operators.search import Search
from marketloom.sources import offer_store, retail
from marketloom.sources.retail import AS_OF

F = text.F


def pieces(folded):
    return [f"  {w} "[i : i + 3] for w in folded.split() for i in range(len(w) + 1)]


def alike(a, b):
    return 1000 * len(a & b) // len(a | b) if a | b else 0


def test_word_similarity_is_the_best_of_all_runs(spark):
    rng = random.Random(3)
    words = lambda n: " ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, n)))
    rows = [(words(3), words(7)) for _ in range(300)] + [("word", "two words"), ("", "ab"), ("ab", ""), ("kava", "mleta kava kavovar")]
    docs = spark.createDataFrame(rows, "q string, t string")
    got = docs.select("q", "t", text.word_similarity_permille(text.trigrams(F.col("q")), text.ordered_trigrams(F.col("t"))).alias("w")).collect()
    for r in got:
        q, t = set(pieces(r.q)), pieces(r.t)
        best = max((alike(q, set(t[i:j])) for i in range(len(t)) for j in range(i + 1, len(t) + 1)), default=0)
        assert r.w == best, r
    assert {(r.q, r.t): r.w for r in got}["word", "two words"] == 800
    null = spark.createDataFrame([(None, "a"), ("a", None)], "q string, t string")
    assert [r[0] for r in null.select(text.word_similarity_permille(text.trigrams(F.col("q")), text.ordered_trigrams(F.col("t")))).collect()] == [0, 0]


@pytest.fixture(scope="module")
def titles(spark, sf_dir, tmp_path_factory):
    made = retail.titles(spark, sf_dir.replace("sf0.001", "sf0.01")).select(text.fold(F.col("title")).alias("text"))
    return trigram_index.build(made, str(tmp_path_factory.mktemp("index") / "at"))


@pytest.mark.parametrize("least", [240, 500, 900])
def test_lookups_find_all_and_look_at_few(spark, titles, least):
    known = [r.text for r in titles.texts.collect()]
    sets = {t: set(pieces(t)) for t in known}
    want = {(a, b): alike(sets[a], sets[b]) for a in known for b in known if alike(sets[a], sets[b]) >= least}
    queries = titles.texts.withColumnRenamed("text", "query")
    assert {(r.query, r.text): r.permille for r in trigram_index.similar(titles, queries, least).collect()} == want
    # Postings joined with themselves would give every pair that shares a piece, as often as it does.
    shared = sum(len(sets[a] & sets[b]) for a in known for b in known)
    looked = trigram_index.candidates(titles, queries, least).count()
    assert looked < shared / 10 and (least < 900 or looked < 3 * len(want))


def test_a_lookup_reads_the_buckets_of_its_pieces(spark, titles):
    one = spark.createDataFrame([("the reation",)], "query string")
    found = trigram_index.containing(titles, one)
    assert {r.text for r in found.collect()} == {r.text for r in titles.texts.collect() if "the reation" in r.text}
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString().lower()


def test_unknown_pieces_and_empty_texts(spark, tmp_path):
    index = trigram_index.build(spark.createDataFrame([("abc",), ("",), (None,), ("abc",), ("xy",)], "text string"), str(tmp_path / "at"))
    assert sorted(r.text for r in index.texts.collect()) == ["", "abc", "xy"]
    asked = spark.createDataFrame([("qqq",), ("abc",), ("",)], "query string")
    assert [tuple(r) for r in trigram_index.similar(index, asked, 300).collect()] == [("abc", "abc", 1000)]
    assert sorted(tuple(r) for r in trigram_index.containing(index, spark.createDataFrame([("x",), ("bc",), ("abc",), ("zzz",)], "query string")).collect()) == [("abc", "abc"), ("bc", "abc"), ("x", "xy")]


TAGGED = {
    "Máslo 250 g": ["butter"], "Kuřecí prsa chlazená": ["chicken", "meat"], "Podprsenka na velká prsa, top": [], "Zavináče v nálevu, veka": [], "Rohlík 43 g": ["bread", "rolls"],
    "Jablka červená": ["fruit_fresh"], "Jablečný džus": [], "Nápoj jablko, dzus": ["fruit_drink"], "Mražené jahody": ["fruit_frozen"], "Granule pro psy hovězí": [], "Eidam 30 % sýr": ["cheese", "eidam"],
    "Bramborové lupínky": ["potatoes", "veg_fresh"], "Bramborové chipsy chips": ["potatoes"], "Světlý ležák pivo": ["beer"], "Televize 55": [],
}


def test_tags_and_their_collisions(spark):
    rows = spark.createDataFrame([(k,) for k in TAGGED] + [(None,)], "t string")
    got = {r[0]: r[1] for r in rows.select("t", tags.offer_tags(text.fold(F.col("t")))).collect()}
    assert {k: v for k, v in got.items() if k} == TAGGED and not got[None]
    asked = spark.createDataFrame([("chleba",), ("Pivo",), ("sampon",), ("gouda sýr",)], "t string")
    found = asked.select(tags.query_tag(tags.offer_tags(text.fold(F.col("t")))).alias("tag")).select("tag", tags.tag_group(F.col("tag"))).collect()
    assert [tuple(r) for r in found] == [("loaf", "food"), ("beer", "drinks"), (None, None), ("gouda", "food")]


def test_the_store_is_read_and_guarded(spark, sf_dir, tmp_path):
    from marketloom.operators.lifecycle import GuardError

    store = offer_store.OfferStore(spark, str(tmp_path))
    parts = retail.offers(spark, sf_dir), retail.stores(spark, sf_dir), retail.products(spark, sf_dir)
    assert offer_store.publish(store, *parts) == 1
    whole = store.cache()
    # Only months that can still be valid are read, and only those of the tag.
    assert 0 < len(store.cache(AS_OF).inputFiles()) < len(whole.inputFiles())
    page = store.page(Search(AS_OF, query="máslo", semantic=True))
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert page.count() and "= butter)" in plan.split("PartitionFilters: [")[1].split("]")[0]
    before = page.collect()
    with pytest.raises(GuardError):
        offer_store.publish(store, parts[0].where("product_id < 5"), *parts[1:])
    assert store.table.versions() == [1] and store.page(Search(AS_OF, query="máslo", semantic=True)).collect() == before
    for n in (2, 3):
        assert offer_store.publish(store, *parts) == n
    assert store.table.versions() == [2, 3] and store.page(Search(AS_OF, query="máslo", semantic=True)).collect() == before
    again = offer_store.of_tables(spark, sf_dir)
    assert offer_store.of_tables(spark, sf_dir) is again


def test_similar_pairs_by_blocks(spark):
    """Every pair once and no row for each shared piece, whatever the blocks; equal to comparing all pairs."""
    words = ["mleko", "maslo", "maso", "kava", "kavovar", "pivo", "syr", "x"]
    texts = spark.createDataFrame([(f"{a} {b}",) for a in words for b in words] + [("",), ("a",)], "text string")
    sets = texts.select("text", trigram_index.trigrams(F.col("text")).alias("set"))
    value = trigram_index.similarity_permille(F.col("set"), F.col("other_set")).alias("permille")
    all_pairs = sets.crossJoin(sets.selectExpr("text as other", "set as other_set")).where("text < other").select("text", "other", value).where("permille >= 300")
    want = sorted(map(tuple, all_pairs.collect()))
    for block in (1000, 7):
        found = trigram_index.similar_pairs(texts, 300, block)
        assert sorted(map(tuple, found.collect())) == want
    assert "Join" not in found._jdf.queryExecution().toString() and len(want) > 100
