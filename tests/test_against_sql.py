import pytest

from marketloom.plans import registry


def plain(rows):
    return sorted(str(list(r)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, duck, name):
    got = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    rows = plain(got.select(*columns).collect())
    # Some searches find nothing in the smallest tables; those are alike then, too.
    if name in registry.SQL:
        found = duck.execute(registry.SQL[name])
        names = [c[0] for c in found.description]
        assert sorted(names) == columns
        assert plain([r[names.index(c)] for c in columns] for r in found.fetchall()) == rows


def test_enough_queries_find_rows(spark, sf_dir):
    for name in ("page_recommended", "basket_metrics", "plan_route", "deal_scores", "alerts_matched", "stream_changes"):
        assert not registry.QUERIES[name](spark, sf_dir).isEmpty(), name


def test_entry_without_llm(spark, monkeypatch):
    import importlib
    import sys

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(registry.QUERIES) and set(entry.oracle_sql()) == set(registry.SQL)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)


def test_guard_keeps_the_present_snapshot(spark):
    from marketloom.operators import lifecycle

    old = spark.createDataFrame([(1, 5, "published"), (2, 6, "published")], "offer_id long, price_cents long, status string")
    with pytest.raises(lifecycle.GuardError):
        lifecycle.publish(old, old.limit(0), ["offer_id"], 1)
    again = lifecycle.publish(old, old.select("offer_id", "price_cents"), ["offer_id"], 2)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, old.collect()))


def test_texts(spark):
    from marketloom.functions import text

    rows = spark.createDataFrame([("Mléko  Plnotučné 1,5%",), ("4 x 50 g",), ("0,5 l",), ("1,00 kg",), ("010 Gloss",), ("Akce",), ("123",), ("Máslo",), (None,)], "t string")
    got = [tuple(r) for r in rows.select(text.fold(text.F.col("t")), text.pack_size_key(text.F.col("t")), text.label_is_specific(text.F.col("t"))).collect()]
    assert got[0][0] == "mleko plnotucne 1 5"
    assert [r[1] for r in got] == [None, "200g", "500ml", "1000g", None, None, None, None, None]
    assert [r[2] for r in got[5:]] == [False, False, True, False]
