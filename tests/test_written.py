import datetime
import os

import pytest

from marketloom.operators import upserts
from marketloom.operators.lifecycle import GuardError
from marketloom.sources.versioned import ConflictError, VersionedTable

SCHEMA = "offer_id string, product_id long, store_id long, title string, price_cents long, old_cents long, status string, is_verified boolean, confidence double, locked boolean, external_id string, valid_from date, valid_to date, coverage string, region string, city string, published_at timestamp, updated_at timestamp"
DAY, LATER = datetime.datetime(2026, 1, 1), datetime.datetime(2026, 1, 2)


def offer(ident, title="Milk", store=1, **more):
    row = dict(offer_id=ident, product_id=None, store_id=store, title=title, price_cents=100, old_cents=None, status="review", is_verified=None, confidence=None, locked=None, external_id=None, valid_from=DAY.date(), valid_to=LATER.date(), coverage="national", region=None, city=None, published_at=None, updated_at=DAY)
    return tuple((row | more).values())


def table_of(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def after(spark, old, new):
    return {r.offer_id: r for r in upserts.merged(table_of(spark, *old), table_of(spark, *new)).collect()}


def test_rules_by_column(spark):
    old = [
        offer("a", product_id=7, price_cents=200, old_cents=300, status="published", is_verified=True, confidence=0.9, published_at=DAY),
        offer("b", "Beer", locked=True), offer("c", "Tea", external_id="x1"), offer("d", "Rice", old_cents=90), offer("e", "Salt"),
    ]
    new = [
        offer("n1", " MILK ", price_cents=250, old_cents=240, confidence=0.5, updated_at=LATER), offer("n2", "beer", price_cents=1), offer("n3", "Tea", external_id="x1", price_cents=50, old_cents=10),
        offer("n4", "rice", price_cents=95, status="published", published_at=LATER, is_verified=False), offer("n5", "Tea"), offer("n6", "Milk", price_cents=1), offer("n7", None, store=2),
    ]
    got = after(spark, old, new)
    assert {k: r.change for k, r in got.items()} == {"a": "merged", "b": "locked", "c": "replaced", "d": "merged", "e": "kept", "n5": "added", "n7": "added"}
    a = got["a"]  # the row updated last counts; its old price is below its price, the former one is not
    assert (a.product_id, a.title, a.price_cents, a.old_cents, a.status, a.is_verified, a.confidence, a.published_at) == (7, " MILK ", 250, 300, "published", True, 0.9, DAY)
    assert (got["b"].price_cents, got["c"].price_cents, got["c"].old_cents) == (100, 50, 10)
    assert (got["d"].old_cents, got["d"].status, got["d"].is_verified, got["d"].published_at) == (None, "published", False, LATER)


def test_written_by_touched_partitions(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path), "store_id")
    with pytest.raises(LookupError):
        table.read()
    first = [offer("a"), offer("b", store=2), offer("z", store=None)]
    assert upserts.write_offers(table, table_of(spark, *first)) == 1
    held = table.read()  # a reader from before
    places = table.manifest()["parts"]
    assert upserts.write_offers(table, table_of(spark, offer("n", "Milk", price_cents=5), offer("m", "Tea"))) == 2
    now = table.manifest()["parts"]
    assert now["2"] == places["2"] and now["-"] == places["-"] and now["1"] != places["1"]
    assert {(r.offer_id, r.price_cents) for r in table.read().collect()} == {("a", 5), ("m", 100), ("b", 100), ("z", 100)}
    assert {(r.offer_id, r.price_cents) for r in held.collect()} == {("a", 100), ("b", 100), ("z", 100)}
    assert {r.offer_id for r in table.read(1).collect()} == {"a", "b", "z"}
    assert upserts.write_offers(table, table_of(spark, offer("k", store=2, title="Tea"))) == 3
    assert table.versions() == [2, 3] and not os.path.exists(tmp_path / places["1"]) and os.path.exists(tmp_path / places["-"])


def test_a_reader_between_the_steps_sees_the_old_version(spark, tmp_path, monkeypatch):
    table = VersionedTable(spark, str(tmp_path), "store_id")
    table.commit(table_of(spark, offer("a")))
    seen = []
    name = VersionedTable._name
    monkeypatch.setattr(VersionedTable, "_name", lambda self, *a: (seen.append({r.offer_id for r in table.read().collect()}), name(self, *a))[1])
    table.commit(table_of(spark, offer("b"), offer("c")))
    assert seen == [{"a"}] and {r.offer_id for r in table.read().collect()} == {"b", "c"}
    monkeypatch.undo()
    # A writer that began from an older version loses; so does one that writes too little, or a key twice.
    with pytest.raises(ConflictError):
        table.commit(table_of(spark, offer("x")), since=1)
    with pytest.raises(GuardError):
        table.commit(table_of(spark, offer("x")), least=2)
    with pytest.raises(GuardError):
        table.commit(table_of(spark, offer("x"), offer("x", "Tea")), key="offer_id")
    assert {r.offer_id for r in table.read().collect()} == {"b", "c"}
    assert sorted(os.listdir(tmp_path / "drafts")) == [] or all(n.endswith(".crc") for n in os.listdir(tmp_path / "drafts"))


def test_stores_share_a_bounded_number_of_parts(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path), "store_id", 4)
    upserts.write_offers(table, table_of(spark, *(offer(f"a{k}", store=k) for k in range(40)), offer("z", store=None)))
    places = table.manifest()["parts"]
    assert sorted(places) == ["-", "0", "1", "2", "3"] or sorted(places) == ["0", "1", "2", "3"]
    upserts.write_offers(table, table_of(spark, offer("b3", store=3, price_cents=5), offer("c3", "Tea", store=3)))
    assert sum(places[k] != at for k, at in table.manifest()["parts"].items()) == 1  # only the part of that store is written
    got = {(r.offer_id, r.store_id, r.price_cents) for r in table.read().collect()}
    assert got == {(f"a{k}", k, 5 if k == 3 else 100) for k in range(40)} | {("z", None, 100), ("c3", 3, 100)}


def test_old_and_new_rows_move_once(spark, tmp_path, monkeypatch):
    """One exchange for both, by the parts that are written; the commit adds none."""
    old, new = table_of(spark, offer("a"), offer("b", store=2)), table_of(spark, offer("n", price_cents=5), offer("m", "Tea"))

    def exchanges(rows):
        return rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")

    assert exchanges(upserts.merged(old, new)) == 1
    table, seen = VersionedTable(spark, str(tmp_path), "store_id", 4), []
    commit = VersionedTable.commit
    monkeypatch.setattr(VersionedTable, "commit", lambda self, rows, **how: (seen.append((exchanges(rows), "_partition" in rows.columns)), commit(self, rows, **how))[1])
    upserts.write_offers(table, old)
    upserts.write_offers(table, new)
    assert seen == [(1, True)] * 2
    assert {(r.offer_id, r.price_cents) for r in table.read().collect()} == {("a", 5), ("b", 100), ("m", 100)}
    # A table divided by anything else is dealt by the commit, as before.
    other = VersionedTable(spark, str(tmp_path / "other"), "coverage")
    upserts.write_offers(other, old)
    assert seen[-1] == (1, False) and set(other.manifest()["parts"]) == {"national"}
