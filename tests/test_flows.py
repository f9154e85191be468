import datetime

from pyspark.sql import functions as F

from marketloom.sources.retail import AS_OF
from marketloom.streaming import changes, ledger, offers

DAY = datetime.date.fromisoformat(AS_OF)


def version(key, snapshot, **more):
    row = dict(key=key, snapshot=snapshot, offer_id=f"o{key}-{snapshot}", product_id=1, store_id=1, price_cents=100, status="published", is_verified=True, valid_from=DAY, valid_to=DAY)
    return tuple((row | more).values())


ago = lambda n: DAY - datetime.timedelta(days=n)
FIRST = [
    version(1, 0), version(2, 0, status="review"), version(3, 0, is_verified=False), version(4, 0, price_cents=None), version(5, 0), version(6, 0), version(7, 0), version(8, 0, valid_from=ago(9), valid_to=ago(5)),
    version(9, 0, valid_from=ago(-9), valid_to=ago(-20)), version(10, 0), version(11, 0, product_id=None), version(12, 0, is_verified=None),
]
SECOND = [
    version(1, 1), version(2, 1), version(3, 1), version(4, 1), version(5, 1, price_cents=99), version(6, 1, product_id=2), version(7, 1, store_id=2), version(8, 1), version(9, 1, valid_from=ago(-7), valid_to=ago(-20)),
    version(10, 1, price_cents=101), version(11, 1), version(12, 1, store_id=5, price_cents=50), version(13, 1), version(10, 2, price_cents=60),
]


def test_two_snapshots_with_a_restart_between(spark, tmp_path):
    schema = f"key long, {offers.VERSION}"

    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        with changes.state_store(spark, offers.ROCKSDB):
            made = offers.told(stream, AS_OF)
            made.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).format("parquet").start(str(tmp_path / "out")).awaitTermination()

    for k, rows in enumerate((FIRST, SECOND)):  # each run is a new query that goes on from the state of the one before
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"snapshot{k}"))
        run()
        run()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=str)
    want = sorted(map(tuple, offers.compared(spark.createDataFrame(FIRST + SECOND, schema), AS_OF).collect()), key=str)
    assert got == want
    why = {(r[0], r[1]): r[4] for r in got}
    assert {k: v for k, v in why.items() if v != "new"} == {
        (2, "o2-1"): "published", (3, "o3-1"): "verified", (4, "o4-1"): "priced", (5, "o5-1"): "cheaper", (6, "o6-1"): "product", (7, "o7-1"): "store", (8, "o8-1"): "again", (9, "o9-1"): "near",
        (10, "o10-2"): "cheaper", (11, "o11-1"): "product", (12, "o12-1"): "verified,cheaper,store",
    }


def test_a_silent_feed_is_told(spark, tmp_path):
    schema = f"key long, {offers.VERSION}"

    def run(rows, k):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"s{k}"))
        with changes.state_store(spark, offers.ROCKSDB):
            made = offers.told(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")), AS_OF, stale_ms=1)
            made.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).format("parquet").start(str(tmp_path / "out")).awaitTermination()
        return {(r.key, r.kind) for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    run([version(1, 0), version(2, 0)], 0)
    assert run([version(3, 1)], 1) >= {(1, "stale"), (2, "stale"), (3, "new")}


def test_notices_once_for_each_follower(spark):
    told = offers.compared(spark.createDataFrame(FIRST + SECOND, f"key long, {offers.VERSION}"), AS_OF)
    followers = spark.createDataFrame([(7, 1), (8, 1), (8, 2)], "user_id long, product_id long")
    got = offers.notices(told.unionByName(told), followers)
    assert got.count() == got.distinct().count() == 2 * told.where("product_id = 1").count() + told.where("product_id = 2").count()


def test_the_ledger_knows_content(spark, tmp_path):
    root = str(tmp_path)
    write = ledger.sink(spark, root, "source")
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 3), (None, 4)], "source string, value int")
    write(rows, 0)
    write(rows.orderBy(F.desc("value")).repartition(3), 17)  # the same in another order, under another number
    assert sorted(map(tuple, ledger.written(spark, root).collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    write(rows.where("source = 'a'").distinct(), 18)  # other content of one source, as one row less
    assert ledger.written(spark, root).count() == 7 and ledger.ledger(spark, root).count() == 4
    # Cut off before the ledger was written: the rows are written again to the same place.
    new = spark.createDataFrame([("c", 9)], "source string, value int")
    failing = ledger.sink(spark, root, "source")
    real = ledger.signatures(new, "source").first()
    new.selectExpr("*", "'c' as _source", f"'{real.signature}' as _signature").write.mode("append").partitionBy("_source", "_signature").parquet(f"{root}/rows")
    failing(new, 19)
    assert ledger.written(spark, root).where("source = 'c'").count() == 1


def test_batches_with_a_table_of_last_versions(spark, tmp_path):
    """No call to Python for each key; a batch run again tells nothing twice, and only two tables of last versions are kept."""
    schema, root = f"key long, {offers.VERSION}", str(tmp_path / "out")
    third = [version(1, 3, price_cents=50), version(14, 3), version(2, -1, price_cents=10)]  # an older snapshot that comes late counts as the newest
    batches = [spark.createDataFrame(rows, schema) for rows in (FIRST, SECOND, third, [])]
    assert offers.written(spark, root).count() == 0
    for n in (0, 1, 1, 2, 3):
        offers.sink(spark, root, AS_OF)(batches[n], n)
    got = sorted(map(tuple, offers.written(spark, root).collect()), key=str)
    late = offers.compared(spark.createDataFrame([*FIRST, *SECOND, third[0], third[1], version(2, 9, offer_id="o2--1", price_cents=10)], schema), AS_OF)
    assert got == sorted(map(tuple, late.collect()), key=str)
    assert sorted(p.parent.name for p in (tmp_path / "out").glob("batch=*/part=last")) == ["batch=2", "batch=3"]
    plans = offers._explained(batches[0], AS_OF, offers.ORDER)._jdf.queryExecution().toString()
    assert "Python" not in plans and "Pandas" not in plans
