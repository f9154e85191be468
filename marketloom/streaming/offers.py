"""Changes of offers that followers are told of, and feeds that fall silent, from a stream of offer versions.

State per offer is its last version. A new version is told if it can be seen
now and differs from the one before in one of eight ways. A timer of processing
time, set anew by every version, tells of an offer whose source has gone quiet.
:func:`sink` keeps the same state as a table that each batch makes anew: it has
no timers, and compares all keys of a batch at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

HORIZON_DAYS = 7
#: A feed is stale after so long without a version.
STALE_MS = 45 * 60 * 1000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
VERSION = "snapshot long, offer_id string, product_id long, store_id long, price_cents long, status string, is_verified boolean, valid_from date, valid_to date"
TOLD = "key long, offer_id string, product_id long, price_cents long, reasons string, kind string"
#: Versions of an offer follow each other by these.
ORDER = ("snapshot", "valid_from", "offer_id")
#: Why a version is told, in this order; ``new`` is the first version of an offer.
REASONS = ("new", "published", "verified", "priced", "cheaper", "product", "store", "again", "near")


def visible(as_of: str) -> Column:
    """Published, verified offers of a known product, valid now or within the horizon."""
    day = F.lit(as_of).cast("date")
    return F.col("product_id").isNotNull() & (F.col("status") == "published") & F.coalesce("is_verified", F.lit(False)) & (F.col("valid_to") >= day) & (F.col("valid_from") <= F.date_add(day, HORIZON_DAYS))


def _reasons(old, new, day, horizon) -> list[str]:
    """Names of REASONS that hold between two versions; ``old`` is None for the first."""
    if old is None:
        return ["new"]
    tests = {
        "published": old.status != new.status and new.status == "published",
        "verified": not old.is_verified and bool(new.is_verified),
        "priced": old.price_cents is None and new.price_cents is not None,
        "cheaper": old.price_cents is not None and new.price_cents is not None and new.price_cents < old.price_cents,
        "product": old.product_id != new.product_id,
        "store": old.store_id != new.store_id,
        "again": None not in (old.valid_to, new.valid_to) and old.valid_to < day <= new.valid_to,
        "near": None not in (old.valid_from, new.valid_from) and new.valid_from <= horizon < old.valid_from,
    }
    return [r for r in REASONS if tests.get(r)]


class OfferChanges(StatefulProcessor):
    """Keeps the last version of each offer; gives rows of ``TOLD``."""

    def __init__(self, as_of: str, stale_ms: int | None) -> None:
        import datetime

        self.day = datetime.date.fromisoformat(as_of)
        self.horizon = self.day + datetime.timedelta(days=HORIZON_DAYS)
        self.stale_ms = stale_ms
        self.schema = StructType.fromDDL(VERSION)  # here, as workers have no session to parse it

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        names = self.schema.names
        last = Row(*names)(*self.last.get()) if self.last.exists() else None
        for new in sorted(rows, key=lambda r: (r.snapshot, r.valid_from, r.offer_id)):
            why = _reasons(last, new, self.day, self.horizon)
            seen = new.product_id is not None and new.status == "published" and new.is_verified and new.valid_to >= self.day and new.valid_from <= self.horizon
            if why and seen:
                yield Row(key=key[0], offer_id=new.offer_id, product_id=new.product_id, price_cents=new.price_cents, reasons=",".join(why), kind="cheaper" if "cheaper" in why else "new")
            last = new
        if last is not None:
            self.last.update(tuple(last[n] for n in names))
        if self.stale_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.stale_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        last = dict(zip(self.schema.names, self.last.get(), strict=True))
        yield Row(key=key[0], offer_id=last["offer_id"], product_id=last["product_id"], price_cents=last["price_cents"], reasons="", kind="stale")

    def close(self) -> None:
        pass


def told(versions: DataFrame, as_of: str, stale_ms: int | None = STALE_MS) -> DataFrame:
    """A stream of ``key`` and the columns of ``VERSION`` turned into one of ``TOLD``; needs the RocksDB state store."""
    return versions.groupBy("key").transformWithState(OfferChanges(as_of, stale_ms), TOLD, "append", "ProcessingTime")


def _explained(versions: DataFrame, as_of: str, order: tuple[str, ...]) -> DataFrame:
    """``versions`` with ``old``, the one before; ``why``, the names of REASONS that hold; and whether each is the ``newest`` of its key."""
    w = Window.partitionBy("key").orderBy(*order)
    names = StructType.fromDDL(VERSION).names
    both = versions.withColumns({"old": F.lag(F.struct(*names)).over(w), "newest": F.lead(F.lit(True)).over(w).isNull()})
    day = F.lit(as_of).cast("date")
    old = F.col("old")
    tests = {
        "new": old.isNull(),
        "published": ~old["status"].eqNullSafe(F.col("status")) & (F.col("status") == "published"),
        "verified": ~F.coalesce(old["is_verified"], F.lit(False)) & F.col("is_verified"),
        "priced": old["price_cents"].isNull() & F.col("price_cents").isNotNull(),
        "cheaper": F.col("price_cents") < old["price_cents"],
        "product": ~old["product_id"].eqNullSafe(F.col("product_id")),
        "store": ~old["store_id"].eqNullSafe(F.col("store_id")),
        "again": (old["valid_to"] < day) & (F.col("valid_to") >= day),
        "near": (old["valid_from"] > F.date_add(day, HORIZON_DAYS)) & (F.col("valid_from") <= F.date_add(day, HORIZON_DAYS)),
    }
    why = F.array_compact(F.array(*(F.when(tests[r] if r == "new" else old.isNotNull() & tests[r], r) for r in REASONS)))
    return both.withColumn("why", why)


def _told(explained: DataFrame) -> DataFrame:
    kind = F.when(F.array_contains("why", "cheaper"), "cheaper").otherwise("new")
    return explained.select("key", "offer_id", "product_id", "price_cents", F.array_join("why", ",").alias("reasons"), kind.alias("kind"))


def compared(versions: DataFrame, as_of: str) -> DataFrame:
    """What :func:`told` tells, by one window over a table that has all versions."""
    return _told(_explained(versions, as_of, ORDER).where(visible(as_of) & (F.size("why") > 0)))


def sink(spark: SparkSession, root: str, as_of: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that writes below ``root`` what :func:`told` tells of each batch, without timers.

    The last version of each key stands in a table that each batch reads and
    makes anew; one window compares the keys of a batch. A batch that is run
    again reads the same table and replaces its own folder, so nothing is told
    twice. Tables before the one that the last batch read are deleted.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    schema = StructType.fromDDL(f"key long, {VERSION}")

    def write(batch: DataFrame, n: int) -> None:
        found = (f.getPath().getName() for f in fs.listStatus(path(root)) if fs.exists(path(f"{f.getPath()}/_SUCCESS"))) if fs.exists(path(root)) else ()
        done = sorted(k for k in (int(name.removeprefix("batch=")) for name in found if name.startswith("batch=")) if k < n)
        last = f"{root}/batch={done[-1]}/part=last" if done else None
        old = spark.read.schema(schema).parquet(last) if last and fs.exists(path(last)) else spark.createDataFrame([], schema)
        both = old.withColumn("fresh", F.lit(0)).unionByName(batch.select(*schema.names).withColumn("fresh", F.lit(1)))
        rows = _explained(both, as_of, ("fresh", *ORDER))
        parts = F.array_compact(F.array(F.when(F.col("newest"), "last"), F.when((F.col("fresh") == 1) & visible(as_of) & (F.size("why") > 0), "told")))
        rows.select(*schema.names, "why", F.explode(parts).alias("part")).write.mode("overwrite").partitionBy("part").parquet(f"{root}/batch={n}")
        for k in done[:-1]:
            fs.delete(path(f"{root}/batch={k}/part=last"), True)

    return write


def written(spark: SparkSession, root: str) -> DataFrame:
    """What a stream into :func:`sink` has told, as rows of ``TOLD``."""
    schema = StructType.fromDDL(f"key long, {VERSION}, why array<string>, batch int, part string")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):  # an empty stream runs no batch
        return spark.createDataFrame([], TOLD)
    return _told(spark.read.schema(schema).option("basePath", root).parquet(f"{root}/batch=*").where("part = 'told'"))


def notices(told_rows: DataFrame, followers: DataFrame) -> DataFrame:
    """One notice for each follower (``user_id``, ``product_id``), offer and price; told again, it is the same row."""
    return told_rows.where("kind <> 'stale'").join(followers, "product_id").select("user_id", "product_id", "offer_id", "price_cents", "kind").dropDuplicates(["user_id", "offer_id", "price_cents"])
