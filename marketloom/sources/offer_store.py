"""The offer cache as pages read it: published once, with its tags and text indexes, and read many times.

``publish`` writes the cache as a versioned table divided by the month in which
offers end, an inverted table of their tags, and trigram indexes of labels and
searched texts. Pages and facets read only the months that can still be valid;
a search by tag reads only that tag's part; a search by text asks the indexes
which labels and texts it means.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions import tags
from marketloom.functions.text import fold
from marketloom.operators import search, trigram_index
from marketloom.operators.search import Search
from marketloom.operators.trigram_index import TrigramIndex
from marketloom.sources import retail
from marketloom.sources.folders import shared_folder
from marketloom.sources.versioned import VersionedTable

#: A publication must not shrink below this share of the present one.
LEAST_SHARE = 0.5
#: Columns that the stored cache has beyond those of :func:`marketloom.operators.search.build_cache`.
DERIVED = ("tags", "end_month", "folded_label")


@dataclass(frozen=True)
class OfferStore:
    """A published cache below ``root``."""

    spark: SparkSession
    root: str

    @property
    def table(self) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.root}/cache", "end_month")

    def cache(self, as_of: str | None = None) -> DataFrame:
        """The present version; with ``as_of`` only the months whose offers may end then or later."""
        month = as_of and as_of[:7]
        return self.table.read(only=(lambda value: value >= month) if month else None)

    def tagged(self, tag: str, as_of: str) -> DataFrame:
        """The offers of one tag: only its part of the inverted table is read."""
        rows = self.spark.read.parquet(f"{self._beside}/tags")
        return rows.where((F.col("tag") == tag) & (F.col("valid_to") >= F.lit(as_of).cast("date"))).drop("tag")

    @property
    def _beside(self) -> str:
        return f"{self.table.root}/{self.table.manifest()['beside']}"

    @property
    def labels(self) -> TrigramIndex:
        return TrigramIndex(self.spark, f"{self._beside}/labels")

    @property
    def texts(self) -> TrigramIndex:
        return TrigramIndex(self.spark, f"{self._beside}/texts")

    def query_tag(self, query: str) -> str | None:
        one = self.spark.range(1).select(tags.query_tag(tags.offer_tags(fold(F.lit(query)))).alias("tag"))
        return one.first()["tag"]

    def page(self, s: Search) -> DataFrame:
        """A page of :func:`search.page` from the published cache; a text is looked up in the indexes, a tag in its own table."""
        needle = (s.query or "").strip()
        if not needle:
            return search.page(self.cache(s.as_of), s)
        plain = replace(s, query=None)
        if s.semantic and (tag := self.query_tag(needle)):
            group = dict((t.name, t.group) for t in tags.TAGS)[tag]
            return search.page(self.tagged(tag, s.as_of).where(F.col("filter_group") == group), plain)
        asked = self.spark.range(1).select(fold(F.lit(needle)).alias("query"))
        offers = self.cache(s.as_of)
        by_text = trigram_index.containing(self.texts, asked).select(F.col("text").alias("search_text"), F.lit(True).alias("holds"))
        by_label = trigram_index.similar(self.labels, asked, search.FUZZY_PERMILLE).select(F.col("text").alias("folded_label"), F.lit(True).alias("alike"))
        found = offers.join(by_text, "search_text", "left").join(by_label, "folded_label", "left").where("holds or alike").select(*offers.columns)
        return search.page(found, plain)


def publish(store: OfferStore, offers: DataFrame, stores: DataFrame, products: DataFrame) -> int:
    """Write the next version of the cache, its tags and its indexes; the version's number.

    The first version has no lower bound of its size, every other one needs at
    least LEAST_SHARE of the rows of the one before.
    """
    rows = search.build_cache(offers, stores, products, derived=True).withColumn("end_month", F.date_format("valid_to", "yyyy-MM"))
    least = int(store.cache().count() * LEAST_SHARE) if store.table.versions() else 0

    def derived(now: DataFrame, at: str) -> None:
        now.withColumn("tag", F.explode("tags")).repartition("tag", F.pmod(F.xxhash64("offer_id"), F.lit(8))).write.partitionBy("tag").parquet(f"{at}/tags")
        for name, column in (("labels", "folded_label"), ("texts", "search_text")):
            trigram_index.build(now.select(F.col(column).alias("text")), f"{at}/{name}")

    return store.table.commit(rows, whole=True, least=least, key="offer_id", beside=derived)


_STORES: dict[tuple[str, str, str], OfferStore] = {}
_LABELS: dict[tuple[str, str, str], TrigramIndex] = {}


def _signature(spark: SparkSession, sf_dir: str) -> str:
    """Names, sizes and times of the files that a store is made from."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    found = []
    for name in ("lineitem", "orders", "supplier", "nation", "region", "part"):
        path = at(f"{sf_dir}/{name}.parquet")
        for f in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path):
            found.append(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}")
    return ",".join(sorted(found))


def of_tables(spark: SparkSession, sf_dir: str) -> OfferStore:
    """The store of the given tables, published by the first query of an application that asks for it and again when a table changes."""
    key = (spark.sparkContext.applicationId, sf_dir, _signature(spark, sf_dir))
    if key not in _STORES:
        store = OfferStore(spark, shared_folder(spark, "offer-store"))
        publish(store, retail.offers(spark, sf_dir), retail.stores(spark, sf_dir), retail.products(spark, sf_dir))
        _STORES[key] = store
    return _STORES[key]


def folded_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct folded labels of all products, whether on offer or not."""
    return retail.products(spark, sf_dir).select(fold(F.col("label")).alias("text")).distinct()


def product_labels(spark: SparkSession, sf_dir: str) -> TrigramIndex:
    """The index of :func:`folded_labels`, built by the first query that asks for it."""
    key = (spark.sparkContext.applicationId, sf_dir, _signature(spark, sf_dir))
    if key not in _LABELS:
        _LABELS[key] = trigram_index.build(folded_labels(spark, sf_dir), shared_folder(spark, "label-index"))
    return _LABELS[key]
