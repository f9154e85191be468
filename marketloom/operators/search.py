"""Offer cache, pages, facets and fuzzy search."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions import tags
from marketloom.functions.text import filter_group, fold, once_each, similarity_permille, trigrams

HORIZON_DAYS = 7
SORTS = ("recommended", "discount", "cheapest", "dearest", "newest", "ending", "saving", "name")
MODES = ("all", "recommended", "food", "ending", "under50", "under100", "discount", "new")
FUZZY_PERMILLE = 240


def described(products: DataFrame) -> DataFrame:
    """Products with ``search_text``, ``filter_group``, ``tags`` and ``folded_label``, made once for each different text."""
    names = ["label", "brand", "name"]

    def made(texts: DataFrame) -> DataFrame:
        folded = texts.withColumns({"folded_label": fold(F.col("label")), "search_text": fold(F.concat_ws(" ", *names))})
        return folded.withColumns({"filter_group": filter_group(F.col("folded_label")), "tags": tags.offer_tags(F.col("search_text"))})

    return once_each(products, names, made).select(*products.columns, "search_text", "filter_group", "tags", "folded_label")


def build_cache(offers: DataFrame, stores: DataFrame, products: DataFrame, derived: bool = False) -> DataFrame:
    """Published, verified offers of active stores with their product, one of each set of copies.

    Filters run before the one shuffle; small dimensions are broadcast by the
    planner where their size allows it. Texts are derived by product, not by
    offer; with ``derived`` the ``tags`` and the ``folded_label`` come too.
    """
    o = offers.where("status = 'published' and is_verified").drop("status", "is_verified", "list_id", "quantity")
    s = stores.where("is_active").select("store_id", "slug", "city", "region")
    p = described(products.select("product_id", "label", "brand", "name", "category"))
    w = Window.partitionBy("store_id", "product_id", "price_cents", "valid_from", "valid_to").orderBy(F.col("old_cents").isNull(), F.desc("published_at"), "offer_id")
    first = o.join(s, "store_id").withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")
    wide = first.join(p if derived else p.drop("tags", "folded_label"), "product_id", "left")
    # An offer of no known product has an empty text.
    empty = {"search_text": F.lit(""), "filter_group": F.lit("other")} | ({"tags": F.array().cast("array<string>")} if derived else {})
    return wide.withColumns({name: F.coalesce(name, value) for name, value in empty.items()})


def live(cache: DataFrame, as_of: str) -> DataFrame:
    """Offers valid on ``as_of`` or beginning within the horizon, with their discount and score."""
    day = F.lit(as_of).cast("date")
    saved = F.col("old_cents") - F.col("price_cents")
    seen = cache.where((F.col("valid_to") >= day) & (F.col("valid_from") <= F.date_add(day, HORIZON_DAYS)))
    return seen.withColumns(
        {
            "upcoming": F.col("valid_from") > day,
            "off_permille": F.when(saved > 0, F.expr("(old_cents - price_cents) * 1000 div old_cents")).otherwise(0).cast("bigint"),
            "score": F.when(saved > 0, F.expr("(old_cents - price_cents) * 20000 div old_cents") + F.least(saved, F.lit(10000))).otherwise(0).cast("bigint"),
        }
    )


@dataclass(frozen=True)
class Search:
    """Parameters of a page; bad values fall back to defaults."""

    as_of: str
    limit: int = 24
    offset: int = 0
    sort: str = "recommended"
    mode: str = "all"
    store: str | None = None
    group: str | None = None
    region: str | None = None
    city: str | None = None
    min_cents: int | None = None
    max_cents: int | None = None
    query: str | None = None
    include_upcoming: bool = True
    #: Whether a query that means a tag finds the offers of that tag, instead of its text; the cache then has ``tags``.
    semantic: bool = False

    def bounds(self) -> tuple[int, int]:
        return min(max(self.limit, 1), 100), max(self.offset, 0)


def _mode(mode: str, as_of: str) -> Column | None:
    day = F.lit(as_of).cast("date")
    return {
        "recommended": F.col("score") > 0,
        "food": F.col("filter_group") == "food",
        "ending": F.datediff("valid_to", day).between(0, 2),
        "under50": F.col("price_cents") < 5000,
        "under100": F.col("price_cents") < 10000,
        "discount": F.col("off_permille") > 0,
        "new": F.datediff(day, F.to_date("published_at")).between(0, 3),
    }.get(mode)


def matched(cache: DataFrame, s: Search, without: tuple[str, ...] = ()) -> DataFrame:
    """Live offers that fit the search; ``without`` names parameters that do not count (for facets)."""
    found = live(cache, s.as_of)
    tests = {
        "store": s.store and F.col("slug") == s.store,
        "group": s.group and F.col("filter_group") == s.group,
        "min_cents": s.min_cents and s.min_cents > 0 and F.col("price_cents") >= s.min_cents,
        "max_cents": s.max_cents and s.max_cents > 0 and F.col("price_cents") <= s.max_cents,
        # An offer without a scope, or without a place, holds everywhere.
        "region": s.region and ((F.coalesce("coverage", F.lit("national")) == "national") | F.col("region").isNull() | (F.col("region") == s.region)),
        "city": s.city and (F.coalesce("coverage", F.lit("national")).isin("national", "region") | F.col("city").isNull() | (F.col("city") == s.city)),
    }
    for name, test in tests.items():
        if test is not None and not isinstance(test, (str, bool, int)) and name not in without:
            found = found.where(test)
    if not s.include_upcoming:
        found = found.where("not upcoming")
    if (test := _mode(s.mode, s.as_of)) is not None:
        found = found.where(test)
    needle = (s.query or "").strip()
    if needle and s.semantic:
        asked = fold(F.lit(needle))
        tag = tags.query_tag(tags.offer_tags(asked))
        by_tag = F.array_contains("tags", tag) & (F.col("filter_group") == tags.tag_group(tag))
        near = similarity_permille(trigrams(fold(F.col("label"))), trigrams(asked)) >= FUZZY_PERMILLE
        return found.where(F.when(tag.isNotNull(), by_tag).otherwise(F.contains(F.col("search_text"), asked) | near))
    if needle:
        folded = fold(F.lit(needle))
        near = similarity_permille(trigrams(fold(F.col("label"))), trigrams(folded)) >= FUZZY_PERMILLE
        found = found.where(F.contains(F.col("search_text"), folded) | near)
    return found


def order(s: Search) -> list[Column]:
    key = {
        "recommended": [F.desc("score")],
        "discount": [F.desc("off_permille")],
        "cheapest": [F.asc("price_cents")],
        "dearest": [F.desc("price_cents")],
        "newest": [],
        "ending": [F.asc("valid_to")],
        "saving": [F.greatest(F.coalesce("old_cents", F.lit(0)) - F.col("price_cents"), F.lit(0)).desc()],
        "name": [F.asc_nulls_last("label")],
    }.get(s.sort, [F.desc("score")])
    first = {"discount": [F.desc("off_permille")], "new": [F.desc("published_at")]}.get(s.mode, [])
    return [F.asc("upcoming"), *first, *key, F.desc_nulls_last("published_at"), F.asc("offer_id")]


def page(cache: DataFrame, s: Search) -> DataFrame:
    """One page in order; a top-k, not a whole sort."""
    limit, offset = s.bounds()
    return matched(cache, s).orderBy(*order(s)).offset(offset).limit(limit)


def total(cache: DataFrame, s: Search) -> DataFrame:
    count = lambda c: F.count_if(c).alias
    return matched(cache, s).agg(F.count("*").alias("total"), count(F.col("upcoming"))("upcoming"), count(~F.col("upcoming"))("current"))


def store_facet(cache: DataFrame, s: Search) -> DataFrame:
    return matched(cache, s, ("store",)).groupBy("slug").agg(F.count("*").alias("n"))


def group_facet(cache: DataFrame, s: Search) -> DataFrame:
    return matched(cache, s, ("group",)).groupBy("filter_group").agg(F.count("*").alias("n"))


def top_per_store(cache: DataFrame, as_of: str, k: int) -> DataFrame:
    """The ``k`` best products of each store, the best offer of each product first found."""
    best = Window.partitionBy("store_id", "product_id").orderBy(F.desc("off_permille"), "price_cents", "offer_id")
    rank = Window.partitionBy("store_id").orderBy(F.desc("off_permille"), "price_cents", "offer_id")
    once = live(cache, as_of).withColumn("_b", F.row_number().over(best)).where("_b = 1")
    return once.withColumn("place", F.row_number().over(rank).cast("bigint")).where(F.col("place") <= k).drop("_b")
