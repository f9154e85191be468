"""Offers and links out of documents: tiles, paragraphs, URLs and lines of words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def links(pages: DataFrame) -> DataFrame:
    """Anchors of each page in order: address and text."""
    found = F.regexp_extract_all("html", F.lit(r'<a href="[^"]*">[^<]*</a>'), F.lit(0))
    each = pages.select("page_id", F.posexplode(found).alias("place", "tile"))
    return each.select("page_id", F.col("place").cast("bigint").alias("place"), F.regexp_extract("tile", 'href="([^"]*)"', 1).alias("href"), F.regexp_extract("tile", ">([^<]*)<", 1).alias("title"))


def fields(pages: DataFrame) -> DataFrame:
    """Language, title and first heading of each page."""
    get = lambda p: F.nullif(F.regexp_extract("html", p, 1), F.lit(""))
    return pages.select("page_id", get('<html lang="([a-z]+)"').alias("lang"), get("<title>([^<]*)</title>").alias("title"), get("<h1>([^<]*)</h1>").alias("heading"))


def canonical_url(url):
    """Without fragment and tracking parameters, the rest sorted."""
    base = F.regexp_extract(url, r"^([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike("^(utm_[a-z]+|ref|width|height)=")))
    return F.concat(base, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def url_score(url):
    """Points of a link as a leaflet document; below 60 it is none."""
    points = ((r"\.pdf($|\?)", 70), (r"\.html($|\?)", 30), (r"/(en|de)/", 20), (r"/[0-9]+", 15), (r"utm_source", -25), (r"(adult|spam|bets)", -100))
    return sum((F.when(url.rlike(p), n).otherwise(0) for p, n in points), F.lit(0)).cast("bigint")


def document_candidates(links: DataFrame, least: int = 60) -> DataFrame:
    """``url`` and ``score`` of links (``href``) worth opening: each canonical address once, at its best score of at least ``least``."""
    scored = links.select(canonical_url(F.col("href")).alias("url"), url_score(F.col("href")).alias("score")).where(F.col("score") >= least)
    return scored.groupBy("url").agg(F.max("score").alias("score"))


def paragraphs(documents: DataFrame) -> DataFrame:
    """Lines of each document with their place, length and nearest earlier short line (its heading)."""
    line = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    short = F.when(F.length("line") < 40, F.col("place"))
    w = Window.partitionBy("doc_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return line.select("doc_id", F.col("place").cast("bigint").alias("place"), F.length("line").cast("bigint").alias("n_chars"), F.last(short, ignorenulls=True).over(w).cast("bigint").alias("heading_place"))


def word_lines(words: DataFrame, bucket: int = 4) -> DataFrame:
    """Recognised words joined to lines: those of a page whose heights round to one bucket, from the left."""
    y = F.expr(f"(top + {bucket // 2}) div {bucket} * {bucket}")
    grouped = words.groupBy("page_id", y.alias("y")).agg(
        F.array_sort(F.collect_list(F.struct("left", "text"))).alias("_w"), F.min("left").alias("x_min"), F.max("left").alias("x_max"), F.sum("confidence").alias("_c"), F.count("*").alias("n_words")
    )
    return grouped.select("page_id", "y", "x_min", "x_max", "n_words", F.expr("_c div n_words").alias("confidence"), F.array_join(F.transform("_w", lambda w: w["text"]), " ").alias("line"))


def nearest_titles(prices: DataFrame, titles: DataFrame, dx: int = 250, dy: int = 120) -> DataFrame:
    """For each price the nearest title on its page, above or beside it; distance counts height twice."""
    p, t = prices.alias("p"), titles.alias("t")
    near = (F.col("p.page_id") == F.col("t.page_id")) & (F.abs(F.col("p.x") - F.col("t.x")) <= dx) & (F.col("p.y") - F.col("t.y")).between(0, dy)
    far = F.abs(F.col("p.x") - F.col("t.x")) + 2 * (F.col("p.y") - F.col("t.y"))
    w = Window.partitionBy("page_id", "price_id").orderBy("distance", "title_id")
    pairs = p.join(t, near).select(F.col("p.page_id").alias("page_id"), "price_id", "title_id", far.cast("bigint").alias("distance"))
    return pairs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
