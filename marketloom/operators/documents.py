"""Structured sources: JSON in text and in pages, objects whose keys are data, product tiles of a page with their evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def embedded_json(html: Column, element: str) -> Column:
    """The JSON of the script element whose id is ``element``, as a variant; null if there is none or it can't be read."""
    body = F.regexp_extract(html, rf"""(?is)<script[^>]+id=["']{element}["'][^>]*>(.*?)</script>""", 1)
    return F.try_parse_json(F.nullif(F.trim(body), F.lit("")))


def objects_of(rows: DataFrame, body: Column, path: str, key: str = "key", value: str = "value") -> DataFrame:
    """A row for each member of the object at ``path``, whatever its keys; ``value`` stays a variant. Nothing for what is no object."""
    held = rows.withColumn("_object", F.try_variant_get(body, path, "variant"))
    return held.where(F.schema_of_variant("_object").startswith("OBJECT")).lateralJoin(held.sparkSession.tvf.variant_explode(F.col("_object").outer())).select(*(F.col(c) for c in rows.columns), F.col("key").alias(key), F.col("value").alias(value))


def money(text: Column) -> Column:
    """Cents of a price as shops write it: ``1 299,50``, ``1.299``, ``89,-``; null if there is no number."""
    plain = F.regexp_replace(text, "[\\s ]|\\.(?=[0-9]{3})", "")
    whole, rest = F.regexp_extract(plain, "^([0-9]{1,9})", 1), F.regexp_extract(plain, "^[0-9]+[,.]([0-9]{1,2})", 1)
    return F.when(whole != "", whole.cast("bigint") * 100 + F.coalesce(F.nullif(F.rpad(rest, 2, "0"), F.lit("00")).try_cast("bigint"), F.lit(0)))


TILE = "(?is)<li[^>]+data-qa=\"ProductTile\"[^>]*>"
#: Words beside a price that hold only for some customers or amounts.
CONDITIONAL = "(?i)for members|with code|coupon|when you buy|from [0-9]+ pcs"


def tiles(pages: DataFrame, html: str = "html") -> DataFrame:
    """The product tiles of each page: ``tile`` (its number), ``href``, ``title``, ``price_cents``, ``old_cents``, ``shown`` percent, ``conditional``.

    The page is cut where tiles begin, so every field is read from its own tile.
    """
    parts = F.slice(F.split(F.col(html), TILE), 2, 1 << 30)
    cut = pages.select(*[c for c in pages.columns if c != html], F.posexplode(parts).alias("tile", "block"))
    block = F.col("block")
    field = lambda pattern: F.nullif(F.regexp_extract(block, pattern, 1), F.lit(""))
    visible = F.regexp_replace(block, "<[^>]*>", " ")
    return cut.select(
        *[c for c in cut.columns if c != "block"],
        field('href="([^"]+)"').alias("href"),
        F.trim(field('(?i)aria-label="([^"]+)"')).alias("title"),
        money(field('(?i)data-qa="ProductPrice">\\s*([0-9\\s., ]+)')).alias("price_cents"),
        money(field("(?is)Original price.{0,300}?([0-9][0-9\\s. ]*(?:,[0-9]{1,2})?)")).alias("old_cents"),
        F.abs(field("-([0-9]{1,2})\\s*%").try_cast("int")).alias("shown"),
        visible.rlike(CONDITIONAL).alias("conditional"),
    )


def evident(found: DataFrame, least_cents: int = 1000, most_cents: int = 10_000_000) -> DataFrame:
    """Tiles whose fields prove each other: both prices, a fall between them, and a shown discount within one of the computed."""
    computed = F.round((F.col("old_cents") - F.col("price_cents")) / F.col("old_cents") * 100).cast("int")
    sound = F.col("href").isNotNull() & (F.length("title") >= 3) & F.col("price_cents").between(least_cents, most_cents) & (F.col("old_cents") > F.col("price_cents"))
    return found.withColumn("computed", computed).where(sound & ~F.col("conditional") & (F.abs(F.col("shown") - F.col("computed")) <= 1)).drop("conditional")


# Raised digits and the plain ones.
RAISED, DIGITS = "⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789"


def raised_cents(text: Column) -> Column:
    """Cents of a price whose hundredths are printed raised: ``12⁹⁰`` is 1290; null if the text has none."""
    found = F.regexp_extract(text, f"([0-9]{{1,6}})\\s*([{RAISED}]{{2}})", 0)
    return F.nullif(F.regexp_replace(F.translate(found, RAISED, DIGITS), "\\s", ""), F.lit("")).try_cast("bigint")


def blank_line_paragraphs(documents: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, and ``place`` (from 0) and ``paragraph`` of each run of lines between blank ones, outer space dropped."""
    parts = F.filter(F.transform(F.split(F.col(text), "\n[ \t\r]*(?:\n[ \t\r]*)+"), lambda p: F.regexp_replace(p, "^\\s+|\\s+$", "")), lambda p: p != "")
    return documents.select(*keep, F.posexplode(parts).alias("place", "paragraph"))


#: Columns of a recogniser's table, as far as they are used; level 5 is a word.
TSV = "level int, page bigint, word bigint, `left` bigint, top bigint, confidence double, text string"


def recognised_words(tables: DataFrame, body: str = "tsv") -> DataFrame:
    """Words out of tab-separated tables (one for each page, with a heading): ``page_id``, ``word_id``, place, whole ``confidence``, ``text``.

    Lines that are no word, hold no text, or were not recognised (below 0) are left out.
    """
    line = tables.select(F.explode(F.slice(F.split(body, "\n"), 2, 1 << 30)).alias("line")).where(F.trim("line") != "")
    row = line.select(F.from_csv("line", TSV, {"sep": "\t", "mode": "PERMISSIVE"}).alias("r")).select("r.*")
    words = row.where((F.col("level") == 5) & (F.trim("text") != "") & (F.col("confidence") >= 0))
    return words.select(F.col("page").alias("page_id"), F.col("word").alias("word_id"), "left", "top", F.floor("confidence").cast("bigint").alias("confidence"), "text")


def json_words(pages: DataFrame, body: str = "body") -> DataFrame:
    """The same out of JSON: ``{"page": .., "words": [{"id", "x", "y", "conf", "t"}, ..]}``; what can't be read has none."""
    doc = F.from_json(body, "page bigint, words array<struct<id: bigint, x: bigint, y: bigint, conf: bigint, t: string>>")
    return pages.select(doc.alias("d")).select(F.col("d.page").alias("page_id"), F.explode("d.words").alias("w")).select("page_id", F.col("w.id").alias("word_id"), F.col("w.x").alias("left"), F.col("w.y").alias("top"), F.col("w.conf").alias("confidence"), F.col("w.t").alias("text"))
