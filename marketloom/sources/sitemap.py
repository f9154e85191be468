"""Sitemaps: addresses written as XML, in as many files as there are parts, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A sitemap may hold so many addresses.
PART_ROWS = 50_000
_SCHEMA = "loc string, lastmod string, priority string"


def write(urls: DataFrame, at: str) -> None:
    """Write ``loc``, ``lastmod`` (a date) and ``priority`` of each address below ``at``, at most PART_ROWS to a file."""
    rows = urls.select("loc", F.date_format("lastmod", "yyyy-MM-dd").alias("lastmod"), F.format_string("%.1f", F.col("priority").cast("double")).alias("priority"))
    writer = rows.write.format("xml").option("rootTag", 'urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"').option("rowTag", "url").option("declaration", "version='1.0' encoding='UTF-8'")
    writer.option("maxRecordsPerFile", PART_ROWS).save(at)


def read(spark: SparkSession, at: str) -> DataFrame:
    return spark.read.format("xml").schema(_SCHEMA).option("rowTag", "url").load(at)
